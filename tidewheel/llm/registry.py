"""Queries of this subpackage and, where SQL can express them, their SQL."""

from tidewheel.llm import decontaminate, importance, language, mixing, passages, quality, secrets, sharding, simhash, urls


def queries():
    return {
        "op1_simhash_components": simhash.op1_simhash_components,
        "op2_repeated_passages": passages.op2_repeated_passages,
        "op3_url_filter": urls.op3_url_filter,
        "op4_importance_resample": importance.op4_importance_resample,
        "op5_mix_sources": mixing.op5_mix_sources,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_language_id": language.op8_language_id,
        "op9_secret_scan": secrets.op9_secret_scan,
        "op10_shuffle_shards": sharding.op10_shuffle_shards,
    }


def oracle_sql():
    return {
        "op3_url_filter": urls.OP3_SQL,
        "op5_mix_sources": mixing.OP5_SQL,
        "op6_quality_rules": quality.OP6_SQL,
        "op7_decontaminate": decontaminate.OP7_SQL,
    }
