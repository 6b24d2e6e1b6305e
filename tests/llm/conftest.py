import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text[, source]) with columns whose names operators use inside."""

    def build(rows, extra=True):
        df = spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], DOCS)
        if extra:
            from pyspark.sql import functions as F

            for c in ("size", "fp", "node", "shard", "slot", "copies", "target", "score", "root", "u", "v", "n_words", "kept"):
                df = df.withColumn(c, F.lit("x"))
        return df

    return build


@pytest.fixture
def sf(tmp_path, spark):
    """A folder of tables, as the queries read them."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Small tables and many steps: fewer tasks are faster."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
