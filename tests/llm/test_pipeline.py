"""The pipeline's stages against plain definitions on a small table."""

import random

import corpus_pipeline
from tidewheel.llm import quality
from tests.llm.test_corpus import edited, prose


def test_pipeline(spark, make, sf):
    rng = random.Random(31)
    base = [prose(200, rng) for _ in range(40)]
    bench = prose(30, rng)
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "s0") for i in range(10)] + [(200, base[0] + " " + bench, "s1"), (201, prose(80, rng) + " " + bench, "s1"), (202, "too short", "s1"), (203, None, "s1")]
    docs = make(rows, extra=False)
    path = sf(documents=docs, benchmark=spark.createDataFrame([(1, bench)], "item_id bigint, text string"))
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_rules", "near_duplicates", "decontamination", "mix", "shards"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    one = steps["quality_rules"](spark, docs, path)
    assert ids(one) == sorted(d for d, t, _ in rows if quality.measure(t)[6]) and 202 not in ids(one)
    two = steps["near_duplicates"](spark, one, path)
    assert not any(100 <= d < 200 for d in ids(two)) and set(range(40)) <= set(ids(two))
    three = steps["decontamination"](spark, two, path)
    assert ids(three) == [d for d in ids(two) if d not in (200, 201)]
    four = steps["mix"](spark, three, path)
    assert set(ids(four)) <= set(ids(three)) and max(ids(four).count(d) for d in set(ids(four))) <= 3
    for df in (one, two, three, four):
        assert df.columns == docs.columns
    out = corpus_pipeline.run(spark, path)
    assert ids(out) == ids(four)
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    empty = sf(documents=make([], extra=False))
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert edited("a", 1)
