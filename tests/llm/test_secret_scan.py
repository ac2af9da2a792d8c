from __future__ import annotations

import hashlib

import pytest

from viewtrail.llm import secret_scan as m


@pytest.fixture(scope="module")
def forest(spark):
    return m.train(m.example_findings(spark, 3000))


def test_trees_as_expressions_find_secrets(spark, forest):
    hexes = hashlib.sha1(b"x").hexdigest()
    rows = [
        (1, f'set token = "{hexes}" here', "src/a", 1), (2, f"see commit {hexes} for this", "src/a", 1), (3, "your_api_key_here_please = sample_user_data_token", "docs/x", 1),
        (4, None, "src/a", 1), (5, "", None, 1), (None, f'password = "{hexes}"', None, 1), (1, f'set token = "{hexes}" here', "src/a", 1), (6, "plain words only and nothing else to see", "src/a", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score int")
    got = m.scan(docs, forest).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["is_secret"] for r in by[1]] == [True, True] and by[1][0]["sha256"] == hashlib.sha256(hexes.encode()).hexdigest()
    assert not any(r["is_secret"] for r in by[2] + by[3]) and by[None][0]["is_secret"]
    assert not {4, 5, 6} & set(by)
    assert m.scan(docs.filter("false"), forest).collect() == []


def test_held_out_findings(spark, forest):
    from pyspark.sql import functions as F

    later = m.example_findings(spark, 6000).withColumn("n", F.monotonically_increasing_id()).filter("n >= 3000")
    x = m.features(*map(F.col, ("candidate", "before", "after", "path")))
    held = later.select("label", F.array(*(v.cast("double") for v in x.values())).alias("x"))
    got = held.select((m.score(forest, [F.col("x")[k] for k in range(len(x))]) >= 0.5).cast("int").alias("p"), "label")
    assert got.filter("p = label").count() / got.count() > 0.97
