"""Outputs that are replaced at once and keyed tables that are not rewritten."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from viewtrail.sources.snapshots import CommitConflict, KeyedLog, Snapshots, bucket_of


def numbers(df) -> list[int]:
    return sorted(r[0] for r in df.collect())


def test_readers_see_one_state_whole(spark, tmp_path):
    out = Snapshots(spark, tmp_path.as_uri())
    with pytest.raises(LookupError):
        out.read()
    assert out.replace(spark.range(5)) == 1
    before = out.read()  # a reader that is slower than the next wave
    assert out.replace(spark.range(10, 13)) == 2
    assert numbers(before) == [0, 1, 2, 3, 4] and numbers(out.read()) == [10, 11, 12] and numbers(out.read(1)) == [0, 1, 2, 3, 4]
    assert out.replace(spark.range(0)) == 3 and numbers(out.read()) == []
    with pytest.raises(LookupError):
        out.read(9)


def test_a_failed_wave_leaves_the_old_state(spark, tmp_path):
    out = Snapshots(spark, tmp_path.as_uri())
    out.replace(spark.range(5))
    with pytest.raises(Exception):  # noqa: B017
        out.replace(spark.range(5).withColumn("id", F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("id"))))
    assert numbers(out.read()) == [0, 1, 2, 3, 4] and out.numbers() == [1]
    (tmp_path / "commits" / "0000000002.json").write_text("")  # a writer that is lost while it commits
    assert numbers(out.read()) == [0, 1, 2, 3, 4] and out.numbers() == [1]


def test_two_writers_and_expiry(spark, tmp_path):
    out = Snapshots(spark, tmp_path.as_uri())
    out.replace(spark.range(1))
    with pytest.raises(CommitConflict):
        out.log.commit(1, {})
    for n in range(2, 5):
        out.replace(spark.range(n))
    out.expire(2)
    assert out.numbers() == [3, 4] and numbers(out.read()) == [0, 1, 2, 3]
    assert len([f for f in os.listdir(tmp_path) if f.startswith("state-")]) == 2


def test_updates_against_a_dictionary(spark, tmp_path):
    rng, want = random.Random(4), {}
    held = KeyedLog(spark, tmp_path.as_uri(), "id", spark.createDataFrame([], "id string, n long").schema, buckets=8)
    assert held.read().collect() == []
    states = {}
    for turn in range(7):
        new = [(f"k{rng.randrange(60)}", 100 * turn + i) for i in range(rng.choice([0, 3, 40]))]
        number = held.update(spark.createDataFrame(new, "id string, n long"), "n")
        for k, n in new:
            want[k] = n
        if turn in (2, 5):
            held.compact(0.5)
        states[number] = dict(want)
        assert {r["id"]: r["n"] for r in held.read().collect()} == want
    for number, rows in states.items():
        assert {r["id"]: r["n"] for r in held.read(number).collect()} == rows


def test_an_update_writes_its_buckets_alone(spark, tmp_path):
    held = KeyedLog(spark, tmp_path.as_uri(), "id", spark.createDataFrame([], "id string, n long").schema, buckets=64)
    old = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("id"), F.col("id").alias("n"))
    held.update(old)
    assert held.compact() == 64
    before = {f for _, _, files in os.walk(tmp_path) for f in files if f.endswith(".parquet")}
    new = old.filter("n % 100 = 7").withColumn("n", -F.col("n"))
    held.update(new)
    own = {r[0] for r in new.select(bucket_of("id", 64)).collect()}
    written = [(d, f) for d, _, files in os.walk(tmp_path) for f in files if f.endswith(".parquet") and f not in before]
    assert {int(d.rsplit("bucket=", 1)[1]) for d, _ in written} == own and len(written) == len(own) < 64
    assert held.read().count() == 3000 and held.read().agg(F.sum("n")).first()[0] == 3000 * 2999 // 2 - 2 * sum(range(7, 3000, 100))
    plan = held._live(held._state()[1], [3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]


def test_lost_writers_and_unsafe_keys(spark, tmp_path):
    held = KeyedLog(spark, tmp_path.as_uri(), "id", spark.createDataFrame([], "id string, n long").schema, buckets=4)
    held.update(spark.createDataFrame([("a", 1), ("b", 2)], "id string, n long"))
    held._write(spark.createDataFrame([("a", 99)], "id string, n long"))  # written, never committed
    assert {r["id"]: r["n"] for r in held.read().collect()} == {"a": 1, "b": 2}
    with pytest.raises(Exception, match="unsafe key"):
        held.update(spark.createDataFrame([("../c", 3)], "id string, n long"))
    assert held.update(spark.createDataFrame([("b", 5)], "id string, n long")) == 2
    assert {r["id"]: r["n"] for r in held.read().collect()} == {"a": 1, "b": 5}
    own = {r[0] for r in spark.createDataFrame([("a",), ("b",)], "id string").select(bucket_of("id", 4)).collect()}
    assert held.compact(0.0) == len(own) and held.compact(0.0) == 0
    assert {r["id"]: r["n"] for r in held.read().collect()} == {"a": 1, "b": 5}
