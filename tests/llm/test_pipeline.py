"""The stages on a small corpus of planted cases."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import pytest

import corpus_pipeline
from tests.llm.test_decontaminate import text

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "encoding"]


def test_whole_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF).collect()
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert 0.5 * len(ids) < len(got) <= len(ids) and {r["doc_id"] for r in got} <= ids and len({r["doc_id"] for r in got}) == len(got)


def test_planted_cases(spark):
    rng = random.Random(9)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 150").orderBy("item_id").first()["text"]
    clean = [text(rng, 200) for _ in range(6)]
    copy = clean[0]
    leak = f"{text(rng, 30)} {item} {text(rng, 30)}"
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)] + [(100, copy, "en", "s", 1), (101, copy + " tail", "en", "s", 1), (102, leak, "en", "s", 1), (103, None, "en", "s", 0), (None, "a text without an id", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    near = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert near.columns == docs.columns
    kept = {r["doc_id"] for r in near.collect()}
    assert {0, 1, 2, 3, 4, 5, 102, 103, None} <= kept and 100 not in kept
    left = {r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, SF).collect()}
    assert left == {r[0] for r in rows} - {102}
    done = {r["doc_id"]: r for r in corpus_pipeline.encoding(spark, docs, SF).collect()}
    assert done[0]["decoded_sha256"] == hashlib.sha256(clean[0].encode()).hexdigest() and done[103]["n_tokens"] == 0


def test_near_duplicates_keeps_rows_of_null_and_repeated_ids(spark):
    rng = random.Random(10)
    a, b, c, d, e = (text(rng, 120) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (None, c), (5, c), (5, d), (7, e), (7, e), (8, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert len(got) == 5 and set(got) == {(8, a), (None, b), (5, c), (5, d), (7, e)}


def test_empty_table_stays_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs_out = stage(spark, docs, SF)
        assert docs_out.collect() == []


def test_columns_of_the_operators_names_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "'own' AS quality_score", "'own' AS quality_kept", "'own' AS leaked", "'own' AS line").limit(40)
    for name in ("quality", "decontamination"):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
        assert out.columns == docs.columns and {r["leaked"] for r in out.collect()} <= {"own"}
