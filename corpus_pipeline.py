"""Corpus pipeline: five stages over whole documents, in this order.

1. quality: documents that the quality classifier rejects go.
2. line_dedup: lines that repeat an earlier line, nearly or exactly, go from
   their texts; the documents stay, though a copy may be left with no text.
3. near_duplicates: of documents with linked fingerprints the one of the
   smallest id stays, whatever ids the documents have.
4. decontamination: documents that hold a passage of the benchmark go.
5. encoding: texts are encoded to token ids; decoded bytes equal the texts'.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of
docs. Each works on all rows it is given; rows with a null id or text pass
through the stages like others, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewtrail.llm import byte_bpe, decontaminate, line_dedup, quality_gam, simhash
from viewtrail.llm._common import free_name, stored, table
from viewtrail.plans.shipping import ship

#: No stage but the first could be stated in SQL; tests hold them to brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    score, kept = free_name(docs, "quality_score"), free_name(docs, "quality_kept")
    return quality_gam.classify(docs, model, score_col=score, kept_col=kept).filter(kept).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component.

    Rows are told apart by id and text: ids may be null or stand for several
    texts. Rows of equal id and text are in one component, so one of them stays.
    """
    ship(spark)
    own = docs.withColumn("_vt_h1", F.xxhash64("text")).withColumn("_vt_h2", F.xxhash64(F.lit(1), "text"))
    keep = simhash.representatives(own, ["_vt_h1", "_vt_h2"]).select(F.col("doc_id").alias("_vt_id"), F.col("_vt_h1").alias("_vt_k1"), F.col("_vt_h2").alias("_vt_k2"))
    same = own["doc_id"].eqNullSafe(F.col("_vt_id")) & (F.col("_vt_h1") == F.col("_vt_k1")) & (F.col("_vt_h2") == F.col("_vt_k2"))
    return own.join(keep, same, "left_semi").dropDuplicates(["doc_id", "_vt_h1", "_vt_h2"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
