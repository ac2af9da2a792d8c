"""Exact top-k search by tiled matrix products.

The stated queries are taken in blocks of bounded bytes. For each block every
shard of the candidates is multiplied with it tile by tile; each tile keeps its
k best per query by partial selection and folds them into the shard's list.
The lists of the shards are merged as a tree: first within groups of shards,
then over the groups. No task holds more than one block, one tile and the
lists of one group.

Scores are integer inner products of floor(1024 * x). Where the components are
small enough for every partial sum to be exact in float64 (below 2**53) the
tiles go through BLAS; otherwise the products are exact Python integers, held
to the range of a long at the end. A component beyond the range of a long is
held to that range, as a cast to long does.

Defined cases: vectors that are null, empty or hold a null or non-finite
component take no part, nor do rows with a null id. Vectors of other lengths
than the query's are not comparable with it and no candidates of it. Rows that
repeat an id are one query for each distinct vector but all of them stay
candidates of others; no row is a candidate of its own id. Ties go to the
smaller id. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored, table

#: Bytes of one block of queries, and rows of the two sides of a tile.
BLOCK_BYTES, TILE_QUERIES, TILE_ROWS = 32 << 20, 256, 4096
SCHEMA = "query_id long, query_key long, vec_id long, score long"


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id long, vec array<long>) of the rows that take part."""
    x = F.col("_vt_vec")
    whole = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e))
    finite = ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("_vt_vec"))
        .filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False)))
        .select("vec_id", whole.alias("vec"))
    )


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products, in float64 or as integers."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return q.astype(np.float64) @ c.astype(np.float64).T
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def select(scores: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of each row's k best, ties to smaller ids; own ids never."""
    allowed = q_ids[:, None] != ids[None, :]
    low = np.iinfo(np.int64).min if scores.dtype == np.int64 else -np.inf
    held = np.where(allowed, scores, low)
    if held.shape[1] > k:
        least = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
        row, col = np.nonzero((held >= least[:, None]) & allowed)
    else:
        row, col = np.nonzero(allowed)
    found, value = ids[col], scores[row, col].astype(np.int64)
    order = np.lexsort((found, np.invert(value), row))  # ~v falls as v rises, without overflow
    row, found, value = row[order], found[order], value[order]
    first = np.searchsorted(row, np.arange(len(q_ids)))
    keep = np.arange(len(row)) - first[row] < k if len(row) else np.zeros(0, bool)
    return row[keep], found[keep], value[keep]


def _shard_lists(block: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], k: int):
    """mapInPandas function: a shard's k best for each query of the block.

    block: (length, ids, keys, vectors) for each length of vector; a key tells
    queries of one id apart.
    """

    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            lengths = pdf["vec"].map(len).to_numpy()
            for n, q_ids, _, q in block:
                mine = pdf[lengths == n]
                for a in range(0, len(mine), TILE_ROWS):
                    part = mine.iloc[a : a + TILE_ROWS]
                    ids, c = part["vec_id"].to_numpy(np.int64), np.stack(part["vec"].to_list()).astype(np.int64)
                    for b in range(0, len(q_ids), TILE_QUERIES):
                        own = q_ids[b : b + TILE_QUERIES]
                        row, found, value = select(_product(q[b : b + TILE_QUERIES], c), own, ids, k)
                        old = best.get((n, b))
                        if old is not None:
                            row, found, value = (np.concatenate(x) for x in zip(old, (row, found, value), strict=True))
                            order = np.lexsort((found, np.invert(value), row))
                            row, found, value = row[order], found[order], value[order]
                            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                            row, found, value = row[keep], found[keep], value[keep]
                        best[n, b] = row, found, value
        shard = TaskContext.get().partitionId()
        for n, q_ids, q_keys, _ in block:
            for b in range(0, len(q_ids), TILE_QUERIES):
                if (n, b) in best:
                    row, found, value = best[n, b]
                    yield pd.DataFrame({"query_id": q_ids[b + row], "query_key": q_keys[b + row], "vec_id": found, "score": value, "shard": shard})

    return run


def _k_best(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score of every query's k best candidates."""
    spark = queries.sparkSession
    q = stored(quantised(queries, id_col, vector_col, scale).dropDuplicates().withColumn("_vt_n", F.size("vec")).withColumn("_vt_key", F.xxhash64("vec")), "topk-queries")
    size = q.agg(F.count("*"), F.sum(F.col("_vt_n") + 4) * 8).first()
    blocks = max(1, math.ceil((size[1] or 0) / block_bytes))
    q = q.withColumn("_vt_block", F.pmod(F.xxhash64("vec_id", "_vt_key"), F.lit(blocks)))
    rows = quantised(candidates, id_col, vector_col, scale)
    lists = None
    for b in range(blocks if size[0] else 0):
        pdf = q.filter(F.col("_vt_block") == b).drop("_vt_block").toPandas()
        block = [(int(n), g["vec_id"].to_numpy(np.int64), g["_vt_key"].to_numpy(np.int64), np.stack(g["vec"].to_list()).astype(np.int64)) for n, g in pdf.groupby("_vt_n")]
        shards = rows.mapInPandas(_shard_lists(block, k), f"{SCHEMA}, shard int")
        fan = max(2, math.isqrt(max(1, candidates.rdd.getNumPartitions())))
        groups = _k_best(shards.withColumn("_vt_group", F.pmod(F.col("shard"), F.lit(fan))), ["query_id", "query_key", "_vt_group"], k)
        part = _k_best(groups.drop("rank"), ["query_id", "query_key"], k).select("query_id", "rank", "vec_id", "score")
        part = stored(part, "topk-block") if blocks > 1 else part  # a lost job repeats one block only
        lists = part if lists is None else lists.unionByName(part)
    if lists is None:
        lists = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return lists


def query(spark, sf_dir: str) -> DataFrame:
    """op1: rows whose vec_id is divisible by 100, against every row."""
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows.filter(F.col("vec_id") % 100 == 0), rows)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.vec) + 1), lambda i: q.vec[i] * c.vec[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.vec) = len(q.vec)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
