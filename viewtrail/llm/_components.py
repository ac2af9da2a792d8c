"""Connected components of an edge list, by alternating stars over tables.

Each round writes its edges to the shared folder, so that a lost executor costs
one round and the plan stays short. A large star links every neighbour above a
node to the least of its neighbourhood, a small star every neighbour below it;
the result is a star around the least node of each component. The least
neighbour of a node is found by an aggregate with partial sums on the map side,
and a node with many neighbours is only ever one side of a join, which adaptive
execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_folder, scratch


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over undirected edges (a, b), a > b; returns the same form."""
    a, b = F.col("a"), F.col("b")
    if large:
        pairs = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).unionAll(edges.select(b.alias("n"), a.alias("m")))
        least = pairs.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))
        out = pairs.filter(F.col("m") > F.col("n")).join(least, "n").select(F.col("m").alias("a"), F.col("least").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("least"))
        both = edges.join(least, "a")
        out = both.select(F.when(b == F.col("least"), a).otherwise(b).alias("a"), F.col("least").alias("b"))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(node, root) of every node that has an edge; root is the least reachable.

    Nodes may be of any type that can be ordered. Loops, repeated and null
    edges are ignored; no edges give an empty table.
    """
    spark = edges.sparkSession
    path = scratch(spark, "components")
    now = _write(edges.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) != F.col(y))).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), path)
    mark = None
    while True:
        mixed = F.xxhash64("a", "b")
        state = now.agg(F.count("*"), F.sum(F.shiftright(mixed, 20)), F.bit_xor(mixed)).first()
        if state[0] == 0 or state == mark:
            break
        mark = state
        last, path = path, scratch(spark, "components")
        now = _write(_star(_star(now, True), False), path)
        drop_folder(spark, last)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
