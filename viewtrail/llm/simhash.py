"""SimHash near-duplicates: exact Hamming pairs by vantage-point trees.

Fingerprints are 64-bit majority votes over the XXH64 hashes of word shingles.
Equal fingerprints collapse first. A vantage-point tree over a bounded sample
cuts the space into shards: a fingerprint lives in one shard, and by the
triangle inequality it must also be looked up in the shards beyond any boundary
that it is within the radius of. Each shard answers its look-ups with a tree of
its own, pruning branches by the same bounds and comparing leaves whole. A
shard reports a spanning forest of its links only, so groups of thousands of
near copies cost as many rows as members. A shard with too many rows is cut
into chunks of homes and look-ups, every pair of which is a task. Components
come from the union of all forests.

Defined cases: a text without words, an empty and a null text have fingerprint
zero, which links like any other; fewer words than a shingle are one shingle;
repeated rows and equal texts share a fingerprint, hence a component; a null id
gets its component like any other row, and component_id is the smallest id that
isn't null. An empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ._common import stored, table
from ._components import components

#: Fingerprints that a shard should hold; the sample's bound; shards at most;
#: rows of a shard beyond which it is cut into chunks.
SHARD_ROWS, SAMPLE, SHARDS, CHUNK_ROWS = 16_384, 65_536, 2048, 400_000
#: Fingerprints of a leaf that are compared with all look-ups that reach it.
LEAF = 512


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles], dtype=np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, also .., fp long): the fingerprint's bits as a signed long."""
    source = docs.select(docs[id_col].alias("doc_id"), *also, docs[text_col].alias("_vt_text"))
    names = ["doc_id", *also]
    schema = StructType([source.schema[c] for c in names]).add("fp", LongType())

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), width) for t in batch.column("_vt_text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(values)], names=[*names, "fp"])

    return source.mapInArrow(run, schema)


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _vantage(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The candidate point whose distances spread most, and their median cut."""
    trial = points if len(points) <= 1024 else rng.choice(points, 1024, replace=False)
    best = None
    for v in rng.choice(points, min(8, len(points)), replace=False):
        d = distance(trial, v)
        cut = int(np.median(d))
        if not (distance(points, v) > cut).any():
            cut -= 1
        if cut < 0 or not (d > cut).any():
            continue
        near = float(np.mean(np.abs(d.astype(np.int64) - cut) <= 3))
        if best is None or near < best[0]:
            best = near, v, cut
    return None if best is None else (best[1], best[2])


def plan_tree(sample: np.ndarray, depth: int, rng: np.random.Generator, smallest: int = 8):
    """Nested (vantage, cut, inside, outside); leaves are None."""
    if depth == 0 or len(sample) < 2 * smallest or (found := _vantage(sample, rng)) is None:
        return None
    v, cut = found
    inside = distance(sample, v) <= cut
    return v, cut, plan_tree(sample[inside], depth - 1, rng, smallest), plan_tree(sample[~inside], depth - 1, rng, smallest)


def route(tree, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, shard, home): each point's own shard and those it must look into."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []

    def walk(node, number: int, index: np.ndarray, home: np.ndarray) -> None:
        if not len(index):
            return
        if node is None:
            out.append((index, number, home))
            return
        v, cut, inside, outside = node
        d = distance(points[index], v).astype(np.int64)
        near, far = d <= cut + radius, d > cut - radius
        walk(inside, 2 * number, index[near], home[near] & (d[near] <= cut))
        walk(outside, 2 * number + 1, index[far], home[far] & (d[far] > cut))

    walk(tree, 1, np.arange(len(points)), np.ones(len(points), bool))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate([x[0] for x in out]), np.concatenate([np.full(len(x[0]), x[1]) for x in out]), np.concatenate([x[2] for x in out])


class _Forest:
    """Union-find over indices that keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.parent[i]
        while len(up := np.flatnonzero(self.parent[r] != r)):
            r[up] = self.parent[r[up]]
        self.parent[i] = r
        return r

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins pairs in ever longer runs; what earlier runs joined is passed over at once.

        A crowd of m points so costs m * m array elements, but few Python steps.
        """
        kept, at, step = [], 0, 1024
        while at < len(a):
            x, y = a[at : at + step], b[at : at + step]
            apart = self.roots(x) != self.roots(y)
            for i, j in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
                r, s = self.root(i), self.root(j)
                if r != s:
                    self.parent[max(r, s)] = min(r, s)
                    kept.append((i, j))
            at, step = at + step, step * 2
        if kept:
            self.links.append(tuple(np.array(kept).T))


def shard_links(points: np.ndarray, homes: np.ndarray, lookups: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (i, j) of all pairs home x look-up within the radius."""
    forest = _Forest(len(points))

    def compare(h: np.ndarray, q: np.ndarray) -> None:
        step = max(1, (1 << 20) // max(1, len(h)))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            i, j = np.nonzero(distance(points[part][:, None], points[h][None, :]) <= radius)
            a, b = part[i], h[j]
            other = a != b
            forest.add(a[other], b[other])

    def walk(h: np.ndarray, q: np.ndarray, depth: int) -> None:
        if not len(h) or not len(q):
            return
        if len(h) <= LEAF or len(q) <= 8 or depth > 48 or (found := _vantage(points[h], rng)) is None:
            compare(h, q)
            return
        v, cut = found
        dh, dq = distance(points[h], v).astype(np.int64), distance(points[q], v).astype(np.int64)
        walk(h[dh <= cut], q[dq <= cut + radius], depth + 1)
        walk(h[dh > cut], q[dq > cut - radius], depth + 1)

    walk(homes, lookups, 0)
    if not forest.links:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in forest.links]), np.concatenate([x[1] for x in forest.links])


def links(fps: DataFrame, radius: int = 3, shard_rows: int = SHARD_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(x, y) links of distinct fingerprints ``fp`` that span all components."""
    spark = fps.sparkSession
    count = fps.count()
    shards = min(SHARDS, max(1, -(-count // shard_rows)))
    share = min(1.0, SAMPLE / max(1, count))
    # A tree's shape decides no result, only how evenly shards are filled.
    chosen = fps.filter(F.pmod(F.xxhash64("fp"), F.lit(1_000_003)) < int(share * 1_000_003) + 1).toPandas()
    sample = np.sort(chosen["fp"].to_numpy(np.int64).view(np.uint64))
    tree = plan_tree(sample, max(0, int(shards - 1).bit_length()), np.random.default_rng(7))

    def deal(batches):
        for pdf in batches:
            points = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            index, shard, home = route(tree, points, radius)
            yield pd.DataFrame({"shard": shard.astype(np.int64), "fp": points.view(np.int64)[index], "home": home})

    dealt = fps.mapInPandas(deal, "shard long, fp long, home boolean")
    dealt = stored(dealt, "simhash-shards")
    sizes = dealt.groupBy("shard").agg(F.count_if("home").alias("homes"), F.count("*").alias("lookups"))
    large = {r["shard"]: (-(-r["homes"] // chunk_rows) or 1, -(-r["lookups"] // chunk_rows)) for r in sizes.filter(F.col("lookups") > chunk_rows).collect()}
    own = F.xxhash64("fp")
    cut = dealt.withColumn("h", F.lit(0)).withColumn("q", F.lit(0))
    if large:  # at most SHARDS entries
        plan = F.broadcast(spark.createDataFrame([(k, *v) for k, v in large.items()], "shard long, nh int, nq int"))
        split = dealt.join(plan, "shard")
        as_home = split.filter("home").withColumn("h", F.pmod(own, F.col("nh")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
        as_query = split.withColumn("home", F.lit(False)).withColumn("q", F.pmod(own, F.col("nq")).cast("int")).withColumn("h", F.explode(F.sequence(F.lit(0), F.col("nh") - 1)))
        both = as_home.withColumn("role", F.lit(1)).unionByName(as_query.withColumn("role", F.lit(2)))
        cut = dealt.join(plan, "shard", "left_anti").withColumn("h", F.lit(0)).withColumn("q", F.lit(0)).withColumn("role", F.lit(3)).unionByName(both.drop("nh", "nq"))
    else:
        cut = cut.withColumn("role", F.lit(3))

    def answer(key, pdf):
        points = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        role, home = pdf["role"].to_numpy(), pdf["home"].to_numpy(bool)
        homes, lookups = np.flatnonzero(((role & 1) > 0) & home), np.flatnonzero((role & 2) > 0)
        # In chunks a home and its own look-up are rows apart; that link goes below.
        i, j = shard_links(points, homes, lookups, radius, np.random.default_rng(int(key[0]) & 0x7FFFFFFF))
        out = pd.DataFrame({"x": points.view(np.int64)[i], "y": points.view(np.int64)[j]})
        return out[out["x"] != out["y"]]

    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return cut.repartition(n, "shard", "h", "q").groupBy("shard", "h", "q").applyInPandas(answer, "x long, y long")


def _rooted(prints: DataFrame, radius: int, shard_rows: int, chunk_rows: int) -> DataFrame:
    """Distinct fingerprints ``fp`` with the root of their component."""
    roots = components(links(prints.select("fp"), radius, shard_rows, chunk_rows))
    return prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def representatives(docs: DataFrame, keys: list[str], id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, shard_rows: int = SHARD_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """doc_id and keys of one row of each component, whatever ids its rows have.

    It is the row of the smallest id, then of the smallest keys; a null id is
    last. The keys should tell rows of different texts apart.
    """
    prints = stored(fingerprints(docs, id_col, text_col, width, tuple(keys)), "simhash-fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *keys)
    least = stored(prints.groupBy("fp").agg(F.min(place).alias("least")), "simhash-distinct")
    first = _rooted(least, radius, shard_rows, chunk_rows).groupBy("root").agg(F.min("least").alias("least"))
    return first.select(*(F.col(f"least.{c}").alias(c) for c in ("doc_id", *keys)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, shard_rows: int = SHARD_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id; one row per input row."""
    prints = stored(fingerprints(docs, id_col, text_col, width), "simhash-fingerprints")
    least = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = _rooted(least, radius, shard_rows, chunk_rows)
    ids = found.groupBy("root").agg(F.min("least").alias("component_id"))
    # Only fingerprints that several rows or several fingerprints share need a look-up.
    by_print = found.join(ids, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: all documents, three-word shingles, three bits."""
    return near_duplicates(table(spark, sf_dir, "documents"))
