"""Periodic runs of words: maximal repetitions in whole texts.

A run is a stretch of consecutive words with smallest period q, at least twice
as long as q and of at least so many words, that no neighbouring word extends.
A stretch of period p and 2p words holds two neighbours jp and (j+1)p of the
grid of p, so it is enough to compare those: the grids of all periods have
n/1 + n/2 + .. points, a harmonic sum. Periods are taken in blocks [b, 2b), in
which no period divides another; few periods with many points are compared a
period at a time, many periods with few points a point number at a time, both
as strided arrays. Equal neighbours inside a run that is known, of a period that
divides p, are passed over: that stretch is the run itself, or too short. The
others must match at five words about them, too, and half a period away; what
is left is extended to both sides by chunks of doubling length.

Texts of like length are laid in a row and searched together, with numbers that
equal none of another text. Memory is a small multiple of their words; a longer
text is searched alone.

Defined cases: a null text has no words and no run, and its collapsed text is
empty; fewer words than the bound hold no run; repeated rows are answered each;
a null id is kept; an empty table gives an empty result; other columns aren't
read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable
from itertools import chain, compress, count
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from ._common import crc32_sql, table

#: Words of a run at least; rows that are read at once; words that are searched at once, but for a longer text.
LEAST, ROWS, TOGETHER = 12, 256, 65_536
#: Words about a grid point that are compared before it is extended; a run has as many in common and one more.
NEAR = 5
RUN = StructType().add("start", LongType()).add("length", LongType()).add("period", LongType())


def word_numbers(texts: list[list[bytes]]) -> np.ndarray:
    """Numbers of the words of texts in a row: equal ones are equal words of one text."""
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    total = sum(map(len, texts))
    own = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int64, total)
    return own * len(texts) + np.repeat(np.arange(len(texts)), [len(t) for t in texts])


class _Text:
    """Word numbers between margins that equal nothing."""

    def __init__(self, numbers: np.ndarray):
        margin = np.arange(-2 * NEAR, 0)
        self.n, self.numbers = len(numbers), numbers
        self.padded = np.concatenate([margin[:NEAR], numbers, margin[NEAR:]])

    def same(self, at: np.ndarray, p: np.ndarray, step: int) -> np.ndarray:
        """Whether the words ``step`` from both grid points are equal; step is small."""
        return self.padded[at + (step + NEAR)] == self.padded[at + p + (step + NEAR)]

    def far(self, at: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The same of any places; False beyond the text."""
        inside = (at >= 0) & (at + p < self.n)
        low = np.where(inside, at, 0)
        return inside & (self.numbers[low] == self.numbers[np.where(inside, at + p, 0)])

    def probes(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, period) of all equal neighbours on the grids of periods in [low, high)."""
        w, n, places, periods = self.numbers, self.n, [], []
        if low <= isqrt(n):
            for p in range(low, high):
                grid = w[::p]
                hit = np.flatnonzero(grid[1:] == grid[:-1])
                places.append(hit * p)
                periods.append(np.full(len(hit), p))
        else:
            j = 0
            while (j + 1) * low < n:
                top = min(high - 1, (n - 1) // (j + 1))
                first = w[j * low : j * top + 1 : j] if j else w[:1]
                hit = np.flatnonzero(first == w[(j + 1) * low : (j + 1) * top + 1 : j + 1]) + low
                places.append(hit * j)
                periods.append(hit)
                j += 1
        return np.concatenate(places), np.concatenate(periods)

    def plausible(self, at: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those with NEAR matches in a row beside them, and one half a period away."""
        sides = []
        for sign in (1, -1):
            run, alive = np.zeros(len(at), np.int64), np.arange(len(at))
            for d in range(1, NEAR + 1):
                alive = alive[self.same(at[alive], p[alive], sign * d)]
                if not len(alive):
                    break
                run[alive] = d
            sides.append(run)
        keep = sides[0] + sides[1] >= NEAR
        at, p = at[keep], p[keep]
        half = p // 2
        keep = self.far(at - half, p) | self.far(at + p - half, p)
        return at[keep], p[keep]

    def stretch(self, at: int, p: int) -> tuple[int, int]:
        """The widest [start, end) about ``at`` in which each word equals the one p further."""
        w, last = self.numbers, self.n - p
        end, size = at + 1, 64
        while end < last:
            stop = min(last, end + size)
            equal = w[end:stop] == w[end + p : stop + p]
            if not equal.all():
                end += int(equal.argmin())
                break
            end, size = stop, size * 2
        start, size = at, 64
        while start > 0:
            stop = max(0, start - size)
            equal = w[stop:start] == w[stop + p : start + p]
            if not equal.all():
                start -= int(equal[::-1].argmin())
                break
            start, size = stop, size * 2
        return start, end


def find_runs(numbers: np.ndarray, least: int = LEAST, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period.

    ``least`` is over twice NEAR; no run is longer than ``longest``, by default the whole.
    """
    if least < 2 * (NEAR + 1):
        raise ValueError(f"runs of under {2 * (NEAR + 1)} words are not looked for")
    most = min(len(numbers), len(numbers) if longest is None else longest) // 2
    if 2 * most < least - 1:
        return []
    text, found, low = _Text(numbers), {}, 1
    while low <= most:
        high = min(2 * low, most + 1)
        at, p = text.probes(low, high)
        for q, runs in found.items():  # known runs of a period that divides p
            ends = np.array(runs)
            which = np.flatnonzero(p % q == 0)
            near = np.searchsorted(ends[:, 0], at[which], side="right") - 1
            inside = (near >= 0) & (at[which] + p[which] < ends[near, 1])
            keep = np.ones(len(at), bool)
            keep[which[inside]] = False
            at, p = at[keep], p[keep]
        at, p = text.plausible(at, p)
        order = np.lexsort((at, p))
        period = end = 0
        fresh: dict[int, list[tuple[int, int]]] = {}
        for i, q in zip(at[order].tolist(), p[order].tolist(), strict=True):
            if q == period and i < end:
                continue
            period = q
            start, end = text.stretch(i, q)
            if end - start >= max(q, least - q):
                fresh.setdefault(q, []).append((start, end + q))
        found |= fresh
        low *= 2
    return sorted((s, e - s, q) for q, runs in found.items() for s, e in runs)


def runs_of_texts(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs of each text. Texts of like length are laid in a row and searched at once."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((i for i, t in enumerate(texts) if len(t) >= least), key=lambda i: len(texts[i]))
    while order:
        group, total = [], 0
        while order and (not group or total + len(texts[order[-1]]) <= TOGETHER):
            group.append(order.pop())
            total += len(texts[group[-1]])
        starts = np.cumsum([0, *(len(texts[i]) for i in group[:-1])])
        runs = find_runs(word_numbers([texts[i] for i in group]), least, len(texts[group[0]]))
        owner = np.searchsorted(starts, [r[0] for r in runs], side="right") - 1
        for (start, length, period), k in zip(runs, owner.tolist(), strict=True):
            found[group[k]].append((start - int(starts[k]), length, period))
    return found


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of n words stays: all but those after the first period of a run."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and the collapsed text of every row.

    Words are parted by ASCII blanks. The collapsed text holds the words that
    stay, with one blank between them. ``prepare`` gets a row's id and words and
    returns the words to work on.
    """
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = StructType([source.schema["doc_id"]]).add("n_words", LongType()).add("runs", ArrayType(RUN)).add("collapsed", StringType())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = part.column("doc_id")
                words = [(t or "").encode("utf-8").split() for t in part.column("text").to_pylist()]  # bytes: ASCII blanks only
                if prepare is not None:
                    words = [prepare(i, w) for i, w in zip(ids.to_pylist(), words, strict=True)]
                runs = runs_of_texts(words, least)
                listed = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
                left = [b" ".join(compress(w, kept_words(len(w), r).tolist()) if r else w).decode("utf-8") for w, r in zip(words, runs, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(w) for w in words], pa.int64()), pa.array(listed, kind), pa.array(left, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return source.mapInArrow(run, schema)


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of every tenth document by hash, with a periodic tail; rows without an id are left alone."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + period]
    return words[:a] + (part * -(-(n - a) // period))[: n - a]


def digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of the runs and the collapsed text of ``detect``."""
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("neg"), r["start"], r["period"]))), 1)
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))))
    best = F.when(F.size("runs") > 0, longest)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), (-F.col("_best.neg")).alias("length"), F.col("_best.period").alias("period"),
        F.floor(-F.col("_best.neg") * 1000 / F.col("_best.period")).cast("long").alias("exponent_milli"), sha(listed).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op13: all documents, each tenth with a periodic tail."""
    return digests(detect(table(spark, sf_dir, "documents"), prepare=repeated_tail))


#: The same in DuckDB's SQL. Runs come from equal stretches of six words, which every run holds at its period's distance.
ORACLE = f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
tail AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM g),
each AS (SELECT r, n, a, p, unnest(range(n)) AS i FROM tail),
word AS (SELECT each.r, each.n, i, w[1 + CASE WHEN i >= each.a THEN each.a + (i - each.a) % each.p ELSE i END] AS x FROM each JOIN tail USING (r)),
six AS (SELECT r, n, i, hash(x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o, lead(x, 5) OVER o) AS k, lead(x, 5) OVER o IS NOT NULL AS whole FROM word WINDOW o AS (PARTITION BY r ORDER BY i)),
pair AS (SELECT x.r, x.i, y.i - x.i AS p FROM six x JOIN six y ON x.r = y.r AND x.k = y.k AND y.i > x.i AND y.i - x.i <= x.n // 2 WHERE x.whole AND y.whole),
island AS (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS k FROM pair),
stretch AS (SELECT r, p, min(i) AS s, count(*) + 5 AS m FROM island GROUP BY r, p, k),
run AS (SELECT r, s, m + p AS l, min(p) AS q FROM stretch WHERE m >= greatest(p, {LEAST} - p) GROUP BY r, s, m + p),
best AS (SELECT r, count(*) AS n_runs, arg_min(struct_pack(s := s, l := l, q := q), (-l, s, q)) AS b, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS listed FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM run),
left_words AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS words FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.q AS period, 1000 * b.l // b.q AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM tail LEFT JOIN best USING (r) LEFT JOIN left_words USING (r)"""
