"""Benchmark decontamination by the q-gram lemma and banded alignment.

A passage that is within k edits of a piece of m characters shares at least
m - q + 1 - q * k q-grams with it, on diagonals that differ by at most k. So:

1. Benchmark items are cut into overlapping pieces; a short item is one piece.
2. A window of the text that has too few q-grams of any piece is dropped; one
   cumulative sum over the batch's bytes tells.
3. In what remains, hits are counted per piece in diagonal bands that overlap
   by half, so that any k + 1 neighbouring diagonals lie in one band. Bands
   that reach the piece's bound are kept.
4. Each kept band is verified by an alignment held to the band's diagonals.

Texts are compared after lower-casing, with runs of ASCII punctuation and white
space as one blank, as UTF-8 bytes. Pieces of similar length share an index. Of
the benchmark, one block of bounded bytes is searched at a time, so that its
size bounds no executor.

Defined cases: null and empty texts and items have no match; an item with fewer
bytes than a q-gram, once normalised, matches nothing; items with equal texts
are each reported; repeated rows and null ids are reported row by row; an empty
table or benchmark gives an empty result; other columns pass through or aren't
read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ._common import free_name, table

#: Bytes of a q-gram, of a piece and from piece to piece; edits per byte.
Q, PIECE, STEP, EDITS = 8, 96, 48, 0.08
#: Bytes of one block of benchmark texts; bytes of text that are searched at once.
BLOCK_BYTES, SPAN = 4 << 20, 8 << 20
_BLANKS = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))


def normalised(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8").translate(_BLANKS).split())


def budget(size: int) -> int:
    """Edits allowed in a piece; never so many that the lemma says nothing."""
    return max(0, min(int(size * EDITS), (size - Q) // Q))


def bound(size: int) -> int:
    return size - Q + 1 - Q * budget(size)


def pieces(items: list[tuple[object, str | None]]) -> list[tuple[int, bytes]]:
    """(place of the item, piece)."""
    out = []
    for n, (_, text) in enumerate(items):
        data = normalised(text)
        if len(data) < Q:
            continue
        starts = range(0, max(1, len(data) - PIECE + 1), STEP)
        out += [(n, data[s : s + PIECE]) for s in starts]
        if len(data) > PIECE and (len(data) - PIECE) % STEP:
            out.append((n, data[-PIECE:]))
    return out


def grams(data: np.ndarray) -> np.ndarray:
    """The q-gram at each byte as a number; data ends with 8 spare bytes."""
    return np.ndarray((len(data) - 8,), "<u8", data.tobytes(), strides=(1,)) & np.uint64((1 << 8 * Q) - 1)


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)


@dataclass
class Index:
    """q-grams of pieces of similar length."""

    owner: list[int]
    data: list[bytes]

    def __post_init__(self):
        found = [(g, p, at) for p, d in enumerate(self.data) for at, g in enumerate(grams(np.frombuffer(d + b"\0" * 8, np.uint8))[: len(d) - Q + 1].tolist())]
        found.sort()
        self.gram = np.array([x[0] for x in found], np.uint64)
        self.piece, self.at = (np.array([x[k] for x in found], np.int64) for k in (1, 2))
        self.unique, self.first = np.unique(self.gram, return_index=True)
        self.last = np.append(self.first[1:], len(found))
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[_slot(self.unique)] = True
        sizes = [len(d) for d in self.data]
        self.need = np.array([bound(s) for s in sizes])
        self.width = np.array([budget(s) + 1 for s in sizes])
        self.least, self.reach = int(self.need.min()), max(s + budget(s) for s in sizes) - Q + 1

    def regions(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, gram numbers) of the hits in windows with enough of them."""
        at = np.flatnonzero(self.maybe[_slot(g)])
        number = np.minimum(np.searchsorted(self.unique, g[at]), len(self.unique) - 1)
        real = self.unique[number] == g[at]
        at, number = at[real], number[real]
        if len(at) < self.least:
            return at[:0], number[:0]
        # A hit counts if the window that begins or ends some hits away holds enough.
        ahead = np.searchsorted(at, at + self.reach, side="left") - np.arange(len(at)) >= self.least
        if not ahead.any():
            return at[:0], number[:0]
        begin = at[ahead]
        near = np.searchsorted(begin, at, side="right") - 1
        keep = (near >= 0) & (at - begin[np.maximum(near, 0)] < self.reach)
        return at[keep], number[keep]

    def bands(self, at: np.ndarray, number: np.ndarray) -> list[tuple[int, int, int]]:
        """(piece, least and greatest diagonal) of the bands that reach the bound."""
        if not len(at):
            return []
        count = self.last[number] - self.first[number]
        base = np.repeat(self.first[number] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        piece, place, pos = self.piece[base], self.at[base], np.repeat(at, count)
        diagonal, width = pos - place, self.width[piece]
        out = []
        for shift in (0, 1):  # bands of two widths, one width apart
            band = (diagonal // width + shift) // 2
            key = piece * (1 << 40) + (band + (1 << 20))
            held = np.sort(key)
            new = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
            enough = np.diff(np.append(new, len(held))) >= self.need[held[new] >> 40]
            full = held[new[enough]]  # reached by hits; now each q-gram of a piece counts once
            if not len(full):
                continue
            slot = np.minimum(np.searchsorted(full, key), len(full) - 1)
            inside = np.flatnonzero(full[slot] == key)
            order = inside[np.lexsort((place[inside], slot[inside]))]
            group, s, d = slot[order], place[order], diagonal[order]
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            fresh = np.append(True, (s[1:] != s[:-1]) | (group[1:] != group[:-1]))
            p = full >> 40
            kept = np.bincount(group, weights=fresh) >= self.need[p]
            low, high = np.minimum.reduceat(d, first), np.maximum.reduceat(d, first)
            out += [(int(x), int(y), int(z)) for x, y, z in zip(p[kept], low[kept], high[kept], strict=True)]
        return list(dict.fromkeys(out))


def banded(piece: bytes, text: bytes, low: int, high: int, edits: int) -> int | None:
    """The least edits that turn the piece into some part of the text.

    Only cells whose diagonal lies within the edits of low to high are filled.
    None: more than so many edits.
    """
    for d in range(max(low, 0), high + 1):
        if text[d : d + len(piece)] == piece:
            return 0
    left, right, beyond = low - edits, high + edits, edits + 1
    row = {j: 0 for j in range(max(0, left), min(len(text), right) + 1)}  # a match may begin anywhere
    for i in range(1, len(piece) + 1):
        new: dict[int, int] = {}
        for j in range(max(0, i + left), min(len(text), i + right) + 1):
            best = row.get(j, beyond) + 1
            if j:
                best = min(best, new.get(j - 1, beyond) + 1, row.get(j - 1, beyond) + (piece[i - 1] != text[j - 1]))
            if best <= edits:
                new[j] = best
        if not new:
            return None
        row = new
    return min(row.values())


class Searcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.items, classes = items, {}
        for owner, data in pieces(items):
            size = Q if len(data) < 16 else 16 if len(data) < 32 else 32 if len(data) < 64 else 64
            classes.setdefault(size, ([], []))
            classes[size][0].append(owner)
            classes[size][1].append(data)
        self.indexes = [Index(*x) for _, x in sorted(classes.items())]

    def texts(self, texts: list[str | None]) -> list[dict[int, int]]:
        """For each text: item's place to the edits of its best piece."""
        out: list[dict[int, int]] = [{} for _ in texts]
        chunk, size = [], 0
        for n, t in enumerate(texts):
            data = normalised(t)
            if len(data) >= Q:
                chunk.append((n, data))
                size += len(data)
            if size >= SPAN:
                self._search(chunk, out)
                chunk, size = [], 0
        self._search(chunk, out)
        return out

    def _search(self, chunk: list[tuple[int, bytes]], out: list[dict[int, int]]) -> None:
        if not chunk:
            return
        gap = b"\0" * 8  # no q-gram of a piece has a zero byte
        joined = gap.join(d for _, d in chunk) + gap
        begin = np.cumsum([0, *(len(d) + 8 for _, d in chunk[:-1])])
        g = grams(np.frombuffer(joined, np.uint8))
        for index in self.indexes:
            for piece, low, high in index.bands(*index.regions(g)):
                # The band's matches all lie in one text, or in several apart.
                first, last = np.searchsorted(begin, [max(low, 0), high + len(index.data[piece])], side="right") - 1
                for k in range(max(0, int(first)), int(last) + 1):
                    n, text = chunk[k]
                    item = index.owner[piece]
                    if out[n].get(item) == 0:
                        continue
                    found = banded(index.data[piece], text, low - int(begin[k]), high - int(begin[k]), budget(len(index.data[piece])))
                    if found is not None:
                        out[n][item] = min(found, out[n].get(item, found))


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, leaked_col: str = "leaked") -> DataFrame:
    """The rows of docs with an array of (item_id, edits), by item, added; an own column of its name gives way."""
    docs = docs.drop(leaked_col)
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("item_text")).filter(F.col("item_text").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    entry = StructType([items.schema["item_id"]]).add("edits", "integer")
    schema = StructType([*docs.schema.fields]).add(leaked_col, ArrayType(entry))
    at, out = docs.columns.index(text_col), docs.withColumn(leaked_col, F.array().cast(ArrayType(entry)))

    def search(block):
        def run(batches):
            finder = Searcher(block)
            for batch in batches:
                found = finder.texts(batch.column(at).to_pylist())
                old = batch.column(batch.num_columns - 1)
                new = [[*(before or []), *({"item_id": block[k][0], "edits": e} for k, e in sorted(f.items()))] for before, f in zip(old.to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(new, batch.schema.field(batch.num_columns - 1).type)], schema=batch.schema)

        return run

    for b in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == b) if blocks > 1 else items
        block = sorted(((r[0], r[1]) for r in mine.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))  # bounded by block_bytes
        out = out.mapInArrow(search(block), schema)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs without a leaked item."""
    own = free_name(docs, "leaked")
    return leaks(docs, benchmark, leaked_col=own, **options).filter(F.size(own) == 0).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: a row for each document and benchmark item found in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaked").alias("leak")).select("doc_id", "leak.item_id", "leak.edits")
