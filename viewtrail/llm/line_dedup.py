"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

1. Lines are split off, trimmed and named by two independent 64-bit hashes.
   Their character shingles are exploded, a few to a row, and one aggregate per
   distinct line takes the minima of the shingles' hashes under K multipliers:
   the signature. A line's shingles stand together in one task, so partial sums
   leave one row of it.
2. Banding: each band hashes a few of the minima; lines that share a band are
   candidates. The bands overlap in a cyclic design, so that a pair at the
   similarity bound is missed only if many minima differ at once.
3. Candidates get their text once, from their first place, and a sketch: the
   number of their shingles and a bitmap in which every shingle sets one bit.
   Two bitmaps differ in no more bits than the sets in shingles, so the sketch
   sets pairs aside without losing any. What is left is verified by the exact
   Jaccard similarity of the shingles, told apart by 64-bit hashes, as part of
   the join that makes the pairs.
4. In a band of a few lines all pairs are tested at once. Larger ones begin with
   stars: each line is paired with the band's least line; those that hold several
   components yet get one more star. Stars only save work: a crowd of near copies
   so costs a few pairs a line.
5. In the larger bands that hold several components yet, every pair of lines
   across components is tested: bands are cut into blocks and pairs of blocks are
   dealt out; the join returns the links alone. Two lines that share a band so end
   in one component or have been compared. The number of comparisons grows with
   the square of the lines of a band that stars leave in several components.
6. A distributed union-find over the verified links gives components; the first
   line of each (by document, then place) is kept.

Defined cases: null and empty texts have no lines; blank lines are kept and
never compared; a line shorter than a shingle is one shingle; lines of any
length are taken whole; repeated lines of one document count as copies, of
which the first by place is kept; rows that repeat a document id with the same
text are one document, rows of one id (or of none) with different texts are
several, in the order of their texts' hashes; a null id sorts last; an empty
table gives an empty result; other columns aren't read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import forget, release, stored, table
from ._components import components

#: Turns of one more star in bands that hold several components.
TURNS = 1
#: Lines of a band whose pairs are all tested at once.
FEW = 4
#: Lines of a band's block; parts of the mixed bands at most, one after another, so that one part's shuffle is on disk; lines of a part.
BLOCK, PARTS, PART_LINES = 512, 4, 100_000
#: Characters of a shingle, least Jaccard similarity.
SHINGLE, SIMILARITY = 8, 0.8
#: Minima of a signature, a band for each, and the steps of a band's three places.
MINIMA, STEPS = 13, (0, 1, 3)
#: A minimum's hash is the shingle's, shifted by one of these and then masked.
SHIFTS = (0, 16, 32)
#: Shingles that one row of the signature's aggregate holds, and of the sketch's.
STRIDE, SKETCH_STRIDE = 6, 4
#: 64-bit words of a sketch's bitmap.
WORDS = 32


def _masks(count: int) -> list[int]:
    """63-bit masks. Those of one shift begin with other bits each, so that their
    minima come from other shingles."""
    x, out = 0x9E3779B97F4A7C15, []
    for k in range(count):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        turn = k // len(SHIFTS)  # its lowest bits, turned about, are the mask's first
        out.append((turn & 1) << 62 | (turn >> 1 & 1) << 61 | (turn >> 2 & 1) << 60 | x >> 4)
    return out


def _text_hashes(text) -> list:
    """Two hashes that tell documents of one id, or of none, apart."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t1, t2, line_no, line, h1, h2) of the lines that aren't blank."""
    text = F.col(text_col).cast("string")
    named = docs.select(F.col(id_col).alias("doc_id"), *_text_hashes(text), text.alias("_vt_text"))  # first: after the split each line would hash its whole text
    split = named.select("doc_id", "t1", "t2", F.posexplode(F.split("_vt_text", "\n")).alias("line_no", "line"))
    split = split.withColumn("line", F.trim("line")).filter(F.col("line") != "")
    return split.select("doc_id", "t1", "t2", "line_no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _end(units: str, size: int) -> str:
    """SQL of the last shingle's place; units is UTF-16BE, two bytes a character from place 1."""
    return f"greatest(length({units}) - {2 * size - 1}, 1)"


def _shingle_at(units: str, place: str, size: int) -> str:
    """SQL of the hash of the shingle at a place."""
    return f"xxhash64(substring({units}, {place}, {2 * size}))"


def signatures(found: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(h1, h2, n, place, m0 .. mK) of each distinct line.

    n: how often it stands; place: the least hash of its places. A row holds
    STRIDE shingles; the last one stands for those beyond the end.
    """
    place = F.xxhash64("doc_id", "t1", "t2", "line_no")
    units = found.select("h1", "h2", place.alias("place"), F.encode("line", "UTF-16BE").alias("units"))
    end = _end("units", size)
    rows = units.select("h1", "h2", "place", "units", F.expr(end).alias("end"), F.expr(f"explode(sequence(1, {end}, {2 * STRIDE}))").alias("i"))
    rows = rows.select("h1", "h2", "place", "i", *(F.expr(_shingle_at("units", f"least(i + {2 * j}, end)", size)).alias(f"s{j}") for j in range(STRIDE)))
    shifted = [F.expr(f"shiftleft(s{j}, {by})" if by else f"s{j}").alias(f"s{j}_{by}") for j in range(STRIDE) for by in SHIFTS]
    rows = rows.select("h1", "h2", "place", "i", *shifted)
    minima = []
    for k, mask in enumerate(_masks(MINIMA)):
        each = ", ".join(f"s{j}_{SHIFTS[k % len(SHIFTS)]} ^ {mask}L" for j in range(STRIDE))
        minima.append(F.expr(f"hash(min(least({each})))").alias(f"m{k}"))
    return rows.groupBy("h1", "h2").agg(F.count_if(F.col("i") == 1).alias("n"), F.min("place").alias("place"), *minima)


def _set(line: str, size: int) -> str:
    """SQL of the hashes of a line's shingles, repeats included.

    The line is bound once, outside: a function of a shingle's place alone would
    copy the whole line out of its row for every place.
    """
    return f"transform(array(encode({line}, 'UTF-16BE')), u -> transform(sequence(1, {_end('u', size)}, 2), i -> {_shingle_at('u', 'i', size)}))[0]"


def _sketched(wanted: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """(lid, line, count, set_bits, bits, m0 .. mK) of the wanted lines (lid, h1, h2, n, place, m0 .. mK).

    A line has at most ``count`` different shingles, and at least ``set_bits``.
    """
    place = F.xxhash64("doc_id", "t1", "t2", "line_no")
    named, keys = found.select("h1", "h2", place.alias("place"), "line"), wanted.select("lid", "h1", "h2", "place")
    # A place is one row, but for rows of documents that repeat id and text.
    texts = named.join(keys.hint("shuffle_hash"), ["h1", "h2", "place"]).groupBy("lid").agg(F.first("line").alias("line"))
    texts = stored(texts, "line-texts")
    release(found.sparkSession)  # the shuffle held every line's text
    end, steps = _end("units", size), range(SKETCH_STRIDE)
    units = texts.select("lid", F.encode("line", "UTF-16BE").alias("units"))
    each = units.select("lid", "units", F.expr(end).alias("end"), F.expr(f"explode(sequence(1, {end}, {2 * SKETCH_STRIDE}))").alias("i"))
    each = each.select("lid", *(F.expr(_shingle_at("units", f"least(i + {2 * j}, end)", size)).alias(f"s{j}") for j in steps))
    each = each.select("lid", *(F.expr(f"s{j} & {WORDS - 1}").alias(f"word{j}") for j in steps), *(F.expr(f"shiftleft(1L, cast(shiftright(s{j}, 8) & 63 as int))").alias(f"bit{j}") for j in steps))
    words = [F.expr(f"bit_or({' | '.join(f'if(word{j} = {k}, bit{j}, 0L)' for j in steps)})").alias(f"w{k}") for k in range(WORDS)]
    set_bits = reduce(lambda x, y: x + y, (F.bit_count(f"w{k}") for k in range(WORDS)))
    bits = each.groupBy("lid").agg(*words).select("lid", set_bits.alias("set_bits"), F.array(*(f"w{k}" for k in range(WORDS))).alias("bits"))
    counted = texts.withColumn("count", F.expr(f"cast(({_end('encode(line, "UTF-16BE")', size)} + 1) div 2 as int)"))
    sketched = stored(counted.join(bits.hint("merge"), "lid").join(wanted.drop("h1", "h2", "n", "place").hint("merge"), "lid"), "line-sketches")
    forget(texts)
    release(found.sparkSession)
    return sketched


def _similar(a: str, b: str, size: int, similarity: float):
    """Whether two lines' sets, in columns with these prefixes, reach the bound.

    Numbers of shingles and differing bits bound the similarity from above; only
    pairs that they allow come to the exact sets.
    """
    fit = f"{a}set_bits * {similarity!r}D <= {b}count + 1e-9D AND {b}set_bits * {similarity!r}D <= {a}count + 1e-9D"
    differing = " + ".join(f"bit_count({a}bits[{k}] ^ {b}bits[{k}])" for k in range(WORDS))
    few = f"({differing}) <= ({a}count + {b}count) * {(1 - similarity) / (1 + similarity)!r}D + 1e-9D"
    sets = f"array(named_struct('x', {_set(f'{a}line', size)}, 'y', {_set(f'{b}line', size)}))"
    exact = f"exists({sets}, p -> size(array_intersect(p.x, p.y)) >= {similarity!r}D * size(array_union(p.x, p.y)) - 1e-9D)"
    return F.expr(f"{fit} AND {few} AND {exact}")


def _side(sketched: DataFrame, prefix: str, *columns: str) -> list:
    return [F.col(c).alias(f"{prefix}{c}") for c in ("line", "count", "set_bits", "bits", *columns)]


def _verified(pairs: DataFrame, sketched: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of line numbers whose exact similarity reaches the bound."""
    left = sketched.select(F.col("lid").alias("a"), *_side(sketched, "_a"))
    right = sketched.select(F.col("lid").alias("_b"), *_side(sketched, "_b"))
    # Sketches grow with the input: never broadcast, however small they are.
    met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), (F.col("b") == F.col("_b")) & _similar("_a", "_b", size, similarity))
    return stored(met.select("a", "b"), "line-links")


def _band(k: int, prefix: str = ""):
    """The key of a line's band k."""
    return F.xxhash64(*(F.col(f"{prefix}m{(k + s) % MINIMA}") for s in STEPS), F.lit(k))


def _first_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): each line and the least of its band, and all pairs of bands of FEW lines at most."""
    stars = shared.filter(F.col("low") < F.col("lid")).select(F.col("low").alias("a"), F.col("lid").alias("b"))
    few = shared.filter((F.col("size") > 2) & (F.col("size") <= FEW) & (F.col("low") < F.col("lid")))
    others = few.select("band", F.col("lid").alias("a")).join(few.select("band", F.col("lid").alias("b")), "band").filter(F.col("a") < F.col("b"))
    return stars.unionByName(others.select("a", "b")).distinct()


def _placed(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, lid, root) of the lines of bands."""
    return shared.select("band", "lid").join(roots.select(F.col("node").alias("lid"), "root"), "lid", "left").withColumn("root", F.coalesce("root", "lid"))


def _stars(shared: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """(a, b): each line of a band of several components, and the band's drawn line."""
    placed = _placed(shared, roots)
    drawn = F.min(F.struct(F.xxhash64("lid", "band", F.lit(turn)).alias("by"), F.col("lid").alias("c"), F.col("root").alias("c_root"))).alias("centre")
    centres = placed.groupBy("band").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), drawn).filter(F.col("_lo") < F.col("_hi")).select("band", "centre.c", "centre.c_root")
    across = placed.join(centres, "band").filter(F.col("root") != F.col("c_root"))
    return across.select(F.least("lid", "c").alias("a"), F.greatest("lid", "c").alias("b")).distinct()


def _across(shared: DataFrame, roots: DataFrame, sketched: DataFrame, size: int, similarity: float) -> list[DataFrame]:
    """The links (a, b) between lines of a band that are in two components."""
    placed = stored(_placed(shared, roots), "line-placed")
    mixed = placed.groupBy("band").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count("*").alias("_n")).filter(F.col("_lo") < F.col("_hi"))
    blocks = stored(mixed.select("band", "_n", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks")), "line-blocks")
    links, count = [], blocks.agg(F.sum("_n")).first()[0] or 0
    parts = min(PARTS, -(-count // PART_LINES))
    if parts:
        held = placed.join(blocks.drop("_n"), "band").withColumn("_own", F.pmod(F.xxhash64("lid"), F.col("_blocks")).cast("int"))
        held = stored(held.join(sketched.hint("merge"), "lid"), "line-mixed")  # once for all parts
        release(shared.sparkSession)
        for part in range(parts):
            links.append(_met(held.filter(F.pmod("band", F.lit(parts)) == part), size, similarity))
            release(shared.sparkSession)
        forget(held)
    for done in (placed, blocks):
        forget(done)
    return links


def _met(held: DataFrame, size: int, similarity: float) -> DataFrame:
    """The same of some bands (band, lid, root, _blocks, _own and the lines' sketches)."""
    # Every pair of blocks is a cell; a line stands in a row and a column of them.
    more = ("lid", "root", *(f"m{k}" for k in range(MINIMA)))
    left = held.select("band", F.col("_own").alias("_i"), F.explode(F.expr("sequence(_own, _blocks - 1)")).alias("_j"), *_side(held, "_a", *more))
    right = held.select(F.col("band").alias("_band"), F.explode(F.expr("sequence(0, _own)")).alias("_bi"), F.col("_own").alias("_bj"), *_side(held, "_b", *more))
    # A pair is met in the first of the bands that it shares only.
    first = F.lit(None).cast("long")
    for k in reversed(range(MINIMA)):
        same = reduce(lambda x, y: x & y, [F.col(f"_am{(k + s) % MINIMA}") == F.col(f"_bm{(k + s) % MINIMA}") for s in STEPS])
        first = F.when(same, _band(k, "_a")).otherwise(first)
    cell = (F.col("band") == F.col("_band")) & (F.col("_i") == F.col("_bi")) & (F.col("_j") == F.col("_bj"))
    once = ((F.col("_i") < F.col("_j")) | (F.col("_alid") < F.col("_blid"))) & (F.col("_aroot") != F.col("_broot"))
    met = left.join(right.hint("merge"), cell & once & (F.col("band") == first) & _similar("_a", "_b", size, similarity))
    return stored(met.select(F.least("_alid", "_blid").alias("a"), F.greatest("_alid", "_blid").alias("b")), "line-links")


def line_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(h1, h2, root) of the lines that stand more than once or have a link."""
    found = lines(docs, id_col, text_col)
    signed = stored(signatures(found, size).withColumn("lid", F.monotonically_increasing_id()), "line-signatures")
    bands = signed.select("lid", F.explode(F.array(*(_band(k) for k in range(MINIMA)))).alias("band"))
    least = stored(bands.groupBy("band").agg(F.min("lid").alias("low"), F.count("*").alias("size")).filter(F.col("size") > 1), "line-least")
    release(docs.sparkSession)
    shared = stored(bands.join(least.hint("shuffle_hash"), "band"), "line-bands")  # only bands of several lines
    forget(least)
    release(docs.sparkSession)
    # Of the signatures only those of lines in bands, and the names of repeated lines, stay on disk.
    wanted = stored(signed.join(shared.select("lid").distinct().hint("shuffle_hash"), "lid"), "line-wanted")
    repeated = stored(signed.filter(F.col("n") > 1).select("lid", "h1", "h2"), "line-repeated")
    forget(signed)
    release(docs.sparkSession)
    sketched = _sketched(wanted, found, size)
    links = [_verified(_first_pairs(shared), sketched, size, similarity)]
    release(docs.sparkSession)  # the shuffle held sketches and texts twice
    roots = _roots(links[0])
    crowds = shared.filter(F.col("size") > FEW)
    for turn in range(TURNS + 1):
        more = [_verified(_stars(crowds, roots, turn), sketched, size, similarity)] if turn < TURNS else _across(crowds, roots, sketched, size, similarity)
        links += more
        old, roots = roots, _merged(roots, more)
        if old is not roots:
            forget(old)
        release(docs.sparkSession)
    linked = wanted.select("lid", "h1", "h2").join(roots.select(F.col("node").alias("lid"), "root"), "lid")
    alone = repeated.join(roots.select(F.col("node").alias("lid")), "lid", "left_anti").withColumn("root", F.col("lid"))
    classes = stored(linked.unionByName(alone).select("h1", "h2", "root"), "line-classes")
    for done in (wanted, repeated, shared, sketched, roots, *links):
        forget(done)
    return classes


def _roots(links: DataFrame) -> DataFrame:
    return stored(components(links, "a", "b"), "line-roots")


def _merged(roots: DataFrame, links: list[DataFrame]) -> DataFrame:
    """roots after some more links: only components that these join are looked at."""
    links = [x for x in links if not x.isEmpty()]
    if not links:
        return roots
    at = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    joined = reduce(DataFrame.unionByName, links).join(at("a"), "a", "left").join(at("b"), "b", "left")
    moves = _roots(joined.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
    known = roots.unionByName(moves.select("node", F.col("node").alias("root"))).distinct()  # a node that moves is its own root yet
    moved = known.join(moves.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    out = stored(moved.select("node", F.coalesce("to", "root").alias("root")), "line-roots")
    forget(moves)
    return out


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, line_no, kept, keeper_doc, keeper_line of every line that isn't blank."""
    return _decided(docs, id_col, text_col, size, similarity).drop("t1", "t2")


def _decided(docs: DataFrame, id_col: str, text_col: str, size: int, similarity: float) -> DataFrame:
    """The same beside the hashes t1, t2 of the document's text.

    Both joins have stored tables on their right, so that adaptive execution
    can split the places of a common line or of a large component.
    """
    classes = line_components(docs, id_col, text_col, size, similarity)
    where = stored(lines(docs, id_col, text_col).drop("line").join(classes, ["h1", "h2"], "left").drop("h1", "h2"), "line-places")
    forget(classes)
    release(docs.sparkSession)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2", "line_no")
    copied = where.filter(F.col("root").isNotNull())
    keeper = stored(copied.groupBy("root").agg(F.min(place).alias("keeper")), "line-keepers")
    out = copied.join(keeper, "root").unionByName(where.filter(F.col("root").isNull()).withColumn("keeper", place))
    return out.select("doc_id", "t1", "t2", "line_no", (F.col("keeper") == place).alias("kept"), F.col("keeper.doc_id").alias("keeper_doc"), F.col("keeper.line_no").alias("keeper_line"))


def deduplicated(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, texts without their dropped lines, n_chars as they are now."""
    dropped = _decided(docs, "doc_id", "text", size, similarity).filter(~F.col("kept")).groupBy("doc_id", "t1", "t2").agg(F.array_sort(F.collect_set("line_no")).alias("_vt_dropped"))
    # Whether each line up to the last dropped one stays: as many lines as lie between two dropped ones, and no.
    gaps = F.transform("_vt_dropped", lambda x, j: F.concat(F.array_repeat(F.lit(True), (x - F.coalesce(F.get("_vt_dropped", j - 1), F.lit(-1)) - 1).cast("int")), F.array(F.lit(False))))
    dropped = stored(dropped.select(F.col("doc_id").alias("_vt_id"), F.col("t1").alias("_vt_t1"), F.col("t2").alias("_vt_t2"), F.flatten(gaps).alias("_vt_stays")), "line-dropped")
    t1, t2 = _text_hashes(docs["text"].cast("string"))
    joined = docs.join(dropped, docs["doc_id"].eqNullSafe(F.col("_vt_id")) & (t1 == F.col("_vt_t1")) & (t2 == F.col("_vt_t2")), "left")
    kept = F.expr("array_join(filter(split(text, '\\n'), (l, i) -> coalesce(get(_vt_stays, i), true)), '\\n')")
    text = F.when(F.col("_vt_stays").isNull(), F.col("text")).otherwise(kept)
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_vt_stays").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every line of every document."""
    return decisions(table(spark, sf_dir, "documents"))
