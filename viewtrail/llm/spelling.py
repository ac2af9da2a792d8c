"""Spelling variants: words one edit apart, found by their rarest bigrams.

Words are counted over all texts. Bigrams are ordered by the number of words
that hold them, the rarest first, then by their characters and places. One edit
destroys at most two bigrams of a word, and the others keep their order, so two
words one edit apart share a bigram among the three rarest of each; and the edit
stands before it or behind it, so its place from the start or from the end is
the same in both. Words are joined by such a bigram with the side that the edit
leaves alone, and verified by their edit distance.

A bigram at one place may belong to a third of all words, so what is on the
other side is a part of the key, too: with m characters there in the shorter
word, half of them stand unchanged at the outer or the inner end. Each word
therefore has keys for words of its own length and for words shorter by one; a
key holds words that differ in half of the rest alone, and links that several
keys give count once.

A word's form is its most frequent neighbour, if that is at least twice as
frequent; roots follow forms by pointer doubling. Counts double along forms, so
that takes six rounds at most.

Defined cases: a null text has no words; a null id has no slips (see
``slipped``); a word of no near words has no form and is its own root;
repeated rows count each; no words give an empty result; other columns aren't
read. Texts of any length are read whole, long ones word by word.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc32_sql, forget, stored, table

#: Words by default: maximal runs of these characters, A-Z in lower case.
RUNS = "[A-Za-zÀ-ÿ]+"
#: Code points of a word, occurrences, and how many times its form is as frequent, at least.
SHORTEST, RAREST, TIMES = 5, 3, 2
#: Rarest bigrams of a word that are joined: one more than an edit destroys.
PREFIX = 3
#: Words counted in a task before they are passed on; characters beyond which a text isn't split at once.
HELD, LONG_TEXT = 200_000, 1_000_000


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: str = RUNS, change: Callable[[object], Callable[[str], str] | None] | None = None) -> DataFrame:
    """(word, n) over all texts; ``change(id)`` gives a function of a text's words, or None."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).filter(F.col("text").isNotNull())

    def count(batches):
        pattern = re.compile(runs)
        held: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                text = value.as_py().encode("utf-8").lower().decode("utf-8")  # bytes: A-Z only
                own = Counter(pattern.findall(text) if len(text) <= LONG_TEXT else (m[0] for m in pattern.finditer(text)))
                new = change(doc_id.as_py()) if change else None
                if new is None:
                    held.update(own)
                else:
                    for word, n in own.items():
                        held[new(word)] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return source.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bigram_counts(words: DataFrame) -> dict[str, int]:
    """The number of places of every bigram; as many entries as pairs of letters."""

    def count(batches):
        held: Counter[str] = Counter()
        for batch in batches:
            for w in batch.column("word").to_pylist():
                held.update(map("".join, zip(w, w[1:], strict=False)))
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["gram", "n"])

    found = words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in found.collect()}


def word_keys(word: str, counts: dict[str, int]) -> tuple[set[str], set[str]]:
    """Keys that the word shares with words of its length or longer by one, and with shorter ones.

    Each is of a rare bigram with what stands on one side of it, the length of
    the rest in the shorter word, and half of that rest. Characters are joined by
    one that no word holds.
    """
    rare = heapq.nsmallest(PREFIX, ((counts[word[i : i + 2]], word[i : i + 2], i) for i in range(len(word) - 1)))
    own, longer = set(), set()
    for _, _, i in rare:
        for side, same, rest in ((">", word[: i + 2], word[i + 2 :]), ("<", word[i:], word[:i])):
            m = len(rest)
            h = m // 2
            own.update((f"{side}{same}|{m}a{rest[:h]}", f"{side}{same}|{m}b{rest[h:]}"))
            if m:
                h = (m - 1) // 2
                longer.update((f"{side}{same}|{m - 1}a{rest[:h]}", f"{side}{same}|{m - 1}b{rest[h + 1 :]}"))
    return own, longer


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every two words (word, n) one inserted, deleted or replaced character apart, once."""
    counts = bigram_counts(words)

    def keys(batches):
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            texts, numbers = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            for at in range(0, len(texts), 10_000):
                out = [], [], [], []
                for w, n in zip(texts[at : at + 10_000], numbers[at : at + 10_000], strict=True):
                    for plain, found in zip((True, False), word_keys(w, counts), strict=True):
                        for key in found:
                            for column, value in zip(out, ((digest(key) >> 1), plain, w, n), strict=True):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.bool_(), pa.string(), pa.int64()), strict=True)], names=["key", "plain", "word", "n"])

    each = stored(words.select("word", "n").mapInArrow(keys, "key long, plain boolean, word string, n long"), "spelling-keys")
    left = each.filter("plain").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = each.select("key", "plain", F.col("word").alias("b"), F.col("n").alias("b_n"))
    # Equal lengths meet twice, in both orders; a longer word meets a shorter one once.
    once = ~F.col("plain") | (F.col("a") < F.col("b"))
    pairs = left.join(right, "key").filter(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n").distinct()
    pairs = stored(pairs, "spelling-links")
    forget(each)
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last form that a word leads to. Forms have no cycles."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("_went")), "spelling-roots")
        if longer.filter("_went").isEmpty():
            return now
        last, now = now, longer.drop("_went")
        forget(last)


def variants(counted: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words (word, n) that are long and frequent enough."""
    words = stored(counted.filter((F.col("n") >= rarest) & (F.length("word") >= shortest)), "spelling-words")
    links = near_words(words)
    both = links.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionAll(links.select("b", "b_n", "a", "a_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("neg"), F.col("near").alias("form")))
    linked = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    form_n = -F.col("best.neg")
    linked = stored(linked.select("word", "n_near", F.when(form_n >= times * F.col("n"), F.col("best.form")).alias("form"), F.when(form_n >= times * F.col("n"), form_n).alias("form_n")), "spelling-forms")
    found = words.join(linked, "word", "left").join(roots(linked.filter("form IS NOT NULL")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def slipped(doc_id: int | None) -> Callable[[str], str] | None:
    """Drops a character of every 97th word by the hash of document and word."""
    if doc_id is None:
        return None
    begin = zlib.crc32(f"{doc_id}:".encode())

    def change(word: str) -> str:
        h = zlib.crc32(word.encode("utf-8"), begin)
        if h % 97:
            return word
        k = h % len(word)
        return word[:k] + word[k + 1 :]

    return change


def query(spark, sf_dir: str) -> DataFrame:
    """op11: words of all documents, with the slips of ``slipped``."""
    return variants(word_counts(table(spark, sf_dir, "documents"), change=slipped))


#: The same in DuckDB's SQL. Near words share a deletion of one place, or one is a deletion of the other.
ORACLE = f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+') AS runs FROM documents),
own AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(runs) AS run FROM t) GROUP BY doc_id, run),
hashed AS (SELECT run, n, {crc32_sql("concat(doc_id, ':', run)")} AS h, doc_id FROM own),
slip AS (SELECT CASE WHEN doc_id IS NOT NULL AND h % 97 = 0 THEN concat(substr(run, 1, CAST(h % length(run) AS BIGINT)), substr(run, CAST(h % length(run) AS BIGINT) + 2)) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slip WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {RAREST}),
cut AS (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM cut x JOIN words y ON x.rest = y.word
  UNION SELECT y.word, y.n, x.word, x.n FROM cut x JOIN words y ON x.rest = y.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n, any_value(n) AS n FROM near GROUP BY word),
forms AS (SELECT word, n_near, CASE WHEN form_n >= {TIMES} * n THEN form END AS form, CASE WHEN form_n >= {TIMES} * n THEN form_n END AS form_n FROM best),
walk AS (SELECT word, form AS root, 1 AS k FROM forms WHERE form IS NOT NULL UNION ALL SELECT walk.word, forms.form, k + 1 FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, k) AS root FROM walk GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, coalesce(n_near, 0) AS n_near, form_n FROM words LEFT JOIN forms USING (word) LEFT JOIN ends USING (word)"""
