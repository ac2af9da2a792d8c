"""Byte-level BPE encoding and decoding without replaying merges.

A piece's bytes are mapped to Latin-1 characters, so that a pyahocorasick
automaton over the vocabulary says how far the tokens at an offset reach.
Encoding goes left to right: take the longest token that is compatible
with the one before it; where none is, step back and shorten. Two adjacent
tokens are compatible if merging their joined bytes gives just these two, and
a sequence whose neighbours are all compatible is the one that merging gives.
Compatibility is memoised and offsets that led nowhere are marked, so that no
offset is entered twice: the time is linear in the piece.

Defined cases: a null text is an empty one; an empty text has no tokens;
characters that no match of the pattern covers are skipped, as a scan by the
pattern does; repeated rows and null ids give a row each; other columns are
not read. Pieces are memoised up to a bound, so that memory doesn't grow with
the corpus; of a full memo the older half goes, so that common pieces stay.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

#: Pieces of at most this many characters are memoised, and so many of them.
MEMO_CHARS, MEMO_PIECES, MEMO_PAIRS = 40, 300_000, 150_000
#: Characters of a text up to which its pieces are listed at once.
LISTED_CHARS = 1 << 20


class ByteBpe:
    """Encoder and decoder over a rank file and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pair: dict[tuple[int, int], bool] = {}
        # Others never come out of merging.
        self.known = {token.decode("latin-1"): rank for token, rank in ranks.items() if self.merged(token) == [token]}
        self.most = max(map(len, self.known), default=0)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for token in self.known:
            self.automaton.add_word(token)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)}
        return cls(ranks, pattern)

    def merged(self, data: bytes) -> list[bytes]:
        """The definition: merge the pair of lowest rank, the leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        known = self.pair.get((a, b))
        if known is None:
            left, right = self.token[a], self.token[b]
            known = self.merged(left + right) == [left, right]
            if len(self.pair) >= MEMO_PAIRS:
                self.pair.clear()
            self.pair[a, b] = known
        return known

    def piece(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        text, size, most = data.decode("latin-1"), len(data), self.most
        reach, known, pair = self.automaton.longest_prefix, self.known, self.pair
        dead = bytearray(size + 1)
        ids: list[int] = []
        at, length, last = 0, reach(text[:most]), None
        while at < size:
            while length:
                rank = known.get(text[at : at + length])
                if rank is not None and not dead[at + length]:
                    fits = True if last is None else pair.get((last, rank))
                    if fits or fits is None and self.compatible(last, rank):
                        break
                length -= 1
            if length:
                ids.append(rank)
                last = rank
                at += length
                length = reach(text[at : at + most])
            elif not ids:
                raise ValueError("the vocabulary lacks single bytes")
            else:
                dead[at] = 1
                length = len(self.token[ids.pop()])
                at -= length
                length -= 1
                last = ids[-1] if ids else None
        return ids

    def words(self, text: str) -> Iterator[list[str]]:
        """The pattern's matches, in lists; those of a long text come in parts."""
        if len(text) <= LISTED_CHARS and not self.pattern.groups:
            yield self.pattern.findall(text)
            return
        matches = self.pattern.finditer(text)
        while part := [m[0] for m in islice(matches, LISTED_CHARS // 4)]:
            yield part

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for words in self.words(text):
            ids = list(map(self.memo.get, words))
            if None in ids:
                ids = [self._ids(w) if i is None else i for w, i in zip(words, ids, strict=True)]
            out += ids
        return b"".join(out)

    def _ids(self, word: str) -> bytes:
        ids = self.memo.get(word) or self.older.get(word)
        if ids is None:
            ids = array("I", self.piece(word.encode("utf-8"))).tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_PIECES // 2:
                self.memo, self.older = {}, self.memo
            self.memo[word] = ids
        return ids

    def decode(self, ids: bytes) -> bytes:
        numbers = array("I")
        numbers.frombytes(ids)
        return b"".join(map(self.token.__getitem__, numbers))


@lru_cache(maxsize=4)
def _codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe.from_file(path, pattern)


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``token_ids`` (binary, uint32 LE) and ``decoded`` (binary) to id and text.

    ``keep`` names further columns to pass through. The vocabulary is a file of
    the installed tokenizer package that every worker opens itself.
    """
    from pyspark.sql.types import BinaryType, StructType

    columns = [id_col, *keep]
    source = docs.select(*columns, docs[text_col].alias("_vt_text"))
    schema = StructType([*docs.select(*columns).schema.fields]).add("token_ids", BinaryType()).add("decoded", BinaryType())

    def run(batches):
        codec = _codec(vocabulary, pattern)
        for batch in batches:
            ids = [codec.encode(t or "") for t in batch.column("_vt_text").to_pylist()]
            rest = [batch.column(c) for c in columns]
            decoded = [codec.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=[*columns, "token_ids", "decoded"])

    return source.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 (of real decoded bytes)."""
    from pyspark.sql.types import LongType, StringType, StructType

    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_vt_text"))
    schema = StructType([source.schema["doc_id"]]).add("n_tokens", LongType()).add("ids_sha256", StringType()).add("decoded_sha256", StringType())

    def run(batches):
        codec, sha = _codec(vocabulary, pattern), lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for text in batch.column("_vt_text"):
                ids = codec.encode(text.as_py() or "")
                counts.append(len(ids) // 4)
                ids_sha.append(sha(ids))
                decoded_sha.append(sha(codec.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the multilingual ranks over all documents."""
    import public_tokenizers

    from ._common import table

    docs = table(spark, sf_dir, "documents")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
