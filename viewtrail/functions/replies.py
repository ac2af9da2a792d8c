"""Parsers of model replies: numbered lines, each number once, nothing guessed.

One scanner serves all kinds of reply. A kind says how many fields a line has
and what makes them valid; a reply is whole or refused. ``parse_replies`` runs
a kind over a table, a row an answer, beside a column with the refusal.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import EMPTY_SUBS, MODES, SUB_CAP, UNCLEAR

_NUMBER = re.compile(r"(\d+)[.):]?")


class Refused(ValueError):
    """A reply that can't be mapped line by line."""


def slug(text: str, cap: int = SUB_CAP) -> str:
    return re.sub("[^a-z0-9]+", "-", text.strip().lower()).strip("-")[:cap].rstrip("-")


@dataclass(frozen=True)
class Areas:
    names: tuple[str, ...]
    aliases: tuple[tuple[str, str], ...] = ()

    def topic(self, text: str) -> str | None:
        """The topic in the configured spelling; None for an unknown area."""
        head, _, tail = text.partition("/")
        area = {n.lower(): n for n in self.names}.get(head.strip().lower())
        if area is None:
            return None
        sub = slug(tail)
        sub = slug(dict(self.aliases).get(sub, sub))
        bare = not sub or sub in EMPTY_SUBS or sub == area.lower() or area == UNCLEAR
        return area if bare else f"{area}/{sub}"


def mode(text: str) -> str | None:
    return text if text in MODES else "" if text in ("", UNCLEAR) else None


def confidence(text: str) -> float | None:
    try:
        value = float(text)
    except ValueError:
        return None
    return value if 0 <= value <= 1 else None


def _glued(topic: str, areas: Areas) -> tuple[str, str] | None:
    """area/sub-mode as (area/sub, mode), where the last dash parts a subject from a mode."""
    base, dash, last = topic.rpartition("-")
    area, slash, sub = base.partition("/")
    return (base, last) if dash and slash and sub and last in MODES and areas.topic(base) else None


def repaired(fields: list[str], areas: Areas) -> list[str]:
    """A verdict's number, topic, mode and confidence, where only one reading fits."""
    number, rest = fields[:1], fields[1:]
    if len(rest) < 2 or confidence(rest[-1]) is None:
        return fields
    topic, last = rest[0], rest[-1]
    known = areas.topic(topic) is not None
    if len(rest) == 4 and known and mode(rest[2]) is not None:
        return [*number, f"{topic}/{rest[1]}", rest[2], last]
    if len(rest) == 3 and known and "/" not in topic and mode(rest[1]) is None:
        return [*number, f"{topic}/{rest[1]}", UNCLEAR, last]
    if len(rest) == 2 and (parts := _glued(topic, areas)):
        return [*number, *parts, last]
    if len(rest) == 2 and known:
        return [*number, topic, UNCLEAR, last]
    return fields


def numbered(reply: str, count: int, width: int, read: Callable[[list[str]], object | None], mend: Callable[[list[str]], list[str]] = list) -> list:
    """read() of the fields of lines 1 to count; refuses gaps, repeats and misfits.

    Lines of another width or without a number are prose. A number out of range
    refuses the reply only if its line reads as an answer.
    """
    found: dict[int, object] = {}
    for line in reply.split("\n"):
        fields = mend(line.split())
        if len(fields) != width or not (m := _NUMBER.fullmatch(fields[0])):
            continue
        n, value = int(m[1]), read(fields[1:])
        if not 1 <= n <= count:
            if value is not None:
                raise Refused(f"an answer for line {n} of {count}")
            continue
        if n in found:
            raise Refused(f"two answers for line {n}")
        if value is None:
            raise Refused(f"line {n} holds no valid answer")
        found[n] = value
    missing = [n for n in range(1, count + 1) if n not in found]
    if missing:
        raise Refused(f"{len(missing)} of {count} answers are missing, the first for line {missing[0]}")
    return [found[n] for n in range(1, count + 1)]


#: Answers of lines that are kept, and the characters of a line that is kept at most.
KEPT, KEPT_CHARS = 1 << 15, 120


@lru_cache(KEPT)
def _mended(rest: tuple[str, ...], areas: Areas) -> list[str]:
    return repaired(["", *rest], areas)[1:]


@lru_cache(KEPT)
def _verdict(f: tuple[str, ...], areas: Areas) -> tuple[str, str, float] | None:
    parts = areas.topic(f[0]), mode(f[1]), confidence(f[2])
    return None if None in parts else parts


def verdicts(reply: str, count: int, areas: Areas) -> list[tuple[str, str, float]]:
    """Lines repeat but for their numbers, so what short ones mean is kept for the next."""
    short = lambda f: sum(map(len, f)) <= KEPT_CHARS

    def mend(f: list[str]) -> list[str]:
        rest = tuple(f[1:])
        return [*f[:1], *(_mended if short(rest) else _mended.__wrapped__)(rest, areas)]

    return numbered(reply, count, 4, lambda f: (_verdict if short(f) else _verdict.__wrapped__)(tuple(f), areas), mend)


def modes(reply: str, count: int) -> list[str]:
    return numbered(reply, count, 2, lambda f: mode(f[0]))


def subjects(reply: str, count: int) -> list[tuple[str, float]]:
    """(slug or '' for none, confidence) of each line."""

    def read(f: list[str]):
        name, sure = slug(f[0]), confidence(f[1])
        return None if sure is None or not name else ("" if name in EMPTY_SUBS else name, sure)

    return numbered(reply, count, 3, read)


def names(reply: str, count: int) -> list[str]:
    """The raw names of clusters; each must leave a slug."""
    return numbered(reply, count, 2, lambda f: f[0] if slug(f[0]) else None)


def picks(reply: str, count: int) -> dict[int, int]:
    """A referee's picks (0 to 2): by number if all are there, else by place."""
    rows = [(int(a.rstrip(".")), int(b)) for a, b in (line.split() for line in reply.split("\n") if len(line.split()) == 2) if re.fullmatch(r"-?\d+\.?", a) and b in ("0", "1", "2")]
    by_number: dict[int, int] = {}
    for n, pick in rows:
        if 1 <= n <= count:
            by_number.setdefault(n, pick)
    if len(by_number) != count and len(rows) == count:
        return {k: pick for k, (_, pick) in enumerate(rows, 1)}
    return by_number


def verdict_json(reply: str, areas: Areas) -> tuple[str, str, float] | None:
    """The verdict of the first JSON object in prose, or None."""
    m = re.search(r"\{.*?\}", reply, re.S)
    try:
        x = json.loads(m[0]) if m else {}
        parts = areas.topic(str(x.get("topic", ""))), mode(str(x.get("mode", "") or "")), confidence(str(x.get("confidence", "")))
    except ValueError:
        return None
    return None if None in parts else parts


#: Kinds of numbered replies that Python reads: the parser over (reply, count, areas), and the columns of an answer.
KINDS: dict[str, tuple[Callable, str]] = {
    "verdicts": (verdicts, "topic string, mode string, confidence double"),
    "picks": (lambda reply, count, areas: [(picked.get(n),) for picked in [picks(reply, count)] for n in range(1, count + 1)], "pick int"),
}
_BLANKS = r"(?U)[\\s\\x1c-\\x1f]+"


def _slug_sql(x: str) -> str:
    edge = f"trim(BOTH '-' FROM regexp_replace(lower({x}), '[^a-z0-9]+', '-'))"
    return f"trim(TRAILING '-' FROM substring({edge}, 1, {SUB_CAP}))"


def _sure_sql(x: str) -> str:
    return f"if({x} RLIKE '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$' AND CAST({x} AS DOUBLE) BETWEEN 0 AND 1, CAST({x} AS DOUBLE), NULL)"


def _among(x: str, values) -> str:
    return f"{x} IN ({', '.join(repr(v) for v in sorted(values))})"


#: Kinds that column expressions read: fields of a line with its number, and the answer of the fields f[1], f[2] by column; the first is null where the line is no answer.
LINES: dict[str, tuple[int, dict[str, str]]] = {
    "modes": (2, {"mode": f"CASE WHEN {_among('f[1]', MODES)} THEN f[1] WHEN f[1] = '{UNCLEAR}' THEN '' END"}),
    "subjects": (3, {
        "sub": f"CASE WHEN {_sure_sql('f[2]')} IS NULL OR {_slug_sql('f[1]')} = '' THEN NULL WHEN {_among(_slug_sql('f[1]'), EMPTY_SUBS)} THEN '' ELSE {_slug_sql('f[1]')} END",
        "confidence": _sure_sql("f[2]"),
    }),
    "names": (2, {"name": f"CASE WHEN {_slug_sql('f[1]')} <> '' THEN f[1] END"}),
}


def parse_lines(df: DataFrame, kind: str) -> DataFrame:
    """What ``parse_kind`` says of modes, subjects and names, in column expressions alone.

    Lines are split, read and held against the batch's ids inside their row; a
    reply has as many lines as a batch has items, so its arrays are small.
    """
    width, answer = LINES[kind]
    key = next(iter(answer))
    told = ", ".join(f"'{c}', {x}" for c, x in answer.items())
    # A line's number, of more digits than any batch counts as too far.
    digits = "regexp_extract(f[0], '^0*([0-9]+)', 1)"
    number = f"if(length({digits}) > 9, 999999999, CAST({digits} AS INT))"
    rows = df.select("batch_id", "ids", F.expr(f"transform(split(coalesce(reply, ''), '\\n'), l -> filter(split(l, '{_BLANKS}'), w -> w <> ''))").alias("_fields"))
    rows = rows.withColumn("_lines", F.expr(f"transform(filter(_fields, f -> size(f) = {width} AND f[0] RLIKE '^[0-9]+[.):]?$'), f -> named_struct('n', {number}, 'digits', {digits}, {told}))"))
    rows = rows.withColumn("_numbers", F.expr("transform(_lines, x -> x.n)"))
    wrong = f"""filter(transform(_lines, (x, i) -> CASE
      WHEN x.n < 1 OR x.n > size(ids) THEN if(x.{key} IS NULL, NULL, concat('an answer for line ', x.digits, ' of ', size(ids)))
      WHEN array_position(_numbers, x.n) <= i THEN concat('two answers for line ', x.n)
      WHEN x.{key} IS NULL THEN concat('line ', x.n, ' holds no valid answer') END), e -> e IS NOT NULL)[0]"""
    absent = "if(size(ids) = 0, array(), array_except(sequence(1, greatest(size(ids), 1)), _numbers))"
    rows = rows.withColumn("_absent", F.expr(absent)).withColumn("_wrong", F.expr(f"get({wrong[:-3]}, 0)"))
    short = F.when(F.size("_absent") > 0, F.concat(F.size("_absent"), F.lit(" of "), F.size("ids"), F.lit(" answers are missing, the first for line "), F.get("_absent", F.lit(0))))
    rows = rows.withColumn("error", F.coalesce("_wrong", short))
    each = rows.select("batch_id", "error", "_lines", "_numbers", F.posexplode("ids").alias("_at", "id"))
    found = F.when(F.col("error").isNull(), F.get("_lines", (F.array_position("_numbers", F.col("_at") + 1) - 1).cast("int")))
    return each.withColumn("_x", found).select("batch_id", "id", *(F.col(f"_x.{c}").alias(c) for c in answer), "error")


def parse_kind(df: DataFrame, kind: str, areas: Areas = Areas(())) -> DataFrame:  # noqa: B008
    """batch_id, ids, reply to batch_id, id, the answer's columns and error.

    A refused reply gives a row an id with null answers and the refusal. Python
    reads verdicts, whose layouts are mended, and picks; the other kinds are
    column expressions.
    """
    if kind in LINES:
        return parse_lines(df, kind)
    read, columns = KINDS[kind]
    width = columns.count(",") + 1

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for batch, ids, reply in zip(part["batch_id"], part["ids"], part["reply"], strict=True):
                try:
                    out += [(batch, i, *v, None) for i, v in zip(ids, read(reply or "", len(ids), areas), strict=True)]
                except Refused as why:
                    out += [(batch, i, *[None] * width, str(why)) for i in ids]
            frame = pd.DataFrame(out, columns=["batch_id", "id", *(c.split()[0] for c in columns.split(", ")), "error"])
            yield frame.astype({"pick": "Int32"}) if "pick" in frame else frame

    return df.select("batch_id", "ids", "reply").mapInPandas(run, f"batch_id long, id string, {columns}, error string")


def parse_replies(df: DataFrame, areas: Areas) -> DataFrame:
    """batch_id, ids, reply to id, topic, mode, confidence; refused rows have an error."""
    return parse_kind(df, "verdicts", areas)


def parse_json(df: DataFrame, areas: Areas) -> DataFrame:
    """id, reply to id, topic, mode, confidence: the first JSON object of each reply, nulls where there is no verdict."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [verdict_json(reply or "", areas) or (None, None, None) for reply in part["reply"]]
            yield pd.DataFrame([(i, *v) for i, v in zip(part["id"], found, strict=True)], columns=["id", "topic", "mode", "confidence"])

    return df.select("id", "reply").mapInPandas(run, "id long, topic string, mode string, confidence double")
