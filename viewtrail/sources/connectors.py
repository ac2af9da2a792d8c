"""Connectors to outside services, with the client injected.

A client is any picklable callable over a list of ids or texts. The answers are
checked before they are rows; there is no network in here.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def with_backoff(call: Callable, *args, tries: int = 4, cap: int = 3, sleep: Callable[[float], None] = time.sleep):
    """call(*args), again after 1, 2, 4 and at most 2**cap seconds."""
    for k in range(tries):
        try:
            return call(*args)
        except OSError:
            if k == tries - 1:
                raise
            sleep(2 ** min(k, cap))


class Backoff:
    """Shared between the chunks of a task: the level rises with a failure and falls with a success.

    A chunk waits 2**level seconds before it is asked while the level isn't 0, so
    that one throttled chunk slows the following ones, which then speed up step by
    step.
    """

    def __init__(self, cap: int = 3, tries: int = 4, sleep: Callable[[float], None] = time.sleep):
        self.level, self.cap, self.tries, self.sleep = 0, cap, tries, sleep

    def __call__(self, call: Callable, *args):
        for k in range(self.tries):
            if self.level:
                self.sleep(2 ** (self.level - 1))
            try:
                answer = call(*args)
            except OSError:
                self.level = min(self.level + 1, self.cap + 1)
                if k == self.tries - 1:
                    raise
            else:
                self.level = max(0, self.level - 1)
                return answer


def fetch_metadata(ids: DataFrame, client: Callable[[list[str]], list[dict]], chunk: int = 50, id_col: str = "video_id") -> DataFrame:
    """Metadata rows of ids, asked in chunks; duration is cut to whole seconds."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = Backoff()
        for part in parts:
            names = part[id_col].tolist()
            for at in range(0, len(names), chunk):
                rows = ask(client, names[at : at + chunk])
                yield pd.DataFrame([(r["id"], r.get("title", ""), int(r.get("duration") or 0), bool(r.get("unavailable")), r.get("gone_reason") or None) for r in rows], columns=["id", "title", "duration_s", "unavailable", "gone_reason"])

    return ids.select(id_col).mapInPandas(run, "id string, title string, duration_s int, unavailable boolean, gone_reason string")


def checked_vectors(answer: list[dict], count: int) -> list[list[float]]:
    """Vectors in the order asked: as many as asked, each place once."""
    places = [a["index"] for a in answer]
    if len(answer) != count or sorted(places) != list(range(count)):
        raise ValueError(f"{len(answer)} vectors for {count} texts, or a place twice")
    return [a["embedding"] for a in sorted(answer, key=lambda a: a["index"])]


def embed(texts: DataFrame, client: Callable[[list[str]], list[dict]], batch: int = 32, text_col: str = "text", key_col: str = "key") -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                mine = part.iloc[at : at + batch]
                vectors = checked_vectors(with_backoff(client, mine[text_col].tolist()), len(mine))
                yield pd.DataFrame({"key": mine[key_col].tolist(), "vec": vectors})

    return texts.select(key_col, text_col).mapInPandas(run, "key string, vec array<float>")


def chat(prompts: DataFrame, client: Callable[[str, str, int], str], most_tokens: int = 1024) -> DataFrame:
    """key, system, user to key, reply; a client takes (system, user, most tokens)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = Backoff()
        for part in parts:
            replies = [ask(client, s, u, most_tokens) for s, u in zip(part["system"], part["user"], strict=True)]
            yield pd.DataFrame({"key": part["key"], "reply": replies})

    return prompts.select("key", "system", "user").mapInPandas(run, "key string, reply string")


def missing_models(client: Callable[[], list[str]], wanted: list[str]) -> list[str]:
    """The wanted models that a service doesn't offer."""
    offered = set(with_backoff(client))
    return [m for m in wanted if m not in offered]
