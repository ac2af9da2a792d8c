"""Raw exports: discovery, JSON and CSV scans, sinks, the import guard."""

from __future__ import annotations

import csv
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t

RAW = "header STRING, title STRING, titleUrl STRING, subtitles ARRAY<STRUCT<name: STRING, url: STRING>>, details ARRAY<STRUCT<name: STRING>>, time STRING, products ARRAY<STRING>"
META = "id STRING, title STRING, channel STRING, channel_id STRING, duration DOUBLE, categories ARRAY<STRING>, tags ARRAY<STRING>, upload_date STRING, unavailable BOOLEAN, gone_reason STRING"
# Fixed file names of the export's locales.
HISTORY_NAMES = ("wiedergabeverlauf.json", "watch-history.json")
SUBSCRIPTION_NAMES = ("abos.csv", "subscriptions.csv")
SKIPPED_FOLDERS = ("cache", "out")


def find_exports(root: str, names: tuple[str, ...], depth: int = 4) -> list[Path]:
    """Files of these names, at most so deep, outside caches and outputs."""
    base, found = Path(root), []
    for path in sorted(base.rglob("*")):
        inner = path.relative_to(base).parts
        if path.is_file() and path.name.lower() in names and len(inner) <= depth and not set(inner[:-1]) & set(SKIPPED_FOLDERS):
            found.append(path)
    return found


def newest(paths: list[Path]) -> Path | None:
    """The last modified; of equals the first."""
    return max(paths, key=lambda p: p.stat().st_mtime, default=None)


def pick_export(root: str) -> tuple[Path | None, Path | None]:
    """(history, subscriptions); with several exports both come from one of them."""
    histories, subs = find_exports(root, HISTORY_NAMES), find_exports(root, SUBSCRIPTION_NAMES)
    history = newest(histories)
    group = lambda p: p.relative_to(root).parts[0] if len(p.relative_to(root).parts) > 1 else ""
    if history is not None and len({group(h) for h in histories}) > 1:
        subs = [s for s in subs if group(s) == group(history)]
    return history, newest(subs)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON export; an HTML export is refused."""
    first = spark.read.text(path).filter(F.length(F.trim("value")) > 0).limit(1).collect()
    if first and first[0][0].lstrip("﻿ \t").startswith("<"):
        raise ValueError("the export is HTML; ask for JSON instead")
    return spark.read.schema(RAW).option("multiLine", True).option("mode", "FAILFAST").json(path)


def views_of(entries: DataFrame) -> DataFrame:
    """Views of the entries that aren't ads; the time is null where it can't be read."""
    sub = F.get("subtitles", F.lit(0))
    return entries.filter(~t.is_ad("details")).select(
        t.video_id("titleUrl").alias("video_id"), t.clean_title("title").alias("title"), sub["name"].alias("channel"), sub["url"].alias("channel_url"),
        t.rfc3339("time").alias("watched_at"), t.is_music("products", "titleUrl").alias("music"),
    )


def parse_statistics(entries: DataFrame) -> DataFrame:
    ad, no_ad = t.is_ad("details"), ~t.is_ad("details")
    return entries.agg(
        F.count("*").alias("total"), F.count_if(ad).alias("ads"), F.count_if(no_ad).alias("views"), F.count_if(no_ad & (F.coalesce("titleUrl", F.lit("")) == "")).alias("no_url"),
        F.count_if(no_ad & t.is_music("products", "titleUrl")).alias("music"), F.count_if(no_ad & t.rfc3339("time").isNull()).alias("bad_time"),
    )


def read_subscriptions(spark: SparkSession, path: str) -> DataFrame:
    """A ragged CSV of any width whose columns are named by its header; rows without id go.

    The header is the first line of each file; that of the first file by path
    tells the columns. One that speaks of an id is the id, even if it names an
    address too; then an address, then a title. Where none is named the places
    count.
    """
    first = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).agg(F.min("path")).first()[0]
    line = spark.read.text(first).first()[0] if first else ""  # of one file, whose first split is the first to be read
    head = [h.lower().removeprefix("\ufeff") for h in next(csv.reader([line]), [])]
    place: dict[str, int] = {}
    for k, h in enumerate(head):
        name = "channel_id" if "id" in h else "channel_url" if "url" in h else "title" if "title" in h or "titel" in h else None
        if name:
            place.setdefault(name, k)
    for k, name in enumerate(("channel_id", "channel_url", "title")):
        place.setdefault(name, k)
    schema = ", ".join(f"c{k} STRING" for k in range(max(len(head), 3)))
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").csv(path)
    own = rows.select(*(F.trim(F.col(f"c{place[n]}")).alias(n) for n in ("channel_id", "channel_url", "title")))
    return own.filter(F.length(F.coalesce("channel_id", F.lit(""))) > 0)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """Strict: one bad line fails the read; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_keyed(spark: SparkSession, folder: str, schema=META, strict: bool = True) -> DataFrame:
    """One JSON file a key; lenient reads drop what can't be decoded."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(schema).option("multiLine", True).option("mode", mode).option("pathGlobFilter", "*.json").json(folder)


def keyed_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids that a folder of keyed files names, without reading them."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path")
    return listed.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("id"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of each file: twelve digits of its SHA-256, its path, its time in UTC; for small files such as configs."""
    files = spark.read.format("binaryFile").load(path)
    stamp = F.date_format(F.to_utc_timestamp("modificationTime", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return files.select("path", F.concat(F.lit("sha256:"), F.substring(F.sha2("content", 256), 1, 12), F.lit(" "), "path", F.lit(" "), stamp).alias("line"))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The keyed table after an update: a row a key, new rows before old ones.

    Of new rows that repeat a key the greatest by ``order`` stays, without one
    any. An unsafe key is refused: the job fails and names it.
    """
    checked = new.withColumn(key, F.when(t.safe_key(key), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("an unsafe key: "), F.coalesce(F.col(key), F.lit("null"))))))
    row = F.struct(*(F.col(c) for c in checked.columns))
    pick = F.max_by(row, order) if order else F.first(row)
    last = checked.groupBy(key).agg(pick.alias("_row")).select("_row.*")
    return old.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def write_keyed(df: DataFrame, folder: str, key: str) -> DataFrame:
    """One JSON file a row, named by its key; returns (key, path) of what was written.

    Each file is written beside its place and moved there, so that it appears
    whole or not at all, and a repeated task leaves the same files. An unsafe key
    is refused. Nothing is written before the result is read.
    """
    from collections.abc import Iterator

    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs as af

        for part in parts:
            paths = []
            for name, body in zip(part["key"], part["body"], strict=True):
                fs, at = (af.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if folder.startswith(("/", "file:")) else af.FileSystem.from_uri(folder)
                fs.create_dir(at, recursive=True)
                own = f"{at}/.{name}.{uuid.uuid4().hex}.part"
                with fs.open_output_stream(own) as out:
                    out.write(body.encode("utf-8"))
                fs.move(own, f"{at}/{name}.json")
                paths.append(f"{at}/{name}.json")
            yield pd.DataFrame({"key": part["key"], "path": paths})

    safe = F.when(t.safe_key(key), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("an unsafe key: "), F.coalesce(F.col(key), F.lit("null")))))
    return df.select(safe.alias("key"), F.to_json(F.struct(*df.columns)).alias("body")).mapInPandas(run, "key string, path string")


def read_unseen(spark: SparkSession, folder: str, schema: str, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, seen now) of a folder of keyed files: only those whose path isn't seen.

    A file that can't be decoded gives no row and isn't marked, so that the next
    scan tries it again.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    new = files.select("path", F.decode("content", "UTF-8").alias("body")).join(seen.select("path"), "path", "left_anti")
    bad = "_bad STRING"
    read = new.select("path", F.from_json("body", f"{schema}, {bad}", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("row"))
    whole = read.filter(F.col("row").isNotNull() & F.col("row._bad").isNull())
    return whole.select("path", "row.*").drop("_bad"), seen.select("path").unionByName(whole.select("path"))


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path under the root, modified) of all files, from the file system's listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime")
    base = root.rstrip("/").removeprefix("file:").lstrip("/")
    return files.select(F.regexp_replace("path", f"^[a-z]*:/*{base}/", "").alias("path"), F.col("modificationTime").alias("modified"))


def candidates(files: DataFrame, depth: int = 4) -> DataFrame:
    """Adds kind and export: the files that are histories or subscriptions, not too deep and in no skipped folder."""
    parts = F.split("path", "/")
    name = F.lower(F.element_at(parts, -1))
    kind = F.when(name.isin(*HISTORY_NAMES), "history").when(name.isin(*SUBSCRIPTION_NAMES), "subscriptions")
    skipped = F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, SKIPPED_FOLDERS)))
    own = files.withColumns({"kind": kind, "export": F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise("")})
    return own.filter(F.col("kind").isNotNull() & (F.size(parts) <= depth) & ~skipped)


def chosen(files: DataFrame) -> DataFrame:
    """One row (history, subscriptions, exports): the newest of each kind, the first path on ties.

    With histories of several exports both files come from one of them.
    """
    found, newest_first = candidates(files), F.struct((-F.unix_micros("modified")).alias("age"), "path")
    of = lambda kind: found.filter(F.col("kind") == kind)
    history = of("history").agg(F.min_by(F.struct("path", "export"), newest_first).alias("h"), F.count_distinct("export").alias("exports"))
    fit = (F.coalesce(F.col("exports"), F.lit(0)) <= 1) | (F.col("export") == F.col("h.export"))
    subs = of("subscriptions").crossJoin(F.broadcast(history)).filter(fit).agg(F.min_by("path", newest_first).alias("subscriptions"))  # history: one row
    return history.crossJoin(subs).select(F.col("h.path").alias("history"), "subscriptions", "exports")


def append_log(path: str, **event) -> None:
    """One JSON line of a run's log."""
    with open(path, "a", encoding="utf-8") as log:
        log.write(json.dumps(event, sort_keys=True, default=str) + "\n")


def lost_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """(fewer, later): whether a new history has fewer views or begins later."""
    one = lambda df, p: df.agg(F.count("*").alias(f"{p}_n"), F.min("watched_at").alias(f"{p}_first"))
    both = one(old, "old").crossJoin(one(new, "new"))  # a row each
    return both.select((F.col("new_n") < F.col("old_n")).alias("fewer"), F.coalesce(F.col("new_first") > F.col("old_first"), F.lit(False)).alias("later"))
