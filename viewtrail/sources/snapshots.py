"""Tables that are replaced at once, and keyed tables that are changed without being rewritten.

Both keep immutable folders and a log of small commits, numbered from 1. A commit
is a file that can be created once only, so of two writers one meets
``CommitConflict`` and begins anew; what a lost writer leaves is in no commit and
is never read. Readers take the last whole commit, or an earlier one by number.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as t


class CommitConflict(RuntimeError):
    """Another writer has made this commit."""


class CommitLog:
    """Numbered JSON files of a folder, through Hadoop's file system."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self.folder, self._path = folder.rstrip("/"), jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._exists_error = "FileAlreadyExistsException"
        self._read = jvm.org.apache.commons.io.IOUtils.toString

    def numbers(self) -> list[int]:
        at = self._path(self.folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def read(self, number: int) -> dict | None:
        """The commit's content; None while its writer hasn't closed it."""
        stream = self._fs.open(self._path(f"{self.folder}/{number:010d}.json"))
        try:
            body = self._read(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(body) if body.endswith("\n") else None

    def last(self, at_most: int | None = None) -> tuple[int, dict] | tuple[int, None]:
        for number in reversed(self.numbers()):
            if (at_most is None or number <= at_most) and (found := self.read(number)) is not None:
                return number, found
        return 0, None

    def commit(self, number: int, content: dict) -> None:
        try:
            stream = self._fs.create(self._path(f"{self.folder}/{number:010d}.json"), False)
        except Exception as error:
            if self._exists_error in str(error):
                raise CommitConflict(f"commit {number} of {self.folder} is made") from None
            raise
        try:
            stream.write(bytearray((json.dumps(content, sort_keys=True) + "\n").encode("utf-8")))
        finally:
            stream.close()

    def remove(self, *parts: str) -> None:
        """Deletes a folder or file beside the log."""
        self._fs.delete(self._path(posixpath.join(posixpath.dirname(self.folder), *parts)), True)

    def forget(self, number: int) -> None:
        self._fs.delete(self._path(f"{self.folder}/{number:010d}.json"), False)


@dataclass
class Snapshots:
    """An output whose every state is a folder of its own; the pointer to it moves last."""

    spark: SparkSession
    folder: str

    def __post_init__(self):
        self.log = CommitLog(self.spark, f"{self.folder}/commits")

    def replace(self, rows: DataFrame) -> int:
        """The number of the new state, which readers see whole or not at all."""
        number, data = self.log.last()[0] + 1, f"state-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{data}")
        self.log.commit(number, {"data": data, "schema": rows.schema.jsonValue()})
        return number

    def read(self, number: int | None = None) -> DataFrame:
        """The last state, or the one of a number."""
        found, content = self.log.last(number)
        if content is None or (number is not None and found != number):
            raise LookupError(f"{self.folder} has no state" + ("" if number is None else f" {number}"))
        return self.spark.read.schema(StructType.fromJson(content["schema"])).parquet(f"{self.folder}/{content['data']}")

    def numbers(self) -> list[int]:
        return [n for n in self.log.numbers() if self.log.read(n) is not None]

    def expire(self, keep: int) -> None:
        """Deletes all but the last states; their readers end with an error."""
        for number in self.numbers()[:-keep]:
            content = self.log.read(number)
            self.log.forget(number)
            self.log.remove(content["data"])


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


@dataclass
class KeyedLog:
    """A keyed table in hash buckets: a base each, and logs of later rows.

    An update writes one folder, with files for the buckets of its keys alone,
    and a commit. Reads merge a bucket's rows by key, the last commit's first;
    buckets without logs are read as they are. Compaction writes new bases for
    the buckets whose logs have grown to a share of their base, and nothing else.
    Commits hold, for every bucket, the commit of its base and the rows of its
    base and logs: a few numbers a bucket.
    """

    spark: SparkSession
    folder: str
    key: str
    schema: StructType
    buckets: int = 64

    def __post_init__(self):
        self.log = CommitLog(self.spark, f"{self.folder}/commits")

    def _state(self, number: int | None = None) -> tuple[int, dict]:
        found, content = self.log.last(number)
        return found, content or {"folders": {}, "base": [0] * self.buckets, "rows": [[0, 0] for _ in range(self.buckets)]}

    def _write(self, rows: DataFrame) -> tuple[str, dict[int, int]]:
        """(folder, rows by bucket): one task a bucket, a file each."""
        name = f"rows-{uuid.uuid4().hex}"
        each = rows.withColumn("bucket", bucket_of(self.key, self.buckets))
        each.repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{name}")
        counts = self.spark.read.schema(self._stored()).parquet(f"{self.folder}/{name}").groupBy("bucket").count().collect()  # of file footers, a row a bucket
        return name, {r["bucket"]: r["count"] for r in counts}

    def _stored(self) -> StructType:
        return StructType([*self.schema.fields]).add("bucket", "integer")

    def update(self, rows: DataFrame, order: str | None = None) -> int:
        """New rows before old ones; of those that repeat a key the greatest by ``order`` stays, without one any.

        An unsafe key fails the job; then, as after any failure, the table is as it was.
        """
        safe = F.when(t.safe_key(self.key), F.col(self.key)).otherwise(F.raise_error(F.concat(F.lit("an unsafe key: "), F.coalesce(F.col(self.key), F.lit("null")))))
        new, row = rows.withColumn(self.key, safe), F.struct(*self.schema.names)
        last = new.groupBy(self.key).agg((F.max_by(row, order) if order else F.first(row)).alias("_row")).select("_row.*")
        name, counts = self._write(last.select(*self.schema.names))
        while True:
            number, state = self._state()
            state["folders"][str(number + 1)] = name
            for b, n in counts.items():
                state["rows"][b][1] += n
            try:
                self.log.commit(number + 1, state)
                return number + 1
            except CommitConflict:
                continue  # the folder stays; it only comes later

    def _live(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        """Rows of bases and logs with bucket and commit."""
        parts = None
        base = F.array(*map(F.lit, state["base"]))
        for number, name in sorted(state["folders"].items(), key=lambda x: int(x[0])):
            part = self.spark.read.schema(self._stored()).parquet(f"{self.folder}/{name}").filter(F.get(base, F.col("bucket")) <= int(number))
            part = (part if buckets is None else part.filter(F.col("bucket").isin(buckets))).withColumn("_commit", F.lit(int(number)))
            parts = part if parts is None else parts.unionByName(part)
        return parts if parts is not None else self.spark.createDataFrame([], self._stored()).withColumn("_commit", F.lit(0))

    def _merged(self, state: dict, buckets: list[int]) -> DataFrame:
        row = F.struct(*self.schema.names)
        return self._live(state, buckets).groupBy("bucket", self.key).agg(F.max_by(row, "_commit").alias("_row")).select("_row.*")

    def read(self, number: int | None = None) -> DataFrame:
        """The table after a commit, by default the last."""
        _, state = self._state(number)
        logged = [b for b, (_, n) in enumerate(state["rows"]) if n]
        plain = [b for b in range(self.buckets) if b not in set(logged)]
        return self._live(state, plain).select(*self.schema.names).unionByName(self._merged(state, logged))

    def compact(self, share: float = 0.25) -> int:
        """New bases for buckets whose logs are at least so large a share of their base; the number of buckets."""
        number, state = self._state()
        full = [b for b, (base, n) in enumerate(state["rows"]) if n and n >= share * base]
        if not full:
            return 0
        name, counts = self._write(self._merged(state, full))
        state["folders"][str(number + 1)] = name
        for b in full:
            state["base"][b], state["rows"][b] = number + 1, [counts.get(b, 0), 0]
        oldest = min(state["base"])
        state["folders"] = {k: v for k, v in state["folders"].items() if int(k) >= oldest}
        self.log.commit(number + 1, state)  # a conflict leaves the table as the other writer made it
        return len(full)
