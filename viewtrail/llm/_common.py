"""Shared folders, tables and file access of the training-data operators."""

from __future__ import annotations

import gc
import posixpath
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``.

    Only where the setting is absent (tests on one machine) a local folder is
    made and set, so that every later call returns the same one.
    """
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if not found:
        found = Path(tempfile.mkdtemp(prefix="viewtrail-")).as_uri()
        spark.conf.set(CHECKPOINT_DIR, found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path inside the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table in the shared folder and reads it: lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, uri: str) -> None:
    """Deletes a scratch folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Deletes the folder of a table of ``stored`` that nothing reads again."""
    for folder in {posixpath.dirname(f) for f in df.inputFiles()}:
        drop_folder(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are over.

    Spark does so once the driver has collected its garbage, which may be long
    after an operator of many jobs has filled the disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def file_system(uri: str):
    """(pyarrow file system, path in it) of a shared folder's file."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, write) -> None:
    """``write(stream)`` into a file that appears whole or not at all.

    A lost or repeated task leaves at most an orphan beside it: each attempt
    writes a file of its own and renames it at the end.
    """
    fs, path = file_system(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(own) as stream:
        write(stream)
    fs.move(own, path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(id_column: str, folds: int, fold: int):
    """crc32(id as text) mod folds = fold; rows without an id are held out."""
    crc = F.crc32(F.col(id_column).cast("string").cast("binary"))
    return F.coalesce(crc % folds == fold, F.lit(True))


#: Characters of a text that a model is fitted on at most: longer ones are left out of the fit, not of the scores.
TRAIN_CHARS = 1_000_000


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, fold: int, bound: int) -> DataFrame:
    """(doc_id, text, label) of labelled documents outside the held-out fold.

    At most about ``bound`` rows, chosen by a hash of the id, then of id and text:
    a model is fitted on a bounded sample. Rows without an id, a text or a label
    are left out, and texts of over TRAIN_CHARS characters; repeated rows count
    once.
    """
    share = lambda rows, count, *key: rows.filter(F.pmod(F.xxhash64(*key), F.lit(1_000_003)) < int(bound / count * 1_000_003)) if count > bound else rows
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out("doc_id", folds, fold)).select("doc_id", F.col(label_col).cast("int").alias("label")).distinct()
    known = share(known, known.count(), "doc_id")
    # About ``bound`` rows of 12 bytes: a proven bound for the broadcast.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull() & (F.length("text") <= TRAIN_CHARS)).join(F.broadcast(known), "doc_id").distinct()
    return share(rows, rows.count(), "doc_id", "text")


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of the UTF-8 bytes of a text that isn't empty, in DuckDB's SQL, half a byte a step."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    step = lambda c, x: f"xor({c} >> 4, {table}[1 + (xor({c}, {x}) & 15)])"
    halves = f"list_transform(string_split(regexp_replace(hex(encode({text})), '(.)(.)', '\\2\\1', 'g'), ''), lambda d: CAST(strpos('123456789ABCDEF', d) AS BIGINT))"
    return f"xor(list_reduce({halves}, lambda c, x: {step('c', 'x')}, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"
