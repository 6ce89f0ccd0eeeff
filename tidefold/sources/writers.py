"""Results as files: tables, appended cells that survive a restart, documents."""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import _exists


_local: dict[str, tempfile.TemporaryDirectory] = {}
_made: dict[str, list[str]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which a cluster shares; a local session without one gets a folder of its own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _local.setdefault(spark.sparkContext.applicationId, tempfile.TemporaryDirectory(prefix="tidefold-", ignore_cleanup_errors=True)).name
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> None:
    """Deletes what this session wrote below scratch(); tables that still read from there are then lost."""
    made = _made.pop(spark.sparkContext.applicationId, [])
    for path in made:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """A table written below scratch() and read again: small ones that several branches of a plan use."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file of the driver's, in any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data))
    out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def write_csv(rows: DataFrame, path: str, compression: str = "none") -> None:
    """Replaces a folder of CSV files with headers."""
    rows.write.mode("overwrite").option("header", True).option("compression", compression).csv(path)


def todo(keys: DataFrame, path: str, on: Sequence[str]) -> DataFrame:
    """Keys without a result under a path yet."""
    spark = keys.sparkSession
    there = any(_exists(spark, f"{path}/{some}") for some in ("*.parquet", "append=*/*.parquet"))
    return keys.join(spark.read.parquet(path).select(*on), list(on), "left_anti") if there else keys


def append_new(results: DataFrame, path: str, on: Sequence[str]) -> None:
    """Adds the results whose keys aren't there; one that is run again adds nothing twice.

    An append is a folder of its own that appears when it is whole. Of writers that run at once none waits for another:
    keys that two of them add are there twice, and read_appended() takes them from the earlier append.
    """
    spark, name = results.sparkSession, f"{time.time_ns():020}-{uuid.uuid4().hex}"
    hidden = f"{path}/_writing-{name}"
    todo(results.dropDuplicates(list(on)), path, on).write.parquet(hidden)
    at = spark._jvm.org.apache.hadoop.fs.Path
    if not at(hidden).getFileSystem(spark._jsc.hadoopConfiguration()).rename(at(hidden), at(f"{path}/append={name}")):
        raise RuntimeError(f"{hidden} could not be renamed")


def read_appended(spark: SparkSession, path: str, on: Sequence[str]) -> DataFrame:
    """What append_new() added, each key once; of a key that overlapping writers added the row of the earliest append."""
    rows = spark.read.parquet(path)
    if "append" not in rows.columns:
        return rows
    kept = [c for c in rows.columns if c != "append"]
    return rows.groupBy(*on).agg(F.min_by(F.struct(*kept), "append").alias("_row")).select("_row.*")


def compact(spark: SparkSession, path: str, on: Sequence[str]) -> None:
    """Writes read_appended() as one append in place of all there are; only while nobody appends."""
    at, name = spark._jvm.org.apache.hadoop.fs.Path, f"{time.time_ns():020}-{uuid.uuid4().hex}"
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = [f.getPath() for f in files.globStatus(at(f"{path}/append=*")) or []]
    read_appended(spark, path, on).write.parquet(f"{path}/_writing-{name}")
    # the new one is later than those it holds: if it stops here, readers take the old rows or, as they go, the same from it
    files.rename(at(f"{path}/_writing-{name}"), at(f"{path}/append={name}"))
    for f in old:
        files.delete(f, True)


def to_document(results: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """key and document: each row's other columns as JSON, nulls kept."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in results.columns if c not in keys]
    return results.select(*keys, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("document"))


def write_document(results: DataFrame, path: str, key: str) -> None:
    """One JSON file of results by key, for tables of summaries: the rows come to the driver and are some dozen."""
    doc = {r[key]: json.loads(r["document"]) for r in to_document(results, key).orderBy(key).toLocalIterator()}
    spark = results.sparkSession
    spark.createDataFrame([(json.dumps(doc, indent=2),)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def write_numbers(rows: DataFrame, path: str) -> None:
    """The numbers behind a figure, as JSON records."""
    rows.write.mode("overwrite").json(path)


def stamped(rows: DataFrame, column: str = "downloaded_utc") -> DataFrame:
    """Rows with the time of the query in UTC, to the second: 2026-01-31T12:00:00+00:00."""
    utc = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return rows.withColumn(column, F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines in a folder; files that are there stay as they are. read_manifest() reads it."""
    rows.write.mode("append").json(path)
