"""Tables of a decoding study from its files: results, indexes, leaderboards, side tables, manifests."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import float_key, parse_tag
from ..model import CELLS, DECODE_RESULT, ELECTRODE_MEANS, FOLD_INDEX, LEADERBOARD, MANIFEST


def _paths(spark: SparkSession, path: str) -> list:
    """Files that a path or pattern names, or that lie in the folders it names, by name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f for f in files.globStatus(at) or []]
    inside = [g for f in found for g in (files.listStatus(f.getPath()) if f.isDirectory() else [f])]
    return sorted(f.getPath().toString() for f in inside if f.isFile() and f.getPath().getName()[0] not in "._")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at))


def _header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names in a CSV file's first line, read by itself through Hadoop's file system and codecs; none of an empty file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(conf).open(at)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
    lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    try:
        return tuple(next(csv.reader([lines.readLine() or ""]), ()))
    finally:
        lines.close()


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV files with a header, columns found by name in each file: those of the schema that a file lacks are null.

    Files are grouped by their header (first lines are read sixteen at a time, without a job) and each group is read with its
    own columns, so files of one folder may differ. Columns beyond the schema aren't read. No file, or none with a header, gives no rows.
    """
    by_header: dict[tuple, list[str]] = {}
    files = _paths(spark, path)
    with ThreadPoolExecutor(16) as pool:
        for file, names in zip(files, pool.map(lambda f: _header(spark, f), files), strict=True):
            if names:
                by_header.setdefault(names, []).append(file)
    kinds, out = {f.name: f.dataType for f in schema}, None
    for names, files in by_header.items():
        read = spark.read.option("header", True).schema(T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])).csv(files)
        some = read.select(*[F.col(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        out = some if out is None else out.unionByName(some)
    return spark.createDataFrame([], schema) if out is None else out


def read_index(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A fold index from CSV, gzip by its name; just some columns if asked for (the others aren't parsed)."""
    index = _csv(spark, path, FOLD_INDEX)
    return index.select(*columns) if columns else index


def read_decoded(spark: SparkSession, folder: str, pattern: str = "L*.csv") -> DataFrame:
    """All decoding results of a folder; no rows where it has none."""
    return _csv(spark, f"{folder.rstrip('/')}/{pattern}", DECODE_RESULT)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, CELLS)


def read_electrode_means(spark: SparkSession, folder: str, pattern: str = "electrode_mean_s*_t*.csv") -> DataFrame:
    """subject, trial, electrode, mean_auroc: the session is in each file's name."""
    tag = F.regexp_extract(F.input_file_name(), r"(s\d+_t\d+)\.csv", 1)
    means = spark.read.option("header", True).schema(ELECTRODE_MEANS).csv(f"{folder.rstrip('/')}/{pattern}").withColumn("_s", parse_tag(tag))
    return means.select("_s.subject", "_s.trial", "electrode", "mean_auroc")


def read_leaderboard(spark: SparkSession, path: str, model: str, split: str) -> DataFrame:
    """CELLS rows of a published model: JSON files named after the task, sessions as keys, mean over folds."""
    files = spark.read.schema(LEADERBOARD).option("multiLine", True).json(path)
    task = F.regexp_replace(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1), "^population_", "")
    rows = files.select(task.alias("task"), F.explode("evaluation_results").alias("tag", "r")).withColumn("_s", parse_tag("tag"))
    scores = F.transform("r.population.one_second_after_onset.folds", lambda f: f["test_roc_auc"])
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return rows.select(F.lit(model).alias("model"), F.lit(split).alias("split"), "_s.subject", "_s.trial", "task", mean.alias("auroc"))


def read_subsets(spark: SparkSession, path: str) -> DataFrame:
    """subject, trial, pos (from 1), electrode of a JSON object of lists by session."""
    lists = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    rows = lists.select(F.explode("m").alias("tag", "names")).withColumn("_s", parse_tag("tag"))
    return rows.select("_s.subject", "_s.trial", F.posexplode("names").alias("pos", "electrode")).withColumn("pos", F.col("pos") + 1)


def read_keyed_numbers(spark: SparkSession, path: str, value: str, name: str = "pitch") -> DataFrame:
    """key (text of five decimals) and one number of each entry of a JSON object keyed by numbers."""
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,struct<`{value}`:double>>")).alias("k", "v"))
    return entries.select(float_key("k").alias("key"), F.col(f"v.{value}").alias(name))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each name of a JSON-lines log, by place: later files, then later lines of a file.

    Files follow each other by when they were written, then by name; what append_log() adds comes last.
    """
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    rows = spark.read.schema(MANIFEST).json(path).select("*", place.alias("_at")).where(F.col("name").isNotNull())
    best = F.max_by(F.struct(*[f.name for f in MANIFEST]), "_at").alias("m")
    return rows.groupBy("name").agg(best).select("m.*")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
