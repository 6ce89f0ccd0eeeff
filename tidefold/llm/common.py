"""What the operators of this subpackage share: tables, shared storage, byte-wise text rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space and \t to \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc32_mod(column: str, n: int) -> Column:
    """crc32 of a value written as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


_local: dict[str, tempfile.TemporaryDirectory] = {}
_made: dict[str, list[str]] = {}
_scope: ContextVar[list[str] | None] = ContextVar("folders", default=None)


@contextmanager
def folders() -> Iterator[list[str]]:
    """The folders that are made within this block, by this thread: not those of operators that run beside it."""
    own: list[str] = []
    token = _scope.set(own)
    try:
        yield own
    finally:
        _scope.reset(token)


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir.

    Where that is unset, a local session gets a folder that goes with the process; a cluster has none to share, so that
    is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if root is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _local.setdefault(app, tempfile.TemporaryDirectory(prefix="tidefold-", ignore_cleanup_errors=True)).name
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    _made.setdefault(app, []).append(path)
    if (own := _scope.get()) is not None:
        own.append(path)
    return path


def made(spark: SparkSession) -> list[str]:
    """The folders that this session's operators have made so far, in order."""
    return list(_made.get(spark.sparkContext.applicationId, ()))


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes folders that this session's operators made, all unless told; tables that still read from them are then lost."""
    known = _made.get(spark.sparkContext.applicationId, [])
    for path in known[:] if paths is None else [p for p in paths if p in known]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        known.remove(path)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cuts the lineage: writes a table to the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_key(df: DataFrame) -> DataFrame:
    """(row, key): a table's rows as structs with a number each, written so that it's the same whenever it is read."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return cut(df.select(row.alias("row"), F.monotonically_increasing_id().alias("key")), "rows")


def rows_of(keyed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of with_key() as they were."""
    return keyed.select(*[F.col("row").getField(c).alias(c) for c in columns])


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer splits than there are cores, such as one small file, dealt to all of them.

    For tables as they are read: larger ones, which have splits enough, stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parts_of(df: DataFrame, rows: int, a_part: int) -> int:
    """Partitions for a table: some rows each, and not fewer than the session shuffles to."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // a_part))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """What Spark sends to Python in parts of some rows, without copies: results are made and returned part by part.

    Spark itself bounds what it sends at once, by rows and by bytes (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB).
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; bytes.split() and bytes.lower() know just ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def filesystem(uri: str):
    """pyarrow's file system for a URI or local path, and the path in it."""
    from pyarrow import fs

    if re.match(r"file:/+", uri):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


@contextmanager
def replacing(uri: str) -> Iterator:
    """An output stream whose file appears under its name only when it is whole; a repeated task replaces it with the same."""
    files, path = filesystem(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with files.open_output_stream(part) as out:
            yield out
        files.move(part, path)
    except BaseException:
        if files.get_file_info(part).size is not None:
            files.delete_file(part)
        raise
