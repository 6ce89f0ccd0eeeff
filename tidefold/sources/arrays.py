"""Arrays in .npy files as a data source: one file is read by many tasks, and only the rows and columns asked for.

`spark.read.format("npy").load(path)` after register(), or read_arrays(). A path holds .npy files of one array, which is the
column `values`, or a folder for each column whose files are named alike. Rows are those of the first axis; further
axes are flattened, and a column of one axis has plain numbers. `file` is a file's name and `row` counts from 0 in it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of files that a task reads, about; of a batch; and of a file that is written.
SPLIT, BATCH, FILE = 128 << 20, 4 << 20, 128 << 20
#: numpy's kinds and sizes, Spark's types, and what a batch of Arrow's holds.
KINDS = {
    "f2": (T.FloatType(), pa.float32()), "f4": (T.FloatType(), pa.float32()), "f8": (T.DoubleType(), pa.float64()), "b1": (T.BooleanType(), pa.bool_()),
    "i1": (T.ByteType(), pa.int8()), "i2": (T.ShortType(), pa.int16()), "i4": (T.IntegerType(), pa.int32()), "i8": (T.LongType(), pa.int64()),
    "u1": (T.ShortType(), pa.int16()), "u2": (T.IntegerType(), pa.int32()), "u4": (T.LongType(), pa.int64()),
}
_PATTERN = r"/[^/]*[*?\[][^/]*$"
_OF = {k.typeName(): a for k, a in KINDS.values()}


def _files(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system for a URI or a local path, and the path in it."""
    if re.match(r"file:/+", uri):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri).rstrip("/")
    return (fs.LocalFileSystem(), uri.rstrip("/")) if uri.startswith("/") else fs.FileSystem.from_uri(uri.rstrip("/"))


def _listed(files: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    """.npy files that a path is, holds, or names by a pattern, by name; hidden ones are left out."""
    if files.get_file_info(path).type == fs.FileType.File:
        return [files.get_file_info(path)]
    folder, _, pattern = path.rpartition("/") if re.search(r"[*?\[]", path) else (path, "", "*.npy")
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((f for f in found if f.type == fs.FileType.File and f.base_name.endswith(".npy") and f.base_name[0] not in "._" and fnmatch(f.base_name, pattern)), key=lambda f: f.base_name)


def _columns(files: fs.FileSystem, path: str) -> list[str]:
    """Columns of a path: its folders, or `values` if the files are right there."""
    if _listed(files, path):
        return ["values"]
    return sorted(f.base_name for f in files.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.type == fs.FileType.Directory and f.base_name[0] not in "._")


@dataclass
class Header:
    """Shape, type and place of a file's array."""

    shape: tuple[int, ...]
    kind: np.dtype
    start: int

    @property
    def width(self) -> int:
        return int(np.prod(self.shape[1:]))


def _header(source: pa.NativeFile, name: str) -> Header:
    version = np.lib.format.read_magic(source)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(source)
    if not shape or kind.str[1:] not in KINDS or (fortran and len(shape) > 1):
        raise ValueError(f"{name}: arrays have an axis of rows, numbers of {', '.join(KINDS)}, and rows one after the other; this one has shape {shape}, {kind}, fortran_order {fortran}")
    return Header(shape, kind, source.tell())


@dataclass
class Split(InputPartition):
    """A part of the rows of a file: the k-th of n."""

    name: str
    k: int
    n: int


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, split: int, first: int, end: int | None, chunk: int):
        self.path, self.schema, self.split, self.first, self.end, self.chunk = path, schema, split, first, end, chunk
        self.columns = [c for c in schema.names if c not in ("file", "row")]

    def _at(self, files: fs.FileSystem, path: str, column: str, name: str) -> str:
        if path.endswith(f"/{name}"):
            return path
        return f"{re.sub(_PATTERN, '', path)}/{name}" if _listed(files, path) else f"{path}/{column}/{name}"

    def _inside(self, rows: int, k: int, n: int) -> tuple[int, int]:
        first, end = rows * k // n // self.chunk * self.chunk, rows if k + 1 == n else rows * (k + 1) // n // self.chunk * self.chunk
        return max(first, self.first), end if self.end is None else min(end, self.end)

    def partitions(self) -> list[Split]:
        """Files in parts by their size. Only where rows are asked for are headers read here, to leave out parts without any."""
        files, path = _files(self.path)
        found = _columns(files, path)
        flat = bool(_listed(files, path))
        if missing := [c for c in self.columns if c not in found]:
            if found:
                raise ValueError(f"{self.path} has no column {missing[0]}, it has {', '.join(found)}")
            return []
        sizes: dict[str, int] = {}
        read = self.columns or found[:1]
        for c in read:
            for f in _listed(files, path if flat else f"{path}/{c}"):
                sizes[f.base_name] = sizes.get(f.base_name, 0) + f.size
        parts = [Split(name, k, n) for name, size in sizes.items() for n in (max(1, -(-size // self.split)),) for k in range(n)]
        if self.first or self.end is not None:
            with ThreadPoolExecutor(16) as pool:
                rows = dict(pool.map(lambda name: (name, self._rows(files, self._at(files, path, read[0], name))), sizes))
            parts = [p for p in parts for a, b in (self._inside(rows[p.name], p.k, p.n),) if a < b]
        return parts

    def _rows(self, files: fs.FileSystem, name: str) -> int:
        with files.open_input_file(name) as source:
            return _header(source, name).shape[0]

    def read(self, partition: Split | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark reads where there are no parts
            return
        files, path = _files(self.path)
        columns = self.columns or _columns(files, path)[:1]
        sources = [files.open_input_file(self._at(files, path, c, partition.name)) for c in columns]
        heads = [_header(s, f"{c}/{partition.name}") for s, c in zip(sources, columns, strict=True)]
        rows = heads[0].shape[0]
        for h, c in zip(heads, columns, strict=True):
            if h.shape[0] != rows:
                raise ValueError(f"{partition.name}: {columns[0]} has {rows} rows, {c} has {h.shape[0]}")
        at, end = self._inside(rows, partition.k, partition.n)
        step = max(1, BATCH // max(1, *(h.width * h.kind.itemsize for h in heads)) // self.chunk) * self.chunk
        for a in range(at, end, step):
            n = min(step, end - a)
            first = np.arange(a, a + n, self.chunk)
            found = {"file": pa.array([partition.name] * len(first)), "row": pa.array(first)}
            for s, h, c in zip(sources, heads, columns, strict=True):
                if c in self.columns:
                    found[c] = self._part(s, h, a, n, self.schema[c].dataType)
            yield pa.RecordBatch.from_arrays([found[c] for c in self.schema.names], self.schema.names)

    def _part(self, source: pa.NativeFile, head: Header, at: int, n: int, kind: T.DataType) -> pa.Array:
        size = head.width * head.kind.itemsize
        source.seek(head.start + at * size)
        data = source.read(n * size)
        if len(data) != n * size:
            raise ValueError(f"a file ends before row {at + n} of {head.shape[0]}")
        listed = isinstance(kind, T.ArrayType)
        if not listed and (len(head.shape) > 1 or self.chunk > 1):
            raise ValueError(f"{self.chunk} rows of shape {head.shape[1:]} aren't single numbers")
        x = np.frombuffer(data, head.kind).astype(np.float32 if head.kind.str[1:] == "f2" else head.kind.newbyteorder("="), copy=False)
        x = pa.array(x).cast(_OF[(kind.elementType if listed else kind).typeName()])
        ends = np.append(np.arange(0, n, self.chunk), n).astype(np.int32) * np.int32(head.width)
        return pa.ListArray.from_arrays(pa.array(ends), x) if listed else x


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class ArrayWriter(DataSourceArrowWriter):
    """Writes each column to a folder of its own, in files that appear when the whole table is written."""

    def __init__(self, path: str, schema: T.StructType, size: int, overwrite: bool, only_empty: bool):
        self.path, self.names, self.size = path, schema.names, size
        files, at = _files(path)
        there = [f.path for c in _columns(files, at) for f in _listed(files, f"{at}/{c}")]
        if there and only_empty:
            raise ValueError(f"{path} has arrays already")
        self.old = there if overwrite else []

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, path = _files(self.path)
        done: list[tuple[str, str]] = []
        held: list[pa.RecordBatch] = []
        stem = uuid.uuid4().hex

        def flush() -> None:
            for c in self.names if held else ():
                name = f"{path}/{c}/part-{stem}-{len(done) // len(self.names):05}.npy"
                parts = [_numbers(b.column(b.schema.names.index(c)), c) for b in held]
                if len({p.shape[1:] for p in parts}) > 1:
                    raise ValueError(f"rows of {c} have different lengths")
                files.create_dir(f"{path}/{c}", recursive=True)
                hidden = name.replace("/part-", "/.part-")
                with files.open_output_stream(hidden) as out:
                    np.save(_Sink(out), np.concatenate(parts), allow_pickle=False)
                done.append((hidden, name))
            held.clear()

        for batch in iterator:
            rows = max(1, self.size * batch.num_rows // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, rows):
                held.append(batch.slice(at, rows))
                if sum(b.nbytes for b in held) >= self.size:
                    flush()
        flush()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = _files(self.path)
        for m in messages:
            for hidden, name in m.names if m else ():
                files.move(hidden, name)
        for name in self.old:
            files.delete_file(name)

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = _files(self.path)
        for m in messages:
            for hidden, _ in m.names if m else ():
                files.delete_file(hidden)


class _Sink:
    """What np.save() needs of a file; an array's own tofile() wants a local one."""

    def __init__(self, out: pa.NativeFile):
        self.out = out

    def write(self, data: bytes) -> int:
        self.out.write(data)
        return len(data)


def _numbers(column: pa.Array, name: str) -> np.ndarray:
    if column.null_count:
        raise ValueError(f"{name} has nulls, which an array of numbers can't hold")
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    if (lengths != lengths[0]).any() or flat.null_count:
        raise ValueError(f"rows of {name} have different lengths, or nulls")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), int(lengths[0]))


class ArraySource(DataSource):
    """Options: path; splitBytes (of files to a task), firstRow and endRow (of each file), chunkRows (to a row); fileBytes (of a written file).

    Rows are chosen by options rather than by conditions that Spark hands on: Spark 4.1 keeps a Python source that took
    conditions with the table it belongs to, so that its next query would lack rows.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> T.StructType:
        files, path = _files(self.options["path"])
        out = T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])
        for c in _columns(files, path):
            found = _listed(files, path) or _listed(files, f"{path}/{c}")
            if found:
                with files.open_input_file(found[0].path) as source:
                    head = _header(source, found[0].path)
                one = KINDS[head.kind.str[1:]][0]
                out.add(c, one if len(head.shape) == 1 and c != "values" and int(self.options.get("chunkRows", 1)) == 1 else T.ArrayType(one))
        return out

    def reader(self, schema: T.StructType) -> ArrayReader:
        end = self.options.get("endRow")
        return ArrayReader(self.options["path"], schema, int(self.options.get("splitBytes", SPLIT)), int(self.options.get("firstRow", 0)), None if end is None else int(end), int(self.options.get("chunkRows", 1)))

    def writer(self, schema: T.StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options["path"], schema, int(self.options.get("fileBytes", FILE)), overwrite, self.options.get("onlyEmpty", "false") == "true")


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(ArraySource)


def read_arrays(spark: SparkSession, path: str, schema: str | T.StructType | None = None, rows: tuple[int, int] | None = None, chunk: int = 1, split: int = SPLIT) -> DataFrame:
    """file, row and the arrays' columns, or those of `schema` alone: the files of other columns aren't opened.

    rows: the first row of each file that is read, and the one to end before; parts of files without such rows get no task.
    chunk: so many rows of the array are joined to one, whose `row` is the first's: a recording saved as one long array
    comes as chunks of samples.
    """
    register(spark)
    read = spark.read.format("npy").option("splitBytes", split).option("chunkRows", chunk)
    if rows:
        read = read.option("firstRow", rows[0]).option("endRow", rows[1])
    return (read.schema(schema) if schema is not None else read).load(path)


def write_arrays(rows: DataFrame, path: str, mode: str = "error", size: int = FILE) -> None:
    """Columns of numbers, or of arrays of one length, as aligned .npy files; nulls are errors.

    A task writes the rows it has, in their order, in files of some size; mode is error, append or overwrite.
    """
    register(rows.sparkSession)
    rows.write.format("npy").option("fileBytes", size).mode("append" if mode == "error" else mode).option("onlyEmpty", mode == "error").save(path)
