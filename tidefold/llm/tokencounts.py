"""Token counts: a scan of flat token files for end-of-document ids, stitched across blocks by prefix scans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, filesystem, replacing, shared_dir, slices
from .tokens import encoder, vocabulary

#: Tokens a block holds. A block is a task's unit: files of any size are scanned in parallel.
BLOCK = 1 << 20


def write_flat_files(docs: DataFrame, end_id: int = 49407, tokenizer: str = "word_bpe_49k.json", width: int = 2, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Writes flat files of little-endian ids, each document closed by end_id, and nothing else; no index, no header.

    Returns the files (path, tokens) and the documents in them (path, nth, doc_id), both written as tables. Each input
    partition makes a file, in its own order; texts are not shuffled. Control strings in texts are ordinary text, so
    end_id marks ends only. A null text is empty; repeated rows are documents of their own; extra columns aren't read.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    end = end_id.to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path, nth, ids = f"{folder}/flat-{part:06d}.bin", 0, encoder(vocabulary(tokenizer), width, special=False)
        with replacing(path) as out:
            tokens = 0
            for batch in slices(batches):
                for t in batch.column(1):
                    data = ids.encode(t.as_py() or "") + end
                    out.write(data)
                    tokens += len(data) // width
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(nth, nth + n)), batch.column(0), pa.array([tokens] * n, pa.int64())], ["path", "nth", "doc_id", "upto"])
                nth += n

    kind = rows.schema["doc_id"].dataType.simpleString()
    written = rows.mapInArrow(run, f"path string, nth long, doc_id {kind}, upto long")
    written.write.parquet(f"{folder}/documents.parquet")
    listed = spark.read.schema(written.schema).parquet(f"{folder}/documents.parquet")
    return listed.groupBy("path").agg(F.max("upto").alias("tokens")), listed.drop("upto")


def count_tokens(files: DataFrame, end_id: int = 49407, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(path, nth, n_tokens) of each document in flat token files (path, tokens), the end id not counted.

    Files are read in blocks, in any order and on any executor. A block finds its end ids with one vectorised
    comparison and returns the lengths they part, the first from its own start. Running sums of ends number the
    documents; the running maximum of the last end's place tells what earlier blocks hold of a block's first document,
    however many blocks it crosses. Just these numbers of a file's blocks meet in a task; lengths stay with their block. Tokens behind a file's last end are no document. Empty files have no documents.
    """
    blocks = files.where("tokens > 0").select("path", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(block).cast("long"))).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for path, tokens, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                where, inside = filesystem(path)
                with where.open_input_file(inside) as f:
                    f.seek(at * width)
                    ids = np.frombuffer(f.read(min(block, tokens - at) * width), f"<u{width}")
                ends = np.flatnonzero(ids == end_id)
                lengths = np.diff(ends, prepend=-1) - 1
                last = at + int(ends[-1]) if len(ends) else None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([at]), pa.array([len(ends)], pa.int64()), pa.array([last], pa.int64()), pa.array([lengths.tolist()], pa.list_(pa.int64()))], ["path", "at", "ends", "last", "lengths"]
                )

    n = max(1, files.sparkSession.sparkContext.defaultParallelism * 4)
    scanned = cut(blocks.repartition(n, "path", "at").mapInArrow(run, "path string, at long, ends long, last long, lengths array<bigint>"), "blocks")
    earlier = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # a file's blocks meet without their lengths: some numbers for each
    before = scanned.select("path", "at", F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("first"), (F.col("at") - F.coalesce(F.max("last").over(earlier), F.lit(-1)) - 1).alias("open"))
    stitched = scanned.select("path", "at", "lengths").join(before.hint("merge"), ["path", "at"]).select("path", "first", "open", F.posexplode("lengths").alias("k", "length"))
    return stitched.select("path", (F.col("first") + F.col("k")).alias("nth"), (F.col("length") + F.when(F.col("k") == 0, F.col("open")).otherwise(0)).alias("n_tokens"))


def document_token_counts(docs: DataFrame, end_id: int = 49407, tokenizer: str = "word_bpe_49k.json", width: int = 2, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens) of every document, counted in flat files that are written for it."""
    files, listed = write_flat_files(docs, end_id, tokenizer, width)
    return listed.join(count_tokens(files, end_id, width, block).hint("merge"), ["path", "nth"]).select("doc_id", "n_tokens")
