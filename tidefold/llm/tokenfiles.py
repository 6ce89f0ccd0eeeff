"""Token-id files: documents compressed one by one with a shared zstandard dictionary, and an offset index."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, parts_of, replacing, shared_dir, slices
from .tokens import encoder, vocabulary

#: A file is one zstandard frame per document, in order; then the index: the frames' offsets (n + 1), ids (n, signed),
#: token counts (n), all 8 bytes, and a byte for each id, 0 if it is null; then this trailer. All is little-endian.
MAGIC = b"TIDEZID1"
TRAILER = struct.Struct("<QQB32s8s")  # offset of the index, documents, bytes an id, SHA-256 of the dictionary, MAGIC
DICTIONARY = "dictionary.zstd"
DICTIONARY_BYTES = 64 << 10
#: The dictionary is trained on about so many documents, chosen by a hash of their id, and this much of each at most.
SAMPLE_DOCUMENTS, SAMPLE_BYTES = 400, 32 << 10
#: Documents a file holds, about.
FILE_DOCUMENTS = 20_000
LEVEL = 1


def train_dictionary(docs: DataFrame, encode: Callable[[str], bytes]) -> bytes:
    """A zstandard dictionary of serialized id arrays; empty where there is too little to train on.

    A compression aid, not a result: it may be fitted on a bounded sample, which comes to the driver (some 12 MB).
    """
    every = max(1, docs.count() // SAMPLE_DOCUMENTS)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).limit(4 * SAMPLE_DOCUMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([encode(t.as_py() or "")[:SAMPLE_BYTES] for t in batch.column(1)], pa.binary())], ["ids"])

    samples = sorted(bytes(r[0]) for r in some.mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too small
        return b""


def write_documents(out, documents: Iterator[tuple[int | None, bytes]], dictionary: bytes, width: int) -> tuple[int, int]:
    """Writes a file of (id, serialized token ids); returns documents and tokens written."""
    zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
    offsets, ids, counts, known = [0], [], [], bytearray()
    for doc_id, data in documents:
        frame = zstd.compress(data)
        out.write(frame)
        offsets.append(offsets[-1] + len(frame))
        ids.append(doc_id or 0)
        known.append(doc_id is not None)
        counts.append(len(data) // width)
    for values in (offsets, ids, counts):
        out.write(np.array(values, "<i8").tobytes())
    out.write(bytes(known))
    out.write(TRAILER.pack(offsets[-1], len(ids), width, hashlib.sha256(dictionary).digest(), MAGIC))
    return len(ids), sum(counts)


class TokenFile:
    """Reads a token file by its index; documents are read one by one, or any one alone."""

    def __init__(self, path: str, dictionary: bytes) -> None:
        files, inside = filesystem(path)
        self.file = files.open_input_file(inside)
        self.file.seek(self.file.size() - TRAILER.size)
        at, self.n, self.width, digest, magic = TRAILER.unpack(self.file.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        self.file.seek(at)
        self.offsets = np.frombuffer(self.file.read(8 * (self.n + 1)), "<i8")
        self.ids = np.frombuffer(self.file.read(8 * self.n), "<i8")
        self.counts = np.frombuffer(self.file.read(8 * self.n), "<i8")
        self.known = np.frombuffer(self.file.read(self.n), np.uint8)
        self.zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return self.n

    def _ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.zstd.decompress(frame), f"<u{self.width}")

    def document(self, k: int) -> np.ndarray:
        """Token ids of the k-th document alone: one short read."""
        self.file.seek(int(self.offsets[k]))
        return self._ids(self.file.read(int(self.offsets[k + 1] - self.offsets[k])))

    def __iter__(self) -> Iterator[np.ndarray]:
        step = 256
        for k in range(0, self.n, step):
            at = self.offsets[k : k + step + 1]
            self.file.seek(int(at[0]))
            data = memoryview(self.file.read(int(at[-1] - at[0])))
            for a, b in zip(at[:-1] - at[0], at[1:] - at[0], strict=True):
                yield self._ids(data[a:b])


def write_token_files(docs: DataFrame, folder: str | None = None, end_id: int = 2, tokenizer: str = "word_bpe_49k.json", width: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes documents in ascending id order; returns the list of files: path, part, n_documents, n_tokens, dictionary.

    Documents are dealt to files by ranges of their id (null first), then text, and sorted so; equal ids follow each
    other, repeated rows are documents of their own. Null text is empty: its document holds the end id alone. An empty
    table gives no files. Extra columns are not read. A file appears when it is whole, and a task that is run again
    writes the same one. The ids must be integers. width is the bytes of an id in the file (2 or 4).
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    end = end_id.to_bytes(width, "little")
    encode = lambda t: encoder(vocabulary(tokenizer), width).encode(t) + end
    dictionary = train_dictionary(rows, encode)
    with replacing(f"{folder}/{DICTIONARY}") as out:
        out.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def documents() -> Iterator[tuple[int | None, bytes]]:
            for batch in slices(batches):
                for k, t in zip(batch.column(0), batch.column(1), strict=True):
                    yield k.as_py(), encode(t.as_py() or "")

        rest = documents()
        if (first := next(rest, None)) is None:
            return
        part = TaskContext.get().partitionId()
        path = f"{folder}/ids-{part:06d}.bin"
        with replacing(path) as out:
            n, tokens = write_documents(out, (x for some in ([first], rest) for x in some), shared.value, width)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([tokens], pa.int64())], ["path", "part", "n_documents", "n_tokens"])

    by = F.col("doc_id").asc_nulls_first()  # an id of many rows, or none, is parted by how its texts begin
    dealt = rows.repartitionByRange(parts_of(rows, rows.count(), FILE_DOCUMENTS), by, F.left("text", F.lit(64)).asc_nulls_first()).sortWithinPartitions(by, F.col("text").asc_nulls_first())
    files = dealt.mapInArrow(run, "path string, part int, n_documents long, n_tokens long")
    files = files.withColumn("dictionary", F.lit(f"{folder}/{DICTIONARY}"))
    files.write.parquet(f"{folder}/files.parquet")  # written once; what follows reads this list
    return spark.read.schema(files.schema).parquet(f"{folder}/files.parquet")


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document of token files: doc_id, start, n_tokens, ids_crc32 (of 4-byte ids); files in order of part.

    A null id stays null; a document of an empty text has the end id alone; no files give no rows.
    """
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    dealt = files.withColumn("base", F.coalesce(before, F.lit(0))).select("path", "dictionary", "base")
    dealt = dealt.repartition(max(1, files.count()), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for path, dictionary, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                where, inside = filesystem(dictionary)
                with where.open_input_stream(inside) as f:
                    file = TokenFile(path, f.read())
                start = base + np.concatenate(([0], np.cumsum(file.counts)))[:-1]
                crc, n = [], []
                for ids in file:
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    n.append(len(ids))
                doc_ids = pa.array(file.ids, pa.int64(), mask=file.known == 0)
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, end_id: int = 2, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """What read_token_files() finds in the files that write_token_files() makes of the documents; their rules hold."""
    return read_token_files(write_token_files(docs, end_id=end_id, tokenizer=tokenizer))


def read_document(spark: SparkSession, path: str, k: int) -> np.ndarray:
    """Token ids of one document of a file, without reading the others."""
    folder = path.rpartition("/")[0]
    where, inside = filesystem(f"{folder}/{DICTIONARY}")
    with where.open_input_stream(inside) as f:
        return TokenFile(path, f.read()).document(k)
