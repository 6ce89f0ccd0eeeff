"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned for in windows of document words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, slices

WINDOW = 10
#: Benchmark words that one hash set may hold, some 200 MB in a worker; more items are scanned for in further blocks.
MOST_WORDS = 1_000_000
#: Digests of texts with hits that are broadcast at most, some 50 MB; more are joined by a shuffle.
MOST_HITS = 500_000
#: Bytes of words stay, A-Z are lowered, all else parts words: 0-9, a-z and all of characters beyond ASCII.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD_IN_TEXT = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_P = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class NgramSet:
    """Windows of benchmark items by length; words by number."""

    def __init__(self, items: list[tuple], window: int = WINDOW) -> None:
        self.number: dict[bytes, int] = {}
        self.items: dict[int, dict[tuple, list]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number)) for w in words(text)]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                self.items.setdefault(n, {}).setdefault(tuple(ids[i : i + n]), []).append(item)
        self.powers = np.array([pow(int(_P), k, 1 << 64) for k in range(window)], np.uint64)
        self.maps: dict[int, np.ndarray] = {}
        for n, found in self.items.items():
            self.maps[n] = np.zeros(1 << _BITS, bool)
            self.maps[n][self._slot(np.array(list(found), np.int64))] = True

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        """Place of each gram (a row of word numbers) in a map of bits."""
        with np.errstate(over="ignore"):
            h = ((grams.astype(np.uint64) + np.uint64(1)) * self.powers[: grams.shape[1]]).sum(axis=1, dtype=np.uint64) * _P
        return (h >> np.uint64(64 - _BITS)).astype(np.int64)

    def scan(self, tokens: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words lie in an occurrence of a window, and the items whose windows occur."""
        a = np.fromiter(map(self.number.get, tokens, repeat(-1)), np.int64, len(tokens))
        hit, found = np.zeros(len(a), bool), set()
        outside = np.concatenate(([0], np.cumsum(a < 0)))
        for n, grams in self.items.items():
            starts = np.flatnonzero(outside[n:] == outside[:-n]) if len(a) >= n else ()
            for i in range(0, len(starts), 1 << 16):
                some = starts[i : i + (1 << 16)]
                windows = a[some[:, None] + np.arange(n)]
                likely = self.maps[n][self._slot(windows)]
                for s, gram in zip(some[likely].tolist(), windows[likely].tolist(), strict=True):
                    if (items := grams.get(tuple(gram))) is not None:  # the map can err, the words themselves decide
                        hit[s : s + n] = True
                        found.update(items)
        return hit, found


#: Sets of windows that this worker has built, by the block they are of: a worker runs many tasks.
_BUILT: list[tuple[list, int, NgramSet]] = []


def ngrams_of(block: list[tuple], window: int) -> NgramSet:
    for known, n, found in _BUILT:
        if known is block and n == window:
            return found
    _BUILT[:] = [*_BUILT[-3:], (block, window, NgramSet(block, window))]
    return _BUILT[-1][2]


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without some runs of its words; each leaves one space."""
    places = [m.span() for m in _WORD_IN_TEXT.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    if not spans:
        return text
    return " ".join([out[0].rstrip(), *(x.strip() for x in out[1:]), text[at:].lstrip()])


def _blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple]]:
    """The benchmark in blocks of at most `most` words each (or one item), read one at a time; one empty block at least."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        n = len(words(row["t"]))
        if size + n > most and block:
            yield block
            block, size = [], 0
        block.append((row["i"], row["t"]))
        size += n
    yield block


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, item_ids (array, ascending, null last), spans array<struct<first, last>> of words.

    A window is `window` consecutive words of an item, or all words of a shorter one; spans join the document words
    inside occurrences, last excluded. Null texts, empty texts and items without words have no words. Repeated rows give
    repeated rows. An empty benchmark gives no hits, an empty table no rows. Extra columns are not read. Windows are
    broadcast while the benchmark has most_words words or fewer; else documents are scanned once per block of items of
    that size, and only rows with hits are joined up.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    of_item = benchmark.schema[item_id].dataType.simpleString()
    item_type = pa.list_(to_arrow_type(benchmark.schema[item_id].dataType))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {kind}, n_words long, n_hit long, item_ids array<{of_item}>, spans array<struct<first:int,last:int>>"
    spans_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    # 128 bits of id and text: equal just for equal rows
    same = F.md5(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))))

    def scanned(block: list[tuple], keep: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ngrams = ngrams_of(shared.value, window)
            for batch in slices(batches):
                counts, hits, items, spans = [], [], [], []
                for t in batch.column(1):
                    tokens = words(t.as_py())
                    hit, found = ngrams.scan(tokens)
                    counts.append(len(tokens))
                    hits.append(int(hit.sum()))
                    items.append(sorted(found, key=lambda i: (i is None, i)))
                    spans.append([{"first": a, "last": b} for a, b in runs(hit)])
                out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, item_type), pa.array(spans, spans_type)]
                names = ["doc_id", "n_words", "n_hit", "item_ids", "spans"]
                if keep:
                    out, names = [*out, batch.column(2)], [*names, "row"]
                yield pa.RecordBatch.from_arrays(out, names)

        return (rows.withColumn("row", same) if keep else rows).mapInArrow(run, schema + (", row string" if keep else ""))

    blocks = _blocks(benchmark, item_id, item_text, most_words)
    block, after = next(blocks), next(blocks, None)  # the driver holds these two at most
    if after is None:
        return scanned(block, keep=False)
    # equal rows have equal hits in a block, so one of each (by `row`) is joined; positions are joined as spans, not word by word
    parts = []
    while block is not None:
        parts.append(cut(scanned(block, keep=True), "hits").withColumn("block", F.lit(len(parts))))
        block, after = after, next(blocks, None)
    some = parts[0].where("n_hit > 0")
    for p in parts[1:]:
        some = some.unionByName(p.where("n_hit > 0"))
    some = some.dropDuplicates(["row", "block"]).groupBy("row").agg(F.flatten(F.collect_list("item_ids")).alias("i"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"))
    # a span is appended if it starts behind the last, else the last grows
    joined = F.expr(
        """aggregate(s, cast(array() as array<struct<first:int,last:int>>), (a, x) -> if(size(a) > 0 and x.first <= element_at(a, -1).last,
             concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'last', greatest(x.last, element_at(a, -1).last)))),
             concat(a, array(x))))"""
    )
    some = some.select("row", F.array_sort(F.array_distinct("i")).alias("i"), joined.alias("s"))
    out = parts[0].select("doc_id", "n_words", "row").join(some, "row", "left")
    spans = F.coalesce("s", F.expr("cast(array() as array<struct<first:int,last:int>>)"))
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.coalesce("i", F.expr(f"cast(array() as array<{of_item}>)")).alias("item_ids"), spans.alias("spans"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """The documents without those that hold a benchmark window, or (remove="spans") without the words inside windows.

    All columns stay as they are, whatever their names; with spans, texts with hits are changed, others never. Texts
    that are null or without words stay. Rules and bounds are those of scan(), and so are the windows that are found,
    however the benchmark is cut into blocks: with several, each is scanned for in a pass of its own, and rows are joined
    with the texts that have hits, by a digest of the text.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove!r}")
    spark, at = docs.sparkSession, docs.columns.index(text)
    blocks = _blocks(benchmark, item_id, item_text, most_words)
    block = next(blocks)
    if next(blocks, None) is None:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ngrams = ngrams_of(shared.value, window)
            for batch in slices(batches):
                found = [runs(ngrams.scan(words(t.as_py()))[0]) for t in batch.column(at)]
                yield batch.filter(pa.array([not s for s in found])) if remove == "documents" else _cleaned(batch, at, found)

        return docs.mapInArrow(run, docs.schema)
    digest = F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    scanned = scan(docs.select(digest.alias("of"), F.col(f"`{text}`").alias("text")), benchmark, window, "of", "text", item_id, item_text, most_words)
    hits = cut(scanned.where("n_hit > 0").select(F.col("doc_id").alias("of"), "spans").dropDuplicates(["of"]), "texts")
    hits = F.broadcast(hits) if remove == "documents" and hits.count() <= MOST_HITS else hits
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest.alias("of"))
    if remove == "documents":
        return rows.join(hits.select("of"), "of", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    wide = rows.join(hits, "of", "left").select("spans", "row")

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [[(s["first"], s["last"]) for s in x.as_py() or ()] for x in batch.column(0)]
            yield _cleaned(pa.RecordBatch.from_struct_array(batch.column(1)), at, found)

    return wide.mapInArrow(cleaned, docs.schema)


def _cleaned(batch: pa.RecordBatch, at: int, found: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    """A batch whose texts lack some runs of words."""
    texts = batch.column(at).to_pylist()
    new = pa.array([without(t, s) if s else t for t, s in zip(texts, found, strict=True)], batch.schema.field(at).type)
    return pa.RecordBatch.from_arrays([new if k == at else batch.column(k) for k in range(batch.num_columns)], batch.schema.names)
