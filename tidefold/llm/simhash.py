"""SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts_of, rows_of, slices, with_key, words_of
from .components import connected_components

SHINGLE, SEED = 3, 42
#: Differing bits up to which fingerprints link.
THRESHOLD = 2
#: The anchors: pairs of words of the binary Golay code [23, 12] over bits 0-22 and 23-45 of a fingerprint. The code is
#: perfect with radius 3, so each fingerprint has one nearest anchor, at a distance of 6 or less. As fingerprints get
#: more than 2^24, so does the code: it takes in all words of one more bit, then another (16 at most, radius 0), so that an anchor is
#: nearest to one fingerprint on average.
LENGTH, GENERATOR, RADIUS, FREE = 23, 0b101011100011, 3, 16
REACH = 2 * RADIUS + THRESHOLD
#: Fingerprints that a task sends to their anchors: some 8 million rows, most of which go no further.
DEALT = 100_000
#: Where more fingerprints than this are nearest to an anchor all the same, they lie close together: what reaches such
#: an anchor is compared by midpoints, not pair by pair.
CROWD = 4
#: Bits of the map of anchors that are nearest to something, 2 MB whatever the data.
MAP_BITS = 24


def fingerprint(text: str | None) -> int:
    """64-bit SimHash, signed: XXH64 of the 3-word shingles, repeats included; a bit is 1 if set in over half of them."""
    words = words_of(text)
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(g, SEED) for g in grams]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: str | None = None) -> DataFrame:
    """(doc_id, fp long) of every row, and key (long) if it's named; whole texts, null like one without words."""
    more = [F.col(key).alias("key")] if key else []
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps, *batch.columns[2:]], ["doc_id", "fp", *(["key"] if key else [])])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long{', key long' if key else ''}")


@cache
def _cosets() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of single bits; patterns of up to REACH bits by (syndrome, weight); starts[syndrome, weight] in them."""
    degree = GENERATOR.bit_length() - 1

    def remainder(v: int) -> int:
        while v.bit_length() > degree:
            v ^= GENERATOR << (v.bit_length() - 1 - degree)
        return v

    single = np.array([remainder(1 << i) for i in range(LENGTH)], np.int64)
    words = np.arange(1 << LENGTH, dtype=np.int64)
    words = words[np.bitwise_count(words) <= REACH]
    weight = np.bitwise_count(words).astype(np.int64)
    keys = _syndromes(words, single) * (REACH + 2) + weight
    order = np.argsort(keys, kind="stable")
    starts = np.searchsorted(keys[order], np.arange((1 << degree) * (REACH + 2))).reshape(1 << degree, REACH + 2)
    return single, words[order], starts


def _syndromes(words: np.ndarray, single: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    for i in range(LENGTH):
        out ^= np.where(words >> i & 1, single[i], 0)
    return out


def _halves(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    single, _, _ = _cosets()
    left, right = fps & ((1 << LENGTH) - 1), fps >> LENGTH & ((1 << LENGTH) - 1)
    return left, right, _syndromes(left, single), _syndromes(right, single)


def nearest_anchor(fps: np.ndarray, more: int = 0) -> np.ndarray:
    """The one anchor within the covering radius of each fingerprint; `more` bits beyond the two blocks are its own."""
    _, patterns, starts = _cosets()
    left, right, s, t = _halves(fps)
    return (fps >> 2 * LENGTH & ((1 << more) - 1)) << 2 * LENGTH | (left ^ patterns[starts[s, 0]]) << LENGTH | (right ^ patterns[starts[t, 0]])


def anchors_in_reach(fps: np.ndarray, more: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Row and anchor for every anchor within REACH of each fingerprint: about 78 each, 16 more for a bit, 3 for two."""
    _, patterns, starts = _cosets()
    bits = [1 << 2 * LENGTH + i for i in range(more)]
    flips = [np.zeros(1, np.int64), np.array(bits, np.int64), np.array([a | b for a, b in combinations(bits, 2)], np.int64)]
    own = (fps >> 2 * LENGTH & ((1 << more) - 1)) << 2 * LENGTH
    rows, found = [], [np.zeros(0, np.int64)]
    for u, p, q, s, t in zip(own, *_halves(fps), strict=True):
        n = 0
        for w in range(REACH + 1):
            one = patterns[starts[s, w] : starts[s, w + 1]]
            if not len(one):
                continue
            for flipped, flip in enumerate(flips[: min(THRESHOLD, REACH - w) + 1]):
                two = patterns[starts[t, 0] : starts[t, REACH - w - flipped + 1]]
                if len(two) and len(flip):
                    found.append(((((p ^ one) << LENGTH)[:, None] | (q ^ two)).ravel()[:, None] | (u ^ flip)).ravel())
                    n += len(found[-1])
        rows.append(n)
    return np.repeat(np.arange(len(fps)), rows), np.concatenate(found)


def _slot(anchors: np.ndarray) -> np.ndarray:
    """Place of an anchor in a map of MAP_BITS."""
    return (anchors.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _nearest(fps: DataFrame, more: int) -> DataFrame:
    """(anchor, fp, slot) of the nearest anchor of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors = nearest_anchor(batch.column(0).to_numpy(), more)
            yield pa.RecordBatch.from_arrays([pa.array(anchors), batch.column(0), pa.array(_slot(anchors))], ["anchor", "fp", "slot"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long, slot long")


def _reaching(fps: DataFrame, more: int, taken: DataFrame) -> DataFrame:
    """(anchor, fp) for all anchors in reach of each fingerprint that may be nearest to something, by the map of `taken` slots."""
    spark = fps.sparkSession
    taken = taken.groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("m"))
    whole = np.zeros((1 << MAP_BITS) + (1 << 15), np.uint8)
    for r in taken.collect():  # 2^MAP_BITS bits in all
        bits = np.unpackbits(np.frombuffer(bytes(r["m"]), np.uint8), bitorder="little")
        whole[(r["b"] - 1) * len(bits) : r["b"] * len(bits)] = bits
    shared = spark.sparkContext.broadcast(np.packbits(whole[: 1 << MAP_BITS]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.unpackbits(shared.value).astype(bool)
        for batch in slices(batches):
            values = batch.column(0).to_numpy()
            rows, anchors = anchors_in_reach(values, more)
            some = there[_slot(anchors)]
            yield pa.RecordBatch.from_arrays([pa.array(anchors[some]), pa.array(values[rows[some]])], ["anchor", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long")


def links(fps: DataFrame, more: int | None = None) -> DataFrame:
    """(a, b) edges between distinct fingerprints, all of THRESHOLD bits or fewer, that join whatever such pairs join.

    If f and g differ in THRESHOLD bits at most, f's nearest anchor lies within REACH of g: so every fingerprint is
    sent to all anchors in reach (those that are nearest to nothing are left out before anything is shuffled), and
    compared there with those whose nearest it is. `more`, the bits by which the code grows, follows from how many
    fingerprints there are, so anchors don't fill up with the data. Where over CROWD near copies share an anchor, pairs
    would grow with the square of their number. What reaches such an anchor is joined by midpoints: two words differ in
    2 bits or fewer just if some word differs in at most 1 bit from either, so each is sent to the 65 words around it
    and linked with the smallest that arrives there. That is exact, and linear in the crowd.
    """
    n = fps.count()
    if more is None:
        more = min(FREE, max(0, (max(1, n) - 1).bit_length() - 24))
    near = cut(_nearest(fps, more), "nearest")
    some = Window.partitionBy("anchor").orderBy("fp")
    nearest = near.withColumn("n", F.row_number().over(some)).where(F.col("n") <= CROWD + 1)
    nearest = nearest.groupBy("anchor").agg(F.collect_list("fp").alias("centres"))  # CROWD + 1 at most
    reaching = _reaching(fps.select("fp").repartition(parts_of(fps, n, DEALT), "fp"), more, near)
    met = cut(reaching.join(nearest.hint("merge"), "anchor").select("fp", "centres"), "met")
    pairs = met.where(F.size("centres") <= CROWD).select(F.col("fp").alias("a"), F.explode("centres").alias("b"))
    pairs = pairs.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD))
    crowd = met.where(F.size("centres") > CROWD).select("fp").distinct()
    around = F.array("fp", *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -1 << 63)) for i in range(64)])
    spread = crowd.select("fp", F.explode(around).alias("mid"))
    first = spread.groupBy("mid").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("mid", "b")
    return pairs.unionByName(spread.join(first.hint("merge"), "mid").where("fp <> b").select(F.col("fp").alias("a"), "b"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (long), component_id, the smallest doc_id reachable over links, itself included.

    Fingerprints are linked once whatever the number of documents that share them; texts without words (null, empty,
    white space) have fingerprint 0 and are linked like any other. Repeated rows stay, with the same component. A null
    id counts only where a component has no other. An empty table gives no rows. Extra columns are not read.
    """
    return _classes(cut(fingerprints(docs, doc_id, text), "fingerprints")).select("doc_id", "fp", "component_id")


def _classes(own: DataFrame) -> DataFrame:
    """The rows of fingerprints() with component_id, and root (long), the component's smallest fingerprint.

    component_id is null where no row of a component has an id; root always tells components apart.
    """
    each = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = connected_components(links(each))
    joined = each.join(found.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = joined.select("fp", "root").join(least.hint("merge"), "root").select("fp", "component_id", "root")
    return own.join(classes.hint("merge"), "fp").select("doc_id", "fp", "component_id", *[c for c in ("key",) if c in own.columns], "root")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of near-duplicates, the one with the smallest id, then text; all columns unchanged.

    Classes are of rows: rows of one id whose texts aren't alike each stay, rows without an id are kept only where their
    class has no other. Of rows that repeat id and text any one stays.
    """
    keyed = with_key(docs)
    rows = keyed.select(F.col("row").getField(doc_id).alias("doc_id"), F.col("row").getField(text).alias("text"), "key")
    found = cut(_classes(cut(fingerprints(rows, key="key"), "fingerprints")).select("root", "doc_id", "key"), "classes")
    least = found.groupBy("root", "doc_id").agg(F.min("key").alias("key"), F.count("*").alias("n"))
    first = cut(least.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "n")).alias("l")).select("root", "l.doc_id", "l.key", "l.n"), "least")
    kept = first.where("n = 1").select("key")
    repeated = first.where("n > 1").select("root", F.col("doc_id").alias("_id"))
    if repeated.head(1):  # texts are read just where ids don't decide
        same = found.join(repeated, (found["root"] == repeated["root"]) & found["doc_id"].eqNullSafe(repeated["_id"])).select(found["root"], "key")
        texts = same.join(rows.select("key", F.col("text").alias("t")), "key")
        kept = kept.unionByName(texts.groupBy("root").agg(F.min(F.struct("t", "key"))["key"].alias("key")).select("key"))
    return rows_of(keyed.join(kept, "key", "left_semi"), docs.columns)
