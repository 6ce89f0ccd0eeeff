"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts_of, rows_of, with_key, word_count

#: Documents, or copies of them, of a range of a sort, about.
ROWS_A_RANGE = 1 << 20


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> those and target: a share of all sizes by weight, at most `most` times a source's size.

    Sources sort by code point, null last, and take the weights in turn. What a capped source can't hold goes to the
    others by weight until none is above. With r = cap / weight, sources fill up in the order of r. The level of the
    others once the first k are full is (budget - their caps) / (weights left); the first k whose next r is not below
    that level holds. One row per source: this table is small whatever the number of documents.
    """
    everything = Window.partitionBy()
    by_r = Window.orderBy("_r", "_rank")
    full = F.coalesce(F.sum("_cap").over(by_r.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_weight").over(by_r.rowsBetween(0, Window.unboundedFollowing))
    turn = (F.col("_rank") - 1) % len(weights) + 1
    return (
        sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
        .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_r", F.col("_cap") / F.col("_weight"))
        .withColumn("_budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_level", (F.col("_budget") - full) / left)
        .withColumn("_held", F.min(F.when(F.col("_level") <= F.col("_r"), F.struct("_r", "_rank", "_level"))).over(everything)["_level"])
        .select("source", "source_size", F.when(F.col("_held") <= F.col("_r"), F.col("_held") * F.col("_weight")).otherwise(F.col("_cap")).alias("target"))
    )


def _range_sorted(df: DataFrame, rows: int, name: str, *by: str) -> DataFrame:
    """The table sorted over all its partitions and written so, with the number of a row's partition as _range.

    Where equal keys can hold many rows, a row's number ends `by`: so no value of the others fills a range.
    """
    ordered = df.repartitionByRange(parts_of(df, rows, ROWS_A_RANGE), *by).withColumn("_range", F.spark_partition_id())
    return cut(ordered.sortWithinPartitions(*by), name)


def _served(docs: DataFrame, weights: tuple[int, ...], share: float, passes: int, doc_id: str, text: str, source: str, key: Column) -> tuple[DataFrame, DataFrame, dict]:
    """Documents with the finish times of their copies; the copies in order of the mix; and where the mix ends."""
    order = ("_h", "doc_id", "size", "_text", "key")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("_text"), key.alias("key"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("_h"), F.col(source).isNull().alias("_none"), F.coalesce(source, F.lit("")).alias("_source"),
    )
    rows = cut(rows, "sizes")  # the texts are read once; what follows needs some 80 bytes a document
    n = rows.count()
    rows = _range_sorted(rows, n, "shuffled", "_none", "_source", *order)
    by_range = cut(rows.groupBy("_none", "_source", "_range").agg(F.sum("size").alias("_words")), "ranges")
    earlier = Window.partitionBy("_none", "_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = by_range.groupBy("_none", "_source").agg(F.sum("_words").alias("source_size"))
    plan = targets(sizes.withColumn("source", F.when(~F.col("_none"), F.col("_source"))), weights, share, float(passes))
    plan = cut(plan.select(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "target"), "targets")
    starts = by_range.withColumn("_before", F.coalesce(F.sum("_words").over(earlier), F.lit(0))).drop("_words").join(plan, ["_none", "_source"])

    place = Window.partitionBy("_none", "_source", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_cum", F.sum("size").over(place)).join(starts, ["_none", "_source", "_range"])

    def finish(k: int) -> Column:
        done = F.lit(k) * F.col("source_size") + F.col("_before") + F.col("_cum")
        return F.when(F.col("target") > 0, done / F.col("target")).otherwise(F.lit(0.0))

    placed = cut(placed.select("doc_id", "source", "size", "source_size", "target", "_none", "_source", "key", F.array(*[finish(k) for k in range(passes)]).alias("_finish")), "placed")
    copies = placed.select(F.explode("_finish").alias("_at"), "_none", "_source", "size", "key")
    copies = _range_sorted(copies, n * passes, "mix", "_at", "_none", "_source", "key")
    return placed, copies, _last_copy(copies, plan, min(share, float(passes)))


def _last_copy(copies: DataFrame, plan: DataFrame, share: float) -> dict:
    """Where the mix ends: finish time and source of the copy that the budget ends in, and its words that are left.

    Ranges are added up, and rows of the one in which the budget ends. A single row comes to the driver. Copies with
    words have distinct (finish, source); others don't matter.
    """
    budget = plan.agg(F.floor(F.sum("source_size") * F.lit(share)).alias("b")).first()["b"] or 0
    ranges = copies.groupBy("_range").agg(F.sum("size").alias("_words"))
    ranges = ranges.withColumn("_upto", F.sum("_words").over(Window.orderBy("_range")))
    here = ranges.where(F.col("_upto") >= budget).orderBy("_range").first()
    if here is None or budget == 0:
        return {"at": float("inf") if budget else -1.0, "none": False, "source": "", "left": 0}
    order = Window.orderBy("_at", "_none", "_source").rowsBetween(Window.unboundedPreceding, 0)
    inside = copies.where((F.col("_range") == here["_range"]) & (F.col("size") > 0))
    row = inside.withColumn("_upto", F.sum("size").over(order) + (here["_upto"] - here["_words"])).where(F.col("_upto") >= budget).orderBy("_at", "_none", "_source").first()
    return {"at": row["_at"], "none": row["_none"], "source": row["_source"], "left": row["size"] - (row["_upto"] - budget)}


def _taken(at: Column, last: dict) -> Column:
    """Words that the mix takes of the copy that finishes at a time."""
    here = F.struct(at.alias("at"), F.col("_none"), F.col("_source"))
    there = F.struct(F.lit(last["at"]).alias("at"), F.lit(last["none"]).alias("_none"), F.lit(last["source"]).alias("_source"))
    return F.when(here < there, F.col("size")).when(here == there, F.least(F.col("size"), F.lit(last["left"]))).otherwise(F.lit(0))


def _drawn(at: Column, last: dict) -> Column:
    return (at < last["at"]) | ((at == last["at"]) & (_taken(at, last) > 0))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, passes: int = 2, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, draws.

    Documents of a source are shuffled by the md5 of their id (then id, size, a hash of the text); each further pass
    repeats that order. A copy's virtual finish time is the source's words up to it over the source's target. All copies
    are range-sorted by it, then by source, and the mix is cut where it holds its budget, the targets' sum in whole
    words: the copy there gives what is left. taken counts the words taken, repeats included; draws the copies, the cut
    one included. Documents without words take 0 words; they're drawn with the copies at the same time. Repeated rows
    are documents of their own. A null text has size 0; a null source is a source, a null id sorts first. No row gives
    no rows. Extra columns are not read. The same rows give the same mix, however they are partitioned.
    """
    placed, _, last = _served(docs, weights, share, passes, doc_id, text, source, F.monotonically_increasing_id())
    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        F.aggregate(F.transform("_finish", lambda at: _taken(at, last)), F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"),
        F.size(F.filter("_finish", lambda at: _drawn(at, last))).alias("draws"),
    )


def draw(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, passes: int = 2, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself, in its order: each row as many times as mix_sources() draws it, whole, all columns unchanged.

    Rows are told apart by numbers of their own, whatever their ids. Partitions follow each other by finish time, and
    rows in them, so sources are interleaved all along.
    """
    keyed = with_key(docs)
    named = keyed.select(F.col("row").getField(doc_id).alias("doc_id"), F.col("row").getField(text).alias("text"), F.col("row").getField(source).alias("source"), "key")
    _, copies, last = _served(named, weights, share, passes, "doc_id", "text", "source", F.col("key"))
    by = ("_at", "_none", "_source", "key")
    drawn = copies.where(_drawn(F.col("_at"), last)).select(*by)
    mixed = keyed.join(drawn, "key").repartitionByRange(*by).sortWithinPartitions(*by)
    return rows_of(mixed, docs.columns)
