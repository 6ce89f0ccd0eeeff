"""Nested subsets: maps from places in a subset to places in what it was taken from, composed down to the base."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import refuse
from ..sources.writers import stored
from .features import lookup_all


def _normal(maps: DataFrame, keys: list[str], level: str, position: str, target: str) -> tuple[DataFrame, int]:
    """(keys, _l, _p, _t, _last) with levels from 0 and targets that count from the end told by their place, and the greatest depth."""
    rows = maps.select(*keys, (F.col(level) - 1).cast("long").alias("_l"), F.col(position).cast("long").alias("_p"), F.col(target).cast("long").alias("_t"))
    levels = Window.partitionBy(*keys).orderBy("_l")
    sizes = stored(rows.groupBy(*keys, "_l").agg(F.count("*").alias("_n")).withColumn("_next", F.lead("_l").over(levels)).withColumn("_size", F.lead("_n").over(levels)), "levels")
    depth = sizes.agg(F.coalesce(F.max("_l"), F.lit(-1)) + 1).first()[0]
    every = rows.join(sizes, [*keys, "_l"])
    gap = F.concat(F.lit("no map below level "), (F.col("_l") + 1).cast("string"))
    wrapped = F.when(F.col("_next").isNotNull() & (F.col("_t") < 0), F.col("_t") + F.col("_size")).otherwise(F.col("_t"))
    found = refuse(F.col("_next") > F.col("_l") + 1, gap, wrapped)
    return every.select(*keys, "_l", "_p", found.alias("_t"), F.col("_next").isNull().alias("_last")), depth


def compose(maps: DataFrame, keys: Sequence[str] = (), level: str = "level", position: str = "position", target: str = "target") -> DataFrame:
    """(keys, position, target): each place of the outermost subset and the place in the base that it leads to.

    maps has a row for each place (from 0) of each level; levels count from 1, the outermost, and a level's targets are
    places of the next; the last level's are places in the base and stay as they are. Depths may differ by key. Pairs of
    levels are joined, then pairs of those, so a nest takes as many joins as its depth has binary digits, each written
    before the next; a join is by place, so a dataset of any size is spread out.

    A negative target counts from the end of its level. One out of range, a level that is missing between others, and
    a place that a level has twice are errors. A null target is out of range. Without rows of level 1 a key has no places;
    rows of a null key are left out.
    """
    keys = list(keys)
    rows, depth = _normal(maps, keys, level, position, target)
    while depth > 1:
        rows = stored(rows, "maps")
        at = [*keys, "_pair", "_t"]
        outer = rows.where("_l % 2 = 0").withColumn("_pair", F.expr("_l div 2"))
        inner = rows.where("_l % 2 = 1").select(*keys, F.expr("_l div 2").alias("_pair"), F.col("_p").alias("_t"), F.struct(F.col("_t").alias("t"), F.col("_last").alias("last")).alias("_below"))
        one = inner.groupBy(*at).agg(F.min("_below").alias("_below"), F.count("*").alias("_n"))
        both = outer.join(one, at, "left")
        lost = ~F.col("_last") & F.col("_below").isNull()
        place = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
        below = refuse(lost | (F.col("_n") > 1), F.concat(F.lit("place "), place("_t"), F.lit(" is "), F.when(lost, "out of range").otherwise("there twice")), F.col("_below"))
        to = F.when(F.col("_last"), F.col("_t")).otherwise(below["t"])
        rows = both.select(*keys, F.col("_pair").alias("_l"), "_p", to.alias("_t"), (F.col("_last") | below["last"]).alias("_last"))
        depth = -(-depth // 2)
    return rows.where("_l = 0").select(*keys, F.col("_p").alias("position"), F.col("_t").alias("target"))


def index_rows(maps: DataFrame, items: DataFrame, keys: Sequence[str], level: str = "level", position: str = "position", target: str = "target") -> DataFrame:
    """Rows of an index: each place of the outermost subset as `item`, its base_index, and the columns of that item of the base.

    items has keys and base_index, and one row for each; a place that leads to none is an error that names it.
    """
    places = compose(maps, keys, level, position, target).withColumnsRenamed({"position": "item", "target": "base_index"})
    return lookup_all(places, items, [*keys, "base_index"])
