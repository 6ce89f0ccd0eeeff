"""Queries over nested subsets, arrays in files and recordings kept in chunks; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..operators import features, fluctuation, index_maps
from ..sources import arrays, writers
from . import adapters as A
from .registry import ORACLE_SQL, query, r6
from .sql import EM
from .queries import Q, SCALES
from .study import GA, _traces

# Nested subsets: each user's events, of which some are kept, sorted by value, thinned, kept by kind, and thinned again

NESTED = """b AS (SELECT user_id AS dataset, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS base FROM events),
s5 AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY base) - 1 AS p5 FROM b WHERE value >= 5),
s4 AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY value, base) - 1 AS p4 FROM s5),
s3 AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY p4) - 1 AS p3 FROM s4 WHERE p4 % 3 <> 2),
s2 AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY p3) - 1 AS p2 FROM s3 WHERE event_type <> 'error'),
s1 AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY p2 DESC) - 1 AS p1 FROM s2 WHERE p2 % 2 = 0 OR dataset % 5 = 0)"""


def _nested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Maps of five levels (three for some datasets, whose outer two are left out), and the items of the base."""
    place = lambda *order: F.row_number().over(Window.partitionBy("dataset").orderBy(*order)) - 1
    base = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("dataset"), "event_id", "event_type", "value").withColumn("p6", place("event_id"))
    s5 = base.where("value >= 5").withColumn("p5", place("p6"))
    s4 = s5.withColumn("p4", place("value", "p6"))
    s3 = s4.where("p4 % 3 <> 2").withColumn("p3", place("p4"))
    s2 = s3.where("event_type <> 'error'").withColumn("p2", place("p3"))
    s1 = s2.where("p2 % 2 = 0 or dataset % 5 = 0").withColumn("p1", place(F.desc("p2")))
    maps = None
    for level, rows in enumerate((s1, s2, s3, s4, s5), 1):
        some = rows.select("dataset", F.lit(level).alias("level"), F.col(f"p{level}").alias("position"), F.col(f"p{level + 1}").alias("target"))
        maps = some if maps is None else maps.unionByName(some)
    shallow = maps.where("dataset % 4 = 1 and level > 2").withColumn("level", F.col("level") - 2)
    items = base.select("dataset", F.col("p6").cast("long").alias("base_index"), "event_id", "value")
    return maps.where("dataset % 4 <> 1").unionByName(shallow), items


@query(f"""WITH {NESTED} SELECT dataset, p1 AS item, base AS base_index, event_id, round(value, 6) AS value FROM s1 WHERE dataset % 4 <> 1
UNION ALL SELECT dataset, p3, base, event_id, round(value, 6) FROM s3 WHERE dataset % 4 = 1""")
def composed_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of subsets of subsets, five deep or three, each told by its place in the base."""
    return index_maps.index_rows(*_nested(spark, sf_dir), ["dataset"]).select("dataset", "item", "base_index", "event_id", r6("value", "value"))


# Arrays in files


@query("SELECT vec_id, label::BIGINT AS label, k::INT AS k, round(x, 6) AS value FROM (SELECT vec_id, label, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings) e")
def rows_of_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and their numbers saved as aligned arrays and read back by their columns."""
    path = writers.scratch(spark, "arrays")
    arrays.write_arrays(A.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").alias("samples")), path)
    read = arrays.read_arrays(spark, path, "vec_id long, label long, samples array<float>")
    return read.select("vec_id", "label", F.posexplode("samples").alias("k", "v")).select("vec_id", "label", "k", r6(F.col("v").cast("double"), "value"))


@query("SELECT label::INT AS label, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM embeddings WHERE vec_id % 3 = 0 GROUP BY label")
def some_columns_of_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain numbers beside vectors: the files of the vectors are not opened."""
    path = writers.scratch(spark, "arrays")
    arrays.write_arrays(A.table(spark, sf_dir, "embeddings").where("vec_id % 3 = 0").select("vec_id", "label", "embedding"), path, size=4096)
    read = arrays.read_arrays(spark, path, "label int, vec_id long", split=2048)
    return read.groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))


# Recordings in chunks


@query(ORACLE_SQL["gathered_windows"])
def windows_of_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of traces that are kept in chunks of 7 samples; chunks and windows meet in bins of 20."""
    traces, starts = _traces(spark, sf_dir)
    rows = features.gather_chunks(features.chunked(traces, 7), starts, ["vec_id"], n=48, bin_samples=20)
    return rows.select("vec_id", "window_from", F.posexplode("samples").alias("i", "v")).select("vec_id", F.col("window_from").cast("int"), "i", r6("v", "x"))


@query(ORACLE_SQL["extracted_features"])
def features_of_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of every window of traces in chunks."""
    traces, starts = _traces(spark, sf_dir)
    rows = features.extract(features.chunked(traces, 7), starts, ["vec_id"], (8, 9, 10, 12), (1.0, 2.0), 48, fs=48.0, window=16, max_hz=24.0, at="chunk_from", bin_samples=20)
    return rows.select("vec_id", F.col("window_from").cast("int"), r6("log_var", "log_var"), r6(F.col("hq")[1], "h2"), "run", F.size("spec").alias("frames"), r6(F.col("spec")[6][0], "middle"))


@query(f"WITH {EM}, {GA} SELECT vec_id, window_from::INT AS window_from, round(sum(x), 6) AS total, round(sum(x * i), 6) AS moment FROM ga GROUP BY ALL")
def windows_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all vectors in long arrays in files, one vector after the other: they are read in chunks of 100 samples and found by place."""
    path, (traces, starts) = writers.scratch(spark, "recordings"), _traces(spark, sf_dir)
    samples = traces.repartition(8, "vec_id").sortWithinPartitions("vec_id").select("vec_id", F.posexplode("trace").alias("i", "x"))
    arrays.write_arrays(samples.select(F.col("vec_id").cast("long"), F.col("x").cast("double")), path)
    # a file's samples are a recording; where each vector begins in it is in the numbers beside them
    begins = arrays.read_arrays(spark, path, "file string, row long, vec_id long").groupBy("file", "vec_id").agg(F.min("row").alias("begin"))
    placed = starts.join(begins, "vec_id").select("file", "vec_id", F.col("window_from").alias("own"), (F.col("window_from") + F.col("begin")).alias("window_from"))
    recordings = arrays.read_arrays(spark, path, "file string, row long, x array<double>", chunk=100)
    rows = features.gather_chunks(recordings, placed, ["file"], n=48, trace="x", at="row", bin_samples=256).join(placed.distinct(), ["file", "window_from"])
    total, moment = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v), F.aggregate(F.transform("samples", lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
    return rows.select("vec_id", F.col("own").cast("int").alias("window_from"), r6(total, "total"), r6(moment, "moment"))


@query(ORACLE_SQL["mfdfa_hq"])
def exponents_of_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponents of signals in chunks of 7 samples, which segments of 8 to 16 reach across."""
    signals = features.chunked(A.windows(spark, sf_dir).select("vec_id", "samples"), 7, "samples")
    hq = fluctuation.mfdfa_chunks(signals, ["vec_id"], SCALES, Q, "samples")
    rows = hq.select("vec_id", F.explode(F.arrays_zip(F.array(*[F.lit(q) for q in Q]).alias("q"), F.col("hq").alias("h"))).alias("z"))
    return rows.select("vec_id", "z.q", r6("z.h", "h"))


@query()
def exponents_of_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponents of one long signal a label, its vectors one after the other; tested against windows held whole."""
    v = A.windows(spark, sf_dir)
    numbered = ranks.numbered(v, ["label"], ["vec_id"], "k")
    chunks = numbered.select("label", (F.col("k").cast("long") * 64).alias("chunk_from"), F.col("samples").alias("trace"))
    found = fluctuation.mfdfa_chunks(chunks, ["label"], (8, 16, 32, 64, 128, 256), (-3.0, 0.0, 2.0, 3.0), order=2)
    return found.select("label", r6("hurst", "hurst"), F.transform("hq", lambda h: F.round(h, 6)).alias("hq"))
