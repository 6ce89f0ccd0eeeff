"""The audit's queries over the driver's tables, and the same in DuckDB's SQL.

Doubles are rounded to six decimals on both sides: sums differ in their last bits by order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import bind, geometric_scales, is_finite
from ..model import CELL, SESSION
from ..operators import decoding, features, fluctuation, fold_audit, inference, selection, timescale
from ..sources import synthetic
from . import adapters as A
from .registry import ORACLE_SQL, QUERIES, query, r6  # noqa: F401
from .sql import C4, EM, EV, FI, LI, PA, PR, PROFILES

HORIZONS = (60, 600, 3600)
SCALES = (8, 9, 10, 11, 12, 13, 14, 16)
Q = (1.0, 2.0, 3.0, 5.0)
TASKS = 7
HOURS = 720


# Fold audit


@query(f"WITH {FI} SELECT * FROM fi")
def fold_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.fold_index(spark, sf_dir)


@query(f"""WITH {FI}, t AS (SELECT *, window_from AS w FROM fi WHERE role = 'test')
SELECT a.test_subject, a.test_trial, a.task, a.fold, round(avg(CASE WHEN w < (SELECT max(m) FROM (SELECT min(w) AS m FROM t b WHERE b.test_subject = a.test_subject AND b.test_trial = a.test_trial AND b.task = a.task AND b.fold = a.fold GROUP BY label) x)
   OR w > (SELECT min(m) FROM (SELECT max(w) AS m FROM t b WHERE b.test_subject = a.test_subject AND b.test_trial = a.test_trial AND b.task = a.task AND b.fold = a.fold GROUP BY label) x) THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS single_class_share
FROM t a GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT label) = 2""")
def single_class_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = fold_audit.single_class_share(A.stored_index(spark, sf_dir), missing="drop")
    return shares.select(*CELL, r6("single_class_share", "single_class_share"))


@query(f"""WITH {FI}, n AS (SELECT a.*, (SELECT min(abs(a.window_from / 2048.0 - b.window_from / 2048.0)) FROM fi b
   WHERE b.role = 'train' AND b.test_subject = a.test_subject AND b.test_trial = a.test_trial AND b.task = a.task AND b.fold = a.fold) AS near FROM fi a WHERE a.role = 'test')
SELECT {C4}, {", ".join(f"round(avg(CASE WHEN near < {w} THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS within_{w}s" for w in HORIZONS)} FROM n GROUP BY ALL""")
def train_test_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = fold_audit.train_test_adjacency(A.stored_index(spark, sf_dir), HORIZONS, bucket_seconds=86_400.0)
    return near.select(*CELL, *[r6(f"within_{w}s", f"within_{w}s") for w in HORIZONS])


@query(f"""WITH {EV}, d AS (SELECT *, median(window_from) OVER (PARTITION BY test_subject, test_trial, task) AS cut FROM ev),
p AS (SELECT *, CASE WHEN window_from < cut THEN 0 ELSE 1 END AS part FROM d),
c AS (SELECT *, median(window_from) OVER (PARTITION BY test_subject, test_trial, task, part) AS c2 FROM p),
u AS (SELECT test_subject, test_trial, task, part AS fold, CASE WHEN window_from < c2 THEN 'val' ELSE 'test' END AS role, base_index, window_from, label FROM c
  UNION ALL SELECT test_subject, test_trial, task, 1 - part, 'train', base_index, window_from, label FROM c)
SELECT *, (row_number() OVER (PARTITION BY test_subject, test_trial, task, fold, role ORDER BY window_from, base_index) - 1)::INT AS item FROM u""")
def common_time_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_audit.common_time_folds(A.events(spark, sf_dir).drop("value"))


@query(f"""WITH {FI} SELECT {C4}, count(*) FILTER (WHERE role = 'test') AS n_test, count(*) FILTER (WHERE role = 'train') AS n_train,
  count(DISTINCT CASE WHEN role = 'test' THEN label END) AS n_labels FROM fi GROUP BY ALL""")
def fold_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_audit.fold_quality(A.fold_index(spark, sf_dir))


@query(f"""WITH {FI} SELECT role, count(*) AS rows, count(DISTINCT (test_subject, test_trial, window_from)) AS distinct_windows FROM fi GROUP BY role""")
def split_role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_audit.role_counts(A.fold_index(spark, sf_dir))


@query(f"""WITH {EV}, one AS (SELECT DISTINCT test_subject, test_trial, window_from FROM ev)
SELECT test_subject, test_trial, count(*) AS windows FROM one GROUP BY 1, 2 UNION ALL SELECT NULL, NULL, count(*) FROM one""")
def unique_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_audit.unique_window_totals(A.events(spark, sf_dir))


# Results


@query(f"WITH {LI} SELECT model, subject, trial, task, round(auroc, 6) AS auroc FROM cells")
def cell_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.cell_means(A.decoded(spark, sf_dir)).select("model", *SESSION, "task", r6("auroc", "auroc"))


@query(f"WITH {LI} SELECT model, subject, trial, round(auroc, 6) AS auroc FROM ov")
def session_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.session_overall(A.cells(spark, sf_dir), TASKS).select("model", *SESSION, r6("auroc", "auroc"))


@query(f"""WITH {LI} SELECT a.subject, a.trial, round(a.auroc - b.auroc, 6) AS diff FROM ov a JOIN ov b USING (subject, trial) WHERE a.model = 'A' AND b.model = 'N'""")
def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    overall = inference.session_overall(A.cells(spark, sf_dir), TASKS)
    return inference.paired_difference(overall, "A", "N").select(*SESSION, r6("diff", "diff"))


def _thinned(cells: DataFrame) -> DataFrame:
    """Cells without those of one model and task whose mean is high: some sessions then lack a task."""
    return cells.where(~((F.col("model") == "N") & (F.col("task") == "7") & (F.round("auroc", 4) > 0.5)))


@query(f"""WITH {LI}, few AS (SELECT * FROM cells WHERE NOT (model = 'N' AND task = '7' AND round(auroc, 4) > 0.5)),
fo AS (SELECT model, subject, trial FROM few GROUP BY ALL HAVING count(DISTINCT task) = 7)
(SELECT subject, trial FROM fo WHERE model = 'A' EXCEPT SELECT subject, trial FROM fo WHERE model = 'N')
UNION ALL (SELECT subject, trial FROM fo WHERE model = 'N' EXCEPT SELECT subject, trial FROM fo WHERE model = 'A')""")
def sessions_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.keys_dropped(inference.session_overall(_thinned(A.cells(spark, sf_dir)), TASKS), "A", "N")


@query(f"""WITH {LI} SELECT subject, trial, round(max(auroc) FILTER (WHERE model = 'A'), 6) AS "A", round(max(auroc) FILTER (WHERE model = 'N'), 6) AS "N", round(max(auroc) FILTER (WHERE model = 'R'), 6) AS "R"
FROM ov GROUP BY 1, 2 HAVING count(*) = 3""")
def in_all_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = inference.in_all(inference.session_overall(A.cells(spark, sf_dir), TASKS), ("A", "N", "R"))
    return wide.select(*SESSION, *[r6(m, m) for m in "ANR"])


@query(f"""WITH {LI}, d AS (SELECT abs(a.auroc - b.auroc) AS d FROM cells a JOIN cells b USING (subject, trial, task) WHERE a.model = 'A' AND b.model = 'R')
SELECT count(*) AS cells, round(max(d), 6) AS max_abs_diff, round(median(d), 6) AS median_abs_diff, count(*) FILTER (WHERE d <= 0.01) AS within_0p01 FROM d""")
def reproduction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = A.cells(spark, sf_dir)
    out = inference.reproduction_stats(cells.where("model = 'A'"), cells.where("model = 'R'"), (*SESSION, "task"))
    return out.select("cells", r6("max_abs_diff", "max_abs_diff"), r6("median_abs_diff", "median_abs_diff"), "within_0p01")


@query(f"WITH {LI} SELECT model, subject, trial, round(avg(abs(auroc - 0.5)), 6) AS dev FROM cells GROUP BY 1, 2, 3")
def abs_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.abs_deviation(A.cells(spark, sf_dir), ("model", *SESSION)).select("model", *SESSION, r6("dev", "dev"))


@query(f"""WITH {LI}, t AS (SELECT task, avg(auroc) FILTER (WHERE model = 'A') AS x, avg(auroc) FILTER (WHERE model = 'N') AS y FROM cells GROUP BY task),
r AS (SELECT (SELECT count(*) FROM t b WHERE b.x < a.x) + ((SELECT count(*) FROM t b WHERE b.x = a.x) + 1) / 2.0 AS x, (SELECT count(*) FROM t b WHERE b.y < a.y) + ((SELECT count(*) FROM t b WHERE b.y = a.y) + 1) / 2.0 AS y FROM t a)
SELECT round(corr(x, y), 6) AS rho FROM r""")
def spearman_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda m: F.avg(F.when(F.col("model") == m, F.col("auroc")))
    tasks = A.cells(spark, sf_dir).groupBy("task").agg(of("A").alias("x"), of("N").alias("y"))
    return inference.spearman(tasks, "x", "y").select(r6("rho", "rho"))


@query("""WITH x AS (SELECT l_returnflag AS model, l_linenumber AS n, l_linenumber / 10.0::DOUBLE AS truth, l_discount AS v, l_discount - l_linenumber / 10.0::DOUBLE AS e, l_tax AS s FROM lineitem)
SELECT model, n, min(truth) AS truth, round(avg(e), 6) AS bias, round(stddev_samp(v), 6) AS sd, round(sqrt(avg(e * e)), 6) AS rmse, round(median(s), 6) AS median, round(quantile_cont(s, 0.95), 6) AS p95 FROM x GROUP BY 1, 2""")
def replicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("n"), (F.col("l_linenumber") / 10.0).alias("truth"), F.col("l_discount").alias("v"),
        (F.col("l_discount") - F.col("l_linenumber") / 10.0).alias("e"), F.col("l_tax").alias("s"),
    )
    out = inference.replicate_summary(rows, ("model", "n"), "truth", "v", "e", "s")
    return out.select("model", "n", "truth", *[r6(c, c) for c in ("bias", "sd", "rmse", "median", "p95")])


@query(f"""WITH {LI} SELECT model, round(min(x), 6) AS least, round(median(x), 6) AS median, round(max(x), 6) AS largest FROM dec GROUP BY model""")
def value_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.extent(A.decoded(spark, sf_dir).withColumnRenamed("rung", "model"), ("model",), "test_auroc")
    return out.select("model", *[r6(c, c) for c in ("least", "median", "largest")])


def _half(decoded: DataFrame, fold: int) -> DataFrame:
    return inference.cell_means(decoded.where(F.col("fold") == fold)).drop("split")


HALVES = """hc AS (SELECT fold, model, subject, trial, task, avg(x) AS auroc FROM dec GROUP BY ALL),
ho AS (SELECT fold, model, subject, trial, avg(auroc) AS auroc FROM hc GROUP BY ALL HAVING count(DISTINCT task) = 7)"""


@query(f"""WITH {LI}, {HALVES} SELECT a.model, a.subject, a.trial, round(a.auroc, 6) AS circular, round(b.auroc, 6) AS crossfit, round(a.auroc - b.auroc, 6) AS diff
FROM ho a JOIN ho b USING (model, subject, trial) WHERE a.fold = 0 AND b.fold = 1""")
def selection_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.decoded(spark, sf_dir)
    return inference.inflation(_half(d, 0), _half(d, 1), TASKS).select("model", *SESSION, *[r6(c, c) for c in ("circular", "crossfit", "diff")])


@query(f"""WITH {LI}, {HALVES}, d AS (SELECT a.model, a.subject, a.trial, a.auroc - b.auroc AS diff FROM ho a JOIN ho b USING (model, subject, trial) WHERE a.fold = 0 AND b.fold = 1)
SELECT x.subject, x.trial, round((x.diff + y.diff) / 2 - z.diff, 6) AS diff FROM d x JOIN d y USING (subject, trial) JOIN d z USING (subject, trial) WHERE x.model = 'A' AND y.model = 'R' AND z.model = 'N'""")
def amplitude_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.decoded(spark, sf_dir)
    return inference.contrast(inference.inflation(_half(d, 0), _half(d, 1), TASKS), ("A", "R"), ("N",)).select(*SESSION, r6("diff", "diff"))


@query(f"""WITH {LI}, {HALVES} SELECT a.subject, a.trial, round(b.auroc - a.auroc, 6) AS diff FROM ho a JOIN ho b USING (subject, trial, model) WHERE a.fold = 0 AND b.fold = 1 AND a.model = 'R'""")
def variant_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.decoded(spark, sf_dir)
    return inference.variant_difference(_half(d, 0), _half(d, 1), "R", "_alt", TASKS).select(*SESSION, r6("diff", "diff"))


@query()
def hier_boot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of three paired differences; tested against published values."""
    overall = inference.session_overall(A.cells(spark, sf_dir), TASKS)
    pairs = [("A", "N"), ("A", "R"), ("N", "R")]
    rows = [inference.paired_difference(overall, a, b).withColumn("comparison", F.lit(f"{a}-{b}")) for a, b in pairs]
    out = inference.hier_boot(rows[0].unionByName(rows[1]).unionByName(rows[2]))
    return out.withColumn("equivalent", inference.equivalent()).withColumn("off_chance", inference.off_chance(chance=0.0))


@query()
def task_boot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of each task's mean AUROC, and whether they leave chance out."""
    rows = A.cells(spark, sf_dir).where("model = 'A'").select(F.concat(F.lit("H5_"), "task").alias("comparison"), *SESSION, F.col("auroc").alias("diff"))
    return inference.hier_boot(rows).withColumn("confounded", inference.off_chance())


@query()
def spearman_boot(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = A.cells(spark, sf_dir)
    diff = inference.paired_difference(cells, "A", "N", (*SESSION, "task"))
    return inference.spearman_boot(diff, cells.where("model = 'R'").groupBy("task").agg(F.avg("auroc").alias("tau")))


# Selection


@query(f"WITH {PA} SELECT electrode, stem, num FROM na")
def stem_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.parse_names(A.electrodes(spark, sf_dir)).select("electrode", "stem", "num")


@query(f"WITH {PA} SELECT stem, len, lo, hi FROM rn")
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.streaks(A.electrodes(spark, sf_dir)).select("stem", "len", "lo", "hi")


@query(f"""WITH {PA}, o AS (SELECT *, coalesce(sum(len) OVER (ORDER BY perf DESC, stem, len DESC, lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rn WHERE len > 1)
SELECT (o.before + st.num - st.lo + 1)::INT AS pos, st.electrode FROM st JOIN o ON st.stem = o.stem AND st.lo = o.lo WHERE o.before < 119 AND o.before + st.num - st.lo + 1 <= 120""")
def select_electrodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select_electrodes(A.electrodes(spark, sf_dir))


@query(f"""WITH {PA}, a AS (SELECT electrode FROM na WHERE mean_auroc >= 910), b AS (SELECT electrode FROM na WHERE num % 2 = 0)
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) x) AS shared,
  round((SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) x) / greatest(1, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) x)), 6) AS jaccard""")
def subset_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = selection.parse_names(A.electrodes(spark, sf_dir))
    return selection.overlap(known.where("mean_auroc >= 910"), known.where("num % 2 = 0")).select("n_a", "n_b", "shared", r6("jaccard", "jaccard"))


@query(f"""WITH {PA}, a AS (SELECT electrode FROM na WHERE mean_auroc >= 910), b AS (SELECT electrode FROM na WHERE num % 2 = 0)
SELECT electrode, EXISTS (SELECT 1 FROM b WHERE b.electrode = a.electrode) AS known FROM a""")
def semi_anti_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = selection.parse_names(A.electrodes(spark, sf_dir))
    wanted, there = names.where("mean_auroc >= 910"), names.where("num % 2 = 0")
    found = selection.keep_known(wanted, there).select("electrode", F.lit(True).alias("known"))
    return found.unionByName(selection.unknown(wanted, there).select("electrode", F.lit(False).alias("known")))


@query(f"""WITH {LI} SELECT a.subject, a.trial, b.trial AS partner_trial, a.model, round(b.auroc, 6) AS auroc FROM ov a JOIN ov b ON a.model = b.model AND a.subject = b.subject AND a.trial <> b.trial""")
def partner_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    overall = inference.session_overall(A.cells(spark, sf_dir), TASKS)
    return selection.partner_scores(overall).select(*SESSION, "partner_trial", "model", r6("auroc", "auroc"))


# Decoding


@query("""WITH s AS (SELECT event_type AS kind, value, (hour(ts) >= 12)::INT AS y FROM events),
r AS (SELECT kind, y, rank() OVER (PARTITION BY kind ORDER BY value) + (count(*) OVER (PARTITION BY kind, value) - 1) / 2.0 AS r FROM s)
SELECT kind, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6)::DOUBLE AS auroc FROM r GROUP BY kind""")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), "value", (F.hour("ts") >= 12).cast("int").alias("y"))
    return decoding.auroc(rows, ["kind"], "value", "y").select("kind", r6("auroc", "auroc"))


@query(f"""WITH {FI}, te AS (SELECT * FROM fi WHERE role = 'test'),
r AS (SELECT {C4}, label, rank() OVER (PARTITION BY {C4} ORDER BY window_from) + (count(*) OVER (PARTITION BY {C4}, window_from) - 1) / 2.0 AS r FROM te),
a AS (SELECT {C4}, (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * sum(1 - label), 0) AS a FROM r GROUP BY ALL),
c AS (SELECT {C4}, covar_pop(label::DOUBLE, window_from / 2048.0) AS c FROM fi WHERE role = 'train' GROUP BY ALL)
SELECT a.test_subject, a.test_trial, a.task, a.fold, round(CASE WHEN c > 0 THEN a WHEN c < 0 THEN 1 - a WHEN a IS NOT NULL THEN 0.5 END, 6)::DOUBLE AS auroc
FROM a LEFT JOIN c ON a.test_subject = c.test_subject AND a.test_trial = c.test_trial AND a.task = c.task AND a.fold = c.fold""")
def l0_time_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.time_only_auroc(A.stored_index(spark, sf_dir)).select(*CELL, r6("auroc", "auroc"))


@query(f"""WITH {FI}, m AS (SELECT {C4}, avg(window_from / 2048.0) AS mu, stddev_pop(window_from / 2048.0) AS sd FROM fi WHERE role = 'train' GROUP BY ALL)
SELECT fi.test_subject, fi.test_trial, fi.task, fi.fold, role, base_index, round((window_from / 2048.0 - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS z
FROM fi JOIN m ON fi.test_subject = m.test_subject AND fi.test_trial = m.test_trial AND fi.task = m.task AND fi.fold = m.fold WHERE role IN ('train', 'test')""")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decoding.standardize(A.stored_index(spark, sf_dir), F.col("window_from") / 2048.0)
    return rows.select(*CELL, "role", "base_index", r6("z", "z"))


@query()
def logistic_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell per label present, told from the others by its vectors; tested against a plain solver."""
    role = F.when(F.crc32(F.col("vec_id").cast("string").cast("binary")) % 2 == 0, "train").otherwise("test")
    cells = A.windows(spark, sf_dir).select(role.alias("role"), "label", F.col("samples").alias("features"))
    return decoding.decode_labels(cells).withColumn("task", F.col("task").cast("int"))


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the fold index with what their windows' times tell: the day, the time of day as a place on a circle, and the number's remainder."""
    day = F.col("window_from") / F.lit(2048.0 * 86400)
    turn = day * (2 * 3.141592653589793)
    features_ = F.array(day, F.sin(turn), F.cos(turn), (F.col("base_index") % 7).cast("double"))
    return A.stored_index(spark, sf_dir).select(*CELL, "role", F.col("base_index").alias("item"), "label", features_.alias("features"))


@query()
def small_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model for each cell of the fold index, hundreds solved together; tested against a plain solver cell by cell."""
    return decoding.decode_many(_timed(spark, sf_dir)).select(*CELL, "n_train", "n_test", "n_features", r6("test_auroc", "test_auroc"), r6("train_auroc", "train_auroc"))


@query()
def two_tolerances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell's scores at a loose and a tight tolerance, and the steps that each took."""
    found = decoding.convergence(_timed(spark, sf_dir))
    return found.select(*CELL, r6("auroc_loose", "auroc_loose"), r6("auroc_tight", "auroc_tight"), "iter_loose", "iter_tight", r6("diff", "diff"))


@query()
def single_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels decoded alone: vectors of one remainder by 8 are the windows of a channel, told apart by whether their label is even."""
    v = A.windows(spark, sf_dir).select(F.lit(1).alias("session"), (F.col("vec_id") % 8).cast("string").alias("electrode"), F.floor(F.col("vec_id") / 8).alias("window_from"), "samples", "label")
    whole = v.groupBy("window_from").agg(F.count("*").alias("n"), F.min("label").alias("label")).where("n = 8")  # windows that all channels have
    folds = whole.select(F.lit(1).alias("session"), F.explode(F.array(F.lit(0), F.lit(1))).alias("fold"), F.col("window_from"), (F.col("label") % 2).alias("label"))
    folds = folds.withColumn("role", F.when(F.col("window_from") % 2 == F.col("fold"), "test").otherwise("train")).withColumn("item", F.col("window_from"))
    found = decoding.decode_channels(v.drop("label"), folds, ["session"], ["fold"])
    return found.select("electrode", "fold", "n_train", "n_test", "n_features", r6("test_auroc", "test_auroc"), r6("train_auroc", "train_auroc"))


# Signals


@query(f"WITH {EM} SELECT vec_id, round(ln(var_pop(x)), 6) AS log_var FROM em GROUP BY vec_id")
def log_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.windows(spark, sf_dir).select("vec_id", r6(features.log_variance("samples"), "log_var"))


@query(f"WITH {EM} SELECT vec_id, i::INT AS pos, round(abs(x) / sum(abs(x)) OVER (PARTITION BY vec_id), 6) AS share FROM em")
def shape_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = features.shape_only(F.transform("samples", F.abs))
    return A.windows(spark, sf_dir).select("vec_id", F.posexplode(shares).alias("pos", "s")).select("vec_id", "pos", r6("s", "share"))


@query(f"WITH {PR} SELECT vec_id, i::INT AS i, round(y, 6) AS y FROM pr")
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.windows(spark, sf_dir).select("vec_id", F.posexplode(fluctuation.profile("samples")).alias("i", "v")).select("vec_id", "i", r6("v", "y"))


@query(f"WITH {PR} SELECT vec_id, scale::INT AS scale, segment::INT AS segment, round(rms, 6) AS rms FROM rm")
def segment_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_scale = F.arrays_zip(F.array(*[F.lit(s) for s in SCALES]).alias("s"), fluctuation.segment_rms("samples", SCALES).alias("r"))
    rows = A.windows(spark, sf_dir).select("vec_id", F.explode(by_scale).alias("z")).select("vec_id", F.col("z.s").alias("scale"), F.posexplode("z.r").alias("segment", "v"))
    return rows.select("vec_id", "scale", "segment", r6("v", "rms"))


@query(f"""WITH {PR}, f AS (SELECT vec_id, scale, sqrt(avg(rms * rms)) AS f FROM rm GROUP BY ALL)
SELECT vec_id, round(regr_slope(log2(f + 2.220446049250313e-16::DOUBLE), log2(scale)), 6) AS hurst FROM f GROUP BY vec_id""")
def dfa_hurst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fluctuation.dfa(A.windows(spark, sf_dir), SCALES).select("vec_id", r6("hurst", "hurst"))


@query(f"""WITH {PR}, m AS (SELECT vec_id, scale, q, avg(pow(rms, q)) AS m FROM rm, (SELECT unnest([1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE, 5.0::DOUBLE]) AS q) z GROUP BY vec_id, scale, q),
f AS (SELECT vec_id, scale, q, pow(m, 1 / q) AS f FROM m)
SELECT vec_id, q, round(regr_slope(log2(f + 2.220446049250313e-16::DOUBLE), log2(scale)), 6) AS h FROM f GROUP BY vec_id, q""")
def mfdfa_hq(spark: SparkSession, sf_dir: str) -> DataFrame:
    hq = fluctuation.mfdfa(A.windows(spark, sf_dir), SCALES, Q)
    rows = hq.select("vec_id", F.explode(F.arrays_zip(F.array(*[F.lit(q) for q in Q]).alias("q"), F.col("hq").alias("h"))).alias("z"))
    return rows.select("vec_id", "z.q", r6("z.h", "h"))


def _quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.windows(spark, sf_dir).withColumn("samples", F.transform("samples", lambda v: F.floor(v * 8 + 0.5).cast("double")))


RUNS = (
    EM
    + """, qu AS (SELECT vec_id, i, floor(x * 8 + 0.5) AS v FROM em),
ch AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY vec_id ORDER BY i) THEN 0 ELSE 1 END AS c FROM qu),
isl AS (SELECT *, sum(c) OVER (PARTITION BY vec_id ORDER BY i) AS k FROM ch),
ru AS (SELECT vec_id, max(n)::INT AS run FROM (SELECT vec_id, k, count(*) AS n FROM isl GROUP BY ALL) x GROUP BY vec_id)"""
)


@query(f"WITH {RUNS} SELECT vec_id, run FROM ru")
def longest_flat_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fluctuation.flat_run(_quantised(spark, sf_dir)).select("vec_id", "run")


@query(f"WITH {RUNS} SELECT count(*) FILTER (WHERE run < 8) AS n_kept, count(*) FILTER (WHERE run >= 8) AS n_excluded FROM ru")
def plateau_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.exclusion_counts(features.keep_unflat(fluctuation.flat_run(_quantised(spark, sf_dir)), ["vec_id"]))


ORDER2 = (
    PROFILES
    + """, sg AS (SELECT vec_id, s AS scale, i // s AS segment, i % s - (s - 1) / 2.0::DOUBLE AS t, s::DOUBLE AS s, y FROM pr, (SELECT unnest([8, 9, 10, 11, 12, 13, 14, 16]) AS s) z WHERE i < (64 // s) * s),
-- a line and a parabola that is orthogonal to it
rw AS (SELECT vec_id, scale, segment, sqrt(greatest(regr_syy(y, t) - regr_sxy(y, t) * regr_sxy(y, t) / regr_sxx(y, t) - regr_sxy(y, t * t - (s * s - 1) / 12) * regr_sxy(y, t * t - (s * s - 1) / 12) / regr_sxx(y, t * t - (s * s - 1) / 12), 0) / count(*)) AS r FROM sg GROUP BY ALL),
fl AS (SELECT vec_id, scale, coalesce(median(CASE WHEN r > 0 THEN r END) * 0.001, 0) AS f FROM rw GROUP BY ALL),
rm AS (SELECT rw.vec_id, rw.scale, segment, greatest(r, f, 2.220446049250313e-16::DOUBLE) AS rms FROM rw JOIN fl ON rw.vec_id = fl.vec_id AND rw.scale = fl.scale)"""
)


def _hq_sql(rms: str, moments: str) -> str:
    """Exponents by moment from a table rm of segment RMS; 0 is the geometric mean."""
    return f"""WITH {rms}, m AS (SELECT vec_id, scale, q, CASE WHEN q = 0 THEN exp(avg(ln(rms))) ELSE pow(avg(pow(rms, q)), 1 / nullif(q, 0)) END AS f FROM rm, (SELECT unnest([{moments}]::DOUBLE[]) AS q) z GROUP BY vec_id, scale, q)
SELECT vec_id, q, round(regr_slope(log2(f + 2.220446049250313e-16::DOUBLE), log2(scale)), 6) AS h FROM m GROUP BY vec_id, q"""


def _by_q(hq: DataFrame, q: tuple[float, ...]) -> DataFrame:
    rows = hq.select("vec_id", F.explode(F.arrays_zip(F.array(*[F.lit(k) for k in q]).alias("q"), F.col("hq").alias("h"))).alias("z"))
    return rows.select("vec_id", "z.q", r6("z.h", "h"))


@query(_hq_sql(ORDER2, "1, 2, 3, 5"))
def order2_hq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponents with quadratic detrending, in numpy."""
    return _by_q(fluctuation.hq_of_order(A.windows(spark, sf_dir), SCALES, Q, 2), Q)


@query(_hq_sql(PR, "-5, -3, -2, -1, 0"))
def negative_hq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponents of moments of 0 and below; vectors have no plateaus."""
    q = (-5.0, -3.0, -2.0, -1.0, 0.0)
    return _by_q(fluctuation.hq_of_order(A.windows(spark, sf_dir), SCALES, q, 1), q)


@query(f"""WITH {EM}, fr AS (SELECT vec_id, f.f, t.t, coalesce(x, 0) * (0.5 - 0.5 * cos(2 * pi() * t.t / 16)) AS v FROM (SELECT DISTINCT vec_id FROM em) d, (SELECT unnest(range(17)) AS f) f, (SELECT unnest(range(16)) AS t) t
  LEFT JOIN em ON em.vec_id = d.vec_id AND em.i = f.f * 4 + t.t - 8)
SELECT vec_id, f::INT AS frame, k::INT AS k, round(sqrt(pow(sum(v * cos(2 * pi() * k * t / 16)), 2) + pow(sum(v * sin(2 * pi() * k * t / 16)), 2)) / 8, 6) AS magnitude FROM fr, (SELECT unnest(range(9)) AS k) k GROUP BY vec_id, f, k""".replace("SELECT vec_id, f.f", "SELECT d.vec_id, f.f"))
def spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short-time spectra of vectors as windows of 64 samples; this library's own transform."""
    spec = features.spectrogram(A.windows(spark, sf_dir), fs=64.0, window=16, overlap=0.75, max_hz=32.0)
    frames = spec.select("vec_id", F.posexplode("spec").alias("frame", "m"))
    return frames.select("vec_id", "frame", F.posexplode("m").alias("k", "v")).select("vec_id", "frame", "k", r6("v", "magnitude"))


@query()
def known_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates on noise of known exponent, a signal for each supplier: its number gives the exponent, its nation the length; tested for bias."""
    key = F.col("s_suppkey")
    cells = A.table(spark, sf_dir, "supplier").select(
        F.when(key % 2 == 0, "fgn").otherwise("fbm").alias("family"), (0.3 + 0.2 * (F.floor(key / 2) % 4)).alias("exponent"), F.when(F.col("s_nationkey") > 12, 2048).otherwise(1024).alias("n"), key.cast("int").alias("rep"),
    )
    made = fluctuation.mfdfa(synthetic.noise(synthetic.dealt(cells)), geometric_scales(1024), (1.0, 2.0, 5.0))
    rows = made.select("family", "exponent", "n", "truth", F.col("hq")[1].alias("alpha"), (F.col("hq")[1] - F.col("truth")).alias("e"), (F.col("hq")[0] - F.col("hq")[2]).alias("spread"))
    return inference.replicate_summary(rows.withColumnRenamed("truth", "t"), ("family", "exponent", "n"), "t", "alpha", "e", "spread")


# Time grids and nested data


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = F.floor((A.micros() - A.EPOCH_US) / 3600e6)
    return timescale.bin_grid(A.table(spark, sf_dir, "events"), ["event_type"], hours, "value", HOURS)


GRID = f"""e AS (SELECT event_type, floor((epoch_us(ts) - 1704067200000000) / 3600e6)::BIGINT AS bin, value FROM events),
g AS (SELECT t.event_type, b.bin, avg(e.value) AS value FROM (SELECT DISTINCT event_type FROM events) t CROSS JOIN (SELECT unnest(range({HOURS})) AS bin) b LEFT JOIN e ON e.event_type = t.event_type AND e.bin = b.bin GROUP BY 1, 2)"""


@query(f"WITH {GRID} SELECT event_type, bin, round(value, 6) AS value FROM g")
def bin_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hourly(spark, sf_dir).select("event_type", "bin", r6("value", "value"))


@query(f"""WITH {GRID}, s AS (SELECT event_type, bin, avg(value) OVER (PARTITION BY event_type ORDER BY bin ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS v FROM g),
l AS (SELECT a.event_type, k, count(*) AS n, corr(a.v, b.v) AS r, stddev_pop(a.v) AS sa, stddev_pop(b.v) AS sb FROM s a, (SELECT unnest(range(1, 101)) AS k) z, s b
  WHERE b.event_type = a.event_type AND b.bin = a.bin + z.k AND a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL),
x AS (SELECT event_type, k, CASE WHEN n < 20 OR sa = 0 OR sb = 0 THEN 'NaN'::DOUBLE WHEN r < 1 / exp(1.0::DOUBLE) THEN k::DOUBLE END AS e FROM l)
SELECT event_type, CASE WHEN NOT isnan(tau) THEN tau END AS tau FROM (SELECT event_type, coalesce(arg_min(e, k) FILTER (WHERE e IS NOT NULL), 100.0::DOUBLE) AS tau FROM x GROUP BY event_type) y""")
def acf_timescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    smooth = F.avg("value").over(Window.partitionBy("event_type").orderBy("bin").rowsBetween(-11, 0))
    return timescale.acf_timescale(_hourly(spark, sf_dir).withColumn("value", smooth), ["event_type"], cap=100)


@query("""SELECT conv_id, turn, CASE WHEN lag(role) OVER w = role THEN turn - lag(turn + 1) OVER w END AS gap FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""")
def gap_in_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = A.table(spark, sf_dir, "conversations").withColumn("end", F.col("turn") + 1)
    return timescale.gap_in_sequence(turns, ["conv_id"], ["turn", "role", "text"], "turn", "end", "role").select("conv_id", "turn", "gap")


@query("""WITH d AS (SELECT test_subject, task, median(n) AS m FROM (SELECT (user_id % 6)::INT AS test_subject, user_id, event_type AS task, avg(value) AS n FROM events GROUP BY ALL) x GROUP BY ALL)
SELECT test_subject, task, round(m, 6) AS tau FROM d""")
def median_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 6).cast("int").alias("test_subject"), "user_id", F.col("event_type").alias("task")).agg(F.avg("value").alias("n"))
    return inference.median_by(e, ["test_subject", "task"], "n", "tau").select("test_subject", "task", r6("tau", "tau"))


@query("""SELECT event_type, round(avg((props->>'$.k')::DOUBLE), 6) AS avg_k, count(*) AS rows FROM events GROUP BY event_type""")
def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k double")["k"]
    return A.table(spark, sf_dir, "events").groupBy("event_type").agg(r6(F.avg(k), "avg_k"), F.count("*").alias("rows"))


@query(f"""WITH {EM}, w AS (SELECT vec_id, label, max(x) - min(x) AS span, count(*) FILTER (WHERE isnan(x) OR isinf(x)) AS bad FROM em GROUP BY ALL)
SELECT label, count(*) AS windows, round(avg(span), 6) AS span, sum(bad)::BIGINT AS bad FROM w GROUP BY label""")
def window_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = A.windows(spark, sf_dir)
    span = bind(F.col("samples"), lambda a: F.array_max(a) - F.array_min(a))
    bad = F.size(F.filter("samples", lambda v: ~is_finite(v)))
    return w.groupBy("label").agg(F.count("*").alias("windows"), r6(F.avg(span), "span"), F.sum(bad).alias("bad"))
