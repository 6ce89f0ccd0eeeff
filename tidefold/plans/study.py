"""Queries of a whole study's steps: guards, lookups, extraction, comparisons; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns
from ..model import CELL, SESSION
from ..operators import decoding, features, fluctuation, fold_audit, inference, selection, summaries, timescale
from ..sources import writers
from ..streaming import growing
from . import adapters as A
from .queries import HALVES, HORIZONS, SCALES, TASKS, _half, _thinned
from .registry import ORACLE_SQL, query, r6
from .sql import C4, EM, EV, FI, LI, PR, PROFILES

# Folds


@query(f"WITH {FI} SELECT {C4}, role, base_index, window_from, window_from + 2048 AS window_to FROM fi")
def checked_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = A.fold_index(spark, sf_dir).withColumn("window_to", F.col("window_from") + 2048)
    return fold_audit.check_folds(index, 2048).select(*CELL, "role", "base_index", "window_from", "window_to")


@query(f"WITH {EV} SELECT DISTINCT test_subject, test_trial, window_from FROM ev")
def window_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_audit.distinct_windows(A.events(spark, sf_dir))


@query(f"WITH {FI} SELECT DISTINCT {C4}, role, CASE WHEN role = 'train' THEN (test_subject + 1) % 6 ELSE test_subject END AS src_subject, CASE WHEN role = 'train' THEN 1 - test_trial ELSE test_trial END AS src_trial FROM fi WHERE role <> 'val'")
def fold_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train rows come from the next subject's other session, test rows from their own; validation rows from all over."""
    train = F.col("role") == "train"
    subject = F.when(F.col("role") == "val", F.col("base_index") % 6).when(train, (F.col("test_subject") + 1) % 6).otherwise(F.col("test_subject"))
    index = A.fold_index(spark, sf_dir).withColumn("src_subject", subject.cast("int")).withColumn("src_trial", F.when(train, 1 - F.col("test_trial")).otherwise(F.col("test_trial")))
    return fold_audit.single_source(index)


@query(f"WITH {LI} SELECT model, subject, trial, task, round(auroc, 6) AS auroc FROM cells WHERE (subject, trial) IN ((1, 1), (2, 0), (5, 1))")
def sessions_of_a_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.only_sessions(A.cells(spark, sf_dir), ["1_1", "s2_t0", "btbank5_1"]).select("model", *SESSION, "task", r6("auroc", "auroc"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20")
def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.first_rows(A.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), 20, "o_orderdate", "o_orderkey")


# Features

L1H = """lv AS (SELECT vec_id, ln(var_pop(x)) AS l1 FROM em GROUP BY vec_id),
hm AS (SELECT vec_id, scale, q, pow(avg(pow(rms, q)), 1 / q) AS f FROM rm, (SELECT unnest([1, 2, 3, 5]::DOUBLE[]) AS q) z GROUP BY vec_id, scale, q),
hq AS (SELECT vec_id, q, regr_slope(log2(f + 2.220446049250313e-16::DOUBLE), log2(scale)) AS h FROM hm GROUP BY vec_id, q)"""


@query(f"""WITH {PR}, {L1H} SELECT vec_id, 0 AS place, round(l1, 6) AS value FROM lv
UNION ALL SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY q))::INT, round(h, 6) FROM hq WHERE q IN (1, 2, 5)""")
def amplitude_and_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log variance, then some of the exponents, in one array."""
    rows = fluctuation.hq_of_order(A.windows(spark, sf_dir), SCALES, (1.0, 2.0, 3.0, 5.0), 1)
    some = features.q_subset("hq", (1.0, 2.0, 3.0, 5.0), (1.0, 2.0, 5.0))
    both = features.refuse_non_finite(features.amplitude_and_dynamics(features.log_variance("samples"), some))
    return rows.select("vec_id", F.posexplode(both).alias("place", "v")).select("vec_id", "place", r6("v", "value"))


@query(f"""WITH {EM}, ch AS (SELECT vec_id // 4 AS "window", vec_id % 4 AS c, i, x FROM em)
SELECT "window", (row_number() OVER (PARTITION BY "window" ORDER BY c DESC, i) - 1)::INT AS place, round(x, 6) AS value FROM ch""")
def flattened_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four vectors a window as its channels, the last first."""
    rows = A.windows(spark, sf_dir).select(F.floor(F.col("vec_id") / 4).alias("window"), (-(F.col("vec_id") % 4)).alias("c"), F.col("samples").alias("x"))
    flat = features.flatten_channels(rows, ["window"], "c", "x")
    return flat.select("window", F.posexplode("features").alias("place", "v")).select("window", "place", r6("v", "value"))


FLAT = """fw AS (SELECT vec_id, label, i, CASE WHEN vec_id % 5 = 0 THEN 1.5 ELSE x END AS x FROM em), fm AS (SELECT vec_id, label, max(x) = min(x) AS flat FROM fw GROUP BY ALL)"""


def _partly_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of which every fifth is constant."""
    return A.windows(spark, sf_dir).withColumn("samples", F.when(F.col("vec_id") % 5 == 0, F.transform("samples", lambda v: F.lit(1.5))).otherwise(F.col("samples")))


@query(f"WITH {EM}, {FLAT} SELECT label, count(*) AS n_windows, count(*) FILTER (WHERE flat) AS n_flat FROM fm GROUP BY label HAVING count(*) FILTER (WHERE flat) > 0")
def flat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.flat_window_counts(_partly_flat(spark, sf_dir), ["label"])


@query(f"WITH {EM}, {FLAT} SELECT vec_id, NOT flat AS kept FROM fm")
def not_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.keep_not_constant(fluctuation.flat_run(_partly_flat(spark, sf_dir)), ["vec_id"], n=64)


@query(f"WITH {EM}, {FLAT} SELECT label, count(*) AS n, count(*) FILTER (WHERE flat) AS n_undefined FROM fm GROUP BY label")
def undefined_variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _partly_flat(spark, sf_dir).withColumn("log_var", features.log_variance("samples", "nan"))
    return features.undefined_counts(rows, ["label"], "log_var")


@query("SELECT l_orderkey, l_linenumber, o_orderdate, round(o_totalprice, 6) AS o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with its order; a line without one would be an error."""
    lines = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    found = features.lookup_all(lines, A.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), ["o_orderkey"])
    return found.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "o_orderdate", r6("o_totalprice", "o_totalprice"))


GA = """ga AS (SELECT em.vec_id, s.s AS window_from, i - s.s AS i, x FROM em, (SELECT unnest([0, 8, 16]) AS s) s WHERE i >= s.s AND i < s.s + 48 AND (s.s < 16 OR em.vec_id % 2 = 0))"""


def _traces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors as traces of 64 samples, and starts of windows of 48: two, or three where the number is even."""
    traces = A.windows(spark, sf_dir).select("vec_id", F.col("samples").alias("trace"))
    starts = traces.select("vec_id", F.explode(F.when(F.col("vec_id") % 2 == 0, F.array(*map(F.lit, (16, 0, 8)))).otherwise(F.array(*map(F.lit, (0, 8, 0))))).alias("window_from"))
    return traces, starts


@query(f"WITH {EM}, {GA} SELECT vec_id, window_from::INT AS window_from, i::INT AS i, round(x, 6) AS x FROM ga")
def gathered_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.gather(*_traces(spark, sf_dir), ["vec_id"], 48)
    return rows.select("vec_id", "window_from", F.posexplode("samples").alias("i", "v")).select("vec_id", "window_from", "i", r6("v", "x"))


@query(f"""WITH {EM}, {GA}, mu AS (SELECT vec_id, window_from, avg(x) AS m, ln(var_pop(x)) AS log_var FROM ga GROUP BY ALL),
pr AS (SELECT g.vec_id, g.window_from, i, sum(x - m) OVER (PARTITION BY g.vec_id, g.window_from ORDER BY i) AS y FROM ga g JOIN mu ON g.vec_id = mu.vec_id AND g.window_from = mu.window_from),
sg AS (SELECT vec_id, window_from, s AS scale, i // s AS segment, i % s AS t, y FROM pr, (SELECT unnest([8, 9, 10, 12]) AS s) z WHERE i < (48 // s) * s),
rw AS (SELECT vec_id, window_from, scale, segment, sqrt(greatest(regr_syy(y, t) - regr_sxy(y, t) * regr_sxy(y, t) / regr_sxx(y, t), 0) / count(*)) AS r FROM sg GROUP BY ALL),
fl AS (SELECT vec_id, window_from, scale, coalesce(median(CASE WHEN r > 0 THEN r END) * 0.001, 0) AS f FROM rw GROUP BY ALL),
f2 AS (SELECT rw.vec_id, rw.window_from, rw.scale, sqrt(avg(pow(greatest(r, f, 2.220446049250313e-16::DOUBLE), 2))) AS f FROM rw JOIN fl ON rw.vec_id = fl.vec_id AND rw.window_from = fl.window_from AND rw.scale = fl.scale GROUP BY ALL),
h2 AS (SELECT vec_id, window_from, regr_slope(log2(f + 2.220446049250313e-16::DOUBLE), log2(scale)) AS h FROM f2 GROUP BY ALL),
fr AS (SELECT vec_id, window_from, sum(x * (0.5 - 0.5 * cos(2 * pi() * (i - 16) / 16))) / 8 AS level FROM ga WHERE i BETWEEN 16 AND 31 GROUP BY ALL)
SELECT mu.vec_id, mu.window_from::INT AS window_from, round(log_var, 6) AS log_var, round(h, 6) AS h2, 1 AS run, 13 AS frames, round(abs(level), 6) AS middle
FROM mu JOIN h2 ON mu.vec_id = h2.vec_id AND mu.window_from = h2.window_from JOIN fr ON mu.vec_id = fr.vec_id AND mu.window_from = fr.window_from""")
def extracted_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of every window of every trace; of the spectrum the number of frames and one's mean level."""
    rows = features.extract(*_traces(spark, sf_dir), ["vec_id"], (8, 9, 10, 12), (1.0, 2.0), 48, fs=48.0, window=16, max_hz=24.0)
    return rows.select("vec_id", "window_from", r6("log_var", "log_var"), r6(F.col("hq")[1], "h2"), "run", F.size("spec").alias("frames"), r6(F.col("spec")[6][0], "middle"))


def _setting_sql(largest: int, order: int, scales: list[int]) -> str:
    parabola = "" if order == 1 else " - pow(regr_sxy(y, t * t - (s * s - 1) / 12), 2) / regr_sxx(y, t * t - (s * s - 1) / 12)"
    return f"""SELECT vec_id, {largest} AS s_max, {order} AS polynomial, round(regr_slope(log2(f + 2.220446049250313e-16::DOUBLE), log2(scale)), 6) AS h2 FROM (
  SELECT rw.vec_id, rw.scale, sqrt(avg(pow(greatest(r, f, 2.220446049250313e-16::DOUBLE), 2))) AS f FROM
    (SELECT vec_id, scale, r, coalesce(median(CASE WHEN r > 0 THEN r END) OVER (PARTITION BY vec_id, scale) * 0.001, 0) AS f FROM
      (SELECT vec_id, scale, segment, sqrt(greatest(regr_syy(y, t) - pow(regr_sxy(y, t), 2) / regr_sxx(y, t){parabola}, 0) / count(*)) AS r FROM
        (SELECT vec_id, s AS scale, i // s AS segment, i % s - (s - 1) / 2.0::DOUBLE AS t, s::DOUBLE AS s, y FROM pr, (SELECT unnest({scales}) AS s) z WHERE i < (64 // s) * s) sg GROUP BY ALL) r0) rw GROUP BY ALL) z GROUP BY vec_id"""


SMALL_SETTINGS = ((12, 1), (16, 1), (24, 1), (12, 2), (16, 2))


@query(f"WITH {PROFILES} " + " UNION ALL ".join(f"({_setting_sql(m, o, columns.geometric_scales(8 * m, 6, 12, m))})" for m, o in SMALL_SETTINGS))
def sensitivity_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-order exponents at five settings of largest scale and order, here small enough for vectors of 64."""
    rows = fluctuation.sensitivity(A.windows(spark, sf_dir), ["vec_id"], (2.0,), SMALL_SETTINGS, smallest=6)
    return rows.select("vec_id", "s_max", "polynomial", r6(F.col("hq")[0], "h2"))


@query("""SELECT user_id % 50 AS "window", event_type AS region, round(avg(value / 3), 6) AS value FROM events WHERE event_type IN (SELECT event_type FROM events WHERE user_id % 2 = 0 INTERSECT SELECT event_type FROM events WHERE user_id % 2 = 1) GROUP BY ALL""")
def averaged_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values (a third, so that means aren't halves of the last digit kept) averaged over the electrodes of regions that both subjects have: users as electrodes, kinds as regions."""
    e = A.table(spark, sf_dir, "events")
    of = lambda k: e.where(F.col("user_id") % 2 == k).select(F.col("event_type").alias("region")).distinct()
    electrode = F.concat_ws("-", "event_type", "user_id")
    rows = e.select((F.col("user_id") % 50).alias("window"), electrode.alias("electrode"), (F.col("value") / 3).alias("value"))
    regions = e.select(electrode.alias("electrode"), F.col("event_type").alias("region")).distinct()
    return features.region_means(rows, regions, of(0).intersect(of(1)), ["window"]).select("window", "region", r6("value", "value"))


# Words and time

WORDS = """wd AS (SELECT l_suppkey % 3 AS session, l_orderkey * 10 + l_linenumber AS est_idx, l_linenumber, l_orderkey, l_quantity, l_discount, l_tax, l_extendedprice, l_linestatus, l_returnflag FROM lineitem)"""


@query(f"""WITH {WORDS}, v AS (SELECT session, est_idx, l_quantity AS volume, l_discount / 3 AS delta_volume, l_tax AS gpt2_surprisal, l_extendedprice / 7 AS frame_brightness, l_extendedprice / 11 AS global_flow, l_extendedprice * l_tax AS local_flow, length(l_linestatus || l_returnflag)::DOUBLE AS word_length,
  (l_linenumber = 1)::INT::DOUBLE AS onset, (l_linenumber > 2)::INT::DOUBLE AS face_num, (l_linenumber = 1)::INT::DOUBLE AS word_index, (l_quantity::INT % 2 = 0)::INT::DOUBLE AS word_head_pos, (l_quantity > 25)::INT::DOUBLE AS word_part_speech,
  CASE WHEN lag(l_orderkey) OVER w = l_orderkey THEN est_idx::DOUBLE - (lag(est_idx) OVER w + 0.5) END AS word_gap, 1.0::DOUBLE AS speech, pitch FROM wd JOIN (SELECT est_idx, max(l_quantity * l_linenumber) AS pitch FROM wd GROUP BY est_idx) pp USING (est_idx) WINDOW w AS (PARTITION BY session ORDER BY est_idx))
SELECT task, count(*) AS n, count(value) AS known, round(avg(value), 6) AS mean FROM (UNPIVOT v ON volume, delta_volume, gpt2_surprisal, frame_brightness, global_flow, local_flow, word_length, pitch, onset, face_num, word_index, word_head_pos, word_part_speech, word_gap, speech INTO NAME task VALUE value) u GROUP BY task
UNION ALL SELECT 'word_gap_missing', count(*), 0, NULL FROM v WHERE word_gap IS NULL""")
def task_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All variables of words made of order lines, pitch from a side table: how many words have each, and its mean."""
    x, c = A.table(spark, sf_dir, "lineitem"), F.col
    at = (c("l_orderkey") * 10 + c("l_linenumber")).cast("double")
    words = x.select(
        (c("l_suppkey") % 3).alias("session"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("est_idx"), c("l_orderkey").alias("sentence"), at.alias("start"), (at + 0.5).alias("end"),
        c("l_quantity").alias("rms"), (c("l_discount") / 3).alias("delta_rms"), c("l_tax").alias("gpt2_surprisal"), F.when(c("l_linenumber") == 1, 1).otherwise(0).alias("is_onset"),
        F.when(c("l_linenumber") > 2, 1).otherwise(0).alias("face_num"), (c("l_linenumber") - 1).alias("idx_in_sentence"), (c("l_quantity").cast("int") % 2).alias("bin_head"),
        F.when(c("l_quantity") > 25, "VERB").otherwise("NOUN").alias("pos"), (c("l_extendedprice") / 7).alias("mean_pixel_brightness"), (c("l_extendedprice") / 11).alias("max_global_magnitude"),
        (c("l_extendedprice") * c("l_tax")).alias("max_vector_magnitude"), F.length(F.concat("l_linestatus", "l_returnflag")).alias("word_length"),
    )
    pitch = x.groupBy(columns.float_key(at).alias("key")).agg(F.max(c("l_quantity") * c("l_linenumber")).alias("pitch"))
    rows = timescale.word_variables(words, pitch, session=("session",))
    known = rows.where("value is not null").groupBy("task").agg(F.count("*").alias("n"), F.count("value").alias("known"), r6(F.avg("value"), "mean"))
    gaps = rows.where("task = 'word_gap' and value is null").agg(F.lit("word_gap_missing").alias("task"), F.count("*").alias("n"), F.lit(0).cast("long").alias("known"), F.lit(None).cast("double").alias("mean"))
    return known.unionByName(gaps)


# Comparisons


@query(f"WITH {LI} SELECT task AS electrode, model, round(avg(x), 6) AS mean_auroc FROM dec GROUP BY ALL")
def electrode_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.decoded(spark, sf_dir).select(F.col("rung").alias("model"), F.col("task").alias("electrode"), "test_auroc")
    return inference.electrode_means(rows, ["model"]).select("electrode", "model", r6("mean_auroc", "mean_auroc"))


@query("SELECT round(avg(l_tax), 6) AS first_jaccard, round(avg(l_discount), 6) AS second_jaccard FROM lineitem")
def suffix_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_tax").alias("first_jaccard"), F.col("l_discount").alias("second_jaccard"), "l_quantity")
    out = inference.suffix_means(rows)
    return out.select(*[r6(c, c) for c in out.columns])


@query(f"""WITH {LI}, {HALVES} SELECT a.model, count(*) AS n_sessions, round(avg(b.auroc - a.auroc), 6) AS mean, round(avg(a.auroc), 6) AS "default", round(avg(b.auroc), 6) AS converged
FROM ho a JOIN ho b USING (model, subject, trial) WHERE a.fold = 0 AND b.fold = 1 GROUP BY a.model""")
def converged_minus_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.decoded(spark, sf_dir)
    out = inference.converged_minus_default(_half(d, 0), _half(d, 1), TASKS)
    return out.select("model", "n_sessions", *[r6(c, c) for c in ("mean", "default", "converged")])


@query(f"""WITH {LI}, few AS (SELECT * FROM cells WHERE NOT (model = 'N' AND task = '7' AND round(auroc, 4) > 0.5)),
fo AS (SELECT model, subject, trial, avg(auroc) AS auroc FROM few GROUP BY ALL HAVING count(DISTINCT task) = 7)
SELECT 'A-N' AS comparison, count(*) FILTER (WHERE a.auroc IS NOT NULL AND b.auroc IS NOT NULL) AS n_sessions, round(avg(a.auroc - b.auroc), 6) AS mean_diff,
  coalesce(string_agg(coalesce(a.subject, b.subject) || '_' || coalesce(a.trial, b.trial), ',' ORDER BY coalesce(a.subject, b.subject), coalesce(a.trial, b.trial)) FILTER (WHERE a.auroc IS NULL OR b.auroc IS NULL), '') AS dropped, true AS inside
FROM (SELECT * FROM fo WHERE model = 'A') a FULL JOIN (SELECT * FROM fo WHERE model = 'N') b ON a.subject = b.subject AND a.trial = b.trial HAVING count(*) FILTER (WHERE a.auroc IS NOT NULL AND b.auroc IS NOT NULL) > 0""")
def paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n, dropped sessions, mean, and whether the interval holds the mean; intervals themselves are tested against published ones."""
    out = inference.compare(_thinned(A.cells(spark, sf_dir)), "A", "N", TASKS)
    inside = (F.col("ci_lo") <= F.col("mean_diff")) & (F.col("mean_diff") <= F.col("ci_hi"))
    return out.select("comparison", "n_sessions", r6("mean_diff", "mean_diff"), F.array_join("sessions_dropped", ",").alias("dropped"), inside.alias("inside"))


@query(f"""WITH {LI}, d AS (SELECT a.task, a.auroc - b.auroc AS d FROM cells a JOIN cells b USING (subject, trial, task) WHERE a.model = 'A' AND b.model = 'N'),
t AS (SELECT task, avg(auroc) AS tau FROM cells WHERE model = 'R' AND task <> '3' GROUP BY task)
SELECT task, count(*) AS n_sessions, round(avg(d), 6) AS mean, round(max(t.tau), 6) AS tau, true AS inside FROM d LEFT JOIN t USING (task) GROUP BY task""")
def paired_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = A.cells(spark, sf_dir)
    tau = cells.where("model = 'R' and task <> '3'").groupBy("task").agg(F.avg("auroc").alias("tau"))
    out = inference.compare_tasks(cells, "A", "N", tau)
    inside = (F.col("ci_lo") <= F.col("mean")) & (F.col("mean") <= F.col("ci_hi"))
    return out.select("task", "n_sessions", r6("mean", "mean"), r6("tau", "tau"), inside.alias("inside"))


@query()
def comparison_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and whole intervals of the comparisons above, of models, of tasks and of tolerances; tested against plain resampling."""
    d, cells = A.decoded(spark, sf_dir), A.cells(spark, sf_dir)
    models = inference.compare(_thinned(cells), "A", "N", TASKS).select("comparison", "n_sessions", F.col("mean_diff").alias("mean"), "ci_lo", "ci_hi")
    tasks = inference.compare_tasks(cells, "A", "N").select(F.concat(F.lit("fig_A_N_"), "task").alias("comparison"), "n_sessions", "mean", "ci_lo", "ci_hi")
    late = inference.converged_minus_default(_half(d, 0), _half(d, 1), TASKS).select(F.concat(F.lit("D4_"), "model").alias("comparison"), "n_sessions", "mean", "ci_lo", "ci_hi")
    return models.unionByName(tasks).unionByName(late)


@query(f"""WITH {LI}, t AS (SELECT task, round(avg(auroc) FILTER (WHERE model = 'R'), 3) AS tau, avg(auroc) FILTER (WHERE model = 'A') AS mean FROM cells GROUP BY task)
SELECT task, (row_number() OVER (ORDER BY tau, mean))::INT AS place FROM t""")
def task_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks in order of timescale, then mean."""
    of = lambda m: F.avg(F.when(F.col("model") == m, F.col("auroc")))
    tasks = A.cells(spark, sf_dir).groupBy("task").agg(F.round(of("R"), 3).alias("tau"), of("A").alias("mean"))
    ordered = tasks.orderBy("tau", "mean").agg(F.array_sort(F.collect_list(F.struct("tau", "mean", "task"))).alias("s"))
    return ordered.select(F.posexplode("s").alias("k", "t")).select("t.task", (F.col("k") + 1).alias("place"))


@query(f"""WITH {LI}, {HALVES} SELECT a.model, count(*) AS cells, round(max(abs(a.auroc - b.auroc)), 6) AS max_abs_diff FROM hc a JOIN hc b USING (model, subject, trial, task) WHERE a.fold = 0 AND b.fold = 1 GROUP BY a.model""")
def determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells scored twice, joined on their key: the largest difference."""
    d = A.decoded(spark, sf_dir)
    both = _half(d, 0).join(_half(d, 1).withColumnRenamed("auroc", "again"), ["model", *SESSION, "task"])
    return both.groupBy("model").agg(F.count("*").alias("cells"), r6(F.max(F.abs(F.col("auroc") - F.col("again"))), "max_abs_diff"))


@query(f"""WITH {LI}, n AS (SELECT task, CASE task WHEN '1' THEN 'one' WHEN '2' THEN 'two' ELSE 'other' END AS name, avg(auroc) AS m FROM cells GROUP BY task) SELECT task, name, round(m, 6) AS mean FROM n""")
def named_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from a map, with a default."""
    names = F.create_map(F.lit("1"), F.lit("one"), F.lit("2"), F.lit("two"))
    return A.cells(spark, sf_dir).groupBy("task").agg(columns.lookup(names, F.first("task"), "other").alias("name"), r6(F.avg("auroc"), "mean"))


@query(f"WITH {LI}, tt AS (SELECT model, avg(auroc) AS tau FROM cells WHERE model <> 'N' GROUP BY model) SELECT subject, trial, cells.model, task, round(tau, 6) AS tau FROM cells LEFT JOIN tt ON cells.model = tt.model")
def looked_up_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension joined from the left: null where it has no row."""
    cells = A.cells(spark, sf_dir)
    tau = cells.where("model <> 'N'").groupBy("model").agg(F.avg("auroc").alias("tau"))
    return cells.join(tau, "model", "left").select(*SESSION, "model", "task", r6("tau", "tau"))


@query(f"WITH {FI} SELECT {C4}, base_index, label FROM fi WHERE role = 'test' AND label IN (SELECT DISTINCT label FROM fi WHERE role = 'train' AND task = 'click')")
def labels_the_model_knows(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = A.fold_index(spark, sf_dir)
    return decoding.known_labels(index.where("role = 'test'"), index.where("role = 'train' and task = 'click'")).select(*CELL, "base_index", "label")


# Scalars


@query("""SELECT DISTINCT 's' || (user_id % 6) || '_t' || (user_id % 4) AS tag, (user_id % 6)::INT AS subject, (user_id % 4)::INT AS trial FROM events""")
def session_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = A.table(spark, sf_dir, "events").select(columns.session_tag(F.col("user_id") % 6, F.col("user_id") % 4).alias("tag")).distinct()
    return tags.withColumn("s", columns.parse_tag("tag")).select("tag", "s.subject", "s.trial")


#: CRC-32 by bytes and bits, in SQL: a table of 256 remainders, then one step a character of an ASCII text.
CRC = """b AS (SELECT n, n AS c, 0 AS k FROM (SELECT unnest(range(256))::BIGINT AS n) x UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM b WHERE k < 8),
tab AS (SELECT list(c ORDER BY n) AS t FROM b WHERE k = 8),
st AS (SELECT DISTINCT 'H' || l_linenumber || '_' || l_returnflag AS name, 4294967295::BIGINT AS c, 0 AS i FROM lineitem
  UNION ALL SELECT name, xor(t[(xor(c, ascii(substr(name, i + 1, 1))) & 255) + 1], c >> 8), i + 1 FROM st, tab WHERE i < length(name))"""


@query(f"WITH RECURSIVE {CRC} SELECT name, xor(c, 4294967295)::BIGINT AS seed FROM st WHERE i = length(name)")
def name_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = A.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("H"), F.col("l_linenumber").cast("string"), F.lit("_"), "l_returnflag").alias("name")).distinct()
    return names.withColumn("seed", columns.name_seed("name"))


@query("SELECT DISTINCT l_linenumber / 2.0::DOUBLE AS x, round_even(l_linenumber / 2.0::DOUBLE, 0) AS rounded FROM lineitem")
def halves_to_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") / 2.0).alias("x")).distinct()
    return rows.withColumn("rounded", columns.half_even("x").cast("double"))


@query("""WITH w AS (SELECT DISTINCT p_size * 40 + 200 AS n FROM part)
SELECT DISTINCT n, round_even(8 * exp(k * ln(greatest(16, n // 8) / 8.0::DOUBLE) / 11), 0)::BIGINT AS scale FROM w, (SELECT unnest(range(12)) AS k) b""")
def default_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geometric scales of windows whose lengths are a column."""
    lengths = A.table(spark, sf_dir, "part").select((F.col("p_size") * 40 + 200).alias("n")).distinct()
    return lengths.select("n", F.explode(columns.scales_of("n")).alias("scale"))


@query("""WITH e AS (SELECT event_type, user_id, value, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day FROM events)
SELECT event_type, count(*) AS n, count(DISTINCT day) AS days, true AS median_within, true AS p95_within, true AS users_within FROM e GROUP BY event_type""")
def summaries_over_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored sketches of values and users by kind and day, merged over days, held against the exact ranks and counts: within the stated errors?"""
    e = A.table(spark, sf_dir, "events").select("event_type", "user_id", "value", F.floor(A.micros() / 86400e6).cast("long").alias("day"))
    path = writers.scratch(spark, "summaries")
    summaries.add_days(e.where("day % 2 = 0"), path, ["event_type"], "day", "value", "user_id")
    summaries.add_days(e, path, ["event_type"], "day", "value", "user_id")
    days = writers.read_appended(spark, path, ["event_type", "day"]).groupBy("event_type").agg(F.count("*").alias("days"))
    found = summaries.estimates(summaries.over_days(e, path, ["event_type"], "day"), ["event_type"], {"median": 0.5, "p95": 0.95}).join(days, "event_type")
    ranks = e.join(found.select("event_type", "median", "p95"), "event_type").groupBy("event_type").agg(
        F.avg((F.col("value") < F.col("median")).cast("int")).alias("m0"), F.avg((F.col("value") <= F.col("median")).cast("int")).alias("m1"),
        F.avg((F.col("value") < F.col("p95")).cast("int")).alias("p0"), F.avg((F.col("value") <= F.col("p95")).cast("int")).alias("p1"), F.countDistinct("user_id").alias("users"),
    )
    off = 3 * summaries.RANK_ERROR
    within = lambda a, b, p: (F.col(a) <= p + off) & (F.col(b) >= p - off)
    near = F.abs(F.col("n_distinct") / F.col("users") - 1) <= summaries.DISTINCT_ERROR
    return found.join(ranks, "event_type").select("event_type", "n", "days", within("m0", "m1", 0.5).alias("median_within"), within("p0", "p1", 0.95).alias("p95_within"), near.alias("users_within"))


@query(ORACLE_SQL["train_test_adjacency"])
def growing_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacency over an index that comes in two runs of a stream, the earlier windows first."""
    path = writers.scratch(spark, "growing")
    index = A.stored_index(spark, sf_dir)
    middle = index.agg(F.expr("percentile_approx(window_from, 0.5)")).first()[0]
    for part in (F.col("window_from") < middle, F.col("window_from") >= middle):
        index.where(part).write.mode("append").parquet(f"{path}/index")
        rows = spark.readStream.schema(index.schema).parquet(f"{path}/index")
        pairs = growing.near_pairs(rows.where("role = 'test'"), rows.where("role = 'train'"), float(max(HORIZONS)), "30 days")
        growing.follow(pairs, f"{path}/pairs", f"{path}/state").awaitTermination()
    found = growing.adjacency(spark, f"{path}/pairs", index, HORIZONS)
    return found.select(*CELL, *[r6(f"within_{w}s", f"within_{w}s") for w in HORIZONS])
