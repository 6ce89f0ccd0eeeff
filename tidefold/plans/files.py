"""Queries that write files and read them back by the readers of the audit; with SQL over what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns
from ..model import SESSION
from ..operators import inference, selection
from ..sources import readers, writers
from . import adapters as A
from .registry import query, r6
from .sql import C4, FI, LI, PA


@query(f"WITH {FI} SELECT {C4}, role, window_from, label FROM fi")
def index_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold index as compressed CSV, of which just some columns are read again."""
    path = writers.scratch(spark, "index")
    writers.write_csv(A.fold_index(spark, sf_dir).withColumn("split", F.lit("within")), path, "gzip")
    return readers.read_index(spark, path, ["test_subject", "test_trial", "task", "fold", "role", "window_from", "label"])


@query(f"""WITH {LI} SELECT model AS rung, subject AS test_subject, trial AS test_trial, task, fold, count(*) AS n, count(*) FILTER (WHERE model = 'A') AS counted, round(avg(x), 6) AS test_auroc FROM dec GROUP BY ALL""")
def results_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in one folder, in files of different columns in different order."""
    path, d = writers.scratch(spark, "results"), A.decoded(spark, sf_dir)
    keys = ["test_subject", "test_trial", "task", "fold", "rung"]
    writers.write_csv(d.where("rung = 'A'").select("test_auroc", *keys, F.lit(1).alias("n_excluded_plateau")), f"{path}/L1")
    writers.write_csv(d.where("rung <> 'A'").select("split", *keys, "test_auroc"), f"{path}/L2")
    rows = readers.read_decoded(spark, path, "L*")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count("n_excluded_plateau").alias("counted"), r6(F.avg("test_auroc"), "test_auroc"))


@query(f"WITH {LI} SELECT model, subject, trial, task, round(auroc, 6) AS auroc FROM cells")
def cells_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = writers.scratch(spark, "cells")
    writers.write_csv(A.cells(spark, sf_dir).withColumn("split", F.lit("within")), path)
    return readers.read_cells(spark, path).select("model", *SESSION, "task", r6("auroc", "auroc"))


@query(f"WITH {LI} SELECT subject, trial, model AS electrode, round(avg(x), 6) AS mean_auroc FROM dec GROUP BY ALL")
def electrodes_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of electrodes in a file for each session, which the file's name tells; sessions are some dozen."""
    path = writers.scratch(spark, "electrodes")
    means = A.decoded(spark, sf_dir).groupBy(F.col("test_subject").alias("subject"), F.col("test_trial").alias("trial"), F.col("rung").alias("electrode")).agg(F.avg("test_auroc").alias("m"))
    files = means.groupBy(columns.session_tag("subject", "trial").alias("tag")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", "electrode", "m"))), "\n").alias("lines"))
    for r in files.toLocalIterator():
        writers.write_text(spark, f"{path}/electrode_mean_{r['tag']}.csv", f"electrode,mean_auroc\n{r['lines']}\n")
    return readers.read_electrode_means(spark, path).select("subject", "trial", "electrode", r6("mean_auroc", "mean_auroc"))


@query(f"WITH {LI}, f AS (SELECT subject, trial, task, fold, avg(x) AS a FROM dec WHERE model = 'A' GROUP BY ALL) SELECT 'm' AS model, 'within' AS split, subject, trial, task, round(avg(a), 6) AS auroc FROM f GROUP BY subject, trial, task")
def leaderboard_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published model's folds as nested JSON, a file a task, sessions as keys."""
    path = writers.scratch(spark, "leaderboard")
    folds = A.decoded(spark, sf_dir).where("rung = 'A'").groupBy("test_subject", "test_trial", "task", "fold").agg(F.avg("test_auroc").alias("test_roc_auc"))
    tag = F.format_string("btbank%d_%d", "test_subject", "test_trial")
    nested = F.struct(F.struct(F.struct(F.collect_list(F.struct("test_roc_auc")).alias("folds")).alias("one_second_after_onset")).alias("population"))
    files = folds.groupBy("task", tag.alias("tag")).agg(nested.alias("s")).groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("tag", "s"))).alias("m"))
    for r in files.select("task", F.to_json(F.struct(F.col("m").alias("evaluation_results"))).alias("document")).toLocalIterator():
        writers.write_text(spark, f"{path}/population_{r['task']}.json", r["document"])
    return readers.read_leaderboard(spark, f"{path}/*.json", "m", "within").withColumn("auroc", F.round("auroc", 6))


@query(f"WITH {PA}, o AS (SELECT stem, electrode, row_number() OVER (PARTITION BY stem ORDER BY num) AS pos, dense_rank() OVER (ORDER BY stem) AS k FROM na) SELECT (k % 100)::INT AS subject, (k // 100)::INT AS trial, pos::INT AS pos, electrode FROM o")
def subsets_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of electrodes by session as one JSON object."""
    path = writers.scratch(spark, "subsets")
    names = selection.parse_names(A.electrodes(spark, sf_dir)).groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("num", "electrode"))).alias("s"))
    lists = names.withColumn("k", F.dense_rank().over(Window.orderBy("stem")))
    tag = F.format_string("s%d_t%d", (F.col("k") % 100).cast("int"), F.floor(F.col("k") / 100).cast("int"))
    document = lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(tag, F.transform("s", lambda x: x["electrode"]))))).alias("d")).first()["d"]
    writers.write_text(spark, path, document)
    return readers.read_subsets(spark, path)


@query("SELECT DISTINCT printf('%.5f', l_quantity + l_linenumber / 8.0::DOUBLE) AS key, round(l_quantity * l_linenumber, 6) AS pitch FROM lineitem")
def pitch_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A side table as a JSON object whose keys are numbers as text; keys come back with five decimals."""
    path = writers.scratch(spark, "pitch")
    rows = A.table(spark, sf_dir, "lineitem").select((F.col("l_quantity") + F.col("l_linenumber") / 8.0).alias("k"), (F.col("l_quantity") * F.col("l_linenumber")).alias("v")).distinct()
    entries = rows.select(F.col("k").cast("string").alias("k"), F.struct(F.col("v").alias("enhanced_pitch")).alias("v"))
    document = entries.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("d")).first()["d"]
    writers.write_text(spark, path, document)
    return readers.read_keyed_numbers(spark, path, "enhanced_pitch").withColumn("pitch", F.round("pitch", 6))


@query("""SELECT o_orderpriority AS name, max(o_orderkey) FILTER (WHERE o_orderkey % 2 = 1) AS bytes, true AS stamped FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1""")
def manifest_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that is added to twice: the later row of a name holds, whatever its time says."""
    path = writers.scratch(spark, "manifest")
    rows = A.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name"))
    writers.append_log(rows.agg(F.max("o_orderkey").alias("bytes")).withColumn("downloaded_utc", F.lit("2999-01-01T00:00:00+00:00")), path)
    writers.append_log(writers.stamped(rows.agg(F.max(F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderkey"))).alias("bytes"))), path)
    stamp = F.col("downloaded_utc").rlike(r"^2\d{3}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00$") & (F.col("downloaded_utc") < "2999")
    return readers.read_manifest(spark, path).select("name", "bytes", stamp.alias("stamped"))


@query(f"WITH {LI} SELECT model, subject, trial, task, round(auroc, 6) AS auroc FROM cells")
def appended_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells appended in two runs that overlap: none is there twice."""
    path, cells, on = writers.scratch(spark, "appended"), A.cells(spark, sf_dir), ["model", *SESSION, "task"]
    writers.append_new(cells.where("subject < 4"), path, on)
    writers.append_new(cells.where("subject > 1"), path, on)
    return writers.read_appended(spark, path, on).select(*on, r6("auroc", "auroc"))


@query(f"WITH {LI} SELECT model, subject, trial, task FROM cells WHERE NOT (model = 'A' AND subject < 3)")
def cells_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, cells, on = writers.scratch(spark, "done"), A.cells(spark, sf_dir), ["model", *SESSION, "task"]
    cells.where("model = 'A' and subject < 3").write.parquet(path)
    return writers.todo(cells.select(*on), path, on)


@query(f"WITH {LI} SELECT model, round(avg(x), 6) AS mean, count(*) AS n FROM dec GROUP BY model")
def documents_of_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document of results by model, and the numbers of a figure; read back."""
    path = writers.scratch(spark, "documents")
    rows = inference.electrode_means(A.decoded(spark, sf_dir).withColumn("electrode", F.col("rung"))).join(A.decoded(spark, sf_dir).groupBy(F.col("rung").alias("electrode")).agg(F.count("*").alias("n")), "electrode")
    writers.write_document(rows.select(F.col("electrode").alias("model"), F.col("mean_auroc").alias("mean")), f"{path}/document", "model")
    writers.write_numbers(rows.select(F.col("electrode").alias("model"), "n"), f"{path}/numbers")
    means = spark.read.text(f"{path}/document", wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<mean:double>>")).alias("model", "v"))
    return means.join(spark.read.json(f"{path}/numbers"), "model").select("model", r6("v.mean", "mean"), F.col("n").cast("long"))


@query("""WITH f AS (SELECT DISTINCT l_returnflag AS name FROM lineitem) SELECT name || '.txt' AS file, octet_length(encode('text of ' || name || chr(10)))::BIGINT AS bytes, sha256('text of ' || name || chr(10)) AS sha256 FROM f""")
def digests_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = writers.scratch(spark, "digests")
    for r in A.table(spark, sf_dir, "lineitem").select("l_returnflag").distinct().toLocalIterator():
        writers.write_text(spark, f"{path}/{r[0]}.txt", f"text of {r[0]}\n")
    return readers.file_digests(spark, path).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "bytes", "sha256")
