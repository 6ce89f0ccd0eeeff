from __future__ import annotations

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tidefold.llm import queries, winnow

TEXTS = [None, "", " \t ", "one", "One two", "a b c d e", "a b c d e f g h i j k l m", "wor " * 40, "这是一个没有空格的中文句子用来测试", "mix 中文 and words here too", "É é ß ẞ x y z q r", "x\ny\tz  w v u t s"]


def brute_chosen(values):
    """Rightmost least of each window of WINDOW grams; (hash, place)."""
    n = len(values)
    out = []
    for i in range(max(1, n - winnow.WINDOW + 1) if n else 0):
        window = list(enumerate(values[i : i + winnow.WINDOW], i))
        least = min(v for _, v in window)
        place = max(k for k, v in window if v == least)
        if (least, place) not in out:
            out.append((least, place))
    return out


def test_fingerprints_are_the_rightmost_least_of_every_window(spark):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    safe = F.coalesce("text", F.lit(""))
    got = df.select("text", winnow.unpack(winnow.grams(safe)).alias("grams"), winnow.unpack(winnow.winnow(safe)).alias("fp"), winnow.units(safe).alias("units")).collect()
    for r in got:
        n = len(r["units"])
        assert [g["place"] for g in r["grams"]] == list(range(max(n - winnow.GRAM + 1, min(n, 1))))
        assert [(g["hash"], g["place"]) for g in r["fp"]] == brute_chosen([g["hash"] for g in r["grams"]]), r["text"]
        same = {}
        for g in r["grams"]:  # equal grams have equal hashes, different ones different
            gram = tuple(r["units"][g["place"] : g["place"] + winnow.GRAM])
            assert same.setdefault(g["hash"], gram) == gram
        assert len(set(same.values())) == len(same)


def test_shared_runs_share_a_hash(spark):
    rng = random.Random(2)
    rows = []
    for k in range(30):
        run = " ".join(str(rng.random()) for _ in range(winnow.WINDOW + winnow.GRAM - 1))
        pad = lambda: " ".join(str(rng.random()) for _ in range(rng.randint(0, 20)))
        rows.append((k, f"{pad()} {run} {pad()}", f"{pad()} {run} {pad()}"))
    df = spark.createDataFrame(rows, "k int, a string, b string")
    hashes = lambda c: F.transform(winnow.unpack(winnow.winnow(F.col(c))), lambda x: x["hash"])
    assert df.where(~F.arrays_overlap(hashes("a"), hashes("b"))).count() == 0


def brute_next(rows):
    u = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42) >> 1
    order = sorted(rows, key=lambda r: ((1, r[0]) if r[0] is not None else (0, 0), u(r[1]), (r[1] or "").encode()), reverse=True)
    return [(a[0], a[1] or "", b[1] or "") for a, b in zip(order, order[1:] + order[:1], strict=True)]


@pytest.mark.parametrize("size", [1, 5, 60])
@pytest.mark.parametrize("rows_a_range", [1, 1000])
def test_next_follows_descending_ids(spark, monkeypatch, size, rows_a_range):
    monkeypatch.setattr(winnow, "ROWS_A_RANGE", rows_a_range)
    rng = random.Random(size)
    rows = [(rng.choice([None, *range(-40, 40), 1 << 60]), rng.choice([*TEXTS, "t" * rng.randint(1, 9)])) for _ in range(size)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("r", F.lit(3)).withColumn("next_text", F.lit(""))
    got = winnow.with_next(df)
    assert "hashpartitioning(r" not in got._jdf.queryExecution().executedPlan().toString()  # texts are shuffled once
    assert sorted(map(str, ((r["doc_id"], r["text"], r["next_text"]) for r in got.collect()))) == sorted(map(str, brute_next(rows)))
    assert got.where(~F.col("next_packed").eqNullSafe(winnow.winnow(F.col("next_text")))).count() == 0


def test_empty_table(spark):
    assert winnow.with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate([*TEXTS, "a b c d e f g h i j k l m"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op4_fingerprints(spark, str(tmp_path)).collect()}
    text = {i: t or "" for i, t in rows}
    for i in text:
        following = text[i - 1] if i else text[len(text) - 1]
        half = len(text[i]) // 2
        edited = text[i][: len(text[i]) - half] + following[:half]
        assert got[i]["n_chars"] == len(text[i])
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[6]["fingerprint"] == got[12]["fingerprint"]
    assert got[1]["near_next"] == 1.0  # two texts without words


def test_hot_ids_are_cut_and_order_stays(spark, monkeypatch):
    monkeypatch.setattr(winnow, "ROWS_A_RANGE", 5)
    rng = random.Random(9)
    rows = [(rng.choice([None, 7, 7, 7, i]), f"t{rng.randint(0, 500)}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, ((r["doc_id"], r["text"], r["next_text"]) for r in winnow.with_next(df).collect()))) == sorted(map(str, brute_next(rows)))
    ids = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    with pytest.raises(ValueError, match="numbers"):
        winnow.with_next(ids)


def test_hashes_roll(spark):
    text = "a b c a b c d e f a b c d e f g h a a a a a a a"
    row = spark.createDataFrame([(text,)], "text string").select(winnow.numbers(F.col("text")).alias("u"), winnow.unpack(winnow.grams(F.col("text"))).alias("g")).first()
    h = 0
    for x in row.u[: winnow.GRAM]:
        h = (h * winnow.BASE + x) % winnow.PRIME
    rolled = [h]
    for first, new in zip(row.u, row.u[winnow.GRAM :], strict=False):
        h = ((h - first * winnow.BASE ** (winnow.GRAM - 1)) * winnow.BASE + new) % winnow.PRIME
        rolled.append(h)
    assert rolled == [g["hash"] for g in row.g]
