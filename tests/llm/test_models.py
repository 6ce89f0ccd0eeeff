from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.llm import langid, quality, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_of_held_out_texts(spark, docs):
    got = queries.op3_language_id(spark, SF).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.lang is not None]
    assert len(held) > 200 and np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert np.mean([r.rejected for r in got if langid.has_letter(r.text)]) < 0.005


def test_model_ignores_held_out_rows_and_other_columns(docs):
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    a = langid.fit(docs, learn, sample=50)
    b = langid.fit(docs.withColumn("lang", F.when(learn, F.col("lang")).otherwise("xx")).withColumn("source", F.lit("s")), learn, sample=50)
    assert a.languages == b.languages and np.array_equal(a.table, b.table) and (a.floor, a.strange) == (b.floor, b.strange)


def test_odd_texts(spark, docs):
    model = langid.fit(docs, F.lit(True), sample=60)
    rows = [(1, None), (2, ""), (3, "123 --- !!"), (4, "the one of this and that"), (4, "the one of this and that"), (None, "中文"), (5, "a" * 100_000)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, rejected string")
    got = langid.identify(df, model).collect()
    assert [(r.doc_id, r.lang_pred, r.score, r.rejected) for r in got if r.doc_id in (1, 2, 3)] == [(i, "und", 0.0, True) for i in (1, 2, 3)]
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 4}) == 1 and len(got) == len(rows)
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns and {1, 2, 3}.isdisjoint(r.doc_id for r in kept.collect())
    none = langid.fit(docs.where("false"), F.lit(True))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def test_other_languages_and_noise_are_rejected_and_known_texts_stay(docs):
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    held = docs.where(~learn).select("lang", "text").where("lang is not null and text is not null").collect()
    whole = langid.fit(docs, learn)
    assert langid.rejected(whole, [r.text for r in held if langid.has_letter(r.text)]) <= 0.005
    rng = np.random.default_rng(3)
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz   ")) for _ in range(400)) for _ in range(50)]
    other_script = ["".join(chr(c) for c in rng.integers(0x400, 0x44F, 200)) for _ in range(50)]
    assert langid.rejected(whole, noise) == langid.rejected(whole, other_script) == 1
    for out in ("fr", "de"):  # a language that is left out of training
        model = langid.fit(docs, learn & (F.col("lang") != out))
        assert langid.rejected(model, [r.text for r in held if r.lang == out]) > 0.9
        assert langid.rejected(model, [r.text for r in held if r.lang != out and langid.has_letter(r.text)]) <= 0.01


def brute_predict(model, text):
    """Subwords cut and hashed one by one, scores added up in a loop."""
    words = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in text.lower().encode()).split()
    line = b" " + b" ".join(words) + b" "
    buckets = []
    for n in langid.GRAMS:
        for i in range(len(line) - n + 1):
            gram = line[i : i + n]
            if b" " in gram[1:-1] or gram == b"  ":
                continue
            h = n * 0x9E3779B1 & 0xFFFFFFFF
            for b in gram:
                h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
            buckets.append(((h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF) >> 32 - 12)
    z = [model.intercept[k] + sum(model.table[b][k] for b in buckets) / max(1, len(buckets)) for k in range(len(model.languages))]
    p = [np.exp(v / model.temperature) for v in z]
    return model.languages[int(np.argmax(z))], max(p) / sum(p)


def test_scores_equal_brute_force(spark, docs):
    model = langid.fit(docs, F.lit(True), sample=40)
    some = docs.where("doc_id % 9 = 0 and length(text) < 3000")
    got = langid.identify(some, model).join(some, "doc_id").where("lang_pred <> 'und'").collect()
    assert len(got) > 50
    for r in got:
        name, score = brute_predict(model, r.text)
        assert r.lang_pred == name and abs(r.score - score) < 1e-9


@pytest.mark.parametrize(("text", "letters"), [("²³", False), ("Ⅷ 12", False), ("é", True), ("中", True), ("_ 9 ª", True), (None, False)])
def test_letters(text, letters):
    assert langid.has_letter(text) == letters


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(1)
    many = [(f"l{k:02}", "".join(chr(97 + i) for i in rng.integers(0, 26, 6))) for k in range(70)]
    rows = [(100 * k + i, f"{word} " * (3 + i), name) for k, (name, word) in enumerate(many) for i in range(1 if k == 69 else 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, F.lit(True))
    assert model.languages == [name for name, _ in many]
    assert np.mean([model.predict(f"{word} {word}")[0] == name for name, word in many]) > 0.95
    assert model.predict(f"{many[69][1]} {many[69][1]}")[0] == "l69"


def test_quality_of_held_out_texts(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.op8_quality(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.95


def test_boosted_tables_learn_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((1500, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.train(x, y, rounds=20)
    assert (0, 3) in model.pairs and np.mean((model.score(x) > 0.5) == y) > 0.9
    assert np.array_equal(model.score(x[:10]), model.score(x)[:10])


def brute_score(model, x):
    """One text's features looked up edge by edge."""
    at = [sum(v > e for e in edges) for v, edges in zip(x, model.edges, strict=True)]
    z = model.intercept + sum(t[k] for t, k in zip(model.tables, at, strict=True))
    z += sum(t[at[i] * quality.PAIR_BINS // quality.BINS][at[j] * quality.PAIR_BINS // quality.BINS] for (i, j), t in model.pairs.items())
    return 1 / (1 + np.exp(-z))


def test_quality_scores_equal_brute_force(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    learn = F.col("doc_id") % 2 == 0
    model = quality.fit(docs, labels, learn)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = quality.score_quality(docs.repartition(7), labels, learn).collect()
    assert len(got) == len(texts)
    assert all(abs(r.score - brute_score(model, quality.features(texts[r.doc_id]))) < 1e-9 for r in got)


def test_very_long_texts(spark):
    long = "word " * 400_000 + "end."
    df = spark.createDataFrame([(1, long), (2, "x" * 2_000_000), (3, "short text here.")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.score_quality(df, labels, F.lit(True)).collect())
    assert quality.features(long)[0] == pytest.approx(np.log1p(400_001))


def test_quality_of_odd_tables(spark):
    rows = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, "word " * 9, "t"), (3, "word " * 9, "t"), (None, "x", "t")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (9, 0, 0), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(rows, labels, F.lit(True)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert quality.score_quality(rows.limit(0), labels.limit(0), F.lit(True)).count() == 0
