from __future__ import annotations

import hashlib
import random

import pytest

from tidefold.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def brute_mix(rows):
    """Serve words by finish time, then source, until the budget."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    target, copies = brute_targets(sizes), []
    for s in sizes:
        mine = sorted((hashlib.md5(("" if d is None else str(d)).encode()).hexdigest(), d is not None, d or 0, len((t or "").split()), k) for k, (d, t, x) in enumerate(rows) if x == s)
        for p in range(2):
            done = p * sizes[s]
            for *_, n, k in mine:
                done += n
                if n and target[s]:
                    copies.append((done / target[s], s is None, s or "", n, k))
    left, taken = int(1.5 * sum(sizes.values())), [0] * len(rows)
    for _, _, _, n, k in sorted(copies):
        taken[k] += min(n, left)
        left -= min(n, left)
    return sizes, target, taken


def make(seed, n):
    rng = random.Random(seed)
    sources = ["a", "b", "B", "é", None, "", "tiny"]
    return [(i if rng.random() < 0.95 else None, rng.choice([None, "", "w " * rng.randint(1, 50)]) if s != "tiny" else "one", s) for i in range(n) for s in [rng.choice(sources if rng.random() < 0.6 else ["a"])]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_equals_brute_force(spark, seed):
    rows = make(seed, 400)
    sizes, target, taken = brute_mix(rows)
    df = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, source string, target string")
    got = mixing.mix_sources(df.repartition(seed + 1)).collect()
    want = [(d, len((t or "").split()), sizes[s], round(target[s], 6), n) for (d, t, s), n in zip(rows, taken, strict=True)]
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.taken for r in got) == int(1.5 * sum(sizes.values()))
    for s in sizes:
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= 50


def test_draw_gives_whole_documents(spark):
    rows = make(5, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").where("doc_id is not null")
    times = {r.doc_id: r.draws for r in mixing.mix_sources(df).collect()}
    drawn = mixing.draw(df).collect()
    count = {}
    for r in drawn:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count == {k: v for k, v in times.items() if v}
    assert {(r.doc_id, r.text, r.source) for r in drawn} <= {tuple(r) for r in rows}


def test_draw_carries_the_draws_of_each_row(spark):
    rows = [(None if i % 3 else 5, f"t{i} " * (1 + i % 4), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times = sorted((r["size"], r.source_size, r.draws) for r in mixing.mix_sources(df).collect() for _ in range(r.draws))
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "ab"}
    drawn = [(len(r.text.split()), sizes[r.source]) for r in mixing.draw(df).collect()]
    assert sorted(drawn) == sorted(t[:2] for t in times)


def test_tables_without_words_or_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(empty).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {r.taken for r in mixing.mix_sources(none).collect()} == {0}


@pytest.mark.parametrize("rows_a_range", [7, 1 << 20])
def test_draw_interleaves_sources_and_keeps_clashing_columns(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(mixing, "ROWS_A_RANGE", rows_a_range)
    rows = [(None if i % 5 == 0 else i % 40, f"t{i} " * (1 + i % 7), "abc"[i % 3], i, "x", "y", 1.5) for i in range(200)]
    names = "doc_id long, text string, source string, _copy int, _id string, key string, _at double"
    df = spark.createDataFrame(rows, names)
    drawn = [tuple(r) for r in mixing.draw(df).collect()]
    assert set(drawn) <= set(rows) and len(drawn) == sum(r.draws for r in mixing.mix_sources(df).collect())
    target = {r.source: r.target for r in mixing.mix_sources(df).select("source", "target").distinct().collect()}
    done = dict.fromkeys(target, 0)
    for r in drawn:  # at any point each source has had its share of what was served, to a document or two
        done[r[2]] += len(r[1].split())
        served = sum(done.values())
        assert all(abs(n - served * target[s] / sum(target.values())) < 15 for s, n in done.items())
    assert mixing.draw(df.limit(0)).columns == df.columns and mixing.draw(df.limit(0)).count() == 0
