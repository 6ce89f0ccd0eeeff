from __future__ import annotations

import datetime
import random
import re

import pytest

from tidefold.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10):
    w, hit, found = brute_words(text), set(), set()
    for item, t in items:
        b = brute_words(t)
        n = min(window, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(w), len(hit), sorted(found)


def make(spark):
    rng = random.Random(4)
    pick = lambda n: " ".join(rng.choice("aa bb cc DD é ß 中文 x1".split()) for _ in range(n))
    items = [(i, pick(rng.choice([1, 2, 5, 10, 14, 30]))) for i in range(6)] + [(6, None), (7, "--- !!"), (8, "one two three"), (8, "unique words of ten in a row make one window here")]
    docs = [(i, pick(rng.randint(0, 60))) for i in range(40)] + [(90, None), (91, ""), (92, "One, TWO; three!"), (92, "One, TWO; three!"), (None, "x" * 20000), (93, "z UNIQUE words-of ten in a row make one window here. z"), (94, pick(3000))]
    return items, docs, spark.createDataFrame([(*i, "t") for i in items], "item_id long, text string, doc_id string"), spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, item_id int, spans string")


@pytest.mark.parametrize("most_words", [1_000_000, 25, 1])
def test_scan_equals_brute_force(spark, most_words):
    items, docs, benchmark, table = make(spark)
    got = decontaminate.scan(table, benchmark, most_words=most_words).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_hit, r.item_ids)) for r in got) == sorted(str((d, *brute(t, items))) for d, t in docs)
    assert all(sum(s["last"] - s["first"] for s in r.spans) == r.n_hit for r in got)


@pytest.mark.parametrize("most_words", [1_000_000, 4])
def test_texts_of_one_item_in_two_blocks(spark, most_words):
    items = [(8, "one two three"), (8, "four five six seven")]
    docs = [(1, "one two three x four five six seven")] * 2
    got = decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most_words=most_words).collect()
    assert [(r.n_hit, r.item_ids, [tuple(s) for s in r.spans]) for r in got] == [(7, [8], [(0, 3), (4, 8)])] * 2


@pytest.mark.parametrize("most_words", [1_000_000, 25])
def test_removal(spark, most_words):
    items, docs, benchmark, table = make(spark)
    kept = decontaminate.decontaminate(table, benchmark, most_words=most_words)
    assert kept.columns == table.columns
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str(d) for d in docs if not brute(d[1], items)[1])
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(table, benchmark, remove="spans", most_words=most_words).collect()}
    assert cut[93] == "z . z" and cut[90] is None and cut[91] == ""
    with pytest.raises(ValueError):
        decontaminate.decontaminate(table, benchmark, remove="words")


def test_empty_tables(spark):
    _, docs, benchmark, table = make(spark)
    assert decontaminate.scan(table.limit(0), benchmark).count() == 0
    assert {r.n_hit for r in decontaminate.scan(table, benchmark.limit(0)).collect()} == {0}
    assert decontaminate.decontaminate(table, benchmark.limit(0)).count() == len(docs)


def test_items_of_any_type_and_null_ids(spark):
    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"x {text} y"), (2, "nothing")], "doc_id long, text string")
    for kind, ids in (("int", [3, None]), ("date", [datetime.date(2020, 1, 1), None]), ("double", [1.5, None]), ("string", ["b", None])):
        bench = spark.createDataFrame([(i, text) for i in ids], f"item_id {kind}, text string")
        for most in (1, 1_000_000):
            got = {r.doc_id: (r.n_hit, list(r.item_ids)) for r in decontaminate.scan(docs, bench, most_words=most).collect()}
            assert got == {1: (11, ids), 2: (0, [])}


@pytest.mark.parametrize("remove", ["documents", "spans"])
def test_many_blocks_take_one_python_node_a_pass(spark, remove):
    """Each block is a job of its own, and what is removed doesn't depend on the blocks."""
    rng = random.Random(1)
    items = [(i, " ".join(rng.choice("abcdefgh") * 3 + str(rng.randint(0, 9)) for _ in range(12))) for i in range(20)]
    docs = [(i, f"start {items[i % 20][1]} middle {items[(i * 7 + 1) % 20][1]} end", "of") for i in range(60)] + [(99, "clean text", "row"), (100, None, "spans")]
    benchmark, table = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "of long, text string, spans string")
    one, many = (decontaminate.decontaminate(table, benchmark, remove, most_words=n) for n in (1000, 12))
    assert many.columns == table.columns and sorted(map(str, many.collect())) == sorted(map(str, one.collect()))
    assert many._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == (remove == "spans")


def test_very_long_text(spark):
    item = " ".join(f"w{i}" for i in range(10))
    text = "word " * 1_000_000 + item + " tail" * 1_000_000
    docs = spark.createDataFrame([(1, text), (2, "x" * 5_000_000)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontaminate.scan(docs, benchmark).collect()}
    assert got == {1: (2_000_010, 10, [7]), 2: (1, 0, [])}
