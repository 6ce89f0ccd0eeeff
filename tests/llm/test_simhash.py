from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from tidefold.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    value = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def brute_classes(fps):
    """Smallest member of each value's component over differences of 2 bits or fewer."""
    left, root = set(fps), {}
    values = np.array(sorted(left), np.int64)
    while left:
        todo, seen = [min(left)], set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [int(y) for y in values[np.bitwise_count((values ^ x).view(np.uint64)) <= 2]]
        root |= dict.fromkeys(seen, min(seen))
        left -= seen
    return root


def flipped(x, bits):
    for b in bits:
        x ^= (1 << b) if b < 63 else -(1 << 63)
    return x


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c", "a b c a b c a b c", "É é É é x y", "Za " * 40000])
def test_fingerprint_follows_its_definition(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_anchors_cover():
    rng = np.random.default_rng(1)
    fps = rng.integers(-(2**63), 2**63 - 1, 300, dtype=np.int64)
    mask = (1 << 46) - 1
    near = simhash.nearest_anchor(fps)
    swap = (fps & ((1 << 23) - 1)) << 23 | (fps >> 23 & ((1 << 23) - 1))
    assert np.bitwise_count(near ^ swap & mask).max() <= 6
    rows, anchors = simhash.anchors_in_reach(fps)
    assert (np.bitwise_count(anchors ^ swap[rows]) <= simhash.REACH).all()
    assert 60 < len(rows) / len(fps) < 95
    for k in range(0, 300, 10):
        reach = set(anchors[rows == k].tolist())
        assert len(reach) == (rows == k).sum()
        for a in range(64):
            for b in range(a, 64, 7):
                assert int(simhash.nearest_anchor(np.array([flipped(int(fps[k]), {a, b})], np.int64))[0]) in reach


def test_components_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    fps = {rng.getrandbits(63) for _ in range(150)} | {0, -1}
    for x in list(fps)[:60]:
        for _ in range(rng.choice([1, 2, 5])):
            x = flipped(x, rng.sample(range(64), rng.choice([1, 2, 2, 3])))
            fps.add(x)
    base = rng.getrandbits(63)  # a crowd, and a chain
    fps |= {flipped(base, rng.sample(range(64), rng.choice([1, 2, 3]))) for _ in range(120)}
    x = base
    for i in range(0, 64, 2):
        x = flipped(x, [i, i + 1])
        fps.add(x)
    want = brute_classes(fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    for more in (None, 3, 16):
        got = dict(simhash.connected_components(simhash.links(frame, more)).collect())
        assert {f: got.get(f, f) for f in fps} == want


@pytest.mark.parametrize("more", [1, 4, 16])
def test_more_anchors_cover(more):
    rng = np.random.default_rng(more)
    fps = rng.integers(-(2**63), 2**63 - 1, 20, dtype=np.int64)
    rows, anchors = simhash.anchors_in_reach(fps, more)
    for k, f in enumerate(fps):
        reach = set(anchors[rows == k].tolist())
        assert len(reach) == (rows == k).sum()
        near = simhash.nearest_anchor(np.array([flipped(int(f), {a, b}) for a in range(64) for b in range(a, 64)], np.int64), more)
        assert set(near.tolist()) <= reach


def test_near_duplicates(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    rows = [(5, text, 1), (3, text.upper(), 2), (9, None, 3), (8, "", 4), (7, "other words altogether in this text", 5), (7, "other words altogether in this text", 5), (None, text, 6)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id int"))
    got = sorted(((r.doc_id, r.component_id) for r in out.collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 8), (8, 8), (7, 7), (7, 7), (None, 3)], key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one_row_of_each_class_whatever_the_ids(spark):
    one, two, three = ("the quick brown fox jumps over the lazy dog and runs far away", "other words altogether in this text of another kind", "nothing of what was said before is repeated in this line")
    rows = [(1, one, "a"), (5, one, "b"), (5, two, "c"), (None, three, "d"), (None, three, "d"), (None, one, "e"), (7, three.upper(), "f"), (9, "", "g"), (9, None, "h")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, more string").repartition(3))
    assert sorted(got.collect()) == [(1, one, "a"), (5, two, "c"), (7, three.upper(), "f"), (9, None, "h")]
    none = simhash.keep_one(spark.createDataFrame([(None, one), (None, one), (None, two)], "doc_id long, text string")).collect()
    assert sorted(r.text for r in none) == sorted([one, two])
