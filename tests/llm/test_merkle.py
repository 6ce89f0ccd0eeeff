from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidefold.llm import merkle

KIND = "doc_id long, source string, lang string, n_chars long, text string, leaf string"
H = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def tree(leaves):
    """The root of a list of digests, and each leaf's siblings: (place, others) by level."""
    steps, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for s, i in zip(steps, range(len(leaves)), strict=True):
            run = nodes[at[i] // 8 * 8 : at[i] // 8 * 8 + 8]
            s.append((at[i] % 8, run[: at[i] % 8] + run[at[i] % 8 + 1 :]))
            at[i] //= 8
        nodes = [H("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], steps


def brute(rows, changed=lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 0):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = {}
    for r in rows:
        own = H("".join(map(field, r[:5])))
        groups.setdefault(r[2], []).append((r[0], own, H("".join(map(field, (*r[:4], lower(r[4]))))) if changed(r[0]) else own))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    below = {g: tree([x[1] for x in groups[g]]) for g in names}
    root, above = tree([below[g][0] for g in names]) if names else (None, [])
    out = []
    for g, up in zip(names, above, strict=True):
        for (key, own, other), steps in zip(groups[g], below[g][1], strict=True):
            f, proof = other, ""
            for slot, others in steps + up:
                f, proof = H("".join([*others[:slot], f, *others[slot:]])), proof + "".join(others)
            out.append((key, own, below[g][0], root, H(proof), f, f == root))
    return sorted(out, key=str)


def ran(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, "own") for r in rows], KIND).repartition(parts)
    got = merkle.document_manifest(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    assert got.columns == list(NAMES)
    return sorted((tuple(r) for r in got.collect()), key=str)


def rows_of(sizes):
    return [(1000 * k + i, None if i % 4 == 0 else f"s{i % 3}", g, None if i % 5 == 0 else i, [f"Text {i} É", None, "", "lower", "A" * i][i % 5]) for k, (g, n) in enumerate(sizes.items()) for i in range(n)]


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9}, {None: 1, "": 2, "a": 64, "é": 65, "z": 7}, {f"g{k:03}": 1 + k % 3 for k in range(70)}])
def test_manifest_equals_brute_force(spark, sizes):
    rows = rows_of(sizes)
    assert ran(spark, rows) == brute(rows)


def test_ties_repeated_rows_null_keys_and_empty_tables(spark):
    rows = [(1, "s", "en", 3, "ABC")] * 30 + [(1, "s", "en", 3, "abc"), (None, None, None, None, None), (None, "s", "en", 1, "X"), (None, "s", "en", 1, "X"), (2, "s", "de", 0, "")]
    assert ran(spark, rows) == brute(rows)
    assert ran(spark, []) == []


def test_groups_over_partition_borders(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SORTED", 7)
    monkeypatch.setattr(merkle, "STEP", 9)
    rows = rows_of({"a": 3, "b": 90, "c": 1, "d": 1, "e": 40})
    assert ran(spark, rows) == brute(rows)


def test_very_long_text(spark):
    rows = [(i, "s", "en", 1, "Word " * 400_000 if i == 3 else "x") for i in range(10)]
    assert ran(spark, rows) == brute(rows)


def test_proofs_hold_alone_and_a_missing_child_is_an_error(spark):
    df = spark.createDataFrame([(*r, "own") for r in rows_of({"a": 20, "b": 3})], KIND)
    leaves = df.select("doc_id", "lang", merkle.leaf(F.col("text")).alias("leaf"))
    tree_ = merkle.build(leaves)
    got = merkle.proofs(leaves, tree_).collect()
    assert len(got) == 23 and all(merkle.fold(bytes(r.leaf), [(s.slot, bytes(s.others)) for s in r.steps]) == tree_.root for r in got)
    with pytest.raises(RuntimeError):
        merkle._family(((0, 0), [(0, 3, b""), (2, 3, b"")]))
