from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import FAILS
from pyspark.sql import functions as F

from tidefold.operators import features, index_maps
from tidefold.sources import arrays

MAP = "key string, level int, position long, target long"


def composed(lists):
    """Lists from the outermost to the last, looked up one in the next."""
    idx = lists[0]
    for inner in lists[1:]:
        idx = [inner[i] for i in idx]
    return idx


def nest(rng, depth, size):
    lists, below = [], size
    for _ in range(depth):
        n = rng.randint(1, max(1, below))
        lists.append([rng.randrange(-below if lists else 0, below) for _ in range(n)])
        below = n
    return lists[::-1]


def rows_of(key, lists):
    return [(key, level, p, t) for level, x in enumerate(lists, 1) for p, t in enumerate(x)]


def test_composed_maps_equal_lists(spark):
    rng = random.Random(0)
    nests = {f"k{d}{i}": nest(rng, d, 20) for d in range(1, 8) for i in range(3)}
    rows = [r for k, x in nests.items() for r in rows_of(k, x)]
    rng.shuffle(rows)
    got = {}
    for r in index_maps.compose(spark.createDataFrame(rows, MAP), ["key"]).collect():
        got.setdefault(r.key, {})[r.position] = r.target
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: composed(x) for k, x in nests.items()}


def test_maps_without_key_and_empty(spark):
    rows = [(1, 0, 1), (1, 1, -1), (2, 0, 7), (2, 1, 5), (2, 2, -3)]
    got = index_maps.compose(spark.createDataFrame(rows, "level int, position int, target int"))
    assert sorted(map(tuple, got.collect())) == [(0, 5), (1, -3)]
    assert index_maps.compose(spark.createDataFrame([], MAP), ["key"]).count() == 0
    only_inner = spark.createDataFrame([("a", 2, 0, 0), (None, 1, 0, 0)], MAP)
    assert index_maps.compose(only_inner, ["key"]).count() == 0


@pytest.mark.parametrize(
    ("rows", "what"),
    [
        ([(1, 0, 2), (2, 0, 0), (2, 1, 0)], "place 2 is out of range"),
        ([(1, 0, -3), (2, 0, 0), (2, 1, 0)], "place -1 is out of range"),
        ([(1, 0, None), (2, 0, 0)], "place null is out of range"),
        ([(1, 0, 0), (2, 0, 4), (2, 0, 5)], "place 0 is there twice"),
        ([(1, 0, 0), (3, 0, 4)], "no map below level 1"),
    ],
)
def test_what_leads_nowhere_is_an_error(spark, rows, what):
    with pytest.raises(FAILS, match=what):
        index_maps.compose(spark.createDataFrame(rows, "level int, position long, target long")).collect()


def test_index_rows_name_what_they_lack(spark):
    maps = spark.createDataFrame(rows_of("a", [[1, 0], [4, 9]]), MAP)
    items = spark.createDataFrame([("a", 4, "x"), ("a", 9, "y")], "key string, base_index long, label string")
    got = index_maps.index_rows(maps, items, ["key"])
    assert sorted(map(tuple, got.select("key", "item", "base_index", "label").collect())) == [("a", 0, 9, "y"), ("a", 1, 4, "x")]
    with pytest.raises(FAILS, match="no features for"):
        index_maps.index_rows(maps, items.where("label = 'x'"), ["key"]).collect()


def saved(path, x):
    path.parent.mkdir(parents=True, exist_ok=True)
    np.save(path, x)


@pytest.mark.parametrize("kind", ["f2", "f4", "f8", "i1", "i2", "i4", "i8", "u1", "u2", "u4", "b1", ">f8", ">i4"])
def test_arrays_of_every_kind(spark, tmp_path, kind):
    x = np.arange(30).reshape(5, 2, 3).astype(kind)
    saved(tmp_path / "a.npy", x)
    got = sorted((r.row, r.values) for r in arrays.read_arrays(spark, str(tmp_path)).collect())
    assert got == list(enumerate(x.reshape(5, 6).tolist()))


def test_one_file_is_read_in_parts_whatever_their_size(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(1001, 7)).astype(np.float32)
    saved(tmp_path / "a.npy", x)
    saved(tmp_path / "b.npy", x[:3])
    saved(tmp_path / "c.npy", x[:0])
    for split in (1 << 20, 5000, 131, 7):
        df = arrays.read_arrays(spark, f"file://{tmp_path}", split=split)
        got = sorted((r.file, r.row, r.values) for r in df.collect())
        assert got == [("a.npy", i, r) for i, r in enumerate(x.tolist())] + [("b.npy", i, r) for i, r in enumerate(x[:3].tolist())]
        assert split > 5000 or df.rdd.getNumPartitions() > 5


def test_rows_asked_for_prune_parts(spark, tmp_path):
    saved(tmp_path / "x" / "a.npy", np.arange(5000.0).reshape(500, 10))
    path = str(tmp_path / "x" / "*.npy")
    some = arrays.read_arrays(spark, path, rows=(100, 103), split=400)
    assert [(r.row, r.values[0]) for r in some.orderBy("row").collect()] == [(100, 1000.0), (101, 1010.0), (102, 1020.0)]
    read = arrays.read_arrays(spark, path, split=400)
    assert some.rdd.getNumPartitions() <= 2 < 100 <= read.rdd.getNumPartitions()
    assert [r.row for r in read.where("row = 7").collect()] == [7] and read.count() == 500
    assert arrays.read_arrays(spark, path, rows=(500, 900)).count() == 0


def test_a_file_above_two_gigabytes(spark, tmp_path):
    """A sparse file: only some rows of its end are looked at."""
    big = np.lib.format.open_memmap(tmp_path / "big.npy", "w+", np.float32, (300_000, 2048))
    big[299_998] = 5
    big.flush()
    assert (tmp_path / "big.npy").stat().st_size > 2_400_000_000
    assert arrays.read_arrays(spark, str(tmp_path / "big.npy")).rdd.getNumPartitions() >= 18
    read = arrays.read_arrays(spark, str(tmp_path / "big.npy"), rows=(299_997, 300_000))
    got = read.selectExpr("row", "values[2047] as v").orderBy("row").collect()
    assert [(r.row, r.v) for r in got] == [(299_997, 0.0), (299_998, 5.0), (299_999, 0.0)]


def test_columns_are_aligned_and_only_those_asked_for_are_opened(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "array(id / 2, -id) as two", "id % 7 = 0 as seventh").repartition(3)
    path = str(tmp_path / "t")
    arrays.write_arrays(df, path, size=2000)
    back = arrays.read_arrays(spark, path)
    assert dict(back.dtypes) == {"file": "string", "row": "bigint", "id": "bigint", "two": "array<double>", "seventh": "boolean"}
    assert sorted((r.id, r.two, r.seventh) for r in back.collect()) == [(i, [i / 2, -i], i % 7 == 0) for i in range(1000)]
    assert len(list((tmp_path / "t" / "id").glob("*.npy"))) > 3
    with pytest.raises(FAILS, match="has arrays already"):
        arrays.write_arrays(df, path)
    for f in (tmp_path / "t" / "two").glob("*.npy"):
        f.write_bytes(b"broken")
    assert arrays.read_arrays(spark, path, "id long").agg({"id": "sum"}).first()[0] == 499_500
    arrays.write_arrays(df.where("id < 10"), path, "overwrite")
    arrays.write_arrays(df.where("id >= 990"), path, "append")
    assert sorted(r.id for r in arrays.read_arrays(spark, path, "id long").collect()) == [*range(10), *range(990, 1000)]


def test_what_is_no_table_of_rows_is_an_error(spark, tmp_path):
    for name, x in (("scalar", np.float64(3)), ("fortran", np.asfortranarray(np.ones((3, 4)))), ("text", np.array(["a"]))):
        saved(tmp_path / name / "a.npy", x)
        with pytest.raises(FAILS, match="arrays have an axis of rows"):
            arrays.read_arrays(spark, str(tmp_path / name)).collect()
    with pytest.raises(FAILS, match="has no column z"):
        saved(tmp_path / "t" / "a" / "1.npy", np.ones(3))
        arrays.read_arrays(spark, str(tmp_path / "t"), "z int").collect()
    saved(tmp_path / "t" / "b" / "1.npy", np.ones(4))
    with pytest.raises(FAILS, match="a has 3 rows, b has 4"):
        arrays.read_arrays(spark, str(tmp_path / "t")).collect()
    with pytest.raises(FAILS, match="nulls"):
        arrays.write_arrays(spark.createDataFrame([(None,)], "a int"), str(tmp_path / "n"))
    with pytest.raises(FAILS, match="different lengths"):
        arrays.write_arrays(spark.createDataFrame([([1],), ([1, 2],)], "a array<int>").coalesce(1), str(tmp_path / "l"))
    assert not list(tmp_path.glob("[nl]/*/*.npy"))


def test_chunks_of_an_array(spark, tmp_path):
    x = np.arange(1003, dtype=np.int32)
    saved(tmp_path / "a.npy", x)
    for split in (1 << 20, 700):
        got = sorted((r.row, r["values"]) for r in arrays.read_arrays(spark, str(tmp_path), chunk=10, split=split).collect())
        assert got == [(i, x[i : i + 10].tolist()) for i in range(0, 1003, 10)]
    saved(tmp_path / "b" / "y.npy", np.arange(24.0).reshape(6, 4))
    assert [(r.row, r["values"]) for r in arrays.read_arrays(spark, str(tmp_path / "b"), chunk=4).orderBy("row").collect()] == [(0, [float(i) for i in range(16)]), (4, [float(i) for i in range(16, 24)])]


@pytest.mark.parametrize(("length", "bins"), [(1, 5), (7, 16), (50, 1 << 16), (1000, 64)])
def test_windows_of_chunks_equal_slices(spark, length, bins):
    rng = np.random.default_rng(length)
    traces = {(s, e): rng.normal(size=130 + 10 * s).tolist() for s in (1, 2) for e in ("A", "B")}
    starts = [(s, w) for s in (1, 2) for w in (0, 3, 16, 64, 90, 90)] + [(9, 0)]
    df = spark.createDataFrame([(*k, v) for k, v in traces.items()], "s int, e string, trace array<double>")
    chunks = features.chunked(df, length).orderBy(F.rand(1))
    got = features.gather_chunks(chunks, spark.createDataFrame(starts, "s int, window_from long"), ["s"], ["e"], 40, bin_samples=bins)
    assert {(r.s, r.e, r.window_from): r.samples for r in got.collect()} == {(s, e, w): traces[s, e][w : w + 40] for s, w in starts if s < 9 for e in "AB"}


@pytest.mark.parametrize("bad", ["before", "behind", "far", "hole", "twice"])
def test_windows_that_chunks_do_not_cover(spark, bad):
    rows = [(1, i, [float(i)] * 10) for i in range(0, 100, 10) if bad != "hole" or i != 50] + ([(1, 45, [0.0] * 10)] if bad == "twice" else []) + [(1, 100, []), (1, 100, None)]
    start = {"before": -1, "behind": 81, "far": 5000}.get(bad, 40)
    chunks = spark.createDataFrame(rows, "s int, chunk_from long, trace array<double>")
    at = lambda w: features.gather_chunks(chunks, spark.createDataFrame([(1, w)], "s int, window_from long"), ["s"], n=20, bin_samples=16)
    with pytest.raises(FAILS, match="a window leaves its trace, or chunks overlap"):
        at(start).collect()
    assert len(at(10).first().samples) == 20
