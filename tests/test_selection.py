from __future__ import annotations

import random

import pytest
from conftest import FAILS

from tidefold.operators import selection


def scores(spark, rows):
    return spark.createDataFrame(rows, "electrode string, mean_auroc double")


def test_names(spark):
    df = scores(spark, [("LT1a12", 0.1), ("A-3", 0.2), ("7", 0.3)])
    got = {r.electrode: (r.stem, r.num) for r in selection.parse_names(df).collect()}
    assert got == {"LT1a12": ("LT1a", 12), "A-3": ("A", -3), "7": ("", 7)}
    for bad in ("abc", "x_3"):
        with pytest.raises(FAILS, match="no contact number"):
            selection.parse_names(scores(spark, [(bad, 0.1)])).collect()


def brute(rows, quota):
    names, out = {}, []
    for name, v in rows:
        names.setdefault(name[0], {})[int(name[1:])] = v
    runs = []
    for stem, nums in names.items():
        for n in sorted(nums):
            if runs and runs[-1][0] == stem and runs[-1][1][-1] == n - 1:
                runs[-1][1].append(n)
            else:
                runs.append((stem, [n]))
    runs.sort(key=lambda r: (-sum(names[r[0]][n] for n in r[1]) / len(r[1]), r[0], -len(r[1]), r[1][0]))
    for stem, nums in runs:
        if len(nums) > 1 and len(out) < quota - 1:
            out += [f"{stem}{n}" for n in nums][: quota - len(out)]
    return out


@pytest.mark.parametrize("quota", [2, 8, 120])
def test_runs_by_mean_until_the_quota(spark, quota):
    rng = random.Random(quota)
    rows = [(f"{s}{n}", rng.uniform(0.49, 0.53)) for s in "ABCD" for n in range(1, 20) if rng.random() < 0.7]
    got = selection.select_electrodes(scores(spark, rows), quota).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1, len(got) + 1))
    assert [r.electrode for r in got] == brute(rows, quota)


def test_unscored_run(spark):
    with pytest.raises(FAILS, match="no scored electrode"):
        selection.select_electrodes(scores(spark, [("A1", None), ("A2", float("nan"))])).collect()


def test_overlap_and_partners(spark):
    a, b = scores(spark, [("A1", 0.0), ("A2", 0.0)]), scores(spark, [("A2", 0.0), ("A3", 0.0), ("A3", 0.0)])
    assert tuple(selection.overlap(a, b).first()) == (2, 2, 1, 1 / 3)
    assert tuple(selection.overlap(a.limit(0), b.limit(0)).first()) == (0, 0, 0, 0.0)
    assert [r.electrode for r in selection.unknown(a, b).collect()] == ["A1"]
    s = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.2), (2, 0, 0.3)], "subject int, trial int, v double")
    assert sorted((r.subject, r.trial, r.partner_trial, r.v) for r in selection.partner_scores(s).collect()) == [(1, 1, 2, 0.2), (1, 2, 1, 0.1)]
