"""Boosted trees against a plain loop over rows, and their handling of layouts and odd values."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import recommend, trees

SCHEMA = "id long, a double, b double, y double"


def _table(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rng.choice([None, 0.0, 1.0, 2.5, 4.0]), float(rng.randint(0, 9))
        out.append((i, a, b, (3 if a is None else a) * (1 if b < 5 else -1) + rng.randint(-2, 2) / 4))
    return out


def _plain(data, rounds, depth, rate=0.2, l2=1.0):
    """Predictions of greedy second-order boosting, a node's rows cut at every value of every feature with nulls on either side."""
    base = sum(r[3] for r in data) / len(data)
    margin = {r[0]: base for r in data}

    def grow(rows, left):
        g, n = sum(margin[r[0]] - r[3] for r in rows), len(rows)
        best, score = None, lambda x, m: x * x / (m + l2)
        if left:
            for null_left, f in itertools.product((True, False), (1, 2)):
                for at in sorted({r[f] for r in data if r[f] is not None})[1:]:
                    side = [null_left if r[f] is None else r[f] < at for r in rows]
                    lo, hi = [r for r, s in zip(rows, side) if s], [r for r, s in zip(rows, side) if not s]
                    if lo and hi:
                        gl = sum(margin[r[0]] - r[3] for r in lo)
                        gain = score(gl, len(lo)) + score(g - gl, len(hi)) - score(g, n)
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = gain, lo, hi
        if best is None:
            return {r[0]: -rate * g / (n + l2) for r in rows}
        return grow(best[1], left - 1) | grow(best[2], left - 1)

    for _ in range(rounds):
        step = grow(data, depth)
        margin = {k: m + step[k] for k, m in margin.items()}
    return margin


def _predicted(model, df):
    return {r["id"]: r["prediction"] for r in trees.predict(model, df).collect()}


@pytest.mark.parametrize("rounds, depth", [(1, 1), (3, 3), (12, 2)])  # 12 rounds write margins once
def test_trees_equal_a_plain_loop(spark, rounds, depth):
    data = _table(150, 1)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = _predicted(trees.fit(df, "y", ("a", "b"), rounds=rounds, depth=depth), df)
    want = _plain(data, rounds, depth)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_a_model_is_the_same_however_rows_are_dealt(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.gauss(0, 100), rng.random() ** 3, rng.random() * 5) for i in range(3000)], SCHEMA)
    df = df.union(df.limit(1).crossJoin(spark.range(1500).select()))  # a third of all rows are one
    fits = [trees.fit(x, "y", ("a", "b"), rounds=4, depth=4) for x in (df.coalesce(1), df.repartition(7, "y"), df.orderBy(F.desc("a")))]
    for m in fits[1:]:
        assert m.base == fits[0].base and all((x == y).all() for k in ("edges", "feature", "cut", "null_left", "value") for x, y in zip(getattr(m, k), getattr(fits[0], k)))
    assert all(len(e) <= trees.BINS - 2 for e in fits[0].edges) and min(len(e) for e in fits[0].edges) > 40


def test_many_tasks_sum_to_one_tasks_histograms(spark):
    data = _table(400, 3)
    df = spark.createDataFrame(data, SCHEMA)
    model = trees.fit(df, "y", ("a", "b"), rounds=2, depth=2)
    bins = model.binned([np.array([r[k] for r in data], float) for k in (1, 2)])
    rows = [(bytes(b), 1, round(r[3] * trees.UNIT), model.base) for b, r in zip(bins, data)]
    cells = spark.createDataFrame(rows, "cell binary, n long, y long, margin double")
    one, many = (trees._summed(cells.repartition(k), model, 1, trees.BINS) for k in (1, 6))
    assert (one[0] == many[0]).all() and (one[1] == many[1]).all() and one[1][:, 0].sum() == 400


def test_trees_learn_a_rule_that_rows_left_out_obey(spark):
    rng = random.Random(4)
    data = [(i, a, b, math.sin(a) * 2 + (b > 0.5)) for i in range(4000) for a, b in [(rng.uniform(0, 6), rng.random())]]
    df = spark.createDataFrame(data, SCHEMA)
    held = F.pmod("id", F.lit(10)) == 0
    got = recommend.rmse(recommend.boosted(df.where(~held), df.where(held), "y", ("a", "b"), rounds=30, depth=4), "y").first()["rmse"]
    assert got < 0.1  # the labels spread by 1.5


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    data = [(1, None, 1.0, 1.0), (2, nan, 1.0, 1.0), (3, inf, 1.0, 2.0), (4, -inf, 1.0, 3.0), (5, 1e308, 1.0, 2.0), (6, 5e-324, 1.0, 2.5), (7, 1.0, 1.0, None), (8, 1.0, 1.0, nan), (9, 1.0, 1.0, inf), (None, None, None, 1.0)]
    df = spark.createDataFrame(data, SCHEMA).withColumn("prediction", F.lit("earlier")).withColumn("x0", F.lit("extra"))
    model = trees.fit(df, "y", ("a", "b"), rounds=20, depth=3)
    got = trees.predict(model, df)
    assert got.columns == df.columns and got.count() == 10
    p = {r["id"]: r["prediction"] for r in got.collect()}
    assert model.base == pytest.approx(12.5 / 7) and p[1] == p[2] and all(math.isfinite(v) for v in p.values())
    assert abs(p[4] - 3) < 0.6 and abs(p[1] - 1) < 0.4
    none = trees.fit(df.where("id > 6"), "y", ("a", "b"), rounds=2)
    assert [r["prediction"] for r in trees.predict(none, df).collect()] == [None] * 10
    same = trees.fit(df.where("id < 3"), "y", ("a", "b"), rounds=2)
    assert {r["prediction"] for r in trees.predict(same, df).collect()} == {1.0}


def test_smaller_children_of_blocks_give_whole_levels_whatever_the_rounds_between_fresh_margins(spark, monkeypatch):
    data = _table(600, 5)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    summed, real = [], trees._summed

    def watched(cells, model, level, bins, wanted=None):
        g, n = real(cells, model, level, bins, wanted)
        summed.append((level, int(n[:, 0].sum())))
        return g, n

    monkeypatch.setattr(trees, "_summed", watched)
    fits = []
    for keep in (2, 50):
        monkeypatch.setattr(trees, "KEEP", keep)
        fits.append(trees.fit(df, "y", ("a", "b"), rounds=5, depth=3))
    assert all(n <= (600 if not level else 300) for level, n in summed) and {level for level, _ in summed} == {0, 1, 2}
    assert all((x == y).all() for k in ("feature", "cut", "null_left", "value") for x, y in zip(getattr(fits[0], k), getattr(fits[1], k)))
    got, want = _predicted(fits[0], df), _plain(data, 5, 3)
    assert all(abs(got[k] - want[k]) < 1e-3 for k in want)
