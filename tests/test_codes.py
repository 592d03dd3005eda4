"""Features that share a code: the sums of each, the nodes that rows reach, and whole numbers in few bytes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import trees

NAMES = tuple("abcde")


def _rows(n):
    rng = random.Random(8)
    return [(i, rng.choice([None, 0.0, 1.0]), float(rng.randint(0, 4)), rng.random(), 7.0, rng.choice([None, -1.0, 2.0, 3.0]), rng.randint(0, 40) / 8) for i in range(n)]


@pytest.mark.parametrize("direct, codes", [(16, 2048), (0, 2048), (16, 256)])
def test_shared_codes_give_the_sums_of_each_feature_and_the_nodes_of_each_row(spark, monkeypatch, direct, codes):
    monkeypatch.setattr(trees, "DIRECT", direct)
    monkeypatch.setattr(trees, "CODES", codes)
    data = _rows(700)
    df = spark.createDataFrame(data, "id long, a double, b double, c double, d double, e double, y double").repartition(3)
    model = trees.fit(df, "y", NAMES, rounds=2, depth=3)
    assert sorted(j for g in model.groups for j in g) == list(range(5)) and len(model.groups) < 5
    bins = model.binned([np.array([r[k] for r in data], float) for k in range(1, 6)])
    y = np.array([round(r[6] * trees.UNIT) for r in data])
    node = np.zeros(700, int)
    margin = np.full(700, model.base)
    for t in range(2):
        node[:] = 0
        for _ in range(3):
            for i in range(700):
                f = model.feature[t][node[i]]
                if f >= 0:
                    b = bins[i, f]
                    node[i] = 2 * node[i] + (1 if (model.null_left[t][node[i]] if b == 0 else b <= model.cut[t][node[i]]) else 2)
        assert (model.place(model.coded(bins), t, 3) == node).all()
        if not t:
            margin = margin + model.value[t][node]
    cells = spark.createDataFrame([(bytes(b), 1, int(v), model.base) for b, v in zip(bins, y)], "cell binary, n long, y long, margin double").repartition(3)
    blocks = cells.mapInArrow(trees._advanced(model.part(0, 1)), trees.BLOCK)
    at = model.place(model.coded(bins), 1, 2) - 3
    for source, tree in ((cells, model), (blocks, model.part(-1))):
        g, n = trees._summed(source, tree, 2, trees.BINS)
        want = np.zeros((2, 4, 5, trees.BINS), np.int64)
        for j in range(5):
            some = at >= 0
            np.add.at(want[0], (at[some], j, bins[some, j]), np.rint(margin * trees.UNIT).astype(np.int64)[some] - y[some])
            np.add.at(want[1], (at[some], j, bins[some, j]), 1)
        assert (g == want[0]).all() and (n == want[1]).all()
    held = blocks.select(F.sum(F.octet_length("cell") + F.octet_length("n") + F.octet_length("g"))).first()[0]
    assert held <= 700 * (2 * len(model.groups) + 1 + 4)  # 29 bytes a cell with a byte a feature and three numbers of eight


@pytest.mark.parametrize("values", [[0], [-128, 127], [128], [-129], [-(2**31), 1], [2**31], [-(2**62), 2**62]])
def test_whole_numbers_keep_their_values_in_few_bytes(values):
    x = np.array(values, np.int64)
    assert (trees._narrow(x) == x).all()
