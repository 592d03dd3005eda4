"""Item links from lists of items: equal to the self-join, and with lists shuffled, not pairs."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import links, recommend


def _rows(df):
    return [str(x) for x in df.select("item_1", "item_2", "n_common", F.round("r", 6)).orderBy("item_1", "item_2").collect()]


@pytest.mark.parametrize("kind, task_pairs", [("long", 1 << 21), ("long", 300), ("long", 4), ("string", 300), ("int", 300)])
def test_links_in_blocks_and_dealt_blocks_equal_the_self_join(spark, monkeypatch, kind, task_pairs):
    monkeypatch.setattr(links, "TASK_PAIRS", task_pairs)  # 4: blocks are dealt over tasks
    monkeypatch.setattr(links, "PIECE", 50)
    rng = random.Random(6)
    data = [(0, i, rng.random()) for i in range(60)] + [(u, i, rng.random()) for u in range(1, 40) for i in rng.sample(range(30), rng.randint(1, 16))]
    data += data[70:90] + [(1, 7, None), (2, None, 0.5), (None, 3, 0.5), (3, 1000, float("nan")), (4, 1000, 1.0), (5, 1000, 2.0)]  # repeated pairs, nulls
    df = spark.createDataFrame(data, "user long, item long, rating double").withColumn("item", F.col("item").cast(kind))
    want = recommend.item_pearson(df.where("user IS NOT NULL")).where("n_common >= 3 AND r > 0.1")
    got = recommend.item_links(df, 3, 0.1, block_rows=16)
    assert got.schema["item_1"].dataType == df.schema["item"].dataType
    assert _rows(got) == _rows(want) != []


def test_links_shuffle_lists_and_not_pairs(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(u, i, rng.random()) for u in range(300) for i in rng.sample(range(600), 40)], "user long, item long, rating double").cache()
    n = df.count()  # pairs are 19.5 times the ratings
    store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext
    doubles = sc._gateway.new_array(sc._jvm.double, 0)

    def records():
        s = store.stageList(None, False, False, doubles, None)
        return {s.apply(k).stageId(): s.apply(k).shuffleWriteRecords() for k in range(s.size())}

    before = set(records())
    assert recommend.item_links(df, 3, 0.2).count() > 0
    assert sum(v for k, v in records().items() if k not in before) < 3 * n
    df.unpersist()
