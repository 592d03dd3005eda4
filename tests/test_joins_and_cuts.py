"""The set-similarity join, betweenness in batches and the whole divisive loop against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import graph, itemsets, recommend
from millrace.plans.lineage import ranked
from test_operators import _brandes, _random_graph, rows


def most_shuffled(spark, run):
    """The most records that one stage of run() writes to a shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()
    doubles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages():
        s = store.stageList(None, False, False, doubles, None)
        return {s.apply(k).stageId(): s.apply(k).shuffleWriteRecords() for k in range(s.size())}

    before = max(stages(), default=-1)
    run()
    return max(n for k, n in stages().items() if k > before)


def test_ranks_are_those_of_a_window(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.6 else rng.choice("abc"), x) for x in rng.sample(range(1000), 300)]
    got = rows(ranked(spark.createDataFrame(data, "g string, x long"), ["g"], ["x"]), "g", "x", "rank")
    want = [(g, x, k) for g in {d[0] for d in data} for k, x in enumerate(sorted(x for h, x in data if h == g), 1)]
    assert got == sorted(want)


@pytest.mark.parametrize("threshold", [0.2, 0.5, 2 / 3, 0.8, 1.0])
def test_similarity_join_equals_all_pairs(spark, threshold):
    rng = random.Random(2)
    sets = {i: set(rng.choices(range(12), weights=range(1, 13), k=rng.randint(1, 9))) | ({99} if i % 3 else set()) for i in range(60)}
    sets |= {100: set(range(16)), 101: set(range(8)), 102: {99}, 103: {99}, 104: set(range(8))}
    data = [(i, u) for i, s in sets.items() for u in s]
    want = [(a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold]
    df = spark.createDataFrame(data + [(None, 3), (None, 99)], "item long, user long")
    assert rows(recommend.jaccard_pairs(df, threshold), "item_1", "item_2", "similarity") == want
    assert recommend.jaccard_pairs(df.limit(0), threshold).count() == 0


@pytest.mark.parametrize("block_rows, pair_rows", [(256, 1 << 23), (16, 1 << 23), (16, 50)])
def test_item_links_in_blocks_and_passes_equal_the_self_join(spark, monkeypatch, block_rows, pair_rows):
    monkeypatch.setattr(recommend, "PAIR_ROWS", pair_rows)
    rng = random.Random(4)
    data = [(0, i, rng.random()) for i in range(150)] + [(u, i, rng.random()) for u in range(1, 30) for i in rng.sample(range(40), rng.randint(1, 17))]
    df = spark.createDataFrame(data + [(None, 1, 0.5), (None, 2, 0.1), (3, None, 0.5)], "user long, item long, rating double").cache()
    want = recommend.item_pearson(df).where("n_common >= 3 AND r > 0.2")
    key = ("item_1", "item_2", "n_common", F.round("r", 6).alias("r"))
    got = recommend.item_links(df, 3, 0.2, block_rows).select(*key)
    assert rows(got, "item_1", "item_2", "n_common", "r") == rows(want.select(*key), "item_1", "item_2", "n_common", "r") != []
    blocks = recommend.history_blocks(df, block_rows).collect()
    assert max(len(b["own"]) for b in blocks) <= max(3 * block_rows, 32) and sum(len(b["own"]) for b in blocks) == df.count()
    assert recommend.item_links(df.limit(0), 3, 0.2).count() == 0
    df.unpersist()


def test_a_user_of_all_items_makes_no_pairs(spark):
    rng = random.Random(3)
    data = [(i, u) for i in range(500) for u in [0, *rng.sample(range(1, 4000), 5)]] + [(900, u) for u in (1, 2, None)] + [(901, u) for u in (1, 2, 3)]
    df = spark.createDataFrame(data, "item long, user long").cache()
    got = []
    assert most_shuffled(spark, lambda: got.extend(rows(recommend.jaccard_pairs(df), "item_1", "item_2", "similarity"))) < 3 * len(data)  # all pairs by user 0 are 124,750
    assert (900, 901, 0.5) in got
    for bad in (0, 1.1):
        with pytest.raises(ValueError):
            recommend.jaccard_pairs(df, bad)
    df.unpersist()


def frame(spark, edges, kind="long"):
    return spark.createDataFrame([p for a, b in edges for p in ((a, b), (b, a))], f"src {kind}, dst {kind}")


def test_betweenness_in_batches_of_roots(spark):
    e = _random_graph(13, 17, 8) | {(50, 51), (51, 52)}
    want = _brandes(e)
    got = {(r["u"], r["v"]): r["score"] for r in graph.edge_betweenness(frame(spark, e), 60).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def divided(edges):
    """The divisive loop with everything computed anew each round."""
    left, best = set(edges), None
    nodes = sorted({n for e in edges for n in e})
    degree = {n: sum(n in e for e in edges) for n in nodes}
    while left:
        scores = {k: round(v, 9) for k, v in _brandes(left).items()}
        left = {k for k in left if scores[k] != max(scores.values())}
        own = {n: n for n in nodes}
        for _ in nodes:
            for a, b in left:
                own[a] = own[b] = min(own[a], own[b])
        groups = {}
        for n, c in own.items():
            groups.setdefault(c, []).append(n)
        q = round(sum(sum(own[a] == own[b] == c for a, b in edges) / len(edges) - (sum(degree[n] for n in g) / 2 / len(edges)) ** 2 for c, g in groups.items()), 6)
        if best is None or q > best[0]:
            best = q, own
    return best[1]


def test_turns_are_those_of_rounds_over_all_components():
    rng = random.Random(9)
    for _ in range(300):
        lists = [[rng.randint(1, 4) for _ in range(rng.randint(0, 6))] for _ in range(3)]
        at, rounds = [0] * 3, []
        while any(k < len(x) for k, x in zip(at, lists)):
            top = max(x[k] for k, x in zip(at, lists) if k < len(x))
            rounds.append([(c, k) for c, (k, x) in enumerate(zip(at, lists)) if k < len(x) and x[k] == top])
            at = [k + (k < len(x) and x[k] == top) for k, x in zip(at, lists)]
        turns = {}
        for c, x in enumerate(lists):
            for k, turn in enumerate(graph._turns(x)):
                turns.setdefault(turn, []).append((c, k))
        assert [turns[t] for t in sorted(turns)] == rounds


@pytest.mark.parametrize("task_edges", [4096, 12])
def test_the_divisive_loop_to_its_end(spark, task_edges):
    e = {(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5), (5, 6), (6, 7), (7, 8), (6, 8)} | ({(20, 21), (21, 22), (22, 23)} if task_edges > 12 else set())
    got = dict(rows(graph.divisive_communities(frame(spark, e), task_edges=task_edges), "id", "component"))
    assert got == divided(e)


def test_a_division_of_text_nodes_and_of_no_edges(spark):
    e = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")]
    own = rows(graph.divisive_communities(frame(spark, e, "string")), "id", "component")
    assert own == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")]
    assert graph.divisive_communities(frame(spark, e, "string").where(F.lit(False))).count() == 0


@pytest.mark.parametrize("cells", [itemsets.PART_CELLS, 150, 0])
def test_parts_are_mined_as_brute_force_does(spark, cells):
    rng = random.Random(12)
    baskets = {k: set(rng.choices("abcdefgh", weights=range(8, 0, -1), k=6)) for k in range(50)}
    pairs = spark.createDataFrame([(k, i) for k, b in baskets.items() for i in b] + [(k, None) for k in range(20)] + [(None, i) for i in "abc"], "key long, item string")
    dealt = dict(rows(pairs.select("key", F.pmod(F.xxhash64("key"), F.lit(3)).alias("part")).distinct().where("key is not null"), "key", "part"))
    for top in (None, 1, 2, 3):
        want = set()
        for p in range(3):
            counts = {("a",): 1, ("b",): 1, ("c",): 1} if p == 42 % 3 else {}  # the null key's, whose hash is the seed
            for k, b in baskets.items():
                for n in range(1, 9):
                    for c in itertools.combinations(sorted(b), n) if dealt[k] == p else ():
                        counts[c] = counts.get(c, 0) + 1
            want |= {c for c, n in counts.items() if n >= 4 and (top is None or len(c) <= top)}
        got = [tuple(r[0]) for r in itemsets.son_candidates(pairs, 12, 3, top, cells).collect()]
        assert len(got) == len(set(got)) and set(got) - {(None,)} == want
        if cells != 150:
            break


def test_shared_items_are_counted_in_blocks_and_in_tasks_for_their_pairs(spark):
    rng = random.Random(21)
    held = {n: {0, *rng.sample(range(1, 30), 6)} for n in range(80)}  # item 0 is everyone's
    data = [(n, i) for n, s in held.items() for i in s]
    want = [(a, b, len(held[a] & held[b])) for a, b in itertools.combinations(range(80), 2)]
    df = spark.createDataFrame(data + [(None, 0), (None, 3), (5, None), (6, None)], "node long, item long").cache()
    for block_nodes, task_pairs in ((256, 1 << 22), (8, 500)):
        got = graph.share_counts(df, block_nodes, task_pairs)
        assert rows(got, "src", "dst", "n") == want
        assert got.rdd.getNumPartitions() >= sum(n for _, _, n in want) // task_pairs
    assert most_shuffled(spark, lambda: graph.share_counts(df).count()) < sum(n for _, _, n in want) // 4
    assert graph.share_counts(df.limit(0)).count() == 0
    df.unpersist()


def test_dense_sets_are_counted_by_their_users_without_a_row_each_in_a_shuffle(spark):
    rng = random.Random(22)
    sets = {i: set(rng.sample(range(600), 400)) for i in range(20)}
    want = [(a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) for a, b in itertools.combinations(sets, 2) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])]
    data = [(i, u) for i, s in sets.items() for u in s]
    df = spark.createDataFrame(data, "item long, user long").cache()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        for most in (recommend.BROADCAST_PAIRS, 0):
            got = []
            n = most_shuffled(spark, lambda: got.extend(rows(recommend.jaccard_pairs(df, 0.5, most), "item_1", "item_2", "similarity")))
            assert got == want != [] and (n <= 3 * len(data)) == (most > 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        df.unpersist()


def test_parts_in_slices_give_the_same_sets(spark):
    rng = random.Random(23)
    data = [(k, i) for k in range(200) for i in set(rng.choices("abcdefgh", weights=range(8, 0, -1), k=5))] + [(None, "a"), (3, None)]
    df = spark.createDataFrame(data, "key long, item string").cache()
    sets = [sorted(tuple(r[0]) for r in itemsets.son_candidates(df, 12, 2, 4, slice_rows=n).collect() if None not in r[0]) for n in (1 << 20, 40)]
    assert sets[0] == sets[1] and max(map(len, sets[0])) > 2
    df.unpersist()
