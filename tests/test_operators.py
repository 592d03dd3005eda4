"""Small tables with answers worked out by hand or by brute force, a case for each decision that was taken."""

import itertools
import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from millrace.functions import columns as fn
from millrace.operators import graph, itemsets, recommend, relational, sketches
from millrace.plans.lineage import numbered


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_top_keys_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(k,) for k in "bbaaccd"], "k string")
    assert [tuple(r) for r in relational.top_keys(df, "k", 2).collect()] == [("a", 2), ("b", 2)]


def test_counts_of_empty_tables_and_null_keys(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "k string")
    assert relational.count_rows(df.limit(0)).first()[0] == 0
    assert relational.count_keys(df, "k").first()[0] == 2


def test_review_stats_of_a_year_without_rows(spark):
    df = spark.createDataFrame([("u", "b", "2018-01-02")], "user_id string, business_id string, date string")
    r = relational.review_stats(df, 2017).first()
    assert (r["n_review"], r["n_review_2017"]) == (1, 0)
    assert [tuple(x) for x in r["top10_user"]] == [("u", 1)]


def test_first_letter_partitions_keep_empty_ones(spark):
    df = spark.createDataFrame([("a",), ("i",), ("b",)], "k string")
    got = dict(rows(relational.first_letter_partitions(df, "k", 8), "partition", "n_items"))
    assert got == {0: 0, 1: 2, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}
    dealt = relational.layout(relational.repartition_by_first_letter(df, "k", 8))
    assert dict(rows(dealt, "partition", "n_items")) == got


def test_columns(spark):
    df = spark.createDataFrame([("12/31/2000", "000", "loud", "True", "x"), ("1/2/1999", "0070", None, "true", "2.5")], "d string, z string, n string, f string, p string")
    got = [tuple(r) for r in df.select(fn.short_date(F.col("d")), fn.strip_zeros(F.col("z")), fn.noise_level(F.col("n")), fn.flag(F.col("f")), fn.number(F.col("p"))).collect()]
    assert got == [("12/31/00", "", 3, 1, 0.0), ("1/2/99", "70", 0, 1, 2.5)]
    got = spark.createDataFrame([("aé",)], "s string").select(fn.bytes_mod(F.col("s"), 69997)).first()[0]
    assert got == int.from_bytes("aé".encode(), "big") % 69997
    assert [r[0] for r in spark.createDataFrame([(0,), (12,), (1,)], "h long").select(fn.trailing_zeros(F.col("h"))).collect()] == [1, 2, 0]


def test_frequent_itemsets_match_brute_force_and_all_paths_agree(spark):
    rng = random.Random(1)
    baskets = {k: set(rng.choices("abcdefg", k=5)) for k in range(40)}
    want = Counter(c for b in baskets.values() for n in range(1, 8) for c in itertools.combinations(sorted(b), n))
    want = {k: v for k, v in want.items() if v >= 9}
    pairs = spark.createDataFrame([(k, i) for k, b in baskets.items() for i in b], "key long, item string")
    got = {tuple(r["itemset"]): r["n"] for r in itemsets.frequent_itemsets(pairs, 9).collect()}
    assert got == want
    fp = itemsets.fp_growth(itemsets.baskets(pairs, "key", "item"), 9)
    assert {tuple(r["itemset"]): r["n"] for r in fp.collect()} == want
    for parts in (1, 2, 7):
        cand = {tuple(r[0]) for r in itemsets.son_candidates(pairs, 9, parts, 7).collect()}
        assert set(want) <= cand
        assert parts > 1 or cand == set(want)


def test_fp_growth_over_equal_baskets(spark):
    """Repeated pairs and baskets, null items, several keys' items as one row; as brute force, each set once."""
    rng = random.Random(4)
    baskets = {k: set(rng.choices("abcdefghij", [9, 8, 7, 6, 5, 4, 3, 2, 1, 1], k=6)) for k in range(60)} | {60: set()}
    pairs = spark.createDataFrame([(k, i) for k, b in baskets.items() for i in [*b, *b, None]], "key long, item string")
    sets = itemsets.equal_baskets(pairs, "key", "item")
    assert {tuple(r["items"]): r["n"] for r in sets.collect()} == Counter(tuple(sorted(b)) for b in baskets.values())
    for support in (2, 12):
        want = Counter(c for b in baskets.values() for n in range(1, 8) for c in itertools.combinations(sorted(b), n))
        got = [(tuple(r["itemset"]), r["n"]) for r in itemsets.fp_growth(sets, support).collect()]
        assert sorted(got) == sorted((k, v) for k, v in want.items() if v >= support)
    assert itemsets.fp_growth(sets.limit(0), 2).count() == 0


def test_son_candidates_of_every_size(spark):
    pairs = spark.createDataFrame([(k, i) for k in range(12) for i in "abcde"], "key long, item string")
    want = {c for n in range(1, 6) for c in itertools.combinations("abcde", n)}
    assert {tuple(r[0]) for r in itemsets.son_candidates(pairs, 12, 1).collect()} == want
    assert itemsets.son_candidates(pairs.limit(0), 3, 2).count() == 0


def test_baskets(spark):
    df = spark.createDataFrame([("u", "x"), ("u", "x"), ("u", "y"), ("v", "x")], "a string, b string")
    assert rows(itemsets.baskets(itemsets.pairs_of_case(df, "a", "b", 1), "key", "item", 1), "key", "items") == [("u", ["x", "y"])]
    assert rows(itemsets.baskets(itemsets.pairs_of_case(df, "a", "b", 2), "key", "item"), "key", "items") == [("x", ["u", "v"]), ("y", ["u"])]
    with pytest.raises(ValueError):
        itemsets.pairs_of_case(df, "a", "b", 3)


def test_jaccard_at_the_threshold_and_lsh_within_it(spark):
    sets = {1: {1, 2, 3, 4}, 2: {3, 4}, 3: {9}}
    pairs = spark.createDataFrame([(i, u) for i, s in sets.items() for u in s], "item long, user long")
    assert rows(recommend.jaccard_pairs(pairs), "item_1", "item_2", "similarity") == [(1, 2, 0.5)]
    assert rows(recommend.lsh_pairs(pairs), "item_1", "item_2", "similarity") == [(1, 2, 0.5)]


def test_pearson_without_variance_is_zero(spark):
    r = spark.createDataFrame([(u, i, float(v)) for u, i, v in [(1, 1, 3), (2, 1, 3), (1, 2, 1), (2, 2, 5), (1, 3, 2), (2, 3, 6)]], "user long, item long, rating double")
    assert rows(recommend.item_pearson(r), "item_1", "item_2", "r") == [(1, 2, 0.0), (1, 3, 0.0), (2, 3, 1.0)]


def test_item_cf_takes_the_lowest_neighbours_and_covers_cold_starts(spark):
    rng = random.Random(2)
    ratings = {(u, i): rng.randint(1, 5) + (u % 3) for u in range(30) for i in range(16) if rng.random() < 0.8}
    targets = [(0, 0, 0), (1, 1, 5), (2, 99, 3), (3, 4, 99), (4, 98, 98), (5, 0, 0)]
    r = spark.createDataFrame([(u, i, float(v)) for (u, i), v in ratings.items()], "user long, item long, rating double")
    t = spark.createDataFrame(targets, "row_id long, user long, item long")
    got = {x["row_id"]: x["prediction"] for x in recommend.item_cf(r, t, min_common=10, min_r=0.1, neighbours=3).collect()}
    mean = lambda v: sum(v) / len(v)

    def pearson(a, b):
        us = [u for u in range(30) if (u, a) in ratings and (u, b) in ratings]
        x, y = [ratings[u, a] for u in us], [ratings[u, b] for u in us]
        x, y = [v - mean(x) for v in x], [v - mean(y) for v in y]
        below = sum(v * v for v in x) ** 0.5 * sum(v * v for v in y) ** 0.5
        return len(us), sum(p * q for p, q in zip(x, y)) / below if below else 0

    for row, u, i in targets:
        own, other = [v for (a, _), v in ratings.items() if a == u], [v for (_, b), v in ratings.items() if b == i]
        if not own or not other:
            want = mean(list(ratings.values())) if not own and not other else mean(own or other)
        else:
            near = sorted((p, b) for (a, b) in ratings if a == u and b != i for n, p in [pearson(i, b)] if n >= 10 and p > 0.1)[:3]
            below = sum(abs(p) for p, _ in near)
            want = sum(p * ratings[u, b] for p, b in near) / below if below else 0.6 * mean(other) + 0.4 * mean(own)
        assert got[row] == pytest.approx(want, abs=2e-6)


def test_item_links_shuffle_pairs_in_passes(spark, monkeypatch):
    rng = random.Random(5)
    own = {u: rng.sample(range(45) if u < 30 else range(100, 4100), 40) for u in range(480)}  # few of the pairs have common users
    r = spark.createDataFrame([(u, i, float(rng.randint(1, 50))) for u, items in own.items() for i in items] + [(None, 1, 2.0), (None, 2, 3.0)], "user long, item long, rating double").repartition(8, "user").cache()
    t = r.where("user is not null").select((F.col("user") * 10000 + F.col("item")).alias("row_id"), "user", "item")
    store = spark.sparkContext._jsc.sc().statusStore()
    doubles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages():
        s = store.stageList(None, False, False, doubles, None)
        return {s.apply(k).stageId(): s.apply(k).shuffleWriteRecords() for k in range(s.size())}

    want = rows(recommend.item_pearson(r).where("n_common >= 8 and r > 0.2"), "item_1", "item_2", "n_common", "r")
    assert len(want) > 50
    monkeypatch.setattr(recommend, "PAIR_ROWS", 1)
    before = max(stages())
    cf = recommend.item_cf(r, t, min_common=8, min_r=0.2)
    assert len(cf.collect()) == 480 * 40
    most = max(n for k, n in stages().items() if k > before)
    assert most < 4 * 480 * 40  # all pairs are 19.5 times the ratings
    got = rows(recommend.item_links(r, 8, 0.2), "item_1", "item_2", "n_common", "r")
    assert [x[:3] for x in got] == [x[:3] for x in want] and all(a[3] == pytest.approx(b[3], abs=1e-9) for a, b in zip(got, want))
    assert recommend.item_links(r.limit(0), 8, 0.2).count() == 0
    r.unpersist()


def test_features_of_missing_rows_and_missing_keys(spark):
    pairs = spark.createDataFrame([("u", "b1"), ("u", "b2"), ("x", "b9")], "user_id string, business_id string")
    business = spark.createDataFrame([("b1", "c", 4.0, 10, 1, {"NoiseLevel": "loud"}), ("b2", None, 2.0, 30, 0, None)], "business_id string, city string, stars double, review_count long, is_open int, attributes map<string,string>")
    tips = spark.createDataFrame([("b1", "u", 2), ("b1", "u", 4)], "business_id string, user_id string, likes long")
    checkins = spark.createDataFrame([("b1", {"a": 1, "b": 2})], "business_id string, time map<string,long>")
    users = spark.createDataFrame([("u", 5, 3.5, 7, 1)], "user_id string, review_count long, average_stars double, useful long, fans long")
    got = {r["business_id"]: r for r in recommend.features(pairs, business, tips, checkins, users).collect()}
    assert (got["b1"]["noise"], got["b1"]["price"], got["b1"]["tip_likes"], got["b1"]["checkin_norm"]) == (3.0, 0.0, 6.0, 1.0)
    assert (got["b2"]["noise"], got["b2"]["price"], got["b2"]["bike_parking"], got["b2"]["city_avg"], got["b2"]["checkin_norm"]) == (3.0, 1.5, 1.0, 2.0, 0.0)
    assert (got["b9"]["biz_stars"], got["b9"]["biz_review_norm"], got["b9"]["user_avg_stars"]) == (3.0, 0.0, 3.5)


def _random_graph(n, m, seed):
    rng = random.Random(seed)
    e = set()
    while len(e) < m:
        a, b = rng.sample(range(n), 2)
        e.add((min(a, b), max(a, b)))
    return e


def _brandes(edges):
    adj = {}
    for a, b in edges:
        adj.setdefault(a, []).append(b), adj.setdefault(b, []).append(a)
    out = Counter()
    for s in adj:
        dist, paths, order, q = {s: 0}, Counter({s: 1}), [], deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        credit = Counter()
        for w in reversed(order):
            for v in adj[w]:
                if dist[v] == dist[w] - 1:
                    c = paths[v] / paths[w] * (1 + credit[w])
                    out[min(v, w), max(v, w)] += c / 2
                    credit[v] += c
    return out


def test_betweenness_and_components(spark):
    e = _random_graph(14, 18, 3)
    df = spark.createDataFrame([p for a, b in e for p in ((a, b), (b, a))], "src long, dst long")
    got = {(r["u"], r["v"]): r["score"] for r in graph.edge_betweenness(df).collect()}
    want = _brandes(e)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    comp = dict(rows(graph.connected(df), "id", "component"))
    assert all(comp[a] == comp[b] for a, b in e) and all(comp[v] == v for v in comp.values())


def test_two_triangles_are_divided(spark):
    e = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)]
    df = spark.createDataFrame([p for a, b in e for p in ((a, b), (b, a))], "src long, dst long")
    own = graph.divisive_communities(df, rounds=2)
    assert dict(rows(own, "id", "component")) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}
    assert graph.modularity(df, own.select("id", "component")).first()[0] == pytest.approx(2 * (6 / 14 - 0.25), abs=1e-6)
    labels = graph.label_propagation(df)
    assert sorted(len(r["members"]) for r in graph.communities(labels).collect())[-1] <= 6
    with pytest.raises(ValueError):
        graph.coshare_edges(df.toDF("node", "item"), 0)


def test_sketches_equal_the_sequential_algorithms(spark):
    rng = random.Random(5)
    stream = [(n, (n - 1) // 100, rng.randrange(60)) for n in range(1, 501)]
    df = spark.createDataFrame(stream, "seq long, batch long, user long")
    coef = [((i * 7919 + 104729) % 99991 + 1, (i * 15485863 + 32452843) % 98387 + 1) for i in range(8)]
    bits, seen, want = set(), set(), {}
    for _, batch, u in stream:
        pos = [(a * u + b) % 101 for a, b in coef]
        w = want.setdefault(batch, [0, 0])
        if u not in seen:
            w[0] += 1
            w[1] += all(p in bits for p in pos)
        seen.add(u), bits.update(pos)
    got = {r["batch"]: [r["n_new"], r["n_false"]] for r in sketches.bloom_fpr(df, 101, 8).collect()}
    assert got == want
    held, snap = [None] * 100, set()
    for n, _, u in stream:
        if n <= 100:
            held[n - 1] = u
        elif (n * 7919 + 104729) % 10007 / 10007 * n < 100:
            held[(n * 104729 + 7919) % 100] = u
        if n % 100 == 0:
            snap |= {(n, k, held[k]) for k in (0, 20, 40, 60, 80)}
    assert set(rows(sketches.reservoir_snapshots(df), "seqnum", "slot", "user")) == snap
    fm = sketches.fm_distinct(df, 400).collect()
    assert all(10 < r["estimate"] < 400 for r in fm) and len(fm) == 5


def test_numbering_and_streams(spark, tmp_path):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(1000), 200)], "user long")
    got = rows(numbered(df, ["user"]), "seq", "user")
    assert [s for s, _ in got] == list(range(1, 201)) and [u for _, u in got] == sorted(u for _, u in got)
    from millrace.streaming.batches import sketch_stream

    df.write.parquet(str(tmp_path / "in"))
    seen = []
    q = sketch_stream(spark.readStream.schema("user long").parquet(str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "cp"), sketches.bloom_fpr, lambda out, b: seen.append(out.agg(F.sum("n_new")).first()[0]))
    q.processAllAvailable()
    q.stop()
    assert seen[-1] == 200
