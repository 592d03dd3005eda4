from millrace.operators.itemsets import transaction_pairs
from millrace.sources import sinks, tables


def test_readers_and_reports(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('"DATE","C","x","y","z","P"\n"11/1/2000","007","a,b","","","0471"\n"11/1/2000","000","","","","00"\n')
    got = sorted(map(tuple, transaction_pairs(tables.transactions(spark, str(p))).collect()))
    assert got == [("11/1/00-", ""), ("11/1/00-7", "471")]
    j = tmp_path / "r.json"
    j.write_text('{"user_id":"u","business_id":"b","date":"2018-01-01","stars":4}\n')
    assert tables.json_lines(spark, str(j), tables.REVIEW).first()["stars"] == 4.0
    sets = spark.createDataFrame([(["b"],), (["a"],), (["a", "b"],)], "itemset array<string>")
    sinks.itemset_report(sets.limit(0), sets, str(tmp_path / "o.txt"))
    assert (tmp_path / "o.txt").read_text() == "Candidates:\n\n\nFrequent Itemsets:\n('a'),('b')\n\n('a', 'b')\n\n"
    sinks.csv_table(spark.createDataFrame([("u", "b", 1.5)], "a string, b string, c double"), str(tmp_path / "p"), ["user_id", " business_id", " prediction"])
    line = next((tmp_path / "p").glob("*.csv")).read_text().splitlines()[0]
    assert line == "user_id, business_id, prediction"


def test_sampled_batches(spark):
    lines = spark.createDataFrame([(f"u{k}",) for k in range(30)], "user string")
    got = tables.sampled_batches(lines, "user", 3, 20).collect()
    assert sorted(r["seq"] for r in got) == list(range(60)) and {r["batch"] for r in got} == {0, 1, 2}


def test_entry_without_the_llm_subpackage():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_report_files(spark, tmp_path):
    import json

    from millrace.operators import relational, sketches

    p = lambda n: str(tmp_path / n)
    reviews = spark.createDataFrame([("u", "b", "2018-01-02"), ("u", "c", "2017-01-02"), ("v", "b", "2018-05-02")], "user_id string, business_id string, date string")
    sinks.stats_report(relational.review_stats(reviews, 2018), p("s.json"))
    assert json.load(open(p("s.json"))) == {"n_review": 3, "n_review_2018": 2, "n_user": 2, "n_business": 2, "top10_user": [["u", 2], ["v", 1]], "top10_business": [["b", 2], ["c", 1]]}
    dealt = relational.repartition_by_first_letter(reviews, "business_id", 2)
    got = sinks.partition_report(relational.layout(reviews.repartition(3)), relational.layout(dealt), p("p.json"))
    assert json.load(open(p("p.json"))) == got and got["default"]["n_partition"] == 3 and got["customized"]["n_items"] == [2, 1] and got["default"]["exe_time"] > 0
    avg = spark.createDataFrame([("Reno", 4.5), ("Ash, Fork", 3.0)], "city string, stars double")
    sinks.text_lines(sinks.average_lines(avg, "city", "stars"), p("a.txt"), "city,stars")
    assert open(p("a.txt")).read() == "city,stars\nReno,4.5\nAsh, Fork,3.0\n"
    groups = spark.createDataFrame([(["b", "c"],), (["a"],)], "members array<string>")
    assert [r["line"] for r in sinks.community_lists(groups).collect()] == ["'a'", "'b', 'c'"] == [r["line"] for r in sinks.community_lines(groups).collect()]
    scores = spark.createDataFrame([("a", "b", 2.0), ("a", "c", 12.5)], "u string, v string, score double")
    assert [r["line"] for r in sinks.betweenness_lines(scores).collect()] == ["('a', 'c'), 12.5", "('a', 'b'), 2.0"]
    sinks.stream_csv(spark.createDataFrame([(1, 0.5), (0, 0.0)], "batch long, fpr double"), p("f.csv"), ["Time", "FPR"], "batch")
    assert open(p("f.csv"), newline="").read() == "Time,FPR\r\n0,0.0\r\n1,0.5\r\n"
    stream = spark.createDataFrame([(k // 100, k + 1, f"u{k}") for k in range(200)], "batch long, seq long, user string")
    wide = sinks.reservoir_rows(sketches.reservoir_snapshots(stream))
    assert wide.columns == ["seqnum", "0_id", "20_id", "40_id", "60_id", "80_id"] and wide.orderBy("seqnum").first()["20_id"] == "u20"
    assert sinks.duration_line(1.5, lambda x: None) == "Duration: 1.5"
    h = tmp_path / "h.csv"
    h.write_text("user_id,business_id,stars\nu,b,4.0\n")
    assert [tuple(r) for r in tables.header_csv(spark, str(h), tables.RATINGS).collect()] == [("u", "b", 4.0)]
    h.write_text("user_id,business_id\nu,b\n")
    assert [tuple(r) for r in tables.header_csv(spark, str(h), tables.PAIRS).collect()] == [("u", "b")]
    j = tmp_path / "b.json"
    j.write_text('{"business_id":"b","city":"Reno","stars":4,"attributes":{"NoiseLevel":"loud"}}\n{"business_id":"c"}\n')
    rows = tables.json_lines(spark, str(j), tables.BUSINESS).orderBy("business_id").collect()
    assert rows[0]["attributes"] == {"NoiseLevel": "loud"} and rows[1]["city"] is None
    j.write_text('{"business_id":"b","time":{"Mon-1":3}}\n')
    assert tables.json_lines(spark, str(j), tables.CHECKIN).first()["time"] == {"Mon-1": 3}


def test_text_users(spark):
    from millrace.operators import recommend, sketches

    names = [f"user-{k}" for k in range(40)]
    stream = spark.createDataFrame([(k // 20, k + 1, u) for k, u in enumerate(names + names[:10])], "batch long, seq long, user string")
    bits = {(c, int.from_bytes(u.encode(), "big")) for u in names for c in range(2)}
    assert len(bits) == 80 and [r["n_new"] for r in sketches.bloom_fpr(stream).orderBy("batch").collect()] == [20, 20, 0]
    assert all(r["estimate"] >= 1 for r in sketches.fm_distinct(stream, 200).collect())
    pairs = spark.createDataFrame([("x", u) for u in names[:10]] + [("y", u) for u in names[:8]] + [("z", "q")], "item string, user string")
    assert [(r["item_1"], r["item_2"], r["similarity"]) for r in recommend.lsh_pairs(pairs).collect()] == [("x", "y", 0.8)]
    assert sorted((r["n"], r["user"]) for r in recommend.user_index(pairs).collect()) == [(n, u) for n, u in enumerate(sorted({*names[:10], "q"}))]


def test_timing_report_finds_the_same_rows_both_ways(spark, tmp_path):
    import json

    import pytest

    from millrace.operators import relational

    reviews = spark.createDataFrame([(f"b{k % 13}", float(k % 5)) for k in range(200)] + [("b99", 9.0)], "business_id string, stars double")
    business = spark.createDataFrame([(f"b{k}", f"c{k % 4}" if k else None) for k in range(13)], "business_id string, city string")
    load = lambda: reviews.join(business, "business_id").groupBy("city").agg({"stars": "avg"}).toDF("city", "stars")
    got = sinks.timing_report(load, str(tmp_path / "t.json"), "city", "stars", 3)
    assert json.load(open(tmp_path / "t.json")) == got and list(got) == ["m1", "m2", "reason"] and got["m1"] > 0 and got["m2"] > 0
    ties = spark.createDataFrame([("b", 1.0), (None, 1.0), ("a", 1.0), ("z", None)], "city string, stars double")
    sinks.timing_report(lambda: ties, str(tmp_path / "u.json"), "city", "stars", 2)
    sinks.timing_report(lambda: ties.limit(0), str(tmp_path / "v.json"), "city", "stars")
    shown = iter([ties, ties.where("city = 'b'")])
    with pytest.raises(ValueError):
        sinks.timing_report(lambda: next(shown), str(tmp_path / "w.json"), "city", "stars", 2)


def test_basket_file_is_one_file_and_is_read_again(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('"DATE","C","x","y","z","P"\n"11/1/2000","007","a,b","","","0471"\n"11/12/2001","8","","","","52"\n"11/12/2001","8","","","","052"\n')
    pairs = transaction_pairs(tables.transactions(spark, str(p)))
    out = tmp_path / "out.csv"
    sinks.basket_file(pairs, str(out))
    text = open(out, newline="").read()
    assert text.startswith("DATE-CUSTOMER_ID,PRODUCT_ID\r\n") and sorted(text.split("\r\n")[1:]) == ["", "11/1/00-7,471", "11/12/01-8,52"]
    again = tables.header_csv(spark, str(out), "key STRING, item STRING")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, pairs.collect()))


def test_json_folder_feeds_the_features(spark, tmp_path):
    from millrace.operators import recommend

    lines = {
        "business": ['{"business_id":"b","city":"Reno","stars":4,"review_count":10,"is_open":1,"attributes":{"NoiseLevel":"loud"}}', '{"business_id":"c","stars":2}'],
        "tip": ['{"business_id":"b","user_id":"u","likes":2,"text":"x"}', '{"business_id":"b","user_id":"u","likes":3}', '{"business_id":"c"}'],
        "checkin": ['{"business_id":"b","time":{"Mon-1":3,"Tue-2":1}}'],
        "user": ['{"user_id":"u","review_count":5,"average_stars":3.5,"useful":7,"fans":1,"name":"n"}', '{"user_id":"v"}'],
    }
    for name, rows in lines.items():
        (tmp_path / f"{name}.json").write_text("\n".join(rows) + "\n")
    read = lambda name, schema: tables.json_lines(spark, str(tmp_path / f"{name}.json"), schema)
    tips, users = read("tip", tables.TIP), read("user", tables.USER)
    assert sorted((r["business_id"], r["likes"] or 0) for r in tips.collect()) == [("b", 2), ("b", 3), ("c", 0)]
    assert {r["user_id"]: r["fans"] for r in users.collect()} == {"u": 1, "v": None}
    pairs = spark.createDataFrame([("u", "b")], "user_id string, business_id string")
    x = recommend.features(pairs, read("business", tables.BUSINESS), tips, read("checkin", tables.CHECKIN), users).first()
    assert (x["tip_likes"], x["noise"], x["checkin_norm"], x["user_avg_stars"], x["useful"], x["fans"]) == (5.0, 3.0, 1.0, 3.5, 7.0, 1.0)
