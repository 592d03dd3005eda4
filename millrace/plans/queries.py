"""The library's queries over the standard tables, and equal SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import flag, in_year, map_sum, noise_level, number
from ..operators import graph, itemsets, recommend, relational, sketches
from ..sources.tables import parquet
from .lineage import cut, numbered, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# -- counts, top-k, averages

@query("SELECT count(*) AS n FROM lineitem")
def n_rows(spark, d):
    return relational.count_rows(parquet(spark, d, "lineitem"))


@query("SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def n_rows_in_year(spark, d):
    return relational.count_rows(parquet(spark, d, "orders").where(in_year(F.col("o_orderdate"), 1997)))


@query("SELECT count(DISTINCT o_custkey) AS n FROM orders")
def n_distinct_users(spark, d):
    return relational.count_keys(parquet(spark, d, "orders"), "o_custkey")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def top10_users(spark, d):
    return relational.top_keys(parquet(spark, d, "orders"), "o_custkey")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def top10_items(spark, d):
    return relational.top_keys(parquet(spark, d, "lineitem"), "l_partkey")


def _top_sql(column):
    return f"(SELECT string_agg(k || ':' || n, ',' ORDER BY n DESC, k) FROM (SELECT {column} AS k, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10))"


STATS = f"""SELECT count(*) AS n_review, count(*) FILTER (year(o_orderdate) = 1997) AS n_review_1997, count(DISTINCT o_custkey) AS n_user, count(DISTINCT o_orderpriority) AS n_business,
{_top_sql('o_custkey')} AS top10_user, {_top_sql('o_orderpriority')} AS top10_business FROM orders"""


@query(STATS)
def review_stats(spark, d):
    o = parquet(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("business_id"), F.col("o_orderdate").cast("string").alias("date"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["n"].cast("string"))), ",").alias(c)
    return relational.review_stats(o, 1997).select("n_review", "n_review_1997", "n_user", "n_business", text("top10_user"), text("top10_business"))


def _supplied(spark, d):
    s = parquet(spark, d, "supplier").join(parquet(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    return parquet(spark, d, "lineitem").select("l_suppkey", "l_quantity"), s


AVG = "SELECT n_name, round(avg(l_quantity), 6) AS avg_value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 ORDER BY avg_value DESC, 1"


@query(AVG)
def avg_by_group_sorted(spark, d):
    return relational.grouped_average(*_supplied(spark, d), "l_suppkey", "n_name", "l_quantity")


@query(AVG + " LIMIT 10")
def top10_groups_by_avg(spark, d):
    return avg_by_group_sorted(spark, d).limit(10)


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey")
def left_avg_default(spark, d):
    n = parquet(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return relational.left_with_default(parquet(spark, d, "customer").select("c_custkey"), n, "c_custkey", "n", F.lit(0))


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def known_items(spark, d):
    return relational.known(parquet(spark, d, "part").select("p_partkey"), parquet(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def unknown_items(spark, d):
    return relational.unknown(parquet(spark, d, "part").select("p_partkey"), parquet(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("SELECT i::BIGINT AS partition, coalesce(n, 0) AS n_items FROM range(8) t(i) LEFT JOIN (SELECT ascii(p_name) % 8 AS p, count(*) AS n FROM part GROUP BY 1) ON i = p")
def partition_report(spark, d):
    return _longs(relational.first_letter_partitions(parquet(spark, d, "part"), "p_name", 8), "partition", "n_items")


# -- baskets and itemsets: orders as baskets of brands

BRANDS = "SELECT DISTINCT l_orderkey AS key, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey"


def _lines(spark, d):
    p = parquet(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return parquet(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(p, "l_partkey")


def _brands(spark, d):
    return itemsets.pairs_of_case(_lines(spark, d), "l_orderkey", "p_brand", 1)


def _support(pairs):
    """Half a percent of the baskets, at least 2."""
    return max(2, pairs.select("key").distinct().count() // 200)


def _sets(spark, d, size):
    pairs = cut(_brands(spark, d))
    return itemsets.frequent_itemsets(pairs, _support(pairs), size).where(F.size("itemset") == size).select(F.concat_ws(",", "itemset").alias("itemset"), "n")


def _sets_sql(size):
    froms = " ".join(f"JOIN b b{i} ON b{i}.key = b0.key AND b{i}.item > b{i - 1}.item" for i in range(1, size))
    cols = " || ',' || ".join(f"b{i}.item" for i in range(size))
    return f"WITH b AS ({BRANDS}), s AS (SELECT greatest(2, count(DISTINCT key) // 200) AS s FROM b) SELECT {cols} AS itemset, count(*) AS n FROM b b0 {froms} GROUP BY 1 HAVING count(*) >= (SELECT s FROM s)"


def _all_sets_sql(largest):
    return " UNION ALL ".join(f"SELECT * FROM ({_sets_sql(k)})" for k in range(1, largest + 1))


@query(f"SELECT key, string_agg(item, ',' ORDER BY item) AS items FROM ({BRANDS}) GROUP BY key HAVING count(*) > 2")
def baskets_case1(spark, d):
    return itemsets.baskets(_brands(spark, d), "key", "item", 2).select("key", F.concat_ws(",", "items").alias("items"))


@query("SELECT key, count(*) AS n_items FROM (SELECT DISTINCT p_brand AS key, l_suppkey AS item FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY key")
def baskets_case2(spark, d):
    p = parquet(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    pairs = itemsets.pairs_of_case(parquet(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(p, "l_partkey"), "l_suppkey", "p_brand", 2)
    return itemsets.baskets(pairs, "key", "item").select("key", F.size("items").cast("long").alias("n_items"))


@query(_sets_sql(1))
def frequent_singles(spark, d):
    return _sets(spark, d, 1)


@query(_sets_sql(2))
def frequent_pairs(spark, d):
    return _sets(spark, d, 2)


@query(f"SELECT coalesce(max(len(itemset) - len(replace(itemset, ',', '')) + 1), 0)::BIGINT AS n FROM ({_all_sets_sql(7)})")
def longest_itemset(spark, d):
    pairs = cut(_brands(spark, d))
    return itemsets.longest(itemsets.frequent_itemsets(pairs, _support(pairs)))


@query(_sets_sql(3))
def frequent_triples(spark, d):
    return _sets(spark, d, 3)


@query()
def son_candidates(spark, d):
    pairs = cut(_brands(spark, d))
    return itemsets.son_candidates(pairs, _support(pairs), 4).select(F.concat_ws(",", "itemset").alias("itemset"))


#: An order has at most seven lines, so no itemset is larger.
@query(_all_sets_sql(7))
def fp_growth(spark, d):
    sets = itemsets.equal_baskets(_lines(spark, d), "l_orderkey", "p_brand")
    n = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return itemsets.fp_growth(sets, max(2, n // 200)).select(F.concat_ws(",", "itemset").alias("itemset"), "n")


TX = "SELECT month(o_orderdate) || '/' || day(o_orderdate) || '/' || right(year(o_orderdate)::VARCHAR, 2) || '-' || ltrim(lpad(o_custkey::VARCHAR, 8, '0'), '0') AS key, ltrim(lpad(l_suppkey::VARCHAR, 8, '0'), '0') AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


@query(f"SELECT key, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT key, item FROM ({TX})) GROUP BY key HAVING count(*) > 3")
def transaction_baskets(spark, d):
    o = parquet(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "M/d/yyyy").alias("date"), F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("customer"))
    tx = parquet(spark, d, "lineitem").select("l_orderkey", F.lpad(F.col("l_suppkey").cast("string"), 8, "0").alias("product")).join(o, "l_orderkey")
    return itemsets.baskets(itemsets.transaction_pairs(tx), "key", "item", 3).select("key", F.concat_ws(",", "items").alias("items"))


# -- similarity and recommendation: users, items (props) and mean values of events

RATED = "SELECT user_id AS u, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS i, avg(value) AS r FROM events GROUP BY 1, 2"


def _ratings(spark, d):
    e = parquet(spark, d, "events").select(F.col("user_id").alias("user"), F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("item"), "value")
    return e.groupBy("user", "item").agg(F.avg("value").alias("rating"))


SIMILAR = f"""WITH r AS ({RATED}), s AS (SELECT i, count(*) AS n FROM r GROUP BY 1),
c AS (SELECT a.i AS item_1, b.i AS item_2, count(*) AS c FROM r a JOIN r b ON a.u = b.u AND a.i < b.i GROUP BY 1, 2)
SELECT item_1, item_2, round(c / (s1.n + s2.n - c), 6) AS similarity FROM c JOIN s s1 ON s1.i = item_1 JOIN s s2 ON s2.i = item_2 WHERE c / (s1.n + s2.n - c) >= 0.5"""


@query(SIMILAR)
def jaccard_pairs(spark, d):
    return recommend.jaccard_pairs(_ratings(spark, d).select("item", "user"))


@query(SIMILAR)
def lsh_pairs(spark, d):
    return recommend.lsh_pairs(_ratings(spark, d).select("item", "user"))


@query(f"SELECT r.i AS item, k AS i, min(((((k + 1) * 1103515245 + 12345) % 2147483647) * (((u * u) % 1000000007 * 48271 + u * 69621 + 7) % 1000000007) + (k * 15485863 + 32452843) % 98387 + 1) % 2147483647) AS h FROM ({RATED}) r, range(100) t(k) GROUP BY 1, 2")
def minhash_signatures(spark, d):
    return recommend.minhash_signatures(_ratings(spark, d).select("item", "user"))


PEARSON = f"""r AS ({RATED}), s AS (SELECT a.i AS item_1, b.i AS item_2, count(*) AS n, sum(a.r) AS sx, sum(b.r) AS sy, sum(a.r * a.r) AS xx, sum(b.r * b.r) AS yy, sum(a.r * b.r) AS xy FROM r a JOIN r b ON a.u = b.u AND a.i < b.i GROUP BY 1, 2),
p AS (SELECT item_1, item_2, n AS n_common, CASE WHEN xx - sx * sx / n > 1e-9 AND yy - sy * sy / n > 1e-9 THEN (xy - sx * sy / n) / sqrt((xx - sx * sx / n) * (yy - sy * sy / n)) ELSE 0 END AS r FROM s)"""


@query(f"WITH {PEARSON} SELECT item_1, item_2, n_common, round(r, 6) AS r FROM p")
def item_pearson(spark, d):
    return recommend.item_pearson(_ratings(spark, d)).withColumn("r", F.round("r", 6))


def _split(spark, d):
    """Training ratings, and one pair in ten, with some new users and items, as targets."""
    r = cut(_ratings(spark, d))
    held = F.pmod(F.col("user") * 31 + F.col("item"), F.lit(10)) == 0
    old = r.where(held).select((F.col("user") * 1000 + F.col("item")).alias("row_id"), "user", "item", "rating")
    new = r.where((F.col("item") < 3) & ~held).select((F.col("user") * 1000 + F.col("item") + 100_000_000).alias("row_id"), (F.col("user") + F.when(F.col("item") != 1, 1_000_000).otherwise(0)).alias("user"), (F.col("item") + F.when(F.col("item") != 0, 1_000_000).otherwise(0)).alias("item"), "rating")
    return r.where(~held), old.union(new)


CF = PEARSON.replace(f"r AS ({RATED}),", f"""ra AS ({RATED}), r AS (SELECT * FROM ra WHERE (u * 31 + i) % 10 <> 0),""", 1) + """,
t AS (SELECT u * 1000 + i AS row_id, u, i FROM ra WHERE (u * 31 + i) % 10 = 0 UNION ALL SELECT u * 1000 + i + 100000000, u + CASE WHEN i <> 1 THEN 1000000 ELSE 0 END, i + CASE WHEN i <> 0 THEN 1000000 ELSE 0 END FROM ra WHERE i < 3 AND (u * 31 + i) % 10 <> 0),
sim AS (SELECT item_1 AS i, item_2 AS o, r FROM p WHERE n_common >= 10 AND r > 0.5 UNION ALL SELECT item_2, item_1, r FROM p WHERE n_common >= 10 AND r > 0.5),
nb AS (SELECT t.row_id, sim.r AS w, r.r AS v, row_number() OVER (PARTITION BY t.row_id ORDER BY sim.r, sim.o) AS k FROM t JOIN sim ON t.i = sim.i JOIN r ON r.u = t.u AND r.i = sim.o),
sc AS (SELECT row_id, sum(w * v) AS above, sum(abs(w)) AS below FROM nb WHERE k <= 10 GROUP BY 1),
im AS (SELECT i, avg(r) AS m FROM r GROUP BY 1), um AS (SELECT u, avg(r) AS m FROM r GROUP BY 1), g AS (SELECT avg(r) AS m FROM r)
SELECT t.row_id, t.u AS "user", t.i AS item, round(CASE WHEN im.m IS NULL AND um.m IS NULL THEN g.m WHEN um.m IS NULL THEN im.m WHEN im.m IS NULL THEN um.m WHEN below <> 0 AND above <> 0 THEN above / below ELSE 0.6 * im.m + 0.4 * um.m END, 6) AS prediction
FROM t LEFT JOIN sc USING (row_id) LEFT JOIN im ON im.i = t.i LEFT JOIN um ON um.u = t.u, g"""


@query(f"WITH {CF}")
def item_cf_predictions(spark, d):
    train, targets = _split(spark, d)
    return recommend.item_cf(train, targets.select("row_id", "user", "item"))


@query(f"WITH {CF} WHERE t.row_id >= 100000000")
def cold_start(spark, d):
    train, targets = _split(spark, d)
    return recommend.item_cf(train, targets.where("row_id >= 100000000").select("row_id", "user", "item"))


@query("SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS total FROM events")
def map_value_sum(spark, d):
    m = F.from_json("props", "map<string,bigint>")
    return parquet(spark, d, "events").select("event_id", map_sum(m).alias("total"))


LEVELS = ("quiet", "average", "loud", "very_loud")


@query(
    "SELECT event_id, CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 0 END::BIGINT AS noise, (k % 2)::BIGINT AS flag, "
    "CASE WHEN k > 50 THEN k::DOUBLE ELSE 0 END AS price FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)"
)
def attribute_encode(spark, d):
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    noise = F.get(F.array(*map(F.lit, LEVELS)), (k % 5).cast("int"))  # null for 4
    a = F.create_map(F.lit("NoiseLevel"), noise, F.lit("flag"), F.when(k % 2 == 1, "True").otherwise("no"), F.lit("price"), F.when(k > 50, k.cast("string")))
    e = parquet(spark, d, "events").withColumn("a", a)
    at = lambda n: F.try_element_at("a", F.lit(n))
    return e.select("event_id", noise_level(at("NoiseLevel")).cast("long").alias("noise"), flag(at("flag")).cast("long").alias("flag"), number(at("price")).alias("price"))


def _review_tables(spark, d):
    """Stand-ins with the shapes of the five review tables: orders as pairs of customer and clerk-like supplier."""
    li = parquet(spark, d, "lineitem").join(parquet(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    pairs = li.select(F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("business_id"), (F.col("l_quantity") / 10).alias("stars"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"))
    s = parquet(spark, d, "supplier")
    attributes = F.when(F.col("s_suppkey") % 5 != 0, F.create_map(F.lit("NoiseLevel"), F.when(F.col("s_suppkey") % 2 == 0, "quiet").otherwise("loud"), F.lit("RestaurantsPriceRange2"), (F.col("s_suppkey") % 4).cast("string"), F.lit("GoodForKids"), F.when(F.col("s_suppkey") % 3 == 0, "True").otherwise("False")))
    business = s.select(F.col("s_suppkey").alias("business_id"), F.col("s_nationkey").cast("string").alias("city"), (F.col("s_suppkey") % 5 + 1).cast("double").alias("stars"), (F.col("s_suppkey") % 100).alias("review_count"), (F.col("s_suppkey") % 2).cast("int").alias("is_open"), attributes.alias("attributes"))
    tips = li.where("l_linenumber = 1").select(F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("business_id"), F.col("l_quantity").cast("long").alias("likes"))
    checkins = s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("business_id"), F.create_map(F.lit("Mon-1"), F.col("s_suppkey"), F.lit("Tue-2"), F.col("s_suppkey") % 7).alias("time"))
    users = parquet(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 50).alias("review_count"), (F.col("c_custkey") % 5 + 0.5).cast("double").alias("average_stars"), (F.col("c_custkey") % 9).alias("useful"), (F.col("c_custkey") % 3).alias("fans"))
    return pairs, business, tips, checkins, users


FEATURES_SQL = """WITH li AS (SELECT o_custkey AS u, l_suppkey AS b, l_orderkey * 10 + l_linenumber AS row_id, l_quantity AS q, l_linenumber AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
tip AS (SELECT u, b, sum(q::BIGINT)::DOUBLE AS likes FROM li WHERE n = 1 GROUP BY 1, 2),
biz AS (SELECT s_suppkey AS b, s_nationkey, (s_suppkey % 5 + 1)::DOUBLE AS stars, s_suppkey % 100 AS rc, (s_suppkey % 2)::DOUBLE AS open, avg((s_suppkey % 5 + 1)::DOUBLE) OVER (PARTITION BY s_nationkey) AS city, s_suppkey % 5 <> 0 AS has, CASE WHEN s_suppkey % 2 = 0 THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END AS noise, (s_suppkey % 4)::DOUBLE AS price, CASE WHEN s_suppkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS kids FROM supplier),
chk AS (SELECT s_suppkey AS b, (s_suppkey + s_suppkey % 7)::DOUBLE AS c FROM supplier WHERE s_suppkey % 3 <> 0),
usr AS (SELECT c_custkey AS u, (c_custkey % 50)::DOUBLE AS rc, (c_custkey % 5 + 0.5)::DOUBLE AS st, (c_custkey % 9)::DOUBLE AS useful, (c_custkey % 3)::DOUBLE AS fans FROM customer WHERE c_custkey % 4 <> 0),
t AS (SELECT (SELECT avg(likes) FROM tip) AS ml, (SELECT avg(noise) FROM biz WHERE has) AS mn, (SELECT avg(rc) FROM biz) AS mr, (SELECT avg(c) FROM chk) AS mc, (SELECT avg(rc) FROM usr) AS ur, (SELECT avg(st) FROM usr) AS us, (SELECT avg(useful) FROM usr) AS uu, (SELECT avg(fans) FROM usr) AS uf)
SELECT row_id, round(coalesce(likes, ml), 6) AS tip_likes, round(CASE WHEN has THEN noise ELSE mn END, 6) AS noise, CASE WHEN has THEN price ELSE 1.5::DOUBLE END AS price, CASE WHEN has THEN kids ELSE 0::DOUBLE END AS good_for_kids, 0::DOUBLE AS good_for_groups, CASE WHEN has THEN 0::DOUBLE ELSE 1::DOUBLE END AS bike_parking, 0::DOUBLE AS table_service,
round(coalesce(chk.c / mc, 0), 6) AS checkin_norm, biz.stars AS biz_stars, round(biz.rc / mr, 6) AS biz_review_norm, open AS is_open, round(city, 6) AS city_avg, round(coalesce(usr.rc / ur, 0), 6) AS user_review_norm, round(coalesce(st, us), 6) AS user_avg_stars, round(coalesce(useful, uu), 6) AS useful, round(coalesce(fans, uf), 6) AS fans
FROM li LEFT JOIN tip ON tip.u = li.u AND tip.b = li.b LEFT JOIN biz ON biz.b = li.b LEFT JOIN chk ON chk.b = li.b LEFT JOIN usr ON usr.u = li.u, t"""


@query(FEATURES_SQL)
def features_16(spark, d):
    x = recommend.features(*_review_tables(spark, d))
    return x.select("row_id", *[F.round(c, 6).alias(c) for c in recommend.FEATURES])


def _boosted(spark, d):
    x = stored(recommend.features(*_review_tables(spark, d)))
    held = F.pmod("row_id", F.lit(5)) == 0
    return recommend.boosted(x.where(~held), x.where(held))


@query()
def boosted_predictions(spark, d):
    return _boosted(spark, d).select("row_id", "user_id", "business_id", "prediction")


@query(
    "SELECT o_custkey AS user_id, l_suppkey AS business_id, min(l_orderkey * 10 + l_linenumber) AS row_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE (l_orderkey * 10 + l_linenumber) % 5 = 0 GROUP BY 1, 2"
)
def distinct_predictions(spark, d):
    pairs = _review_tables(spark, d)[0].where(F.pmod("row_id", F.lit(5)) == 0)
    return recommend.distinct_predictions(pairs.select("row_id", "user_id", "business_id")).select("user_id", "business_id", "row_id")


@query()
def rmse(spark, d):
    return recommend.rmse(_boosted(spark, d), "stars")


@query()
def hybrid(spark, d):
    """Trees over the 16 features and item-based neighbours over the same training pairs, 0.78 to 0.22."""
    x = stored(recommend.features(*_review_tables(spark, d)).withColumn("_row", F.monotonically_increasing_id()))  # row_id repeats
    held = F.pmod("row_id", F.lit(5)) == 0
    tree = recommend.boosted(x.where(~held), x.where(held)).select(F.col("_row").alias("row_id"), "prediction")
    ratings = stored(x.where(~held).groupBy(F.col("user_id").alias("user"), F.col("business_id").alias("item")).agg(F.avg("stars").alias("rating")))
    cf = recommend.item_cf(ratings, x.where(held).select(F.col("_row").alias("row_id"), F.col("user_id").alias("user"), F.col("business_id").alias("item")))
    both = recommend.hybrid(tree, cf).select(F.col("row_id").alias("_row"), F.round("prediction", 6).alias("prediction"))
    return both.join(x.select("_row", "row_id"), "_row").select("row_id", "prediction")


# -- graphs: suppliers that share parts


def _supplier_pairs(spark, d):
    return parquet(spark, d, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("item")).distinct()


def _edges(spark, d):
    """Suppliers that share at least 0.92 times as many parts as those that share the most; pairs are counted once."""
    counts = stored(graph.share_counts(_supplier_pairs(spark, d)))
    t = counts.agg(F.max("n")).first()[0]
    return cut(graph.both_ways(counts.where(F.col("n") >= max(1, int(t or 1) * 92 // 100))))


EDGES = """p AS (SELECT DISTINCT l_suppkey AS node, l_partkey AS item FROM lineitem), n AS (SELECT a.node AS src, b.node AS dst, count(*) AS n FROM p a JOIN p b ON a.item = b.item AND a.node < b.node GROUP BY 1, 2),
h AS (SELECT src, dst FROM n WHERE n >= greatest(1, (SELECT max(n) FROM n) * 92 // 100)), e AS (SELECT src, dst FROM h UNION ALL SELECT dst, src FROM h)"""


@query(f"WITH {EDGES} SELECT src, dst FROM e")
def coshare_edges(spark, d):
    return _edges(spark, d)


def _propagated_sql():
    steps, last = [], "l0"
    for k in range(1, 6):
        steps.append(f"l{k} AS (SELECT id, label FROM (SELECT e.dst AS id, label, row_number() OVER (PARTITION BY e.dst ORDER BY count(*) DESC, label) AS k FROM e JOIN {last} ON e.src = {last}.id GROUP BY 1, 2) WHERE k = 1)")
        last = f"l{k}"
    return f"WITH {EDGES}, l0 AS (SELECT DISTINCT src AS id, src AS label FROM e), {', '.join(steps)} "


@query(_propagated_sql() + "SELECT id, label FROM l5")
def label_propagation(spark, d):
    return graph.label_propagation(_edges(spark, d))


@query(_propagated_sql() + "SELECT string_agg(id::VARCHAR, ',' ORDER BY id) AS members, count(*) AS n FROM l5 GROUP BY label")
def communities(spark, d):
    c = graph.communities(graph.label_propagation(_edges(spark, d)))
    return c.select(F.concat_ws(",", F.transform("members", lambda x: x.cast("string"))).alias("members"), F.size("members").cast("long").alias("n"))


REACH = f"WITH RECURSIVE {EDGES}, r AS (SELECT src AS id, src AS o FROM e UNION SELECT r.id, e.dst FROM r JOIN e ON r.o = e.src)"


@query(REACH + " SELECT id, min(o) AS component FROM r GROUP BY id")
def components(spark, d):
    return graph.connected(_edges(spark, d))


@query(REACH + ", c AS (SELECT id, min(o) AS c FROM r GROUP BY id), g AS (SELECT a.c, count(*) AS deg, count(*) FILTER (a.c = b.c) AS inn FROM e JOIN c a ON a.id = e.src JOIN c b ON b.id = e.dst GROUP BY 1), m AS (SELECT sum(deg)::DOUBLE AS m FROM g) SELECT round(sum(inn / m - pow(deg / m, 2)), 6) AS modularity FROM g, m")
def modularity(spark, d):
    e = _edges(spark, d)
    return graph.modularity(e, graph.connected(e))


def _betweenness_sql(steps=24):
    """Distances by recursion, shortest paths counted length by length (up to `steps`), and for each edge the pairs that it lies between."""
    walks = ["w0 AS MATERIALIZED (SELECT id AS s, id AS v, 0 AS depth, 1::DOUBLE AS n FROM nodes)"]
    for k in range(1, steps + 1):
        walks.append(f"w{k} AS MATERIALIZED (SELECT w.s, e.dst AS v, {k} AS depth, sum(w.n) AS n FROM w{k - 1} w JOIN e ON e.src = w.v JOIN dist ON dist.s = w.s AND dist.v = e.dst AND dist.depth = {k} GROUP BY 1, 2)")
    union = " UNION ALL ".join(f"SELECT * FROM w{k}" for k in range(steps + 1))
    return f"""WITH RECURSIVE {EDGES}, nodes AS (SELECT DISTINCT src AS id FROM e),
reach AS (SELECT id AS s, id AS v, 0 AS depth FROM nodes UNION SELECT s, e.dst, depth + 1 FROM reach JOIN e ON e.src = reach.v WHERE depth < {steps}),
dist AS MATERIALIZED (SELECT s, v, min(depth) AS depth FROM reach GROUP BY 1, 2), {', '.join(walks)}, sp AS MATERIALIZED ({union})
SELECT least(e.src, e.dst) AS u, greatest(e.src, e.dst) AS v, round(sum(a.n * b.n / st.n) / 2, 6) AS score
FROM e JOIN sp a ON a.v = e.src JOIN sp b ON b.s = e.dst JOIN sp st ON st.s = a.s AND st.v = b.v AND st.depth = a.depth + 1 + b.depth GROUP BY 1, 2"""


@query(_betweenness_sql())
def edge_betweenness(spark, d):
    return graph.edge_betweenness(_edges(spark, d)).withColumn("score", F.round("score", 6))


@query()
def divisive_communities(spark, d):
    return graph.divisive_communities(_edges(spark, d))


# -- streams: events in order of (ts, event_id), 1,000 a batch

STREAM = "SELECT user_id AS u, row_number() OVER (ORDER BY ts, event_id) AS seq, (row_number() OVER (ORDER BY ts, event_id) - 1) // 1000 AS batch FROM events"
COEF = "((k * 7919 + 104729) % 99991 + 1)", "((k * 15485863 + 32452843) % 98387 + 1)"


def _stream(spark, d):
    s = numbered(parquet(spark, d, "events").select("ts", "event_id", F.col("user_id").alias("user")), ["ts", "event_id"])
    return s.select("seq", F.expr("(seq - 1) div 1000").alias("batch"), "user")


@query(f"""WITH s AS ({STREAM}), f AS (SELECT u, min(seq) AS seq, min(batch) AS batch FROM s GROUP BY 1), p AS (SELECT u, seq, batch, ({COEF[0]} * u + {COEF[1]}) % 69997 AS pos FROM f, range(60) t(k)),
w AS (SELECT pos, min(seq) AS set_at FROM p GROUP BY 1), j AS (SELECT u, batch, bool_and(set_at < seq) AS hit FROM p JOIN w USING (pos) GROUP BY 1, 2), g AS (SELECT batch, count(*) AS n_new, count(*) FILTER (hit) AS n_false FROM j GROUP BY 1)
SELECT b.batch, coalesce(n_new, 0) AS n_new, coalesce(n_false, 0) AS n_false, round(n_false / n_new, 6) AS fpr FROM (SELECT DISTINCT batch FROM s) b LEFT JOIN g USING (batch)""")
def bloom_fpr(spark, d):
    return sketches.bloom_fpr(_stream(spark, d))


@query(f"""WITH u AS (SELECT DISTINCT batch, u FROM ({STREAM})), h AS (SELECT batch, u, k, ({COEF[0]} * (u * 2654435 + 97) + {COEF[1]}) % 100000000 AS h FROM u, range(2000) t(k)),
z AS (SELECT batch, k, max(CASE WHEN h = 0 THEN 1 ELSE bit_count((h & -h) - 1) END) AS z FROM h GROUP BY 1, 2), g AS (SELECT batch, k // 500 AS g, pow(2, avg(z)) AS e FROM z GROUP BY 1, 2)
SELECT batch, n_distinct, floor(median(e))::BIGINT AS estimate FROM g JOIN (SELECT batch, count(*) AS n_distinct FROM u GROUP BY 1) USING (batch) GROUP BY 1, 2""")
def fm_distinct(spark, d):
    return sketches.fm_distinct(_stream(spark, d))


@query(f"""WITH s AS ({STREAM}), w AS (SELECT seq, u, CASE WHEN seq <= 100 THEN seq - 1 WHEN ((seq * 7919 + 104729) % 10007) / 10007 * seq < 100 THEN (seq * 104729 + 7919) % 100 END AS slot FROM s)
SELECT e.seq AS seqnum, slot, arg_max(w.u, w.seq) AS "user" FROM s e JOIN w ON w.seq <= e.seq WHERE e.seq % 100 = 0 AND slot IN (0, 20, 40, 60, 80) GROUP BY 1, 2""")
def reservoir_snapshots(spark, d):
    return sketches.reservoir_snapshots(_stream(spark, d))


@query()
def hll_distinct(spark, d):
    return sketches.hll_distinct(_stream(spark, d))
