"""Similarity, item-based collaborative filtering, features, and boosted and hybrid predictions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import affine, coefficients, flag, map_sum, noise_level, number
from ..plans.lineage import numbered, ranked, stored
from . import links, trees


def _least(share: float):
    """How many of n a share of them is at least; a hair below a whole number counts as that."""
    return F.ceil(F.lit(share) * F.col("n") - 1e-9)


def similar_candidates(pairs: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """(small, large, n1, n2), small the item with fewer users (the lesser of equal ones): all item pairs that may reach the threshold.

    Users of an item are ranked rarest first. Sets that overlap enough share a user
    among the first n - ceil(t * n) + 1 of the larger and the first
    n - ceil(2 t / (1 + t) * n) + 1 of the smaller, so only these prefixes meet, by
    user and by a class of sizes, a factor 1 / t wide, and its neighbour. What is
    left after the first shared user must still suffice. A user that most items
    have stands behind the others' prefixes.
    """
    t = threshold
    seen = pairs.groupBy("user").agg(F.count("*").alias("seen"))
    x = ranked(pairs.join(seen, "user").select("item", "user", "seen"), ["item"], ["seen", "user"], "at").join(sizes, "item")
    size_class = F.floor(F.log("n") / math.log(1 / t) * (1 - 1e-9)) if t < 1 else F.col("n")  # a hair narrower, so that a factor 1 / t never spans three
    x = x.withColumn("class", size_class.cast("long"))
    small = x.where(F.col("at") <= F.col("n") - _least(2 * t / (1 + t)) + 1).select("user", "class", F.col("item").alias("small"), F.col("n").alias("n1"), F.col("at").alias("at1"))
    large = x.where(F.col("at") <= F.col("n") - _least(t) + 1)
    large = large.select("user", F.explode(F.array("class", F.col("class") - 1)).alias("class"), F.col("item").alias("large"), F.col("n").alias("n2"), F.col("at").alias("at2"))
    met = small.join(large, ["user", "class"]).where("(n1 < n2 OR n1 = n2 AND small < large)").where(F.col("n2") * t <= F.col("n1") + 1e-9)
    first = met.groupBy("small", "large", "n1", "n2").agg(F.min("at1").alias("at1"), F.min("at2").alias("at2"))
    most = F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2")) + 1
    return first.where(most >= F.lit(t / (1 + t)) * (F.col("n1") + F.col("n2")) - 1e-9).select("small", "large", "n1", "n2")


#: Candidates that go to every task, at most, and rows of the two ways to count them: a row by items is shuffled, one by users is not.
BROADCAST_PAIRS, USER_ROWS = 1 << 16, 8


def _by_items(cand: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row (small, large, n1, n2) for each user that a candidate's items share: the smaller one's users are looked up in the larger one."""
    u1, u2 = pairs.select(F.col("item").alias("small"), "user"), pairs.select(F.col("item").alias("large"), "user")
    return cand.join(u1, "small").join(u2, ["large", "user"])


def _by_users(cand: DataFrame, own: DataFrame) -> DataFrame:
    """The same rows from history_blocks(), pairs of a user's items that are a candidate, which go to every task; a task sums its own before any shuffle."""
    short, long = own.where("blocks = 1").select("own", F.col("own").alias("other")), own.where("blocks > 1")
    met = long.select("user", "own").join(long.select("user", F.col("own").alias("other")), "user").select("own", "other")
    p = short.union(met).select(F.explode("own.item").alias("small"), F.col("other.item").alias("other")).select("small", F.explode("other").alias("large"))
    return p.join(F.broadcast(cand), ["small", "large"])


def jaccard_pairs(pairs: DataFrame, threshold: float = 0.5, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """pairs(item, user), distinct, to (item_1, item_2, similarity) with at least `threshold` (over 0 to 1): an exact set-similarity join.

    Candidates are counted in full from the smaller set's users, or, where few
    candidates hold most of what users share, from the pairs of each user's items. A
    null user belongs to an item's size but is shared by none; a null item has no pairs.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    sizes = stored(pairs.where("item IS NOT NULL").groupBy("item").agg(F.count("*").alias("n")))
    cand = similar_candidates(pairs, sizes, threshold)
    cand = stored(cand)
    n, by_items = cand.agg(F.count("*"), F.coalesce(F.sum("n1"), F.lit(0))).first()
    met = None
    if 0 < n <= broadcast_pairs:
        own = stored(history_blocks(pairs.where("user IS NOT NULL AND item IS NOT NULL").select("user", "item", F.lit(0).alias("rating"))))
        by_users = own.groupBy("user").agg(F.sum(F.size("own").cast("double")).alias("d")).agg(F.sum(F.col("d") * F.col("d"))).first()[0]
        met = _by_users(cand, own) if by_users <= USER_ROWS * by_items else None
    both = (_by_items(cand, pairs) if met is None else met).groupBy("small", "large", "n1", "n2").agg(F.count("*").alias("c"))
    out = both.withColumn("similarity", F.col("c") / (F.col("n1") + F.col("n2") - F.col("c"))).where(F.col("similarity") >= threshold)
    return out.select(F.least("small", "large").alias("item_1"), F.greatest("small", "large").alias("item_2"), F.round("similarity", 6).alias("similarity"))


def _similar(both: DataFrame, size: DataFrame, threshold: float) -> DataFrame:
    s1, s2 = size.toDF("item_1", "n1"), size.toDF("item_2", "n2")
    out = both.join(s1, "item_1").join(s2, "item_2").withColumn("similarity", F.col("c") / (F.col("n1") + F.col("n2") - F.col("c")))
    return out.where(F.col("similarity") >= threshold).select("item_1", "item_2", F.round("similarity", 6).alias("similarity"))


def minhash_signatures(pairs: DataFrame, user_number: str = "user", hashes: int = 100, modulus: int = 2_147_483_647) -> DataFrame:
    """pairs(item, user: number or text) to (item, i, h): the least of each affine hash over an item's users; partial minima.

    Texts are first turned into numbers by their hash; user_index() gives dense ones.
    """
    a, b = F.pmod((F.col("i") + 1) * 1_103_515_245 + 12_345, F.lit(2_147_483_647)), coefficients(F.col("i"))[1]
    x = pairs.select("item", (F.pmod(F.xxhash64(user_number), F.lit(modulus)) if pairs.schema[user_number].dataType.typeName() == "string" else F.col(user_number).cast("long")).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hashes - 1).cast("long"))).alias("i"))
    y = F.pmod(F.col("x"), F.lit(2_147_483_647))
    spread = F.pmod(F.pmod(y * y, F.lit(1_000_000_007)) * 48271 + y * 69621 + 7, F.lit(1_000_000_007))  # not affine in x, so that the hashes of close numbers are unalike
    return x.groupBy("item", "i").agg(F.min(affine(spread, a, b, modulus)).alias("h"))


def lsh_pairs(pairs: DataFrame, threshold: float = 0.5, bands: int = 50, rows: int = 2) -> DataFrame:
    """jaccard_pairs() of items that agree on all rows of some band; candidates are verified exactly."""
    sig = minhash_signatures(pairs, hashes=bands * rows)
    band = sig.groupBy("item", F.floor(F.col("i") / rows).alias("band")).agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("key"))
    a, b = band.select(F.col("item").alias("item_1"), "band", "key"), band.select(F.col("item").alias("item_2"), "band", "key")
    cand = a.join(b, ["band", "key"]).where("item_1 < item_2").select("item_1", "item_2").distinct()
    size = pairs.groupBy("item").agg(F.count("*").alias("n"))
    u1, u2 = pairs.select(F.col("item").alias("item_1"), "user"), pairs.select(F.col("item").alias("item_2"), "user")
    both = cand.join(u1, "item_1").join(u2, ["item_2", "user"]).groupBy("item_1", "item_2").agg(F.count("*").alias("c"))
    return _similar(both, size, threshold)


def item_pearson(ratings: DataFrame) -> DataFrame:
    """ratings(user, item, rating) to (item_1, item_2, n_common, r) for item_1 < item_2 with common users.

    Means are over the common users; r is 0 where either side has no variance.
    """
    a, b = ratings.toDF("user", "item_1", "x"), ratings.toDF("user", "item_2", "y")
    return _pearson(a.join(b, "user").where("item_1 < item_2"))


def _pearson(pairs: DataFrame) -> DataFrame:
    """pairs(item_1, item_2, x, y), a row for each common user, to (item_1, item_2, n_common, r)."""
    s = pairs.groupBy("item_1", "item_2").agg(F.count("*").alias("n"), *[F.sum(F.expr(e)).alias(k) for k, e in (("sx", "x"), ("sy", "y"), ("xx", "x * x"), ("yy", "y * y"), ("xy", "x * y"))])
    return _correlated(s)


def _correlated(s: DataFrame) -> DataFrame:
    vx, vy = F.col("xx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("yy") - F.col("sy") * F.col("sy") / F.col("n")
    r = F.when((vx > 1e-9) & (vy > 1e-9), (F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy)).otherwise(0.0)
    return s.select("item_1", "item_2", F.col("n").alias("n_common"), r.alias("r"))


#: Entries of lists that one pass of item_links may shuffle, however few the ratings are.
PAIR_ROWS = 1 << 23

#: Ratings of a block that a user's history is cut into, and parts in which a longer history finds its size.
HISTORY_ROWS, SALTS = 256, 64


def history_blocks(ratings: DataFrame, block_rows: int = HISTORY_ROWS) -> DataFrame:
    """ratings(user, item, rating) to (user, block, blocks, own): a user's ratings in blocks of about block_rows by the hash of the item.

    Only users beyond one block are looked up, by user and one of SALTS parts, so
    that no task gets a whole history.
    """
    size = ratings.groupBy("user").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")).where("blocks > 1")
    size = size.select("user", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    x = ratings.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)).cast("int")).join(size, ["user", "salt"], "left")
    x = x.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "item"), F.col("blocks")).cast("int"))
    return x.groupBy("user", "block", "blocks").agg(F.collect_list(F.struct("item", "rating")).alias("own"))


def item_links(ratings: DataFrame, min_common: int, min_r: float, block_rows: int = HISTORY_ROWS) -> DataFrame:
    """item_pearson() where n_common >= min_common and r > min_r, as a stored table.

    A user with d ratings has d * (d - 1) / 2 pairs, so all pairs are many times
    the ratings. They are summed in tasks from lists of items, see links.py, in
    passes of some four entries of lists a rating. A history of one block is a
    list; of a longer one, any two blocks are.
    """
    # by position, as in item_pearson
    ratings = ratings.toDF("user", "item", "rating").where("user IS NOT NULL AND item IS NOT NULL").withColumn("rating", F.col("rating").cast("double"))
    kind, names = ratings.schema["item"].dataType, None
    if kind.typeName() not in ("byte", "short", "integer", "long"):
        names = stored(numbered(ratings.select("item").distinct(), ["item"], "k"))
        ratings = ratings.join(names, "item").select("user", F.col("k").alias("item"), "rating")
    ratings = ratings.withColumn("item", F.col("item").cast("long"))
    own = stored(history_blocks(ratings, block_rows))
    size = F.sum(F.size("own").cast("double"))
    n, pairs = own.groupBy("user").agg(size.alias("d")).agg(F.coalesce(F.sum("d"), F.lit(0.0)), F.coalesce(F.sum(F.expr("d * (d - 1) / 2")), F.lit(0.0))).first()
    short, long = own.where("blocks = 1"), own.where("blocks > 1")
    side = lambda c, k: F.transform(c, lambda _: F.lit(k).cast("byte"))
    no_side = F.lit(None).cast("array<byte>")
    alone = short.unionByName(long).select(F.xxhash64("user", "block").alias("h"), F.col("own.item").alias("item"), F.col("own.rating").alias("rating"), no_side.alias("side"))
    later = long.select("user", F.col("block").alias("block_2"), F.col("own").alias("own_2"))
    met = long.join(later, "user").where("block < block_2")
    met = met.select(F.xxhash64("user", "block", "block_2").alias("h"), F.concat("own.item", "own_2.item").alias("item"), F.concat("own.rating", "own_2.rating").alias("rating"), F.concat(side("own.item", 1), side("own_2.item", 2)).alias("side"))
    sums = links.pair_sums(alone.unionByName(met), pairs, max(4 * int(n), PAIR_ROWS), min_common, min_r)
    out = _correlated(sums).where((F.col("n_common") >= min_common) & (F.col("r") > min_r))
    if names is not None:
        for c in ("item_1", "item_2"):
            out = out.join(names.select(F.col("k").alias(c), F.col("item").alias("_name")), c).withColumn(c, F.col("_name")).drop("_name")
        return stored(out.select("item_1", "item_2", "n_common", "r"))
    return stored(out.select(F.col("item_1").cast(kind).alias("item_1"), F.col("item_2").cast(kind).alias("item_2"), "n_common", "r"))


def item_cf(ratings: DataFrame, targets: DataFrame, min_common: int = 10, min_r: float = 0.5, neighbours: int = 10, descending: bool = False, item_weight: float = 0.6) -> DataFrame:
    """targets(row_id, user, item) to (row_id, user, item, prediction), a row for each.

    Unknown user and item: the global mean; unknown user: the item's mean; unknown
    item: the user's. Else the weighted mean of the user's ratings of up to
    `neighbours` items with at least min_common raters in common and r over min_r:
    by default those with the lowest such r, ties by item, as the reference results
    have it. Without any, or where the weighted sum is 0: item_weight of the item's
    mean and the rest of the user's. A rating of the target itself is left out.
    """
    item_mean = ratings.groupBy("item").agg(F.avg("rating").alias("item_mean"))
    user_mean = ratings.groupBy("user").agg(F.avg("rating").alias("user_mean"))
    p = item_links(ratings.select("user", "item", "rating"), min_common, min_r)
    sims = p.select(F.col("item_1").alias("item"), F.col("item_2").alias("other"), "r").union(p.select("item_2", "item_1", "r"))
    near = targets.join(sims, "item").join(ratings.select("user", F.col("item").alias("other"), "rating"), ["user", "other"])
    order = [F.desc("r"), "other"] if descending else ["r", "other"]
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("row_id").orderBy(*order))).where(F.col("k") <= neighbours)
    score = stored(near.groupBy("row_id").agg(F.sum(F.col("r") * F.col("rating")).alias("above"), F.sum(F.abs("r")).alias("below")))  # its shuffles, the largest here, end with it
    out = targets.join(score, "row_id", "left").join(item_mean, "item", "left").join(user_mean, "user", "left").crossJoin(F.broadcast(ratings.agg(F.avg("rating").alias("mean"))))  # one row
    value = F.when(F.col("item_mean").isNull() & F.col("user_mean").isNull(), F.col("mean")).when(F.col("user_mean").isNull(), F.col("item_mean")).when(F.col("item_mean").isNull(), F.col("user_mean"))
    value = value.when((F.col("below") != 0) & (F.col("above") != 0), F.col("above") / F.col("below")).otherwise(item_weight * F.col("item_mean") + (1 - item_weight) * F.col("user_mean"))
    return out.select("row_id", "user", "item", F.round(value, 6).alias("prediction"))


FEATURES = ("tip_likes", "noise", "price", "good_for_kids", "good_for_groups", "bike_parking", "table_service", "checkin_norm", "biz_stars", "biz_review_norm", "is_open", "city_avg", "user_review_norm", "user_avg_stars", "useful", "fans")


def features(pairs: DataFrame, business: DataFrame, tips: DataFrame, checkins: DataFrame, users: DataFrame, review_default: float = 0.0) -> DataFrame:
    """pairs(user_id, business_id, ...) with the 16 FEATURES, for training and validation alike; repeated dimension rows count once.

    A business without attributes gets the mean noise, price 1.5 and fixed flags; an
    attribute that is missing from those it has is 0. A null city is a city.
    """
    business, users = business.dropDuplicates(["business_id"]), users.dropDuplicates(["user_id"])
    likes = tips.groupBy("user_id", "business_id").agg(F.sum("likes").cast("double").alias("tip_likes"))
    at = lambda k: F.try_element_at("attributes", F.lit(k))
    b = business.withColumn("city_avg", F.avg("stars").over(Window.partitionBy("city")))
    b = b.select(
        "business_id", F.col("stars").alias("biz_stars"), "review_count", F.col("is_open").cast("double"), "city_avg", F.col("attributes").isNotNull().alias("_has"), noise_level(at("NoiseLevel")).cast("double").alias("_noise"), number(at("RestaurantsPriceRange2")).alias("_price"),
        *[flag(at(k)).cast("double").alias(f"_{n}") for n, k in (("good_for_kids", "GoodForKids"), ("good_for_groups", "RestaurantsGoodForGroups"), ("bike_parking", "BikeParking"), ("table_service", "RestaurantsTableService"))],
    )
    c = checkins.groupBy("business_id").agg(F.sum(map_sum(F.col("time"))).alias("checkins"))
    one = lambda df: F.broadcast(df)  # noqa: E731  one row of totals each
    t = likes.agg(F.avg("tip_likes").alias("m_likes")).crossJoin(one(b.agg(F.avg(F.when(F.col("_has"), F.col("_noise"))).alias("m_noise"), F.avg("biz_stars").alias("m_stars"), F.avg("review_count").alias("m_reviews"), F.avg("is_open").alias("m_open"), F.avg("city_avg").alias("m_city"))))
    t = t.crossJoin(one(c.agg(F.avg("checkins").alias("m_checkins")))).crossJoin(one(users.agg(F.avg("review_count").alias("mu_reviews"), F.avg("average_stars").alias("mu_stars"), F.avg("useful").alias("mu_useful"), F.avg("fans").alias("mu_fans"))))
    u = users.select("user_id", F.col("review_count").alias("u_reviews"), "average_stars", F.col("useful").alias("u_useful"), F.col("fans").alias("u_fans"))
    x = pairs.join(likes, ["user_id", "business_id"], "left").join(b, "business_id", "left").join(c, "business_id", "left").join(u, "user_id", "left").crossJoin(one(t))
    has = F.coalesce("_has", F.lit(False))
    attr = lambda n, default: F.when(has, F.col(f"_{n}")).otherwise(default)
    col = F.coalesce
    return x.select(
        *pairs.columns, col("tip_likes", "m_likes").alias("tip_likes"), attr("noise", F.col("m_noise")).alias("noise"), attr("price", 1.5).alias("price"), attr("good_for_kids", 0.0).alias("good_for_kids"), attr("good_for_groups", 0.0).alias("good_for_groups"), attr("bike_parking", 1.0).alias("bike_parking"), attr("table_service", 0.0).alias("table_service"),
        col(F.try_divide("checkins", "m_checkins"), F.lit(0.0)).alias("checkin_norm"), col("biz_stars", "m_stars").alias("biz_stars"), col(F.try_divide("review_count", "m_reviews"), F.lit(review_default)).alias("biz_review_norm"), col("is_open", "m_open").alias("is_open"), col("city_avg", "m_city").alias("city_avg"),
        col(F.try_divide("u_reviews", "mu_reviews"), F.lit(0.0)).alias("user_review_norm"), col("average_stars", "mu_stars").alias("user_avg_stars"), col("u_useful", "mu_useful").cast("double").alias("useful"), col("u_fans", "mu_fans").cast("double").alias("fans"),
    )


def boosted(train: DataFrame, rows: DataFrame, label: str = "stars", columns=FEATURES, rounds: int = 100, depth: int = 6) -> DataFrame:
    """rows with `prediction` by gradient-boosted trees, learning rate 0.2: see trees.fit() and trees.predict()."""
    return trees.predict(trees.fit(train, label, columns, rounds=rounds, depth=depth), rows)


def hybrid(tree: DataFrame, cf: DataFrame, weight: float = 0.78) -> DataFrame:
    """(row_id, prediction) of both to their weighted sum, by row id, so that repeated pairs stay apart."""
    return tree.select("row_id", F.col("prediction").alias("a")).join(cf.select("row_id", F.col("prediction").alias("b")), "row_id").select("row_id", (weight * F.col("a") + (1 - weight) * F.col("b")).alias("prediction"))


def rmse(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    return df.agg(F.round(F.sqrt(F.avg(F.pow(F.col(label) - F.col(prediction), F.lit(2)))), 6).alias("rmse"))


def user_index(pairs: DataFrame, user: str = "user") -> DataFrame:
    """(user, n): users numbered from 0 in their order, without one sort task."""
    return numbered(pairs.select(user).where(F.col(user).isNotNull()).distinct(), [user], "_n").select(user, (F.col("_n") - 1).alias("n"))


def distinct_predictions(predictions: DataFrame, user: str = "user_id", item: str = "business_id") -> DataFrame:
    """One row a pair, that with the smallest row_id, so that the choice is the same however rows are dealt."""
    rest = [c for c in predictions.columns if c not in (user, item)]
    best = predictions.groupBy(user, item).agg(F.min_by(F.struct(*rest), F.col("row_id")).alias("_x"))
    return best.select(user, item, *[F.col(f"_x.{c}").alias(c) for c in rest])
