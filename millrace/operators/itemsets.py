"""Baskets and frequent itemsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import short_date, strip_zeros
from ..plans.lineage import cut, stored


def baskets(pairs: DataFrame, key: str, item: str, more_than: int = 0) -> DataFrame:
    """(key, items): sorted distinct items of each key with more than `more_than` of them."""
    return pairs.groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_set(item)).alias("items")).where(F.size("items") > more_than)


def pairs_of_case(df: DataFrame, first: str, second: str, case_number: int) -> DataFrame:
    """Case 1: baskets of the first column; 2: of the second. ValueError for others."""
    if case_number not in (1, 2):
        raise ValueError("case_number must be 1 or 2")
    key, item = (first, second) if case_number == 1 else (second, first)
    return df.select(F.col(key).alias("key"), F.col(item).alias("item")).distinct()


def transaction_pairs(tx: DataFrame) -> DataFrame:
    """tx(date M/D/YYYY, customer, product) to distinct (key M/D/YY-customer, item); leading zeros of ids go."""
    return tx.select(F.concat_ws("-", short_date(F.col("date")), strip_zeros(F.col("customer"))).alias("key"), strip_zeros(F.col("product")).alias("item")).distinct()


def frequent_itemsets(pairs: DataFrame, support: int, max_size: int | None = None) -> DataFrame:
    """pairs(key, item), distinct, to (itemset, n): every itemset in at least `support` baskets, with its count.

    Level by level: the frequent sets of each basket are extended by the basket's
    frequent items that sort after their last, so that all joins are on keys and
    counts are partial sums.
    """
    items = pairs.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    live = cut(pairs.join(items.select("item"), "item", "left_semi"))
    out = items.select(F.array("item").alias("itemset"), "n")
    level = live.select("key", F.array("item").alias("itemset"), F.col("item").alias("last"))
    size = 1
    while max_size is None or size < max_size:
        grown = level.join(live, "key").where(F.col("item") > F.col("last")).select("key", F.concat("itemset", F.array("item")).alias("itemset"), F.col("item").alias("last"))
        counts = cut(grown.groupBy("itemset").agg(F.count("*").alias("n")).where(F.col("n") >= support))
        if not counts.limit(1).count():
            break
        out = out.union(counts)
        level = cut(grown.join(counts.select("itemset"), "itemset", "left_semi").select("key", "itemset", "last"))
        size += 1
    return out


#: Items times rows of a part, at most, that one task mines in bitmaps (256 MB of them); larger parts go by joins.
PART_CELLS = 1 << 31


#: Rows of a slice of a part, about, that one task turns into bitmaps.
SLICE_ROWS = 1 << 20


def _groups(batches, columns: tuple):
    """(values, batches) of each run of rows with equal values in the columns."""
    import numpy as np

    held, last = [], None
    for b in batches:
        values = np.stack([b.column(c).to_numpy() for c in columns], 1)
        starts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist(), b.num_rows]
        for s, e in zip(starts, starts[1:]):
            if e > s:
                if held and tuple(values[s]) != last:
                    yield last, held
                    held = []
                last = tuple(values[s])
                held.append(b.slice(s, e - s))
    if held:
        yield last, held


def _bitmaps(batches):
    """In a task: (part, slice, key, item), a slice's rows together, to (part, slice, item, bits), an item's bitmap over the slice's baskets."""
    import numpy as np
    import pyarrow as pa

    for (part, slice_), rows in _groups(batches, ("part", "slice")):
        t = pa.Table.from_batches(rows).drop_null()
        if not t.num_rows:
            continue
        key = t["key"].combine_chunks().dictionary_encode().indices.to_numpy()
        item = t["item"].combine_chunks().dictionary_encode()
        bits = np.zeros((len(item.dictionary), -(-(int(key.max()) + 1) // 8)), np.uint8)
        np.bitwise_or.at(bits, (item.indices.to_numpy(), key >> 3), (1 << (key & 7)).astype(np.uint8))
        n = len(bits)
        yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array([slice_] * n, pa.int64()), item.dictionary, pa.array([x.tobytes() for x in bits], pa.binary())], names=["part", "slice", "item", "bits"])


def _mined(local: int, max_size: int | None):
    """(part, slice, item, bits), a part's rows together and by slice, to the sets of two or more items in at least `local` of its baskets.

    An item is a bitmap over the part's baskets. Sets grow depth first by items
    that sort after their last, each by one `and` with all that may follow.
    """

    def sets(rows):
        import numpy as np
        import pyarrow as pa

        t = pa.Table.from_batches(rows)
        item, size = t["item"].combine_chunks().dictionary_encode(), pa.compute.binary_length(t["bits"]).to_numpy()
        names = item.dictionary.to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        names, place = [names[k] for k in order], np.argsort(order)
        new = np.concatenate(([True], np.diff(t["slice"].to_numpy()) != 0))
        start = np.concatenate(([0], np.cumsum(size[new])))
        bits = np.zeros((len(names), start[-1]), np.uint8)
        for k, at, own in zip(place[item.indices.to_numpy()], start[np.cumsum(new) - 1], t["bits"]):
            own = np.frombuffer(own.as_buffer(), np.uint8)
            bits[k, at : at + len(own)] = own
        todo = [([k], bits[k], np.arange(k + 1, len(names))) for k in range(len(names))]
        while todo:
            own, mask, after = todo.pop()
            if not len(after) or max_size is not None and len(own) >= max_size:
                continue
            both = bits[after] & mask
            enough = np.bitwise_count(both).sum(axis=1) >= local
            after, both = after[enough], both[enough]
            for k, (x, m) in enumerate(zip(after.tolist(), both)):
                yield [names[i] for i in (*own, x)]
                todo.append(([*own, x], m.copy(), after[k + 1 :]))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        for _, rows in _groups(batches, ("part",)):
            kind, out = pa.list_(rows[0].schema.field("item").type), []
            for x in sets(rows):
                out.append(x)
                if len(out) >= 1 << 14:
                    yield pa.RecordBatch.from_arrays([pa.array(out, kind)], ["itemset"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, kind)], ["itemset"])

    return run


def son_candidates(pairs: DataFrame, support: int, partitions: int, max_size: int | None = None, cells: int = PART_CELLS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """itemsets frequent in some of `partitions` parts of the baskets at ceil(support / partitions): SON's first phase, sets of every size up to max_size.

    Items are counted for all parts first. A part whose frequent items times rows
    are at most `cells` is turned into bitmaps in slices of its baskets, each in a
    task, and mined in a task that reads only these; others level by level by joins, as
    a part may be of any size. A null item is a set of its own only; a null key
    makes no larger sets.
    """
    local = -(-support // partitions)
    part = pairs.select(F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("long").alias("part"), "key", "item")
    ones = cut(part.groupBy("part", "item").agg(F.count("*").alias("n")).where(F.col("n") >= local))
    out = ones.select(F.array("item").alias("itemset"))
    if max_size is not None and max_size < 2:
        return (out if max_size == 1 else out.limit(0)).distinct()
    live = cut(part.join(ones.select("part", "item"), ["part", "item"], "left_semi").select("part", "key", "item"))
    size = ones.groupBy("part").agg(F.sum("n").alias("rows"), F.count("*").alias("items"))
    small = cut(size.where(F.col("rows") * F.col("items") <= cells).select("part"))
    slices = -(-(size.join(small, "part", "left_semi").agg(F.max("rows")).first()[0] or 1) // slice_rows)
    rows = live.join(small, "part", "left_semi").select("part", F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(slices)).cast("long").alias("slice"), "key", "item")
    rows = rows.repartition(partitions * slices, "part", "slice").sortWithinPartitions("part", "slice")
    kind = pairs.schema["item"].dataType.simpleString()
    rows = rows.mapInArrow(_bitmaps, f"part long, slice long, item {kind}, bits binary").repartition(partitions, "part").sortWithinPartitions("part", "slice")
    out = out.union(rows.mapInArrow(_mined(local, max_size), f"itemset array<{kind}>"))
    live, k = live.join(small, "part", "left_anti"), 1
    if live.limit(1).count():
        live = cut(live)
        level = live.select("part", "key", F.array("item").alias("itemset"), F.col("item").alias("last"))
        while max_size is None or k < max_size:
            grown = level.join(live, ["part", "key"]).where(F.col("item") > F.col("last")).select("part", "key", F.concat("itemset", F.array("item")).alias("itemset"), F.col("item").alias("last"))
            found = cut(grown.groupBy("part", "itemset").agg(F.count("*").alias("n")).where(F.col("n") >= local).select("part", "itemset"))
            if not found.limit(1).count():
                break
            out = out.union(found.select("itemset"))
            level = cut(grown.join(found, ["part", "itemset"], "left_semi"))
            k += 1
    return out.distinct()


def equal_baskets(pairs: DataFrame, key: str, item: str) -> DataFrame:
    """(items, n): every different basket's sorted items, and how many keys have just these; pairs may repeat. Written once."""
    sets = pairs.groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_set(item)).alias("items"))
    return stored(sets.groupBy("items").agg(F.count("*").alias("n")))


def fp_growth(baskets_: DataFrame, support: int) -> DataFrame:
    """The same sets by FP-growth over baskets(items[, n]), n of each (one without that column).

    Baskets keep their frequent items, the most frequent first, and equal ones are one
    row. The base of a set is the part of each such row before the set's last
    item, again with equal ones as one row; items frequent in it extend the set. Bases of
    all sets of a size are grouped together, so no task holds a whole base or tree.
    """
    rows = baskets_.select("items", (F.col("n") if "n" in baskets_.columns else F.lit(1)).cast("long").alias("n"))
    rows = cut(rows.groupBy("items").agg(F.sum("n").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    single = rows.select("id", "n", F.explode("items").alias("item"))
    ones = cut(single.groupBy("item").agg(F.sum("n").alias("c")).where(F.col("c") >= support))
    ordered = single.join(ones, "item").groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), "item"))).alias("before"))
    kind = rows.schema["items"].dataType.simpleString()
    base = cut(ordered.groupBy("before").agg(F.sum("n").alias("n")).select(F.array().cast(kind).alias("itemset"), "before", "n"))
    out = None
    while True:
        grown = base.select("itemset", "n", "before", F.posexplode("before").alias("at", "x"))
        grown = grown.select(F.array_append("itemset", F.col("x.item")).alias("itemset"), F.slice("before", F.lit(1), F.col("at")).alias("before"), "n")
        found = cut(grown.groupBy("itemset").agg(F.sum("n").alias("n")).where(F.col("n") >= support))
        out = found if out is None else out.union(found)
        if not found.limit(1).count():
            return out.select(F.sort_array("itemset").alias("itemset"), "n")
        base = grown.where(F.size("before") > 0).join(found.select("itemset"), "itemset", "left_semi")
        base = cut(base.groupBy("itemset", "before").agg(F.sum("n").alias("n")))


def longest(itemsets: DataFrame) -> DataFrame:
    """(n): the size of the largest itemset, 0 without any."""
    return itemsets.agg(F.coalesce(F.max(F.size("itemset")), F.lit(0)).cast("long").alias("n"))
