"""Stream sketches over (batch, seq, user: number or text), as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import affine, bytes_mod, coefficients


def _number(stream: DataFrame, modulus: int):
    """A user as a number: texts by their UTF-8 bytes as one big-endian number, modulo `modulus`."""
    return bytes_mod(F.col("user"), modulus) if stream.schema["user"].dataType.typeName() == "string" else F.col("user")


def bit_positions(first: DataFrame, bits: int, hashes: int) -> DataFrame:
    """first(user, ...) with `pos`, a row for each of a user's bits."""
    a, b = coefficients(F.col("_i"))
    x = first.withColumn("_x", _number(first, bits)).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hashes - 1).cast("long"))))
    return x.withColumn("pos", affine(F.col("_x"), a, b, bits)).drop("_x", "_i")


def bloom_fpr(stream: DataFrame, bits: int = 69997, hashes: int = 60) -> DataFrame:
    """(batch, n_new, n_false, fpr): first-time users whose bits were all set before, of all first-time users; null without any."""
    first = stream.groupBy("user").agg(F.min(F.struct("seq", "batch")).alias("f")).select("user", "f.seq", "f.batch")
    pos = bit_positions(first, bits, hashes)
    set_at = pos.groupBy("pos").agg(F.min("seq").alias("set_at"))
    judged = pos.join(set_at, "pos").groupBy("user", "batch").agg(F.min((F.col("set_at") < F.col("seq")).cast("long")).alias("hit"))
    per = judged.groupBy("batch").agg(F.count("*").alias("n_new"), F.sum("hit").alias("n_false"))
    out = stream.select("batch").distinct().join(per, "batch", "left").fillna(0, ["n_new", "n_false"])
    return out.select("batch", "n_new", "n_false", F.round(F.try_divide(F.col("n_false"), F.col("n_new")), 6).alias("fpr"))


#: Batches whose registers a task holds before they leave it, and values that it hashes at once.
FM_BATCHES, FM_VALUES = 1024, 256


def _folded(hashes: int, modulus: int):
    """(batch, x) to (batch, low): for each hash the largest of its values' lowest set bits (2 for a value of 0), a row for each batch of a task."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        i = np.arange(hashes, dtype=np.int64)
        a, b = (i * 7919 + 104729) % 99991 + 1, (i * 15485863 + 32452843) % 98387 + 1
        held: dict[int, np.ndarray] = {}

        def out():
            keys = list(held)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([held[k].tobytes() for k in keys], pa.binary())], ["batch", "low"])

        for rows in batches:
            t = pa.Table.from_batches([rows]).group_by(["batch", "x"]).aggregate([]).sort_by("batch")  # repeated values tell nothing new
            keys, x = t["batch"].to_numpy(), t["x"].to_numpy()
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else []
            for s, e in zip(starts, [*starts[1:], len(keys)]):
                own = held.setdefault(int(keys[s]), np.zeros(hashes, np.int64))
                for k in range(s, e, FM_VALUES):
                    h = (x[k : min(e, k + FM_VALUES), None] % modulus * a + b) % modulus
                    low = h & -h
                    low[h == 0] = 2
                    np.maximum(own, low.max(axis=0), out=own)
            if len(held) > FM_BATCHES:  # bounded memory: later rows of these batches start anew
                yield from out()
                held.clear()
        if held:
            yield from out()

    return run


def _merged(batches):
    """(batch, low), a batch's rows together, to (batch, z): maxima of all, as numbers of trailing zeros."""
    import numpy as np
    import pyarrow as pa

    key, top = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([np.log2(top).astype(np.int32).tolist()], pa.list_(pa.int32()))], ["batch", "z"])

    for rows in batches:
        for k, low in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            low = np.frombuffer(low, np.int64)
            if k == key:
                top = np.maximum(top, low)
                continue
            if top is not None:
                yield out()
            key, top = k, low
    if top is not None:
        yield out()


def fm_registers(values: DataFrame, hashes: int, modulus: int) -> DataFrame:
    """values(batch, x; long) to (batch, z): the most trailing zeros of each hash's values.

    A task folds its rows into a fixed array a batch, so what is shuffled is a row
    for each task and batch (more only for a task with over FM_BATCHES of them).
    """
    low = values.mapInArrow(_folded(hashes, modulus), "batch long, low binary")
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return low.repartition(n, "batch").sortWithinPartitions("batch").mapInArrow(_merged, "batch long, z array<int>")


def fm_distinct(stream: DataFrame, hashes: int = 2000, groups: int = 4, modulus: int = 100_000_000) -> DataFrame:
    """(batch, n_distinct, estimate): the median over groups of 2 to the mean of each hash's most trailing zeros, cut to a whole number.

    A batch without users has a null estimate.
    """
    text = stream.schema["user"].dataType.typeName() == "string"
    x = stream.select(F.col("batch").cast("long").alias("batch"), (_number(stream, modulus) if text else F.col("user") * 2654435 + 97).cast("long").alias("x")).where("x IS NOT NULL")
    size = hashes // groups
    mean = lambda g: F.aggregate(F.slice("z", g * size + 1, size), F.lit(0).cast("long"), lambda s, z: s + z) / F.least(F.lit(size), F.size("z") - g * size)
    of = F.sort_array(F.transform(F.sequence(F.lit(0), F.lit(-(-hashes // size) - 1)), lambda g: F.pow(F.lit(2.0), mean(g))))
    middle = (F.element_at(of, ((F.size(of) + 1) / 2).cast("int")) + F.element_at(of, (F.size(of) / 2).cast("int") + 1)) / 2
    est = fm_registers(x, hashes, modulus).select("batch", F.floor(middle).cast("long").alias("estimate"))
    users = stream.select("batch", "user").distinct().groupBy("batch").agg(F.count("*").alias("n_distinct"))
    return users.join(est, "batch", "left").select("batch", "n_distinct", "estimate")


def slot_written(n, size: int):
    """The slot that event n writes by Algorithm R with fixed draws, null if none: n - 1 up to size, then, if its draw is below size / n, a drawn one."""
    draw = F.pmod(n * 7919 + 104729, F.lit(10007)) / 10007
    return F.when(n <= size, n - 1).when(draw * n < size, F.pmod(n * 104729 + 7919, F.lit(size)))


def reservoir_snapshots(stream: DataFrame, size: int = 100, every: int = 100, slots=(0, 20, 40, 60, 80)) -> DataFrame:
    """(seqnum, slot, user) at every `every` events: what Algorithm R holds in the given slots, from counter-based draws.

    A slot's content is its last write, so each write lasts until the next.
    """
    n = F.col("seq")
    slot = slot_written(n, size)
    w = stream.select(n.alias("seq"), "user", slot.alias("slot")).where(F.col("slot").isin(*slots))
    ends = stream.where(n % every == 0).select(n.alias("seqnum"))
    from pyspark.sql.window import Window

    w = w.withColumn("until", F.lead("seq").over(Window.partitionBy("slot").orderBy("seq")))
    w = w.crossJoin(F.broadcast(stream.agg(F.max("seq").alias("last"))))  # one row
    first = F.ceil(F.col("seq") / every) * every
    last = F.coalesce(F.col("until") - 1, F.col("last"))
    return w.where(first <= last).select(F.explode(F.sequence(first.cast("long"), last.cast("long"), F.lit(every).cast("long"))).alias("seqnum"), F.col("slot").cast("long"), "user").join(ends, "seqnum", "left_semi")


def hll_distinct(stream: DataFrame) -> DataFrame:
    return stream.groupBy("batch").agg(F.approx_count_distinct("user").alias("estimate"))
