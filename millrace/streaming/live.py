"""Sketches of a live stream whose state is keyed and kept by Spark: a micro-batch costs its own rows, however long the stream is.

Streams have (seq, user): seq is the event's place, from 1 and without gaps, and
rises from micro-batch to micro-batch; within one, rows may come in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.sketches import bit_positions, slot_written

#: Bits of the filter that one state row holds.
WORD_BITS = 1024
#: Keyed state of Python processors is kept by this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Choose the state store that keyed state needs, for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _earliest(batches):
    """(user, seq) to the least seq of each user of an Arrow batch: a hot user's rows shrink before the shuffle."""
    import pyarrow as pa

    for b in batches:
        t = pa.Table.from_batches([b]).group_by("user").aggregate([("seq", "min")])
        yield from t.rename_columns(["user", "seq"]).to_batches()


class FirstSeen(StatefulProcessor):
    """Exact membership: a user's first event passes, once for the whole stream."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq = min(int(x["seq"].min()) for x in rows)
        if not self.seen.exists():
            self.seen.update((seq,))
            yield pd.DataFrame({"user": [key[0]], "seq": [seq]})

    def close(self) -> None:
        pass


class BitWord(StatefulProcessor):
    """The bits of one word of a Bloom filter: of each row (user, seq, bit), whether the bit was set by an earlier event."""

    def init(self, handle) -> None:
        self.bits = handle.getValueState("bits", "bits binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        import numpy as np

        x = pd.concat(list(rows), ignore_index=True)
        held = np.frombuffer(bytes(self.bits.get()[0]), np.uint8) if self.bits.exists() else np.zeros(WORD_BITS // 8, np.uint8)
        held = np.unpackbits(held).astype(bool)
        bit = x["bit"].to_numpy(np.int64)
        hit = held[bit] | (x.groupby("bit")["seq"].transform("min") < x["seq"]).to_numpy()
        if not held[bit].all():
            held[bit] = True
            self.bits.update((np.packbits(held).tobytes(),))
        out = pd.DataFrame({"user": x["user"], "hit": hit})
        yield out.groupby("user", as_index=False, sort=False)["hit"].min()

    def close(self) -> None:
        pass


def bloom_hits(stream: DataFrame, bits: int = 69997, hashes: int = 60) -> DataFrame:
    """stream(seq, user) to (user, hit): rows of each first-time user, one for each word its bits lie in; hit: all those were set before.

    Null users count for nothing. Two keyed states: users seen, and words of bits.
    """
    keyed_state(stream.sparkSession)
    user = _type(stream, "user")
    least = stream.where(F.col("user").isNotNull()).select("user", F.col("seq").cast("long").alias("seq")).mapInArrow(_earliest, f"user {user}, seq long")
    new = least.groupBy("user").transformWithStateInPandas(FirstSeen(), f"user {user}, seq long", "Append", "None")
    pos = bit_positions(new, bits, hashes).select("user", "seq", F.expr(f"pos div {WORD_BITS}").alias("word"), (F.col("pos") % WORD_BITS).alias("bit"))
    return pos.groupBy("word").transformWithStateInPandas(BitWord(), f"user {user}, hit boolean", "Append", "None")


def bloom_stream(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], bits: int = 69997, hashes: int = 60):
    """Start bloom_fpr over a live stream(seq, user): sink((batch, n_new, n_false, fpr), one row, batch) after each micro-batch.

    A micro-batch without first-time users gives 0, 0 and a null rate. Restarted on
    its checkpoint, the query goes on with its state; a replayed batch gives the
    same row again.
    """

    def each(df: DataFrame, batch: int) -> None:
        users = df.groupBy("user").agg(F.min("hit").alias("hit"))
        n = users.agg(F.count("*").alias("n_new"), F.count_if("hit").alias("n_false"))
        sink(n.select(F.lit(batch).cast("long").alias("batch"), "n_new", "n_false", F.round(F.try_divide("n_false", "n_new"), 6).alias("fpr")), batch)

    return bloom_hits(stream, bits, hashes).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def _writes(slots: tuple):
    """(seq, user, slot) to the rows that write one of `slots`, and for each slot how far the Arrow batch goes (tick)."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t.filter(pc.is_in(t["slot"], pa.array(slots, t["slot"].type)))
            t = t.append_column("tick", pa.array([False] * len(t), pa.bool_()))
            ends = pa.table({"seq": [pc.max(b.column("seq")).as_py()] * len(slots), "user": pa.nulls(len(slots), b.column("user").type), "slot": list(slots), "tick": [True] * len(slots)})
            yield from pa.concat_tables([t, ends.cast(t.schema)]).to_batches()

    return run


class SlotWriter(StatefulProcessor):
    """One slot of a reservoir: of its writes and how far the stream has come, the runs of snapshots and what they show."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", "user string, written boolean, done long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        user, written, done = self.held.get() if self.held.exists() else (None, False, 0)
        end = int(x["seq"].max())
        if int(x["seq"].min()) <= done:
            raise ValueError(f"event {int(x['seq'].min())} comes after a micro-batch that went up to {done}")
        w = x[~x["tick"].astype(bool)]
        runs, since = [], done + 1
        for at, value in zip(w["seq"].tolist(), w["user"].tolist()):
            if written:
                runs.append((user, since, at - 1))
            user, written, since = value, True, at
        if written:
            runs.append((user, since, end))
        self.held.update((user, written, end))
        runs = [(u, -(-a // self.every) * self.every, b // self.every * self.every) for u, a, b in runs]
        runs = [r for r in runs if r[1] <= r[2]]
        if runs:
            yield pd.DataFrame({"slot": [key[0]] * len(runs), "user": [r[0] for r in runs], "first": [r[1] for r in runs], "last": [r[2] for r in runs]})

    def close(self) -> None:
        pass


def reservoir_stream(stream: DataFrame, size: int = 100, every: int = 100, slots: tuple = (0, 20, 40, 60, 80)) -> DataFrame:
    """reservoir_snapshots over a live stream(seq, user): a stream of (seqnum, slot, user), in append mode.

    A task sends the writes of the given slots and a row for each slot and Arrow
    batch, so a slot's state meets few rows. Snapshots of a micro-batch follow
    when it ends. A stream that goes back behind an earlier batch is an error.
    """
    keyed_state(stream.sparkSession)
    user = _type(stream, "user")
    s = stream.select(F.col("seq").cast("long").alias("seq"), F.col("user").cast("string").alias("user"))  # as text: pandas makes numbers beside nulls inexact
    s = s.select("seq", "user", slot_written(F.col("seq"), size).cast("long").alias("slot"))
    w = s.mapInArrow(_writes(tuple(slots)), "seq long, user string, slot long, tick boolean")
    runs = w.groupBy("slot").transformWithStateInPandas(SlotWriter(every), "slot long, user string, first long, last long", "Append", "None")
    return runs.select(F.explode(F.sequence("first", "last", F.lit(every).cast("long"))).alias("seqnum"), "slot", F.col("user").cast(user).alias("user"))
