"""Sums over all pairs of items that users have in common, made within tasks from lists of a user's items.

Items are cut into blocks by their order, of about equal numbers of pairs. A task gets,
for its block, each user's items from the block on, so that what is shuffled are
lists and not pairs, and where users keep to neighbouring items, little more than
the ratings. A block of many pairs is dealt over several tasks, whose sums are added.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import running, stored

register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

#: Pairs of a block, those that are summed at once, and entries of lists that are dealt at once.
TASK_PAIRS, PIECE, ENTRIES = 1 << 21, 1 << 16, 1 << 19

SUMS = ("n", "sx", "sy", "xx", "yy", "xy")
LISTS = "part long, item binary, rating binary, side binary"  # longs, doubles, bytes


def _values(column: pa.Array, empty=None):
    """(offsets from 0, values) of a column of lists; a null value is `empty`."""
    offsets = column.offsets.to_numpy()
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    return offsets - offsets[0], (values if empty is None else values.fill_null(empty)).to_numpy(zero_copy_only=False)


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Spans of values as binaries."""
    ends = pa.py_buffer((ends * values.itemsize).astype(np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) // 4 - 1, [None, ends, pa.py_buffer(np.ascontiguousarray(values))])


def _slices(batch: pa.RecordBatch):
    """Batches of some ENTRIES items, or one row."""
    ends, at = _values(batch.column("item"))[0], 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + ENTRIES, side="right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def _in_order(row: np.ndarray, item: np.ndarray) -> np.ndarray:
    low, high = int(item.min()), int(item.max())
    if (int(row[-1]) + 1) * (high - low + 1) < 2**63:
        return np.argsort(row * (high - low + 1) + (item - low), kind="stable")
    return np.lexsort((item, row))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of spans, one span after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _runs(batch: pa.RecordBatch, cuts: np.ndarray):
    """A list's items in order, and where those of a block begin: (order, row, block, start, items in the block, items from there on)."""
    ends, item = _values(batch.column("item"))
    row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
    order = _in_order(row, item)
    block = np.searchsorted(cuts, item[order], side="right")
    start = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (block[1:] != block[:-1]))))
    size, rest = np.diff(np.append(start, len(item))), ends[1:][row[start]] - start
    some = rest > 1
    return order, row[start[some]], block[start[some]], start[some], size[some], rest[some]


def _counted(cuts: np.ndarray):
    """In a task: (block, entries, pairs), what each block gets and makes."""

    def run(batches):
        entries, pairs = np.zeros((2, len(cuts) + 1), np.int64)
        for b in batches:
            for s in filter(lambda x: len(x.column("item").flatten()), _slices(b)):
                _, _, block, _, size, rest = _runs(s, cuts)
                np.add.at(entries, block, rest)
                np.add.at(pairs, block, size * rest - size * (size + 1) // 2)
        some = np.flatnonzero(entries)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(entries[some]), pa.array(pairs[some])], names=["block", "entries", "pairs"])

    return run


def _dealt(cuts: np.ndarray, first: np.ndarray, low: int, high: int):
    """In a task: a row for each list and block from `low` up to `high`, the list from the block on."""

    def run(batches):
        for b in batches:
            for s in filter(lambda x: len(x.column("item").flatten()), _slices(b)):
                order, row, block, start, _, rest = _runs(s, cuts)
                wanted = np.flatnonzero((block >= low) & (block < high))
                row, block, start, rest = row[wanted], block[wanted], start[wanted], rest[wanted]
                part = first[block] + s.column("h").to_numpy()[row] % (first[block + 1] - first[block])
                item, rating = _values(s.column("item"))[1][order], _values(s.column("rating"), 0.0)[1][order]
                mixed = s.column("side").null_count < s.num_rows
                side = _values(s.column("side"))[1][order] if mixed else None
                piece = np.cumsum(rest) // ENTRIES
                for k in np.unique(piece):
                    some = np.flatnonzero(piece == k)
                    places, ends = _spans(start[some], rest[some]), np.concatenate(([0], np.cumsum(rest[some])))
                    lists = [_binary(x[places], ends) for x in (item, rating)]
                    sides = _binary(side[places], ends) if mixed else pa.nulls(len(some), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(part[some]), *lists, sides], names=["part", "item", "rating", "side"])

    return run


def _tables(ends, item, rating, side, last):
    """(item_1, item_2, sums) of the pairs of lists in order whose first item is below `last`, piece by piece of some first items."""
    items, at = np.unique(item, return_inverse=True)
    rows, width = int(np.searchsorted(items, last)) if last is not None else len(items), len(items)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    place = np.flatnonzero(at < rows)
    place = place[np.argsort(at[place], kind="stable")]
    count = ends[1:][row[place]] - place - 1
    odd = side is not None or bool(((at[1:] == at[:-1]) & (row[1:] == row[:-1])).any())
    heads = np.searchsorted(at[place], np.arange(rows + 1))
    made = np.concatenate(([0], np.cumsum(count)))[heads]  # pairs before each first item
    found, low = [(items[:0], items[:0], np.zeros((6, 0)))], 0
    while low < rows:
        high = max(low + 1, int(np.searchsorted(made, made[low] + PIECE, side="right")) - 1)
        mine, many = place[heads[low] : heads[high]], count[heads[low] : heads[high]]
        a, b = np.repeat(mine, many), _spans(mine + 1, many)
        if odd:
            ok = at[a] != at[b]
            if side is not None:
                both = side[a] + side[b]
                ok &= (both == 0) | (both == 3)
            a, b = a[ok], b[ok]
        key, x, y, cells = (at[a] - low) * width + at[b], rating[a], rating[b], (high - low) * width
        keys = None
        if cells > 4 * len(key):
            keys, key = np.unique(key, return_inverse=True)
            cells = len(keys)
        n = np.bincount(key, minlength=cells)
        some = np.flatnonzero(n)
        keys = some if keys is None else keys
        found.append((items[low + keys // width], items[keys % width], np.stack([n[some], *(np.bincount(key, w, cells)[some] for w in (x, y, x * x, y * y, x * y))])))
        low = high
    return [np.concatenate(c, axis=-1) for c in zip(*found)]


def correlation(sums: np.ndarray) -> np.ndarray:
    """r of the sums as SQL has it: 0 where either side has no variance, NaN beyond everything."""
    n, sx, sy, xx, yy, xy = sums
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        vx, vy = xx - sx * sx / n, yy - sy * sy / n
        return np.where((vx <= 1e-9) | (vy <= 1e-9), 0.0, (xy - sx * sy / n) / np.sqrt(vx * vy))


def _summed(cuts: np.ndarray, first: np.ndarray, min_common: int, min_r: float):
    """In a task, from lists in order of their part: (item_1, item_2, sums); of blocks that no other task has, only pairs that link."""

    def of(part, held):
        block = int(np.searchsorted(first, part, side="right")) - 1
        sizes = np.concatenate([h[0] for h in held])
        side = None
        if any(h[3] is not None for h in held):
            side = np.concatenate([np.zeros(len(h[1]), np.int8) if h[3] is None else h[3] for h in held])
        item, rating = (np.concatenate([h[k] for h in held]) for k in (1, 2))
        a, b, sums = _tables(np.concatenate(([0], np.cumsum(sizes))), item, rating, side, cuts[block] if block < len(cuts) else None)
        if first[block + 1] - first[block] == 1:
            some = np.flatnonzero((sums[0] >= min_common) & ~(correlation(sums) <= min_r))
            a, b, sums = a[some], b[some], sums[:, some]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sums[0].astype(np.int64)), *map(pa.array, sums[1:])], names=["item_1", "item_2", *SUMS])

    def run(batches):
        now, held = None, []
        for b in batches:
            part = b.column("part").to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else []
            for lo, hi in zip(starts, [*starts[1:], len(part)]):
                if held and part[lo] != now:
                    yield of(now, held)
                    held = []
                now, s = part[lo], b.slice(lo, hi - lo)
                item = s.column("item")
                sizes = np.diff(np.frombuffer(item.buffers()[1], np.int32)[item.offset : item.offset + len(item) + 1]) // 8
                item, rating = (np.frombuffer(b"".join(s.column(c).to_pylist()), kind) for c, kind in (("item", np.int64), ("rating", np.float64)))
                side = None if s.column("side").null_count == len(s) else [x or bytes(n) for n, x in zip(sizes.tolist(), s.column("side").to_pylist())]
                held.append((sizes, item, rating, side if side is None else np.frombuffer(b"".join(side), np.int8)))
        if held:
            yield of(now, held)

    return run


def _cuts(lists: DataFrame, pairs: float) -> np.ndarray:
    """First items of all blocks but the first: an item weighs what its lists' items are, and a block some TASK_PAIRS pairs."""
    if pairs <= TASK_PAIRS:
        return np.zeros(0, np.int64)
    weight = lists.select(F.explode("item").alias("item"), F.size("item").cast("long").alias("w")).groupBy("item").agg(F.sum("w").alias("w"))
    total = running(weight, ["item"], "w", "upto")
    heads = total.groupBy(F.floor((F.col("upto") - 1) / F.lit(2 * TASK_PAIRS)).alias("block")).agg(F.min("item").alias("item")).toArrow()  # a row for each block
    return np.sort(heads.column("item").to_numpy())[1:]


def pair_sums(lists: DataFrame, pairs: float, entries: int, min_common: int, min_r: float) -> DataFrame:
    """lists(h, item, rating, side) to (item_1, item_2, n, sx, sy, xx, yy, xy), as a stored table: what links, and some that does not.

    Of a list with sides, 1 and 2, only items of different sides are a pair. h
    deals lists of one block over its tasks. As many blocks make a pass as get some
    `entries` of lists in all.
    """
    cuts = _cuts(lists, pairs)
    t = lists.mapInArrow(_counted(cuts), "block long, entries long, pairs long").groupBy("block").agg(F.sum("entries").alias("entries"), F.sum("pairs").alias("pairs")).toArrow()
    got, made = np.zeros((2, len(cuts) + 1), np.int64)
    for x, name in ((got, "entries"), (made, "pairs")):
        x[t.column("block").to_numpy()] = t.column(name).to_numpy()
    tasks = np.maximum(1, -(-made // (4 * TASK_PAIRS)))  # a block somewhat over is left whole
    first = np.concatenate(([0], np.cumsum(tasks)))
    passes = np.cumsum(got) // max(1, entries)

    def one(k: int) -> DataFrame:
        low, high = (int(np.searchsorted(passes, x)) for x in (k, k + 1))
        dealt = lists.mapInArrow(_dealt(cuts, first, low, high), LISTS)
        n = min(int(first[high] - first[low]), 2048)
        out = dealt.repartition(n, "part").sortWithinPartitions("part")
        return out.mapInArrow(_summed(cuts, first, min_common, min_r), "item_1 long, item_2 long, n long, " + ", ".join(f"{c} double" for c in SUMS[1:]))

    out = stored(*map(one, np.unique(passes)))
    return out if tasks.max() == 1 else out.groupBy("item_1", "item_2").agg(*[F.sum(c).alias(c) for c in SUMS])
