"""Boosted regression trees grown level by level from histograms that Spark sums.

Rows alike in all binned features count as one cell with a weight, so that what a
round reads is the different cells, however often one occurs. Features of few bins
share a code, whose sums give theirs. Cells are held in blocks, a binary a column,
code by code, so that a level costs few calls a block. Gradients are sums of whole units, so a model is the same however rows are
dealt, and a node's sums less one child's are the other child's.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import stored

register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

#: Bins of a feature, at most 256; the first is for null and NaN.
BINS = 64

#: Values of a code that features share, cells of a block, and those placed at once.
CODES, BLOCK_CELLS, PLACED = 2048, 1 << 17, 1 << 14

#: A label, and a gradient, is counted in units of 1 / UNIT.
UNIT = 1 << 16

#: Rounds after which margins are added up anew from the cells, so that no longer chain of cached steps leads to them.
KEEP = 20

#: Tasks that sum a level's histograms: they are small, and a default of 200 costs more than the rest of the level.
SUMMING = 4

#: Tasks whose histograms, of fixed size, the driver adds up itself.
DIRECT = 16

#: Sums of doubles that stay below this are exact.
EXACT = 2.0**53


def _rounded(v: np.ndarray) -> np.ndarray:
    """Three significant digits, so that a feature has at most 1,800 values a decade."""
    some = np.isfinite(v) & (v != 0)
    scale = 10.0 ** (2 - np.clip(np.floor(np.log10(np.abs(np.where(some, v, 1.0)))), -290, 290))
    with np.errstate(over="ignore", invalid="ignore"):  # what overflows is kept as it is
        got = np.round(v * scale) / scale
    return np.where(some & np.isfinite(got), got, v)


def _groups(sizes: list) -> list:
    """Features in groups whose bins have at most CODES combinations, the largest first."""
    groups, held = [], []
    for j in sorted(range(len(sizes)), key=lambda j: (-sizes[j], j)):
        k = next((k for k, n in enumerate(held) if n * sizes[j] <= CODES), len(held))
        if k == len(held):
            groups.append([])
            held.append(1)
        groups[k].append(j)
        held[k] *= sizes[j]
    return groups


@dataclass
class Trees:
    """A fitted model: complete trees in heap order (children of k: 2k + 1 and 2k + 2), feature -1 where a node is a leaf."""

    columns: tuple
    edges: list
    depth: int
    base: float | None = None
    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    null_left: list = field(default_factory=list)
    value: list = field(default_factory=list)

    def __post_init__(self):
        sizes = [len(e) + 2 for e in self.edges]
        self.groups = _groups(sizes)
        self.sizes = [[sizes[j] for j in g] for g in self.groups]
        self._next = {}

    def coded(self, bins: np.ndarray) -> np.ndarray:
        """A matrix of bins to one of codes, the last feature of a group counting in ones."""
        out = np.empty((len(bins), len(self.groups)), np.uint16, order="F")
        for k, (group, sizes) in enumerate(zip(self.groups, self.sizes)):
            code = np.zeros(len(bins), np.int64)
            for j, size in zip(group, sizes):
                code = code * size + bins[:, j]
            out[:, k] = code
        return out

    def following(self, t: int) -> np.ndarray:
        """The next node of tree t by node and code of the group that the node's feature is in, and each node's group."""
        if t not in self._next:
            feature = self.feature[t]
            inner = len(feature) // 2
            table = np.repeat(np.arange(len(feature))[:, None], CODES, 1).astype(np.min_scalar_type(len(feature)))
            group = np.zeros(len(feature), np.int64)
            for k in np.flatnonzero(feature[:inner] >= 0):
                group[k] = next(i for i, g in enumerate(self.groups) if feature[k] in g)
                g, sizes = self.groups[group[k]], self.sizes[group[k]]
                at = g.index(feature[k])
                bin_ = np.arange(int(np.prod(sizes))) // int(np.prod(sizes[at + 1 :])) % sizes[at]
                table[k, : len(bin_)] = 2 * k + 1 + np.where(bin_ == 0, not self.null_left[t][k], bin_ > self.cut[t][k])
            self._next[t] = table.ravel(), group
        return self._next[t]

    def binned(self, values) -> np.ndarray:
        """Columns of doubles, NaN for null, to a matrix of bins."""
        out = np.empty((len(values[0]), len(self.edges)), np.uint8, order="F")
        for j, (v, e) in enumerate(zip(values, self.edges)):
            out[:, j] = np.where(np.isnan(v), 0, np.searchsorted(e, _rounded(v), side="right") + 1)
        return out

    def place(self, codes: np.ndarray, t: int, levels: int) -> np.ndarray:
        """The node of tree t at which each row stands after so many levels; a table gives the next node by node and code."""
        out = np.zeros(len(codes), np.int64)
        if levels:
            following, group = self.following(t)
            for low in range(0, len(codes), PLACED):
                some = codes[low : low + PLACED]
                at = np.zeros(len(some), np.int64)
                flat, rows = some.ravel(order="F"), np.arange(len(some))
                start = group * len(some)
                for _ in range(levels):
                    at = following.take(at * CODES + flat.take(start.take(at) + rows)).astype(np.int64)
                out[low : low + PLACED] = at
        return out

    def margin(self, codes: np.ndarray, margin: np.ndarray) -> np.ndarray:
        """Margins with the trees' values added, in their order."""
        for t in range(len(self.value)):
            margin = margin + self.value[t][self.place(codes, t, self.depth)]
        return margin

    def part(self, first: int, last: int | None = None) -> Trees:
        """The model of the trees from `first` up to `last`."""
        return replace(self, **{k: getattr(self, k)[first:last] for k in ("feature", "cut", "null_left", "value")})

    def open_tree(self) -> None:
        n = 2 ** (self.depth + 1) - 1
        self.feature.append(np.full(n, -1))
        self.cut.append(np.zeros(n, np.int64))
        self.null_left.append(np.ones(n, bool))
        self.value.append(np.zeros(n))


def _doubles(batch: pa.RecordBatch, n: int) -> list:
    return [batch.column(j).to_numpy(zero_copy_only=False).astype(np.float64) for j in range(n)]


def _bytes(column: pa.Array, kind=np.uint8) -> np.ndarray:
    """All bytes of a column of binaries, one after the other."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the fewest bytes that hold them all."""
    low, high = x.min(), x.max()
    return x.astype(next((k for k in (np.int8, np.int16, np.int32) if np.iinfo(k).min <= low and high <= np.iinfo(k).max), np.int64))


def _whole(x, rows: int) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), f"i{len(x.as_buffer()) // rows}")


def _cells(batch: pa.RecordBatch, model: Trees):
    """(codes, n, y, margin) of each block; a batch of single cells, which are bins, is one block."""
    if pa.types.is_binary(batch.schema.field("n").type):
        for cell, n, y, margin in zip(*(batch.column(c) for c in ("cell", "n", "y", "margin"))):
            margin = np.frombuffer(margin.as_buffer(), np.float64)
            yield _codes(cell, model), _whole(n, len(margin)), _whole(y, len(margin)), margin
    elif batch.num_rows:
        yield model.coded(_bytes(batch.column("cell")).reshape(-1, len(model.columns))), *(batch.column(c).to_numpy() for c in ("n", "y", "margin"))


def _codes(cell, model: Trees) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), np.uint16).reshape(len(model.groups), -1).T


def _gradients(batch: pa.RecordBatch, model: Trees):
    """(codes, n, g) of each block, g the gradients by their margins; single cells' lack all trees but the last."""
    if "g" in batch.schema.names:
        for cell, n, g in zip(*(batch.column(c) for c in ("cell", "n", "g"))):
            codes = _codes(cell, model)
            yield codes, _whole(n, len(codes)).astype(np.int64), _whole(g, len(codes)).astype(np.int64)
    else:
        for codes, n, y, margin in _cells(batch, model):
            yield codes, n, _gradient(n, y, model.part(0, -1).margin(codes, margin))


def _gradient(n, y, margin) -> np.ndarray:
    return n * np.rint(margin * UNIT).astype(np.int64) - y


BLOCK = "cell binary, n binary, y binary, margin binary, g binary"


def _block(codes, n, y, margin) -> pa.RecordBatch:
    columns = codes, _narrow(n), _narrow(y), margin, _narrow(_gradient(n, y, margin))
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes(order="F")], pa.binary()) for x in columns], names=["cell", "n", "y", "margin", "g"])


def _values(width: int):
    """In a task: (feature, rounded value, rows); a task's counts are merged batch by batch."""

    def run(batches):
        seen = [(np.zeros(0), np.zeros(0, np.int64))] * width
        for b in batches:
            for j, v in enumerate(_doubles(b, width)):
                values = np.concatenate((seen[j][0], _rounded(v[np.isfinite(v)])))
                different, inverse = np.unique(values, return_inverse=True)
                weights = np.zeros(len(different), np.int64)
                np.add.at(weights, inverse, np.concatenate((seen[j][1], np.ones(len(values) - len(seen[j][0]), np.int64))))
                seen[j] = different, weights
        for j, (v, n) in enumerate(seen):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), j, np.int32)), pa.array(v), pa.array(n)], names=["feature", "v", "n"])

    return run


def edges(rows: DataFrame, columns, bins: int = BINS) -> list:
    """The lower ends of all bins but a feature's first, by the counts of its rounded values: each value apart, or some equal number of rows a bin."""
    width = len(columns)
    found = rows.select(*columns).mapInArrow(_values(width), "feature int, v double, n long").groupBy("feature", "v").agg(F.sum("n").alias("n"))
    t = found.toArrow()  # values of three digits
    feature, v, n = (t.column(c).to_numpy() for c in ("feature", "v", "n"))
    out = []
    for j in range(width):
        mine = np.flatnonzero(feature == j)
        mine = mine[np.argsort(v[mine])]
        values, rank = v[mine], np.cumsum(n[mine])
        if len(values) > bins - 1:
            ends = np.arange(1, bins - 1) * (int(rank[-1]) / (bins - 1))
            values = values[np.unique(np.concatenate(([0], np.minimum(np.searchsorted(rank, ends) + 1, len(values) - 1))))]
        out.append(values[1:])
    return out


def _binned(model: Trees):
    """In a task: rows of features and a label to (cell, y), a byte a feature."""
    width = len(model.columns)

    def run(batches):
        for b in batches:
            cells = model.binned(_doubles(b, width))
            ends = pa.py_buffer(np.arange(len(cells) + 1, dtype=np.int32) * np.int32(width))
            cell = pa.BinaryArray.from_buffers(pa.binary(), len(cells), [None, ends, pa.py_buffer(cells.tobytes())])
            yield pa.RecordBatch.from_arrays([cell, b.column(width)], names=["cell", "y"])

    return run


def _histogram(model: Trees, level: int, bins: int, wanted: np.ndarray):
    """In a task: (key, g, n), the gradients and rows of each wanted node of the level, feature and bin of the last tree, the only one not yet in the margins."""
    width, last = len(model.columns), len(model.value) - 1
    slots = int(wanted.sum())
    slot = np.where(wanted, np.cumsum(wanted) - 1, slots)  # the others' rows go to a last slot

    def run(batches):
        codes = [int(np.prod(x)) for x in model.sizes]
        sums = [np.zeros((2, slots * size), np.int64) for size in codes]
        for b in batches:
            for cells, n, g in _gradients(b, model):
                if level:
                    node = model.place(cells, last, level) - (2**level - 1)
                    start = np.where(node < 0, slots, slot.take(node, mode="clip"))  # leaves of earlier levels are done
                    some = np.flatnonzero(start < slots)
                    start, g, n = start[some], g[some], n[some]
                else:
                    start, some = 0, None
                exact = max(np.abs(g, dtype=np.float64).sum(), n.sum(dtype=np.float64)) < EXACT
                weights = [x.astype(np.float64) for x in (g, n)] if exact else (g, n)
                for k, size in enumerate(codes):
                    key = start * size + (cells[:, k] if some is None else cells[:, k].take(some)).astype(np.int64)
                    for total, x in zip(sums[k], weights):
                        if exact:
                            total += np.bincount(key, x, len(total)).astype(np.int64)
                        else:
                            np.add.at(total, key, x)
        nodes = np.flatnonzero(wanted)
        by_node = np.zeros((2, slots, width, bins), np.int64)
        for group, sizes, x in zip(model.groups, model.sizes, sums):
            x = x.reshape(2, slots, *sizes)
            for k, j in enumerate(group):
                by_node[:, :, j, : sizes[k]] = x.sum(axis=tuple(2 + i for i in range(len(group)) if i != k))
        at, feature, bin_ = np.nonzero(by_node[1])
        g, n = by_node[:, at, feature, bin_]
        yield pa.RecordBatch.from_arrays([pa.array((nodes[at] * width + feature) * bins + bin_), pa.array(g), pa.array(n)], names=["key", "g", "n"])

    return run


def _advanced(model: Trees):
    """In a task: the blocks with the trees' values in their margins; single cells are made blocks."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            for cells, n, y, margin in _cells(b, model):
                if pa.types.is_binary(b.schema.field("n").type):
                    yield _block(cells, n, y, model.margin(cells, margin))
                    continue
                held.append((cells, n, y, margin))
                size += len(n)
            if size >= BLOCK_CELLS:
                yield made(held)
                held, size = [], 0
        if held:
            yield made(held)

    def made(held):
        codes, n, y, margin = (np.concatenate(x) for x in zip(*held))
        codes = np.asfortranarray(codes)
        return _block(codes, n, y, model.margin(codes, margin))

    return run


def split(g: np.ndarray, n: np.ndarray, l2: float, least: int):
    """Gradients and rows of one node, both (feature, bin), to (gain, feature, cut, null_left) of its best cut, or None.

    The gain is that of a second-order expansion with leaves shrunk by l2; nulls go
    to the better side. Ties go to nulls left, then the first feature and cut.
    """
    total, rows = g[0].sum(), n[0].sum()
    gl, nl = np.cumsum(g[:, 1:], 1), np.cumsum(n[:, 1:], 1)
    gl, nl = np.stack((gl + g[:, :1], gl)), np.stack((nl + n[:, :1], nl))  # with nulls left, and right
    score = lambda a, m: (a / UNIT) ** 2 / np.maximum(m + l2, 1e-9)
    gain = score(gl, nl) + score(total - gl, rows - nl) - score(total, rows)
    gain = np.where((nl >= least) & (rows - nl >= least), gain, -np.inf)
    best = int(np.argmax(gain))
    side, feature, cut = np.unravel_index(best, gain.shape)
    return (gain.flat[best], int(feature), int(cut) + 1, side == 0) if gain.flat[best] > 1e-9 else None


def fit(train: DataFrame, label: str, columns, rounds: int = 100, depth: int = 6, rate: float = 0.2, l2: float = 1.0, least: int = 1, bins: int = BINS) -> Trees:
    """Gradient-boosted trees for squared error, from the mean of the labels on.

    Rows whose label is null or not finite teach nothing; null and NaN features have
    a bin of their own, infinite ones belong to the outermost. With nothing to learn
    from, predictions are null. A level is one job that sums gradients and rows by
    node, feature and bin, so that what reaches the driver is at most 2 ** (depth - 1)
    nodes' histograms, whatever the rows and tasks. Of two children only the one of
    fewer rows is summed. A round's margins are cached with its first level, and
    every KEEP rounds they are added up anew from the written cells.
    """
    y = F.col(label).cast("double")
    rows = train.where(F.abs(y) < F.lit(float("inf"))).select(*[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)], F.round(y * UNIT).cast("long").alias("y"))
    width = len(columns)
    model = Trees(tuple(columns), edges(rows.drop("y"), rows.columns[:-1], bins), depth)
    cells = stored(rows.mapInArrow(_binned(model), "cell binary, y long").groupBy("cell").agg(F.count("*").alias("n"), F.sum("y").alias("y")))
    n, total = cells.agg(F.sum("n"), F.sum("y")).first()
    if not n:
        return model
    model.base, first = total / n / UNIT, 0
    fresh = cells.withColumn("margin", F.lit(model.base))
    blocks = fresh.mapInArrow(_advanced(model), BLOCK).persist()
    for t in range(rounds):
        old = None
        if t:
            old, whole = blocks, t % KEEP == 0
            blocks = (fresh if whole else old).mapInArrow(_advanced(model.part(0) if whole else model.part(t - 1)), BLOCK).persist()
        model.open_tree()
        g = n = None
        for level in range(depth):
            g, n = _level(blocks, model, level, bins, g, n)
            if not level and old is not None:
                old.unpersist()
            if not _grown(model, level, g, n, rate, l2, least):
                break
    blocks.unpersist()
    return model


def _level(blocks: DataFrame, model: Trees, level: int, bins: int, g, n):
    """_summed() for the newest tree from the sums of the level before: its nodes' smaller children are summed, the others are what is left."""
    tree = model.part(-1)
    if not level:
        return _summed(blocks, tree, level, bins)
    feature, first = tree.feature[0], 2 ** (level - 1) - 1
    wanted, halves = np.zeros(2**level, bool), []
    for k in range(len(g)):
        f = feature[first + k]
        if f >= 0:
            left = np.arange(bins) <= tree.cut[0][first + k]
            left[0] = tree.null_left[0][first + k]
            small = 2 * k + (2 * n[k, f, left].sum() > n[k, f].sum())
            wanted[small] = True
            halves.append((k, small, small ^ 1))
    g_new, n_new = _summed(blocks, tree, level, bins, wanted)
    for k, small, large in halves:
        g_new[large], n_new[large] = g[k] - g_new[small], n[k] - n_new[small]
    return g_new, n_new


def _summed(cells: DataFrame, model: Trees, level: int, bins: int, wanted: np.ndarray | None = None):
    """Gradients and rows of a level's nodes, or the wanted ones of them, over all cells, both (node, feature, bin)."""
    wanted, parts = np.ones(2**level, bool) if wanted is None else wanted, cells.rdd.getNumPartitions()
    if "g" in cells.columns:
        cells = cells.select("cell", "n", "g")
    found = cells.mapInArrow(_histogram(model, level, bins, wanted), "key long, g long, n long")
    if parts > DIRECT:
        found = found.repartition(SUMMING, "key").groupBy("key").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    found, shape = found.toArrow(), (2**level, len(model.columns), bins)
    sums = np.zeros((2, shape[0] * shape[1] * bins), np.int64)
    for row, name in zip(sums, ("g", "n")):
        np.add.at(row, found.column("key").to_numpy(), found.column(name).to_numpy())
    return sums[0].reshape(shape), sums[1].reshape(shape)


def _grown(model: Trees, level: int, g: np.ndarray, n: np.ndarray, rate: float, l2: float, least: int) -> bool:
    """Cut the newest tree's nodes of a level and give their children values; whether any was cut."""
    feature, cut, null_left, value = model.feature[-1], model.cut[-1], model.null_left[-1], model.value[-1]
    leaf = lambda a, m: -rate * (a / UNIT) / (m + l2)
    any_cut = False
    for k in range(len(g)):
        at = 2**level - 1 + k
        if level == 0:
            value[0] = leaf(g[0, 0].sum(), n[0, 0].sum())
        found = split(g[k], n[k], l2, least) if n[k, 0].sum() else None
        if found:
            any_cut = True
            _, f, c, left = found
            feature[at], cut[at], null_left[at] = f, c, left
            to_left = np.arange(g.shape[2]) <= c
            to_left[0] = left
            for child, side in ((2 * at + 1, to_left), (2 * at + 2, ~to_left)):
                value[child] = leaf(g[k, f, side].sum(), n[k, f, side].sum())
    return any_cut


def predict(model: Trees, rows: DataFrame, name: str = "prediction") -> DataFrame:
    """rows with the model's value in the column `name`, which takes the place of one of that name; null without a base."""
    if model.base is None:
        return rows.withColumn(name, F.lit(None).cast("double"))

    @F.pandas_udf("double")
    def of(x):
        import pandas as pd

        bins = model.binned([x[c].to_numpy(np.float64) for c in x.columns])
        return pd.Series(model.margin(model.coded(bins), np.full(len(bins), model.base)))

    return rows.withColumn(name, of(F.struct(*[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(model.columns)])))
