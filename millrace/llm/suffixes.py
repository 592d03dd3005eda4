"""Exact dedup of repeated strings: threshold-bounded interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BITMAP_BITS, bitmap, materialize, sized

#: Shortest repeat in bytes, and the bytes of an anchor within it.
MIN_LENGTH, ANCHOR = 100, 48
#: Different contexts of an anchor that one task transforms together; anchors with more go the way of _windows.
CONTEXTS = 20_000
#: Bytes that are transformed at once: so few that the arrays stay in a core's cache. One anchor's contexts are never parted.
BATCH_BYTES = 1 << 17


def _utf8(text):
    return (text or "").encode("utf-8", "replace")


def anchors(data: bytes, min_length: int = MIN_LENGTH):
    """(positions, hashes) of anchors: strings of ANCHOR bytes with the smallest hash in some string of min_length bytes.

    Which anchors a string of min_length bytes has depends on its bytes alone, so equal ones share theirs.
    """
    import numpy as np

    n = len(data) - ANCHOR + 1
    if len(data) < min_length:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h, mul, step = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while step < ANCHOR // 3:  # each value covers `step` bytes
        h = h[:-step] * np.uint64(mul) + h[step:]
        mul, step = mul * mul & (1 << 64) - 1, step * 2
    h = (h[: -2 * step] * np.uint64(mul) + h[step:-step]) * np.uint64(mul) + h[2 * step :]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)

    def slid(x, width, f):
        step = 1
        while step * 2 <= width:
            x, step = f(x[:-step], x[step:]), step * 2
        return f(x[: len(x) - (width - step)], x[width - step :]) if width > step else x

    width = min_length - ANCHOR + 1
    low = slid(h, width, np.minimum)  # of each window's anchors
    pad = np.zeros(width - 1, np.uint64)
    top = slid(np.concatenate([pad, low, pad]), width, np.maximum)[:n]  # of the windows that hold an anchor
    at = np.flatnonzero(h == top)
    return at, h[at].view(np.int64)


def _anchor_counts(batches):
    """Batches of (doc_id, text) to (h, n): anchors with their occurrences, summed within a batch."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        h, n = np.unique(np.concatenate([np.empty(0, np.int64), *[anchors(_utf8(t))[1] for t in b.column(1).to_pylist()]]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n, pa.int64())], ["h", "n"])


def _occurrences(member, min_length: int = MIN_LENGTH):
    """Batches of (doc_id, text) to (h, c, doc_id, pos, left, size, ctx) for anchors in the bitmap.

    ctx: the anchor and up to min_length - ANCHOR bytes on either side, `left` of
    them before it: all strings of min_length bytes that hold it. c: its hash.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        bits, side = np.frombuffer(member.value, np.uint8), min_length - ANCHOR
        for b in batches:
            cols = [[] for _ in range(7)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = _utf8(text)
                pos, h = anchors(data, min_length)
                at = h & ((1 << BITMAP_BITS) - 1)
                hit = (bits[at >> 3] >> (at & 7) & 1).astype(bool)
                for p, x in zip(pos[hit].tolist(), h[hit].tolist()):
                    left = min(p, side)
                    ctx = data[p - left : p + ANCHOR + side]
                    c = xxh64_intdigest(ctx, left)
                    for col, v in zip(cols, (x, c - (1 << 64) if c >> 63 else c, doc, p, left, len(ctx), ctx)):
                        col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["h", "c", "doc_id", "pos", "left", "size", "ctx"])

    return run


def suffix_order(text):
    """The order of all suffixes of a uint8 array by their first 216 bytes; ends count as smallest.

    Ranks by 8 bytes are joined to ranks by three times as many, until no two are equal.
    """
    import numpy as np

    n = len(text)
    pad = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | pad[j : j + n]
    step, bits = 8, np.uint64(n.bit_length())
    while True:
        order = np.argsort(key)
        k = key[order]
        rank = np.zeros(n + 2 * step, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[True], k[1:] != k[:-1]])).astype(np.uint64)
        if step >= 216 or rank[order[-1]] == n:
            return order
        if 3 * n.bit_length() > 64:
            key, step = rank[:n] << np.uint64(32) | rank[step : step + n], 2 * step
        else:
            key, step = (rank[:n] << bits | rank[step : step + n]) << bits | rank[2 * step : 2 * step + n], 3 * step


def repeat_classes(text, min_length: int):
    """(order, starts): suffixes in order; starts[x] is true if the suffix at x shares fewer than min_length bytes with the one before.

    Level by level, the intervals of suffixes with a common prefix of l bytes are
    extended backward by one byte through the transform's mapping: a position that
    still shares l + 1 bytes with its predecessor is one whose suffixes, shortened
    by their first byte, lie in one interval of level l. Positions get their common
    prefix by increasing value and then rest; the search stops at min_length.
    """
    import numpy as np

    n = len(text)
    order = suffix_order(text)
    place = np.empty(n + 1, np.intp)
    place[order], place[n] = np.arange(n), 0
    after = place[order + 1]  # the inverse of the backward step
    first = text[order]
    starts, interval = np.ones(n, np.int32), np.empty(n, np.int32)
    starts[1:] = first[1:] != first[:-1]
    open_ = np.flatnonzero(starts == 0)
    a, b = after[open_], after[open_ - 1]
    ended = (order[open_] == n - 1) | (order[open_ - 1] == n - 1)  # the last byte and what follows it share one byte alone
    for _ in range(1, min_length):
        np.cumsum(starts, out=interval)
        apart = interval.take(a, mode="clip") != interval.take(b, mode="clip")
        if ended is not None:
            apart, ended = apart | ended, None
        settled = open_[apart]
        if starts[settled].all():
            break  # nothing new, and so it is at every further level
        starts[settled] = 1
        if len(settled) > len(open_) // 8:  # settled ones may stay among the open, where they change nothing
            still = np.flatnonzero(~apart)
            open_, a, b = open_[still], a[still], b[still]
    return order, starts.astype(bool)


def _found(rows, min_length: int = MIN_LENGTH):
    """Rows (h, doc_id, pos, left, ctx), whole anchors, to (doc_id, start, end): strings that start earlier too.

    The contexts are transformed as one text in which a zero byte, which then also
    stands for itself, ends each; strings that would reach over it are left out.
    """
    import numpy as np

    ctx = [r[4] for r in rows]
    size = np.array([len(c) for c in ctx])
    text = np.frombuffer(b"\0".join(ctx) + b"\0", np.uint8)
    at = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    owner = np.repeat(np.arange(len(rows)), size + 1)
    inside = np.arange(len(text)) - at[owner]
    order, starts = repeat_classes(text, min_length)
    fits = (inside + min_length <= size[owner])[order]
    cls = np.cumsum(starts)[fits]
    pos = order[fits]
    own = owner[pos]
    docs, doc = np.unique([r[1] for r in rows], return_inverse=True)
    begin = np.array([r[2] - r[3] for r in rows])[own] + inside[pos]
    # a class's strings may be of several anchors here: all true repeats
    key = doc[own] * (1 << 32) + begin
    if not len(key):
        return []
    cut = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
    low = np.minimum.reduceat(key, cut)
    late = key > low[np.cumsum(np.concatenate([[False], cls[1:] != cls[:-1]]))]
    k = np.unique(key[late])
    if not len(k):
        return []
    gap = np.flatnonzero(np.concatenate([[True], np.diff(k) > min_length]))
    last = np.concatenate([gap[1:], [len(k)]]) - 1
    return [(int(docs[x >> 32]), int(x & 0xFFFFFFFF), int(y & 0xFFFFFFFF) + min_length) for x, y in zip(k[gap].tolist(), k[last].tolist())]


def _candidates(rows, min_length: int = MIN_LENGTH):
    """Of one anchor's rows, those that share with another what stands on the longer side of any repeat.

    A string of min_length bytes that holds the anchor has at least half of its other
    bytes on one side of it; a context that shares neither half has no repeat, and
    one that shares a single half is cut to less than a half on its other side.
    """
    from collections import Counter

    half = (min_length - ANCHOR) // 2
    ahead = [ctx[left : left + ANCHOR + half] for _, _, _, left, ctx in rows]
    behind = [ctx[max(0, left - half) : left + ANCHOR] for _, _, _, left, ctx in rows]
    a, b = Counter(ahead), Counter(behind)
    out = []
    for r, x, y in zip(rows, ahead, behind):
        more, less = a[x] > 1 and len(x) == ANCHOR + half, b[y] > 1 and len(y) == ANCHOR + half
        h, doc, pos, left, ctx = r
        if more and less:
            out.append(r)
        elif more:
            cut = max(0, left - half)
            out.append((h, doc, pos, left - cut, ctx[cut:]))
        elif less:
            out.append((h, doc, pos, left, ctx[: left + ANCHOR + half]))
    return [r for r in out if len(r[4]) >= min_length]


def _transformed(batches):
    """Rows (h, doc_id, pos, left, ctx) sorted by h to (doc_id, start, end)."""
    import pyarrow as pa

    def table(found):
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32())], ["doc_id", "start", "end"])

    held: list[tuple] = []
    size = 0
    own: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if own and row[0] != own[0][0]:
                kept = _candidates(own)
                held += kept
                size += sum(len(r[4]) for r in kept)
                own = []
                if size > BATCH_BYTES:
                    yield table(_found(held))
                    held, size = [], 0
            own.append(row)
    held += _candidates(own)
    if held:
        yield table(_found(held))


def _windows(batches):
    """Rows (h, doc_id, pos, left, ctx) to a row for each of their strings of MIN_LENGTH bytes: (a, b, doc_id, start)."""
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    signed = lambda v: v - (1 << 64) if v >> 63 else v
    for b in batches:
        out = [[], [], [], []]
        for _, doc, pos, left, ctx in zip(*(c.to_pylist() for c in b.columns)):
            for j in range(len(ctx) - MIN_LENGTH + 1):
                w = ctx[j : j + MIN_LENGTH]
                for col, v in zip(out, (signed(xxh64_intdigest(w, 1)), signed(xxh64_intdigest(w, 2)), doc, pos - left + j)):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["a", "b", "doc_id", "start"])


def _merged(spans):
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _rest(batches):
    """Batches of (doc_id, text, copy, spans) to the contract's columns."""
    import hashlib

    import pyarrow as pa

    for b in batches:
        cols = [[] for _ in range(4)]
        for text, copy, spans in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
            data = _utf8(text)
            cut = [[0, len(data)]] if copy and len(data) >= MIN_LENGTH else [] if copy else _merged((s["start"], s["end"]) for s in spans or ())
            kept, end = hashlib.sha256(), 0
            for s, e in cut:
                kept.update(data[end:s])
                end = e
            kept.update(data[end:])
            for col, v in zip(cols, (len(data), sum(e - s for s, e in cut), len(cut), kept.hexdigest())):
                col.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in cols]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, contexts: int = CONTEXTS) -> DataFrame:
    """docs(doc_id, text), texts all different, to (doc_id, start, end): bytes of strings of MIN_LENGTH bytes that start earlier too.

    Equal strings share an anchor, so only anchors that occur twice matter, and all
    that is needed of a text is what stands around them. Occurrences with the same
    surroundings are one context: all but the first are repeats throughout. Anchors
    with several contexts go, whole, to tasks that transform them.
    """
    counts = materialize(docs.mapInArrow(_anchor_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    member = docs.sparkSession.sparkContext.broadcast(bitmap(counts, "h"))
    seen = materialize(docs.mapInArrow(_occurrences(member), "h long, c long, doc_id long, pos int, left int, size int, ctx binary"))
    one = materialize(seen.groupBy("h", "c").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n"), F.first("left").alias("left"), F.first("ctx").alias("ctx")))
    again = one.where("n > 1").select("h", "c", "first")
    copies = seen.select("h", "c", "doc_id", "pos", "left", "size").join(again, ["h", "c"]).where("struct(doc_id, pos) <> first")
    spans = copies.where(F.col("size") >= MIN_LENGTH).select("doc_id", F.expr("pos - left").alias("start"), F.expr("pos - left + size").alias("end"))
    per = materialize(one.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"))
    several = one.join(sized(per), "h").select("h", F.col("first.doc_id").alias("doc_id"), F.col("first.pos").alias("pos"), "left", "ctx", "k")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = several.where(F.col("k") <= contexts).drop("k").repartition(n, "h").sortWithinPartitions("h", "doc_id", "pos")
    spans = spans.union(small.mapInArrow(_transformed, "doc_id long, start int, end int"))
    if per.where(F.col("k") > contexts).limit(1).count():
        w = several.where(F.col("k") > contexts).drop("k").mapInArrow(_windows, "a long, b long, doc_id long, start int")
        low = materialize(w.groupBy("a", "b").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
        spans = spans.union(w.join(low, ["a", "b"]).where("struct(doc_id, start) <> first").select("doc_id", "start", (F.col("start") + MIN_LENGTH).alias("end")))
    return spans


def suffix_dedup(docs: DataFrame, contexts: int = CONTEXTS) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_bytes, n_removed, n_spans, kept_sha256, a row for each.

    Removed is each byte that is covered by a string of MIN_LENGTH bytes that also
    starts earlier: in a smaller doc_id, or earlier in the same document. Texts, null as
    empty, are UTF-8 bytes, and strings never cross documents. Of equal texts only
    the first is searched; the others go throughout. Rows that repeat a doc_id with
    the same text are one document; a row without a doc_id is left whole.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = d.select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"), F.length("text").alias("c"))
    first = materialize(ids.groupBy("a", "b", "c").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").drop("last"))
    copy = materialize(ids.join(sized(first), ["a", "b", "c"]).where("doc_id <> first").select(F.col("doc_id").alias("_copy")).distinct())
    flagged = d.join(sized(copy), d["doc_id"] == copy["_copy"], "left").select("doc_id", "text", F.col("_copy").isNotNull().alias("copy"))
    spans = repeated_spans(flagged.where("NOT copy AND doc_id IS NOT NULL").select("doc_id", "text"), contexts)
    per = materialize(spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans")).withColumnRenamed("doc_id", "_doc"))
    full = flagged.join(sized(per), flagged["doc_id"] == per["_doc"], "left").select("doc_id", "text", "copy", "spans")
    return full.mapInArrow(_rest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
