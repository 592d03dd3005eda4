"""Substring dedup: paragraph MinHash banding, verified and clustered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, components, discard, materialize, sized, trimmed

WIDTH = 5
SIMILARITY = 0.8
#: Of every so many shingles in a row, the one with the smallest hash begins a passage: any run of 3 * WINDOW + WIDTH words that
#: two texts share has a passage that both have.
WINDOW = 14
#: Words on either side of a passage that are compared with those around its first occurrence.
AROUND = 20
#: Words of the shortest repeated run, of passages side by side, that is removed from inside a line.
SHORTEST = 25


def tune_bands(similarity: float = SIMILARITY, recall: float = 0.998, rows: int = 4) -> int:
    """The fewest bands of `rows` MinHash values that catch a pair at `similarity` with probability `recall`."""
    import math

    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def _split(text: str | None):
    """Words, as lower-case bytes, and (start, end) in words of every line with words."""
    words, lines = [], []
    for part in (text or "").encode("utf-8", "replace").lower().split(b"\n"):
        w = part.split()
        if w:
            lines.append((len(words), len(words) + len(w)))
            words += w
    return words, lines


def _hashes(words):
    import numpy as np
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _stir(h):
    """A bijection of 64-bit numbers."""
    import numpy as np

    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def _shingles(h, width=WIDTH):
    """A hash of every run of `width` words, from the words' hashes."""
    import numpy as np

    n = max(0, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = _stir(out) + h[j : j + n]
    return _stir(out)


def _mix(h, salt):
    """A long from a slice of 64-bit hashes, order included."""
    from xxhash import xxh64_intdigest

    v = xxh64_intdigest(h.tobytes(), salt)
    return v - (1 << 64) if v >> 63 else v


def _slid(x, width, f):
    """f over every `width` elements in a row."""
    step = 1
    while step * 2 <= width:
        x, step = f(x[:-step], x[step:]), step * 2
    return f(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


class _Batch:
    """Texts of a batch: words, lines and passages, in arrays over all of them.

    owner, first: a shingle's text, and where a text's shingles begin in `sh`; between
    texts stand WINDOW hashes larger than any.
    """

    def __init__(self, texts):
        import numpy as np

        top = np.iinfo(np.uint64).max
        self.lines, self.hashes, parts, owner = [], [], [], []
        pad = np.full(WINDOW, top, np.uint64)
        for k, t in enumerate(texts):
            words, lines = _split(t)
            h = _hashes(words)
            sh = np.minimum(_shingles(h), top - np.uint64(1))
            self.lines.append(lines)
            self.hashes.append(h)
            parts += [sh, pad]
            owner.append(np.full(len(sh) + WINDOW, k, np.int32))
        self.sh = np.concatenate([pad, *parts])
        self.owner = np.concatenate([np.full(WINDOW, -1, np.int32), *owner])
        sizes = [len(p) for p in parts[::2]]
        self.first = WINDOW + np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + WINDOW)])[:-1].astype(np.int64) if sizes else np.empty(0, np.int64)

    def passages(self):
        """(text, start, end, h) arrays: from one chosen shingle to the end of the next, by what they hold."""
        import numpy as np

        x, top = self.sh, np.iinfo(np.uint64).max
        if len(x) < 2 * WINDOW:
            return (np.empty(0, np.int64),) * 4
        low = _slid(x, WINDOW, np.minimum)
        edge = np.zeros(WINDOW - 1, np.uint64)
        low = np.where(low == top, np.uint64(0), low)
        chosen = np.flatnonzero((x == _slid(np.concatenate([edge, low, edge]), WINDOW, np.maximum)) & (x < top))
        a, b = chosen[:-1], chosen[1:]
        same = self.owner[a] == self.owner[b]
        a, b = a[same], b[same]
        total = np.concatenate([[np.uint64(0)], np.cumsum(_stir(x), dtype=np.uint64)])
        h = _stir(total[b + 1] - total[a] + _stir(x[a] + np.uint64(1)))
        text = self.owner[a].astype(np.int64)
        return text, a - self.first[text], b - self.first[text] + WIDTH, h.view(np.int64)

    def paragraphs(self):
        """(text, start, end, shingles) of every line of at least WIDTH words."""
        for k, lines in enumerate(self.lines):
            for s, e in lines:
                if e - s >= WIDTH:
                    at = self.first[k] + s
                    yield k, s, e, self.sh[at : at + e - s - WIDTH + 1]


def _bands(sets, bands: int, rows: int):
    """MinHash bands of every array of shingles: (len(sets), bands) longs."""
    import numpy as np

    k = bands * rows
    mul = np.random.default_rng(20).integers(1 << 62, size=k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low, i = np.full((len(sets), k), np.iinfo(np.uint64).max, np.uint64), 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= 1 << 13):
            size, j = size + len(sets[j]), j + 1
        x = np.concatenate(sets[i:j])
        x ^= x >> np.uint64(29)
        if j == i + 1:  # one line, of any length, in parts
            for s in range(0, len(x), 1 << 13):
                low[i] = np.minimum(low[i], (x[s : s + (1 << 13), None] * mul[None, :]).min(0))
        else:
            starts = np.concatenate([[0], np.cumsum([len(v) for v in sets[i : j - 1]])])
            low[i:j] = np.minimum.reduceat(x[:, None] * mul[None, :], starts, axis=0)
        i = j
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sets), bands))
    for r in range(rows):
        out = _stir(out) + low.reshape(len(sets), bands, rows)[:, :, r]
    return _stir(out).view(np.int64)


PASSAGE, LINE = 0, 1


def _paragraphs(bands: int, rows: int):
    """Batches of (doc_id, text) to (kind, h, bands): passages, without bands, and lines."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            batch = _Batch(b.column(1).to_pylist())
            h = batch.passages()[3]
            sets = [sh for _, _, _, sh in batch.paragraphs()]
            names = np.array([_mix(sh, 2) for sh in sets], np.int64)
            sig = _bands(sets, bands, rows) if sets else np.empty((0, bands), np.int64)
            offsets = np.concatenate([np.zeros(len(h), np.int32), np.arange(len(sets) + 1, dtype=np.int32) * bands])
            gaps = pa.array(np.concatenate([np.ones(len(h), bool), np.zeros(len(sets) + 1, bool)]))
            lists = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(offsets), [pa.compute.invert(gaps).buffers()[1], pa.py_buffer(offsets)]), pa.array(sig.ravel()))
            kind = np.concatenate([np.full(len(h), PASSAGE, np.int8), np.full(len(sets), LINE, np.int8)])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([h, names])), lists], ["kind", "h", "bands"])

    return run


def _details(again, compared):
    """Batches of (doc_id, text, t) to (kind, h, doc_id, t, start, end, left, right, set), of what the bitmap `again` holds.

    left, right: hashes of the words around a run of such passages, from it outwards, at
    its two outermost passages; else null. set: the different shingles of a line that
    the bitmap `compared` holds.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .common import BITMAP_BITS

        bits, near = np.frombuffer(again.value, np.uint8), np.frombuffer(compared.value, np.uint8)
        within = lambda m, h: (m[(h & ((1 << BITMAP_BITS) - 1)) >> 3] >> (h & 7) & 1).astype(bool)
        kinds = (pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
        for b in batches:
            ids, ts, cols = b.column(0).to_pylist(), b.column(2).to_pylist(), [[] for _ in range(9)]
            batch = _Batch(b.column(1).to_pylist())
            text, start, end, h = batch.passages()
            hit = within(bits, h)
            text, start, end, h = (v[hit] for v in (text, start, end, h))
            joint = (text[1:] == text[:-1]) & (start[1:] + WIDTH == end[:-1])  # with the passage before
            outer = np.ones((2, len(h)), bool)
            outer[0, 1:], outer[1, :-1] = ~joint, ~joint
            outer[0, 1:] |= outer[0, :-1].copy()  # the two passages at either end of a run: the last may be in the bitmap by chance
            outer[1, :-1] |= outer[1, 1:].copy()
            for k, s, e, x, l, r in zip(*(v.tolist() for v in (text, start, end, h, *outer))):
                words = batch.hashes[k]
                left = words[max(0, s - AROUND) : s].view(np.int32)[::2][::-1] if l else None
                right = words[e : e + AROUND].view(np.int32)[::2] if r else None
                for col, v in zip(cols, (PASSAGE, x, ids[k], ts[k], s, e, left, right, None)):
                    col.append(v)
            for k, s, e, sh in batch.paragraphs():
                x = _mix(sh, 2)
                at = np.array([x])
                if within(bits, at)[0]:
                    for col, v in zip(cols, (LINE, x, ids[k], ts[k], s, e, None, None, np.unique(sh).view(np.int64) if within(near, at)[0] else None)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["kind", "h", "doc_id", "t", "start", "end", "left", "right", "set"])

    return run


DETAILS = "kind byte, h long, doc_id long, t long, start int, end int, left array<int>, right array<int>, set array<long>"


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs (u, v, ...) with `same`: exact Jaccard of the shingle sets at least `similarity`."""
    a, b = sets.select(F.col("h").alias("u"), F.col("set").alias("a")), sets.select(F.col("h").alias("v"), F.col("set").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "u").join(b, "v").withColumn("same", both >= F.lit(similarity) * (F.size("a") + F.size("b") - both)).drop("a", "b")


def _bucket_links(similarity: float):
    """Rows (bucket, h, set) sorted by bucket to a spanning forest of each bucket's verified links."""

    def links(names, sets):
        import numpy as np

        ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        size = np.array([len(s) for s in sets])
        at = np.concatenate([[0], np.cumsum(size)])
        near, mark = np.arange(len(sets)), np.zeros(len(ids), bool)
        for i in range(1, len(sets)):
            own = ids[at[i] : at[i + 1]]
            mark[own] = True
            both = np.add.reduceat(mark[ids[: at[i]]], at[:i], dtype=np.int64)
            mark[own] = False
            hit = np.flatnonzero(both >= similarity * (size[:i] + size[i] - both))
            for label in np.unique(near[hit]):
                j = hit[near[hit] == label][0]
                yield names[i], names[j]
                near[near == label] = i

    def run(batches):
        import pyarrow as pa

        bucket, names, sets = None, [], []

        def table(found):
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["u", "v"])

        for b in batches:
            found = []
            values, offsets = b.column(2).values.to_numpy(), b.column(2).offsets.to_numpy()
            for k, (key, h) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if key != bucket:
                    if len(names) > 1:
                        found += links(names, sets)
                    bucket, names, sets = key, [], []
                names.append(h), sets.append(values[offsets[k] : offsets[k + 1]].copy())
            yield table(found)
        if len(names) > 1:
            yield table(list(links(names, sets)))

    return run


#: Members of a bucket that one task compares; larger buckets are compared as joins.
BUCKET_ROWS = 4096


def _held_bands(member):
    """Batches of (h, bands) to (band, h): the bands that the bitmap holds."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .common import BITMAP_BITS

        bits = np.frombuffer(member.value, np.uint8)
        for b in batches:
            lists = b.column(1)
            band = lists.flatten().to_numpy(zero_copy_only=False)
            h = np.repeat(b.column(0).to_numpy(zero_copy_only=False), np.asarray(lists.value_lengths()))
            hit = (bits[(band & ((1 << BITMAP_BITS) - 1)) >> 3] >> (band & 7) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(band[hit], pa.int64()), pa.array(h[hit], pa.int64())], ["band", "h"])

    return run


def shared_bands(paragraphs: DataFrame) -> DataFrame:
    """paragraphs(h, bands), distinct, to (band, h, n, v): the members of bands that several have, their number and the smallest.

    Most bands have one member; a bitmap of the others drops them before the join.
    """
    counts = paragraphs.select(F.explode("bands").alias("band"), "h").groupBy("band").agg(F.count("*").alias("n"), F.min("h").alias("v"))
    counts = materialize(counts.where("n > 1"))
    member = paragraphs.sparkSession.sparkContext.broadcast(bitmap(counts, "band"))
    return materialize(paragraphs.select("h", "bands").mapInArrow(trimmed(_held_bands(member)), "band long, h long").join(counts, "band"))


def near_paragraphs(hits: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (u, v) between different paragraphs (by h), all verified, with the components of all verified colliding pairs.

    hits: shared_bands(); sets(h, set). Copies are one h, so a bucket's size counts
    different texts. Buckets of up to bucket_rows members go, once for all bands with
    the same members, to a task that compares all and keeps a spanning forest. In
    larger ones, members are joined with the bucket's smallest; those that differ
    from it (the rest) with all members. Those equal to the smallest need no links
    among each other, so nothing is lost.
    """
    buckets = hits.where(F.col("n") <= bucket_rows).groupBy("band").agg(F.sort_array(F.collect_list("h")).alias("hs")).select("hs").distinct()
    members = buckets.select(F.xxhash64("hs").alias("bucket"), F.explode("hs").alias("h")).join(sets, "h").select("bucket", "h", "set")
    edges = members.repartition("bucket").sortWithinPartitions("bucket", "h").mapInArrow(trimmed(_bucket_links(similarity)), "u long, v long")
    large = hits.where(F.col("n") > bucket_rows)
    if large.limit(1).count():
        first = materialize(_verified(large.where("h <> v").select(F.col("h").alias("u"), "v").distinct(), sets, similarity))
        rest = large.join(first.where("NOT same").select(F.col("u").alias("h"), "v"), ["h", "v"], "left_semi").select("band", F.col("h").alias("u"))
        more = rest.join(large.select("band", F.col("h").alias("w")), "band").where("u <> w").select(F.greatest("u", "w").alias("u"), F.least("u", "w").alias("v")).distinct()
        edges = edges.union(first.where("same").select("u", "v")).union(_verified(more, sets, similarity).where("same").select("u", "v"))
    return materialize(edges.distinct())


def _alike(a, b):
    """How many elements at the beginning of two arrays of ints are equal."""
    unlike = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(a.isNull() | b.isNull(), 0).when(unlike > 0, unlike - 1).otherwise(F.size(a)).cast("int")


def _runs(batches):
    """Batches of (doc_id, t, spans(start, end, whole), first_docs) with spans merged to runs: those with a whole line, and those of SHORTEST words and more."""
    import pyarrow as pa

    for b in batches:
        out = []
        for spans in b.column(2).to_pylist():
            runs: list[list] = []
            for x in sorted(spans, key=lambda x: x["start"]):
                if runs and x["start"] <= runs[-1][1]:
                    runs[-1][1], runs[-1][2] = max(runs[-1][1], x["end"]), runs[-1][2] + [x]
                else:
                    runs.append([x["start"], x["end"], [x]])
            kept = []
            for s, e, own in runs:
                if e - s >= SHORTEST:
                    kept.append((s, e))
                else:
                    kept += [(x["start"], x["end"]) for x in own if x["whole"]]
            out.append([{"start": s, "end": e} for s, e in kept])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, kind), b.column(3)], ["doc_id", "t", "spans", "first_docs"])


def repeats(docs: DataFrame, similarity: float = SIMILARITY, bands: int | None = None, rows: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, t, spans, first_docs): word spans of docs that repeat an earlier paragraph or passage; no row without spans.

    t: the text's hash, by which rows with one doc_id and different texts are told
    apart; rows with the same of both are one document.

    Paragraphs are lines of at least WIDTH words: near copies are found by MinHash
    bands, verified by exact Jaccard over shingles of five words and clustered by
    components; a cluster's first paragraph, by doc_id and start, is no repeat.
    Passages, from one chosen shingle to the next (WINDOW), are held against each
    other by the hashes of all their shingles. One that occurs earlier is extended,
    word by word, as far as the text around its run equals that around the first run
    with the passage at that end; runs of SHORTEST words and more go, also across lines. Words are
    split at ASCII white space, A-Z lower-cased; null and short texts have no spans.
    """
    bands = bands or tune_bands(similarity, rows=rows)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t")).where("doc_id IS NOT NULL")
    p = materialize(docs.mapInArrow(trimmed(_paragraphs(bands, rows)), "kind byte, h long, bands array<long>"))
    lines = materialize(p.where(f"kind = {LINE}").groupBy("h").agg(F.count("*").alias("n"), F.first("bands").alias("bands")))
    hits = shared_bands(lines.select("h", "bands"))
    twice = p.where(f"kind = {PASSAGE}").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    again = twice.union(lines.where("n > 1").select("h")).union(hits.select("h").distinct())
    share = docs.sparkSession.sparkContext.broadcast
    found = materialize(docs.mapInArrow(trimmed(_details(share(bitmap(again, "h")), share(bitmap(hits.select("h").distinct(), "h")))), DETAILS))
    sets = materialize(found.where("set IS NOT NULL").groupBy("h").agg(F.first("set").alias("set")))
    cluster = materialize(components(near_paragraphs(hits, sets, similarity, bucket_rows)).select(F.col("node").alias("h"), F.col("component").alias("cluster")))
    placed = found.where(f"kind = {LINE}").select("h", "doc_id", "t", "start", "end").join(sized(cluster), "h", "left")
    placed = materialize(placed.select("doc_id", "t", "start", "end", F.coalesce("cluster", "h").alias("cluster")))
    first = placed.groupBy("cluster").agg(F.min(F.struct("doc_id", "t", "start")).alias("first"))
    whole = placed.join(first, "cluster").where("struct(doc_id, t, start) <> first").select("doc_id", "t", "start", "end", F.col("first.doc_id").alias("first_doc"), F.lit(True).alias("whole"))
    own = found.where(f"kind = {PASSAGE}").select("h", "doc_id", "t", "start", "end", "left", "right")
    at = F.struct("doc_id", "t", "start")
    ends = [F.min(F.when(F.col(c).isNotNull(), F.struct("doc_id", "t", "start", c))).alias(f"f{c}") for c in ("left", "right")]
    early = materialize(own.groupBy("h").agg(F.min(at).alias("f"), F.count("*").alias("n"), *ends).where("n > 1").drop("n"))
    pairs = own.join(early, "h").where(at != F.col("f"))

    def more(c):  # against the first occurrence that has words on that side, if it is an earlier one
        other = F.col(f"f{c}")
        earlier = F.struct(other["doc_id"].alias("doc_id"), other["t"].alias("t"), other["start"].alias("start")) < at
        return F.when(earlier, _alike(F.col(c), other[c])).otherwise(0)

    inner = pairs.select("doc_id", "t", (F.col("start") - more("left")).alias("start"), (F.col("end") + more("right")).alias("end"), F.col("f.doc_id").alias("first_doc"), F.lit(False).alias("whole"))
    spans = whole.union(inner).groupBy("doc_id", "t").agg(F.collect_set(F.struct("start", "end", "whole")).alias("spans"), F.sort_array(F.collect_set("first_doc")).alias("first_docs"))
    out = materialize(spans.mapInArrow(trimmed(_runs), "doc_id long, t long, spans array<struct<start:int,end:int>>, first_docs array<long>").where("size(spans) > 0"))
    for t in (p, lines, hits, found, sets, cluster, placed, early):
        discard(t)
    return out


def _cut_text(text, spans):
    """The text without the words in spans (by word number), and what white space precedes a word that goes."""
    import re

    if not spans:
        return text
    gone = set()
    for s, e in spans:
        gone.update(range(s, e))
    out, end = [], 0
    raw = (text or "").encode("utf-8", "replace")
    for k, m in enumerate(re.finditer(rb"[^\x20\x09-\x0D]+", raw)):
        if k not in gone:
            out.append(raw[end : m.end()])
        end = m.end()
    return (b"".join(out) + raw[end:]).decode("utf-8", "replace")


def _removal(batches):
    import pyarrow as pa

    for b in batches:
        spans = [[(x["start"], x["end"]) for x in s or ()] for s in b.column("__mr_spans").to_pylist()]
        text = [_cut_text(t, s) for t, s in zip(b.column("text").to_pylist(), spans)]
        cols = [pa.array(text, pa.string()) if n == "text" else b.column(n) for n in b.schema.names if n != "__mr_spans"]
        yield pa.RecordBatch.from_arrays(cols, [n for n in b.schema.names if n != "__mr_spans"])


def remove_repeats(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with every repeated span cut out of `text`; other columns, and documents without repeats, as they were."""
    per = repeats(docs, similarity).select(F.col("doc_id").alias("__mr_id"), F.col("t").alias("__mr_t"), F.col("spans").alias("__mr_spans"))
    joined = docs.join(per, (docs["doc_id"] == F.col("__mr_id")) & (F.xxhash64(docs["text"]) == F.col("__mr_t")), "left").select(*[docs[c] for c in docs.columns], "__mr_spans")
    return joined.mapInArrow(trimmed(_removal), docs.schema)


def substring_report(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row a document: doc_id, n_removed (words), spans (start, end in words), first_docs (documents that keep the text)."""
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    per = repeats(docs, similarity).select(F.col("doc_id").alias("__mr_id"), F.col("t").alias("__mr_t"), words.alias("n_removed"), "spans", "first_docs")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("__mr_own"))
    return d.join(per, (d["doc_id"] == F.col("__mr_id")) & (F.col("__mr_own") == F.col("__mr_t")), "left").select("doc_id", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), "spans", "first_docs")
