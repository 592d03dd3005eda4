"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, components, materialize, sized, trimmed
from .paragraphs import _bucket_links as _set_links

#: Members of a bucket that one task compares at once; larger buckets go the way of _midpoints.
BUCKET_ROWS = 4096


def _majority(h):
    """The long whose bit b is set if more than half of the 64-bit hashes have it; a long text's bits are unpacked in parts."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash, as a signed long, of the word shingles of `text` (A-Z lower-cased, null: empty).

    Words are split at ASCII white space. Fewer than `width` words: their whole
    sequence is the one shingle; none: zero. Bit b is set if more than half of
    the shingles' XXH64 have it.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line, k = b" ".join(words), min(width, len(words))
    at = [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    h = np.array([xxh64_intdigest(line[a : b - 1], seed) for a, b in zip(at, at[k:])], dtype="<u8")
    return _majority(h)


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row of docs(doc_id, text); no shuffle."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fp = pa.array([fingerprint(x, width, seed) for x in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _ball(segment: str, bits: int, tag: int) -> str:
    return f"transform(sequence(0, {bits}), i -> ({segment} ^ (CASE WHEN i = 0 THEN 0L ELSE shiftleft(1L, i - 1) END)) | {tag << 32}L)"


def _bucket_links(radius: int):
    """Buckets (fps: array of long) to a spanning forest of their links: each bucket's rows out are fewer than in."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            us, vs, pairs = [], [], []
            for fps in b.column(0).to_pylist():
                if len(fps) == 2:
                    pairs.append(fps)
                    continue
                x = np.array(fps, np.int64).view(np.uint64)
                near = np.arange(len(x))  # label of what is linked so far
                for i in range(len(x)):
                    hit = np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= radius)
                    for lab in np.unique(near[hit]):
                        j = hit[near[hit] == lab][0]
                        us.append(fps[i]), vs.append(fps[j])
                        near[near == lab] = i
            if pairs:
                p = np.array(pairs, np.int64)
                p = p[np.bitwise_count((p[:, 0] ^ p[:, 1]).view(np.uint64)) <= radius]
                us += p[:, 0].tolist()
                vs += p[:, 1].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def _midpoints(keyed: DataFrame, radius: int) -> DataFrame:
    """Links of buckets of any size, without pairs: fingerprints within `radius` share a midpoint within half of it.

    keyed: (key, fp), key a segment's value at distance 0 or 1 from fp's. Each fp
    emits the values of its other segment within what is left of radius // 2, and
    is linked to the smallest fp of the same (key, value): exact for even radii.
    """
    half = radius // 2
    k = keyed.select("key", "fp", F.expr("CASE WHEN key >= 4294967296 THEN fp & 4294967295 ELSE shiftrightunsigned(fp, 32) END").alias("own"), F.expr("CASE WHEN key >= 4294967296 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295 END").alias("other"))
    k = k.withColumn("left", half - F.expr("bit_count(own ^ (key & 4294967295))"))
    one = "transform(sequence(0, 31), i -> other ^ shiftleft(1L, i))"
    two = "flatten(transform(sequence(0, 30), i -> transform(sequence(i + 1, 31), j -> other ^ shiftleft(1L, i) ^ shiftleft(1L, j))))"
    k = k.where("left >= 0").select("key", "fp", F.explode(F.expr(f"CASE WHEN left = 0 THEN array(other) WHEN left = 1 THEN concat(array(other), {one}) ELSE concat(array(other), {one}, {two}) END")).alias("mid"))
    first = k.groupBy("key", "mid").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("key", "mid", "v")
    return k.join(first, ["key", "mid"]).select(F.col("fp").alias("u"), "v").where("u <> v").distinct()


def near_fingerprints(fps: DataFrame, radius: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of distinct `fp` within `radius` bits.

    A 64-bit fingerprint is cut into two segments: within `radius` (at most 5)
    bits, one of them differs in two bits at most, so both ends' Hamming balls
    of radius 1 around that segment meet. Each fingerprint is entered under those
    33 values a segment; values that only it has are dropped after a count with
    partial sums. Buckets up to `bucket_rows` are compared in full inside a task
    that keeps a spanning forest; larger ones (radius 4 or less) by midpoints.
    """
    if not 0 <= radius <= 5:
        raise ValueError("radius must be 0 to 5")
    spread = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = fps.select("fp").distinct().repartition(spread, F.xxhash64("fp"))  # small rows that grow by 66: more tasks than their bytes ask for
    keyed = d.select("fp", F.explode(F.expr(f"concat({_ball('shiftrightunsigned(fp, 32)', 32, 0)}, {_ball('(fp & 4294967295)', 32, 1)})")).alias("key"))
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    hits = keyed.join(shared, "key")
    small = hits.where(F.col("n") <= bucket_rows).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    edges = small.select("fps").distinct().mapInArrow(_bucket_links(radius), "u long, v long")
    if shared.where(F.col("n") > bucket_rows).limit(1).count():
        if radius == 5:
            raise ValueError("a bucket is over bucket_rows: take radius 4, which has an exact way for it")
        edges = edges.union(_midpoints(hits.where(F.col("n") > bucket_rows).select("key", "fp"), radius))
    return edges.distinct()


def simhash_components(docs: DataFrame, width: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """docs(doc_id, text) to (doc_id, fp, component_id), a row for each row of docs.

    Documents link when their fingerprints differ in `radius` bits or fewer;
    component_id is the smallest doc_id reachable. Equal fingerprints (exact
    copies, and all texts without words) are one node, however many rows share
    it. Null texts count as empty; an empty table gives no rows; a null doc_id
    gets its component's id.
    """
    fps = materialize(fingerprints(docs, width, seed))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    comp = components(near_fingerprints(fps, radius))
    placed = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    placed = materialize(placed)
    low = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    table = materialize(placed.join(low, "root").select("fp", "component_id"))
    return fps.join(table, "fp").select("doc_id", "fp", "component_id")


#: Bits of the long fingerprint that rejects pairs before the exact comparison, in longs.
LONG = 4
#: Fingerprints that share the bits of a lookup table by chance, at most; more documents take more bits and more tables.
TABLE_ROWS = 256
#: Lookup tables whose rows are shuffled at once.
TABLES = 16
#: Members of a table's bucket that one task compares at once; larger buckets are cut and compared by pairs of parts.
PART_ROWS = 2048
#: Shingles of a group of candidates that one task compares at once; larger groups are cut and compared by pairs of parts.
GROUP_SHINGLES = 1 << 19


def bits_apart(similarity: float, deviations: float = 0.0, longs: int = LONG) -> int:
    """The bits in which long fingerprints of two texts with this Jaccard similarity of shingles are expected to differ, and so many standard deviations more; or some longs of them."""
    import math

    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(64 * longs * p + deviations * math.sqrt(64 * longs * p * (1 - p)))


def shingle_set(text: str | None, width: int = 5):
    """The sorted XXH64 of the different word shingles of `text`; fewer than `width` words are one shingle, none give none."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, k = b" ".join(words), min(width, len(words))
    at = [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    return np.unique(np.array([xxh64_intdigest(line[a : b - 1], 42) for a, b in zip(at, at[k:])], dtype=np.uint64))


def set_name(sh) -> int:
    """A long that equal shingle sets share."""
    from xxhash import xxh64_intdigest

    v = xxh64_intdigest(sh.tobytes(), 3)
    return v - (1 << 64) if v >> 63 else v


def sketch(sh) -> list[int]:
    """LONG longs of SimHash over a shingle set."""
    import numpy as np

    if not len(sh):
        return [0] * LONG
    mixed = lambda h, j: (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * j * 0x632BE59BD9B4E019 & (1 << 64) - 1 | 1)
    return [_majority(mixed(mixed(sh, j), j + 5)) for j in range(LONG)]


def lookup_tables(rows: int, similarity: float, recall: float = 0.99) -> tuple[int, int]:
    """(bits, tables): of so many tables, each keyed by so many of a fingerprint's bits, one holds both ends of a pair at `similarity` with probability `recall`.

    The bits leave at most TABLE_ROWS of `rows` unlike fingerprints in a bucket.
    """
    import math

    n, p = 64 * LONG, math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = max(0, math.ceil(math.log2(max(1, rows) / TABLE_ROWS)))
    # a pair that differs in d bits agrees on a table's with probability C(n - d, bits) / C(n, bits)
    meet = [(math.comb(n, d) * p**d * (1 - p) ** (n - d), math.comb(n - d, bits) / math.comb(n, bits)) for d in range(n + 1)]
    missed = lambda t: sum(w * (1 - q) ** t for w, q in meet)
    tables = 1
    while missed(tables) > 1 - recall:
        tables += 1
    return bits, tables


def _table_keys(bits: int, tables: range, whole: bool):
    """Batches of (node, s0..) to a row a table: its number and the fingerprint's bits there, as `key`; with node and s0.. if whole."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        weight = np.zeros((64 * LONG, len(tables)))
        for k, t in enumerate(tables):
            weight[np.random.default_rng(1000 + t).permutation(64 * LONG)[:bits], k] = 2.0 ** np.arange(bits)
        for b in batches:
            fp = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], 1).astype("<i8")
            ones = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8 * LONG), axis=1, bitorder="little")
            key = (ones @ weight).astype(np.int64) + (np.array(tables, np.int64) << bits)[None, :]
            cols = [pa.array(key.ravel())]
            if whole:
                at = pa.array(np.repeat(np.arange(len(fp)), len(tables)))
                cols += [c.take(at) for c in b.columns]
            yield pa.RecordBatch.from_arrays(cols, ["key", "node", *[f"s{j}" for j in range(LONG)]][: len(cols)])

    return run


def _stars(x, limit: int, first_limit: int):
    """For rows of LONG longs each, the smallest row that links of at most `limit` bits lead to."""
    import numpy as np

    label = np.arange(len(x))
    for i in range(0, len(x), 256):
        part = x[i : i + 256]
        u, v = np.nonzero(np.bitwise_count(part[:, :1] ^ x[None, : i + len(part), 0]) <= first_limit)
        u, v = u[v < u + i] + i, v[v < u + i]
        same = np.bitwise_count(x[u] ^ x[v]).sum(1) <= limit
        a, b = label[u[same]], label[v[same]]
        pairs = np.unique((a * len(x) + b)[a != b])
        root = np.arange(len(x))
        for a, b in zip((pairs // len(x)).tolist(), (pairs % len(x)).tolist()):
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            while root[b] != b:
                root[b] = root[root[b]]
                b = root[b]
            root[max(a, b)] = min(a, b)
        if len(pairs):
            while (root[root] != root).any():
                root = root[root]
            label = root[label]
    return label


def _bucket_stars(limit: int, first_limit: int):
    """Rows (bucket, node, s0..), sorted by bucket, to links (u, v) whose components are those of each bucket's links."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def links(key, node, x):
            us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            for a, b in zip(edge[:-1], edge[1:]):
                if b - a > 1:
                    label = _stars(x[a:b], limit, first_limit)
                    far = np.flatnonzero(label != np.arange(b - a))
                    us.append(node[a + far])
                    vs.append(node[a + label[far]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

        held = None
        for b in batches:
            if not b.num_rows:
                continue
            c = [x.to_numpy(zero_copy_only=False) for x in b.columns]
            now = [c[0], c[1], np.stack(c[2:], 1).astype(np.int64).view(np.uint64)]
            if held:
                now = [np.concatenate(x) for x in zip(held, now)]
            last = int(np.flatnonzero(np.concatenate([[True], now[0][1:] != now[0][:-1]]))[-1])
            held = [x[last:] for x in now]
            if last:
                yield links(*(x[:last] for x in now))
        if held:
            yield links(*held)

    return run


def _simhash_links(nodes: DataFrame, similarity: float, part_rows: int) -> DataFrame:
    """nodes(node, s0..) to links (u, v) whose components hold, as far as the tables find them, all pairs of long fingerprints six deviations within `similarity`."""
    spark, s = nodes.sparkSession, [f"s{j}" for j in range(LONG)]
    bits, tables = lookup_tables(nodes.count(), similarity)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = nodes.select("node", *s).repartition(spread, F.xxhash64("node"))  # small rows that grow by the tables: more tasks than their bytes ask for
    limit, first_limit = bits_apart(similarity, 6), bits_apart(similarity, 6, 1)
    out = None
    for t in range(0, tables, TABLES):
        some = range(t, min(tables, t + TABLES))
        count = small.mapInArrow(_table_keys(bits, some, False), "key long").groupBy("key").agg(F.count("*").alias("n"))
        large = materialize(count.where(F.col("n") > part_rows).select(F.col("key").alias("hot"), F.ceil(2 * F.col("n") / part_rows).cast("int").alias("parts")))
        keyed = small.mapInArrow(_table_keys(bits, some, True), "key long, node long, " + ", ".join(f"{c} long" for c in s))
        placed = keyed.join(sized(large), keyed["key"] == F.col("hot"), "left").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
        bucket = F.when(F.col("parts").isNull(), F.array("key")).otherwise(F.expr("transform(sequence(0, coalesce(parts, 1) - 1), k -> xxhash64(key, least(own, bigint(k)), greatest(own, bigint(k))))"))
        rows = placed.select(F.explode(bucket).alias("bucket"), "node", *s)
        found = materialize(rows.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(trimmed(_bucket_stars(limit, first_limit)), "u long, v long").distinct())
        out = out.union(found) if out else found
    return out


def _candidate_sets(member):
    """Batches of (doc_id, text) to (node, h, set): the shingle sets of the documents whose id the bitmap holds."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .common import BITMAP_BITS

        bits = np.frombuffer(member.value, np.uint8)
        for b in batches:
            ids, hashes, sets = [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = i & ((1 << BITMAP_BITS) - 1)
                if bits[at >> 3] >> (at & 7) & 1 and len(sh := shingle_set(text)):
                    ids.append(i), hashes.append(set_name(sh)), sets.append(sh.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "h", "set"])

    return run


def near_copies(docs: DataFrame, similarity: float = 0.8, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs(doc_id, text) to (doc_id, component_id): documents alike by their shingles of five words.

    Found by SimHash: a fingerprint of 256 bits over the shingle set, which at a
    similarity of 0.8 differs in some 39 bits, wherever the edits are. Documents
    meet in tables keyed by sampled bits of it (lookup_tables), a bucket's pairs
    within six standard deviations of the distance expected at `similarity` link,
    and the groups are settled by exact Jaccard. Equal shingle sets are one node; sets
    of fewer than similarity / (1 - similarity) shingles are like none but their equals.
    Buckets beyond bucket_rows or PART_ROWS, and groups beyond bucket_rows or
    GROUP_SHINGLES, are cut into parts, and every pair of parts is compared in full.
    """
    s = [f"s{j}" for j in range(LONG)]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sets = [shingle_set(t) for t in b.column(1).to_pylist()]
            rows = [sketch(x) for x in sets]
            cols = [pa.array([r[j] for r in rows], pa.int64()) for j in range(LONG)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([set_name(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), *cols], ["doc_id", "h", "size", *s])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_rows = materialize(d.mapInArrow(trimmed(run), "doc_id long, h long, size long, " + ", ".join(f"{c} long" for c in s)))
    nodes = materialize(all_rows.groupBy("h").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("size", *s)]))
    least = similarity / (1 - similarity) - 1e-9 if similarity < 1 else float("inf")
    edges = _simhash_links(nodes.where(F.col("node").isNotNull() & (F.col("size") >= least)), similarity, min(bucket_rows, PART_ROWS))
    comp = components(_exact(d, nodes.select("node", "h", "size"), edges, similarity, bucket_rows))
    table = materialize(nodes.join(comp, "node", "left").select("h", F.coalesce("component", "node").alias("component_id")))
    return all_rows.select("doc_id", "h").join(table, "h").select("doc_id", "component_id")


def _exact(docs: DataFrame, nodes: DataFrame, edges: DataFrame, similarity: float, group_rows: int) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs with this Jaccard similarity within a component of `edges`.

    nodes: (node, h, size). A node's shingles go to its group once, or once for each part of a group that is too large for a task.
    """
    group = materialize(components(edges).select("node", F.col("component").alias("grp")))
    placed = materialize(nodes.join(group, "node"))
    parts = placed.groupBy("grp").agg(F.greatest(F.ceil(2 * F.count("*") / group_rows), F.ceil(2 * F.sum("size") / GROUP_SHINGLES)).alias("parts"), F.count("*").alias("n"), F.sum("size").alias("all"))
    parts = materialize(parts.select("grp", F.when((F.col("n") <= group_rows) & (F.col("all") <= GROUP_SHINGLES), F.lit(1)).otherwise(F.col("parts")).cast("int").alias("parts")))
    own = placed.join(parts, "grp").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
    pairs = own.select("node", "h", F.explode(F.expr("transform(sequence(0, parts - 1), k -> xxhash64(grp, least(own, bigint(k)), greatest(own, bigint(k))))")).alias("bucket"))
    member = docs.sparkSession.sparkContext.broadcast(bitmap(group.select("node"), "node"))
    sets = materialize(docs.where("doc_id IS NOT NULL").mapInArrow(trimmed(_candidate_sets(member)), "node long, h long, set array<long>").groupBy("node", "h").agg(F.first("set").alias("set")))
    rows = pairs.join(sets, ["node", "h"]).select("bucket", "node", "set")
    return materialize(rows.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(trimmed(_set_links(similarity)), "u long, v long").distinct())


def simhash_dedup(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs without the near copies of a document with a smaller doc_id; columns as they were.

    Rows that share a doc_id stay or go together; a row without a doc_id stays.
    """
    c = near_copies(docs, similarity)
    gone = materialize(c.where("doc_id <> component_id").select(F.col("doc_id").alias("__mr_gone")).distinct())
    return docs.join(sized(gone), docs["doc_id"] == F.col("__mr_gone"), "left_anti")
