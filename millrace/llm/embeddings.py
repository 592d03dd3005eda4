"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, sized

#: Passes, hash bits of each, rows of a block, and rows after a block that it is compared with too.
PASSES, BITS, BLOCK, WINDOW = 12, 60, 1024, 512


def _unit(vectors):
    """Vectors of one dimension, none of them zero, to unit length in doubles; scaled by a power of two first, so that no square leaves the range."""
    import numpy as np

    x = np.array(vectors, np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(passes: int):
    """Batches of (node, label, v) to a row a pass: the signs of BITS random projections as one sortable long."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        planes = {}
        for b in batches:
            vs = b.column(2).to_pylist()
            out = {}
            for dim in {len(v) for v in vs}:
                at = [i for i, v in enumerate(vs) if len(v) == dim]
                x = _unit([vs[i] for i in at])
                for p in range(passes):
                    if (dim, p) not in planes:
                        planes[dim, p] = np.random.default_rng([dim, p]).normal(size=(dim, BITS))
                    bit = (x @ planes[dim, p] > 0).astype(np.int64)
                    for i, k in zip(at, (bit << np.arange(BITS - 1, -1, -1)).sum(1).tolist()):
                        out[i, p] = k
            rows = np.repeat(np.arange(len(vs)), passes)
            keys = [out[i, p] for i in range(len(vs)) for p in range(passes)]
            t = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(passes, dtype=np.int32), len(vs))), pa.array(keys, pa.int64()), *t.columns], ["pass", "key", "node", "label", "v"])

    return run


def _numbered(batches):
    """Add the partition's number and the row's number in it."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), part, np.int32)), pa.array(np.arange(n, n + len(b)))], [*b.schema.names, "part", "at"])
        n += len(b)


def _compare(cosine: float):
    """Rows (block, own, label, node, v) sorted by block to a forest with the components of the pairs of a block's own rows with all its rows."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def forest(rows):
            u, v = [], []
            groups: dict = {}
            for r in rows:
                groups.setdefault((r[2], len(r[4])), []).append(r)
            for own in groups.values():
                x = _unit([r[4] for r in own])
                core = np.flatnonzero([r[1] for r in own])
                ids, near = [r[3] for r in own], np.arange(len(own))
                for s in range(0, len(core), 256):
                    part = core[s : s + 256]
                    hits = x[part] @ x.T >= cosine
                    for i, hit in zip(part[hits.sum(1) > 1], hits[hits.sum(1) > 1]):
                        at = np.flatnonzero(hit)
                        for label in np.unique(near[at]):
                            if label != near[i]:
                                j = at[near[at] == label][0]
                                u.append(max(ids[i], ids[j])), v.append(min(ids[i], ids[j]))
                                near[near == label] = near[i]
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        held: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0][0] != row[0]:
                    yield forest(held)
                    held = []
                held.append(row)
        if held:
            yield forest(held)

    return run


def _counted_links(cosine: float):
    """Rows (bucket, part, node, copies, v) sorted by bucket, of one or two parts of a component, to (node, more): the copies that each node links with."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def counts(rows):
            x = _unit([r[4] for r in rows])
            part, copies = np.array([r[1] for r in rows]), np.array([r[3] for r in rows], np.int64)
            more = np.zeros(len(rows), np.int64)
            one = np.flatnonzero(part == part.min())
            other = np.flatnonzero(part != part.min())
            for s in range(0, len(one), 256):
                i = one[s : s + 256]
                if len(other):
                    hit = x[i] @ x[other].T >= cosine
                    more[i] += hit @ copies[other]
                    more[other] += copies[i] @ hit
                else:
                    hit = x[i] @ x.T >= cosine
                    hit[np.arange(len(i)), i] = False
                    more[i] += hit @ copies
            return pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows], pa.int64()), pa.array(more)], ["node", "more"])

        held: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0][0] != row[0]:
                    if held[0][5] or held[0][1] != held[-1][1]:
                        yield counts(held)
                    held = []
                held.append(row)
        if held and (held[0][5] or held[0][1] != held[-1][1]):
            yield counts(held)

    return run


def link_counts(classes: DataFrame, comp: DataFrame, cosine: float, part_rows: int = BLOCK) -> DataFrame:
    """classes(node, copies, v) and comp(node, component) to (node, more): with how many copies of other nodes of its component each node links.

    Every component is compared in full: it is cut into parts of about part_rows
    nodes, and a task compares two parts, or one with itself. What goes out is a
    count a node and task, no pairs.
    """
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = comp.groupBy("component").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    own = materialize(comp.join(parts, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))
    meets = own.select("node", "component", "part", F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
    meets = meets.select("node", "part", F.xxhash64("component", F.least("part", "other"), F.greatest("part", "other")).alias("bucket"), (F.col("part") == F.col("other")).alias("self"))
    rows = meets.join(classes, "node").select("bucket", "part", "node", "copies", "v", "self")
    got = rows.repartition(n, "bucket").sortWithinPartitions("bucket", "part").mapInArrow(_counted_links(cosine), "node long, more long")
    return materialize(got.groupBy("node").agg(F.sum("more").alias("more")))


def links(vectors: DataFrame, cosine: float = 0.98, passes: int = PASSES) -> DataFrame:
    """vectors(node, label, v), all different, to distinct (u, v), u > v: a forest with the components of the pairs of a label found with a cosine of `cosine` or more.

    Every pass sorts all vectors by label, dimension and hash. A row's number in
    that order is its place in its sorted partition plus the rows of those before,
    of which only the counts reach the driver. Blocks of BLOCK consecutive rows, with the
    WINDOW rows after them, are compared in full.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["v"].dataType.simpleString()
    keyed = vectors.mapInArrow(_keys(passes), f"pass int, key long, node long, label int, v {kind}")
    order = ["pass", "label", F.size("v"), "key", "node"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = materialize(keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_numbered, f"pass int, key long, node long, label int, v {kind}, part int, at long"))
    total, rows = 0, []
    for r in sorted_.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row a partition
        rows.append((r["part"], total))
        total += r["n"]
    first = spark.createDataFrame(rows, "part int, first long")
    rank = sorted_.join(F.broadcast(first), "part").withColumn("rank", F.col("first") + F.col("at"))
    block = F.floor(F.col("rank") / BLOCK).cast("long")
    goes = F.when(F.col("rank") % BLOCK < WINDOW, F.array(F.struct(block.alias("block"), F.lit(True).alias("own")), F.struct((block - 1).alias("block"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(block.alias("block"), F.lit(True).alias("own"))))
    placed = rank.select(F.explode(goes).alias("g"), "label", "node", "v").select("g.block", "g.own", "label", "node", "v")
    return materialize(placed.repartition(n, "block").sortWithinPartitions("block").mapInArrow(_compare(cosine), "u long, v long").distinct())


def _class():
    """The key of a row's label and vector; vectors that share one are told apart."""
    return F.xxhash64("label", "v")


def near_vectors(embeddings: DataFrame, cosine: float = 0.98, passes: int = PASSES) -> DataFrame:
    """embeddings(vec_id, embedding, label) to (vec_id, n_links, component_id, kept), a row for each.

    Only vectors of equal labels are compared, in double precision whatever their
    type. Vectors that are null, zero or hold null or non-finite components, and
    those with a null label, link with nothing. Copies are one node and link with
    each other; a node's links count with its copies, so a group of copies costs no
    pairs. The passes only have to connect a group: its links are counted by
    comparing all of its vectors.
    """
    single = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"  # doubles of them are the same numbers
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"), F.col("label").cast("int").alias("label"))
    fine = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    e = e.withColumn("class", F.when(F.coalesce(fine, F.lit(False)), _class()))
    classes = e.where("class IS NOT NULL AND vec_id IS NOT NULL").groupBy("class", "label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    classes = materialize(classes)
    comp = materialize(components(links(classes.select("node", "label", "v"), cosine, passes)))
    more = link_counts(classes.select("node", "copies", "v"), comp, cosine)
    shared = classes.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class", F.lit(True).alias("shared"))
    told = classes.join(sized(materialize(shared)), "class", "left").select("class", "node", "copies", *[F.when(F.col("shared"), F.col(c)).alias(f"_{c}") for c in ("label", "v")])
    found = told.join(more, "node", "left").join(comp, "node", "left")
    found = materialize(found.select(F.col("class").alias("_class"), "_label", "_v", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    same = (F.col("class") == F.col("_class")) & (F.col("_v").isNull() | (F.col("_v") == F.col("v")) & (F.col("_label") == F.col("label")))
    out = e.join(sized(found), same, "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
