"""Tables in the shared folder, and connected components over them."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: whole texts may be long, so batches stay short.
BATCH_ROWS = 1024


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once a session, wherever the driver found it."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    f = os.path.join(folder, n)
                    z.write(f, os.path.relpath(f, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._millrace_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`; short Arrow batches from now on."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Unset: a temporary folder in local mode, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Spark deletes a query's shuffle files when it ends, not when the driver's heap is next collected.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of queries run inside go when each ends: for those whose result is kept elsewhere. The setting is put back."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def collected(spark: SparkSession) -> None:
    """Give the driver's unused memory back, Python's first, as it holds references into the JVM: around a large result on the driver."""
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()


def trimmed(run):
    """run, over Arrow batches, whose worker gives its free memory back to the system at the end of a task: workers stay, beside those of other stages."""

    def out(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
            if trim:
                trim(0)

    return out


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it: cuts lineage, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/millrace/{uuid.uuid4().hex}"
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a result of materialize()."""
    spark, path = df.sparkSession, getattr(df, "_millrace_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _local_forest(batches):
    """Within a task's edges, the star forest with the same components: at most a row a node."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = parent[x]
        return x

    def drained():
        a = list(parent)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([root(x) for x in a], pa.int64())], ["u", "v"])

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
        if len(parent) > 2_000_000:  # bounded memory: what was gathered goes out, later rows start anew
            yield drained()
            parent.clear()
    if parent:
        yield drained()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Edges (u, v; long) to (node, component): the smallest node reachable, for every node with an edge.

    Edges are first contracted within each task, then by alternating star
    contraction: every round links each node's larger neighbours, then its
    smaller ones, to the smallest. Minima are partial aggregates, so a hub costs
    one row a task; the join back reads written tables, so that skewed keys split.
    Null ends are dropped; no edges give no rows.
    """
    e = edges.select(F.col(edges.columns[0]).cast("long").alias("u"), F.col(edges.columns[1]).cast("long").alias("v")).where("u <> v")
    e = materialize(e.mapInArrow(trimmed(_local_forest), "u long, v long").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        mins = materialize(both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m")))
        # larger neighbours of k = v, the smaller end, go to m
        large = materialize(e.join(mins, e.v == mins.k).select("u", F.col("m").alias("v")).where("u <> v").union(mins.where("k <> m").select("k", "m")).distinct())
        discard(mins)
        low = materialize(large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")))
        small = large.join(low, large.u == low.k).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("k", "m")).distinct()
        nxt = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        for old in (e, large, low):
            discard(old)
        e = nxt
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        state = now
    raise RuntimeError("components did not settle")


#: A table may be broadcast if it is written in at most so many bytes, and has so many values, whatever the input's size.
BROADCAST_BYTES, BROADCAST_VALUES = 4 << 20, 1 << 20


def written_bytes(df: DataFrame) -> int:
    """Bytes of the table behind a result of materialize()."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(df._millrace_path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def sized(df: DataFrame, limit: int = BROADCAST_BYTES, values: int = BROADCAST_VALUES) -> DataFrame:
    """A materialised table, hinted for broadcast if it is small as written and, by rows and columns, in memory; else joined by a shuffle."""
    small = written_bytes(df) <= limit and df.count() * len(df.columns) <= values
    return F.broadcast(df) if small else df


#: Bits of a membership bitmap: 8 MB, at most 2^20 rows to the driver.
BITMAP_BITS = 26


def bitmap(df: DataFrame, column: str) -> bytes:
    """A bitmap of fixed size over a column of hashes: a set bit may be another value's, a clear one is certain."""
    import numpy as np

    rows = df.selectExpr(f"(({column} & {(1 << BITMAP_BITS) - 1}L) >> 6) AS w", f"shiftleft(1L, int({column} & 63L)) AS m")
    with freed_shuffles(df.sparkSession):
        got = rows.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    words = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    words[got["w"].to_numpy()] = got["m"].to_numpy()
    return words.tobytes()
