"""Live sketches with keyed state against the same sketches over the whole stream, with a restart between batches."""

import random

from pyspark.sql import functions as F

from millrace.operators import sketches
from millrace.streaming.live import bloom_stream, reservoir_stream


def written(spark, path, rows, schema, parts):
    """A folder for each batch of 60 events, so that a trigger reads one of several files."""
    df = spark.createDataFrame(rows, schema)
    for k in range(parts):
        df.where(f"batch = {k}").select("seq", "user").repartition(2).write.parquet(f"{path}/batch={k}")
    return df


def test_bloom_state_equals_the_whole_stream_over_ten_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(3)
    events = [(k + 1, k // 60, None if k % 97 == 0 else "hot" if k % 3 == 0 else f"u{rng.randrange(150)}") for k in range(600)]
    df = spark.createDataFrame(events, "seq long, batch long, user string")
    want = {r["batch"]: (r["n_new"], r["n_false"], r["fpr"]) for r in sketches.bloom_fpr(df.where("user is not null"), 997, 6).collect()}
    assert sum(w[1] for w in want.values()) > 5
    got, rows_read = {}, []
    source = str(tmp_path / "in")

    def run(batches):
        for k in batches:
            df.where(f"batch = {k}").select("seq", "user").coalesce(1).write.parquet(f"{tmp_path}/one{k}")
            (part,) = (tmp_path / f"one{k}").glob("*.parquet")
            (tmp_path / "in").mkdir(exist_ok=True)
            part.rename(tmp_path / "in" / f"{k:02}.parquet")
        stream = spark.readStream.schema("seq long, user string").option("maxFilesPerTrigger", 1).parquet(source)
        q = bloom_stream(stream, str(tmp_path / "cp"), lambda out, b: got.update({b: tuple(out.first())[1:]}), 997, 6)
        q.processAllAvailable()
        rows_read.extend(p["numInputRows"] for p in q.recentProgress if p["numInputRows"])
        q.stop()

    run(range(6))
    assert got == {k: want[k] for k in range(6)}
    run(range(6, 10))
    assert got == want and rows_read == [60] * 10  # no batch reads history


def test_reservoir_state_equals_the_whole_stream_and_goes_on_after_a_restart(spark, tmp_path):
    rng = random.Random(4)
    events = [(k + 1, rng.randrange(50)) for k in range(1500)]
    df = spark.createDataFrame(events, "seq long, user long")
    want = sorted(map(tuple, sketches.reservoir_snapshots(df, 20, 50, (0, 7, 19)).collect()))
    got = []
    cuts = [0, 30, 430, 450, 1000, 1500]
    for start in (0, 3):
        for k in range(start, min(start + 3, 5)):
            df.where(f"seq > {cuts[k]} and seq <= {cuts[k + 1]}").repartition(3).write.parquet(f"{tmp_path}/in/part={k}")
        stream = spark.readStream.schema("seq long, user long, part int").parquet(str(tmp_path / "in")).select("seq", "user")
        q = reservoir_stream(stream, 20, 50, (0, 7, 19)).writeStream.foreachBatch(lambda out, b: got.extend(map(tuple, out.collect()))).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(got) == want and len(want) > 60


def test_registers_equal_the_hashes_one_by_one(spark):
    rng = random.Random(6)
    rows = [(k % 7, rng.randrange(-5, 300)) for k in range(900)] + [(7, None), (8, 0), (8, None)]
    df = spark.createDataFrame(rows, "batch long, user long").repartition(5)
    got = {r["batch"]: (r["n_distinct"], r["estimate"]) for r in sketches.fm_distinct(df, 60, 4, 4096).collect()}
    want = {}
    for b in range(9):
        users = {u for k, u in rows if k == b}
        zeros = []
        for i in range(60):
            p, q = (i * 7919 + 104729) % 99991 + 1, (i * 15485863 + 32452843) % 98387 + 1
            hs = [(p * (u * 2654435 + 97) + q) % 4096 for u in users if u is not None]
            zeros.append(max((len(f"{h:b}") - len(f"{h:b}".rstrip("0")) for h in hs), default=None))
        means = sorted(2 ** (sum(zeros[g : g + 15]) / 15) for g in range(0, 60, 15)) if None not in zeros else None
        want[b] = (len(users), int((means[1] + means[2]) / 2) if means else None)
    assert got == want
    folded = df.where("user is not null").select("batch", F.col("user").alias("x")).repartition(5).mapInArrow(sketches._folded(60, 4096), "batch long, low binary")
    assert folded.count() <= 5 * 8  # a row for each task and batch
    assert sketches.fm_distinct(df.limit(0)).count() == 0
