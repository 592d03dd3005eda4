"""Sequence packing: shortest-pack-first over the length histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize, trimmed

#: Pieces of one length that one task ranks, about; there are as many buckets as that asks for.
BUCKET_ROWS = 100_000


def tokenizer(path: str):
    """encode(texts) -> lists of ids for a tokenizers JSON file of a byte-level BPE, as the library gives without its own special tokens.

    The file's own vocabulary is read as merge ranks into tiktoken, which gives
    the same ids (tests hold both against each other) in a quarter of the time.
    Added tokens that stand in a text are found first, the leftmost and of those
    the first in the file, and what is between them is encoded by itself.
    """
    import json
    import re

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    codes = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in codes} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in codes)}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that look at what is around them are not supported")
    ranks = {bytes(byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in added}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    enc = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    parted = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

    def encode(text):
        if not parted or not parted.search(text):
            return enc.encode_ordinary(text)
        return [i for part in parted.split(text) if part for i in ([added[part]] if part in added else enc.encode_ordinary(part))]

    return lambda texts: [encode(t) for t in texts]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) to pieces of at most `capacity` ids: (doc_id, start, length, ids_crc32, doc_tokens[, ids]).

    A text's ids are followed by end_id; longer documents are cut at multiples
    of capacity. Null texts count as empty, and give the one id end_id.
    """
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if keep_ids else "")

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        encode = tokenizer(tokenizer_path)
        for b in batches:
            out = [[] for _ in range(6)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array([*encode([text or ""])[0], end_id], dtype="<u4")
                for s in range(0, len(ids), capacity):
                    part = ids[s : s + capacity]
                    for col, v in zip(out, (doc, s, len(part), zlib.crc32(part.tobytes()), len(ids), part.tolist() if keep_ids else None)):
                        col.append(v)
            cols = [pa.array(c, pa.int64()) for c in out[:5]] + ([pa.array(out[5], pa.list_(pa.int32()))] if keep_ids else [])
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(cols)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), fields)


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Shortest-pack-first: (sequences, [(length, times), ...]) patterns that use every counted length once.

    Lengths go longest first, each to the emptiest open pack that has room, or to a
    new one. Packs with the same content are one pattern with a count, so the work
    depends on the number of lengths, not of documents.
    """
    open_packs: dict[int, list[list]] = {}  # free room -> patterns [count, content]
    done: list[list] = []

    def put(count, content, free):
        (done if not free else open_packs.setdefault(free, [])).append([count, content])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            free = max(open_packs, default=0)
            if free < length:
                each = capacity // length  # only new packs have room: fill them with this length
                full, rest = divmod(left, each)
                if full:
                    put(full, [(length, each)], capacity - each * length)
                if rest:
                    put(1, [(length, rest)], capacity - rest * length)
                break
            groups = open_packs[free]
            count, content = groups.pop()
            if not groups:
                del open_packs[free]
            take = min(left, count)
            if take < count:
                put(count - take, content, free)
            last = [(length, content[-1][1] + 1)] if content[-1][0] == length else [content[-1], (length, 1)]
            put(take, content[:-1] + last, free - length)
            left -= take
    return [(c, p) for c, p in done + [x for g in open_packs.values() for x in g]]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, ...]]:
    """(length, lo, hi, times, sequence, offset): ranks lo to hi - 1 of a length go `times` each to sequences from `sequence` on."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for count, content in patterns:
        offset = 0
        for length, times in content:
            lo = used.get(length, 0)
            used[length] = lo + count * times
            out.append((length, lo, lo + count * times, times, sequence, offset))
            offset += length * times
        sequence += count
    return out


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset to a materialised table of pieces (doc_id, start, length, ...).

    The histogram has at most `capacity` rows and alone goes to the driver; the
    patterns' slots, bounded by the capacity too, are broadcast. A piece's rank
    among those of its length is the sum of the buckets before its own, from
    counts, plus its place in the bucket, so that no length is sorted in one task.
    """
    spark = pieces.sparkSession
    buckets = max(256, pieces.count() // BUCKET_ROWS)
    p = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    counts = p.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    before = materialize(counts.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"), "n"))
    histogram = {r[0]: r[1] for r in before.groupBy("length").agg(F.sum("n")).collect()}
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("length", "lo", "hi", "times", "first", "at")])
    table = spark.createDataFrame(slots(pack_histogram(histogram, capacity)), schema)
    # rows that tie in all three are the same piece of the same text, so any order gives the same result
    place = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", *[c for c in ("ids_crc32", "doc_tokens") if c in pieces.columns])
    p = p.withColumn("_place", F.row_number().over(place) - 1)
    p = p.join(before.drop("n"), ["length", "_bucket"])
    p = p.withColumn("_rank", F.col("_before") + F.col("_place"))
    s = F.broadcast(table.withColumnRenamed("length", "_length"))
    p = p.join(s, (p.length == F.col("_length")) & (p._rank >= F.col("lo")) & (p._rank < F.col("hi")))
    k = F.col("_rank") - F.col("lo")
    return p.select(*pieces.columns, (F.col("first") + F.floor(k / F.col("times"))).cast("long").alias("sequence_id"), (F.col("at") + (k % F.col("times")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """All of docs(doc_id, text) in sequences of at most `capacity` ids: a row for each piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Empty tables give no rows; repeated rows are packed each.
    """
    return pack(materialize(token_pieces(docs, tokenizer_path, capacity, end_id)), capacity)
