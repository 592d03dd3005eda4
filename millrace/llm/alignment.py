"""Cross-tokenizer alignment: elementary intervals between the token ends of two tokenizers, and counts of linked ids over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, trimmed

#: Pairs whose counts go to every task: 2^20 of them, in 17 MB; the others, each rarer than these, are joined.
HELD_PAIRS = 1 << 20
#: Pairs that a task gathers before it adds them up, and bytes of text that it aligns at once.
TASK_PAIRS, ALIGN_BYTES = 1 << 22, 4 << 20

ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def byte_bpe(path: str):
    """(encode, bytes of each id, by id) of a tokenizers JSON file of a byte-level BPE; added tokens in a text are plain text.

    The file's vocabulary serves as merge ranks for tiktoken, which gives the library's ids (tested).
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    added = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in added}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    enc = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    table = [b""] * (max(spec["model"]["vocab"].values()) + 1)
    for s, i in ranks.items():
        table[i] = s
    return enc.encode_ordinary, table


def piece_bpe(path: str):
    """(encode, bytes of each id, by id) of a sentencepiece model, which puts a space before a text."""
    import re

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        code = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        table.append(bytes([int(code[1], 16)]) if code and sp.is_byte(i) else b"" if sp.is_control(i) else piece.replace("▁", " ").encode())
    return lambda text: sp.encode(text, num_threads=1), table


class Aligner:
    """Two tokenizers, and what their tokens of a batch of texts have in common."""

    def __init__(self, a_path: str, b_path: str):
        import numpy as np

        (self.encode_a, self.a), (self.encode_b, self.b) = byte_bpe(a_path), piece_bpe(b_path)
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.a, self.b))
        self.text = [f"{i}{end}" for i in range(max(len(self.a), len(self.b))) for end in ",|;"]

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """Both tokenizers' ids of space+text; none where the text is null or empty or either's bytes are not those."""
        if not text:
            return [], []
        a, b, want = self.encode_a(" " + text), self.encode_b(text), b" " + text.encode()
        if b"".join(map(self.a.__getitem__, a)) != want or b"".join(map(self.b.__getitem__, b)) != want:
            return [], []
        return a, b

    def align(self, texts: list[str | None]) -> dict:
        """Numpy columns of all tokens, links and groups of the texts, one after the other; `doc` is the place in texts.

        Ends count on from text to text, so that one merge serves all: an interval
        between neighbouring ends of either side lies in one token of each, which
        are a link; where both sides end a group closes.
        """
        from itertools import chain

        import numpy as np

        got = [self.tokens(t) for t in texts]
        count_a, count_b = (np.array([len(g[k]) for g in got], np.int64) for k in (0, 1))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(g[k] for g in got), np.int64) for k in (0, 1))
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        cuts = np.union1d(ends_a, ends_b)
        link_a, link_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        shared = cuts[(ends_a[link_a] == cuts) & (ends_b[link_b] == cuts)]
        doc_a = np.repeat(np.arange(len(texts)), count_a)
        last_a = np.searchsorted(ends_a, shared)
        return {
            "count_a": count_a, "count_b": count_b, "ids_a": ids_a, "ids_b": ids_b, "ends_a": ends_a, "ends_b": ends_b, "cuts": cuts, "shared": shared, "link_a": link_a, "link_b": link_b,
            "group_a": np.searchsorted(shared, ends_a), "group_b": np.searchsorted(shared, ends_b), "doc_a": doc_a, "doc_link": doc_a[link_a], "doc_group": doc_a[last_a],
        }

    def written(self, x: dict, n: int) -> list[str]:
        """For each of n texts `a1,a2|b1;a3|b2,b3`: the ids of its groups."""
        import numpy as np

        def ends(group):
            """Whether a token is the last of its side of a group."""
            return np.append(group[1:] != group[:-1], True)[: len(group)].astype(np.int64)

        codes = np.concatenate([3 * x["ids_a"] + ends(x["group_a"]), 3 * x["ids_b"] + 2 * ends(x["group_b"])])
        order = np.argsort(np.concatenate([2 * x["group_a"], 2 * x["group_b"] + 1]), kind="stable")
        parts = list(map(self.text.__getitem__, codes[order].tolist()))
        stops = np.cumsum(x["count_a"] + x["count_b"]).tolist()
        return ["".join(parts[s:e])[:-1] for s, e in zip([0, *stops], stops)]


def _parts(texts: list):
    """Slices of at most about ALIGN_BYTES of text, a text at least."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > ALIGN_BYTES:
            yield first, k
            first, size = k, 0
        size += len(t or "")
    if first < len(texts):
        yield first, len(texts)


def _pair_type(a_path: str, b_path: str):
    """(numbers of B's ids, numpy type that holds a pair as a * B + b)."""
    n_a, n_b = len(byte_bpe(a_path)[1]), len(piece_bpe(b_path)[1])
    return n_b, "<i4" if n_a * n_b < 1 << 31 else "<i8"


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """docs(doc_id, text) to a row for each row: ALIGNED, with a document's different linked id pairs and how often each is linked, as numpy bytes."""
    n_b, kind = _pair_type(a_path, b_path)

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        work, row = Aligner(a_path, b_path), TaskContext.get().partitionId() << 33
        wide = len(work.a) * n_b
        for b in batches:
            all_ids, all_texts = b.column(0), b.column(1).to_pylist()
            for s, e in _parts(all_texts):
                texts, n = all_texts[s:e], e - s
                x = work.align(texts)
                key, times = np.unique(x["doc_link"] * wide + x["ids_a"][x["link_a"]] * n_b + x["ids_b"][x["link_b"]], return_counts=True)
                doc, pair = np.divmod(key, wide)
                stops = np.searchsorted(doc, np.arange(n + 1)).tolist()
                pair, times = pair.astype(kind), times.astype("<i4")
                count = lambda c: np.bincount(c, minlength=n).astype(np.int64)
                sha = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in work.written(x, n)]
                blob = lambda v: pa.array([v[i:j].tobytes() for i, j in zip(stops, stops[1:])], pa.binary())
                cols = [np.arange(row, row + n), all_ids.slice(s, n), x["count_a"], x["count_b"], count(x["doc_group"]), count(x["doc_link"])]
                cols = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(sha, pa.string()), blob(pair), blob(times)], [f.split()[0] for f in ALIGNED.split(", ")])
                row += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), ALIGNED)


def _pair_counts(kind: str):
    """Over (pairs): (pair, n), how many documents of the task have it, added up whenever a task has gathered TASK_PAIRS."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        pairs, counts, raw = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def summed():
            p = np.concatenate([pairs, *raw])
            n = np.concatenate([counts, np.ones(len(p) - len(pairs), np.int64)])
            key, at = np.unique(p, return_inverse=True)
            return key, np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)

        def out():
            for k in range(0, len(pairs), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[k : k + (1 << 16)]), pa.array(counts[k : k + (1 << 16)])], ["pair", "n"])

        for b in batches:
            raw.append(np.frombuffer(b"".join(b.column(0).to_pylist()), kind).astype(np.int64))
            if sum(map(len, raw)) > TASK_PAIRS:
                pairs, counts = summed()
                raw.clear()
                if len(pairs) > TASK_PAIRS:  # bounded memory: what was gathered goes out
                    yield from out()
                    pairs, counts = pairs[:0], counts[:0]
        pairs, counts = summed()
        yield from out()

    return run


def pair_counts(table: DataFrame, n_b: int, kind: str) -> DataFrame:
    """aligned() rows to (pair, n, best): in how many documents a pair is linked, and whether no pair of its A id is in more."""
    counts = materialize(table.select("pairs").mapInArrow(trimmed(_pair_counts(kind)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    a = F.expr(f"pair div {n_b}").alias("a")
    most = F.broadcast(counts.groupBy(a).agg(F.max("n").alias("most")))  # a row for each id of A's vocabulary
    return materialize(counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _held(counts: DataFrame, held: int):
    """(pairs in order, counts, best) of all pairs in at least t documents, t the least power of two for which these are at most `held`; and t."""
    import numpy as np

    of = {r["k"]: r["of"] for r in counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("of")).collect()}  # at most 64 rows
    k, total = max(of, default=-1) + 1, 0
    while k > 0 and total + of.get(k - 1, 0) <= held:
        k -= 1
        total += of.get(k, 0)
    got = counts.where(F.col("n") >= 1 << k).toArrow().sort_by("pair")
    return tuple(np.ascontiguousarray(got[c].to_numpy()) for c in ("pair", "n", "best")), 1 << k


def _scored(shared, kind: str):
    """Over ALIGNED: sums over the links whose pairs are held, and the other pairs with their links."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, counts, best = shared.value
        for b in batches:
            n, blobs = b.num_rows, b.column(1).to_pylist()
            pairs = np.frombuffer(b"".join(blobs), kind).astype(np.int64)
            times = np.frombuffer(b"".join(b.column(2).to_pylist()), "<i4").astype(np.int64)
            doc = np.repeat(np.arange(n), [len(x) // np.dtype(kind).itemsize for x in blobs])
            at = np.minimum(np.searchsorted(held, pairs), max(0, len(held) - 1))
            known = held[at] == pairs if len(held) else np.zeros(len(pairs), bool)
            got = np.zeros((2, n), np.int64)
            np.add.at(got[0], doc[known], times[known] * counts[at[known]])
            np.add.at(got[1], doc[known], times[known] * best[at[known]])
            rest = ~known
            offsets = pa.array(np.searchsorted(doc[rest], np.arange(n + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v[rest])) for v in (pairs, times)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got[0]), pa.array(got[1]), *lists], ["row", "count_sum", "n_best", "pairs", "times"])

    return run


def alignment(docs: DataFrame, a_path: str, b_path: str, held: int = HELD_PAIRS) -> DataFrame:
    """docs(doc_id, text) to a row for each row: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    A link is a pair of an A and a B token of a text that share bytes; groups end
    where both do. A pair of ids counts the rows in which it is linked. n_best are
    the links whose pair no other pair of the same A id outnumbers, count_sum adds
    up the links' counts. A text without tokens (null, empty, or one that a
    tokenizer does not give back) has zeros and ''. Rows may repeat ids or have
    none; no rows give none. Other columns are not read.
    """
    n_b, kind = _pair_type(a_path, b_path)
    table = materialize(aligned(docs, a_path, b_path))
    counts = pair_counts(table, n_b, kind)
    common, _ = _held(counts, held)
    shared = docs.sparkSession.sparkContext.broadcast(common)
    sums = materialize(table.select("row", "pairs", "times").mapInArrow(trimmed(_scored(shared, kind)), "row long, count_sum long, n_best long, pairs array<long>, times array<long>"))
    rest = sums.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    rest = rest.join(counts, F.col("pairs") == F.col("pair")).groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("better"))
    both = sums.select("row", "count_sum", "n_best").join(rest, "row", "left")
    both = both.select("row", (F.col("n_best") + F.coalesce("better", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"))
    out = table.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(both, "row")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def token_groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """docs(doc_id, text) to its groups: (doc_id, group, start, end, a_ids, b_ids), byte offsets in space+text, groups from 0."""
    names = "doc_id long, group long, start long, end long, a_ids array<int>, b_ids array<int>"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        work = Aligner(a_path, b_path)
        for b in batches:
            all_ids, all_texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for s, e in _parts(all_texts):
                x = work.align(all_texts[s:e])
                doc, ends = x["doc_group"], x["shared"]
                first = np.searchsorted(doc, doc)
                starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
                base = starts[first] if len(ends) else starts
                lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(x[f"group_{k}"], np.arange(len(ends) + 1)), pa.int32()), pa.array(x[f"ids_{k}"], pa.int32())) for k in "ab"]
                ids = pa.array([all_ids[s + k] for k in doc.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, pa.int64()) for v in (np.arange(len(doc)) - first, starts - base, ends - base)), *lists], [f.split()[0] for f in names.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), names)


def group_products(groups: DataFrame) -> DataFrame:
    """token_groups() to every pair of an A and a B id of a group: (doc_id, group, a_id, b_id); groups are some tokens long."""
    return groups.select("doc_id", "group", F.explode("a_ids").alias("a_id"), "b_ids").select("doc_id", "group", "a_id", F.explode("b_ids").alias("b_id"))
