"""Language-model scores: prediction by partial matching over bytes, and a word unigram as the base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Byte that stands before a text and ends it; UTF-8 has none.
END = 255
#: Bytes of the longest context. Every context of the training texts is a node of the trie.
ORDER = 5
#: Slots (2 to this power) of the table in which every task counts pairs, and of those of common pairs and words sent to all tasks.
SLOTS, PAIR_SLOTS, WORD_SLOTS = 21, 22, 20
#: Bytes of a text that are looked at together.
STEP = 1 << 20


def _bytes(text):
    return (text or "").encode("utf-8", "replace").lower()


def _pairs(data: bytes, step: int = STEP):
    """The pairs of a text, by parts: for every byte and the END after the last one number, of the ORDER bytes before it and itself."""
    import numpy as np

    padded = bytes([END] * ORDER) + data + bytes([END])
    for s in range(0, len(data) + 1, step):
        n = min(step, len(data) + 1 - s)
        b = np.frombuffer(padded, np.uint8, n + ORDER, s).astype(np.int64)
        key = b[:n]
        for j in range(1, ORDER + 1):
            key = (key << 8) | b[j : j + n]
        yield key


def _slots(keys, slots: int = SLOTS):
    """The slot of each key: its remainder by an odd number (a prime for 21 bits)."""
    return keys % ((1 << slots) - 9)


def _common(table: DataFrame, column: str, slots: int):
    """table(key, n, column) to (slots, keys, values) arrays: the commonest key of each slot, so at most 2 ** slots rows."""
    slot = F.pmod("key", F.lit((1 << slots) - 9)).alias("slot")
    t = table.groupBy(slot).agg(F.max_by(F.struct("key", column), F.struct("n", "key")).alias("x")).select(F.col("slot").cast("int"), "x.key", F.col(f"x.{column}").alias("value")).toArrow()
    return tuple(t[c].to_numpy() for c in ("slot", "key", "value"))


class _Table:
    """A lookup by slot."""

    def __init__(self, slots: int, taken, keys, values):
        import numpy as np

        self.slots, self.key, self.value = slots, np.full(1 << slots, -1), np.zeros(1 << slots, np.float32 if values.dtype.kind == "f" else np.int64)
        self.held = np.zeros(1 << slots, bool)
        self.key[taken], self.value[taken], self.held[taken] = keys, values, True

    def find(self, keys):
        """(values of the keys that are here, which keys are)."""
        at = _slots(keys, self.slots)
        hit = (self.key[at] == keys) & self.held[at]
        return self.value[at[hit]], hit


class _Counter:
    """Counts of pairs: those that come first to their slot in a table, the others by sorting."""

    def __init__(self):
        import numpy as np

        self.key, self.n = np.full(1 << SLOTS, -1), np.zeros(1 << SLOTS, np.int64)
        self.rest, self.size = [], 0

    def add(self, keys):
        import numpy as np

        at = _slots(keys)
        new = self.key[at] < 0
        self.key[at[new]] = keys[new]
        hit = self.key[at] == keys
        self.n += np.bincount(at[hit], minlength=1 << SLOTS)
        if not hit.all():
            self.rest.append(np.unique(keys[~hit], return_counts=True))
            self.size += len(self.rest[-1][0])

    def drained(self):
        """(keys, counts) of the pairs outside the table, which are then forgotten."""
        import numpy as np

        keys, at = np.unique(np.concatenate([np.empty(0, np.int64), *[k for k, _ in self.rest]]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([np.empty(0), *[n for _, n in self.rest]]), minlength=len(keys)).astype(np.int64)
        self.rest, self.size = [], 0
        return keys, n


def _split(data: bytes, step: int = STEP):
    """Words of a text, by parts that end at white space."""
    import re

    s = 0
    while s < len(data):
        m = re.compile(rb"[\x20\x09-\x0D]").search(data, s + step)
        e = m.start() if m else len(data)
        yield data[s:e].split()
        s = e


def _word_hash(words):
    import numpy as np
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w, 5) for w in words], np.uint64).view(np.int64)


def _counted(batches):
    """Batches of (text, held out) to partial counts (kind, key, n). Kind 0: word by hash, 1: pair, 2: texts, 3: pair of a held-out text, whose words don't count."""
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    words, texts = Counter(), 0
    pairs = {1: _Counter()}

    def row(kind, key, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["kind", "key", "n"])

    for b in batches:
        held_keys = {1: [], 3: []}
        for t, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            data = _bytes(t)
            if not held:
                for part in _split(data):
                    words.update(part)
                texts += 1
            own = held_keys[3 if held else 1]
            for keys in _pairs(data):
                own.append(keys)
                if len(keys) == STEP:
                    pairs.setdefault(3 if held else 1, _Counter()).add(own.pop())
        for kind, own in held_keys.items():
            if own:
                pairs.setdefault(kind, _Counter()).add(np.concatenate(own))
        if len(words) > 1 << 20:  # bounded memory: what was gathered goes out
            yield row(0, _word_hash(words), list(words.values()))
            words.clear()
        for kind, c in pairs.items():
            if c.size > 1 << 21:
                yield row(kind, *c.drained())
    if words:
        yield row(0, _word_hash(words), list(words.values()))
    for kind, c in pairs.items():
        yield row(kind, *c.drained())
        yield row(kind, c.key[c.n > 0], c.n[c.n > 0])
    yield row(2, [0], [texts])


def mixed_row(levels):
    """Byte probabilities from counts of the longest context to those of none: escapes by method C, with symbol exclusion.

    levels: arrays (contexts, 256). A level gives a seen byte its count of n + d, for n
    counts and d kinds of byte that no longer context has seen, and d to the next level;
    what is left over is shared by the bytes that no level has seen.
    """
    import numpy as np

    p = np.zeros(levels[0].shape)
    out, mass = np.zeros(levels[0].shape, bool), np.ones((len(p), 1))
    for c in levels:
        c = np.where(out, 0, c)
        n, d = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        more = (~out & (c == 0)).any(1, keepdims=True)
        whole = np.where(n > 0, n + np.where(more, d, 0), 1)
        p += mass * c / whole
        mass = np.where(n > 0, mass * np.where(more, d, 0) / whole, mass)
        out |= c > 0
    left = (~out).sum(1, keepdims=True)
    return p + np.where(out, 0, mass / np.maximum(left, 1))


def _level(key: str) -> str:
    return f"shiftright({key}, 48)"


def _shorter(key: str) -> str:
    """A numbered pair (level << 48 | context << 8 | byte) with the first byte of its context dropped."""
    return f"shiftleft({_level(key)} - 1, 48) | ({key} & (shiftleft(1L, int(8 * {_level(key)})) - 1))"


def trie(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs(key, n), distinct, to (entries, nodes), both of all levels, 0 to ORDER bytes of context.

    entries(key, n): level << 48 | context << 8 | byte. nodes(node, n, d, whole, escape):
    level << 40 | context, its counts and kinds of byte, and what its next shorter
    context then gives from: `whole`, the counts of bytes that the node has not seen
    plus their kinds, and `escape`, the share of the kinds. As a node's bytes are all
    seen by its shorter contexts too, these follow from sums over joined entries.
    """
    levels = F.expr(f"explode(transform(sequence(0, {ORDER}), k -> shiftleft(bigint(k), 48) | (key & (shiftleft(1L, 8 * (k + 1)) - 1)))) AS key")
    entries = materialize(pairs.select(levels, "n").groupBy("key").agg(F.sum("n").alias("n")))
    inner = entries.where("key >= shiftleft(1L, 48)").select(F.expr("shiftright(key, 8)").alias("node"), "n", F.expr(_shorter("key")).alias("up"))
    seen = inner.join(entries.select(F.col("key").alias("up"), F.col("n").alias("above")), "up")
    sums = [F.sum("n").alias("n"), F.count("*").alias("d")]
    root = entries.where("key < shiftleft(1L, 48)").groupBy(F.expr("shiftright(key, 8)").alias("node")).agg(*sums, F.lit(0).cast("long").alias("x"))
    own = materialize(seen.groupBy("node").agg(*sums, F.sum("above").alias("x")).union(root))
    up = F.expr("shiftleft(shiftright(node, 40) - 1, 40) | (node & (shiftleft(1L, int(8 * (shiftright(node, 40) - 1))) - 1))")
    above = own.select(F.col("node").alias("up"), F.col("n").alias("an"), F.col("d").alias("ad"))
    new = F.col("ad") - F.col("d")
    whole = F.when(new > 0, F.col("an") - F.col("x") + new)
    nodes = own.withColumn("up", F.when(F.col("node") >= 1 << 40, up)).join(above, "up", "left")
    return entries, materialize(nodes.select("node", "n", "d", F.coalesce(whole, F.lit(1)).alias("whole"), F.coalesce(new / whole, F.lit(1.0)).alias("escape")))


def pair_logs(entries: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, n, log) of the trie's own pairs and of pairs(key, n): log10 of the mixed probability, by method C with symbol exclusion.

    The longest context that is a node gives a byte its count of n + d; a byte it has
    not seen gets d of that, and what the next shorter ones leave, each without the
    bytes of the longer; bytes that no level has seen share what is left.
    """
    own = entries.where(f"key >= shiftleft({ORDER}L, 48)").select("key", F.col("n").alias("c"), F.expr("shiftright(key, 8)").alias("node")).join(nodes, "node")
    own = own.select(F.expr("key & (shiftleft(1L, 48) - 1)").alias("key"), F.col("c").alias("n"), F.log10(F.col("c") / (F.col("n") + F.col("d"))).alias("log"))
    new = materialize(pairs.join(own.select("key"), "key", "left_anti"))
    asked = new.select("key", F.expr(f"explode(transform(sequence(0, {ORDER}), k -> shiftleft(bigint(k), 48) | (key & (shiftleft(1L, 8 * (k + 1)) - 1)))) AS at"))
    asked = asked.join(entries.select(F.col("key").alias("at"), F.col("n").alias("c")), "at", "left").withColumn("node", F.expr("shiftright(at, 8)"))
    asked = asked.join(nodes, "node").select("key", F.struct((-F.expr(_level("at"))).alias("order"), "c", "n", "d", "whole", "escape").alias("level"))
    chain = asked.groupBy("key").agg(F.sort_array(F.collect_list("level")).alias("levels"))
    kinds = nodes.where("node = 0").select("d").first()
    start = F.expr("CAST(named_struct('p', 1D, 'done', false, 'whole', 0, 'escape', 0D) AS struct<p:double,done:boolean,whole:bigint,escape:double>)")

    def step(s, x):
        first = s["whole"] == 0
        whole, escape = F.when(first, x["n"] + x["d"]).otherwise(s["whole"]), F.when(first, x["d"] / (x["n"] + x["d"])).otherwise(s["escape"])
        share = F.when(x["c"].isNotNull(), x["c"] / whole).otherwise(escape)
        go = F.struct((s["p"] * share).alias("p"), x["c"].isNotNull().alias("done"), x["whole"].alias("whole"), x["escape"].alias("escape"))
        return F.when(s["done"], s).otherwise(go)

    end = F.aggregate("levels", start, step)
    p = F.when(F.col("levels").isNull(), 1 / 256).otherwise(F.when(end["done"], end["p"]).otherwise(end["p"] / (256 - (kinds[0] if kinds else 0))))
    return own.union(new.join(chain, "key", "left").select("key", "n", F.log10(p).alias("log")))


def adaptive_cost(text: str | None, order: int = ORDER) -> float:
    """log10 probability of one text under a trie that learns it byte by byte; every context starts empty."""
    import math

    import numpy as np

    trie: dict[bytes, object] = {}
    data, total = _bytes(text) + bytes([END]), 0.0
    past = bytes([END] * order)
    for s in data:
        at = [past[len(past) - k :] if k else b"" for k in range(order, -1, -1)]
        p = mixed_row([trie.setdefault(x, np.zeros(256, np.int64))[None, :] for x in at])[0, s]
        total += math.log10(p)
        for x in at:
            trie[x][s] += 1
        past = (past + bytes([s]))[1:]
    return total


def score_documents(docs: DataFrame, pair_slots: int = PAIR_SLOTS, word_slots: int = WORD_SLOTS, step: int = STEP) -> DataFrame:
    """docs(doc_id, text) to doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; a row for each.

    Texts, null as empty, are lower-cased (A-Z) and learnt from where
    crc32(doc_id as text) mod 7 is not 2; a null doc_id is not held out. The trie
    holds every context of the training texts, in tables. Of its pairs of context
    and byte, of those that held-out texts add, and of words, the commonest of each
    slot go to every task, in tables of fixed size; the others' logs are joined to
    the texts that hold them. Without training texts every
    byte has a probability of 1/256.
    """
    import math

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = materialize(d.select("text", held.alias("held")).mapInArrow(_counted, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    sums = {r["kind"]: (r["n"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    texts = sums.get(2, (0, 0))[0]
    tokens, kinds = sums.get(0, (0, 0))[0] + texts, sums.get(0, (0, 0))[1] + (texts > 0)
    floor = math.log10(tokens + kinds + 1)
    vocabulary = counts.where("kind = 0").select("key", "n")
    entries, nodes = trie(counts.where("kind = 1").select("key", "n"))
    logs = materialize(pair_logs(entries, nodes, counts.where("kind = 3").select("key", "n")))
    words = vocabulary.select("key", "n", F.log10(F.col("n") + 1).alias("log"))
    shared = docs.sparkSession.sparkContext.broadcast((_common(words, "n", word_slots), _common(logs, "log", pair_slots)))
    end = math.log10(texts + 1)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        common_words, common_pairs = _Table(word_slots, *shared.value[0]), _Table(pair_slots, *shared.value[1])
        for b in batches:
            cols = [[] for _ in range(6)]
            for t in b.column(1).to_pylist():
                data, n, known, base, far = _bytes(t), 1, int(texts > 0), end, []
                for part in _split(data, step):
                    h = _word_hash(part)
                    counted, hit = common_words.find(h)
                    n, known, base = n + len(h), known + len(counted), base + float(np.log10(counted + 1.0, dtype=np.float64).sum())
                    far.append(h[~hit])
                score, rest = 0.0, []
                for pairs in _pairs(data, step):
                    found, hit = common_pairs.find(pairs)
                    score += float(found.sum(dtype=np.float64))
                    rest.append(pairs[~hit])
                for col, v in zip(cols, (n, known, base, score, np.concatenate([np.empty(0, np.int64), *far]), np.concatenate(rest))):
                    col.append(v)
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, types)]], ["doc_id", "n_tokens", "n_top", "top_logs", "top_score", "words", "pairs"])

    scored = d.mapInArrow(run, "doc_id long, n_tokens long, n_top long, top_logs double, top_score double, words array<long>, pairs array<long>")
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()))
    asked = scored.select("row", F.explode("words").alias("key"), F.lit(0).alias("kind")).union(scored.select("row", F.explode("pairs"), F.lit(1)))
    table = words.select("key", F.lit(0).alias("kind"), "log").union(logs.select("key", F.lit(1), "log"))
    more = asked.groupBy("row", "kind", "key").agg(F.count("*").alias("times")).join(table, ["key", "kind"])
    value = F.col("times") * F.col("log")
    more = more.groupBy("row").agg(F.sum(F.when(F.col("kind") == 0, F.col("times"))).alias("n"), F.sum(F.when(F.col("kind") == 0, value)).alias("logs"), F.sum(F.when(F.col("kind") == 1, value)).alias("score"))
    out = scored.drop("words", "pairs").join(more, "row", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        (F.col("n_top") + F.coalesce("n", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("top_logs") + F.coalesce("logs", zero) - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("top_score") + F.coalesce("score", zero)).alias("score"),
    )
