"""Exact dedup: texts dealt by length and content hash, inserted whole into Patricia tries whose terminals own their groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized, trimmed, written_bytes

#: Deleted before texts are compared: the bytes of [\x20\x09-\x0D], which UTF-8 uses for nothing else.
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of a task's trie, about, before its largest subtrees leave it; and what a node takes besides its edge.
TRIE_BYTES, NODE_BYTES = 64 << 20, 300
#: Bytes as written that a partition of texts should have.
PART_BYTES = 64 << 20
#: Carriers of one length and hash that are merged in one task; more go through parts of about as many first.
CARRIERS = 256
#: Bytes of texts in an Arrow batch of carriers.
OUT_BYTES = 4 << 20

CARRIED = "local long, row long, doc_id long, points long, n long, length long, hash long, text binary"
OWNED = CARRIED + ", rep long, sha string"


def _shared(edge: bytes, s: bytes, at: int) -> int:
    """How many bytes of edge and of s from `at` agree."""
    low, high = 0, min(len(edge), len(s) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if edge[low:mid] == s[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """A compressed radix trie over byte strings. A node is [edge, children by first byte, terminal]; children None: its subtree has left."""

    def __init__(self, limit: int = TRIE_BYTES):
        self.root, self.size, self.limit = [b"", {}, None], 0, limit

    def node(self, s: bytes) -> list | None:
        """The node where s ends, made if need be; None if it would lie in a subtree that has left."""
        node, at = self.root, 0
        while at < len(s):
            kids = node[1]
            if kids is None:
                return None
            kid = kids.get(s[at])
            if kid is None:
                kids[s[at]] = kid = [s[at:], {}, None]
                self.size += len(s) - at + NODE_BYTES
                return kid
            edge = kid[0]
            if s.startswith(edge, at):
                node, at = kid, at + len(edge)
                continue
            k = _shared(edge, s, at)
            kids[s[at]] = node = [edge[:k], {edge[k]: kid}, None]
            kid[0] = edge[k:]
            self.size += NODE_BYTES
            at += k
        return None if node[1] is None else node

    @staticmethod
    def terminals(node: list, prefix: bytes):
        """(string, terminal) of all strings at or below node, whose edge ends prefix."""
        todo = [(node, prefix)]
        while todo:
            node, prefix = todo.pop()
            if node[2] is not None:
                yield prefix, node[2]
            todo.extend((kid, prefix + kid[0]) for kid in (node[1] or {}).values())

    def all(self):
        return self.terminals(self.root, b"")

    def spill(self, closed: bool):
        """(string, terminal) of the largest subtrees, until half the limit is left; where strings still come, they stay closed.

        Subtrees hang below the first node that branches; the smallest always stays, so that something is settled.
        """
        node, prefix = self.root, b""
        while len(node[1] or {}) == 1 and node[2] is None:
            (node,) = node[1].values()
            prefix += node[0]
        sizes = {}
        for key, kid in (node[1] or {}).items():
            todo, sizes[key] = [kid], 0
            while todo:
                x = todo.pop()
                sizes[key] += len(x[0]) + NODE_BYTES
                todo.extend((x[1] or {}).values())
        for key in sorted(sizes, key=sizes.get, reverse=True)[:-1]:
            if self.size <= self.limit // 2:
                break
            kid = node[1][key]
            yield from self.terminals(kid, prefix + kid[0])
            if closed:
                kid[1], kid[2] = None, None
            else:
                del node[1][key]
            self.size -= sizes[key]


def _batches(rows, names: str, weigh: int):
    """Rows as Arrow batches of at most about OUT_BYTES in column `weigh`."""
    import pyarrow as pa

    fields = [f.split() for f in names.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in fields])
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    for r in rows:
        held.append(r)
        size += 200 + len(r[weigh] or b"")
        if size > OUT_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (points, doc_id, row), the one that stays: most code points, smallest id (null last), first row."""
    key = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    return a if key(a) <= key(b) else b


def _gathered(limit: int):
    """Over (doc_id, points, text): a row for each row, and one for each different text of a task, its carrier."""

    def run(batches):
        import xxhash
        from pyspark import TaskContext

        trie, row = Trie(limit), TaskContext.get().partitionId() << 33

        def carriers(found):
            for s, (local, n, (points, doc, at)) in found:
                yield local, at, doc, points, n, len(s), xxhash.xxh64_intdigest(s) - (1 << 63), s

        for b in batches:
            members = []
            for doc, points, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                node, own = trie.node((text or b"").translate(None, SPACES)), (points or 0, doc, row)
                if node[2] is None:
                    node[2] = [row, 1, own]
                else:
                    node[2][1] += 1
                    node[2][2] = _better(node[2][2], own)
                members.append((node[2][0], row, doc, None, None, None, None, None))
                row += 1
                if trie.size > limit:
                    yield from _batches(carriers(trie.spill(False)), CARRIED, 7)
            yield from _batches(members, CARRIED, 7)
        yield from _batches(carriers(trie.all()), CARRIED, 7)

    return run


def _owned(limit: int):
    """Over carriers and `part`: of each text its owner, a row for each carrier.

    `sha` is set where the group is whole. Carriers of a text in parts, or from a
    subtree that left, come with their text once more, all but one only with the
    carrier `rep` that stands for them.
    """

    def run(batches):
        import hashlib

        trie = Trie(limit)

        def owners(found, whole):
            for s, (locals_, n, (points, doc, at), length, h, part) in found:
                if whole and not part:
                    sha = hashlib.sha256(s).hexdigest()
                    for local in locals_:
                        yield local, at, doc, None, n, None, None, None, local, sha
                else:
                    rep = min(locals_)
                    yield rep, at, doc, points, n, length, h, s, rep, None
                    for local in locals_:
                        if local != rep:
                            yield local, None, None, None, None, None, None, None, rep, None

        def one(local, at, doc, points, n, length, h, s, part):
            return s, [[local], n, (points, doc, at), length, h, part]

        for b in batches:
            passed = []
            for r in zip(*(b.column(k).to_pylist() for k in range(9))):
                node = trie.node(r[7])
                if node is None:
                    passed.append(one(*r))
                elif node[2] is None:
                    node[2] = one(*r)[1]
                else:
                    t = node[2]
                    t[0].append(r[0])
                    t[1] += r[4]
                    t[2] = _better(t[2], (r[3], r[2], r[1]))
                    trie.size += 40
                if trie.size > limit:
                    yield from _batches(owners(trie.spill(True), False), OWNED, 7)
            yield from _batches(owners(passed, False), OWNED, 7)
        yield from _batches(owners(trie.all(), True), OWNED, 7)

    return run


def exact_groups(docs: DataFrame, limit: int = TRIE_BYTES, carriers: int = CARRIERS) -> DataFrame:
    """docs(doc_id, text) to a row for each row: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when they are after every byte of SPACES is deleted; null
    counts as empty. Of a group stays the row with the most code points in its
    original text, then the smallest doc_id (null last), then, of rows that repeat
    an id and have as many, one. No rows: no rows. Other columns are not read.

    A task inserts its texts into a trie, so that a text leaves it once with what
    its copies come to (a row each, without text). These carriers meet by length
    and content hash in a task's trie, by their full bytes: hashes deal them out,
    but decide nothing. A trie over `limit` gives its largest subtrees away: a
    task's as further carriers, that of a meeting as rows for the next round, which
    has only those. A key of more than `carriers` carriers (texts that many tasks
    hold) first meets in parts of about so many.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length("text").cast("long").alias("points"), F.col("text").cast("binary").alias("text"))
    table = materialize(d.mapInArrow(trimmed(_gathered(limit)), CARRIED))
    names = CARRIED.replace(" long", "").replace(" binary", "").split(", ")
    left, rounds = table.where("n is not null").select(*names), []
    nbytes = written_bytes(table)
    while True:
        many = left.groupBy("length", "hash").agg(F.count("*").alias("of")).where(F.col("of") > carriers)
        many = sized(materialize(many.select("length", "hash", F.ceil(F.col("of") / carriers).alias("parts"))))
        parted = left.join(many, ["length", "hash"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("local"), F.col("parts")) + 1, F.lit(0)))
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nbytes // PART_BYTES))
        dealt = parted.select(*names, "part").repartition(n, "length", "hash", "part", F.lit(len(rounds)))  # other neighbours each round
        rounds.append(materialize(dealt.mapInArrow(trimmed(_owned(limit)), OWNED)))
        left = rounds[-1].where("text is not null").select(*names)
        if not left.limit(1).count():
            break
        nbytes = written_bytes(rounds[-1])
    whole = lambda t: t.where("sha is not null").select("local", F.col("row").alias("own"), F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.col("sha").alias("text_sha256"))
    found = whole(rounds[-1])
    for t in reversed(rounds[:-1]):  # a carrier has what its rep was given a round later
        later = t.where("sha is null").select("local", "rep").join(found.withColumnRenamed("local", "rep"), "rep").drop("rep")
        found = whole(t).unionByName(later)
    members = table.where("n is null").select("local", "row", "doc_id")
    return members.join(found, "local").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("own")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose doc_id stays; rows that repeat an id stay together, and a null id goes."""
    keep = exact_groups(docs).where("kept").select(F.col("doc_id").alias("_keep"))
    return docs.join(keep, F.col("doc_id") == F.col("_keep"), "left_semi")


def exact_sql() -> str:
    """DuckDB SQL for exact_groups over documents."""
    return r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)"""
