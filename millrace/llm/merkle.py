"""Merkle manifest: levels built bottom-up as tables, proofs pushed top-down from parents to children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, sized

#: Children of a node.
FANOUT = 8
#: Columns of a leaf, in the order in which they are hashed.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: A proof: what stands left and right of the node, level by level.
PROOF = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the strings joined."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """A value as bytes that no other value has: its UTF-8 byte count, a colon, the value; `-` for null."""
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """docs to (tree, doc_id, leaf, other): other is the leaf with `tampered` in place of the text, null where that is null or changes nothing.

    A tree holds one lang; its name sorts as the lang does by UTF-8 bytes, null first.
    """
    d = docs.select(*[F.col(c) for c in COLUMNS], (tampered if tampered is not None else F.lit(None).cast("string")).alias("_other"))
    leaf = lambda text: digest(*[field(F.col(c)) for c in COLUMNS[:-1]], field(text))
    tree = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    other = F.when(F.col("_other") != F.col("text"), leaf(F.col("_other")))
    return d.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("leaf"), other.alias("other"))


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """df(tree, ...) with `idx`, its row's place in its tree from 0, and `n`, the tree's rows; equal rows in any order.

    A range-partitioned sort that may cut a tree and even equal rows, and offsets
    from a count for each partition and tree.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order, "_tie"]
    s = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie")
    s = materialize(s.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    runs = s.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    w = Window.partitionBy("tree")  # a row for each partition that has rows of the tree
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = runs.select("tree", "_part", (before - F.col("_low")).alias("_shift"), F.sum("_n").over(w).alias("n"))
    return s.join(sized(materialize(first)), ["tree", "_part"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def build(nodes: DataFrame, payload: list[str], fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """nodes(tree, idx, n, digest, *payload) to the levels of all trees, and their roots (tree, digest, top).

    A level is a table of runs (tree, n, run, kids): n is the tree's nodes there,
    kids at most `fanout` of (idx, digest[, payload]) in order. A tree ends at the
    level, top, where it has one node.
    """
    levels, roots = [], None
    while True:
        kid = F.struct("idx", "digest", *(payload if not levels else []))
        runs = nodes.groupBy("tree", "n", F.expr(f"idx div {fanout}").alias("run")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        levels.append(materialize(runs))
        done = levels[-1].where("n = 1").select("tree", F.col("kids")[0]["digest"].alias("digest"), F.lit(len(levels) - 1).alias("top"))
        roots = done if roots is None else roots.unionByName(done)
        up = levels[-1].where("n > 1")
        if not up.limit(1).count():
            return levels, roots
        joined = F.array_join(F.transform("kids", lambda k: k["digest"]), "")
        nodes = up.select("tree", F.col("run").alias("idx"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), digest(joined).alias("digest"))


def push(levels: list[DataFrame], roots: DataFrame, payload: list[str]) -> DataFrame:
    """The leaves (tree, digest, subroot, proof, *payload) of levels, under roots(tree, digest, top, proof): a root's proof goes on above it.

    Each level joins its runs to the proofs of their parents; a child puts its own
    siblings before what it inherits.
    """
    above = None
    for k in range(len(levels) - 1, -1, -1):
        tops = roots.where(F.col("top") == k).select("tree", F.lit(0).cast("long").alias("run"), F.col("digest").alias("subroot"), F.col("proof").alias("rest"))
        above = tops if above is None else above.unionByName(tops)
        kids = F.transform("kids", lambda k: k["digest"])
        r = levels[k].join(above, ["tree", "run"]).select("tree", "n", "subroot", "rest", kids.alias("all"), F.posexplode("kids").alias("at", "kid"))
        beside = F.struct(F.array_join(F.slice("all", F.lit(1), F.col("at")), "").alias("left"), F.array_join(F.slice("all", F.col("at") + 2, F.size("all")), "").alias("right"))
        proof = F.when(F.col("n") == 1, F.col("rest")).otherwise(F.concat(F.array(beside), "rest"))
        if k:
            above = materialize(r.select("tree", F.col("kid.idx").alias("run"), "subroot", proof.alias("rest")))
        else:
            return r.select("tree", F.col("kid.digest").alias("digest"), "subroot", proof.alias("proof"), *[F.col(f"kid.{c}").alias(c) for c in payload])


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give. A level without siblings hashes the one digest."""
    return F.aggregate(proof, leaf, lambda acc, x: digest(x["left"], acc, x["right"]))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), ""))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """docs (COLUMNS) to a row for each row: (doc_id, leaf, subroot, root, proof, other).

    Per lang, leaves ascend by doc_id (null first), equal ids by digest; subroots
    ascend by lang, null first. Any column may be null, and rows may repeat, which
    gives as many leaves. No rows: no rows. A proof has a level for each level of
    the lang's tree and of the tree over langs; none if there is one leaf in all.
    """
    own = materialize(leaves(docs, tampered))
    levels, roots = build(ranked(own, ["doc_id", "leaf"]).withColumnRenamed("leaf", "digest"), ["doc_id", "other"])
    discard(own)
    sub = materialize(roots)
    langs = ranked(sub.select(F.lit("").alias("tree"), F.col("tree").alias("lang_tree"), "digest", F.col("top").alias("lang_top")), ["lang_tree"])
    top_levels, top = build(langs, ["lang_tree", "lang_top"])
    top = materialize(top)
    p = push(top_levels, top.withColumn("proof", F.array().cast(PROOF)), ["lang_tree", "lang_top"])
    under = materialize(p.select(F.col("lang_tree").alias("tree"), "digest", F.col("lang_top").alias("top"), "proof"))
    found = push(levels, under, ["doc_id", "other"])
    root = top.select(F.col("digest").alias("root"))  # one row
    return found.crossJoin(F.broadcast(root)).select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof", "other")


def audit(docs: DataFrame) -> DataFrame:
    """manifest() checked with copies tampered with: the text's A-Z lower-cased where 3 divides the CRC-32 of the decimal doc_id (never for a null id)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    m = manifest(docs, F.when(picked, F.translate("text", upper, upper.lower())))
    out = m.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), fold(F.coalesce("other", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def audit_sql(levels: int = 6) -> str:
    """DuckDB SQL for audit() over documents, for trees of at most so many levels; CRC-32 bit by bit."""
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda b, y: xor(b >> 1, 3988292384::BIGINT * (b & 1))))"
    f = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    head = " || ".join(f(c) for c in COLUMNS[:-1])
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name, count):
        out = []
        for k in range(count):
            if k:
                out.append(f"{name}{k} AS (SELECT tree, idx // {FANOUT} AS idx, (n + {FANOUT - 1}) // {FANOUT} AS n, sha256(string_agg(h, '' ORDER BY idx)) AS h FROM {name}{k - 1} WHERE n > 1 GROUP BY tree, idx // {FANOUT}, n)")
            w = f"string_agg(h, '') OVER (PARTITION BY tree, idx // {FANOUT} ORDER BY idx ROWS BETWEEN"
            out.append(f"{name}s{k} AS (SELECT tree, idx, n, h, coalesce({w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce({w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})")
        out.append(f"{name}top AS ({' UNION ALL '.join(f'SELECT tree, h FROM {name}{k} WHERE n = 1' for k in range(count))})")
        return ", ".join(out)

    def folds(name, tree, count, on):
        """A level of the fold a CTE: o is the digest so far, p the siblings so far."""
        o = "CASE WHEN x.h IS NULL THEN o ELSE sha256(x.l || o || x.r) END AS o, p || coalesce(x.l || x.r, '') AS p"
        return ", ".join(
            f"{name}{k + 1} AS (SELECT {name}{k}.* REPLACE ({o}) FROM {name}{k} LEFT JOIN {tree}s{k} x ON {on.format(k=k, by=FANOUT**k)} AND x.n > 1)" for k in range(count)
        )

    joins_a = folds("f", "a", levels, "x.tree = f{k}.tree AND x.idx = f{k}.idx // {by}")
    joins_b = folds("g", "b", 2, "x.idx = g{k}.lang_idx // {by}")
    return f"""WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({head} || {f('text')}) AS h, CASE WHEN xor({crc}, 4294967295::BIGINT) % 3 = 0 THEN sha256({head} || {f(lower)}) END AS other FROM documents),
a0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d), {tree('a', levels)},
b0 AS (SELECT '' AS tree, tree AS lang_tree, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM atop), {tree('b', 2)},
f0 AS (SELECT doc_id, tree, idx, h, coalesce(other, h) AS o, '' AS p FROM a0), {joins_a},
g0 AS (SELECT f{levels}.*, b0.h AS subroot, b0.idx AS lang_idx FROM f{levels} JOIN b0 ON b0.lang_tree = f{levels}.tree), {joins_b}
SELECT doc_id, g2.h AS leaf, subroot, btop.h AS root, sha256(p) AS proof_sha256, o AS folded_root, o = btop.h AS verified FROM g2, btop"""
