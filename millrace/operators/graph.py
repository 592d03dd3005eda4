"""Co-occurrence graphs, communities and betweenness, as joins over edge tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut, running, stored


def coshare_edges(pairs: DataFrame, threshold: int) -> DataFrame:
    """pairs(node, item), distinct, to (src, dst), both directions: nodes that share at least `threshold` (1 or more) items."""
    if threshold < 1:
        raise ValueError("threshold must be at least 1")
    return both_ways(share_counts(pairs).where(F.col("n") >= threshold))


#: Nodes of a block that an item's list is cut into, and parts in which a longer list finds its size.
BLOCK_NODES, SALTS = 256, 64

#: Pairs, a row for each shared item, that one task counts, about.
TASK_PAIRS = 1 << 22


def share_counts(pairs: DataFrame, block_nodes: int = BLOCK_NODES, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(src, dst, n), src < dst: how many items two nodes share; null nodes and items share nothing.

    An item's nodes stand in a list, or in blocks of about `block_nodes`, and each
    meets the larger ones of its own list and of the item's other blocks. What is
    shuffled is a node with the rest of a list, not a row a pair, and counts are
    taken where the rows of a node meet, in as many tasks as the pairs need.
    """
    own = stored(_blocks(pairs.where("node IS NOT NULL AND item IS NOT NULL"), block_nodes))
    d = own.groupBy("item").agg(F.sum(F.size("nodes").cast("double")).alias("d"))
    n = d.agg(F.coalesce(F.sum(F.expr("d * (d - 1) / 2")), F.lit(0.0))).first()[0]
    short, long = own.where("blocks = 1"), own.where("blocks > 1")
    rest = short.select(F.posexplode("nodes").alias("at", "src"), "nodes").select("src", F.expr("slice(nodes, at + 2, size(nodes))").alias("after"))
    one = long.select("item", F.explode("nodes").alias("src"))
    met = one.join(long.select("item", "nodes"), "item").select("src", F.filter("nodes", lambda x: x > F.col("src")).alias("after"))
    rest = rest.union(met).where(F.size("after") > 0).repartition(max(1, math.ceil(n / task_pairs)), "src")
    return rest.select("src", F.explode("after").alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))


def _blocks(pairs: DataFrame, block_nodes: int) -> DataFrame:
    """(item, block, blocks, nodes): an item's nodes, sorted, in blocks by their hash; only items beyond one block are looked up, by item and one of SALTS parts."""
    size = pairs.groupBy("item").agg(F.ceil(F.count("*") / block_nodes).cast("int").alias("blocks")).where("blocks > 1")
    size = size.select("item", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    x = pairs.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(size, ["item", "salt"], "left")
    x = x.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("blocks")).cast("int"))
    return x.groupBy("item", "block", "blocks").agg(F.sort_array(F.collect_list("node")).alias("nodes"))


def both_ways(half: DataFrame) -> DataFrame:
    return half.select("src", "dst").union(half.select("dst", "src"))


def label_propagation(edges: DataFrame, steps: int = 5) -> DataFrame:
    """(id, label) after so many steps: each node takes its neighbours' commonest label, the smallest of several."""
    labels = edges.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(steps):
        n = edges.join(labels, edges.src == labels.id).groupBy("dst", "label").agg(F.count("*").alias("n"))
        labels = cut(n.groupBy("dst").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label")).select(F.col("dst").alias("id"), "label"))
    return labels


def communities(labels: DataFrame) -> DataFrame:
    """(label, members)."""
    return labels.groupBy("label").agg(F.sort_array(F.collect_list("id")).alias("members"))


def connected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest node reachable; minima spread along edges, and labels along labels, until nothing changes."""
    labels = cut((nodes if nodes is not None else edges.select(F.col("src").alias("id")).distinct()).select("id", F.col("id").alias("component")))
    while True:
        low = edges.join(labels, edges.src == labels.id).groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("low"))
        step = labels.join(low, "id", "left").select("id", "component", F.least("component", F.coalesce("low", "component")).alias("new"))
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("far"))
        step = cut(step.join(jump, "new", "left").select("id", "component", F.least("new", F.coalesce("far", "new")).alias("new")))
        changed = step.where("component <> new").limit(1).count()
        labels = step.select("id", F.col("new").alias("component"))
        if not changed:
            return labels


#: (root, node) rows that one batch of searches may come to, about; one root's always go together.
ROOT_ROWS = 1 << 24


def edge_betweenness(edges: DataFrame, root_rows: int = ROOT_ROWS) -> DataFrame:
    """(u, v, score), u < v, of undirected edges (src, dst), both directions: the sum over roots of shortest-path shares, halved.

    Roots go in batches of about `root_rows` / nodes of them, and a batch's shares
    are summed by edge before the next, so what is held does not grow with the
    square of the nodes.
    """
    roots = cut(edges.select(F.col("src").alias("root")).distinct())
    n = roots.count()
    batches, total = max(1, -(-n * n // root_rows)), None
    for k in range(batches):
        own = roots if batches == 1 else roots.where(F.pmod(F.xxhash64("root"), F.lit(batches)) == k)
        part = _shares(edges, own)
        if part is not None:
            total = part if total is None else cut(total.union(part).groupBy("u", "v").agg(F.sum("score").alias("score")))
    if total is None:
        return edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(0.0).alias("score")).limit(0)
    return total


def _shares(edges: DataFrame, roots: DataFrame) -> DataFrame | None:
    """(u, v, score) from the given roots alone, a stored table; None without any level.

    All searches advance together, a join a level; a level's neighbours lie in it
    or the levels next to it. Credits then flow back a level a join, each edge
    passing on a child's credit in the parents' shares of its paths.
    """
    levels = [cut(roots.select("root", F.col("root").alias("node"), F.lit(1.0).alias("paths")))]
    while True:
        nxt = levels[-1].join(edges, F.col("node") == F.col("src")).groupBy("root", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        for near in levels[-2:]:
            nxt = nxt.join(near.select("root", "node"), ["root", "node"], "left_anti")
        nxt = cut(nxt)
        if not nxt.limit(1).count():
            break
        levels.append(nxt)
    shares, credit = None, None
    for k in range(len(levels) - 1, 0, -1):
        own = levels[k].select("root", F.col("node").alias("child"), F.col("paths").alias("all"))
        own = own.withColumn("credit", F.lit(1.0)) if credit is None else own.join(credit, ["root", "child"], "left").withColumn("credit", 1 + F.coalesce("got", F.lit(0.0))).drop("got")
        up = own.join(edges, F.col("child") == F.col("src")).select("root", "child", F.col("dst").alias("node"), "all", "credit").join(levels[k - 1], ["root", "node"])
        flow = cut(up.select("root", "node", "child", (F.col("credit") * F.col("paths") / F.col("all")).alias("share")))
        shares = flow if shares is None else shares.union(flow)
        credit = flow.groupBy("root", F.col("node").alias("child")).agg(F.sum("share").alias("got"))
    if shares is None:
        return None
    return cut(shares.groupBy(F.least("node", "child").alias("u"), F.greatest("node", "child").alias("v")).agg((F.sum("share") / 2).alias("score")))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the sum over communities of inner edges / m less (degree / 2m) squared, m and degrees of `edges`."""
    return _quality(edges, labels).select(F.round("q", 6).alias("modularity"))


def _quality(edges: DataFrame, labels: DataFrame) -> DataFrame:
    a, b = labels.toDF("src", "a"), labels.toDF("dst", "b")
    e = edges.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("c")).agg(F.count("*").alias("deg"), F.count_if(F.col("a") == F.col("b")).alias("inner"))
    total = e.agg(F.sum("deg").alias("m2"))
    return e.crossJoin(F.broadcast(total)).agg(F.sum(F.col("inner") / F.col("m2") - F.pow(F.col("deg") / F.col("m2"), F.lit(2))).alias("q"))  # one row of totals


#: Edges, counted in both directions, of a component that one task searches or divides; larger ones go by joins.
TASK_EDGES = 1024


def _search(beside: dict) -> tuple[dict, dict]:
    """(score by edge, smallest node reachable by node) of a graph given as each node's neighbours."""
    label, score = {}, dict.fromkeys(((a, b) for a in beside for b in beside[a] if a < b), 0.0)
    for root in sorted(beside):
        depth, paths, order = {root: 0}, {root: 1.0}, [root]
        for v in order:  # grows as nodes are found
            for w in beside[v]:
                if w not in depth:
                    depth[w], paths[w] = depth[v] + 1, 0.0
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        credit = dict.fromkeys(order, 1.0)
        for w in reversed(order):
            label.setdefault(w, root)
            for v in beside[w]:
                if depth[v] == depth[w] - 1:
                    share = credit[w] * paths[v] / paths[w]
                    credit[v] += share
                    score[min(v, w), max(v, w)] += share / 2
    return score, label


def _searched(key, pdf):
    """A component's edges (src, dst) to its scores (u, v, score) and, with a null score, its nodes' labels (id, component)."""
    import pandas as pd

    beside: dict = {}
    for a, b in zip(pdf["src"].tolist(), pdf["dst"].tolist()):
        beside.setdefault(a, []).append(b)
    score, label = _search(beside)
    rows = [(*e, x) for e, x in score.items()] + [(n, c, None) for n, c in label.items()]
    return pd.DataFrame({"u": [r[0] for r in rows], "v": [r[1] for r in rows], "score": pd.array([r[2] for r in rows], "Float64")})


def scored_components(edges: DataFrame, nodes: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """edges(src, dst, of) and nodes(id) to scores (u, v, score) and, with a null score, (id, component) as (u, v): betweenness and components in one.

    `of` names parts that no edge joins: those of at most `task_edges` edges are
    searched in a task each, the others by edge_betweenness() and connected().
    """
    kind = edges.schema["src"].dataType.simpleString()
    many = cut(edges.groupBy("of").agg(F.count("*").alias("_n")).where(F.col("_n") > task_edges).select("of"))
    out = edges.join(many, "of", "left_anti").groupBy("of").applyInPandas(_searched, f"u {kind}, v {kind}, score double")
    alone = nodes.join(edges, F.col("id") == F.col("src"), "left_anti").select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(None).cast("double").alias("score"))
    out = out.union(alone)
    if many.limit(1).count():
        rest = cut(edges.join(many, "of", "left_semi").select("src", "dst"))
        own = connected(rest).select(F.col("id").alias("u"), F.col("component").alias("v"), F.lit(None).cast("double").alias("score"))
        out = out.union(edge_betweenness(rest)).union(own)
    return cut(out.withColumn("score", F.round("score", 9)))


def _turns(tops: list) -> list[tuple]:
    """For each step of a component, its place among those of all: steps of several components follow in the order of these, equal ones together.

    A step waits until no component has a higher top, and the steps after it that
    are not below it come before any other component's lower ones. So a place is
    minus the least top so far, then, but for the first step with that least top,
    the place among the steps since.
    """
    out, todo = [()] * len(tops), [(0, len(tops), ())]
    while todo:
        at, end, before = todo.pop()
        while at < end:
            upto = at + 1
            while upto < end and tops[upto] >= tops[at]:
                upto += 1
            out[at] = (*before, -tops[at])
            todo.append((at + 1, upto, out[at]))
            at = upto
    return out


def _divided(total: float):
    """Over a component's (src, dst, live, degree), all edges between its nodes, live ones uncut: its whole division, step by step.

    Rows (of, step, turn, gain, id, component): a step's gain in modularity with a
    null id, and a row for each node that gets another component by it.
    """

    def run(key, pdf):
        import pandas as pd

        inner, live, degree = {}, {}, {}
        for a, b, alive, d in zip(pdf["src"].tolist(), pdf["dst"].tolist(), pdf["live"].tolist(), pdf["degree"].tolist()):
            inner.setdefault(a, []).append(b)
            degree[a] = d
            if alive:
                live.setdefault(a, []).append(b)

        def quality(part):
            return sum(b in part for a in part for b in inner[a]) / total - (sum(degree[a] for a in part) / total) ** 2

        score, label = _search(live)
        score, members = {e: round(x, 9) for e, x in score.items()}, {}
        for n, c in label.items():
            members.setdefault(c, set()).add(n)
        tops, gains, moves = [], [], []
        while score:
            top = max(score.values())
            gone = [e for e, x in score.items() if x == top]
            for a, b in gone:
                live[a].remove(b)
                live[b].remove(a)
                del score[a, b]
            gain, moved = 0.0, []
            for c in {label[a] for a, _ in gone}:
                old = members.pop(c)
                own, new = _search({n: live[n] for n in old})
                score.update((e, round(x, 9)) for e, x in own.items())
                for n, k in new.items():
                    members.setdefault(k, set()).add(n)
                    if k != c:
                        moved.append((n, k))
                label.update(new)
                if moved:
                    gain += sum(quality(members[k]) for k in set(new.values())) - quality(old)
            tops.append(top)
            gains.append(gain)
            moves.append(moved)
        rows = []
        for k, turn in enumerate(_turns(tops)):
            rows += [(key[0], k, list(turn), gains[k], None, None), *((key[0], k, list(turn), None, n, c) for n, c in moves[k])]
        out = pd.DataFrame(rows, columns=["of", "step", "turn", "gain", "id", "component"])
        if not isinstance(key[0], str):
            out = out.astype({"of": "Int64", "id": "Int64", "component": "Int64"})
        return out

    return run


def _divide_small(edges: DataFrame, own: DataFrame, live: DataFrame) -> tuple[float, DataFrame] | None:
    """(modularity, (id, component)) of the first best division from `own` on, if every component is divided in a task; None without live edges."""
    kind = edges.schema["src"].dataType.simpleString()
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    e = edges.join(own.toDF("src", "of"), "src").join(own.toDF("dst", "other"), "dst").where("of = other").select("src", "dst", "of")
    e = e.join(degree, "src").join(live.select("src", "dst", F.lit(True).alias("live")), ["src", "dst"], "left").fillna(False, ["live"])
    some = live.join(own.toDF("src", "of"), "src").select("of").distinct()
    e = e.join(some, "of", "left_semi").select("of", "src", "dst", "live", "degree")
    steps = cut(e.groupBy("of").applyInPandas(_divided(float(edges.count())), f"of {kind}, step int, turn array<double>, gain double, id {kind}, component {kind}"))
    base = _quality(edges, own).first()[0]
    turns = running(steps.where("gain IS NOT NULL").groupBy("turn").agg(F.sum("gain").alias("gain")), ["turn"], "gain", "sum")
    best = turns.agg(F.max(F.struct(F.round(F.col("sum") + base, 6).alias("q"), (-F.col("seq")).alias("seq"))).alias("b")).select("b.*").first()
    if best["q"] is None:
        return None
    last = turns.where(F.col("seq") == -best["seq"]).select(F.col("turn").alias("upto"))  # one row
    moved = steps.where("gain IS NULL").crossJoin(F.broadcast(last)).where("turn <= upto").groupBy("id").agg(F.max_by("component", "step").alias("new"))
    return best["q"], cut(own.join(moved, "id", "left").select("id", F.coalesce("new", "component").alias("component")))


def divisive_communities(edges: DataFrame, score_initial: bool = False, rounds: int | None = None, task_edges: int = TASK_EDGES) -> DataFrame:
    """(id, component) of the first division with the best modularity: all edges tied at the top score go, round by round, until none is left.

    A cut changes scores and components only where it was made, so a round searches
    just the components that lost an edge. Once none has over `task_edges` edges,
    each is divided to its end in a task, and the tasks' steps are put in the order
    in which the rounds would take them. Scores are rounded to 1e-9 before they are
    compared. The uncut graph counts only if score_initial. With `rounds`, only so
    many rounds are made.
    """
    edges = cut(edges.select("src", "dst"))
    nodes = cut(edges.select(F.col("src").alias("id")).distinct())
    own, live = cut(connected(edges, nodes)), edges
    best, k, found = (modularity(edges, own).first()[0], own) if score_initial else None, 0, None
    while rounds is None or k < rounds:
        if rounds is None and not live.join(own.toDF("src", "of"), "src").groupBy("of").count().where(F.col("count") > task_edges).limit(1).count():
            rest = _divide_small(edges, own, live)
            if rest and (best is None or rest[0] > best[0]):
                best = rest
            break
        if found is None:
            found = scored_components(edges.join(own.toDF("src", "of"), "src").select("src", "dst", "of"), nodes, task_edges)
        scores = found.where("score IS NOT NULL")
        top = scores.agg(F.max("score")).first()[0]
        if top is None:
            break
        touched = cut(scores.where(F.col("score") == top).join(own.toDF("u", "of"), "u").select("of").distinct())
        left = scores.where(F.col("score") != top).join(own.toDF("u", "of"), "u").join(touched, "of", "left_semi").select("u", "v", "of")
        left = cut(left.select(F.col("u").alias("src"), F.col("v").alias("dst"), "of").union(left.select("v", "u", "of")))
        inside = own.toDF("id", "of").join(touched, "of", "left_semi").select("id")
        kept = found.join(inside, F.col("u") == F.col("id"), "left_anti")
        found = cut(kept.union(scored_components(left, inside, task_edges)))
        own = found.where("score IS NULL").select(F.col("u").alias("id"), F.col("v").alias("component"))
        live = found.where("score IS NOT NULL").select(F.col("u").alias("src"), F.col("v").alias("dst"))
        live = live.union(live.select("dst", "src"))
        q = modularity(edges, own).first()[0]
        if best is None or q > best[0]:
            best = (q, own)
        k += 1
    return best[1] if best else nodes.select("id", F.col("id").alias("component"))
