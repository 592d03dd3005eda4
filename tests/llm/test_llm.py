"""Every operator of the subpackage against brute force, round trips or held-out accuracy, with awkward rows."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, embeddings, lm, media, packing, paragraphs, pieces, simhash, suffixes, toxicity, urls
from millrace.llm.queries import tokenizer_path

RNG = random.Random(11)
WORDS = ["".join(RNG.choices("abcdeéñ", k=RNG.randint(2, 7))) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, n long, row long, copy string, _spans string, score double, component string"


def prose(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def docs(spark, texts, ids=None):
    """A table with columns whose names the operators use too."""
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, "x", "y", 0.5, "z") for i, t in zip(ids, texts)], SCHEMA).repartition(3)


AWKWARD = [None, "", " ", "\n\n", "one", "a b", "A b", "a\0b", "é" * 50, "x" * 5000, "\x1c \x85 \u00a0 w", "<|endoftext|>", prose(3000, 1), prose(3000, 1), prose(40, 2), prose(40, 2)]


def test_materialize_frees_shuffles_and_keeps_the_setting(spark):
    before = spark.conf.get(common.FREE_SHUFFLES, None)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    kept = common.materialize(rows)
    assert spark.conf.get(common.FREE_SHUFFLES, None) == before
    assert sorted(kept.collect()) == sorted(rows.collect())
    common.discard(kept)
    bits = common.bitmap(spark.createDataFrame([(5,), (-1,), (5,)], "h long"), "h")
    assert [k for k, b in enumerate(bits) if b] == [0, (1 << common.BITMAP_BITS - 3) - 1] and bits[0] == 1 << 5
    assert spark.conf.get(common.FREE_SHUFFLES, None) == before


def test_trimmed_passes_batches_on():
    assert list(common.trimmed(lambda batches: (2 * b for b in batches))(iter([1, 2]))) == [2, 4]
    assert list(common.trimmed(lambda batches: iter(()))(iter([1]))) == []
    part = common.trimmed(lambda batches: (b for b in batches))(iter([1, 2]))
    assert next(part) == 1
    part.close()  # as under a limit

    def fails(batches):
        yield from batches
        raise ValueError("kept")

    with pytest.raises(ValueError, match="kept"):
        list(common.trimmed(fails)(iter([1])))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, 6000 + k) for k in range(500)]
    edges += [(7, 7), (None, 3)]
    adj = {}
    for a, b in edges:
        if a is not None and a != b:
            adj.setdefault(a, set()).add(b), adj.setdefault(b, set()).add(a)
    want = {}
    for s in sorted(adj):
        if s not in want:
            todo = [s]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = s
                    todo += adj[x]
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    assert {r["node"]: r["component"] for r in common.components(df).collect()} == want
    assert common.components(df.limit(0)).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path())
    mark = "<|endoftext|>"
    texts = AWKWARD + [f"a{mark}b", mark * 3, f" {mark} a {mark}", f"{mark}\n{mark[:-1]}", f"x {mark}{prose(300, 5)} {mark}"] + [prose(k * 7, k) for k in range(60)]
    got = packing.pack_documents(docs(spark, texts), tokenizer_path(), capacity=256).collect()
    ids = {i: [*tk.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    covered = {i: [0] * len(x) for i, x in ids.items()}
    rows = {}
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        for k in range(r["start"], r["start"] + r["length"]):
            covered[r["doc_id"]][k] += 1
        rows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(set(c) == {1} for c in covered.values())
    for parts in rows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(map(len, ids.values()))
    assert len(rows) <= total / 256 * 1.1 + 1
    twice = packing.pack_documents(docs(spark, ["a b", "c d", "a b", None], [4, 4, 4, None]), tokenizer_path()).collect()
    assert sorted(r["ids_crc32"] for r in twice) == sorted(zlib.crc32(np.array([*tk.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for t in ("a b", "c d", "a b", ""))
    assert sorted(r["offset"] for r in twice)[0] == 0 and len({r["sequence_id"] for r in twice}) == 1
    assert packing.pack_documents(docs(spark, AWKWARD).limit(0), tokenizer_path()).count() == 0


def test_pack_histogram_uses_every_length():
    rng = random.Random(1)
    for _ in range(50):
        h = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(rng.randint(1, 20))}
        used = Counter()
        for count, content in packing.pack_histogram(h, 64):
            assert sum(x * n for x, n in content) <= 64
            for x, n in content:
                used[x] += n * count
        assert used == h


def brute_groups(items, near):
    parent = list(range(len(items)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if near(items[i], items[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(items))]


def test_simhash_contract(spark):
    from xxhash import xxh64_intdigest

    base = prose(300, 5)
    texts = AWKWARD + [base] + [" ".join(w if random.Random(k).random() > 0.002 * (k % 5) or not (k % 5) else "zz" for w in base.split()) for k in range(20)] + [base.replace(WORDS[0], "qq", 1)] * 2
    got = {r["doc_id"]: r for r in simhash.simhash_components(docs(spark, texts)).collect()}

    def fingerprint(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(xxh64_intdigest(s, 42) >> b & 1 for s in sh) > len(sh))

    fps = [fingerprint(t) for t in texts]
    want = brute_groups(fps, lambda a, b: bin(a ^ b).count("1") <= 4)
    assert [got[i]["fp"] % (1 << 64) for i in range(len(texts))] == fps
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert simhash.simhash_components(docs(spark, texts).limit(0)).count() == 0


def test_simhash_large_buckets_take_midpoints(spark):
    rng = random.Random(8)
    center = rng.getrandbits(63)
    fps = {center ^ sum(1 << b for b in rng.sample(range(63), k)) for k in (0, 1, 2, 3, 4, 5) for _ in range(30)} | {rng.getrandbits(63) for _ in range(200)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = brute_groups(fps, lambda a, b: bin(a ^ b).count("1") <= 4)
    for cap in (2, 4096):
        comp = {r["node"]: r["component"] for r in common.components(simhash.near_fingerprints(df, 4, cap)).collect()}
        assert [comp.get(x, x) for x in fps] == [fps[k] for k in want]


def test_near_copies(spark):
    base = [prose(300, 100 + k) for k in range(30)]
    edited = []
    for k, t in enumerate(base[:20]):
        w = t.split()
        for p in random.Random(k).sample(range(300), 2):
            w[p] = "changed"
        edited.append(" ".join(w))
    texts = base + edited + base[:3] + [None, "", ""]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs(spark, texts)).collect()}
    found = sum(got[30 + k] == k for k in range(20))
    assert found >= 18 and [got[50 + k] for k in range(3)] == [0, 1, 2] and len({got[k] for k in range(30)}) == 30
    assert got[53] == got[54] == got[55] == 53
    small = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs(spark, texts), bucket_rows=1).collect()}
    assert small == got
    kept = simhash.simhash_dedup(docs(spark, texts))
    assert kept.columns == docs(spark, texts).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, c in got.items() if k == c)
    assert simhash.simhash_dedup(docs(spark, texts).limit(0)).count() == 0


def test_near_copies_of_every_kind_of_edit(spark):
    def shingles(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    def alike(a, b):
        a, b = shingles(a), shingles(b)
        return len(a & b) / len(a | b)

    texts, want = {}, {}
    for k in range(160):
        rng = random.Random(k)
        n = rng.randint(80, 400)
        w = prose(n, 5000 + k).split()
        x = [f"new{k}x{j}" for j in range(n)]
        at = rng.randrange(n)
        cut = int(n * 0.2)
        if k % 5 == 3:
            edited = list(w)
            for j in rng.sample(range(n), max(1, n // 55)):
                edited[j] = x[j]
        else:
            edited = [w + x[: int(n * 0.22)], x[: int(n * 0.22)] + w, w[: n - int(n * 0.18)], None, w[:at] + x[:cut] + w[at:]][k % 5]
        texts[k], texts[1000 + k] = " ".join(w), " ".join(edited)
        want[k] = alike(w, edited) >= 0.8
    assert sum(want.values()) > 120
    for k in range(20):  # just below: no links
        w = prose(100, 7000 + k).split()
        texts[2000 + k], texts[3000 + k] = " ".join(w), " ".join(w + [f"odd{k}x{j}" for j in range(30)])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs(spark, list(texts.values()), list(texts))).collect()}
    found = sum(got[1000 + k] == k for k, y in want.items() if y)
    assert found >= 0.97 * sum(want.values())
    assert all(got[1000 + k] == 1000 + k for k, y in want.items() if not y) and all(got[3000 + k] == 3000 + k for k in range(20))


def test_near_copies_are_looked_up_by_their_simhash(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TABLE_ROWS", 2)
    monkeypatch.setattr(simhash, "TABLES", 8)
    rng = random.Random(9)
    fps = {k: [rng.getrandbits(64) for _ in range(4)] for k in range(700)}
    for k in range(300):  # as far as texts of a similarity of 0.8 are, at a random place
        bits = rng.sample(range(256), sum(rng.random() < 0.1515 for _ in range(256)))
        fps[1000 + k] = [x ^ sum(1 << b % 64 for b in bits if b // 64 == j) for j, x in enumerate(fps[k])]
    for k in range(40):  # one close group, larger than a part
        fps[2000 + k] = [fps[699][0] ^ 1 << k, *fps[699][1:]]
    nodes = spark.createDataFrame([(k, *(x - (1 << 64) if x >> 63 else x for x in v)) for k, v in fps.items()], "node long, s0 long, s1 long, s2 long, s3 long")
    assert simhash.lookup_tables(1040, 0.8) > (9, 16)
    for part_rows in (2048, 16):
        got = {r["node"]: r["component"] for r in common.components(simhash._simhash_links(nodes, 0.8, part_rows)).collect()}
        found = sum(got.get(1000 + k) == k for k in range(300))
        assert found >= 290 and all(got[2000 + k] == 699 for k in range(40))
        assert len(got) == 2 * found + 41  # and none that are not alike


def test_substring_dedup(spark):
    passage, near = prose(70, 900), prose(80, 901)
    near2 = near.split()
    near2[40] = "other"
    texts = AWKWARD[:12] + [prose(100, 1000 + k) + (" " + passage + " " if k < 4 else " ") + prose(90, 2000 + k) for k in range(10)] + [prose(60, 3000) + "\n" + near, prose(60, 3001) + "\n" + " ".join(near2)]
    d = docs(spark, texts)
    out = {r["doc_id"]: r["text"] for r in paragraphs.remove_repeats(d).collect()}
    assert paragraphs.remove_repeats(d).columns == d.columns and len(out) == len(texts)
    assert passage in out[12] and all(passage not in out[k] for k in (13, 14, 15))
    assert all(out[k] == texts[k] for k in [*range(12), *range(16, 23)])
    assert out[23].split() == texts[23].split()[:60]
    for k in (13, 14, 15):
        own = set(texts[k].split()) - set(passage.split())
        assert own <= set(out[k].split())
    report = {r["doc_id"]: r for r in paragraphs.substring_report(d).collect()}
    assert report[13]["n_removed"] == len(texts[13].split()) - len(out[13].split()) and report[13]["first_docs"] == [12]
    assert report[0]["n_removed"] == 0
    assert paragraphs.remove_repeats(d.limit(0)).count() == 0


def brute_repeats(texts):
    """Words removed by line: a line of five words and more that equals or nearly equals, over links, an earlier one."""
    lines = []
    for i, t in enumerate(texts):
        at = 0
        for part in (t or "").encode().lower().split(b"\n"):
            w = part.split()
            if len(w) >= 5:
                lines.append((i, at, at + len(w), frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))))
            at += len(w)
    group = brute_groups(lines, lambda a, b: len(a[3] & b[3]) >= 0.8 * len(a[3] | b[3]))
    return {(i, k) for j, (i, s, e, _) in enumerate(lines) if group[j] != j for k in range(s, e)}


def test_paragraphs_equal_brute_force(spark):
    """Lines of any length from five words on, near copies with edits anywhere, chains, equal lines of one text."""
    texts = list(AWKWARD)
    for k in range(60):
        rng = random.Random(k)
        own = [prose(rng.choice([4, 5, 6, 9, 14, 24, 30, 80]), 300 + 7 * k + j).split() for j in range(4)]
        old = prose([5, 8, 12, 30, 60][k % 5], 9000 + k % 12).split()
        for _ in range(rng.choice([0, 0, 1])):
            old[rng.randrange(len(old))] = f"edit{k}"
        texts.append("\n".join(" ".join(w) for w in [*own[:2], old, *own[2:], own[0]]))
    d = docs(spark, texts)
    want = brute_repeats(texts)
    got = {(r["doc_id"], k) for r in paragraphs.repeats(d).collect() for x in r["spans"] for k in range(x["start"], x["end"])}
    assert len(want) > 500 and not want - got
    for i, k in got - want:  # only what is repeated word for word over a run of lines or passages
        w = (texts[i] or "").lower().split()
        here = any(" ".join(w[j : j + 10]) in " ".join((t or "").lower().split()) for j in range(max(0, k - 9), k + 1) for t in texts[: i + 1])
        assert here
    small = {r["doc_id"]: r["spans"] for r in paragraphs.repeats(d, bucket_rows=1).collect()}
    assert small == {r["doc_id"]: r["spans"] for r in paragraphs.repeats(d).collect()}


def test_passages_of_fifty_words_are_found_whole(spark):
    texts, where = [], []
    for k in range(120):
        rng = random.Random(k)
        p = [f"p{k}w{rng.randrange(40)}" if k % 3 else f"p{k}w{j % 9}" for j in range(rng.randint(51, 140))]
        for copy in range(2):
            a, b = [f"a{k}x{copy}y{j}" for j in range(rng.randint(0, 90))], [f"b{k}x{copy}y{j}" for j in range(rng.randint(0, 90))]
            texts.append(" ".join(a + p + b))
            where.append((len(a), len(a) + len(p)))
    got = {r["doc_id"]: [(x["start"], x["end"]) for x in r["spans"]] for r in paragraphs.repeats(docs(spark, texts)).collect()}
    for k in range(0, 240, 2):
        s, e = where[k + 1]
        kept = [j for j in range(s, e) if not any(a <= j < b for a, b in got.get(k + 1, []))]
        assert not kept and all(s <= a and b <= e for a, b in got[k + 1]), (k, s, e, got.get(k + 1))
        if (k // 2) % 3:
            assert k not in got


def test_paragraph_tables_with_repeated_and_missing_ids(spark):
    t = prose(60, 5)
    other = prose(50, 6) + "\n"
    d = docs(spark, [t, t, t, other + t, None, prose(40, 7)], [3, None, 3, 4, 3, 3])
    out = sorted((r["doc_id"] or 0, r["text"] or "") for r in paragraphs.remove_repeats(d).collect())
    assert out == sorted([(3, t), (0, t), (3, t), (4, other.strip()), (3, ""), (3, prose(40, 7))])
    assert paragraphs.tune_bands(0.8, 0.998) == 12


def test_suffix_dedup_equals_brute_force(spark):
    p = prose(60, 50)
    texts = AWKWARD + [prose(30, 1) + p + prose(20, 2), prose(15, 3) + p + " " + p[:150], p[50:200], "ab" * 300, "z" + "ab" * 200, "\0" * 250, p + "\0" + p]
    texts += [prose(25, 60 + k) + p[: 100 + 5 * k] for k in range(12)]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    for cap in (1, 20000):
        got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.suffix_dedup(docs(spark, texts), cap).collect()}
        assert got == want
    assert suffixes.suffix_dedup(docs(spark, texts).limit(0)).count() == 0


def test_interval_expansion_finds_all_common_prefixes():
    rng = random.Random(4)
    text = np.array([rng.choice(b"ab") for _ in range(400)] * 2 + [rng.choice(b"abc") for _ in range(300)], np.uint8)
    data = text.tobytes()
    order, starts = suffixes.repeat_classes(text, 60)
    assert sorted(order.tolist()) == list(range(len(text)))
    for x in range(1, len(order)):
        a, b = data[order[x - 1] :][:60], data[order[x] :][:60]
        assert bool(starts[x]) == (not (a == b and len(a) == 60))


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 24))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    for k in range(150):
        v = base[k] + rng.normal(size=24) * 0.1 * rng.random()
        rows.append((300 + k, v.tolist(), k % 3 if k % 7 else (k + 1) % 3))
    rows += [(450, rows[0][1], 0), (451, rows[0][1], 0), (452, [x * 3 for x in rows[0][1]], 0), (453, None, 0), (454, [0.0] * 24, 0), (455, [None, 1.0], 0), (456, [float("nan")] * 24, 0), (457, rows[0][1], None), (458, [1.0], 0), (459, [2.0], 0), (460, [], 0), (461, [float("inf")] * 24, 1)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, label int, class string")
    ok = [r for r in rows if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    vec = {r[0]: np.array(r[1], np.float32).astype(np.float64) for r in ok}
    links = Counter()
    near = {}
    for a in ok:
        for b in ok:
            if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = vec[a[0]], vec[b[0]]
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.98:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    near[a[0], b[0]] = near[b[0], a[0]] = True
    ids = [r[0] for r in rows]
    comp = brute_groups(ids, lambda a, b: (a, b) in near)
    got = {r["vec_id"]: r for r in embeddings.near_vectors(df).collect()}
    assert all(got[i]["n_links"] <= links[i] for i in ids)
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * sum(links.values())
    assert sum(got[i]["component_id"] == ids[c] for i, c in zip(ids, comp)) >= 0.99 * len(ids)
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in ids) and got[453]["n_links"] == 0
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_embeddings_of_doubles_and_of_classes_that_collide(spark, monkeypatch):
    """Doubles beyond the floats' range link by their cosine, and vectors whose class is the same are not copies."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 8))
    x = np.concatenate([base, base * 1e300, base * 1e-300, base + rng.normal(size=base.shape) * 1e-9, base])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)

    def found():
        return [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df).orderBy("vec_id").collect()]

    unit = x / np.abs(x).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (np.arange(200)[:, None] % 2 == np.arange(200) % 2)
    ids = list(range(200))
    comp = brute_groups(ids, lambda a, b: near[a, b])
    want = [(i, int(near[i].sum()) - 1, ids[comp[i]], comp[i] == i) for i in ids]
    assert found() == want and want[40][1:] == (4, 0, False)
    monkeypatch.setattr(embeddings, "_class", lambda: F.pmod(F.xxhash64("label", "v"), F.lit(3)))
    assert found() == want


def test_embeddings_of_a_dense_group_beyond_the_window(spark):
    rng = np.random.default_rng(9)
    center, n = rng.normal(size=32), 9000
    x = np.concatenate([center + rng.normal(size=(n, 32)) * 0.1, rng.normal(size=(600, 32))]).astype(np.float32)
    copies = x[:5]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, copies]))]
    y = np.concatenate([x, copies]).astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= 0.98
    want = near.sum(1) - 1
    assert (want[:n] > 3000).mean() > 0.5 and not near[:n, :n].all()
    got = {r["vec_id"]: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    have = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (np.abs(have - want) <= 1).all() and have.sum() >= 0.999 * want.sum()
    linked = [i for i in range(n) if want[i] > 10]
    assert {got[i]["component_id"] for i in linked} == {min(linked)}


JUNK, FINE = "<p>BUY NOW!! CHEAP$$$ </p>", "<p>Some plain words, and more of them.</p>"


def test_url_filter(spark):
    bad = [(k, f"http://user@host{k % 2}.example.net:80{k}/p/{k}", JUNK if k % 10 else FINE) for k in range(60)]
    odd = [None, "", "no scheme", "HTTP://WWW.Example.ORG/es/1?x#y", "http://example.org", "https://a.b.com/fr/x", "x://com/de/", "http://h.com?q=/de/", "http://a.org/en/1", "http://sub.example.org/en/12", "http://ÀB.Net/Ä", "http://notcom/de/"]
    rows = bad + [(100 + k, u, None) for k, u in enumerate(odd)] + [(200 + k, f"http://casino.example.net/{k}", FINE if k % 20 else JUNK) for k in range(200)]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, html string, verdict string")).collect()}
    rule = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.values()}
    assert rule[100] == rule[101] == rule[102] == ("", "", None, "allow")
    assert rule[103] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert rule[104] == ("example.org", "", None, "allow") and rule[105][2:] == ("com/fr/", "allow") and rule[106] == ("com", "/de/", "com/de/", "block")
    assert rule[107] == ("h.com", "", None, "allow") and rule[108][2:] == ("org/", "allow") and rule[109][2:] == ("example.org/en/1", "block")
    assert rule[110][:2] == ("Àb.net", "/Ä") and rule[111][2] is None
    assert all(rule[k][3] == "block" for k in range(60)) and all(rule[200 + k][3] == "allow" for k in range(200))
    assert rule[1][0] == "user@host1.example.net:801" and got[0]["bad_bound"] > 0.5 > 0.1 > got[200]["bad_bound"] > 0
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_outcomes_and_domains(spark):
    pages = [(JUNK, "/a"), (FINE, "/a"), (FINE, "/a//b"), (None, "/a"), ("", ""), ("<b>OK</b> fine then", "/"), ("a!! b!! c", "/")]
    df = spark.createDataFrame([("h", p, t) for t, p in pages], "host string, path string, html string")
    assert [r["bad"] for r in urls.page_outcomes(df).collect()] == [1, 0, 1, None, 0, 0, 1]
    want = {"a.b.co.uk": ("b.co.uk", "co.uk"), "x.y.example.com": ("example.com", "com"), "com": ("com", ""), "10.0.0.1": ("10.0.0.1", ""), "[::1]": ("[::1]", ""), "": ("", ""), "co.uk": ("co.uk", "uk"), "u:p@a.net:8080": ("a.net", "net"), "a.net.": ("a.net", "net"), "[::1]:80": ("[::1]", "")}
    d = spark.createDataFrame([(h,) for h in want], "host string")
    d = d.withColumn("domain", urls.domain_of(urls.site(F.col("host")))).withColumn("suffix", urls.suffix_of(F.col("domain")))
    assert {r["host"]: (r["domain"], r["suffix"]) for r in d.collect()} == want


def test_url_reputation_by_hand(spark):
    """Two hosts of one domain, four and six pages: rates shrink from the host to what is known of all."""
    rows = [("a.x.com", 1)] * 3 + [("a.x.com", 0)] + [("b.x.com", 0)] * 6 + [("b.x.com", None), (None, 1)]
    got = {r["host"]: r for r in urls.reputation(spark.createDataFrame(rows, "host string, bad long")).collect()}
    p = 3.5 / 11

    def weight(groups):
        v = sum(n * (k / n - p) ** 2 for k, n in groups) / sum(n for _, n in groups)
        return min(1000.0, max(1.0, p * (1 - p) / v - 1)) if v > 0 else 1000.0

    ws, wh = weight([(3, 10)]), weight([(3, 4), (0, 6)])
    s = (3 + ws * p) / (10 + ws)
    d = (3 + ws * s) / (10 + ws)
    for h, k, n in (("a.x.com", 3, 4), ("b.x.com", 0, 6)):
        a, b = k + wh * d, n - k + wh * (1 - d)
        assert (got[h]["n"], got[h]["bad"]) == (n, k)
        assert got[h]["bad_bound"] == pytest.approx(a / (a + b) - urls.Z * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))))
    assert 0.4 < got["a.x.com"]["bad_bound"] + 0.3 and got["b.x.com"]["bad_bound"] < 0.1


def test_media_round_trip(spark):
    d = docs(spark, AWKWARD)
    stored = media.text_media(d)
    got = {r["doc_id"]: r for r in media.describe_media(stored).collect()}
    for i, t in enumerate(AWKWARD):
        b = (t or "").encode()
        p = b + b"\xff" * ((-len(b)) % 576 if b else 576)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert got[0]["media_sha256"] == got[1]["media_sha256"] and got[12]["feature"] == got[13]["feature"]
    assert media.text_media(d.limit(0)).count() == 0
    s = np.random.default_rng(1).integers(0, 256, (3, 576), dtype=np.uint8)
    px = media.pixels(media.encode_frames(s))
    assert (px[:, ::8, ::8].reshape(3, -1) == s).all() and (px[:, 7::8, 7::8].reshape(3, -1) == s).all()


def test_shots_and_clips(spark):
    rng = np.random.default_rng(2)
    scene = lambda n, lo: rng.integers(lo, lo + 40, (n, 576), dtype=np.uint8)
    film = media.write_avi(media.encode_frames(np.concatenate([scene(20, 0), scene(30, 120), scene(10, 200)])))
    rows = media.clips(spark.createDataFrame([(1, bytearray(film), 2), (2, bytearray(b"RIFF?"), 2), (3, None, 2)], "id long, media binary, clip int"), "id").orderBy("clip").collect()
    assert [(r["id"], r["first_frame"], r["frames"], round(r["end_s"], 2)) for r in rows] == [(1, 0, 20, 0.8), (1, 20, 30, 2.0), (1, 50, 10, 2.4)]


def test_pieces_equal_the_library(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    sp = pieces.processor(path)
    texts = AWKWARD + ["  two  spaces   three ", "tab\tline\nend ", "日本語 text", "unbelievable internationalization of tokenizers", "aaaa aaaaaaa aaaaaaaaaaa", "\u2581 mark"]
    got = {r["doc_id"]: list(r["ids"]) for r in pieces.encode(docs(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        if "\u2581" not in (t or ""):
            assert got[i] == sp.encode(t or ""), t
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs(spark, texts[14:19]), path), path).collect()}
    assert back == {i: sp.decode(sp.encode(t)) for i, t in enumerate(texts[14:19])}
    assert pieces.encode(docs(spark, texts).limit(0), path).count() == 0


def test_pieces_of_rare_and_long_words(spark, monkeypatch):
    """Few encodings held in tasks, repeated rows, rows without ids, words cut between letters and others."""
    monkeypatch.setattr(pieces, "FREQUENT", 8)
    path = tokenizer_path("piece_bpe_32k.model")
    sp = pieces.processor(path)
    texts = ["a," + "x" * 300 + "," + "1" * 300 + "!", "aaab" * 2500 + " " + "th" * 5000, "  lead \n  in\n\n out  ", "m² x². 3² ½a a½", "don't e.g. x_y __z 12ab3,cd", "été\u0301s naïve\u00b2.", prose(500, 9) + ", " + prose(9, 8) + ".", None, ""] * 2
    ids = [1, 2, 3, 4, None, None, 7, 8, 9] * 2
    got = sorted((r["doc_id"] or 0, list(r["ids"]), r["n_ids"]) for r in pieces.encode(docs(spark, texts, ids), path).collect())
    assert got == sorted((i or 0, x, len(x)) for i, x in ((i, sp.encode(t or "")) for i, t in zip(ids, texts)))
    monkeypatch.setattr(pieces, "CHUNK", 40)
    for t in texts[:7]:
        cut = pieces.cutter(path)
        words = [w for part in cut.parts([t]) for w in cut.words([s for _, s in part])[0].to_pylist()]
        assert "".join(words) == ("▁" + t.replace(" ", "▁") if t else "")
        assert [i for w in words for i in sp.encode_as_ids("\n" + w)[len(sp.encode("\n")) :]] == sp.encode(t)


def test_words_with_one_path_left_are_not_folded(spark):
    """Pruned until nothing changes, a byte-pair lattice is its path; words still open after one look are folded to the same."""
    path = tokenizer_path("piece_bpe_32k.model")
    sp = pieces.processor(path)
    words = ["▁unbelievable", "internationalization", "a" * 150, "aaab" * 40, "th" * 90, "▁日本x", "", *(w for w in ("▁" + prose(300, 4).replace(" ", " ▁")).split())]
    table = spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "word string").coalesce(1)
    want = {w: sp.encode_as_ids("\n" + w)[len(sp.encode("\n")) :] for w in words}
    lat = pieces.lattice(table, pieces.ordinary_pieces(path), path)
    assert all(r["cells"] is not None and not r["edges"] and len(r["cells"]) == len(r["word"]) for r in lat.collect())
    coded = pieces.encode_words(table, path, 1).collect()
    assert {r["word"]: np.frombuffer(r["ids"], "<i4").tolist() for r in coded} == want
    once = pieces.lattice(table, pieces.ordinary_pieces(path), path, 1)
    assert any(r["cells"] is None and r["edges"] for r in once.collect())
    paths = [pieces.best_paths(pieces.viterbi(x, 16).toArrow()["cells"].combine_chunks()) for x in (lat, once)]
    assert all((x == y).all() for x, y in zip(*paths))


def test_dictionary_is_made_in_bounded_memory(monkeypatch):
    """Words are hashed in parts, on the driver: the same hashes by parts of any size, with little held meanwhile."""
    words = pa.array(["", "a", "é" * 40, "x" * 999, *(f"▁word{i:013}" for i in range(100_000))])
    want = pieces._hashes(words)
    assert len(np.unique(want)) == len(words)
    assert (pieces._hashes(words.slice(2, 500)) == want[2:502]).all() and len(pieces._hashes(words.slice(3, 0))) == 0
    table = pa.table({"word": words, "ids": pa.array([b"\1\0\0\0"] * len(words), pa.binary()), "n": pa.array(range(len(words)), pa.int64())})
    tracemalloc.start()
    known = pieces._Dictionary(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20  # numpy's alone; the table has 4 MB
    assert known.clear and known.places(pa.array(["x", "a", "▁word0000000099999", ""])).tolist() == [-1, len(words) - 2, 0, len(words) - 1]
    monkeypatch.setattr(pieces, "HASHED_BYTES", 50)  # some words are longer
    assert (pieces._hashes(words.slice(0, 2000)) == want[:2000]).all()


def test_unigram_lattice_takes_the_best_path(spark):
    score = {"a": -3.0, "b": -3.0, "ab": -5.0, "ba": -1.0, "aba": -7.0, "c": -2.0}
    table = [(p, i, s) for i, (p, s) in enumerate(score.items())]
    words = ["ababa", "abc", "cab", "b", "aab", "ab" * 90, None, ""]
    lat = pieces.lattice(spark.createDataFrame([(w,) for w in words], "word string"), table)
    names = list(score)

    def best(w):
        top = [0.0]
        for e in range(1, len(w) + 1):
            top.append(max(top[e - k] + score[w[e - k : e]] for k in (1, 2, 3) if k <= e and w[e - k : e] in score))
        return top[-1]

    t = pieces.viterbi(lat, 3).toArrow()
    at, starts, ids = pieces.best_paths(t["cells"].combine_chunks())
    assert len(t) == len(words)
    for k, w in enumerate(t["word"].to_pylist()):
        got = [names[x] for x in ids[at[k] : at[k + 1]]]
        assert "".join(got) == (w or "") and sum(score[p] for p in got) == pytest.approx(best(w or ""))


@pytest.mark.parametrize("slots", [21, 6])
def test_lm(spark, slots):
    """Every context counts; with few slots nearly all pairs go by the joins, with short steps texts go in parts."""
    few = {} if slots == 21 else {"pair_slots": 6, "word_slots": 5, "step": 100}
    texts = AWKWARD + [prose(60, 400 + k) for k in range(60)]
    d = docs(spark, texts)
    got = {r["doc_id"]: r for r in lm.score_documents(d, **few).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    c = Counter(w for i, t in enumerate(texts) if not held(i) for w in [*words(t), b" "])
    n, v = sum(c.values()), len(c)
    trie = Counter()
    for i, t in enumerate(texts):
        if not held(i):
            s = b"\xff" * lm.ORDER + (t or "").encode().lower() + b"\xff"
            for k in range(lm.ORDER, len(s)):
                for o in range(lm.ORDER + 1):
                    trie[s[k - o : k], s[k]] += 1
    size = Counter()
    for (ctx, _), x in trie.items():
        size[ctx] += x

    def ppm(t):
        s, out = b"\xff" * lm.ORDER + (t or "").encode().lower() + b"\xff", 0.0
        for k in range(lm.ORDER, len(s)):
            mass, gone = 1.0, set()
            for o in range(lm.ORDER, -1, -1):
                ctx = s[k - o : k]
                if not size[ctx]:
                    continue
                seen = {b: trie[ctx, b] for b in range(256) if trie[ctx, b] and b not in gone}
                if not seen:
                    continue
                kinds = len(seen) if len(seen) + len(gone) < 256 else 0
                whole = sum(seen.values()) + kinds
                if s[k] in seen:
                    out += math.log10(mass * seen[s[k]] / whole)
                    break
                mass *= kinds / whole
                gone |= set(seen)
            else:
                out += math.log10(mass / (256 - len(gone)))
        return out

    for i, t in enumerate(texts):
        r, w = got[i], [*words(t), b" "]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        if len(w) < 100:
            assert r["score"] == pytest.approx(ppm(t), rel=1e-5)
    if slots == 6:
        return
    assert lm.score_documents(d.limit(0)).count() == 0
    alone = [r for r in lm.score_documents(d.where(F.expr("crc32(cast(cast(doc_id AS string) AS binary)) % 7 = 2"))).collect()]
    assert alone and all(r["n_known"] == r["train_tokens"] == 0 and r["score"] == pytest.approx(-math.log10(256) * (len((texts[r["doc_id"]] or "").encode()) + 1)) for r in alone)
    twins = lm.score_documents(docs(spark, ["a b", "c", "a b"], [8, 8, None])).collect()
    assert [r["n_tokens"] for r in sorted(twins, key=lambda r: r["n_tokens"])] == [2, 3, 3]
    assert lm.adaptive_cost("abab" * 20) > lm.adaptive_cost(prose(14, 3)[:80])


def test_thresholds_by_language():
    rng = random.Random(5)
    counts = Counter((lang, round((rng.gauss(1.5, 1) if y else rng.gauss(-1, 1)) * toxicity.STEPS), y) for lang in ("en", "de") for y in (0, 1) for _ in range(300))
    counts += Counter(("es", 40 * y, y) for y in (0, 1) for _ in range(5))
    rows = [(*k, n) for k, n in counts.items()]
    got = toxicity.calibrated(rows)
    assert set(got) == {None, "en", "de"}

    def f1(lang, t):
        own = [(1 / (1 + math.exp(-s / toxicity.STEPS)) >= t, y, n) for x, s, y, n in rows if lang in (None, x)]
        hit = sum(n for c, y, n in own if c and y)
        return 2 * hit / (sum(n for c, _, n in own if c) + sum(n for _, y, n in own if y))

    for lang, t in got.items():
        assert f1(lang, t) == pytest.approx(max(f1(lang, k / 200) for k in range(1, 200)), abs=0.01)
    assert toxicity.calibrated([]) == {None: 0.5} == toxicity.calibrated([("en", 3, 1, 50)])


def test_classifier_equals_a_plain_convolution():
    """pooled() over chunks against loops over all positions; training moves scores apart."""
    model = toxicity.TextCNN()
    for n in (0, 1, 2, 3, 50):
        ids = toxicity.word_ids(prose(n, n) if n else "")
        x = [model.embed(ids[k : k + 1])[0] for k in range(len(ids))]
        best = model.pooled(ids)
        for w in toxicity.WIDTHS:
            rows = x + [np.zeros(toxicity.DIM, np.float32)] * max(0, w - len(x))
            want = np.max([np.maximum(0, np.concatenate(rows[k : k + w]) @ model.filters[w] + model.bias[w]) for k in range(len(rows) - w + 1)], axis=0)
            assert np.allclose(best[w][0], want, atol=1e-5)
    long = toxicity.word_ids(prose(toxicity.CHUNK + 40, 3))
    a, b = model.pooled(long), [model.pooled(long[s : s + toxicity.CHUNK // 2 + 5]) for s in range(0, len(long), toxicity.CHUNK // 2)]
    for w in toxicity.WIDTHS:
        assert np.allclose(a[w][0], np.max([x[w][0] for x in b], axis=0), atol=1e-5)
    ids, before = toxicity.word_ids("some words of one text"), model.score(toxicity.word_ids("some words of one text"))
    model.fit([ids, toxicity.word_ids("quite other ones")], [1, 0], epochs=20)
    assert model.score(ids) > max(before, 0.6) and model.score(toxicity.word_ids("quite other ones")) < 0.4


def test_a_step_of_training_follows_numeric_gradients():
    """The first Adagrad step is -rate * g / sqrt(0.01 + g * g), from which g comes back."""
    from copy import deepcopy

    model = toxicity.TextCNN()
    for name in ("words", "heads", "out"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    model.filters = {w: f.astype(np.float64) for w, f in model.filters.items()}
    model.bias = {w: b.astype(np.float64) for w, b in model.bias.items()}
    ids = toxicity.word_ids("some words of one text and others")
    before = deepcopy(model)
    model.fit([ids], [1], epochs=1, rate=0.05)

    def loss(m):
        return -0.5 * np.log(m.score(ids))  # the weight of a class that is all there is

    rng, compared = np.random.default_rng(1), 0
    parts = [lambda m: m.out, lambda m: m.words, lambda m: m.heads, *(lambda m, w=w: m.filters[w] for w in toxicity.WIDTHS), *(lambda m, w=w: m.bias[w] for w in toxicity.WIDTHS)]
    for part in parts:
        old, new = part(before), part(model)
        moved = np.argwhere(old != new)
        assert len(moved)
        for at in map(tuple, rng.permutation(moved)[:8]):
            u = (old[at] - new[at]) / 0.05
            found, ends = u * 0.1 / np.sqrt(1 - u * u), []
            for sign in (1, -1):
                m = deepcopy(before)
                part(m)[at] += sign * 1e-5
                ends.append(loss(m))
            assert abs(found - (ends[0] - ends[1]) / 2e-5) < 1e-3 * abs(found) + 1e-5
            compared += 1
    assert compared > 40


def test_an_over_long_text_does_not_stop_learning(spark):
    rng = random.Random(8)
    texts = {k: ("grunk blarf " if k % 2 else "fine words ") * rng.randint(2, 4) for k in range(60)}
    docs = spark.createDataFrame([(k, t if k % 7 else t * 400) for k, t in texts.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in texts], "doc_id long, toxic int")
    model, fitted = toxicity.train(docs, labels, sample_chars=1500)
    own = {r[0] for r in fitted.collect()}
    assert len(own) > 20 and not any(k % 7 == 0 for k in own)
    assert model.score(toxicity.word_ids("grunk blarf grunk")) > 0.5 > model.score(toxicity.word_ids("fine words fine"))


def test_toxicity(spark):
    slurs = ["grunk", "blarf", "snode", "vexil", "quorp"]
    texts, toxic = [], []
    for k in range(500):
        w = prose(60, 7000 + k).split()
        if k % 5 == 0:
            w[k % 60] = slurs[k % 7 % 5]
        texts.append(" ".join(w))
        toxic.append(int(k % 5 == 0))
    d = docs(spark, texts + [None, ""])
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)] + [(None, 0, 1), (500, None, None), (500, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(d, labels).collect()}
    assert len(got) == 502 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i in range(500) if got[i]["held_out"]]
    assert [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(500)] == [got[i]["held_out"] for i in range(500)]
    assert sum(got[i]["predicted"] == toxic[i] for i in held) >= 0.95 * len(held)
    kept = toxicity.keep_clean(d, labels)
    assert kept.columns == d.columns
    left = {r["doc_id"] for r in kept.collect()}
    assert sum(toxic[i] for i in left if i < 500) <= 5 and sum(not toxic[i] for i in left if i < 500) >= 390 and {500, 501} <= left
    odd = toxicity.classify(docs(spark, AWKWARD, [None, 1, 1, *range(3, len(AWKWARD))]), labels.withColumn("toxic", F.lit(None).cast("int"))).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r["score"] <= 1 and r["lang_threshold"] == 0.5 for r in odd)
    assert toxicity.keep_clean(d, labels.limit(0)).count() <= 502 and toxicity.classify(d.limit(0), labels).count() == 0


def test_pipeline_stages_chain(spark, tmp_path):
    import corpus_pipeline

    texts = [prose(120, 8000 + k) for k in range(30)]
    d = docs(spark, [*texts, texts[0], None, ""])
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    cur = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        cur = stage(spark, cur, str(tmp_path))
        assert cur.columns == d.columns, name
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(30)) <= out and 30 not in out
