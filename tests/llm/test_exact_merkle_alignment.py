"""Exact dedup, Merkle manifest and token alignment against plain versions, with awkward rows and small limits."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import alignment, exact, merkle
from millrace.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, local long, row long, n long, idx long, tree string, hash long, kept string, pairs string, proof string, own long"
WORDS = random.Random(4).choices("the of Ende niño naïve straße token 漢字 🙂 x1 3.14 don't [a] <b>".split(), k=300)
PROSE = [" ".join(random.Random(k).choices(WORDS, k=k)) for k in (3, 40, 400)]
TEXTS = [None, "", " ", "\n\t\x0b\x0c\r ", "a", "a ", " a", "A", "ab", "a b", "a b", "a\0b", "é" * 50, "é", "x" * 20000, " lead", "two  spaces", "trail ", "tab\tand\nline", "<|endoftext|>", "<s> </s> <0x41> <unk>", "▁under", *PROSE, *PROSE, PROSE[1].replace(" ", "\n"), PROSE[2] + "  "]


def table(spark, rows, parts=3):
    """rows of (doc_id, text[, lang]) with columns named as the operators' own."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), 1, 2, 3, 4, "t", 5, "k", "p", "q", 6) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


# -- exact dedup


def test_trie_holds_what_was_put_in_and_spills_whole_subtrees():
    rng = random.Random(1)
    words = ["".join(rng.choices("ab", k=rng.randint(0, 12))).encode() for _ in range(2000)]
    t = exact.Trie(1 << 30)
    for w in words:
        node = t.node(w)
        node[2] = (node[2] or 0) + 1
    assert dict(t.all()) == Counter(words)
    edges = [t.root]
    while edges:
        node = edges.pop()
        assert node is t.root or node[0] and (node[2] is not None or len(node[1]) > 1)  # compressed
        edges += node[1].values()
    t.limit = t.size
    out = dict(t.spill(True))
    assert out and t.size <= t.limit // 2 and not out.keys() & dict(t.all()).keys() and out | dict(t.all()) == Counter(words)
    assert all(t.node(w) is None for w in out)
    one = exact.Trie(10)
    one.node(b"a long single text")[2] = 1
    assert not list(one.spill(True)) and one.node(b"a long single text")[2] == 1


def plain_groups(rows):
    squeezed = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for r in rows:
        groups.setdefault(squeezed(r[1]), []).append(r)
    out = []
    for s, g in groups.items():
        key = lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)
        best = min(g, key=key)
        kept = [r for r in g if key(r) == key(best)]
        for r in g:
            out.append((r[0], best[0], len(g), r is kept[0], hashlib.sha256(s.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("limit, carriers", [(exact.TRIE_BYTES, 256), (4000, 256), (3000, 2)])
def test_exact_groups_equal_brute_force(spark, limit, carriers):
    rng = random.Random(7)
    texts = TEXTS * 2 + rng.choices([f"w{k} " * (k % 9) for k in range(30)], k=200) + ["hot text"] * 150 + [" hottext"] * 40
    rows = [(rng.choice([k, k, k, None, 3]) if k % 10 == 0 else k, t) for k, t in enumerate(texts)]
    got = exact.exact_groups(table(spark, rows, 6), limit, carriers)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    show = lambda x: sorted(map(repr, x))
    assert show(map(tuple, got.collect())) == show(plain_groups(rows))


def test_exact_dedup_of_docs_and_of_none(spark):
    d = table(spark, [(1, "a b"), (2, "ab "), (3, "c"), (4, "a  b")])
    assert sorted(r["doc_id"] for r in exact.exact_dedup(d).collect()) == [3, 4] and exact.exact_dedup(d).columns == d.columns
    assert exact.exact_groups(d.limit(0)).count() == 0
    assert {t.simpleString() for t in (f.dataType for f in exact.exact_groups(d).schema)} == {"bigint", "boolean", "string"}


# -- Merkle manifest


def plain_manifest(rows, fanout=8):
    H = lambda s: hashlib.sha256(s.encode()).hexdigest()
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t: H("".join(map(f, (d[0], d[3], d[2], d[4], t))))

    def build(level):
        """(root, siblings of each node as (left, right) level by level)."""
        own, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for k, a in enumerate(at):
                run = a // fanout * fanout
                own[k].append(("".join(level[run:a]), "".join(level[a + 1 : run + fanout])))
            level, at = ["".join(level[k : k + fanout]) for k in range(0, len(level), fanout)], [a // fanout for a in at]
            level = list(map(H, level))
        return level[0], own

    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for x in order:
        langs[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        subs[x] = build([leaf(r, r[1]) for r in langs[x]])
    root, above = build([subs[x][0] for x in order])
    out = []
    for x, up in zip(order, above):
        sub, own = subs[x]
        for r, proof in zip(langs[x], own):
            proof = proof + up
            t = r[1]
            if t is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
            h = leaf(r, t)
            for a, b in proof:
                h = H(a + h + b)
            out.append((r[0], leaf(r, r[1]), sub, root, H("".join(a + b for a, b in proof)), h, h == root))
    return out


def test_manifest_equals_a_plain_tree(spark):
    rng = random.Random(9)
    texts = (TEXTS + ["Upper A", "É", "lower"]) * 8
    rows = [(k if k % 11 else rng.choice([None, 5, k]), t, rng.choices(["en", "de", None, "", "fr-é", "zh"], [60, 9, 8, 1, 3, 1])[0]) for k, t in enumerate(texts)]
    rows += [(7, "Same Row", "en")] * 70  # more than a level's run of equal leaves
    d = table(spark, rows, 5)
    full = [tuple(r)[:5] for r in d.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    want = plain_manifest(full)
    got = [tuple(r) for r in merkle.audit(d).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("rows", [[(3, "ABC", None)], [(k, "T", f"l{k}") for k in range(10)]])
def test_small_manifests(spark, rows):
    d = table(spark, rows, 2)
    want = plain_manifest([tuple(r) for r in d.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    assert sorted(map(repr, (tuple(r) for r in merkle.audit(d).collect()))) == sorted(map(repr, want))


def test_manifest_of_nothing_and_its_proofs(spark):
    d = table(spark, [(k, f"Text {k}", "en" if k % 3 else "de") for k in range(80)])
    assert merkle.audit(d.limit(0)).count() == 0
    m = merkle.manifest(d)
    assert m.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert {len(r["proof"]) for r in m.collect()} == {3}  # 27 and 53 leaves: two levels each, and the langs' one
    changed = merkle.manifest(d.withColumn("text", F.when(F.col("doc_id") == 5, "other").otherwise(F.col("text"))))
    assert changed.first()["root"] != m.first()["root"]


# -- alignment


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(tokenizer_path())
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}

    def b_bytes(i):
        p = b_tok.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) and b_tok.is_byte(i) else p.replace("▁", " ").encode()

    found = []
    for doc, text in (r[:2] for r in rows):
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        ab, bb = [bytes(byte[c] for c in a_tok.id_to_token(i)) for i in a], [b_bytes(i) for i in b]
        if text and not (b"".join(ab) == b"".join(bb) == (" " + text).encode()):
            a, b, ab, bb = [], [], [], []
        spans = lambda x: [(sum(map(len, x[:k])), sum(map(len, x[: k + 1]))) for k in range(len(x))]
        sa, sb = spans(ab), spans(bb)
        links = [(a[i], b[j]) for i, (s, e) in enumerate(sa) for j, (t, f) in enumerate(sb) if s < f and t < e]
        both, groups = sorted({e for _, e in sa} & {e for _, e in sb}), []
        for s, e in zip([0, *both], both):
            groups.append((s, e, [a[k] for k, (x, y) in enumerate(sa) if s <= x and y <= e], [b[k] for k, (x, y) in enumerate(sb) if s <= x and y <= e]))
        found.append((doc, a, b, groups, links))
    counts = Counter(p for *_, links in found for p in set(links))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for doc, a, b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for _, _, x, y in groups)
        out.append((doc, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out, found


@pytest.mark.parametrize("held", [alignment.HELD_PAIRS, 40, 0])
def test_alignment_equals_the_libraries(spark, monkeypatch, held):
    texts = [t if t is None or len(t) < 3000 else t[:3000] for t in TEXTS] + ["Cross-tokenizer ALIGNMENT 12345 …", "naïve café", "  ", "\n", "日本語のテキスト"]
    rows = [(k if k % 7 else None if k % 2 else 3, t) for k, t in enumerate(texts)]
    monkeypatch.setattr(alignment, "ALIGN_BYTES", 2000)
    paths = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
    want, _ = plain_alignment(rows)
    got = alignment.alignment(table(spark, rows), *paths, held=held)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert alignment.alignment(table(spark, rows).limit(0), *paths, held=held).count() == 0


def test_token_groups_and_their_products(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS[:14] + PROSE[:2])]
    _, found = plain_alignment(rows)
    g = alignment.token_groups(table(spark, rows), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    want = sorted((doc, k, s, e, a, b) for doc, _, _, groups, _ in found for k, (s, e, a, b) in enumerate(groups))
    assert sorted(map(tuple, g.collect())) == want
    products = sorted((doc, k, i, j) for doc, k, _, _, a, b in want for i in a for j in b)
    assert sorted(map(tuple, alignment.group_products(g).collect())) == products


def test_task_counts_of_pairs_are_added_up(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(alignment, "TASK_PAIRS", 50)
    rng = random.Random(2)
    docs = [sorted(rng.sample(range(90), 12)) for _ in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array([np.array(d, "<i4").tobytes() for d in docs[k : k + 7]], pa.binary())], ["pairs"]) for k in range(0, 60, 7)]
    got = Counter()
    for b in alignment._pair_counts("<i4")(iter(batches)):
        got.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    assert got == Counter(x for d in docs for x in d)
