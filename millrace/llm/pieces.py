"""SentencePiece encoding and decoding by a relational lattice."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import collected, freed_shuffles, materialize, trimmed

SPACE = "▁"
#: Encodings of at most so many words, of at most so many characters each, go to every task, whatever the input's size.
FREQUENT, FREQUENT_CHARS = 1 << 20, 32
#: Different words that a task counts before it hands them on.
HELD_WORDS = 1_000_000
#: Words whose lattices a task builds, about.
TASK_WORDS = 32_000
#: Characters cut into words at once; longer texts are parted before a space.
CHUNK = 1 << 20
#: Positions of a word that one inner fold takes: a fold copies its state at every position.
SEGMENT = 64
#: Bytes of words that are hashed at once, on the driver too.
HASHED_BYTES = 1 << 18
#: Answers about pairs of pieces that a Python worker keeps.
KNOWN_PAIRS = 4_000_000
#: Times that edges of a batch are looked at for neighbours, at most; words that still have a choice then are folded.
LOOKS = 32


def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def ordinary_pieces(path: str) -> list[tuple[str, int, float]]:
    """(piece, id, score) of all ordinary pieces: a table of the model's fixed size."""
    sp = processor(path)
    skip = (sp.is_control, sp.is_byte, sp.is_unknown, sp.is_unused)
    return [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in range(sp.get_piece_size()) if not any(f(i) for f in skip)]


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """ordinary_pieces() as a table."""
    return spark.createDataFrame(ordinary_pieces(path), "piece string, id int, score double")


class Cutter:
    """Cuts texts into words: between two characters that no piece has side by side.

    No piece, hence no merge, crosses such a cut, so words are encoded one by one
    with the same result. No piece has a SPACE after another character, so every
    word of a text is cut off there too.
    """

    def __init__(self, names):
        import numpy as np

        inner = sorted({c for n in names if len(n) > 1 for c in n})
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.side = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for n in names:
            k = self.number[[ord(c) for c in n]]
            self.side[k[:-1], k[1:]] = True
        self.side[0], self.side[:, 0] = False, False
        self.spaced = not any(SPACE in n.lstrip(SPACE) for n in names)

    def parts(self, texts):
        """Texts to lists of (row, string) of about CHUNK characters in all; spaces as SPACE, one before each text; none of empty texts."""
        held, size = [], 0
        for row, text in enumerate(texts):
            s = SPACE + text.replace(" ", SPACE) if text else ""
            while s:
                end = s.rfind(SPACE, 1, CHUNK) if self.spaced and len(s) > CHUNK else len(s)
                while 0 < end < len(s) and s[end - 1] == SPACE:  # runs of spaces stay whole
                    end -= 1
                end = end if end > 0 else len(s)
                held.append((row, s[:end]))
                size, s = size + end, s[end:]
                if size >= CHUNK:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def words(self, strings):
        """(words, counts): all words of the strings in order, as an Arrow array, and how many each string has."""
        import numpy as np
        import pyarrow as pa

        whole = "".join(strings)
        data = whole.encode()
        code = self.number[np.frombuffer(whole.encode("utf-32-le"), np.uint32)]
        cut = np.ones(len(code), bool)
        cut[1:] = ~self.side[code[:-1], code[1:]]
        first = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
        cut[first[:-1]] = True
        lead = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        offsets = np.concatenate((lead[cut], [len(data)])).astype(np.int32)
        words = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
        before = np.concatenate(([0], np.cumsum(cut)))
        return words, np.diff(before[first])


@lru_cache(maxsize=2)
def cutter(path: str) -> Cutter:
    return Cutter([p for p, _, _ in ordinary_pieces(path)])


class Merges:
    """Which pieces may stand side by side in a byte-pair encoding.

    Two pieces may if encoding what they spell gives the two again. That fails if,
    while both are put together, some end of the one and some beginning of the other
    would have merged first: their merge's score beats that of the merge which next
    takes either of them up; on a tie the left one goes first.
    """

    def __init__(self, pieces: dict[str, float]):
        import numpy as np

        self.score = pieces
        self.parts: dict[str, tuple] = {}
        self.sides: dict[tuple, list] = {}
        self.asked, self.answer = np.empty(0, np.int64), np.empty(0, bool)

    def split(self, piece: str):
        """The two pieces that merged to this one; none for a character."""
        if len(piece) < 2:
            return None
        if piece not in self.parts:
            tokens = list(piece)
            last = None
            while len(tokens) > 1:
                best = max(((self.score.get(a + b, -1e30), -k) for k, (a, b) in enumerate(zip(tokens, tokens[1:]))))
                k = -best[1]
                last = (tokens[k], tokens[k + 1])
                tokens[k : k + 2] = ["".join(last)]
            self.parts[piece] = last
        return self.parts[piece]

    def side(self, piece: str, last: int) -> list:
        """The tokens at a piece's end (last = 1) or beginning (0) on the way to it, each with the score of the merge that takes it up."""
        if (piece, last) not in self.sides:
            out, x, until = [], piece, -1e30
            while True:
                out.append((x, until))
                if not (p := self.split(x)):
                    break
                until, x = self.score[x], p[last]
            self.sides[piece, last] = out
        return self.sides[piece, last]

    def allowed(self, a: str, b: str) -> bool:
        heads, score = self.side(b, 0), self.score
        for x, ux in self.side(a, 1):
            for y, uy in heads:
                s = score.get(x + y)
                if s is not None and s >= uy and s > ux:
                    return False
        return True

    def known(self, pairs, names):
        """allowed() of sorted pairs ((a + 1) << 32 | b + 1, by id; an id of -1 goes with any); answers are kept as arrays."""
        import numpy as np

        at = np.minimum(np.searchsorted(self.asked, pairs), max(0, len(self.asked) - 1))
        old = self.asked[at] == pairs if len(self.asked) else np.zeros(len(pairs), bool)
        out = np.zeros(len(pairs), bool)
        out[old] = self.answer[at[old]]
        new = pairs[~old]
        if len(new):
            ids = [((c >> 32) - 1, (c & 0xFFFFFFFF) - 1) for c in new.tolist()]
            got = np.array([a < 0 or b < 0 or self.allowed(names[a], names[b]) for a, b in ids], bool)
            out[~old] = got
            if len(self.asked) > KNOWN_PAIRS:
                self.asked, self.answer = new, got
            else:
                place = np.searchsorted(self.asked, new)
                self.asked, self.answer = np.insert(self.asked, place, new), np.insert(self.answer, place, got)
        return out


@lru_cache(maxsize=2)
def _merges(path: str):
    """Piece names by id, and a worker's Merges."""
    return {i: p for p, i, _ in ordinary_pieces(path)}, Merges({p: s for p, _, s in ordinary_pieces(path)})


class Joiner:
    """The piece table, sorted by length and hash: what substrings are joined with."""

    MUL = 0x9E3779B97F4A7C15

    def __init__(self, pieces):
        import numpy as np

        self.longest = max((len(p) for p, _, _ in pieces), default=1)
        self.tables = {}
        for n in range(1, self.longest + 1):
            own = [x for x in pieces if len(x[0]) == n]
            if own:
                codes = np.array([[ord(c) for c in p] for p, _, _ in own], np.uint64)
                h = self.start(codes[:, 0])
                for j in range(1, n):
                    h = self.longer(h, codes[:, j])
                order = np.argsort(h)
                ids, scores = np.array([i for _, i, _ in own], np.int32), np.array([s for _, _, s in own])
                self.tables[n] = (h[order], codes[order].astype(np.uint32), ids[order], scores[order])

    def start(self, c):
        import numpy as np

        return (c.astype(np.uint64) + np.uint64(1)) * np.uint64(self.MUL)

    def longer(self, h, c):
        import numpy as np

        return (h ^ (h >> np.uint64(29))) * np.uint64(self.MUL) + c.astype(np.uint64)

    def edges(self, code, last):
        """Characters of words laid end to end, and where the word of each ends, to (end, length, id, score) by end and length.

        Substrings of every length that stay in their word are hashed and looked up among
        the pieces of that length; a hit's characters are compared. A character that is
        no piece gets an edge with id -1.
        """
        import numpy as np

        n, out = len(code), []
        at, h = np.arange(n), self.start(code)
        for size in range(1, self.longest + 1):
            if size > 1:
                stay = at + size <= last[at]
                at = at[stay]
                h = self.longer(h[stay], code[at + size - 1])
            if size not in self.tables:
                if size == 1:
                    out.append((at + 1, np.full(n, 1), np.full(n, -1, np.int32), np.full(n, -1e6)))
                continue
            hashes, codes, ids, scores = self.tables[size]
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[k] == h
            for j in range(size):
                hit[hit] = codes[k[hit], j] == code[at[hit] + j]
            if size == 1:
                out.append((at + 1, np.full(n, 1), np.where(hit, ids[k], -1).astype(np.int32), np.where(hit, scores[k], -1e6)))
            else:
                out.append((at[hit] + size, np.full(int(hit.sum()), size), ids[k[hit]], scores[k[hit]]))
        end, length, ids, scores = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(end * 64 + length, kind="stable")
        return end[order], length[order], ids[order], scores[order]


def _before(end, length, ids, first, last, names, merges, looks):
    """For edges by end: (edge, edge before) of all that may stand side by side, and which edges may be on a path.

    first, last: where an edge's word begins and ends. An edge is left out if nothing
    allowed comes before it, or nothing allowed after it, until all others have both
    (they are then on a path), or `looks` times.
    """
    import numpy as np

    start = end - length
    lo, hi = np.searchsorted(end, start, "left"), np.searchsorted(end, start, "right")
    n = np.where(start > first, hi - lo, 0)
    at = np.repeat(np.arange(len(end)), n)
    prev = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    pairs, which = np.unique((ids[prev].astype(np.int64) + 1 << 32) | (ids[at].astype(np.int64) + 1), return_inverse=True)
    keep = merges.known(pairs, names)[which] if len(at) else np.zeros(0, bool)
    at, prev, alive, left = at[keep], prev[keep], np.ones(len(end), bool), len(end)
    for _ in range(looks):
        for here, there, edge in ((at, prev, start == first), (prev, at, end == last)):
            edge[here[alive[there]]] = True
            alive &= edge
        keep = alive[at] & alive[prev]
        at, prev, now = at[keep], prev[keep], int(alive.sum())
        if now == left:
            break
        left = now
    return at, prev, alive


EDGES = "array<array<array<struct<length:int,id:int,score:double,prev:array<int>>>>>"


def lattice(vocabulary: DataFrame, pieces: list[tuple[str, int, float]], path: str | None = None, looks: int = LOOKS) -> DataFrame:
    """vocabulary(word) to (word, edges, cells): its lattice by end position, in segments of SEGMENT positions.

    Every substring of up to the longest piece's characters is made and joined with
    pieces (piece, id, score), in columns of a batch of words; its edges are grouped
    by word and end. path: of a byte-pair model, whose edges also hold the ids that may
    stand before (prev); else null. Null and empty words have no edges. A word whose
    edges are one path, as those that are left spell it just once, has these as the
    cells of viterbi() and no edges; others have no cells.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        joiner = Joiner(pieces)
        names, merges = _merges(path) if path else (None, None)
        offsets = lambda n: pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
        for b in batches:
            ws = [w or "" for w in b.column(0).to_pylist()]
            size = np.array([len(w) for w in ws], np.int64)
            code = np.frombuffer("".join(ws).encode("utf-32-le"), np.uint32)
            ends = np.cumsum(size)
            end, length, ids, scores = joiner.edges(code, np.repeat(ends, size))
            if path:
                word = np.repeat(np.arange(len(size)), size)
                of = word[end - 1]
                at, prev, alive = _before(end, length, ids, (ends - size)[of], ends[of], names, merges, looks)
                many = np.bincount(of[alive], length[alive], len(size)) != size
                own = alive & ~many[of]
                step, piece = np.zeros(len(code), np.int32), np.zeros(len(code), np.int32)
                step[end[own] - 1], piece[end[own] - 1] = length[own], ids[own]
                alone = ~many[word]
                cells = pa.StructArray.from_arrays([pa.array(step[alone]), pa.array(piece[alone])], ["length", "id"])
                cells = pa.ListArray.from_arrays(offsets(np.where(many, 0, size)), cells, mask=pa.array(many))
                alive, keep = alive & many[of], many[of[at]]
                at, prev = at[keep], prev[keep]
                before = pa.ListArray.from_arrays(offsets(np.bincount(at, minlength=len(end))[alive]), pa.array(ids[prev], pa.int32()))
                end, length, ids, scores = (end - np.concatenate(([0], np.cumsum(alone)))[end])[alive], length[alive], ids[alive], scores[alive]
                code, size = code[~alone], np.where(many, size, 0)
            else:
                before, cells = pa.nulls(len(end), pa.list_(pa.int32())), pa.nulls(len(b), pa.list_(pa.struct([("length", pa.int32()), ("id", pa.int32())])))
            edge = pa.StructArray.from_arrays([pa.array(length, pa.int32()), pa.array(ids, pa.int32()), pa.array(scores, pa.float64()), before], ["length", "id", "score", "prev"])
            by_end = pa.ListArray.from_arrays(offsets(np.bincount(end - 1, minlength=len(code))), edge)
            rows = (size + SEGMENT - 1) // SEGMENT
            full = np.full(int(rows.sum()), SEGMENT)
            full[np.cumsum(rows)[rows > 0] - 1] = (size - (rows - 1) * SEGMENT)[rows > 0]
            segments = pa.ListArray.from_arrays(offsets(full), by_end)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets(rows), segments), cells], ["word", "edges", "cells"])

    return vocabulary.select("word").mapInArrow(trimmed(run), f"word string, edges {EDGES}, cells array<struct<length:int,id:int>>")


def viterbi(lattices: DataFrame, longest: int) -> DataFrame:
    """(word, cells): for every end position the length and id of the last edge of the best path to it; cells that the lattice has stay.

    A fold over the end positions keeps the best score, and the edge that reaches it, of
    paths whose neighbours are allowed. It runs over segments, of which the next one
    sees the last `longest` cells, so that its state stays short in words of any length.
    """
    cell = "struct<score:double,length:int,id:int>"

    def reach(cells, edges):
        def score(x):
            c = F.get(cells, F.size(cells) - x["length"])
            ok = x["prev"].isNull() | (c["length"] == 0) | F.array_contains(x["prev"], c["id"])
            best = F.struct((c["score"] + x["score"]).alias("score"), x["length"].alias("length"), x["id"].alias("id"))
            return F.when(ok & c["score"].isNotNull(), best)

        return F.concat(cells, F.array(F.array_max(F.transform(edges, score)).cast(cell)))

    def segment(state, ends):
        cells = F.aggregate(ends, state["tail"], reach)
        mine = F.transform(F.slice(cells, F.size(state["tail"]) + 1, F.size(ends)), lambda c: F.struct(c["length"].alias("length"), c["id"].alias("id")))
        tail = F.slice(cells, F.greatest(F.lit(1), F.size(cells) - longest + 1), F.lit(longest))
        return F.struct(tail.alias("tail"), F.concat(state["done"], F.array(mine)).alias("done"))

    kind = f"struct<tail:array<{cell}>,done:array<array<struct<length:int,id:int>>>>"
    start = F.expr(f"CAST(named_struct('tail', array(named_struct('score', 0D, 'length', 0, 'id', -2)), 'done', array()) AS {kind})")
    folded = F.flatten(F.aggregate("edges", start, lambda s, e: segment(s, e).cast(kind))["done"])
    return lattices.select("word", F.when(F.col("cells").isNull(), folded).otherwise(F.col("cells")).alias("cells"))


def best_paths(cells):
    """The ids of a batch's best paths, from their ends back: (offsets, starts, ids), starts in characters of a word."""
    import numpy as np

    sizes = np.asarray(cells.value_lengths().fill_null(0))
    flat = cells.flatten()
    length, ids = (np.asarray(x.fill_null(0)) for x in flat.flatten())
    ends = np.cumsum(sizes)
    pos, word, begin = ends.copy(), np.arange(len(sizes)), ends - sizes
    found = []
    while len(word):
        alive = pos > begin[word]
        pos, word = pos[alive], word[alive]
        if not len(word):
            break
        step = length[pos - 1]
        found.append((word, pos - step - begin[word], ids[pos - 1]))
        pos = pos - step
    if not found:
        return np.zeros(len(sizes) + 1, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
    word, start, ids = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(word * (1 << 32) + start)
    return np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(sizes))))), start[order], ids[order]


def encode_words(vocabulary: DataFrame, path: str, n_words: int) -> DataFrame:
    """vocabulary(word), distinct, of about n_words rows, to (word, ids): ids as little-endian 32-bit numbers.

    A character that is no piece becomes its UTF-8 bytes' pieces.
    """
    pieces = ordinary_pieces(path)

    def ids(batches):
        import numpy as np
        import pyarrow as pa

        sp = processor(path)
        bytes_ = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        for b in batches:
            at, start, found = best_paths(b.column(1))
            found = found.astype("<i4")
            raw, offsets = found.tobytes(), (at * 4).astype(np.int32)
            if (found < 0).any():
                ws, out = b.column(0).to_pylist(), []
                for k, w in enumerate(ws):
                    own = found[at[k] : at[k + 1]]
                    if (own < 0).any():
                        own = np.array([y for s, x in zip(start[at[k] : at[k + 1]].tolist(), own.tolist()) for y in ([x] if x >= 0 else [bytes_[c] for c in w[s].encode()])], "<i4")
                    out.append(own.tobytes())
                raw, offsets = b"".join(out), np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
            coded = pa.BinaryArray.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([b.column(0), coded], ["word", "ids"])

    dealt = vocabulary.repartition(n_words // TASK_WORDS + 1, "word")
    longest = max((len(p) for p, _, _ in pieces), default=1)
    return viterbi(lattice(dealt, pieces, path), longest).mapInArrow(trimmed(ids), "word string, ids binary")


def _counted(path: str):
    """Texts to (word, n): partial counts, handed on when they are many."""

    def run(batches):
        import pyarrow as pa

        cut, held, rows = cutter(path), [], 0

        def merged():
            t = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            return pa.table({"word": t["word"], "n": t["n_sum"]})

        for b in batches:
            for part in cut.parts(b.column(0).to_pylist()):
                words, _ = cut.words([s for _, s in part])
                seen = words.value_counts()
                held.append(pa.table({"word": seen.field(0), "n": seen.field(1)}))
                rows += len(seen)
            if rows > 2 * HELD_WORDS:
                held = [merged()]
                rows = len(held[0])
                if rows > HELD_WORDS:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from merged().to_batches()

    return run


def _frequent(vocabulary: DataFrame) -> DataFrame:
    """vocabulary(word, n) with a flag for at most FREQUENT words of the highest counts, all short."""
    step = F.floor(F.log2("n") * 4).cast("int")
    held, least = 0, None
    for r in sorted(vocabulary.where(F.length("word") <= FREQUENT_CHARS).groupBy(step.alias("b")).count().collect(), reverse=True):  # at most 256 rows
        held += r["count"]
        if held > FREQUENT:
            break
        least = r["b"]
    flag = (F.length("word") <= FREQUENT_CHARS) & (step >= least) if least is not None else F.lit(False)
    return vocabulary.withColumn("frequent", flag)


def _hashes(words):
    """A 64-bit hash of each of an Arrow array of strings, made in parts of HASHED_BYTES: each byte takes some ten numbers of 64 bits meanwhile."""
    import numpy as np

    n = len(words)
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8) if n and at[-1] > at[0] else np.empty(0, np.uint8)
    salt = np.random.default_rng(6).integers(1 << 63, size=256, dtype=np.uint64)
    out, first = np.empty(n, np.uint64), 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, int(at[first]) + HASHED_BYTES, "right")) - 1)  # a longer word is a part of its own
        own = at[first : last + 1].astype(np.int64) - int(at[first])
        size, x = np.diff(own), data[at[first] : at[last]].astype(np.uint64)
        place = np.arange(len(x)) - np.repeat(own[:-1], size)
        x = (x + np.uint64(1) + salt[place & 255]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        total = np.concatenate(([np.uint64(0)], np.cumsum(x * np.uint64(0xD6E8FEB86659FD93), dtype=np.uint64)))
        out[first:last] = (total[own[1:]] - total[own[:-1]]) ^ size.astype(np.uint64)
        first = last
    return out


class _Dictionary:
    """The frequent words' encodings as Arrow and numpy arrays, the commonest first."""

    def __init__(self, table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        t = table.select(["word", "ids"]).take(pc.sort_indices(table, [("n", "descending"), ("word", "ascending")])).combine_chunks()
        coded = t["ids"].combine_chunks() if len(t) else pa.array([], pa.binary())
        coded = coded if isinstance(coded, pa.Array) else coded.chunk(0)
        words = t["word"].combine_chunks() if len(t) else pa.array([], pa.string())
        self.words = words if isinstance(words, pa.Array) else words.chunk(0)
        at = np.frombuffer(coded.buffers()[1], np.int32)[coded.offset : coded.offset + len(coded) + 1] // 4 if len(coded) else np.zeros(1, np.int32)
        self.size, self.start = np.diff(at), at[:-1] - at[0]
        self.ids = np.frombuffer(coded.buffers()[2], "<i4")[at[0] : at[-1]].copy() if at[-1] > at[0] else np.empty(0, "<i4")
        h = _hashes(self.words)
        self.by_hash = np.argsort(h).astype(np.int32)
        self.hashes = h[self.by_hash]
        self.clear = bool((self.hashes[1:] != self.hashes[:-1]).all())

    def places(self, words):
        """Every word's place, or -1."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.clear or not len(self.words):  # two words share a hash
            return np.asarray(pc.index_in(words, value_set=self.words).fill_null(-1)).astype(np.int64)
        h = _hashes(words)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        place = self.by_hash[at].astype(np.int64)
        hit = self.hashes[at] == h
        place[hit] = np.where(np.asarray(pc.equal(self.words.take(pa.array(place[hit])), words.filter(pa.array(hit)))), place[hit], -1)
        return np.where(hit, place, -1)

    def codes(self, cut, part):
        """(rows' counts, code of every word, rare words): a word's code is its place here, or len(self.words) plus its place among the rare ones."""
        import numpy as np
        import pyarrow as pa

        words, counts = cut.words([s for _, s in part])
        d = words.dictionary_encode()
        known = self.places(d.dictionary)
        rare = known < 0
        known[rare] = len(self.words) + np.arange(int(rare.sum()))
        return counts, known[np.asarray(d.indices)], d.dictionary.filter(pa.array(rare))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) to (doc_id, ids, n_ids) as the model's library gives them; a row for each, null and empty texts without ids.

    Every different word is encoded once, by its lattice. The encodings of the most
    frequent words, bounded in number and length, go to every task, which turns a
    text into their numbers; those of its other words are found by a join and come
    to it by its key. A key shared by different texts is harmless, as encodings are
    looked up by word.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = d.select("text").mapInArrow(trimmed(_counted(path)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = _frequent(materialize(counted))
    n_common, n_words = vocabulary.agg(F.count_if("frequent"), F.count("*")).first()
    frequent = encode_words(vocabulary.where("frequent").select("word"), path, n_common)
    order = vocabulary.where("frequent").select("word", "n")
    collected(spark)
    with freed_shuffles(spark):
        held = spark.sparkContext.broadcast(_Dictionary(frequent.join(order, "word").select("word", "ids", "n").toArrow()))  # at most FREQUENT short words
    collected(spark)
    coded = encode_words(vocabulary.where("NOT frequent").select("word"), path, n_words - n_common)
    keyed = d.withColumn("key", F.xxhash64("doc_id", "text"))

    def rare(batches):
        import numpy as np
        import pyarrow as pa

        cut, known = cutter(path), held.value
        for b in batches:
            keys = np.asarray(b.column(0))
            for part in cut.parts(b.column(1).to_pylist()):
                counts, codes, names = known.codes(cut, part)
                row = np.repeat([r for r, _ in part], counts)
                far = codes >= len(known.words)
                both = np.unique(row[far] * (1 << 32) + codes[far] - len(known.words))
                yield pa.RecordBatch.from_arrays([pa.array(keys[both >> 32], pa.int64()), names.take(pa.array(both & 0xFFFFFFFF))], ["key", "word"])

    def packed(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        cut, known, z = cutter(path), held.value, zstandard.ZstdCompressor(level=3)
        base = len(known.words)
        for b in batches:
            n = len(b)
            codes, names = [[] for _ in range(n)], [[] for _ in range(n)]
            for part in cut.parts(b.column(2).to_pylist()):
                counts, got, rare_words = known.codes(cut, part)
                far = got >= base
                row = np.repeat([r for r, _ in part], counts)[far]
                both, at = np.unique(row * (1 << 32) + got[far] - base, return_inverse=True)
                first = np.searchsorted(both >> 32, np.arange(n + 1))
                got[far] = base + np.array([len(x) for x in names], np.int64)[row] + at - first[row]
                own = rare_words.take(pa.array(both & 0xFFFFFFFF)).to_pylist()
                for r in {r for r, _ in part}:
                    names[r] += own[first[r] : first[r + 1]]
                ends = np.cumsum(counts)
                for (r, _), s, e in zip(part, ends - counts, ends):
                    codes[r].append(got[s:e])
            out = []
            for own in codes:
                c = np.concatenate(own).astype("<u4") if own else np.empty(0, "<u4")
                out.append(z.compress(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 4).T).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary()), pa.array(names, pa.list_(pa.string()))], ["doc_id", "key", "packed", "names"])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        known, z = held.value, zstandard.ZstdDecompressor()
        base = len(known.words)
        for b in batches:
            out = []
            for raw, names, more in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                c = np.ascontiguousarray(np.frombuffer(z.decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
                own = {x["word"]: x["ids"] for x in more or ()}
                tail = [own[w] for w in names]
                n = np.array([len(x) // 4 for x in tail], np.int64)
                far = c >= base
                size, first = np.empty(len(c), np.int64), np.empty(len(c), np.int64)
                size[~far], first[~far] = known.size[c[~far]], known.start[c[~far]]
                size[far], first[far] = n[c[far] - base], (np.cumsum(n) - n)[c[far] - base]
                at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                if far.any():
                    there, got = np.repeat(far, size), np.empty(len(at), "<i4")
                    got[there], got[~there] = np.frombuffer(b"".join(tail), "<i4")[at[there]], known.ids[at[~there]]
                else:
                    got = known.ids[at]
                out.append(got)
            sizes = np.array([len(x) for x in out], np.int64)
            flat = np.concatenate([np.empty(0, "<i4"), *out])
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(sizes, pa.int64())], ["doc_id", "ids", "n_ids"])

    found = keyed.select("key", "text").mapInArrow(trimmed(rare), "key long, word string").join(coded, "word")
    own = found.groupBy("key").agg(F.collect_set(F.struct("word", "ids")).alias("own"))
    texts = keyed.select("doc_id", "key", "text").mapInArrow(trimmed(packed), "doc_id long, key long, packed binary, names array<string>")
    joined = texts.join(own, "key", "left").select("doc_id", "packed", "names", "own")
    return joined.mapInArrow(trimmed(run), "doc_id long, ids array<int>, n_ids long")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """coded(doc_id, ids) to (doc_id, text); null ids, like none, give an empty text."""

    def run(batches):
        import pyarrow as pa

        sp = processor(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sp.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
