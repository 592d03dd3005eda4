"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, sized, trimmed

#: Hash buckets of words and of their first letters; embedding width; filter widths; filters of each.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 12, (1, 2, 3), 12
#: Labelled documents that the classifier is fitted on, at most.
SAMPLE_ROWS = 6000
#: Characters of their texts in all, at most: the driver holds them as numbers.
SAMPLE_CHARS = 64_000_000
#: Steps of a logit in which scores are counted, and the largest logit.
STEPS, LARGEST = 20, 30
#: Words scored at a time.
CHUNK = 1 << 15


def word_ids(text: str | None):
    """(n, 2) buckets of each word, A-Z lower-cased, and of its first four bytes; punctuation at the ends is dropped."""
    import zlib

    import numpy as np

    words = [w.strip(b".,;:!?*$%&#\"'()") for w in (text or "").encode("utf-8", "replace").lower().split()]
    out = np.empty((len(words), 2), np.int32)
    out[:, 0] = [zlib.crc32(w) & (BUCKETS - 1) for w in words]
    out[:, 1] = [zlib.crc32(w[:4], 7) & (BUCKETS - 1) for w in words]
    return out


class TextCNN:
    """score = sigmoid(b + sum over filters of w * max over positions of relu(filter))."""

    def __init__(self, seed: int = 3):
        import numpy as np

        r = np.random.default_rng(seed)
        f = lambda *s: r.normal(0, 0.1, s).astype(np.float32)
        self.words, self.heads = f(BUCKETS, DIM), f(BUCKETS, DIM)
        self.filters = {w: f(w * DIM, FILTERS) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out, self.out_bias = f(len(WIDTHS) * FILTERS), np.float32(-1)

    def embed(self, ids):
        return self.words[ids[:, 0]] + self.heads[ids[:, 1]]

    def pooled(self, ids):
        """The largest activation of every filter and where it is, over the whole text; a short text is padded with zeros."""
        import numpy as np

        best = {w: (np.zeros(FILTERS, np.float32), np.full(FILTERS, -1)) for w in WIDTHS}
        for s in range(0, max(1, len(ids)), CHUNK):
            x = self.embed(ids[s : s + CHUNK + max(WIDTHS) - 1])
            for w in WIDTHS:
                y = x if len(x) >= w else np.concatenate([x, np.zeros((w - len(x), DIM), np.float32)])
                n = len(y) - w + 1
                a = sum(y[j : j + n] @ self.filters[w][j * DIM : (j + 1) * DIM] for j in range(w)) + self.bias[w]
                k = a.argmax(0)
                top, was = a[k, np.arange(FILTERS)], best[w]
                new = top > was[0]
                best[w] = (np.where(new, top, was[0]), np.where(new, k + s, was[1]))
        return best

    def score(self, ids) -> float:
        import numpy as np

        best = self.pooled(ids)
        z = float(np.concatenate([best[w][0] for w in WIDTHS]) @ self.out + self.out_bias)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def fit(self, docs, labels, epochs: int = 12, rate: float = 0.05, seed: int = 4):
        """Adagrad over single documents; gradients flow through the positions that the pooling chose."""
        import numpy as np

        r = np.random.default_rng(seed)
        params = [self.words, self.heads, self.out, *self.filters.values(), *self.bias.values()]
        sums = {id(p): np.full(p.shape, 1e-2, np.float32) for p in params}
        bias_sum, share = 1e-2, max(1, sum(labels)) / max(1, len(labels))
        weight = (0.5 / max(1e-6, 1 - share), 0.5 / share)

        def step(p, g, at=slice(None)):
            s = sums[id(p)]
            s[at] += g * g
            p[at] -= rate * g / np.sqrt(s[at])

        for _ in range(epochs):
            for i in r.permutation(len(docs)):
                ids, y = docs[i], labels[i]
                best = self.pooled(ids)
                z = float(np.concatenate([best[w][0] for w in WIDTHS]) @ self.out + self.out_bias)
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight[y]
                if abs(d) < 0.01:
                    continue
                g_out = np.concatenate([best[w][0] for w in WIDTHS]) * d
                touched: dict[int, object] = {}
                for k, w in enumerate(WIDTHS):
                    act, at = best[w]
                    up = d * self.out[k * FILTERS : (k + 1) * FILTERS] * (at >= 0)
                    g_f = np.zeros_like(self.filters[w])
                    for j in range(w):
                        ok = (at >= 0) & (at + j < len(ids))
                        x = np.zeros((FILTERS, DIM), np.float32)
                        x[ok] = self.embed(ids[at[ok] + j])
                        g_f[j * DIM : (j + 1) * DIM] = (x * up[:, None]).T
                        g_x = up[:, None] * self.filters[w][j * DIM : (j + 1) * DIM].T
                        for f in np.flatnonzero(ok):
                            touched[at[f] + j] = touched.get(at[f] + j, 0) + g_x[f]
                    step(self.filters[w], g_f)
                    step(self.bias[w], up)
                step(self.out, g_out)
                bias_sum += d * d
                self.out_bias -= np.float32(rate * d / np.sqrt(bias_sum))
                for pos, g in touched.items():
                    step(self.words, g, ids[pos, 0])
                    step(self.heads, g, ids[pos, 1])
        return self


def calibrated(counts, least: int = 20) -> dict[str | None, float]:
    """counts of (lang, step, label, n) to the threshold with the best F1 by language (None: all).

    Languages with fewer than `least` labels of a kind take None's, which then is
    0.5; a row without a language counts under None alone.
    """
    import math

    out = {None: 0.5}
    langs = {lang for lang, _, _, _ in counts if lang is not None}
    for lang in [None, *sorted(langs)]:
        own: dict[int, list[int]] = {}
        for x, step, y, n in counts:
            if lang is None or x == lang:
                own.setdefault(step, [0, 0])[y] += n
        pos, neg = sum(v[1] for v in own.values()), sum(v[0] for v in own.values())
        if min(pos, neg) < least:
            continue
        best, hit, called = -1.0, pos, pos + neg
        for step in sorted(own):  # this step and those above are called toxic
            f1 = 2 * hit / (pos + called)
            if f1 > best:
                best, out[lang] = f1, 1 / (1 + math.exp(-(step - 0.5) / STEPS))
            hit, called = hit - own[step][1], called - sum(own[step])
    return out


def _learnable(labels: DataFrame) -> DataFrame:
    """(_id, _y) of the labelled documents that may be learnt from: crc32(doc_id as text) mod 5 is not 0."""
    y = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL AND crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0")
    return y.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_y"))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS):
    """(model, fitted ids): fitted on at most `sample_rows` labelled documents, those with the smallest hash of doc_id.

    Of these, nine in ten are fitted on, but for those whose texts would bring the
    characters of all chosen over `sample_chars`. Null labels, and documents without a text, teach nothing;
    without both kinds of label the model is untrained. Of documents that share an id
    each text is learnt.
    """
    pick = _learnable(labels).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)

    def ids(batches):
        import pyarrow as pa

        for b in batches:
            flat = [word_ids(t).ravel() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), pa.array(flat, pa.list_(pa.int32()))], ["id", "y", "ids"])

    d = docs.select("doc_id", "text").join(F.broadcast(pick), F.col("doc_id") == F.col("_id")).select(F.col("_id").cast("long").alias("_id"), "_y", "text")
    total, chosen = 0, []
    for k, r in enumerate(d.groupBy("_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n")).orderBy(F.xxhash64("_id"), "_id").collect()):  # at most sample_rows
        if k % 10 and total + r["n"] <= sample_chars:  # a text that does not fit is passed over, not the rest
            total += r["n"]
            chosen.append(r["_id"])
    fitted = docs.sparkSession.createDataFrame([(i,) for i in chosen], "_fit long")
    got = d.join(F.broadcast(fitted), F.col("_id") == F.col("_fit"), "left_semi").mapInArrow(ids, "id long, y int, ids array<int>").toArrow()
    got = got.append_column("size", pa_lengths(got["ids"])).sort_by([("id", "ascending"), ("size", "ascending")])
    xs = [x.values.to_numpy().reshape(-1, 2) if (x := got["ids"][i]).values is not None else None for i in range(len(got))]
    ys = got["y"].to_pylist()
    model = TextCNN()
    if len(set(ys)) == 2:
        model.fit(xs, ys)
    return model, fitted


def pa_lengths(lists):
    import pyarrow.compute as pc

    return pc.fill_null(pc.list_value_length(lists), 0)


def thresholds(scored: DataFrame, labels: DataFrame, fitted: DataFrame) -> dict[str | None, float]:
    """calibrated() over scored(doc_id, lang, score): all learnable labelled documents that the model was not fitted on, counted in the cluster."""
    own = _learnable(labels).join(F.broadcast(fitted), F.col("_id") == F.col("_fit"), "left_anti")
    s = F.least(F.greatest(F.col("score"), F.lit(1e-12)), F.lit(1 - 1e-12))
    step = F.round(F.least(F.greatest(F.log(s / (1 - s)), F.lit(-LARGEST)), F.lit(LARGEST)) * STEPS).cast("int")
    counts = scored.join(own, scored["doc_id"] == own["_id"]).groupBy("lang", step.alias("step"), "_y").agg(F.count("*").alias("n"))
    return calibrated([tuple(r) for r in counts.collect()])  # at most 2 * (2 * STEPS * LARGEST + 1) rows a language


def score(docs: DataFrame, model: TextCNN) -> DataFrame:
    """docs and `score` (0 to 1) of every whole text, null as empty; the model, of fixed size, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            s = pa.array([shared.value.score(word_ids(t)) for t in b.column(b.schema.get_field_index("text")).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], [*b.schema.names, "__mr_score"])

    from pyspark.sql import types as T

    return docs.mapInArrow(trimmed(run), T.StructType([*docs.schema.fields, T.StructField("__mr_score", T.DoubleType())]))


def _scored(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict]:
    """A table (doc_id, lang, t, score), t the text's hash, of every row, and the thresholds by language."""
    model, fitted = train(docs, labels)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    d = docs.select("doc_id", lang.alias("lang"), F.xxhash64("text").alias("t"), "text")
    s = materialize(score(d, model).select("doc_id", "lang", "t", F.col("__mr_score").alias("score")))
    return s, thresholds(s, labels, fitted)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5), lang_threshold, rejected (score at its language's threshold or above).

    Every row of docs(doc_id, text[, lang]); labels(doc_id, toxic). lang chooses
    the threshold only. Null texts count as empty.
    """
    s, by_lang = _scored(docs, labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    limit = threshold(by_lang)
    return s.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), limit.alias("lang_threshold"), (F.col("score") >= limit).alias("rejected"))


def threshold(by_lang: dict) -> F.Column:
    out = F.lit(float(by_lang.get(None, 0.5)))
    for lang, t in sorted((k, v) for k, v in by_lang.items() if k is not None):
        out = F.when(F.col("lang") == lang, F.lit(float(t))).otherwise(out)
    return out


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects; columns as they were. Rows that share an id and a text stay or go together."""
    s, by_lang = _scored(docs, labels)
    gone = materialize(s.where(F.col("score") >= threshold(by_lang)).select(F.col("doc_id").alias("__mr_id"), F.col("t").alias("__mr_t")).distinct())
    discard(s)
    same = docs["doc_id"].eqNullSafe(F.col("__mr_id")) & (F.xxhash64(docs["text"]) == F.col("__mr_t"))
    return docs.join(sized(gone), same, "left_anti")
