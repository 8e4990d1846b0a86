"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word's vector is two halves, looked up by two independent hashes, so a word
shares its whole vector with another only if both hashes meet. Filters of
several widths run over the words, each keeps its maximum over the whole text,
and a logistic layer reads the maxima. The network is trained in numpy on a
bounded sample of labelled rows (``Params.positives`` and ``negatives``); the
first filter of width 1 starts as the reader of each hash's smoothed log-odds,
the rest at random. Thresholds are set for each language the text itself shows
(by its commonest function words) on the logits of every labelled row outside
the held-out fold, and moved into the score so that 0.5 is every language's cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Function words by language, for the guess that picks a threshold.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "was", "for", "with"),
    "de": ("der", "die", "und", "das", "ist", "von", "den", "mit", "auf", "für"),
    "fr": ("le", "la", "les", "des", "et", "est", "dans", "que", "une", "pour"),
    "es": ("el", "los", "las", "del", "que", "por", "una", "con", "para", "y"),
}


@dataclass(frozen=True)
class Params:
    #: Most labelled rows of each class that the fit reads; the bound of the sample.
    positives: int = 2000
    negatives: int = 3000
    buckets: int = 1 << 16
    half: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 12
    epochs: int = 4
    batch: int = 64
    rate: float = 0.05
    seed: int = 7
    #: Folds of the sample: its rows' logits for the thresholds come from networks fitted on the other folds.
    folds: int = 3
    #: Least rows of each class for a language to have a threshold of its own.
    least: int = 20
    #: What rejecting a share of clean rows costs against missing the same share of toxic ones.
    clean_weight: float = 3.0
    #: Steps of the thresholds' histograms in one logit.
    steps: int = 256
    #: Words that the forward pass holds at a time.
    piece: int = 20_000


def tokens(text: str) -> list[bytes]:
    """Lower-cased words without the punctuation around them."""
    return [w for w in (x.strip(b".,;:!?\"'()[]{}|") for x in (text or "").lower().encode().split()) if w]


def guess(words, sets) -> str:
    """The language whose function words are the most frequent; "" if none occurs."""
    from collections import Counter

    seen = Counter(words)
    best = max(((sum(seen[w] for w in s), lang) for lang, s in sets.items()), key=lambda x: (x[0], x[1]))
    return best[1] if best[0] else ""


class Network:
    """Weights and the forward pass; ``fit`` trains them."""

    def __init__(self, p: Params):
        import numpy as np

        r = np.random.default_rng(p.seed)
        self.p = p
        self.embed = np.zeros((2, p.buckets + 1, p.half), np.float32)  # the last row is the padding
        self.embed[:, : p.buckets, 1:] = r.normal(0, 0.01, (2, p.buckets, p.half - 1))
        d = 2 * p.half
        self.conv = {w: r.normal(0, 0.1, (w, d, p.filters)).astype(np.float32) for w in p.widths}
        for w in p.widths:
            self.conv[w][:, :, 0] = 0
            self.conv[w][0, 0, 0] = self.conv[w][0, p.half, 0] = 0.5
        self.bias = {w: np.zeros(p.filters, np.float32) for w in p.widths}
        self.out = np.zeros(len(p.widths) * p.filters + 1, np.float32)

    def hashed(self, words) -> "tuple":
        import numpy as np
        from xxhash import xxh3_64_intdigest

        h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
        return (h % np.uint64(self.p.buckets)).astype(np.int32), ((h >> np.uint64(32)) % np.uint64(self.p.buckets)).astype(np.int32)

    def maxima(self, ids, starts):
        """Per text the maximum of each filter, and where it lies. ids: both hashes of the padded texts in a row."""
        import numpy as np

        x = np.concatenate([self.embed[0][ids[0]], self.embed[1][ids[1]]], axis=1)
        n, ends = len(x), [*starts[1:], len(x)]
        best, place = [], []
        for w in self.p.widths:
            y = np.zeros((n, self.p.filters), np.float32)
            for j in range(w):
                y[: n - j] += x[j:] @ self.conv[w][j]
            y += self.bias[w]
            m = np.maximum.reduceat(y, starts, axis=0)
            best.append(m)
            place.append(np.stack([a + y[a:b].argmax(axis=0) for a, b in zip(starts, ends)]) if self.training else None)
        return x, np.concatenate(best, axis=1), place

    training = False

    def pad(self, texts):
        """Texts (pairs of hash arrays) in a row, each followed by padding as wide as the widest filter."""
        import numpy as np

        gap = np.full(max(self.p.widths), self.p.buckets, np.int32)
        ids = [np.concatenate([part for t in texts for part in (t[k], gap)]) for k in (0, 1)]
        starts = np.concatenate([[0], np.cumsum([len(t[0]) + len(gap) for t in texts])[:-1]]).astype(np.int64)
        return ids, starts

    def logits(self, texts):
        """Long texts go through in pieces that overlap by the widest filter; a text's maxima are over its pieces."""
        import numpy as np

        size, more = self.p.piece, max(self.p.widths) - 1
        cuts = [(i, a) for i, t in enumerate(texts) for a in range(0, max(1, len(t[0])), size)]
        m, group, held = np.full((len(texts), len(self.out) - 1), -np.inf, np.float32), [], 0
        for k, (i, a) in enumerate(cuts):
            group.append((i, [h[a:a + size + more] for h in texts[i]]))
            held += len(group[-1][1][0])
            if held >= size or k + 1 == len(cuts):
                _, best, _ = self.maxima(*self.pad([t for _, t in group]))
                np.maximum.at(m, [i for i, _ in group], best)
                group, held = [], 0
        return np.maximum(m, 0) @ self.out[:-1] + self.out[-1]

    def fit(self, texts, labels):
        import numpy as np

        p, y = self.p, np.asarray(labels, np.float32)
        if not len(y) or y.min() == y.max():
            self.out[-1] = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
            return
        for k in (0, 1):
            seen = np.zeros((2, p.buckets + 1))
            for t, label in zip(texts, y):
                seen[int(label), np.unique(t[k])] += 1
            totals = np.array([[(y == 0).sum()], [(y == 1).sum()]])
            odds = np.log((seen[1] + 0.1) / (totals[1] + 0.2)) - np.log((seen[0] + 0.5) / (totals[0] + 1))
            odds -= np.sqrt(1 / (seen[1] + 0.1) + 1 / (seen[0] + 0.5))  # less its standard error
            self.embed[k, :, 0] = np.where(seen.sum(axis=0) >= 2, np.maximum(odds, 0), 0)
        self.embed[:, p.buckets] = 0
        for w, width in enumerate(p.widths):
            self.out[w * p.filters] = 1.0 if width == 1 else 0.0
            self.out[w * p.filters + 1:(w + 1) * p.filters] = 0.05
        self.out[-1] = -3.0
        state = {}

        def step(name, value, grad, at=...):
            acc = state.setdefault(name, np.zeros_like(value))
            acc[at] += grad * grad
            value[at] -= p.rate * grad / np.sqrt(acc[at] + 1e-6)

        r, self.training = np.random.default_rng(p.seed), True
        weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        for _ in range(p.epochs):
            order = r.permutation(len(y))
            for at in range(0, len(order), p.batch):
                rows = order[at:at + p.batch]
                ids, starts = self.pad([texts[i] for i in rows])
                x, m, place = self.maxima(ids, starts)
                act = np.maximum(m, 0)
                z = act @ self.out[:-1] + self.out[-1]
                d = ((1 / (1 + np.exp(-z)) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
                back = d[:, None] * self.out[None, :-1] * (m > 0)
                step("out", self.out, np.append(act.T @ d, d.sum()).astype(np.float32))
                touched, grads = [[], []], []
                for k, w in enumerate(p.widths):
                    g = back[:, k * p.filters:(k + 1) * p.filters]
                    grad = np.zeros_like(self.conv[w])
                    for j in range(w):
                        pos = np.minimum(place[k] + j, len(x) - 1)
                        grad[j] = np.einsum("bf,bfd->df", g, x[pos])
                        gx = g[:, :, None] * self.conv[w][j].T[None]
                        for side in (0, 1):
                            touched[side].append(ids[side][pos].ravel())
                        grads.append(gx.reshape(-1, gx.shape[2]))
                    step(f"conv{w}", self.conv[w], grad)
                    step(f"bias{w}", self.bias[w], g.sum(axis=0))
                grads = np.concatenate(grads)
                for side in (0, 1):
                    rows_, inverse = np.unique(np.concatenate(touched[side]), return_inverse=True)
                    total = np.zeros((len(rows_), p.half), np.float32)
                    np.add.at(total, inverse, grads[:, side * p.half:(side + 1) * p.half])
                    live = rows_ < p.buckets
                    step(f"embed{side}", self.embed[side], total[live], rows_[live])
        self.training = False


def taught(labels: DataFrame, held_out) -> DataFrame:
    """(_lid, toxic): the label of each id outside the held-out fold, of several the highest."""
    return (
        labels.select(F.col("doc_id").alias("_lid"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("_lid").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("_lid"))
        .groupBy("_lid").agg(F.max("toxic").alias("toxic"))
    )


def hashed_id(id_col: str):
    return F.md5(F.col(id_col).cast("string").cast("binary"))


def sample(docs: DataFrame, known: DataFrame, p: Params) -> list[tuple[str, str, int]]:
    """The bounded labelled sample (hash of the id, text, label): per class the rows first by the hash."""
    one = known.join(docs.select(F.col("doc_id").alias("_lid")).distinct(), "_lid", "left_semi").withColumn("_h", hashed_id("_lid"))
    chosen = one.where("toxic = 1").orderBy("_h").limit(p.positives).unionByName(one.where("toxic = 0").orderBy("_h").limit(p.negatives))
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_lid"))
    rows = got.groupBy("_h").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    return [(r["_h"], r["text"], r["toxic"]) for r in sorted(rows, key=lambda r: r["_h"])]


def in_fold(id_col: str, folds: int = 5):
    """Held out: crc32 of the id as text leaves 0 by ``folds``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(rows: list[tuple[str, str, int]], p: Params = Params()) -> tuple[list[Network], dict[str, int]]:
    """The network fitted on the sample and, before it, one without each fold; and the fold of each hashed id."""
    import numpy as np

    y = np.array([label for _, _, label in rows], int)
    nets = [Network(p) for _ in range(p.folds + 1)]
    texts = [nets[-1].hashed(tokens(text)) for _, text, _ in rows]
    fold = np.arange(len(rows)) % p.folds
    for f, net in enumerate(nets):
        rest = np.flatnonzero(fold != f)
        net.fit([texts[i] for i in rest], y[rest])
    return nets, {h: int(f) for (h, _, _), f in zip(rows, fold)}


def reader(spark, nets: list[Network], fold: dict[str, int], params: Params):
    """A function of (text, hashed id): language, logit, and the logit of a network that didn't read the id's texts."""
    weights = spark.sparkContext.broadcast(([{k: v for k, v in vars(net).items() if k != "p"} for net in nets], fold))

    @F.arrow_udf("lang string, logit double, apart double")
    def read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import numpy as np

        states, fold = weights.value
        models = [Network.__new__(Network) for _ in states]
        for model, state in zip(models, states):
            vars(model).update(state, p=params)
        sets = {k: [w.encode() for w in v] for k, v in FUNCTION_WORDS.items()}
        for texts, ids in batches:
            langs, logits, aparts = [], [np.zeros(0)], [np.zeros(0)]
            for at in range(0, len(texts), 64):
                words = [tokens(text) for text in texts.slice(at, 64).to_pylist()]
                hashes = [models[-1].hashed(w) for w in words]
                langs += [guess(w, sets) for w in words]
                logits.append(models[-1].logits(hashes))
                aparts.append(logits[-1].copy())
                for k, h in enumerate(ids.slice(at, 64).to_pylist()):
                    if h in fold:
                        aparts[-1][k] = models[fold[h]].logits([hashes[k]])[0]
            cols = [pa.array(langs, pa.string()), pa.array(np.concatenate(logits).astype(float)), pa.array(np.concatenate(aparts).astype(float))]
            yield pa.StructArray.from_arrays(cols, ["lang", "logit", "apart"])

    return read


def thresholds(bins: list, p: Params) -> dict[str, float]:
    """A cut for each language with enough rows of both classes, and one ("") for the others.

    bins: (lang, bin, clean, toxic, low, high) with the counts, the least and the
    highest logit of each step. The cut is the middle of the best gap between
    steps: the logit of least cost, where a raised clean share weighs
    ``clean_weight`` times a missed share.
    """
    import numpy as np

    def cut(rows):
        merged = {}
        for _, k, clean, toxic, low, high in rows:
            c, t, a, b = merged.get(k, (0, 0, low, high))
            merged[k] = c + clean, t + toxic, min(a, low), max(b, high)
        clean, toxic, low, high = (np.array(x) for x in zip(*(merged[k] for k in sorted(merged)))) if merged else [np.zeros(0)] * 4
        if not clean.sum() or not toxic.sum():
            return 0.0
        missed = np.concatenate([[0], np.cumsum(toxic)]) / toxic.sum()
        raised = np.concatenate([[0], np.cumsum(clean)]) / clean.sum()
        cost = missed + p.clean_weight * (1 - raised)
        at = np.flatnonzero(cost <= cost.min() + 1e-12)
        k = int(at[len(at) // 2])
        return float(((high[k - 1] if k else low[0] - 1) + (low[k] if k < len(low) else high[-1] + 1)) / 2)

    cuts = {"": cut(bins)}
    for lang in sorted({b[0] for b in bins} - {""}):
        own = [b for b in bins if b[0] == lang]
        if min(sum(b[2] for b in own), sum(b[3] for b in own)) >= p.least:
            cuts[lang] = cut(own)
    return cuts


def scores(rows: DataFrame, labels: DataFrame, p: Params, folds: int) -> DataFrame:
    """``rows`` (doc_id, text and others) without the text, with the column score.

    Every row goes through the network once; its logit is written, and those of
    all labelled rows outside the held-out fold are counted in steps for the cuts.
    """
    known = taught(labels, lambda c: in_fold(c, folds))
    read = reader(rows.sparkSession, *train(sample(rows, known, p), p), p)
    kept = [c for c in rows.columns if c != "text"]
    done = materialize(rows.select(*kept, read("text", hashed_id("doc_id")).alias("_r")), "logits")
    step = F.floor(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("apart"))) * p.steps).alias("step")
    logits = done.where("doc_id is not null").select(F.col("doc_id").alias("_id"), "_r.lang", "_r.apart").join(known, F.col("_id") == F.col("_lid"))
    counts = logits.groupBy("lang", step).agg(F.sum(1 - F.col("toxic")), F.sum("toxic"), F.min("apart"), F.max("apart"))
    cuts = thresholds([tuple(r) for r in counts.collect()], p)
    cut = F.lit(cuts[""])
    for lang in sorted(set(cuts) - {""}):
        cut = F.when(F.col("_r.lang") == lang, cuts[lang]).otherwise(cut)
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("_r.logit") - cut))
    return done.select(*kept, (1 / (1 + F.exp(-z))).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Only labels outside the held-out fold are read, and only the text enters a
    score. Null and empty texts are scored as texts without words. Rows with
    null ids or labels teach nothing; with several labels for one id the
    highest counts. Without labels of both classes the network stays constant:
    0.5 without any, else near the one class seen. Whole texts are read, in
    pieces that overlap by the widest filter. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = scores(rows, labels, params, folds)
    return scored.select("doc_id", in_fold("doc_id", folds).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under 0.5."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct("*").alias("_row"))
    return scores(rows, labels, params, folds).where("score < 0.5").select("_row.*")
