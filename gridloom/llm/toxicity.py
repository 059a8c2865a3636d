"""Toxicity from class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary training texts, give each text a
log-likelihood per word; their difference, calibrated, is the score. What is counted is
the different words seen before a word or a pair, so a passage that is copied often
counts once. Counts are discounted by ``WHOLE`` for words and ``WHOLE_PAIRS`` for pairs,
so rarer ones are discounted whole, and by a multiple of the other class's share. Pairs back off to their class's words; words of both classes back off
to the same shared counts, those the discounting took away in either class (which is
Kneser and Ney's condition: what is taken must be what is given back). So an expression
that is rare in training has the same smoothed probability in both models and says
nothing about the class, and one that is frequent in one class only says much.

Training data. Labels are read only from rows whose crc32(doc_id as text) mod 5 is not 0.
Of these the models are fitted on a bounded sample: at most ``per_class`` texts of each
class, in the order of a hash of doc_id, and at most ``max_bytes`` of text altogether (a
text that alone exceeds what is left is passed over). The calibration is fitted on
half-sample models' scores of the other half, weighted back to the classes' shares of
all labelled training rows. Scoring covers every row and whole text.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.

Edge cases: null and empty texts, and texts without words, get the score of no
evidence: the toxic share of the training rows. A document with several label rows is
toxic if one says so; a null label is none. Null doc_ids are not held out and never
trained on. Without a labelled text of both classes the score is the share (0 when
nothing is labelled). Repeated rows each get a row; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import bytewords as bw
from gridloom.llm.session import tune

PER_CLASS = 2000
MAX_BYTES = 12_000_000
FOLDS = 5
#: Counts up to these are discounted whole.
WHOLE, WHOLE_PAIRS = 3, 12
#: Besides these, so many times the other class's share is discounted: classes differ in
#: their mix of languages and topics, which must not count for or against a text.
CONTRAST = 4.0
SCORED = "doc_id long, held_out boolean, score double, predicted int, n_words long, toxic_rate double, ordinary_rate double"
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def fold(doc_id, n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def _pairs(hashes: np.ndarray) -> np.ndarray:
    return bw.mix(hashes[:-1] * _PAIR + hashes[1:])


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in the sorted table, the table's length where it isn't."""
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    at[table[at] != keys] = len(table)
    return at


@dataclass
class Model:
    """Tables end with an entry for what isn't in them."""

    words: np.ndarray
    base: np.ndarray  # [class, word]: log of the class's smoothed unigram probability
    contexts: np.ndarray
    back: np.ndarray  # [class, context]: log of the back-off mass
    pairs: np.ndarray
    direct: np.ndarray  # [class, pair]: discounted share

    def rates(self, found: bw.Words) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood per word of each text, [class, text]; number of words."""
        h = found.hashes()
        n = found.counts
        total = np.zeros((2, len(h) + 1))
        if len(h):
            base = self.base[:, _find(self.words, h)]
            each = base.copy()
            follows = bw.within(found.doc, 2)
            context = _find(self.contexts, h[:-1])
            pair = _find(self.pairs, _pairs(h))
            with np.errstate(divide="ignore"):
                smooth = np.logaddexp(np.log(self.direct[:, pair]), self.back[:, context] + base[:, 1:])
            each[:, 1:] = np.where(follows, smooth, base[:, 1:])
            np.cumsum(each, axis=1, out=total[:, 1:])
        sums = total[:, found.first[1:]] - total[:, found.first[:-1]]
        return sums / np.maximum(n, 1), n


def _continuations(before: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the number of different words seen before each, and one place of each."""
    _, at = np.unique(bw.mix(before * _PAIR + keys), return_index=True)
    found, first, n = np.unique(keys[at], return_index=True, return_counts=True)
    return found, n.astype(np.float64), at[first]


def _kept(counts: np.ndarray, by: int) -> np.ndarray:
    """What the discount leaves of counts[class, expression]: ``by``, and ``CONTRAST``
    times what the other class's share of the expression would give, go."""
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1.0)
    return np.maximum(counts - by - CONTRAST * counts[::-1] * (total / total[::-1]), 0.0)


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """Both models from labelled texts."""
    uni, pair, left = ([], []), ([], []), ([], [])
    step = 200
    for i in range(0, len(texts), step):
        found = bw.words(pa.array(texts[i : i + step], pa.large_string()), bw.LOWER_ALNUM, lower=True)
        h = found.hashes()
        if not len(h):
            continue
        kind = np.asarray(toxic[i : i + step])[found.doc]
        before = np.zeros_like(h)  # 0 stands before a text's first word
        before[1:] = np.where(bw.within(found.doc, 2), h[:-1], 0)
        earlier = np.zeros_like(h)
        earlier[1:] = np.where(bw.within(found.doc, 2), before[:-1], 0)
        pairs = bw.mix(before * _PAIR + h)
        for c in (0, 1):
            for kept, own in ((uni, np.flatnonzero(kind == c)), (pair, np.flatnonzero((kind == c) & (before != 0)))):
                kept[c].append(np.stack([(before if kept is uni else earlier)[own], (h if kept is uni else pairs)[own]]))
            left[c].append(before[own])
    flat = lambda x: np.concatenate(x, axis=-1) if x else np.zeros((2, 0), np.uint64)
    single, double = [], []
    for c in (0, 1):
        single.append(_continuations(*flat(uni[c])))
        uni[c].clear()
        double.append(_continuations(*flat(pair[c])))
        pair[c].clear()
    words = np.unique(np.concatenate([single[0][0], single[1][0]]))
    v = len(words)
    counts = np.zeros((2, v + 1))
    for c in (0, 1):
        counts[c, np.searchsorted(words, single[c][0])] = single[c][1]
    kept = _kept(counts, WHOLE)
    taken = (counts - kept).sum(axis=0)
    shared = (taken + 0.5) / (taken.sum() + 0.5 * (v + 1))
    base = np.empty((2, v + 1))
    for c in (0, 1):
        total = max(counts[c].sum(), 1.0)
        base[c] = np.log((kept[c] + (total - kept[c].sum()) * shared + 1e-9) / total)
    grams = []
    for c in (0, 1):
        lefts = np.concatenate(left[c]) if left[c] else np.zeros(0, np.uint64)
        keys, n, at = double[c]
        grams.append((keys, lefts[at], n))
    contexts = np.unique(np.concatenate([g[1] for g in grams]))
    pairs = np.unique(np.concatenate([p for p, _, _ in grams]))
    counts = np.zeros((2, len(pairs)))
    for c, (p, _, n) in enumerate(grams):
        counts[c, np.searchsorted(pairs, p)] = n
    kept = _kept(counts, WHOLE_PAIRS)
    big = kept.any(axis=0)
    back, direct = np.zeros((2, len(contexts) + 1)), np.zeros((2, int(big.sum()) + 1))
    for c, (p, lefts, n) in enumerate(grams):
        at, own = np.searchsorted(contexts, lefts), kept[c, np.searchsorted(pairs, p)]
        total = np.bincount(at, n, len(contexts) + 1)
        back[c] = np.log(np.where(total > 0, (total - np.bincount(at, own, len(contexts) + 1)) / np.maximum(total, 1), 1.0))
        direct[c, np.searchsorted(pairs[big], p[own > 0])] = own[own > 0] / total[at[own > 0]]
    used = (back != 0).any(axis=0)[:-1]  # other contexts back off whole, as unseen ones do
    return Model(words, base, contexts[used], np.append(back[:, :-1][:, used], [[0.0], [0.0]], axis=1), pairs[big], direct)


def _features(rates: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per text: the normalised difference, alone and at three powers of the length."""
    d = rates[1] - rates[0]
    x = np.stack([np.ones(len(n)), d * 10, d * np.sqrt(n), np.clip(d * n, -30, 30), np.log1p(n)], axis=1)
    x[n == 0] = 0.0
    return x


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method, on scaled features."""
    scale = np.maximum(np.abs(x).mean(axis=0), 1e-9)
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + 0.1 * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + (0.1 + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


@dataclass
class Scorer:
    """A fitted scorer: the models, the calibration and the share of toxic rows."""

    model: Model | None
    weights: np.ndarray | None
    share: float

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = bw.words(column, bw.LOWER_ALNUM, lower=True)
        n = found.counts
        if self.model is None:
            return np.full(len(n), self.share), n, np.zeros((2, len(n)))
        rates, n = self.model.rates(found)
        score = 1 / (1 + np.exp(-np.clip(_features(rates, n) @ self.weights, -30, 30)))
        score[n == 0] = self.share
        return score, n, rates


def learn(texts: list[str], toxic: np.ndarray, totals: tuple[int, int]) -> Scorer:
    """Scorer from labelled texts; ``totals``: ordinary and toxic training rows there are."""
    toxic = np.asarray(toxic, dtype=np.int64)
    share = totals[1] / max(1, sum(totals))
    if min((toxic == 0).sum(), (toxic == 1).sum()) < 2:
        return Scorer(None, None, share)
    half = np.zeros(len(texts), dtype=np.int64)
    for c in (0, 1):
        half[np.flatnonzero(toxic == c)[1::2]] = 1
    x, y = [], []
    for side in (0, 1):
        fitted = fit([t for t, s in zip(texts, half, strict=True) if s != side], toxic[half != side])
        own = [t for t, s in zip(texts, half, strict=True) if s == side]
        for i in range(0, len(own), 500):
            x.append(_features(*fitted.rates(bw.words(pa.array(own[i : i + 500], pa.large_string()), bw.LOWER_ALNUM, lower=True))))
        y.append(toxic[half == side])
    x, y = np.concatenate(x), np.concatenate(y)
    weight = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum()) * len(y) / sum(totals)
    return Scorer(fit(texts, toxic), _logistic(x, y.astype(float), weight), share)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES, folds: int = FOLDS) -> Scorer:
    """Fit on the bounded sample that the module's text describes."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    marked = marked.where(fold(F.col("doc_id"), folds) != 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").alias("bytes")).where("bytes is not null")
    known = rows.join(marked, "doc_id").withColumn("turn", F.xxhash64("doc_id"))
    totals = {int(r["toxic"] > 0): r["count"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}

    def first(c: int) -> DataFrame:
        """The first ``per_class`` rows of a class by their hash. The hash is uniform, so a
        bound on it leaves little more than so many rows to be put in order."""
        own = known.where((F.col("toxic") > 0) == F.lit(bool(c)))
        share = (1.2 * per_class + 500) / max(1, totals.get(c, 0))
        near = own if share >= 1 else own.where(F.col("turn") < int(2.0**64 * share) - (1 << 63))
        return near.orderBy("turn").limit(per_class)

    chosen: dict[int, int] = {}
    for c in (1, 0):
        left = max_bytes // 2
        for r in first(c).collect():
            if r["bytes"] <= left:
                chosen[r["doc_id"]] = c
                left -= r["bytes"]
    spark = docs.sparkSession
    ids = spark.createDataFrame([(k, c) for k, c in chosen.items()], "doc_id long, toxic int")
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(ids), "doc_id")
    counts = (totals.get(0, 0), totals.get(1, 0))

    def fit_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[int, tuple[str, int]] = {}
        for batch in batches:
            for doc_id, text, toxic in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                texts.setdefault(doc_id, (text, toxic))
        order = sorted(texts, key=lambda k: (k, texts[k]))
        made = learn([texts[k][0] for k in order], np.array([texts[k][1] for k in order], dtype=np.int64), counts)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["scorer"])
        del texts, made
        bw.release()

    # The bounded sample is fitted in one task, which spares the driver's memory.
    rows = picked.select("doc_id", "text", "toxic").repartition(1).sortWithinPartitions("doc_id", "text").mapInArrow(fit_once, "scorer binary").collect()
    return pickle.loads(rows[0]["scorer"]) if rows else learn([], np.zeros(0, np.int64), counts)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES, folds: int = FOLDS) -> DataFrame:
    """Score of every row of ``docs``: doc_id, held_out, score, predicted and the rates."""
    tune(docs.sparkSession)
    scorer = train(docs, labels, per_class, max_bytes, folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.chunks(batches):
            score, n, rates = scorer(batch.column(2))
            columns = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(rates[1]), pa.array(rates[0])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "n_words", "toxic_rate", "ordinary_rate"])

    held = F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, SCORED)


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **bounds: int) -> DataFrame:
    """``docs`` without the rows scored at or above ``threshold``; the texts are scored
    where they are read, so no row is shuffled."""
    tune(docs.sparkSession)
    scorer = train(docs, labels, **bounds)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.chunks(batches):
            yield batch.filter(pa.array(scorer(batch.column(at))[0] < threshold))

    return docs.mapInArrow(run, docs.schema)
