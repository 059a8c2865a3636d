"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams of one to three characters over lower-cased
letters (anything else is a space), weighted by term frequency times inverse document
frequency and normalised to sum ``SCALE`` per text. Document frequencies are counted
over all training documents. The regression is trained with follow-the-regularised-
leader and an elastic-net penalty (so most weights are exactly zero), then a
temperature is fitted on training documents left out of it.

Training data: text and non-null lang of rows whose crc32(doc_id as text) mod 4 is not
2. The regression is fitted on a bounded sample of them: about ``per_lang`` of each of
the ``max_langs`` most frequent languages, by a hash of doc_id, and at most
``max_bytes`` of text. Each language has an equal share of the bytes, and what some
don't need goes to the others; it is spent in the order of the hash, whatever the
table's order. A text gives at most an ``EIGHTH`` of its language's share and the one
that reaches the end of it is cut there, so every language has its texts in the sample,
long as they may be. Rows with equal doc_id and lang count once in the sample.
Prediction uses the text alone, all of it.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, as is every
text when nothing can be learned. Ties go to the first language in string order. Texts
of any length are read whole, in pieces of bounded size. Repeated rows each get a row; extra columns
are ignored; a null doc_id is not held out and never trained on; an empty table gives
an empty result.
"""

from __future__ import annotations

import functools
import pickle
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import bytewords as bw
from gridloom.llm.session import tune

BITS = 16
ORDERS = 3
SCALE = 30.0
PER_LANG = 1000
MAX_LANGS = 200
MAX_BYTES = 24_000_000
EIGHTH = 8
PIECE = 1 << 19  # characters whose features are held at once
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"
_SPACE = 0x20
_SEPARATOR = 0x10FFFF


def fold(doc_id, n: int = 4):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


@functools.cache
def _letters() -> np.ndarray:
    """Lower-cased code point of letters and marks, a space for everything else."""
    table = np.full(0x110000, _SPACE, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    table[_SEPARATOR] = _SEPARATOR
    return table


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(feature of each n-gram, its text, whether each text has a letter), in pieces."""
    codes = np.frombuffer((chr(_SEPARATOR).join([t.replace(chr(_SEPARATOR), " ") for t in texts] + [""])).encode("utf-32-le"), dtype=np.uint32)
    for lo in range(0, len(codes), PIECE):
        # A piece also sees the characters that its last n-grams end with.
        part = _letters()[codes[lo : lo + PIECE + ORDERS - 1]]
        own = min(PIECE, len(codes) - lo)
        yield part, own, codes[lo : lo + own] == _SEPARATOR


def _features(part: np.ndarray, own: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, features) of each order's n-grams that start in the first ``own``."""
    h = np.zeros(len(part), dtype=np.uint32)
    bad = np.zeros(len(part), dtype=bool)
    blank = np.ones(len(part), dtype=bool)
    for k in range(ORDERS):
        if len(part) <= k:
            return
        n = len(part) - k
        c = part[k:]
        h = (h[:n] ^ c) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        bad = bad[:n] | (c == _SEPARATOR)
        blank = blank[:n] & (c == _SPACE)
        at = np.flatnonzero(~(bad | blank)[:own])
        x = (h[at] + np.uint32(k + 1)) * np.uint32(0x85EBCA77)
        yield at, (x >> np.uint32(32 - BITS)).astype(np.int64)


def document_frequencies(texts: list[str]) -> tuple[np.ndarray, int]:
    """In how many of the texts each feature is; number of texts."""
    df = np.zeros(1 << BITS, dtype=np.int64)
    for text in texts:
        seen = np.zeros(1 << BITS, dtype=bool)
        for part, own, _ in grams([text]):
            for _, f in _features(part, own):
                seen[f] = True
        df += seen
    return df, len(texts)


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of one text and their normalised values."""
    tf = np.zeros(1 << BITS)
    for part, own, _ in grams([text]):
        for _, f in _features(part, own):
            tf += np.bincount(f, minlength=1 << BITS)
    at = np.flatnonzero(tf)
    x = tf[at] * idf[at]
    total = x.sum()
    return at, x * (SCALE / total) if total else x


@dataclass
class Ftrl:
    """Follow-the-regularised-leader with elastic-net penalty, one column per class."""

    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01

    def __post_init__(self):
        self.z = np.zeros(((1 << BITS) + 1, self.classes))
        self.n = np.zeros_like(self.z)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at, 1 << BITS), np.append(x, 1.0)  # the last is the intercept
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        more = np.sqrt(self.n[at] + g * g)
        self.z[at] += g - (more - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Identifier:
    langs: list[str]
    weights: np.ndarray  # [feature, language], times idf
    idf: np.ndarray
    bias: np.ndarray
    temperature: float

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        n, k = len(texts), len(self.langs)
        total, norm = np.zeros((n, k)), np.zeros(n)
        done = 0
        for part, own, ends in grams(texts):
            doc = done + np.cumsum(ends) - ends
            done += int(ends.sum())
            for at, f in _features(part, own):
                if not len(at):
                    continue
                d = doc[at]
                first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
                np.add.at(norm, d[first], np.add.reduceat(self.idf[f], first))
                np.add.at(total, d[first], np.add.reduceat(self.weights[f], first, axis=0))
        some = norm > 0
        logits = total * (SCALE / np.where(some, norm, 1.0))[:, None] + self.bias
        p = softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        return [self.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, p.max(axis=1), 0.0)


def learn(rows: list[tuple[str, str]], idf: np.ndarray, epochs: int = 4) -> Identifier:
    """From (text, lang) rows, in an order that should be random."""
    langs = sorted({x for _, x in rows})
    none = Identifier([], np.zeros((1 << BITS, 0)), idf, np.zeros(0), 1.0)
    made = [(*vector(t, idf), langs.index(x)) for t, x in rows]
    made = [m for m in made if len(m[0])]
    if not made:
        return none
    fitted, kept = [m for i, m in enumerate(made) if i % 5], made[::5]
    model = Ftrl(len(langs))
    for _ in range(epochs):
        for m in fitted or made:
            model.learn(*m)
    w = model.weights(np.arange((1 << BITS) + 1))
    logits = np.array([x @ w[at] + w[-1] for at, x, _ in kept])
    y = np.array([c for *_, c in kept])
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return Identifier(langs, (w[:-1] * idf[:, None]).astype(np.float64), idf, w[-1], float(grid[int(np.argmin(loss))]))


def shares(needs: dict[str, int], total: int) -> dict[str, int]:
    """Each one's part of ``total``: equal parts, but what one doesn't need goes to the others."""
    out = {}
    for i, (x, need) in enumerate(sorted(needs.items(), key=lambda n: (n[1], n[0]))):
        out[x] = min(need, total // (len(needs) - i))
        total -= out[x]
    return out


def chosen(rows: list[tuple[int, int, str, int]], max_bytes: int) -> dict[tuple[int, str], int]:
    """Bytes to take of each (doc_id, lang), from rows of (turn, doc_id, lang, bytes)."""
    needs: dict[str, int] = {}
    for _, _, lang, size in rows:
        needs[lang] = needs.get(lang, 0) + size
    left = shares(needs, max_bytes)
    most = {x: n if n == needs[x] else max(1, n // EIGHTH) for x, n in left.items()}
    out = {}
    for _, doc_id, lang, size in sorted(rows):
        take = min(size, most[lang], left[lang])
        if take:
            out[doc_id, lang] = take
            left[lang] -= take
    return out


def train(docs: DataFrame, per_lang: int = PER_LANG, max_langs: int = MAX_LANGS, max_bytes: int = MAX_BYTES) -> Identifier:
    """Fit on ``docs`` as the module's text describes."""
    tune(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("doc_id is not null and text is not null and lang is not null")
    known = known.where(fold(F.col("doc_id")) != 2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, dtype=np.int64), 0
        for batch in bw.chunks(batches, "text"):
            one, m = document_frequencies(batch.column(0).to_pylist())
            df, n = df + one, n + m
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["feature", "n"])

    sums = known.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    df, total = np.zeros(1 << BITS), 0
    for r in sums.collect():  # at most 2**BITS + 1 rows
        if r["feature"] < 0:
            total = r["n"]
        else:
            df[r["feature"]] = r["n"]
    idf = np.log((total + 1) / (df + 1)) + 1
    by_lang = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    if not by_lang:
        return learn([], idf)
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for r in by_lang for x in (r["lang"], min(1.0, per_lang / r["count"]))])
    picked = known.where(turn < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)))
    sizes = picked.groupBy("doc_id", "lang").agg(F.max(F.octet_length("text")).alias("bytes"))
    rows = sizes.select("doc_id", "lang", "bytes", F.xxhash64("doc_id").alias("turn")).collect()  # about per_lang a language
    takes = chosen([(r["turn"], r["doc_id"], r["lang"], r["bytes"]) for r in rows], max_bytes)
    ids = docs.sparkSession.createDataFrame([(d, x, n) for (d, x), n in takes.items()], "doc_id long, lang string, take int")
    # A text's first characters are at least as many bytes as are taken of it.
    cut = picked.join(F.broadcast(ids), ["doc_id", "lang"]).select("doc_id", "lang", F.expr("substring(text, 1, take)").alias("text"))
    rows = cut.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select(F.xxhash64("doc_id", F.lit(1)).alias("turn"), "doc_id", "lang", "text")
    wanted = ids.select("doc_id", "lang", "take")

    def fit_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = []
        for batch in batches:
            for turn, text, lang, take in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                sample.append((turn, text.encode()[:take].decode(errors="ignore"), lang))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn([(t, x) for _, t, x in sorted(sample)], idf))], pa.binary())], ["model"])

    # The bounded sample is fitted in one task, which spares the driver's memory.
    rows = rows.join(F.broadcast(wanted), ["doc_id", "lang"]).select("turn", "text", "lang", "take").repartition(1)
    found = rows.mapInArrow(fit_once, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else learn([], idf)


def identify(docs: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``; no shuffle."""
    tune(docs.sparkSession)
    model = train(docs, **bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.chunks(batches, "text", 1 << 20):
            lang, score = model([x or "" for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, PREDICTED)
