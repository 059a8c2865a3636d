"""Log-probabilities of texts under a causal self-attention model and a unigram base.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end. The
model reads each word, with a space before it, as the subword ids of a byte-level BPE
vocabulary. It gives the probability of the next word's class, by the word's longest
subword id (its anchor), and the word has its share of its class: with c its count, the
probability is P(class) * (c + 0.1) / Z, where Z sums c + 0.1 over the class's words and
one that wasn't seen. A text's score is the sum of the logarithms, each word once.

What is learned comes from rows whose crc32(doc_id as text) mod 10 is not 0, and from
all of them: the counts of words; for each anchor, how the texts that have it spread over
``SPREAD`` hashed buckets of anchors, by which anchors are grouped; and the network,
which takes gradient steps over each of these texts once. They are dealt to ``ROUNDS``
rounds by a hash of doc_id; in a round each task takes steps on its texts from the same
weights, and the changes are averaged by the words read, those of an id's embedding by
how often the task read that id. At the start the network gives the classes' shares of
the corpus, which makes it the base.

Texts are read once: their words, as numbers of a chunk's distinct words with these
words' hashes and subword ids, are written by round, and the counting, the rounds and the
scoring go on from there.

The base needs a count for each word of each text, and the words grow with the corpus.
The most frequent words, at most ``head``, are broadcast; the other words of a text are
joined with the counts by hash and summed per text, so every count is used.

Edge cases: a null or empty text is the end alone. A null doc_id isn't held out and not
learned from. Repeated rows are counted and scored as they come; extra columns are
ignored; an empty table gives an empty result. With nothing to learn from, all counts
are 0. Very long words and texts are scored whole. Words are told apart by 64-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import bytewords as bw
from gridloom.llm import packing, pretoken
from gridloom.llm.attention import CLASSES, WIDTH, Attention, Blocks, Words, blocks, classes_of
from gridloom.llm.session import Scratch, tune

HEAD = 100_000
ROUNDS = 4
RATE = 0.02  # of the first round; it falls to an eighth in the last
BATCH = 512  # blocks in a gradient step
SPREAD = 32
FOLDS = 10
END = 50_256  # the vocabulary's own end-of-text id
IDS = 50_257
HELD_OUT, NOT_LEARNED = -1, -2  # in place of a round; a null doc_id is neither learned from nor held out
CHUNK = 4 << 20  # bytes of text read together
ROW_GROUP = 16 << 20  # bytes in a row group of the words, whose rows are chunks
HELD = 1_000_000  # words with counts that a task holds before it sums them or passes them on


def fold(doc_id, n: int = FOLDS):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


@dataclass
class Read:
    """Distinct words of some texts with their hashes (the end, which is last, has none)
    and counts; the texts' words as numbers of these, each text with its end; and where
    texts begin."""

    distinct: Words
    keys: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    first: np.ndarray

    def blocks(self) -> Blocks:
        return blocks(self.words, self.first, len(self.keys))

    def part(self, texts: np.ndarray) -> Read:
        """Some of the texts, by number, with their own distinct words."""
        sizes = np.diff(self.first)[texts]
        words = self.words[bw.ragged(self.first[texts], sizes)]
        met = np.bincount(words, minlength=len(self.counts))
        at = np.flatnonzero(met)  # the end is in every text, and stays the last
        number = np.cumsum(met > 0) - 1
        ids = np.diff(self.distinct.first)[at]
        flat = self.distinct.flat[bw.ragged(self.distinct.first[at], ids)]
        return Read(Words(flat, _edges(ids), self.distinct.anchor[at]), self.keys[at[:-1]], met[at], number[words], _edges(sizes))

    def packed(self) -> list[bytes]:
        """The columns of ``PACKED``."""
        d = self.distinct
        columns = np.diff(self.first), self.words, self.keys, np.diff(d.first), d.flat, d.anchor
        return [x.astype(t).tobytes() for x, t in zip(columns, PACKED.values(), strict=True)]

    @staticmethod
    def unpacked(columns: list[pa.Scalar]) -> Read:
        sizes, words, keys, ids, flat, anchor = (np.frombuffer(x.as_buffer(), t) for x, t in zip(columns, PACKED.values(), strict=True))
        words = words.astype(np.int64)
        distinct = Words(flat.astype(np.int64), _edges(ids), anchor.astype(np.int64))
        return Read(distinct, keys, np.bincount(words, minlength=len(anchor)), words, _edges(sizes))


#: Words of a chunk's texts: words of each text, their numbers; of distinct words, hashes,
#: how many subword ids, these, and anchors. Subword ids are below 65,536.
PACKED = {"sizes": "<i4", "words": "<i4", "keys": "<u8", "ids": "<i4", "flat": "<u2", "anchor": "<u2"}
READ = "doc_id array<long>, " + ", ".join(f"{c} binary" for c in PACKED) + ", round int"


def _edges(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


class _WordView:
    """What ``pretoken.Cache`` needs of some words, by their numbers."""

    def __init__(self, found: bw.Words, hashes: np.ndarray, at: np.ndarray):
        self.raw, self.own = found.raw.tobytes(), hashes  # slices of bytes are made faster than those of arrays
        self.start, self.end = found.start[at].tolist(), found.end[at].tolist()

    def hashes(self) -> np.ndarray:
        return self.own

    def text(self, i: int) -> bytes:
        return b" " + self.raw[self.start[i] : self.end[i]]


class _Reader:
    """Words and subword ids of texts."""

    _made: dict[tuple[str, str], _Reader] = {}

    def __init__(self, files: tuple[str, str]):
        core = packing.encoder(*files).core
        self.cache = pretoken.Cache(lambda items: [core._encode_single_piece(x) for x in items])
        self.length = np.array([len(core.decode_single_token_bytes(i)) for i in range(END)] + [0], dtype=np.int64)

    @classmethod
    def of(cls, files: tuple[str, str]) -> _Reader:
        if files not in cls._made:
            cls._made[files] = cls(files)
        return cls._made[files]

    def __call__(self, column: pa.Array) -> Read:
        found = bw.words(column, bw.NOT_SPACE, lower=True)
        keys, at, number = np.unique(found.hashes(), return_index=True, return_inverse=True)
        spot, size = self.cache.look_up(_WordView(found, keys, at))
        flat = np.append(self.cache.flat[bw.ragged(spot, size.astype(np.int64))].astype(np.int64), END)
        first = np.concatenate([[0], np.cumsum(size, dtype=np.int64), [len(flat)]])
        place = np.arange(len(flat)) - np.repeat(first[:-1], np.diff(first))
        longest = np.maximum.reduceat((self.length[flat] << 32) - place, first[:-1])
        anchor = flat[first[:-1] + (-longest & 0xFFFF_FFFF)]
        end = len(keys)  # the end is the last of the distinct words
        words = np.insert(number, found.first[1:], end)
        return Read(Words(flat, first, anchor), keys, np.append(np.bincount(number, minlength=end), len(column)), words, found.first + np.arange(len(column) + 1))


def read_words(docs: DataFrame, files: tuple[str, str], folds: int = FOLDS) -> DataFrame:
    """``READ``: the words of all texts in chunks, each of one round, of held-out texts or
    of texts that aren't learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bw.keep_freed()
        for batch in bw.chunks(batches, size=CHUNK):
            read = _Reader.of(files)(batch.column(1))
            own = batch.column(2).to_numpy()
            for r in np.unique(own).tolist():
                texts = np.flatnonzero(own == r)
                ids = batch.column(0).take(pa.array(texts))
                columns = [pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), ids)]
                columns += [pa.array([x], pa.binary()) for x in read.part(texts).packed()]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([r], pa.int32())], ["doc_id", *PACKED, "round"])

    of, turn = fold(F.col("doc_id"), folds), F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(ROUNDS))
    round_ = F.when(of == 0, F.lit(HELD_OUT)).when(of.isNull(), F.lit(NOT_LEARNED)).otherwise(turn).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), round_.alias("round"))
    return rows.mapInArrow(run, READ)


def _reads(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, Read]]:
    """Each row of a batch with its words."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch, i, Read.unpacked([batch.column(c)[i] for c in PACKED])


def _spread(read: Read) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, float[SPREAD]): over the texts that have it, how their words' anchors
    spread over hashed buckets."""
    m = len(read.first) - 1
    doc = np.repeat(np.arange(m), np.diff(read.first))
    anchor = read.distinct.anchor[read.words]
    bucket = (bw.mix(anchor.astype(np.uint64)) >> np.uint64(40)).astype(np.int64) % SPREAD
    share = np.bincount(doc * SPREAD + bucket, minlength=m * SPREAD).reshape(m, SPREAD).astype(np.float32)
    share /= share.sum(axis=1, keepdims=True)
    pair = np.unique(anchor * m + doc)
    own = pair // m
    starts = np.flatnonzero(np.append(True, np.diff(own) != 0))
    return own[starts], np.add.reduceat(share[pair % m], starts, axis=0)


def corpus_counts(reads: DataFrame) -> DataFrame:
    """(key, anchor, n, texts, spread): of the training texts' words by hash, how often
    they occur (spread null); of anchors, their spread (key null); a task's texts."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread, met, texts = np.zeros((IDS, SPREAD), dtype=np.float32), np.zeros(IDS, dtype=bool), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, at, inverse = np.unique(np.concatenate([k for k, *_ in held]), return_index=True, return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([n for _, n, _ in held]), len(keys)).astype(np.int64)
            return keys, counts, np.concatenate([a for *_, a in held])[at]

        def made(*columns) -> pa.RecordBatch:
            m = max(len(c) for c in columns if c is not None)
            return pa.RecordBatch.from_arrays([pa.nulls(m, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "anchor", "n", "texts", "spread"])

        for _, _, read in _reads(batches):
            own, rows = _spread(read)
            spread[own] += rows
            met[own] = True
            texts += len(read.first) - 1
            held.append((read.keys, read.counts[:-1], read.distinct.anchor[:-1]))
            if sum(len(k) for k, *_ in held) > HELD:
                keys, counts, anchors = summed()
                held = [(keys, counts, anchors)]
                if len(keys) > HELD // 2:
                    yield made(keys.view(np.int64), anchors, counts, None, None)
                    held = []
        if held:
            keys, counts, anchors = summed()
            yield made(keys.view(np.int64), anchors, counts, None, None)
        own = np.flatnonzero(met)
        if len(own):
            yield made(None, own, None, None, list(spread[own]))
        yield made(None, None, None, np.array([texts]), None)

    return reads.where("round >= 0").mapInArrow(run, "key long, anchor int, n long, texts long, spread array<float>")


@dataclass
class Counts:
    """What is counted over the training texts. ``reads``: the words of all texts
    (``READ``); ``words``: (key, anchor, n) of distinct words; by anchor, the occurrences
    and the distinct words; the number of texts."""

    reads: DataFrame | None
    words: DataFrame
    mass: np.ndarray
    distinct: np.ndarray
    spread: np.ndarray
    texts: int


def count(docs: DataFrame, files: tuple[str, str], folds: int, scratch: Scratch) -> Counts:
    reads = scratch.keep(read_words(docs, files, folds), "lm_reads", "round", **{"parquet.block.size": ROW_GROUP})
    raw = scratch.keep(corpus_counts(reads), "lm_counts")
    words = scratch.keep(raw.where("key is not null").groupBy("key").agg(F.first("anchor").alias("anchor"), F.sum("n").alias("n")), "lm_words")
    mass, distinct, spread = np.zeros(IDS), np.zeros(IDS), np.zeros((IDS, SPREAD), np.float32)
    for r in words.groupBy("anchor").agg(F.sum("n").alias("n"), F.count("*").alias("m")).collect():  # at most IDS rows
        mass[r["anchor"]], distinct[r["anchor"]] = r["n"], r["m"]
    by_anchor = raw.where("spread is not null").groupBy("anchor").agg(*(F.sum(F.col("spread")[i]).cast("float").alias(f"s{i}") for i in range(SPREAD)))
    found = by_anchor.toPandas()  # at most IDS rows
    spread[found["anchor"].to_numpy()] = found.drop(columns="anchor").to_numpy(np.float32)
    texts = raw.agg(F.sum("texts")).first()[0] or 0
    scratch.drop(raw)
    mass[END], distinct[END] = texts, int(texts > 0)
    return Counts(reads, words, mass, distinct, spread, texts)


def _rest(p: dict[str, np.ndarray]) -> np.ndarray:
    """All weights but the embeddings, in rows of WIDTH."""
    flat = np.concatenate([p[k].ravel() for k in sorted(p) if k != "embed"])
    return np.append(flat, np.zeros(-len(flat) % WIDTH, np.float32)).reshape(-1, WIDTH)


def learn_round(model: Attention, reads: DataFrame, rate: float) -> None:
    """Move the network by the averaged changes of the tasks that go through ``reads``."""
    names = [f"v{i}" for i in range(WIDTH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Attention({k: v.copy() for k, v in model.p.items()}, model.of)
        read, _ = own.follow(((r.distinct, r.blocks()) for *_, r in _reads(batches)), rate, BATCH)
        bw.release()
        total = int(read.sum())
        if not total:
            return
        met = np.flatnonzero(read)
        moved = np.concatenate([own.p["embed"][met] - model.p["embed"][met], _rest(own.p) - _rest(model.p)])
        more = len(moved) - len(met)
        key, weight = np.concatenate([met, IDS + np.arange(more)]), np.concatenate([read[met], np.full(more, total)])
        moved = (moved * weight[:, None]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(weight), *(pa.array(np.ascontiguousarray(c)) for c in moved.T)], ["key", "weight", *names])

    schema = "key long, weight long, " + ", ".join(f"{x} float" for x in names)
    found = reads.mapInArrow(run, schema).groupBy("key").agg(F.sum("weight").alias("weight"), *(F.sum(x).cast("float").alias(x) for x in names)).toPandas()  # as many rows as there are weights
    if not len(found):
        return
    key = found["key"].to_numpy()
    moved = (found[names].to_numpy() / found["weight"].to_numpy()[:, None]).astype(np.float32)
    model.p["embed"][key[key < IDS]] += moved[key < IDS]
    rest = _rest(model.p)
    rest[key[key >= IDS] - IDS] += moved[key >= IDS]
    flat, at = rest.ravel(), 0
    for k in sorted(model.p):
        if k != "embed":
            v = model.p[k]
            model.p[k] = flat[at : at + v.size].reshape(v.shape).copy()
            at += v.size


def train(docs: DataFrame, counts: Counts, files: tuple[str, str], folds: int) -> Attention:
    """The network, learned as the module's text describes, from the words that came with
    the counts or else from ``docs``."""
    model = Attention.fresh(counts.mass, classes_of(counts.mass, counts.spread))
    reads = read_words(docs, files, folds) if counts.reads is None else counts.reads
    for r in range(ROUNDS if counts.texts else 0):
        learn_round(model, reads.where(F.col("round") == r), RATE * (1 - 7 / 8 * r / max(1, ROUNDS - 1)))
    return model


def _head(words: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words' hashes, sorted, and counts: whole steps of the counts'
    logarithm, at most ``head`` words."""
    step = F.floor(F.log2("n") * 16).cast("int").alias("step")
    left, least = head, None
    for r in words.groupBy(step).agg(F.count("*").alias("m"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():  # at most 16 * 64 rows
        if r["m"] > left:
            break
        left, least = left - r["m"], r["n"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = words.where(F.col("n") >= least).select("key", "n").toPandas()
    order = np.argsort(top["key"].to_numpy().view(np.uint64), kind="stable")
    return top["key"].to_numpy().view(np.uint64)[order], top["n"].to_numpy()[order]


def lm_scores(docs: DataFrame, files: tuple[str, str] | None = None, folds: int = FOLDS, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    tune(docs.sparkSession)
    files, scratch = files or packing.vocabulary(), Scratch(docs.sparkSession)
    counts = count(docs, files, folds, scratch)
    ends = counts.texts
    big_n, big_v = int(counts.mass.sum()), int(counts.distinct.sum())
    keys, often = _head(counts.words, head)
    often = np.log10(often + 0.1)
    model = train(docs, counts, files, folds)
    by_class = np.bincount(model.of, counts.mass + 0.1 * counts.distinct, int(model.of.max() // CLASSES + 1) * CLASSES) + 0.1
    share = np.log10(by_class)[model.of]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, done = TaskContext.get().partitionId(), 0
        for batch, i, read in _reads(batches):
            m = len(read.first) - 1
            each = model.score(read.distinct, read.blocks()) - share[read.distinct.anchor[read.words]]
            by_text = np.add.reduceat(each, read.first[:-1])
            spot = np.minimum(np.searchsorted(keys, read.keys), max(len(keys) - 1, 0))
            known = keys[spot] == read.keys if len(keys) else np.zeros(len(read.keys), dtype=bool)
            value = np.append(np.where(known, often[spot] if len(keys) else 0.0, 0.0), 0.0)
            doc = np.repeat(np.arange(m), np.diff(read.first))
            inside = np.append(known, False)[read.words]
            sums = np.bincount(doc, value[read.words], m)
            outside = ~inside & (read.words < len(read.keys))
            tail, n = np.unique(doc[outside] * len(read.counts) + read.words[outside], return_counts=True)
            edges = np.searchsorted(tail // len(read.counts), np.arange(m + 1))
            pairs = pa.StructArray.from_arrays([pa.array(read.keys[tail % len(read.counts)].view(np.int64)), pa.array(n)], ["key", "n"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((np.int64(task) << 40) + done + np.arange(m)),
                    batch.column("doc_id")[i].values,
                    pa.array(np.full(m, batch.column("round")[i].as_py() == HELD_OUT)),
                    pa.array(np.diff(read.first)),
                    pa.array(np.bincount(doc[inside], minlength=m)),
                    pa.array(sums),
                    pa.array(by_text),
                    pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pairs),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "head_known", "head_sum", "classes", "tail"],
            )
            done += m
        bw.release()

    schema = "row long, doc_id long, held_out boolean, n_tokens long, head_known long, head_sum double, classes double, tail array<struct<key:long,n:long>>"
    scored = scratch.keep(counts.reads.mapInArrow(run, schema), "lm_scored")
    scratch.drop(counts.reads)
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.key", F.col("t.n").alias("times"))
    met = tail.join(counts.words.select("key", "n"), "key").groupBy("row").agg(F.sum("times").alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("n") + 0.1)).alias("tail_sum"))
    known = F.col("head_known") + F.coalesce("tail_known", F.lit(0))
    unknown = F.col("n_tokens") - 1 - known
    total = F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) + unknown * F.lit(float(np.log10(0.1))) + F.lit(float(np.log10(ends + 0.1)))
    return scored.drop("tail").join(met, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (known + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(big_n).cast("long").alias("train_tokens"),
        (total - F.col("n_tokens") * F.lit(float(np.log10(big_n + 0.1 * (big_v + 1))))).alias("base_score"),
        (total + F.col("classes")).alias("score"),
    )
