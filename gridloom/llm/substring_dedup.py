"""Removal of passages that occur elsewhere, with a log-structured fingerprint index.

A window is ``width`` consecutive words. Every word covered by a window whose word
sequence also starts anywhere else, in the same document or another, is removed;
windows are judged on the input, not on what is left.

Indexing every window would cost many times the text. Instead each window is
represented by its anchor, the window of ``ANCHOR`` words inside it with the smallest
hash: equal windows have equal anchors at equal distances, and neighbouring windows
mostly share theirs, so anchors are a fifteenth as many. The steps:

1. ``FingerprintIndex``: batches of documents come one after the other. A batch's
   anchor hashes are counted and sorted into an immutable run; it is merge-joined with
   the runs of history to find what repeats; runs are compacted when there are
   several. Runs are bucketed by hash, so history isn't shuffled again.
2. Blocks: the windows that share one anchor occurrence form a block of words. Of the
   blocks with a repeated anchor, those whose whole word sequence occurs twice are
   verified at once, however many copies there are.
3. The other blocks, where a shared passage begins or ends, are verified window by
   window, each distinct block once.
4. The marked windows go back to their documents, and the words under them go.

Verified means: equal in a 64-bit hash of the anchor and another, with its own
constants, of the whole block or window, so 128 bits together.

Edge cases: null texts have no words. A document of fewer than ``width`` words keeps
all. Rows repeated with one doc_id are separate places, so they remove each other.
Extra columns are ignored; an empty table gives an empty result. Very long texts are
handled whole, in bounded pieces of hashing. doc_id may be null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bytewords as bw
from gridloom.llm.session import Scratch, tune, unused

WIDTH = 35
ANCHOR = 8
BATCHES = 4  # the last is joined with the compacted run of those before
COMPACT_AT = 2
SPAN = 64  # windows in a block, and bits in its mask
NAMELESS = 1 << 32
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def anchors(hashes: np.ndarray, doc: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, position of each window's anchor, hash of each anchor position)."""
    g = bw.window_hashes(hashes, ANCHOR)
    n, span = len(hashes) - width + 1, width - ANCHOR + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), g
    at, size = np.arange(len(g)), 1
    while size * 2 <= span:
        a, b = at[:-size], at[size:]
        at = np.where(g[a] <= g[b], a, b)
        size *= 2
    if span > size:
        a, b = at[: -(span - size)], at[span - size :]
        at = np.where(g[a] <= g[b], a, b)
    starts = np.flatnonzero(bw.within(doc, width))
    return starts, at[:n][starts], g


def blocks(found: bw.Words, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """Per anchor occurrence: anchor hash, hash of the block's words, its document's
    row, its first window's start in the document, its number of windows."""
    h = found.hashes()
    starts, at, g = anchors(h, found.doc, width)
    if not len(starts):
        return tuple(np.zeros(0, np.uint64) for _ in range(5))
    new = np.append(True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))
    first = np.flatnonzero(new)
    since = np.arange(len(starts)) - first[np.cumsum(new) - 1]
    first = np.flatnonzero(since % SPAN == 0)  # a block has SPAN windows at most
    count = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    other = found.hashes(1)
    base = bw._WORD_BASES[1]
    total = np.zeros(len(other) + 1, dtype=np.uint64)
    np.cumsum(other * bw.powers(base, len(other)), out=total[1:])
    end = begin + count + width - 1
    whole = bw.mix((total[end] - total[begin]) * bw.powers(bw.inverse(base), len(other) + 1)[begin] + (at[first] - begin).astype(np.uint64))
    row = found.doc[begin]
    return g[at[first]], whole, row, begin - found.first[row], count


def _row_key(doc_id, text) -> tuple:
    """(did, k) tells rows apart: k separates different texts with one doc_id, and has a
    bit of its own for a null doc_id."""
    did = doc_id.cast("long")
    return F.coalesce(did, F.lit(0)), F.crc32(text.cast("binary")) + F.when(did.isNull(), F.lit(NAMELESS)).otherwise(F.lit(0))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    did, k = _row_key(F.col("doc_id"), text)
    return docs.select(did.alias("did"), k.alias("k"), text.alias("text"))


class FingerprintIndex:
    """Sorted immutable runs of fingerprint counts (fp, n), bucketed by fp, so that a
    batch is merge-joined with history where it lies. ``save`` writes the index as one
    run, and ``open`` goes on from it in another session."""

    def __init__(self, spark: SparkSession, compact_at: int = COMPACT_AT):
        self.spark, self.compact_at, self.runs, self.scratch = spark, compact_at, [], Scratch(spark)

    @classmethod
    def open(cls, spark: SparkSession, path: str, compact_at: int = COMPACT_AT) -> FingerprintIndex:
        index = cls(spark, compact_at)
        index.runs.append(index.scratch.bucketed(spark.read.schema("fp long, n long").parquet(path), "run", "fp"))
        return index

    def save(self, path: str) -> None:
        self.compact()
        self.runs[0].write.parquet(path)

    def add(self, fingerprints: DataFrame) -> DataFrame:
        """Index a batch of fingerprints (column fp, repeated as they occur); the
        distinct ones that occur twice in the batch, or in it and in history."""
        run = self.scratch.bucketed(fingerprints.groupBy("fp").agg(F.count("*").alias("n")), "run", "fp")
        found = run.where("n > 1").select("fp")
        for old in self.runs:
            found = found.union(run.join(old.select("fp").hint("merge"), "fp", "left_semi").select("fp"))
        self.runs.append(run)
        found = self.scratch.keep(found.distinct(), "repeated")
        if len(self.runs) > self.compact_at:
            self.compact()
        return found

    def compact(self) -> None:
        """Merge all runs into one; the old ones go."""
        every = self.runs[0]
        for run in self.runs[1:]:
            every = every.unionByName(run)
        # Dealt out anew before it is summed: runs are read with or without their buckets,
        # as the planner likes, and a union of both kinds isn't partitioned by fp.
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        merged = self.scratch.bucketed(every.repartition(n, "fp").groupBy("fp").agg(F.sum("n").alias("n")), "run", "fp")
        self.scratch.drop(*self.runs)
        self.runs = [merged]

    def close(self) -> None:
        self.scratch.close()


def _anchor_rows(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.chunks(batches):
            found = bw.words(batch.column(0), bw.NOT_SPACE)
            _, at, g = anchors(found.hashes(), found.doc, width)
            if len(at):
                once = at[np.append(True, at[1:] != at[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(g[once].view(np.int64))], ["fp"])

    return docs.mapInArrow(run, "fp long")


def _block_rows(docs: DataFrame, width: int) -> DataFrame:
    """(fp, bh, did, k, place) of each anchor occurrence; place: start * SPAN + windows - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.chunks(batches):
            fp, bh, row, start, count = blocks(bw.words(batch.column(2), bw.NOT_SPACE), width)
            if len(fp):
                did, k = (batch.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1))
                columns = [fp.view(np.int64), bh.view(np.int64), did, k, start * SPAN + count - 1]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["fp", "bh", "did", "k", "place"])

    return docs.mapInArrow(run, "fp long, bh long, did long, k long, place long")


def _packed(docs: DataFrame) -> DataFrame:
    """(did, k, z): texts compressed, so that moving them costs less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in bw.chunks(batches):
            raw, offsets = bw.text_bytes(batch.column(2))
            z = [squeeze.compress(raw[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary())], ["did", "k", "z"])

    return docs.mapInArrow(run, "did long, k long, z binary")


def _unpack(column: pa.Array) -> list[str]:
    loose = zstandard.ZstdDecompressor()
    return [loose.decompress(z).decode() for z in column.to_pylist()]


def _window_rows(docs: DataFrame, width: int) -> DataFrame:
    """From (did, k, z, blocks) the windows of the listed blocks, each with its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                listed = one.column(3).flatten()
                fp, bh, place, n = (listed.field(j).to_numpy(zero_copy_only=False) for j in range(4))
                windows = bw.window_hashes(bw.words(pa.array(_unpack(one.column(2)), pa.large_string()), bw.NOT_SPACE).hashes(1), width, 1)
                count = place % SPAN + 1
                own = bw.ragged(place // SPAN, count)
                spread = lambda x, count=count: pa.array(np.repeat(x, count))
                nth = own - np.repeat(place // SPAN, count)
                yield pa.RecordBatch.from_arrays([spread(fp), spread(bh), pa.array(nth), pa.array(windows[own].view(np.int64)), spread(n)], ["fp", "bh", "nth", "wh", "n"])

    return docs.mapInArrow(run, "fp long, bh long, nth long, wh long, n long")


def joined_words(found: bw.Words, keep: np.ndarray) -> list[bytes]:
    """Each text's kept words, joined by one space."""
    start, size = found.start[keep], found.end[keep] - found.start[keep]
    at = bw.ragged(start, size + 1)
    ends = np.cumsum(size + 1) - 1
    out = found.raw[np.minimum(at, len(found.raw) - 1)] if len(at) else np.zeros(0, np.uint8)
    out = out.copy()
    out[ends] = 0x20
    kept = np.concatenate([[0], np.cumsum(keep)])
    edge = np.concatenate([[0], ends + 1])[kept[found.first]]
    return [out[a : max(a, b - 1)].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _whole(docs: DataFrame) -> DataFrame:
    """The result of documents from which nothing is removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.chunks(batches):
            found = bw.words(batch.column(2), bw.NOT_SPACE)
            sha = [hashlib.sha256(x).hexdigest() for x in joined_words(found, np.ones(len(found.start), dtype=bool))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(found.counts.astype(np.int64)), pa.array(sha)], ["did", "k", "doc_id", "n_words", "sha"])

    return docs.mapInArrow(run, "did long, k long, doc_id long, n_words long, sha string")


def _cut(docs: DataFrame, width: int) -> DataFrame:
    """From (did, k, z, marks) what is left of documents with marked windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                marks = one.column(3).flatten()
                place, mask = (marks.field(j).to_numpy(zero_copy_only=False) for j in range(2))
                found = bw.words(pa.array(_unpack(one.column(2)), pa.large_string()), bw.NOT_SPACE)
                n = len(found.start)
                change = np.zeros(n + 1, dtype=np.int64)
                count = place % SPAN + 1
                nth = bw.ragged(np.zeros(len(place), np.int64), count)
                on = (np.repeat(mask, count) >> nth) & 1 == 1
                begin = (np.repeat(place // SPAN, count) + nth)[on]
                np.add.at(change, begin, 1)
                np.add.at(change, begin + width, -1)
                keep = np.cumsum(change)[:n] == 0
                text = joined_words(found, keep)[0]
                columns = [one.column(0), one.column(1), pa.array([int(n - keep.sum())]), pa.array([hashlib.sha256(text).hexdigest()]), pa.array([text.decode()])]
                yield pa.RecordBatch.from_arrays(columns, ["did", "k", "n_removed", "cut_sha", "kept_text"])

    return docs.mapInArrow(run, "did long, k long, n_removed long, cut_sha string, kept_text string")


def marks(docs: DataFrame, scratch: Scratch, width: int = WIDTH, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """(did, k, marks) of documents with repeated windows, and their packed texts."""
    if width < ANCHOR:
        raise ValueError(f"a window has {ANCHOR} words at least")
    spark = docs.sparkSession
    tune(spark)
    rows = _keyed(docs)
    index = FingerprintIndex(spark)
    repeated = None
    for b in range(batches):
        batch = rows.where(F.pmod(F.xxhash64("did"), F.lit(batches)) == b).select("text")
        found = index.add(_anchor_rows(batch, width))
        repeated = found if repeated is None else repeated.union(found)
    hits = scratch.keep(_block_rows(rows, width).join(repeated, "fp", "left_semi"), "hits")
    index.close()
    place = F.struct("did", "k", "place")
    distinct = scratch.keep(hits.groupBy("fp", "bh").agg(F.count("*").alias("n"), F.min(place).alias("at")), "blocks")
    mixed = distinct.groupBy("fp").agg(F.count("*").alias("kinds")).where("kinds > 1").select("fp")
    listed = distinct.join(mixed, "fp").select("at.did", "at.k", F.struct("fp", "bh", "at.place", "n").alias("b"))
    listed = listed.groupBy("did", "k").agg(F.collect_list("b").alias("blocks"))
    texts = scratch.bucketed(_packed(rows).join(hits.select("did", "k").distinct(), ["did", "k"], "left_semi"), "texts", "did", "k")
    windows = scratch.keep(_window_rows(texts.join(listed, ["did", "k"]).select("did", "k", "z", "blocks"), width), "windows")
    twice = windows.groupBy("fp", "wh").agg(F.sum("n").alias("n")).where("n > 1").select("fp", "wh")
    ragged = windows.where("n = 1").join(twice, ["fp", "wh"], "left_semi").groupBy("fp", "bh").agg(F.bit_or(F.expr("shiftleft(1L, cast(nth as int))")).alias("mask"))
    single = distinct.where("n = 1").join(ragged, ["fp", "bh"]).select("at.did", "at.k", "at.place", "mask")
    copied = hits.join(distinct.where("n > 1").select("fp", "bh"), ["fp", "bh"], "left_semi").select("did", "k", "place", F.lit(-1).cast("long").alias("mask"))
    marked = single.unionByName(copied).groupBy("did", "k").agg(F.collect_list(F.struct("place", "mask")).alias("marks"))
    return marked, texts


def _cuts(docs: DataFrame, scratch: Scratch, width: int, batches: int) -> DataFrame:
    """(did, k, n_removed, cut_sha, kept_text) of documents that lose something."""
    marked, texts = marks(docs, scratch, width, batches)
    return _cut(texts.join(marked, ["did", "k"]).select("did", "k", "z", "marks"), width)


def substring_dedup(docs: DataFrame, width: int = WIDTH, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    cut = scratch.keep(_cuts(docs, scratch, width, batches).select("did", "k", "n_removed", "cut_sha").dropDuplicates(["did", "k"]), "cuts")
    scratch.close(cut)
    rows = _keyed(docs).select("did", "k", "text", F.when(F.col("k") < NAMELESS, F.col("did")).alias("doc_id"))
    return (
        _whole(rows)
        .join(cut, ["did", "k"], "left")
        .select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("cut_sha", "sha").alias("kept_sha256"))
    )


def kept_texts(docs: DataFrame, width: int = WIDTH, batches: int = BATCHES) -> DataFrame:
    """``docs`` with what is left of each text in ``text``; a text that loses nothing stays
    as it is, and of others the kept words are joined by one space."""
    scratch = Scratch(docs.sparkSession)
    (did, k, kept), text = unused(docs, "did", "k", "kept"), F.coalesce(F.col("text"), F.lit(""))
    cut = _cuts(docs, scratch, width, batches).select(F.col("did").alias(did), F.col("k").alias(k), F.col("kept_text").alias(kept)).dropDuplicates([did, k])
    cut = scratch.keep(cut, "kept")
    scratch.close(cut)
    own = _row_key(F.col("doc_id"), text)
    out = docs.withColumns({did: own[0], k: own[1]}).join(cut, [did, k], "left")
    return out.withColumn("text", F.coalesce(kept, "text")).select(*docs.columns)
