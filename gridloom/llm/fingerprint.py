"""Document fingerprints: a quartile bucket digest.

Byte triplets of a text (a byte, the third and the seventh after it; the text ends in
zeros) are hashed into ``BUCKETS`` counts. The digest says of each bucket in which
quarter of the text's own counts it lies, two bits a bucket, after a byte for the
logarithm of the length. Triplets that reach over a word's end make the counts follow
the text rather than its language. Two digests differ by the mean distance of their
quarters plus a bounded share for unlike lengths; ``likeness`` scales that to 1 (equal)
down to 0 (as far as chance, ``FARTHEST``, or further).

``fingerprints`` also compares each text with an edited one, whose last third is replaced
by the beginning of the next document in descending order of doc_id. The table is dealt
out once, by ranges of doc_id; tasks go through their rows in order and hold one text
back. The first and last text of each task are written beside the results and joined by
the tasks' numbers, so no task sees more than its range.

Edge cases: a null text is empty; empty texts have the digest of no triplets and are
alike. Texts are hashed piece by piece, whatever their length. Of rows with one doc_id
the order is that of a hash of the text; whole repeated rows may be dealt to several
tasks. A null doc_id comes last. A single row follows itself. Extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import bytewords as bw
from gridloom.llm.session import Scratch, tune

BUCKETS = 512
#: Places of the second and third byte of a triplet after its first.
SECOND, THIRD = 3, 7
#: Positions hashed in one step.
STEP = 1 << 19
#: A step of the length's logarithm, and what unlike lengths add to the difference.
BASE, PER_STEP, MOST_STEPS = 1.1, 0.02, 12
#: Mean distance of quarters drawn by chance.
FARTHEST = 1.25

_DRAWN = np.random.Generator(np.random.PCG64(20_250_311)).integers(0, BUCKETS, (3, 256), dtype=np.uint16)


def counts(raws: list[bytes]) -> np.ndarray:
    """[text, bucket]: triplets of each text by bucket."""
    gap = bytes(THIRD)
    raw = np.frombuffer(gap.join(raws) + gap, dtype=np.uint8)
    sizes = np.array([len(x) for x in raws], dtype=np.int64)
    starts = np.cumsum(sizes + THIRD) - sizes - THIRD
    out = np.zeros(len(raws) * BUCKETS, dtype=np.int64)
    for lo in range(0, len(raw) - THIRD, STEP):
        hi = min(lo + STEP, len(raw) - THIRD)
        bucket = _DRAWN[0][raw[lo:hi]] ^ _DRAWN[1][raw[lo + SECOND : hi + SECOND]] ^ _DRAWN[2][raw[lo + THIRD : hi + THIRD]]
        a, b = np.searchsorted(starts, [lo, hi - 1], "right") - 1
        # Texts a..b lie here; the gaps behind them don't count.
        begin, end = np.maximum(starts[a : b + 1], lo), np.minimum(starts[a : b + 1] + sizes[a : b + 1], hi)
        long = np.maximum(end - begin, 0)
        text = np.repeat(np.arange(b - a + 1), long)
        own = bucket[bw.ragged(begin - lo, long)]
        out[a * BUCKETS : (b + 1) * BUCKETS] += np.bincount(text * BUCKETS + own, minlength=(b - a + 1) * BUCKETS)
    return out.reshape(len(raws), BUCKETS)


def digests(texts: list[str]) -> np.ndarray:
    """[text, byte]: the digest of each text, its length's byte first."""
    raws = [x.encode() for x in texts]
    if not raws:
        return np.zeros((0, 1 + BUCKETS // 4), dtype=np.uint8)
    found = counts(raws)
    order = np.sort(found, axis=1)
    level = sum((found > order[:, BUCKETS * q // 4 - 1][:, None]).astype(np.uint8) for q in (1, 2, 3))
    out = np.empty((len(raws), 1 + BUCKETS // 4), dtype=np.uint8)
    sizes = np.array([len(x) for x in raws], dtype=np.float64)
    out[:, 0] = np.where(sizes > 0, np.minimum(1 + np.floor(np.log(np.maximum(sizes, 1)) / np.log(BASE)), 255), 0)
    level = level.reshape(len(raws), BUCKETS // 4, 4)
    out[:, 1:] = level[:, :, 0] << 6 | level[:, :, 1] << 4 | level[:, :, 2] << 2 | level[:, :, 3]
    return out


def _levels(digest: np.ndarray) -> np.ndarray:
    return np.stack([digest[:, 1:] >> s & 3 for s in (6, 4, 2, 0)]).astype(np.int8)


def closeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of digests, row by row: 1 for equal ones, 0 from the bound on."""
    far = np.abs(_levels(a) - _levels(b)).sum(axis=(0, 2)) / BUCKETS
    steps = np.abs(a[:, 0].astype(np.int64) - b[:, 0]) - 1  # neighbouring steps are near
    return 1.0 - np.minimum((far + PER_STEP * np.clip(steps, 0, MOST_STEPS)) / FARTHEST, 1.0)


def packed(digest: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in digest], pa.binary())


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint columns; null where one of them is."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        both = x.notna() & y.notna()
        out = pd.Series(np.nan, index=x.index, dtype=object).where(both, None)
        if both.any():
            bytes_of = lambda s: np.frombuffer(bytes.fromhex("".join(s[both])), np.uint8).reshape(int(both.sum()), -1)
            out[both] = closeness(bytes_of(x), bytes_of(y))
        return out.astype("Float64")

    return run(a, b)


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _compared(texts: list[str], following: list[str], own: np.ndarray, beside: np.ndarray) -> list[pa.Array]:
    """n_chars, edited_sha256, fingerprints and likenesses of rows with their next texts;
    hashes as bytes."""
    changed = [edited(x, y) for x, y in zip(texts, following, strict=True)]
    other = digests(changed)
    sha = [hashlib.sha256(x.encode()).digest() for x in changed]
    return [
        pa.array([len(x) for x in texts], pa.int64()),
        pa.array(sha, pa.binary()),
        packed(own),
        packed(other),
        pa.array(closeness(own, other)),
        pa.array(closeness(own, beside)),
    ]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
HASHES = NAMES[2:5]
RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
DONE, FIRST, LAST = 0, 1, 2


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows of a task but the last, and the texts at both ends."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    names = [*NAMES, "task", "kind", "body"]
    held_id, held, held_digest = None, None, np.zeros((0, 1 + BUCKETS // 4), dtype=np.uint8)

    def end(kind: int) -> pa.RecordBatch:
        empty = [pa.nulls(1, t) for t in (pa.int64(), *[pa.binary()] * 3, *[pa.float64()] * 2)]
        return pa.RecordBatch.from_arrays([pa.array([held_id], pa.int64()), *empty, pa.array([task], pa.int32()), pa.array([kind], pa.int32()), pa.array([held], pa.string())], names)

    for batch in bw.chunks(batches):
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        found = digests(texts)
        if held is None:
            held_id, held = ids[0], texts[0]
            yield end(FIRST)
        else:
            ids, texts, found = [held_id, *ids], [held, *texts], np.concatenate([held_digest, found])
        n = len(ids) - 1
        if n:
            columns = _compared(texts[:-1], texts[1:], found[:-1], found[1:])
            yield pa.RecordBatch.from_arrays([pa.array(ids[:-1], pa.int64()), *columns, pa.array([task] * n, pa.int32()), pa.array([DONE] * n, pa.int32()), pa.nulls(n, pa.string())], names)
        held_id, held, held_digest = ids[-1], texts[-1], found[-1:]
    if held is not None:
        yield end(LAST)


def _at_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bw.chunks(batches, "body"):
        texts, following = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), *_compared(texts, following, digests(texts), digests(following))], NAMES)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next of every row of ``docs``."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The last key deals whole repeated rows, whose order says nothing, to several tasks.
    rows = rows.select("*", F.xxhash64("text").alias("order"), F.monotonically_increasing_id().alias("row"))
    keys = [F.col("doc_id").desc_nulls_last(), "order", "row"]
    dealt = rows.repartitionByRange(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys).sortWithinPartitions(*keys)
    found = Scratch(spark).keep(dealt.select("doc_id", "text").mapInArrow(_in_order, RESULT + ", task int, kind int, body string"), "fingerprints")
    # One number of each task that had rows: a text's next is the first of the next such task.
    tasks = sorted(r["task"] for r in found.where(F.col("kind") == LAST).select("task").collect())
    after = spark.createDataFrame([*zip(tasks, [*tasks[1:], *tasks[:1]], strict=True)], "task int, after int")
    ends = found.where(F.col("kind") == LAST).select("doc_id", "body", "task").join(F.broadcast(after), "task")
    firsts = found.where(F.col("kind") == FIRST).select(F.col("task").alias("after"), F.col("body").alias("following"))
    last = ends.join(firsts, "after").select("doc_id", "body", "following").mapInArrow(_at_ends, RESULT)
    every = found.where(F.col("kind") == DONE).select(*NAMES).unionByName(last)
    return every.select(*(F.lower(F.hex(c)).alias(c) if c in HASHES else F.col(c) for c in NAMES))
