"""Exact deduplication by a tree-merge of sorted digest runs.

Each task turns its texts into a run: records (digest, size, check, keep, n) in digest
order with one record per distinct text, packed into chunks. Runs are merged in rounds of
a binomial tree: in round r the runs of ``FAN_IN`` neighbouring groups are exchanged and
multiway merged into one, sliced by the digest's first bits, so that no round, and not
the root either, puts the whole table into one task. Only chunks are put in order, by
their first digests; records stay in the order of their runs, and a merge holds what is
left of one chunk of each run, whatever the size of a group of copies. Before a round a
task has at most one record for a text, however many copies there are.

Every merge verifies what it joins: records of one SHA-256 must agree in the text's length
and a second hash, or the job fails. The row that stays is that with the largest doc_id
by default (``keep="min"``: the smallest).

Edge cases: a null text counts as empty. Texts are compared as they are. Rows repeated
with the same doc_id count as members and all report the same keep_id; ``kept`` holds
for each of them with that doc_id. A null doc_id never stays unless all are null. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import bytewords as bw
from gridloom.llm.session import Scratch, if_small, tune, unused

FAN_IN = 16
CHUNK = 4096  # records of a run that travel together
RECORD = np.dtype([("digest", "S32"), ("size", "<i8"), ("check", "<i8"), ("keep", "<i8"), ("named", "?"), ("n", "<i8")])
RUN = "origin int, slice int, head binary, records binary"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the digest columns of each row, without leaving the JVM."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
        F.xxhash64(text).alias("check"),
    )


def merged(parts: list[np.ndarray], largest: bool) -> np.ndarray:
    """One sorted run of several, with a record for each text, verified."""
    every = np.concatenate(parts)
    every = every[np.argsort(every["digest"], kind="stable")]  # merges the sorted parts
    if not len(every):
        return every
    new = np.append(True, every["digest"][1:] != every["digest"][:-1])
    first = np.flatnonzero(new)
    if len(first) == len(every):
        return every
    own = first[np.cumsum(new) - 1]
    if (every["size"] != every["size"][own]).any() or (every["check"] != every["check"][own]).any():
        raise ValueError("two texts with one digest")
    out = every[first]
    out["n"] = np.add.reduceat(every["n"], first)
    worst = np.iinfo(np.int64).min if largest else np.iinfo(np.int64).max
    out["keep"] = (np.maximum if largest else np.minimum).reduceat(np.where(every["named"], every["keep"], worst), first)
    out["named"] = np.logical_or.reduceat(every["named"], first)
    return out


def _records(batch: pa.RecordBatch) -> np.ndarray:
    """From (digest, size, check, doc_id)."""
    out = np.zeros(batch.num_rows, dtype=RECORD)
    digest = batch.column(0).cast(pa.large_binary())
    offset = np.frombuffer(digest.buffers()[1], np.int64)[digest.offset]
    out["digest"] = np.frombuffer(digest.buffers()[2], "S32", batch.num_rows, int(offset))
    out["size"], out["check"] = batch.column(1).to_numpy(), batch.column(2).to_numpy()
    out["named"] = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
    out["keep"] = batch.column(3).fill_null(0).to_numpy()
    out["n"] = 1
    return out


def _head(record: np.void) -> bytes:
    return record["digest"].ljust(32, b"\0")  # numpy drops zeros at the end


def _chunks(run: np.ndarray, origin: int, wide: int) -> Iterator[pa.RecordBatch]:
    """A sorted run as rows of up to CHUNK records, cut where a slice of digests ends."""
    if not len(run):
        return
    prefix = run["digest"].astype("S32").view(np.uint8).reshape(-1, 32)[:, :3].astype(np.int64)
    part = ((prefix[:, 0] << 16 | prefix[:, 1] << 8 | prefix[:, 2]) * wide) >> 24
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(run)]])
    rows = [(int(part[i]), _head(run[i]), run[i : min(i + CHUNK, b)].tobytes()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) for i in range(a, b, CHUNK)]
    columns = [*zip(*rows, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([origin] * len(rows), pa.int32()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["origin", "slice", "head", "records"])


def merged_runs(found: DataFrame, keep: str = "max", fan_in: int = FAN_IN) -> DataFrame:
    """One row per distinct text: digest, size, check, keep and n, after all rounds."""
    spark, largest = found.sparkSession, keep == "max"
    parts = max(1, found.rdd.getNumPartitions())
    slices = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, held = TaskContext.get().partitionId(), np.zeros(0, dtype=RECORD)
        for batch in batches:
            held = merged([held, _records(batch)], largest)
            if len(held) > 16 * CHUNK:  # rows come sorted, so all but the last record are done
                yield from _chunks(held[:-1], task, slices)
                held = held[-1:]
        yield from _chunks(held, task, slices)

    runs = found.select("digest", "size", "check", F.col("doc_id").alias("keep")).sortWithinPartitions("digest").mapInArrow(first, RUN)
    groups = parts
    while True:
        groups = -(-groups // fan_in)

        def round_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Chunks come by group, slice and head: what is below a chunk's head is final.
            # What is held are the rest of one chunk of each run at most.
            at, held = None, np.zeros(0, dtype=RECORD)
            for batch in batches:
                for origin, part, head, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    done = len(held) if (origin, part) != at else int(np.searchsorted(held["digest"], np.bytes_(head)))
                    if done:
                        yield from _chunks(held[:done], at[0], slices)
                    at = (origin, part)
                    held = merged([held[done:], np.frombuffer(records, dtype=RECORD)], largest)
            if at:
                yield from _chunks(held, at[0], slices)

        def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in round_(batches):
                for records in batch.column(3).to_pylist():
                    x = np.frombuffer(records, dtype=RECORD)
                    digest = pa.array([_head(r) for r in x], pa.binary())
                    yield pa.RecordBatch.from_arrays([digest, pa.array(x["size"]), pa.array(x["check"]), pa.array(x["keep"], mask=~x["named"]), pa.array(x["n"])], ["digest", "size", "check", "keep", "n"])
            bw.release()

        group = F.floor(F.col("origin") / fan_in).cast("int").alias("origin")
        dealt = runs.select(group, "slice", "head", "records").repartition(slices, "origin", "slice").sortWithinPartitions("origin", "slice", "head")
        if groups == 1:
            return dealt.mapInArrow(last, "digest binary, size long, check long, keep long, n long")
        runs = dealt.mapInArrow(round_, RUN)


def _grouped(docs: DataFrame, keep: str, scratch: Scratch) -> DataFrame:
    """doc_id, digest, size, check of each row, with keep and n of its group of copies;
    n is null for a text that occurs once."""
    tune(docs.sparkSession)
    found = scratch.keep(digests(docs), "digests")
    copied = scratch.keep(merged_runs(found, keep).where("n > 1").select("digest", "keep", "n"), "copied")
    return found.join(copied, "digest", "left")


def exact_dedup(docs: DataFrame, keep: str = "max") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``."""
    joined = _grouped(docs, keep, Scratch(docs.sparkSession))
    alone = F.col("n").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep"))
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, keep: str = "max") -> DataFrame:
    """``docs`` with one row of each text, all columns as they are. Of rows repeated with
    the doc_id that stays, any one stays.

    Only the keys of what goes meet the texts: broadcast where their counted rows allow
    it, else merged."""
    scratch = Scratch(docs.sparkSession)
    copies = _grouped(docs, keep, scratch).where("n is not null")
    did, size, check = unused(docs, "did", "size", "check")
    # A null doc_id is told from 0 by the sign of the size.
    named = lambda i, n: [F.coalesce(i, F.lit(0)).alias(did), F.when(i.isNull(), -1 - n).otherwise(n).alias(size)]
    keys = [*named(F.col("doc_id"), F.col("size")), F.col("check").alias(check)]
    stays = F.col("doc_id").eqNullSafe(F.col("keep"))
    gone = scratch.keep(copies.where(~stays).select(*keys).distinct(), "gone")
    twice = scratch.keep(copies.where(stays).groupBy(*keys).count().where("count > 1").drop("count"), "twice")
    scratch.close(gone, twice)
    text, by = F.coalesce(F.col("text"), F.lit("")), [did, size, check]
    out = docs.select("*", *named(F.col("doc_id").cast("long"), F.octet_length(text).cast("long")), F.xxhash64(text).alias(check)).join(if_small(gone)[0], by, "left_anti")
    if twice.limit(1).count():
        once = out.join(if_small(twice)[0], by, "left_semi").dropDuplicates(by)
        out = out.join(if_small(twice)[0], by, "left_anti").unionByName(once)
    return out.select(*docs.columns)
