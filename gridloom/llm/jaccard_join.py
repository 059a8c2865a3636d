"""Similarity self-join of texts by the Jaccard index of their word n-grams.

A chosen-path join. In each of ``runs_for(recall)`` independent runs every set samples a
few of its n-grams by a shared hash, so that similar sets sample shared ones, and is put
into the buckets of what it sampled. Small buckets are compared by brute force; large
ones are split again, by samples of their own, until they are small. A pair at the
threshold stays together along some path with at least the chance of ``_chance()``; the
number of runs follows from the target recall.

Texts with equal n-gram sets are one set throughout, so a group of copies of any size is
one row. Comparing goes in rounds, and each drops the buckets that lie in one class by
then as soon as they are seen:

1. The first ``FIRST_ROUND`` runs, without splitting. Buckets of more than ``LIMIT`` sets
   go in blocks of so many, each with the same few leaders of the bucket, so a large
   class of near copies is linked through its leaders before anything is split.
2. The other runs in the same way.
3. The large buckets of all runs that still have several classes: up to ``WIDE`` sets
   they are compared as they are, and larger ones are split, level by level. Where the
   parts would be as many rows as the bucket, its sets have much in common (a licence, a
   template): what most of them hold is left out and the rest is sampled the more. A
   bucket of which one class has nearly all, or whose sets hardly differ but for that,
   isn't split: the sets outside its largest class are compared with the whole bucket,
   in blocks, in a round of their own.

So there is no cap on partners, and no task gets more than some thousand sets at once.
Pairs are pruned by a sketch (one-permutation hashing) before any text is moved; every
reported link is verified on the whole sets. Texts travel compressed, and each task
makes the n-grams it needs.

Result: one row per document with its class (connected documents, named by the
smallest doc_id) and its number of links, that is of other rows at ``threshold`` or
above. Links are counted inside classes, block by block, without listing pairs. In a
class larger than a block sets stand as their differences from one set of the class, a
few n-grams each, since blocks have to meet each other.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; a text of fewer
than ``N`` words, but not none, is one n-gram. Sets are identified by a 64-bit hash.

Edge cases: null texts and texts without words are in no class but their own and have
no links. Repeated rows are each other's links. A row whose doc_id is null is a member
like others and never names a class; the class of such rows alone is null. Ties
(similarity exactly at the threshold) are links. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import bytewords as bw
from gridloom.llm.components import components
from gridloom.llm.session import BROADCAST_BYTES, Scratch, if_small, tune, unused

N = 5
THRESHOLD = 0.8
RECALL = 0.9998
FIRST, DEEPER = 1.25, 3.0  # expected samples at the first and at later levels
LIMIT = 200
LEADERS = 8
WIDE = 1000
MAJOR = 0.9  # a bucket of which one class has this share isn't split
GROWS = 0.7  # nor is one whose large parts have so many of its rows
GROUP_GRAMS = 1 << 20  # n-grams of a large plausible group that is verified at once
SAMPLED, COMMON = 64, 0.5  # sets of a bucket that are looked at, and what share of them has a common n-gram
MANY = 4  # times what a set samples otherwise
PART = 100  # sets of one beyond that which are verified with so many others
BINS = 64
FIRST_ROUND = 2
BLOCK = 2048  # sets of a large class whose differences meet those of another block
BLOCK_GRAMS = 1 << 20


def _chance(threshold: float = THRESHOLD) -> float:
    """Chance that a pair of sets at the threshold meets in a small bucket of one run,
    however often buckets are split. Of the larger set, at least ``threshold`` of what is
    sampled is shared, and each node samples independently of others; so the nodes that
    a pair shares are a branching process, and q is the chance that one dies out."""
    q = 0.0
    for _ in range(200):
        q = math.exp(-DEEPER * threshold * (1 - q))
    return 1 - math.exp(-FIRST * threshold * (1 - q))


def runs_for(recall: float, threshold: float = THRESHOLD) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - _chance(threshold))))


def _families(n: int) -> list[tuple[np.uint64, np.uint64]]:
    draw = np.random.Generator(np.random.PCG64(7_031_977)).integers(1 << 60, 1 << 63, (n, 2), dtype=np.uint64)
    return [(a, b | np.uint64(1)) for a, b in draw]


def shingles(column: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted within a text; first index of each."""
    found = bw.words(column, bw.LOWER_ALNUM, lower=True)
    h, counts = found.hashes(), found.counts
    w = bw.window_hashes(h, n)
    at = np.flatnonzero(bw.within(found.doc, n))
    values, doc = w[at], found.doc[at]
    for row in np.flatnonzero((counts > 0) & (counts < n)).tolist():
        a, b = int(found.first[row]), int(found.first[row + 1])
        values = np.append(values, bw.window_hashes(h[a:b], b - a))
        doc = np.append(doc, row)
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[new], doc[new]
    return values, np.searchsorted(doc, np.arange(len(column) + 1))


def _identity(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(bw.mix(values ^ np.uint64(0x5BF0_3635_16F9_BD71)))])
    return bw.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def sketches(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per set and bin the low byte of the smallest hash in it; empty bins are equal."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    mixed = bw.mix(values ^ np.uint64(0x27D4_EB2F_1656_67C5))
    cell = rows * BINS + (mixed >> np.uint64(58)).astype(np.int64)
    order = np.lexsort((mixed, cell))
    cell, mixed = cell[order], mixed[order]
    head = np.append(True, cell[1:] != cell[:-1]) if len(cell) else np.zeros(0, bool)
    out = np.zeros((len(first) - 1) * BINS, dtype=np.uint8)
    out[cell[head]] = 1 + (mixed[head] % np.uint64(255)).astype(np.uint8)
    return out.reshape(-1, BINS)


def _sample(values: np.ndarray, first: np.ndarray, family: tuple[np.uint64, np.uint64], expected: float) -> tuple[np.ndarray, np.ndarray]:
    """(set, token) of what each set samples by one shared hash, in the order of sets."""
    sizes = np.diff(first)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    bound = (np.minimum(expected / np.maximum(sizes, 1), 0.999999) * 2.0**64).astype(np.uint64)[rows]
    hit = np.flatnonzero((values ^ family[0]) * family[1] < bound)
    return rows[hit], bw.mix(values[hit] ^ family[0])


def _nodes(values: np.ndarray, first: np.ndarray, runs: int) -> pa.ListArray:
    """Per set its first-level nodes, with the run in the low byte."""
    found = [_sample(values, first, family, FIRST) for family in _families(runs)]
    rows = np.concatenate([r for r, _ in found])
    codes = np.concatenate([(t & np.uint64(0xFFFF_FFFF_FFFF_FF00)) | np.uint64(i) for i, (_, t) in enumerate(found)]).view(np.int64)
    order = np.argsort(rows, kind="stable")
    edges = np.searchsorted(rows[order], np.arange(len(first)))
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(codes[order]))


def _below(values: np.ndarray, first: np.ndarray, at: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, node below) of entries (set ``at``, node). Each node samples by a hash of
    its own, so that what a pair shares in one node says nothing about another."""
    entries, made = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    sizes = np.diff(first)
    ends = np.cumsum(sizes[at])
    lo = 0
    while lo < len(at):  # about a million n-grams at a time
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20), "right")))
        n = sizes[at[lo:hi]]
        own = values[bw.ragged(first[at[lo:hi]], n)]
        seed = bw.mix(node[lo:hi].view(np.uint64) ^ np.uint64(0x8CB9_2BA7_2F3D_8DD7))
        token = bw.mix(own ^ np.repeat(seed, n))
        bound = (np.minimum(DEEPER / np.maximum(n, 1), 0.999999) * 2.0**64).astype(np.uint64)
        hit = np.flatnonzero(token < np.repeat(bound, n))
        entry = np.repeat(np.arange(lo, hi), n)[hit]
        entries.append(entry)
        made.append(bw.mix(seed[entry - lo] + bw.mix(token[hit])).view(np.int64))
        lo = hi
    return np.concatenate(entries), np.concatenate(made)


def _scan(docs: DataFrame, n: int, runs: int) -> DataFrame:
    """(did, k, doc_id, sid, n, sketch, nodes) of each row; sid null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.chunks(batches):
            values, first = shingles(batch.column(3), n)
            size = np.diff(first)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(_identity(values, first), mask=size == 0),
                    pa.array(size),
                    pa.array([x.tobytes() for x in sketches(values, first)], pa.binary()),
                    _nodes(values, first, runs),
                ],
                ["did", "k", "doc_id", "sid", "n", "sketch", "nodes"],
            )

    return docs.mapInArrow(run, "did long, k long, doc_id long, sid long, n long, sketch binary, nodes array<long>")


def _row_key(doc_id, text) -> tuple:
    """(did, k) tells rows apart: k is the text's checksum, and has a bit for a null doc_id."""
    did = doc_id.cast("long")
    return F.coalesce(did, F.lit(0)), F.crc32(F.coalesce(text, F.lit("")).cast("binary")) + F.when(did.isNull(), F.lit(1 << 32)).otherwise(F.lit(0))


def _keyed(docs: DataFrame) -> DataFrame:
    did, k = _row_key(F.col("doc_id"), F.col("text"))
    return docs.select(did.alias("did"), k.alias("k"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _by_size(rows: DataFrame, most: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``rows`` (node, sid, root) of the buckets with several classes: those of up to
    ``most`` sets, and larger ones with their size. What is large is told to all tasks,
    so a bucket of any size stays where it was read."""
    size = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    size = scratch.keep(size.select("node", "size"), "sizes")
    big = scratch.keep(size.where(F.col("size") > most), "large_nodes")
    small = rows.join(if_small(big.select("node"))[0], "node", "left_anti").join(size.where(F.col("size") <= most).select("node"), "node", "left_semi")
    return small.select("node", "sid", "root"), rows.join(if_small(big)[0], "node").select("node", "sid", "root", "size")


def _rooted(sets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """With each sid's class so far in ``root``."""
    if roots is None:
        return sets.withColumn("root", F.col("sid"))
    return sets.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def _divided(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Of large buckets (node, sid, root, size) those with several classes, and in
    ``major`` the share of the largest."""
    each = rows.groupBy("node", "root").agg(F.count("*").alias("m"))
    ends = each.groupBy("node").agg(F.max("m").alias("m"), F.sum("m").alias("total")).where("m < total")
    ends = scratch.keep(ends.select("node", (F.col("m") / F.col("total")).alias("major")), "divided")
    return rows.join(if_small(ends)[0], "node")


def _split(large: DataFrame, texts: list[DataFrame], n: int) -> DataFrame:
    """(node, sid, root, above, parent) of the next level of large buckets."""
    entries = large.groupBy("sid").agg(F.first("root").alias("root"), F.collect_list(F.struct("node", "size")).alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values, first in _sets(batch, 0, n):
                lists = part.column(3)
                at = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                node, size = (lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(2))
                entry, made = _below(values, first, at, node)
                sid, root = (part.column(i).to_numpy(zero_copy_only=False)[at[entry]] for i in (1, 2))
                columns = [made, sid, root, node[entry], size[entry]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["node", "sid", "root", "above", "parent"])
        bw.release()

    rows = _all([t.join(entries, "sid").select("z", "sid", "root", "entries") for t in texts])
    return rows.mapInArrow(run, "node long, sid long, root long, above long, parent long")


def _stuck(below: DataFrame) -> DataFrame:
    """(node) of the buckets whose large parts would be about as many rows as they are."""
    size = below.groupBy("node").agg(F.count("*").alias("size"), F.first("above").alias("above"), F.first("parent").alias("parent"))
    grown = size.where(F.col("size") > WIDE).groupBy("above").agg((F.sum("size") / F.first("parent")).alias("grows")).where(F.col("grows") >= GROWS)
    return grown.select(F.col("above").alias("node"))


def _common(large: DataFrame, texts: list[DataFrame], n: int, threshold: float, scratch: Scratch) -> DataFrame:
    """(node, common): n-grams that most sets of a large bucket hold, so that they part
    nothing, by ``SAMPLED`` of its sets. Left out are buckets of whose sets most have so
    little besides that they would sample more than ``MANY`` times as much as elsewhere;
    these hardly differ, and aren't split. Either way only decides what is saved."""
    picked = large.where(F.pmod(F.xxhash64("sid", "node"), F.col("size")) < SAMPLED).select("node", "sid")
    rows = _all([t.join(picked, "sid").select("node", "sid", "z") for t in texts]).dropDuplicates(["node", "sid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values, first in _sets(batch, 2, n):
                node, sid = (np.repeat(part.column(i).to_numpy(zero_copy_only=False), np.diff(first)) for i in range(2))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(sid), pa.array(values.view(np.int64))], ["node", "sid", "gram"])
        bw.release()

    grams = scratch.keep(rows.mapInArrow(run, "node long, sid long, gram long"), "grams")
    counts = grams.groupBy("node", "gram").agg(F.count("*").alias("m"))
    counts = counts.join(picked.groupBy("node").agg(F.count("*").alias("total")), "node").where(F.col("m") >= COMMON * F.col("total"))
    counts = scratch.keep(counts.select("node", "gram", F.lit(1).alias("shared")), "shared")
    own = grams.join(counts, ["node", "gram"], "left").groupBy("node", "sid").agg(F.count("*").alias("n"), F.count("shared").alias("c"))
    free, left = threshold * F.col("n") - F.col("c"), F.col("n") - F.col("c")
    little = (free <= 0) | (left * threshold > MANY * free)
    parted = own.groupBy("node").agg(F.avg(little.cast("int")).alias("little")).where(F.col("little") <= 0.5).select("node")
    return parted.join(counts.groupBy("node").agg(F.array_sort(F.collect_list("gram")).alias("common")), "node", "left")


def _split_apart(large: DataFrame, common: DataFrame, texts: list[DataFrame], n: int, threshold: float) -> DataFrame:
    """(node, sid, root, above, parent, whole) of the next level of large buckets, sampled
    from what a set has besides the common n-grams. Of the larger of two similar sets,
    of size n with c common ones, at least threshold * n - c others are shared; so each set
    samples at DEEPER * threshold by that number, and a pair meets with at least the chance
    it has elsewhere. A set that is left nearly nothing by this samples all its others, and
    goes into a bucket of its kind (``whole``), where such sets meet each other."""
    held = common.agg(F.coalesce(F.sum(F.size("common")), F.lit(0))).first()[0]
    common = F.broadcast(common) if 16 * held <= BROADCAST_BYTES else common.hint("merge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, values, first in _sets(batch, 0, n):
                sid, root, node, size = (part.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
                rows: list[list[np.ndarray]] = []
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    own, key = values[a:b], int(node[i])
                    if key not in known:
                        known.clear()  # rows of a bucket mostly come one after the other
                        known[key] = np.array(part.column(5)[i].as_py() or [], dtype=np.int64).view(np.uint64)
                    left = np.setdiff1d(own, known[key], assume_unique=True)
                    free = threshold * len(own) - (len(own) - len(left))
                    rate = DEEPER * threshold / free if free > 0 else 1.0
                    seed = bw.mix(np.array([key], dtype=np.int64).view(np.uint64) ^ np.uint64(0x6A09_E667_F3BC_C909))
                    token = bw.mix(left ^ seed)
                    if rate < 1:
                        token = token[token < np.uint64(rate * 2.0**64)]
                    made = bw.mix(seed + bw.mix(token))
                    whole = rate >= 1
                    if whole:
                        made = np.append(made, bw.mix(seed ^ np.uint64(0xBB67_AE85_84CA_A73B)))
                    m = len(made)
                    rows.append([made.view(np.int64), *(np.full(m, x[i]) for x in (sid, root, node, size)), np.arange(m) == (m - 1 if whole else m)])
                if rows:
                    columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "sid", "root", "above", "parent", "whole"])
        bw.release()

    rows = _all([t.join(large.select("sid", "root", "node", "size"), "sid").select("z", "sid", "root", "node", "size") for t in texts])
    rows = rows.join(common, "node").select("z", "sid", "root", "node", "size", "common")
    return rows.mapInArrow(run, "node long, sid long, root long, above long, parent long, whole boolean")


def _blocks(dense: DataFrame) -> DataFrame:
    """Large buckets as blocks of about LIMIT sets, each with the bucket's leaders."""
    many = F.ceil(F.col("size") / LIMIT).cast("int")
    lead = F.pmod(F.xxhash64("sid", "node"), F.col("size")) < LEADERS
    own = F.array(F.pmod(F.xxhash64("sid"), many).cast("int"))
    block = F.explode(F.when(lead, F.sequence(F.lit(0), many - 1)).otherwise(own))
    return dense.select("node", "sid", "root", block.alias("block")).select(F.xxhash64("node", "block").alias("node"), "sid", "root")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where groups begin, with the total. A group is the
    rows of one value of the first column; rows come sorted by it."""
    held: list[pa.RecordBatch] = []

    def cut(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        key = table.column(0).to_numpy()
        return table, np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(key, key[-1]))  # the last group may go on
        if last or (held and held[-1].column(0)[-1].as_py() != int(key[0])):
            if last:
                held.append(batch.slice(0, last))
            yield cut(held)
            held = []
            pa.default_memory_pool().release_unused()
        held.append(batch.slice(last))
    if held:
        yield cut(held)
    bw.release()


def _labels(links: np.ndarray) -> np.ndarray:
    """Component of each row of a symmetric boolean matrix."""
    label = np.full(len(links), -1)
    for i in range(len(links)):
        if label[i] < 0:
            todo = [i]
            label[i] = i
            while todo:
                for j in np.flatnonzero(links[todo.pop()] & (label < 0)).tolist():
                    label[j] = i
                    todo.append(j)
    return label


def _may(sketch: np.ndarray, size: np.ndarray, other: np.ndarray, theirs: np.ndarray, threshold: float) -> np.ndarray:
    """Whether pairs of sets may be at the threshold, by sizes and sketches (broadcast
    against each other). A bin differs only if one of the n-grams that not both have is
    in it, and there are few of these at the threshold; for larger sets, six deviations
    of the estimate below the threshold are enough."""
    least, most = np.minimum(size, theirs), np.maximum(size, theirs)
    some = ((sketch | other) != 0).sum(axis=-1)
    differ = (sketch != other).sum(axis=-1)
    ok = (least >= (threshold - 1e-9) * most) & (differ <= (1 - threshold) / (1 + threshold) * (size + theirs) + 1e-6)
    return ok & ((least < 128) | (some - differ >= (threshold - 0.3) * some))


def _alike(sid: np.ndarray, root: np.ndarray, size: np.ndarray, sketch: np.ndarray, threshold: float) -> Iterator[np.ndarray]:
    """Sids of groups inside which all plausible pairs of several classes are."""
    m = len(sid)
    maybe = np.zeros((m, m), dtype=bool)
    for lo in range(0, m, 64):
        part = slice(lo, lo + 64)
        maybe[part] = _may(sketch[part, None], size[part, None], sketch[None], size[None], threshold) & (root[part, None] != root[None])
    label = _labels(maybe)
    for c in np.unique(label[maybe.any(axis=1)]):
        own = np.flatnonzero(label == c)
        if len(own) <= LIMIT or size[own].sum() <= GROUP_GRAMS:
            yield sid[own]
            continue
        parts = [own[i : i + PART] for i in range(0, len(own), PART)]
        for i, a in enumerate(parts):
            for b in parts[i:]:
                pairs = maybe[np.ix_(a, b)]
                if pairs.any():
                    yield sid[np.union1d(a[pairs.any(axis=1)], b[pairs.any(axis=0)])]


def _plausible(members: DataFrame, threshold: float) -> DataFrame:
    """(bucket, sid): the sets of each bucket that may have a link to another class, by
    size and sketch, in groups that may be linked; equal groups of several runs are one.
    ``members``: (node, sid, root, n, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _whole(batches):
            sid, root, size = (table.column(i).to_numpy() for i in (1, 2, 3))
            sketch = np.frombuffer(b"".join(table.column(4).to_pylist()), dtype=np.uint8).reshape(-1, BINS)
            count = np.diff(edges)
            a = edges[:-1][count == 2]  # most buckets: all at once
            a = a[(root[a] != root[a + 1]) & (sid[a] != sid[a + 1])]
            a = a[_may(sketch[a], size[a].astype(float), sketch[a + 1], size[a + 1].astype(float), threshold)]
            key = bw.mix(bw.mix(sid[a].view(np.uint64)) ^ bw.mix(sid[a + 1].view(np.uint64))).view(np.int64)
            keys, found = [np.repeat(key, 2)], [np.stack([sid[a], sid[a + 1]], axis=1).ravel()]
            for i in np.flatnonzero(count > 2).tolist():
                own, at = np.unique(sid[edges[i] : edges[i + 1]], return_index=True)
                at += edges[i]
                for group in _alike(own, root[at], size[at].astype(float), sketch[at], threshold):
                    key = bw.mix(np.bitwise_xor.reduce(bw.mix(group.view(np.uint64)))[None]).view(np.int64)
                    keys.append(np.repeat(key, len(group)))
                    found.append(group)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(found))], ["bucket", "sid"])

    found = members.select("node", "sid", "root", "n", "sketch").repartition("node").sortWithinPartitions("node").mapInArrow(run, "bucket long, sid long")
    return found.distinct()


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def _sets(batch: pa.RecordBatch | pa.Table, column: int, n: int) -> Iterator[tuple[pa.RecordBatch | pa.Table, np.ndarray, np.ndarray]]:
    """Parts of a batch with compressed texts in ``column``, of about ``bw.CHUNK`` bytes
    of text or one row each, and their n-grams as ``shingles`` gives them."""
    loose, texts, size, start = zstandard.ZstdDecompressor(), [], 0, 0
    for i, z in enumerate(batch.column(column)):
        texts.append(loose.decompress(z.as_buffer()).decode())
        size += len(texts[-1])
        if size >= bw.CHUNK or i == batch.num_rows - 1:
            yield batch.slice(start, i + 1 - start), *shingles(pa.array(texts, pa.large_string()), n)
            texts, size, start = [], 0, i + 1


def _grams(table: pa.Table, column: int, n: int) -> list[np.ndarray]:
    """The n-grams of each row's text."""
    out = []
    for _, values, first in _sets(table, column, n):
        out += [values[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return out


def common(left: list[np.ndarray], right: list[np.ndarray], step: int = 2048) -> np.ndarray:
    """How many elements each of the left sets shares with each of the right ones."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    a, b = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (left, right))
    tokens = np.intersect1d(a, b)
    if not len(tokens):
        return out

    def placed(sets: list[np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        column = np.minimum(np.searchsorted(tokens, values), len(tokens) - 1)
        keep = tokens[column] == values
        row, column = row[keep], column[keep]
        order = np.argsort(column, kind="stable")
        return row[order], column[order]

    sides = [placed(left, a), placed(right, b)]
    for lo in range(0, len(tokens), step):
        dense = []
        for (row, column), sets in zip(sides, (left, right), strict=True):
            i, j = np.searchsorted(column, [lo, lo + step])
            one = np.zeros((len(sets), min(step, len(tokens) - lo)), dtype=np.float32)
            one[row[i:j], column[i:j] - lo] = 1
            dense.append(one)
        out += dense[0] @ dense[1].T
    return out


def _over(shared: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs are at the threshold or above, from what they share and their sizes."""
    return shared >= (threshold - 1e-12) * (left[:, None] + right[None, :] - shared.astype(float))


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets are at the threshold or above, as a matrix."""
    size = np.array([len(s) for s in sets], dtype=float)
    if len(sets) == 2:
        shared = np.zeros((2, 2))
        shared[0, 1] = shared[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        # Only what occurs twice can be shared.
        token, n = np.unique(np.concatenate(sets), return_counts=True)
        twice = token[n > 1]
        few = [s[np.isin(s, twice, assume_unique=True)] for s in sets] if len(twice) < 0.5 * len(token) else sets
        shared = common(few, few)
    out = _over(shared, size, size, threshold)
    np.fill_diagonal(out, False)
    return out


def _verify(members: DataFrame, texts: list[DataFrame], threshold: float, n: int) -> DataFrame:
    """Verified links inside each bucket, as edges to its smallest linked sid. ``members``
    are written out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _whole(batches):
            out: list[tuple[int, int]] = []
            sids, sets = table.column(1).to_numpy(), _grams(table, 2, n)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                sid, at = np.unique(sids[a:b], return_index=True)
                if len(sid) < 2:
                    continue
                links = linked([sets[a + i] for i in at], threshold)
                label = _labels(links)
                for c in np.unique(label[links.any(axis=1)]):
                    own = np.sort(sid[label == c]).tolist()
                    out += [(own[0], s) for s in own[1:]]
            if out:
                yield _table(out, ["a", "b"])

    members = if_small(members)[0]
    rows = _all([t.join(members, "sid").select("bucket", "sid", "z") for t in texts]).repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(run, "a long, b long")


def _differences(members: DataFrame, n: int) -> DataFrame:
    """From (part, root, sid, copies, lead, z) each set as its symmetric difference from
    its part's leading row, which is the class's own set in all parts: (root, sid,
    copies, size, lost, base, d); lost: how many of the base's n-grams it lacks. A
    leading row with copies is a member itself."""
    names = ["root", "sid", "copies", "size", "lost", "base", "d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, base = None, None
        for batch in batches:
            for piece, values, first in _sets(batch, 5, n):
                own, root, sid, copies, lead = (piece.column(i).to_numpy(zero_copy_only=False) for i in range(5))
                rows: list[tuple] = []
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    if lead[i] == 0:  # sorted before the part's members
                        part, base = own[i], values[a:b]
                    assert part == own[i]
                    if copies[i]:
                        d = np.setxor1d(base, values[a:b], assume_unique=True)
                        lost = (len(base) + len(d) - (b - a)) // 2
                        rows.append((int(root[i]), int(sid[i]), int(copies[i]), b - a, lost, len(base), d.tobytes()))
                if rows:
                    columns = [*zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())], names)
        bw.release()

    rows = members.select("part", "root", "sid", "copies", "lead", "z").repartition("part").sortWithinPartitions("part", "lead")
    return rows.mapInArrow(run, "root long, sid long, copies long, size long, lost long, base long, d binary")


def _count(differences: DataFrame, threshold: float) -> DataFrame:
    """(sid, links) of all pairs of each class, block against block."""
    sizes = differences.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("d")) / (8 * BLOCK_GRAMS))).cast("int").alias("many"))
    block = F.pmod(F.xxhash64("sid"), F.col("many")).cast("int")
    each = differences.join(sizes, "root").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(low == high, 0).when(F.col("block") == low, 1).otherwise(2).cast("long")
    rows = each.select(F.xxhash64("root", low, high).alias("bucket"), "sid", "copies", "size", "lost", "base", side.alias("side"), "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _whole(batches):
            sids, found = [], []
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                group = table.slice(i, j - i)
                # Whole repeated rows may have given a text more than once.
                _, once = np.unique(np.stack([group.column(c).to_numpy() for c in (6, 1)]), axis=1, return_index=True)
                sid, copies, size, lost, base, side = (group.column(c).to_numpy()[once] for c in range(1, 7))
                sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column(7).take(pa.array(once)).to_pylist()]
                a, b = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
                shared = common([sets[x] for x in a], [sets[x] for x in b])
                shared += (base[0] - lost[a][:, None] - lost[b][None, :]).astype(np.float32)
                links = _over(shared, size[a].astype(float), size[b].astype(float), threshold)
                links &= sid[a][:, None] != sid[b][None, :]
                sids.append(sid[a])
                found.append(links @ copies[b])
                if (side != 0).any():
                    sids.append(sid[b])
                    found.append(links.T @ copies[a])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sids)), pa.array(np.concatenate(found).astype(np.int64))], ["sid", "links"])

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "sid long, links long")


def _texts(keyed: DataFrame, sets: DataFrame, wanted: DataFrame, have: list[DataFrame], scratch: Scratch) -> None:
    """Add (sid, z), the compressed texts of the wanted sids that aren't there, to
    ``have``: tables bucketed by sid, which later joins read in place. Whole repeated
    rows may give a text once for each task."""
    for known in have:
        wanted = wanted.join(known.select("sid"), "sid", "left_anti")
    wanted = scratch.keep(wanted.join(sets.select("sid", "did", "k"), "sid").distinct(), "wanted")
    if have and wanted.limit(1).count() == 0:
        return

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, done = zstandard.ZstdCompressor(level=3), set()
        for batch in bw.chunks(batches):
            rows = [i for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True)) if key not in done and not done.add(key)]
            part = batch.take(pa.array(rows, pa.int64()))
            raw, offsets = bw.text_bytes(part.column(2))
            z = [squeeze.compress(raw[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(z, pa.binary())], ["did", "k", "z"])

    few, small = if_small(wanted)
    rows = keyed.select("did", "k", "text")
    if small:  # only the wanted texts are touched
        rows = rows.join(few.select("did", "k"), ["did", "k"], "left_semi")
    packed = rows.mapInArrow(pack, "did long, k long, z binary").join(few, ["did", "k"])
    have.append(scratch.bucketed(packed.select("sid", "z"), "texts", "sid"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return parts[0] if len(parts) == 1 else parts[0].unionByName(_all(parts[1:]))


class Classes:
    """The classes of a table's texts. ``rows``: (did, k, doc_id, sid) of each row;
    ``sets``: (sid, did, k, doc_id, n, copies), doc_id the smallest; ``roots``: the class
    of the sets that have links, (id, root); ``have``: the texts of these, (sid, z)."""

    def __init__(self, docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL):
        spark = docs.sparkSession
        tune(spark)
        self.scratch, self.n, self.threshold, runs = Scratch(spark), n, threshold, runs_for(recall, threshold)
        self.keyed, keep = _keyed(docs), self.scratch.keep
        scanned = keep(_scan(self.keyed, n, runs), "scanned")
        self.rows = scanned.select("did", "k", "doc_id", "sid")
        first = lambda c: F.first(c).alias(c)
        sets = scanned.where("sid is not null").groupBy("sid").agg(F.count("*").alias("copies"), F.min(F.struct("did", "k")).alias("at"), F.min("doc_id").alias("doc_id"), first("n"), first("sketch"), first("nodes"))
        self.whole = keep(sets.select("sid", "copies", "at.did", "at.k", "doc_id", "n", "sketch", "nodes"), "distinct_sets")
        self.sets = self.whole.drop("sketch", "nodes")
        self.have: list[DataFrame] = []
        self.edges: list[DataFrame] = []
        self.roots: DataFrame | None = None
        self.few = True
        run = F.col("node").bitwiseAND(F.lit(255))
        large = []
        for turn in (run < FIRST_ROUND, run >= FIRST_ROUND):
            level = _rooted(self.whole.select("sid", "nodes"), self._near())
            small, big = _by_size(level.select(F.explode("nodes").alias("node"), "sid", "root").where(turn), LIMIT, self.scratch)
            large.append(keep(big.select("node", "sid", "root", "size"), "large"))
            self._compare([small, _blocks(large[-1])])
        self._split_large(_all(large).drop("root"))
        # What is left: the tables that hold the classes.
        self.scratch.close(scanned, self.whole, self.roots, *self.have)

    def _split_large(self, large: DataFrame) -> None:
        """The third round, on first-level buckets (node, sid, size)."""
        keep = self.scratch.keep
        level = keep(_divided(_rooted(large, self._near()), self.scratch), "level")
        parts, dense = [], []
        while level.limit(1).count():
            parts.append(level.where(F.col("size") <= WIDE))
            dense.append(level.where((F.col("size") > WIDE) & (F.col("major") >= MAJOR)).select("node", "size", "sid"))
            open_ = keep(level.where((F.col("size") > WIDE) & (F.col("major") < MAJOR)), "open")
            if open_.limit(1).count() == 0:
                break
            self._fetch(open_.select("sid").distinct())
            below = keep(_split(open_, self.have, self.n), "nodes")
            stuck = keep(_stuck(below), "stuck")
            below = below.join(if_small(stuck.withColumnRenamed("node", "above"))[0], "above", "left_anti").select("node", "sid", "root")
            if stuck.limit(1).count():
                again = keep(open_.join(if_small(stuck)[0], "node", "left_semi"), "again")
                common = keep(_common(again, self.have, self.n, self.threshold, self.scratch), "common")
                parted = if_small(common.select("node"))[0]
                dense.append(again.join(parted, "node", "left_anti").select("node", "size", "sid"))
                again = keep(again.join(parted, "node", "left_semi"), "again")
                apart = keep(_split_apart(again, common, self.have, self.n, self.threshold), "apart")
                still = keep(_stuck(apart.where("not whole")), "stuck")
                dense.append(again.join(if_small(still)[0], "node", "left_semi").select("node", "size", "sid"))
                apart = apart.join(if_small(still.withColumnRenamed("node", "above"))[0], "above", "left_anti").select("node", "sid", "root", "whole")
                small, big = _by_size(apart.where("whole").drop("whole"), WIDE, self.scratch)
                parts.append(small)
                dense.append(big.select("node", "size", "sid"))
                below = below.unionByName(apart.where("not whole").drop("whole"))
            small, big = _by_size(below, WIDE, self.scratch)
            parts.append(small)
            level = keep(_divided(big, self.scratch), "level")
        if parts:
            self._compare(parts)
            rest = _rest(_all(dense), self._near(), self.scratch)
            if rest is not None:
                self._compare([rest])

    def _fetch(self, wanted: DataFrame) -> None:
        _texts(self.keyed, self.whole, wanted, self.have, self.scratch)

    def _compare(self, parts: list[DataFrame]) -> None:
        """Link the sets of buckets (node, sid, root), and renew the classes."""
        members = _all([p.select("node", "sid", "root") for p in parts]).join(self.whole.select("sid", "n", "sketch"), "sid")
        candidates = self.scratch.keep(_plausible(members, self.threshold), "candidates")
        self._fetch(candidates.select("sid").distinct())
        self.edges.append(self.scratch.keep(_verify(candidates, self.have, self.threshold, self.n), "edges"))
        before, self.roots = self.roots, self.scratch.keep(components(_all(self.edges)), "roots")
        self.few = if_small(self.roots)[1]
        self.scratch.drop(before, candidates)

    def _near(self) -> DataFrame | None:
        """(sid, root) of the classes so far, to be broadcast if they are few."""
        if self.roots is None:
            return None
        hinted = F.broadcast if self.few else lambda t: t.hint("merge")
        return hinted(self.roots.withColumnRenamed("id", "sid"))

    def links(self) -> DataFrame:
        """(sid, links): how many rows of other sets each set is linked with."""
        placed = self.sets.select("sid", "copies").join(self._near(), "sid")
        sizes = self.roots.groupBy("root").agg(F.count("*").alias("members")).where(F.col("members") > BLOCK)
        large = self.scratch.keep(sizes.select("root", F.ceil(F.col("members") / BLOCK).cast("int").alias("parts")), "large_classes")
        few = if_small(large)[0]
        # A class's own set leads each of its parts, and is a member of one.
        own = F.pmod(F.xxhash64("sid"), F.coalesce("parts", F.lit(1))).cast("int")
        members = placed.join(few, "root", "left").select("root", "sid", "copies", own.alias("i"), (F.col("sid") != F.col("root")).cast("int").alias("lead"))
        heads = large.select("root", F.col("root").alias("sid"), F.lit(0).cast("long").alias("copies"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.lit(0).alias("lead"))
        heads = heads.where(F.col("i") != F.pmod(F.xxhash64("sid"), F.col("parts")))
        members = _all([members.unionByName(heads.drop("parts")).join(t, "sid") for t in self.have])
        members = members.select(F.xxhash64("root", "i").alias("part"), "root", "sid", "copies", "lead", "z")
        differences = self.scratch.keep(_differences(members, self.n), "differences")
        return _count(differences, self.threshold).groupBy("sid").agg(F.sum("links").alias("links"))

    def close(self, *but: DataFrame) -> None:
        self.scratch.close(*but)


def _rest(dense: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Of buckets that aren't split and have several classes, the sets outside the
    largest class against all, in blocks: (node, sid, root)."""
    known = scratch.keep(dense.join(roots, "sid", "left").select("node", "size", "sid", F.coalesce("root", "sid").alias("root")), "unsplit")
    by_root = known.groupBy("node", "root").agg(F.count("*").alias("m"))
    top = by_root.groupBy("node").agg(F.max(F.struct("m", "root")).alias("top"), F.sum("m").alias("total")).where("top.m < total")
    top = scratch.keep(top.select("node", F.col("top.root").alias("major"), (F.col("total") - F.col("top.m")).alias("minor")), "majors")
    if top.limit(1).count() == 0:
        return None
    rows = known.join(if_small(top)[0], "node")
    wide, narrow = F.ceil(F.col("size") / WIDE).cast("int"), F.ceil(F.col("minor") / WIDE).cast("int")
    outside = F.col("root") != F.col("major")
    a = rows.where(outside).select("node", "sid", "root", F.pmod(F.xxhash64("sid"), narrow).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), wide - 1)).alias("j"))
    b = rows.select("node", "sid", "root", F.explode(F.sequence(F.lit(0), narrow - 1)).alias("i"), F.pmod(F.xxhash64("sid"), wide).cast("int").alias("j"))
    return a.union(b).select(F.xxhash64("node", "i", "j").alias("node"), "sid", "root").distinct()


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links and class_size of every row of ``docs``."""
    found = Classes(docs, n, threshold, recall)
    of_set = found.sets.join(found._near(), "sid", "left").join(found.links(), "sid", "left")
    of_set = of_set.select("sid", F.coalesce("root", "sid").alias("root"), "copies", F.coalesce("links", F.lit(0)).alias("links"), "doc_id")
    alone = F.col("links") + F.col("copies") == 1  # most sets; they take no part in the shuffle by class
    of_set = found.scratch.keep(of_set.where(~alone), "linked")
    named = of_set.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    out = of_set.join(named, "root").select("sid", "class_id", "class_size", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = found.scratch.keep(out, "classes")
    rows = found.scratch.keep(found.rows.select("doc_id", "sid"), "rows")
    found.scratch.close(out, rows)
    return rows.join(out, "sid", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
    )


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of each class of similar texts, that with the smallest
    doc_id (a null one only if there is no other), all columns as they are. Rows that
    repeat whole are one document; rows without words are in no class and stay."""
    found = Classes(docs, n, threshold, recall)
    keep = found.scratch.keep
    placed = found.rows.where("sid is not null").join(found._near(), "sid", "left").select(F.coalesce("root", "sid").alias("root"), "did", "k")
    placed = placed.select("root", "did", "k", (F.col("k") >= 1 << 32).alias("nameless"))
    at = F.struct("nameless", "did", "k")
    stays = placed.groupBy("root").agg(F.min(at).alias("at"), F.count("*").alias("size")).where("size > 1")
    member = placed.join(keep(stays, "staying").select("root", "at"), "root")
    same = (F.col("did") == F.col("at.did")) & (F.col("k") == F.col("at.k"))
    (did, k), text = unused(docs, "did", "k"), F.col("text")
    keys = [F.col("did").alias(did), F.col("k").alias(k)]
    gone = keep(member.where(~same).select(*keys).distinct(), "gone")
    twice = keep(member.where(same).groupBy(*keys).count().where("count > 1").select(did, k), "twice")
    found.scratch.close(gone, twice)
    own = _row_key(F.col("doc_id"), text)
    out = docs.select("*", own[0].alias(did), own[1].alias(k)).join(if_small(gone)[0], [did, k], "left_anti")
    if twice.limit(1).count():
        once = out.join(if_small(twice)[0], [did, k], "left_semi").dropDuplicates([did, k])
        out = out.join(if_small(twice)[0], [did, k], "left_anti").unionByName(once)
    return out.select(*docs.columns)
