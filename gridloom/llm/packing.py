"""Best-two-fit packing of token sequences.

A text's ids are those of a byte-level BPE vocabulary, then id 0. Longer ones are cut
into pieces of ``capacity`` whose first piece may be shorter. The pieces of each length
are interchangeable for the packing, so the plan is made on the histogram of lengths
(at most ``capacity`` counts, whatever the input's size): a bin is filled greedily with
the longest piece that fits, again and again; then its smallest piece is replaced by
two unpacked ones where they fit the expanded gap more tightly. A bin found this way is
used as often as the counts allow, so each step uses up a length and there are at most
``capacity`` steps or so. Pieces then take the places of their length in rank order.

Edge cases: a null text is empty and has the one id 0. Ties have no effect on the number
of sequences; equal rows each get their own place. An empty table gives an empty
result. Extra columns are ignored. Very long texts become many pieces.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import bytewords as bw
from gridloom.llm import pretoken
from gridloom.llm.session import materialize, tune

CAPACITY = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long, ids binary"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary"


class Encoder:
    """Token ids of texts as the tokenizer library's file ``byte_bpe_50k.json`` gives them."""

    def __init__(self, library: str, ranks: str):
        import base64

        import tiktoken

        self._path = library
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.core = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})
        self.cache = pretoken.Cache(self._merge)

    @functools.cached_property
    def library(self):
        """Loaded for the first odd text only: it holds some 80 MB a process."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._path)

    def _merge(self, items: list[str]) -> list[list[int]]:
        merge = self.core._encode_single_piece
        return [merge(x) for x in items]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(texts)
        strange = [bool(t) and pretoken.is_odd(t) for t in texts]
        for i in (i for i, x in enumerate(strange) if x):
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint16)
        plain = [i for i, t in enumerate(texts) if t and not strange[i]]
        if plain:
            pre = pretoken.split([texts[i] for i in plain], spaced=True)
            at, size = self.cache.look_up(pre)
            ids = self.cache.flat[bw.ragged(at, size.astype(np.int64))]
            total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            for k, i in enumerate(plain):
                out[i] = ids[total[pre.first[k]] : total[pre.first[k + 1]]]
        return out


@functools.cache
def encoder(library: str, ranks: str) -> Encoder:
    return Encoder(library, ranks)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``length`` ids."""
    if length <= capacity:
        return [(0, length)]
    head = length % capacity
    starts = [0] * bool(head) + list(range(head, length, capacity))
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], length], strict=True)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, files: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece. ``part`` and ``place``: the task, and the rank among the
    pieces of this length in it; ``ids``, if they are wanted: little-endian 32-bit."""
    tune(docs.sparkSession)
    library, ranks = files or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, used = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in bw.chunks(batches):
            rows: list[tuple] = []
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder(library, ranks).encode(texts), strict=True):
                wide = np.append(ids, END_ID).astype("<u4")
                for k, (start, length) in enumerate(cut(len(wide), capacity)):
                    own = wide[start : start + length].tobytes()
                    rows.append((doc, k, start, length, zlib.crc32(own), task, int(used[length]), own if with_ids else None))
                    used[length] += 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place", "ids"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, PIECES)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins for ``counts[length]`` pieces: (lengths in a bin, number of such bins)."""
    left = np.array(counts, dtype=np.int64)
    out: list[tuple[list[int], int]] = []
    while len(live := np.flatnonzero(left)):
        taken: list[int] = []
        use = np.zeros_like(left)
        gap = capacity
        top = int(live[-1])
        while gap > 0:
            free = np.flatnonzero(left[: min(gap, top) + 1] - use[: min(gap, top) + 1] > 0)
            if not len(free):
                break
            best = int(free[-1])
            # As many of this length as fit, at once.
            n = int(min(gap // best, left[best] - use[best]))
            taken += [best] * n
            use[best] += n
            gap -= n * best
        if gap and len(taken) > 1:
            small = taken[-1]
            pair = _tightest_pair(left - use, gap + small)
            if pair and sum(pair) > small:
                taken[-1:] = pair
                use[small] -= 1
                for x in pair:
                    use[x] += 1
        used = np.flatnonzero(use)
        times = int((left[used] // use[used]).min())
        left -= use * times
        out.append((taken, times))
    return out


def _tightest_pair(free: np.ndarray, room: int) -> list[int] | None:
    """Two lengths that are free and whose sum is the largest up to ``room``."""
    live = np.flatnonzero(free[: room + 1] > 0)
    if not len(live):
        return None
    # For each first length the largest second one that fits.
    spot = np.searchsorted(live, room - live, "right") - 1
    ok = spot >= 0
    first, second = live[ok], live[spot[ok]]
    ok = (first != second) | (free[first] > 1)
    if (~ok).any():  # only one of that length: take the next smaller one
        lower = spot[np.flatnonzero(spot >= 0)] - 1
        second = np.where(ok, second, np.where(lower >= 0, live[np.maximum(lower, 0)], -1))
    ok = second > 0
    if not ok.any():
        return None
    best = int(np.argmax(np.where(ok, first + second, -1)))
    return sorted((int(first[best]), int(second[best])), reverse=True)


def places(bins: list[tuple[list[int], int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """The plan as arrays: places of one length are consecutive ranks, bin by bin."""
    rows = []
    number = 0
    for lengths, times in bins:
        offset, i = 0, 0
        while i < len(lengths):
            n = 1
            while i + n < len(lengths) and lengths[i + n] == lengths[i]:
                n += 1
            rows.append((lengths[i], n, times, number, offset))
            offset += n * lengths[i]
            i += n
        number += times
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    order = np.argsort(table[:, 0], kind="stable")
    length, per, times, first, offset = table[order].T
    amount = per * times
    before = np.cumsum(amount) - amount
    start = np.searchsorted(length, np.arange(capacity + 2))
    rank = before - before[np.minimum(start[length], max(len(before) - 1, 0))] if len(before) else before
    return {"start": start, "rank": rank, "per": per, "first": first, "offset": offset}


def pack(docs: DataFrame, capacity: int = CAPACITY, files: tuple[str, str] | None = None) -> DataFrame:
    """Places for all pieces of ``docs``. See the module's text."""
    return _placed(docs, capacity, files, False).drop("ids")


def sequences(docs: DataFrame, capacity: int = CAPACITY, files: tuple[str, str] | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids and the doc_ids in their order."""
    placed = _placed(docs, capacity, files, True)
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most ``capacity`` ids in all

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            ids = [np.frombuffer(b"".join(x["ids"] for x in r), dtype="<u4").astype(np.int32) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([[x["doc_id"] for x in r] for r in rows], pa.list_(pa.int64()))], ["sequence_id", "ids", "doc_ids"])

    return placed.groupBy("sequence_id").agg(own.alias("own")).mapInArrow(run, "sequence_id long, ids array<int>, doc_ids array<long>")


def _placed(docs: DataFrame, capacity: int, files: tuple[str, str] | None, with_ids: bool) -> DataFrame:
    cut_up = materialize(pieces(docs, capacity, files, with_ids), "pieces")
    by_part = cut_up.groupBy("part", "length").agg(F.count("*").alias("n"))
    by_part = materialize(by_part, "piece_counts")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    table = places(plan(counts, capacity), capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, place, base = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5, 6))
            rank = place + base
            # The group of places: the last of this length whose first rank isn't beyond ours.
            wide = np.int64(1) << np.int64(44)
            lengths = np.repeat(np.arange(len(table["start"]) - 1), np.diff(table["start"]))
            at = np.searchsorted(lengths * wide + table["rank"], length * wide + rank, "right") - 1
            k = rank - table["rank"][at]
            sequence = table["first"][at] + k // table["per"][at]
            offset = table["offset"][at] + (k % table["per"][at]) * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset), batch.column(7)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"])

    # One row per task and length: it grows with the input, so it is never broadcast.
    joined = cut_up.join(base.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "place", "base", "ids")
    return joined.mapInArrow(run, PACKED)
