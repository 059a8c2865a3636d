"""Ranked lexical search over dual-sorted wavelet trees.

An index is a table of shards. A shard holds up to ``SHARD_DOCS`` documents, numbered by
doc_id, and one posting list a term; lists stand one after the other, each in order of
falling impact. The sequence of the postings' document numbers is kept as a wavelet
tree: level by level its bits part the documents into halves, and within a half the
order of the lists stays. So one structure is sorted twice: an interval of it is a list
by impact, a node of it is a range of documents, and the first posting of a list's
interval in a node has the list's largest impact there.

A search walks the trees best first: a node's bound is the sum of its first postings'
weights over the query's terms, its children are the same intervals mapped by rank, and
a leaf's bound is its document's score. It ends when no node can beat the k-th result,
ties by doc_id included, since nodes know their smallest doc_id. All queries of a block
walk together, so the arithmetic is done on arrays. What a task has found bounds its
next shards; the tasks' results are ranked in Spark.

Impact of a posting: (10^9 tf) div (1000 tf + 8 m), with m = 25 + (75 n N) div L; weight
of a term: floor(1000 ln((2N + 2) / (2 df + 1))). N: documents with a term, L: all
terms, n and tf: the document's, df: documents with the term.

Terms: ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. A shard's
dictionary holds the terms themselves, so a search compares words, not hashes.

Edge cases: null and empty texts, and texts without terms, are in no result and in no
statistic. Very long texts make a shard of their own. Rows repeated with a doc_id are
documents of their own; a null doc_id comes last among equal scores. Items are told
apart by row, so a repeated item_id has its results twice; a null one keeps null. Terms
that no document holds add nothing. Extra columns are ignored; an empty table on either
side gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import bytewords as bw
from gridloom.llm.session import fresh_path, tune

#: A shard ends after so many documents or bytes of text.
SHARD_DOCS, SHARD_BYTES = 4096, 12 << 20
#: Items searched together, and the bytes of their texts.
BLOCK_ITEMS, BLOCK_BYTES = 2000, 4 << 20
#: Nodes that a query opens in one step.
AT_ONCE = 6
K = 10
INDEX = "n_docs long, n_postings long, total_docs long, total_terms long, terms binary, starts binary, body binary"


# ---- the shard ---------------------------------------------------------------------


def _packed(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x if isinstance(x, bytes) else x.tobytes())


def _unpacked(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=kind)


def _next_places(bits: np.ndarray, ones: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Where each posting of a level stands on the next one. ``node``: edges of the
    level's nodes; ``ones``: ones before each place."""
    size = np.diff(node)
    begin = np.repeat(node[:-1], size)
    before = ones[:-1] - np.repeat(ones[node[:-1]], size)  # ones before it in its node
    zeros = np.repeat(size - (ones[node[1:]] - ones[node[:-1]]), size)
    place = np.arange(len(bits))
    return np.where(bits, begin + zeros + before, place - before)


def _ones(bits: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])


def depth(n_docs: int) -> int:
    return max(1, (n_docs - 1).bit_length())


def _edges(sizes: np.ndarray, level: int, levels: int) -> np.ndarray:
    """Edges of a level's nodes, from the number of postings of each document."""
    total = np.zeros((1 << levels) + 1, dtype=np.int64)
    np.cumsum(sizes, out=total[1 : len(sizes) + 1])
    total[len(sizes) + 1 :] = total[len(sizes)]
    return total[:: 1 << (levels - level)]


def shard(ids: np.ndarray, named: np.ndarray, n_terms: np.ndarray, hashes: np.ndarray, doc: np.ndarray, names: dict[int, bytes], totals: tuple[int, int]) -> dict | None:
    """The shard of some documents. ``doc``: the document of each term; ``names``: the
    term of each hash; ``totals``: N and L of the whole table."""
    order = np.lexsort((ids, ~named))
    ids, named, n_terms = ids[order], named[order], n_terms[order]
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.arange(len(order))
    if not len(hashes):
        return None
    terms, term = np.unique(hashes, return_inverse=True)
    pair, tf = np.unique(term * len(ids) + number[doc], return_counts=True)
    term, doc = pair // len(ids), pair % len(ids)
    m = 25 + (75 * n_terms * totals[0]) // totals[1]
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
    order = np.argsort(term << 20 | ((1 << 20) - 1 - impact), kind="stable")  # an impact is at most 10**6
    seq, impact = doc[order], impact[order].astype(np.uint32)
    starts = np.searchsorted(term, np.arange(len(terms) + 1)).astype(np.uint32)
    sizes, levels = np.bincount(seq, minlength=len(ids)), depth(len(ids))
    tree = []
    for level in range(levels):
        bits = (seq >> (levels - 1 - level) & 1).astype(bool)
        tree.append(np.packbits(bits))
        after = np.empty_like(seq)
        after[_next_places(bits, _ones(bits), _edges(sizes, level, levels))] = seq
        seq = after
    body = {"ids": ids.tobytes(), "named": named.tobytes(), "sizes": sizes.astype(np.uint32).tobytes(), "impact": _packed(impact), "tree": [_packed(x) for x in tree]}
    return {"n_docs": len(ids), "n_postings": len(impact), "total_docs": totals[0], "total_terms": totals[1], "terms": _packed(b"\n".join(names[h] for h in terms.tolist())), "starts": _packed(starts), "body": pickle.dumps(body)}


def _term_list(row: dict) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(row["terms"]).split(b"\n")


class Shard:
    """A shard made ready for searches: ones before each place and impacts, by level."""

    def __init__(self, row: dict):
        body, n = pickle.loads(row["body"]), row["n_postings"]
        self.ids, self.named = np.frombuffer(body["ids"], np.int64), np.frombuffer(body["named"], bool)
        self.starts = _unpacked(row["starts"], "<u4").astype(np.int64)
        self.place = {t: i for i, t in enumerate(_term_list(row))}
        sizes, self.levels = np.frombuffer(body["sizes"], np.uint32), depth(row["n_docs"])
        self.wide = n + 1
        self.ones = np.empty((self.levels, n + 1), dtype=np.int32)
        self.impact = np.empty((self.levels + 1, n), dtype=np.uint32)
        self.impact[0] = _unpacked(body["impact"], "<u4")
        for level, packed in enumerate(body["tree"]):
            bits = np.unpackbits(_unpacked(packed, "u1"), count=n).astype(bool)
            ones = _ones(bits)
            self.ones[level] = ones
            self.impact[level + 1][_next_places(bits, ones, _edges(sizes, level, self.levels))] = self.impact[level]
        self.ones_flat, self.impact_flat = self.ones.reshape(-1), self.impact.reshape(-1)

    def key(self, number: int) -> tuple[bool, int]:
        """A document's place among equal scores."""
        return (not self.named[number], int(self.ids[number]))

    def search(self, queries: list[dict[bytes, int]], k: int, best: list[list[tuple]]) -> None:
        """Put each query's documents into ``best``, its k best (-score, key) so far.
        A query gives the weight of each of its terms."""
        heaps = []
        for query in queries:
            held = [(self.place[t], w) for t, w in query.items() if w and t in self.place]
            heaps.append([])
            if held:
                lists, weight = (np.array(x, dtype=np.int64) for x in zip(*held, strict=True))
                sp, ep = self.starts[lists], self.starts[lists + 1]
                heaps[-1].append((-int((weight * self.impact[0][sp]).sum()), 0, 0, 0, self.wide - 1, sp, ep, weight))
        active = [i for i, h in enumerate(heaps) if h]
        while active:
            opened, owner = [], []
            for i in active:
                heap, top = heaps[i], best[i]
                for _ in range(AT_ONCE):
                    if not heap:
                        break
                    if len(top) == k and (heap[0][0], self.key(heap[0][1])) >= top[-1]:
                        heap.clear()  # nothing that is left can beat the k-th
                        break
                    node = heapq.heappop(heap)
                    if node[2] == self.levels:  # a document, and its score
                        top.append((node[0], self.key(node[1])))
                        top.sort()
                        del top[k:]
                    else:
                        opened.append(node)
                        owner.append(i)
            if opened:
                self._open(opened, owner, heaps, best, k)
            active = [i for i in active if heaps[i]]

    def _open(self, nodes: list[tuple], owner: list[int], heaps: list[list], best: list[list], k: int) -> None:
        """Push the children of ``nodes`` that hold postings and may matter."""
        level, begin, end = (np.array([x[j] for x in nodes], dtype=np.int64) for j in (2, 3, 4))
        sp, ep, weight = (np.concatenate([x[j] for x in nodes]) for j in (5, 6, 7))
        size = np.array([len(x[5]) for x in nodes])
        edge = np.concatenate([[0], np.cumsum(size)])
        row = level * self.wide
        before = self.ones_flat[row + begin].astype(np.int64)
        zeros = end - begin - (self.ones_flat[row + end] - before)
        row_, before_ = np.repeat(row, size), np.repeat(before, size)
        one_sp, one_ep = self.ones_flat[row_ + sp] - before_, self.ones_flat[row_ + ep] - before_
        right = np.repeat(begin + zeros, size)
        below = np.repeat((level + 1) * (self.wide - 1), size)
        for side, (a, b) in enumerate(((sp - one_sp, ep - one_ep), (right + one_sp, right + one_ep))):
            some = b > a
            bound = np.where(some, weight * self.impact_flat[below + np.where(some, a, 0)], 0)
            bound = np.add.reduceat(bound, edge[:-1])
            a, b, w = a[some], b[some], weight[some]
            cut = np.concatenate([[0], np.cumsum(np.add.reduceat(some, edge[:-1], dtype=np.int64))]).tolist()
            for j, value in enumerate(bound.tolist()):
                if not value:
                    continue
                node, i = nodes[j], owner[j]
                first = node[1] + (side << (self.levels - node[2] - 1))
                if len(best[i]) == k and (-value, self.key(first)) >= best[i][-1]:
                    continue
                middle = node[3] + int(zeros[j])
                lo, hi = (middle, node[4]) if side else (node[3], middle)
                x, y = cut[j], cut[j + 1]
                heapq.heappush(heaps[i], (-value, first, node[2] + 1, lo, hi, a[x:y], b[x:y], w[x:y]))


# ---- the index ---------------------------------------------------------------------


def totals(docs: DataFrame) -> tuple[int, int]:
    """N and L: documents with at least one term, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = terms = 0
        for batch in bw.chunks(batches):
            each = bw.words(batch.column(0), bw.LOWER_ALNUM, lower=True).counts
            n, terms = n + int((each > 0).sum()), terms + int(each.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([terms])], ["n", "terms"])

    row = docs.select("text").mapInArrow(run, "n long, terms long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
    return row["n"], row["terms"]


def build(docs: DataFrame, path: str | None = None, shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Index every row of ``docs`` into ``path`` (chosen if none is given) on shared
    storage and return the index table, which ``open_index`` reads again.

    Documents stay in the tasks that read them: nothing is shuffled."""
    spark = docs.sparkSession
    tune(spark)
    n, terms = totals(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, named, n_terms, hashes, doc, names, size = [], [], [], [], [], {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            made = shard(*(np.concatenate(x) for x in (ids, named, n_terms, hashes, doc)), names, (n, terms))
            if made:
                yield pa.RecordBatch.from_pylist([made], schema=pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.binary()) for x in INDEX.split(", ")]))

        held = 0
        for batch in bw.chunks(batches):
            if held and (held + batch.num_rows > shard_docs or size + batch.column(1).nbytes > shard_bytes):
                yield from out()
                ids, named, n_terms, hashes, doc, names, size, held = [], [], [], [], [], {}, 0, 0
            found = bw.words(batch.column(1), bw.LOWER_ALNUM, lower=True)
            own = found.hashes()
            new, at = np.unique(own, return_index=True)
            for h, i in zip(new.tolist(), at.tolist(), strict=True):
                if h not in names:
                    names[h] = found.raw[found.start[i] : found.end[i]].tobytes()
            ids.append(batch.column(0).fill_null(0).to_numpy())
            named.append(batch.column(0).is_valid().to_numpy(zero_copy_only=False))
            n_terms.append(found.counts.astype(np.int64))
            hashes.append(own)
            doc.append(found.doc + held)
            held, size = held + batch.num_rows, size + batch.column(1).nbytes
        if held:
            yield from out()
        bw.release()

    path = path or fresh_path(spark, "search_index")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX).write.parquet(path)
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def terms_of(text: str | None) -> Counter:
    found = bw.words(pa.array([text], pa.large_string()), bw.LOWER_ALNUM, lower=True)
    return Counter(found.text(0, len(found.start)))


def document_frequencies(index: DataFrame, terms: list[bytes]) -> list[int]:
    """Documents that hold each term, from the lengths of the shards' lists."""
    number = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(number), dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                long = np.diff(_unpacked(row["starts"], "<u4").astype(np.int64)).tolist()
                for t, n in zip(_term_list(row), long, strict=True):
                    if t in number:
                        total[number[t]] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    out = [0] * len(terms)
    for r in index.select("terms", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def _blocks(items: DataFrame, most: int, size: int) -> Iterator[list[tuple[int, str]]]:
    """The items, a bounded number at a time."""
    block, held = [], 0
    for row, text in items.toLocalIterator():
        if block and (len(block) == most or held + len(text or "") > size):
            yield block
            block, held = [], 0
        block.append((row, text))
        held += len(text or "")
    if block:
        yield block


def _search_block(index: DataFrame, block: list[tuple[int, str]], totals: tuple[int, int], k: int) -> DataFrame:
    rows, asked = [r for r, _ in block], [terms_of(t) for _, t in block]
    terms = sorted({t for q in asked for t in q})
    weight = {t: math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * df + 1))) for t, df in zip(terms, document_frequencies(index, terms), strict=True)}
    sent = index.sparkSession.sparkContext.broadcast([{t: c * weight[t] for t, c in q.items()} for q in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        best: list[list[tuple]] = [[] for _ in queries]
        for batch in batches:
            for i in range(batch.num_rows):
                Shard(batch.slice(i, 1).to_pylist()[0]).search(queries, k, best)
        out = [(rows[i], None if null else doc, -score) for i, top in enumerate(best) for score, (null, doc) in top]
        if out:
            item, doc, score = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])
        bw.release()

    return index.select("n_docs", "n_postings", "terms", "starts", "body").mapInArrow(run, "item long, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, k: int = K, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of every row of ``items``
    (item_id, text), by the index table of ``build``.

    Items go through in blocks of bounded size, each over all shards."""
    spark = index.sparkSession
    tune(spark)
    path = fresh_path(spark, "search_items")
    items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text").write.parquet(path)
    items = spark.read.parquet(path)
    first = index.select("total_docs", "total_terms").first()
    found = spark.createDataFrame([], "item long, doc_id long, score long")
    if first:
        for block in _blocks(items.select("item", "text"), block_items, block_bytes):
            found = found.unionByName(_search_block(index, block, tuple(first), k))
    # The rows of a task are cut to an item's k best before they are moved.
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
