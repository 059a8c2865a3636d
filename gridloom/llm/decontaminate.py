"""Benchmark decontamination against a broadcast set of normalised n-grams.

The items' windows of ``width`` words are put into a hash set that goes to every task
with the closure. Its size is checked first: it has at most one entry per benchmark
word, and beyond ``max_entries`` the items are handled in several passes of that many
windows, a longer item in overlapping parts, so the broadcast is bounded however large
the benchmark is. Several passes run over a copy of the documents with a row id, which
is written once, so that a row's hits of all passes meet. Each task hashes
the windows of its texts at every width in use, looks them up, and compares the words
of each hit with the item's words before it counts.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. An item of fewer
words than ``width``, but not none, is one window of its own width.

Edge cases: null texts and null items have no words. The windows of an item whose item_id
is null count as hits; only its id is left out of the items. Items with equal texts or shared windows are all reported. Repeated item rows count once.
Repeated documents each get a row. Empty tables: no documents, no rows; no items, no
hits. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import bytewords as bw
from gridloom.llm.session import materialize, tune, unused

WIDTH = 10
#: Windows in one broadcast: about 400 MB of words at most, far less in practice.
MAX_ENTRIES = 1_000_000
FOUND = "doc_id long, n_words long, spans array<struct<first:int,last:int>>, items array<string>"


class Grams:
    """Windows of benchmark items, by width: sorted hashes, the words, the items."""

    def __init__(self, items: list[tuple[str, str | None]], width: int = WIDTH):
        gathered: dict[int, dict[bytes, set[str]]] = {}
        hashed: dict[int, dict[bytes, int]] = {}
        for item, text in items:
            if not text:
                continue
            found = bw.words(pa.array([text]), bw.LOWER_ALNUM, lower=True)
            n = len(found.start)
            k = min(width, n)
            if not k:
                continue
            words = found.text(0, n)
            for i, h in enumerate(bw.window_hashes(found.hashes(), k).tolist()):
                key = b" ".join(words[i : i + k])
                gathered.setdefault(k, {}).setdefault(key, set()).update([] if item is None else [str(item)])
                hashed.setdefault(k, {})[key] = h
        self.tables = []
        for k, grams in sorted(gathered.items()):
            keys = sorted(grams, key=hashed[k].get)
            self.tables.append((k, np.array([hashed[k][x] for x in keys], dtype=np.uint64), keys, [sorted(grams[x]) for x in keys]))

    def __len__(self) -> int:
        return sum(len(t[2]) for t in self.tables)

    def hits(self, found: bw.Words) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, width, items) of each verified window, over all rows of a batch."""
        hashes = found.hashes()
        for k, table, keys, items in self.tables:
            windows = bw.window_hashes(hashes, k)
            spot = np.minimum(np.searchsorted(table, windows), len(table) - 1)
            for i in np.flatnonzero((table[spot] == windows) & bw.within(found.doc, k)).tolist():
                words = b" ".join(found.text(i, i + k))
                at = int(spot[i])
                while at < len(table) and table[at] == windows[i]:
                    if keys[at] == words:
                        yield i, k, items[at]
                        break
                    at += 1


def _parts(text: str, width: int, most: int) -> Iterator[tuple[str, int]]:
    """An item's text and its number of words, in parts of up to ``most`` windows."""
    found = bw.words(pa.array([text]), bw.LOWER_ALNUM, lower=True)
    n = len(found.start)
    if n <= max(most, width):
        yield text, n
        return
    for i in range(0, n - width + 1, most):
        j = min(n, i + most + width - 1)
        yield b" ".join(found.text(i, j)).decode(), j - i


def _passes(benchmark: DataFrame, width: int, max_entries: int) -> Iterator[Grams]:
    """Grams of the items, at most about ``max_entries`` windows at a time."""
    held: list[tuple[str | None, str]] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null").toLocalIterator():
        for text, n in _parts(row[1], width, max_entries):
            if held and size + n > max_entries:
                yield Grams(held, width)
                held, size = [], 0
            held.append((row[0], text))
            size += n
    yield Grams(held, width)


def _one_pass(benchmark: DataFrame, max_entries: int) -> bool:
    """Whether the items surely fit one pass: a word and what ends it have two bytes."""
    bytes_ = benchmark.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    return bytes_ / 2 + 1 <= max_entries


def spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """doc_id, n_words, the hit word spans (first, last; those of one pass merged) and the
    items hit, of each row."""
    tune(docs.sparkSession)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    if _one_pass(benchmark, max_entries):
        return rows.mapInArrow(_scan(next(_passes(benchmark, width, max_entries))), FOUND)
    return _several(materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows"), benchmark, width, max_entries).drop("row")


def _several(rows: DataFrame, benchmark: DataFrame, width: int, max_entries: int) -> DataFrame:
    """The same and ``row``, over several passes; ``rows``: doc_id, text, row."""
    out = None
    for grams in _passes(benchmark, width, max_entries):
        part = materialize(rows.select("doc_id", "text", "row").mapInArrow(_scan(grams, 2), f"{FOUND}, row long"), "hits")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def _scan(grams: Grams, *keep: int):
    """``keep``: columns that are passed on after the result's own."""
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.chunks(batches):
            found = bw.words(batch.column(1), bw.LOWER_ALNUM, lower=True)
            where: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            for i, k, ids in sorted(grams.hits(found), key=lambda x: x[0]):
                row = int(found.doc[i])
                first = i - int(found.first[row])
                known = where.setdefault(row, [])
                if known and first <= known[-1][1] + 1:
                    known[-1] = (known[-1][0], max(known[-1][1], first + k - 1))
                else:
                    known.append((first, first + k - 1))
                items.setdefault(row, set()).update(ids)
            rows = range(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(found.counts.astype(np.int64)),
                    pa.array([[{"first": a, "last": b} for a, b in where.get(i, ())] for i in rows], span),
                    pa.array([sorted(items.get(i, ())) for i in rows], pa.list_(pa.string())),
                    *(batch.column(c) for c in keep),
                ],
                ["doc_id", "n_words", "spans", "items", *(batch.schema.names[c] for c in keep)],
            )

    return run


def _covered(spans) -> F.Column:
    """Words in the union of spans, which may overlap after several passes."""
    ordered = F.array_sort(spans)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))

    def add(acc, x):
        first = F.greatest(x["first"].cast("long"), acc["end"] + 1)
        last = F.greatest(x["last"].cast("long"), acc["end"])
        return F.struct((acc["n"] + F.greatest(last - first + 1, F.lit(0).cast("long"))).alias("n"), last.alias("end"))

    return F.aggregate(ordered, start, add, lambda acc: acc["n"])


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document."""
    found = spans(docs, benchmark, width, max_entries)
    hit = _covered(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "document", width: int = WIDTH, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """``docs`` without contaminated documents (mode "document"), or with the hit words
    cut out of their texts (mode "span"; the bytes between words stay). All columns are
    kept; the texts never leave the task that read them."""
    tune(docs.sparkSession)
    if mode not in ("document", "span"):
        raise ValueError("mode is document or span")
    name, once = docs.columns.index("text"), _one_pass(benchmark, max_entries)
    if once or mode == "document":
        out = docs
        for grams in _passes(benchmark, width, max_entries):
            out = out.mapInArrow(_remover(grams, name, mode), docs.schema)
            if not once:  # so that one pass's windows are held at a time
                out = materialize(out, "cleaned")
        return out
    # Windows are judged on the input, so what all passes hit is cut at once.
    (row,) = unused(docs, "row")
    whole = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = _several(whole.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(row).alias("row")), benchmark, width, max_entries)
    hits = found.where(F.size("spans") > 0).select(F.col("row").alias(row), "spans")
    (gone,) = unused(whole, "spans")
    return whole.join(hits.withColumnRenamed("spans", gone), row, "left").select(*docs.columns, gone).mapInArrow(_cutter(name, len(docs.columns)), docs.schema)


def _cut_out(batch: pa.RecordBatch, column: int, gone: np.ndarray, rows: Iterator[int] | set[int], offsets: np.ndarray, raw: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """The batch's columns of ``schema``, without the marked bytes of some rows' texts."""
    texts = batch.column(column).to_pylist()
    for row in rows:
        a, b = int(offsets[row]), int(offsets[row + 1])
        texts[row] = raw[a:b][~gone[a:b]].tobytes().decode()
    columns = batch.columns[: len(schema)]
    columns[column] = pa.array(texts, schema.field(column).type)
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _cutter(column: int, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.chunks(batches):
            schema = pa.schema(list(batch.schema)[:at])
            found = bw.words(batch.column(column), bw.LOWER_ALNUM, lower=True)
            raw, offsets = bw.text_bytes(batch.column(column))
            gone, rows = np.zeros(len(raw), dtype=bool), set()
            for row, spans in enumerate(batch.column(at).to_pylist()):
                for s in spans or ():
                    first = int(found.first[row])
                    gone[found.start[first + s["first"]] : found.end[first + s["last"]]] = True
                    rows.add(row)
            yield _cut_out(batch, column, gone, rows, offsets, raw, schema)

    return run


def _remover(grams: Grams, column: int, mode: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.chunks(batches):
            found = bw.words(batch.column(column), bw.LOWER_ALNUM, lower=True)
            hits = [(i, k) for i, k, _ in grams.hits(found)]
            rows = {int(found.doc[i]) for i, _ in hits}
            if not rows:
                yield batch
            elif mode == "document":
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[list(rows)] = False
                yield batch.filter(pa.array(keep))
            else:
                raw, offsets = bw.text_bytes(batch.column(column))
                gone = np.zeros(len(raw), dtype=bool)
                for i, k in hits:
                    gone[found.start[i] : found.end[i + k - 1]] = True
                yield _cut_out(batch, column, gone, rows, offsets, raw, batch.schema)

    return run


def items_digest(items: list[str]) -> str:
    """items_sha256 of a list of item ids, for checks."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
