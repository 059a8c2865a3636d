"""Spelling variants: words one edit apart, grouped under their most frequent form.

Words are counted over all texts and cut, in code-point order, into shards of bounded
size; each shard is a compact trie. Groups of tries of at most ``GROUP_BYTES`` are
broadcast one after the other, and every word meets every shard: the word's
distance-one Levenshtein automaton is intersected with the trie depth first. Before its
edit the automaton follows one path; at each node of it the edit may be a letter of the
trie too many, another one, or one of the word left out, and behind the edit only the
rest of the word leads on. Each neighbour is reached by one edit only, since of a run of
equal letters only the last is left out and none is put in before it. What a word emits
is reduced where it is found: the number of neighbours and the best one.

A word's form is its most frequent neighbour (ties: the smallest in code-point order) if
that occurs ``ratio`` times as often; roots follow forms by pointer doubling, which ends
because counts grow along it.

Words are runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased. ``every`` plants the
typing errors that the contract asks for: where it divides the crc32 of doc_id and run,
one code point of the run is left out; 0 leaves the words as they are.

Edge cases: null and empty texts have no words; a null doc_id counts as empty text in the
crc32. Long texts are read in pieces. Repeated rows count each time. A shard holds at most
``SHARD_WORDS`` words and ``SHARD_CHARS`` characters, or one word that is longer. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import bytewords as bw
from gridloom.llm.session import Scratch, tune

MIN_CHARS, MIN_COUNT, RATIO, EVERY = 6, 5, 5, 199
#: Bounds of a shard, and the pickled tries that are broadcast together.
SHARD_WORDS, SHARD_CHARS, GROUP_BYTES = 20_000, 1_000_000, 8 << 20
#: Words a counting task holds before it hands them on, and characters read at once.
HELD, PIECE = 200_000, 1 << 20
RUN = re.compile("[a-zÀ-ÿ]+")


def _runs(text: str) -> Counter:
    """Number of each run in a text; A-Z become lower-case, other letters stay."""
    text = text.encode().lower().decode()
    if len(text) <= PIECE:
        return Counter(RUN.findall(text))
    return Counter(m[0] for m in RUN.finditer(text))


def misspelt(doc_id: int | None, run: str, every: int) -> str:
    """The run as the table has it: one code point is missing where the crc32 says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, every: int = EVERY) -> DataFrame:
    """(word, n) of the words of at least ``min_chars`` code points in all texts."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in bw.chunks(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in _runs(text or "").items():
                    # a run of min_chars may lose one, so shorter ones can be left out
                    if len(word) < min_chars:
                        continue
                    if every and not zlib.crc32(word.encode(), before) % every:
                        word = misspelt(doc_id, word, every)
                        if len(word) < min_chars:
                            continue
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---- the compact trie: nodes in flat lists -----------------------------------------


class Trie:
    """Words in a trie whose nodes carry all letters up to the next fork. ``label[v]``
    leads into node v, ``n[v]`` is the count of the word that ends there, or 0."""

    def __init__(self, words: list[str], counts: list[int]):
        """From words in code-point order, each once."""
        self.label, self.kids, self.n = [""], [{}], [0]
        path, depth, last = [0], [0], ""  # nodes on the way to the last word, and where they end
        for word, count in zip(words, counts, strict=True):
            common = 0
            for x, y in zip(last, word, strict=False):
                if x != y:
                    break
                common += 1
            cut = None
            while depth[-1] > common:
                cut = path.pop()
                depth.pop()
            if depth[-1] < common:  # the words part inside a label: a node is put in there
                v, start = cut, depth[-1]
                inner = self._add(self.label[v][: common - start], 0)
                self.kids[path[-1]][self.label[inner][0]] = inner
                self.label[v] = self.label[v][common - start :]
                self.kids[inner][self.label[v][0]] = v
                path.append(inner)
                depth.append(common)
            v = self._add(word[common:], count)
            self.kids[path[-1]][word[common]] = v
            path.append(v)
            depth.append(len(word))
            last = word

    def _add(self, label: str, n: int) -> int:
        self.label.append(label)
        self.kids.append({})
        self.n.append(n)
        return len(self.label) - 1

    def _ends(self, v: int, k: int, word: str, i: int) -> int:
        """Count of the word that behind the first k letters of node v's label goes on
        exactly as ``word`` from i does; 0 if there is none."""
        label = self.label[v]
        while True:
            if not word.startswith(label[k:] if k else label, i):
                return 0
            i += len(label) - k
            if i == len(word):
                return self.n[v]
            v = self.kids[v].get(word[i], 0)
            if not v:
                return 0
            label, k = self.label[v], 0

    def near(self, word: str) -> list[tuple[str, int]]:
        """The words of the trie one edit away from ``word``, each once, with counts."""
        out, size, ends = [], len(word), self._ends
        v, i, label = 0, 0, self.label
        while True:
            # All of node v's letters are word[:i].
            here = word[i] if i < size else ""
            if i == size - 1 and self.n[v]:
                out.append((word[:i], self.n[v]))
            for c, x in self.kids[v].items():
                if c == here:
                    continue
                if i < size:
                    if n := ends(x, 1, word, i + 1):
                        out.append((word[:i] + c + word[i + 1 :], n))
                    if i + 1 < size and c == word[i + 1] and (n := ends(x, 0, word, i + 1)):
                        out.append((word[:i] + word[i + 1 :], n))
                if n := ends(x, 1, word, i):
                    out.append((word[:i] + c + word[i:], n))
            v = self.kids[v].get(here, 0)
            if not v:
                return out
            into = label[v]
            if word.startswith(into, i):
                i += len(into)
                continue
            k = 1
            while k < len(into) and i + k < size and into[k] == word[i + k]:
                k += 1
            # Inside the label the trie has one letter, which isn't the word's next.
            at, c = i + k, into[k]
            if at < size:
                if n := ends(v, k + 1, word, at + 1):
                    out.append((word[:at] + c + word[at + 1 :], n))
                if at + 1 < size and c == word[at + 1] and (n := ends(v, k, word, at + 1)):
                    out.append((word[:at] + word[at + 1 :], n))
            if n := ends(v, k + 1, word, at):
                out.append((word[:at] + c + word[at:], n))
            return out


def _shards(words: DataFrame, shard_words: int, shard_chars: int) -> DataFrame:
    """(trie, bytes): the vocabulary in code-point order, a pickled trie a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, chars = [], [], 0

        def out() -> pa.RecordBatch:
            made = pickle.dumps(Trie(held, counts), protocol=5)
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary()), pa.array([len(made)], pa.int64())], ["trie", "bytes"])

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (len(held) == shard_words or chars + len(word) > shard_chars):
                    yield out()
                    held, counts, chars = [], [], 0
                held.append(word)
                counts.append(n)
                chars += len(word)
        if held:
            yield out()
        bw.release()

    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return words.repartitionByRange(n, "word").sortWithinPartitions("word").mapInArrow(run, "trie binary, bytes long")


_tries: dict[str, list[Trie]] = {}  # of the broadcast at hand, for all tasks of a worker


def _near(words: DataFrame, shards: list[bytes]) -> DataFrame:
    """(word, n_near, best): neighbours in these shards, of the words that have some."""
    sent, name = words.sparkSession.sparkContext.broadcast(shards), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _tries:
            _tries.clear()
            _tries[name] = [pickle.loads(x) for x in sent.value]
        tries = _tries[name]
        for batch in batches:
            found = []
            for word in batch.column(0).to_pylist():
                near = [x for trie in tries for x in trie.near(word)]
                if near:
                    most = max(n for _, n in near)
                    found.append((word, len(near), most, min(w for w, n in near if n == most)))
            if found:
                word, n_near, most, best = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n_near, pa.int64()), pa.array(most, pa.int64()), pa.array(best)], ["word", "n_near", "most", "best"])

    return words.select("word").mapInArrow(run, "word string, n_near long, most long, best string")


def _groups(sizes: list[tuple[int, int]], most: int) -> Iterator[list[int]]:
    """Shard numbers dealt into groups of at most ``most`` bytes, or one shard."""
    group, held = [], 0
    for shard, size in sizes:
        if group and held + size > most:
            yield group
            group, held = [], 0
        group.append(shard)
        held += size
    if group:
        yield group


def neighbours(words: DataFrame, scratch: Scratch, shard_words: int = SHARD_WORDS, shard_chars: int = SHARD_CHARS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(word, n_near, most, best) of the words of ``words`` (word, n), a table that has
    been written, that have a neighbour: number, and count and name of the best one."""
    shards = scratch.keep(_shards(words, shard_words, shard_chars).select(F.monotonically_increasing_id().alias("shard"), "trie", "bytes"), "shards")
    # Hashed, since words of one beginning lie in one shard and cost more there.
    dealt = words.select("word").repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    made = []
    # Only numbers and sizes of shards come to the driver at once, and one group's tries.
    for group in _groups([(r["shard"], r["bytes"]) for r in shards.select("shard", "bytes").orderBy("shard").collect()], group_bytes):
        tries = [r["trie"] for r in shards.where(F.col("shard").isin(group)).select("trie").collect()]
        made.append(scratch.keep(_near(dealt, tries), "near"))
    scratch.drop(shards)
    if not made:
        return words.sparkSession.createDataFrame([], "word string, n_near long, most long, best string")
    every = made[0]
    for part in made[1:]:
        every = every.unionByName(part)
    if len(made) == 1:
        return every
    best = F.min(F.struct((-F.col("most")).alias("less"), F.col("best").alias("best"))).alias("b")
    every = scratch.keep(every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("most"), F.col("b.best").alias("best")), "near")
    scratch.drop(*made)
    return every


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): where following forms ends. Each round
    doubles the steps; a round's table replaces the one before."""
    scratch = Scratch(forms.sparkSession)
    table = scratch.keep(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while table.where("moved").limit(1).count():
        further = table.select(F.col("word").alias("root"), F.col("root").alias("above"))
        after = table.select("word", "root").join(further, "root", "left")
        after = scratch.keep(after.select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        scratch.drop(table)
        table = after
    return table.select("word", "root")


def variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, every: int = EVERY, **bounds: int) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word that occurs often enough."""
    scratch = Scratch(docs.sparkSession)
    words = scratch.keep(word_counts(docs, min_chars, every).where(F.col("n") >= min_count), "words")
    near = neighbours(words, scratch, **bounds)
    has = F.coalesce(F.col("most") >= F.lit(ratio) * F.col("n"), F.lit(False))
    found = words.join(near, "word", "left").select(
        "word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("most")).alias("form_n")
    )
    found = scratch.keep(found, "variants")
    scratch.close(found)
    top = roots(found.where("form is not null"))
    return found.join(top, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
