import collections
import hashlib
import random
import re

import numpy as np
import pytest

from gridloom.llm import exact_dedup, jaccard_join, substring_dedup
from gridloom.llm.components import components


def exact(rows):
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    out = []
    for i, t, *_ in rows:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


EDGE = [(1, None), (2, ""), (3, "a b"), (4, "a b"), (4, "a b"), (5, "a  b"), (6, "x" * 100_000), (7, "x" * 100_000), (None, "lone"), (8, "A b"), (None, "a b")]


def test_exact_against_brute_force(docs, sample):
    for rows in (EDGE, sample):
        got = sorted((tuple(r)[:5] for r in exact_dedup.exact_dedup(docs(*rows)).collect()), key=str)
        assert got == exact(rows)


def test_exact_empty_smallest_and_keep_one(docs, spark):
    empty = docs((1, "x")).where("doc_id < 0")
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.keep_one(empty).columns == empty.columns
    assert {r.keep_id for r in exact_dedup.exact_dedup(docs((1, "q"), (9, "q")), keep="min").collect()} == {1}
    kept = exact_dedup.keep_one(docs(*EDGE))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((i is None, i or 0) for i in (2, 4, 5, 7, 8, None))


def test_merging_needs_several_rounds_and_verifies(docs):
    rows = [(i, f"t{i % 7}") for i in range(60)]
    found = exact_dedup.digests(docs(*rows).repartition(30))
    assert sorted((r.keep, r.n) for r in exact_dedup.merged_runs(found, fan_in=2).collect()) == sorted((max(x for x in range(60) if x % 7 == k), len(range(k, 60, 7))) for k in range(7))
    make = lambda *r: np.array([(d, s, 1, k or 0, k is not None, 1) for d, s, k in r], dtype=exact_dedup.RECORD)
    with pytest.raises(ValueError):
        exact_dedup.merged([make((b"a", 1, 1)), make((b"a", 2, 1))], True)
    out = exact_dedup.merged([make((b"a", 1, None), (b"c", 1, 4)), make((b"a", 1, -3), (b"b", 1, None)), make((b"c", 1, 5))], True)
    assert [(r["digest"], r["keep"], r["named"], r["n"]) for r in out if r["named"]] == [(b"a", -3, True, 2), (b"c", 5, True, 2)] and len(out) == 3


def test_merging_small_chunks(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "CHUNK", 3)
    rows = [(i, f"t{i % 500}") for i in range(1300)]
    found = exact_dedup.digests(docs(*rows).repartition(9))
    got = {r.digest: (r.keep, r.n) for r in exact_dedup.merged_runs(found, fan_in=3).collect()}
    want = {hashlib.sha256(f"t{k}".encode()).digest(): (max(range(k, 1300, 500)), len(range(k, 1300, 500))) for k in range(500)}
    assert {bytes(k): v for k, v in got.items()} == want


def passages(rows, k):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows]
    seen = collections.Counter(tuple(w[s : s + k]) for _, w in words for s in range(len(w) - k + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            if seen[tuple(w[s : s + k])] > 1:
                gone[s : s + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def random_words(draw, n, size=400):
    return [f"w{draw.randrange(size)}" for _ in range(n)]


def test_substring_against_brute_force(docs, sample):
    draw = random.Random(4)
    shared = random_words(draw, 90)
    rows = [(i, "  ".join(random_words(draw, draw.randrange(80)) + (shared[draw.randrange(40) : 45 + draw.randrange(45)] if i % 2 else []) + random_words(draw, draw.randrange(80))) + "\n") for i in range(40)]
    rows += [(100, "same " * 200), (101, " ".join(shared)), (101, " ".join(shared)), (102, None), (103, ""), (104, "few words"), (None, " ".join(shared[:60])), (105, " ".join(random_words(draw, 30) * 4))]
    rows += [(-1, " ".join(shared[5:80])), (0, "zero " + " ".join(shared[:50])), (106, " ".join([*random_words(draw, 30_000, 10**6), *shared, *random_words(draw, 10, 10**6)]))]
    for r in (rows, sample):
        got = substring_dedup.substring_dedup(docs(*r))
        assert sorted((tuple(x) for x in got.collect()), key=str) == passages(r, 35)


@pytest.mark.parametrize("width", [8, 60, 120])
def test_substring_of_other_widths(docs, width):
    draw = random.Random(width)
    shared = random_words(draw, 300)
    rows = [(i, " ".join(random_words(draw, draw.randrange(40)) + shared[(a := draw.randrange(150)) : a + width + draw.randrange(100)])) for i in range(12)]
    got = substring_dedup.substring_dedup(docs(*rows), width=width)
    assert sorted((tuple(x) for x in got.collect()), key=str) == passages(rows, width)
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(docs(*rows), width=7)


def test_substring_empty_table_and_compaction(docs, spark, tmp_path):
    assert substring_dedup.substring_dedup(docs((1, "x")).where("doc_id < 0")).count() == 0
    index = substring_dedup.FingerprintIndex(spark, compact_at=1)
    batch = lambda *x: spark.createDataFrame([(v,) for v in x], "fp long")
    assert index.add(batch(1, 2, 2)).collect()[0].fp == 2
    assert sorted(r.fp for r in index.add(batch(1, 3)).collect()) == [1]
    assert len(index.runs) == 1 and {r.fp: r.n for r in index.runs[0].collect()} == {1: 2, 2: 2, 3: 1}
    assert index.add(batch(3)).collect()[0].fp == 3
    index.save(str(tmp_path / "index"))
    index.close()
    again = substring_dedup.FingerprintIndex.open(spark, str(tmp_path / "index"))
    assert sorted(r.fp for r in again.add(batch(2, 4)).collect()) == [2]
    again.close()


def test_substring_kept_texts(docs):
    draw = random.Random(1)
    shared = random_words(draw, 50)
    rows = [(1, "  a " + " ".join(shared) + " b"), (2, " ".join(shared)), (3, "two  words"), (4, None)]
    table = docs(*rows)
    kept = substring_dedup.kept_texts(table)
    assert kept.columns == table.columns and {r.doc_id: r.text for r in kept.collect()} == {1: "a b", 2: "", 3: "two  words", 4: None}


def similar(rows, n=5, least=0.8):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()})
    links, root = collections.Counter(), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if union and len(sets[a] & sets[b]) >= least * union - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    group = collections.defaultdict(list)
    for a in range(len(rows)):
        group[find(a)].append(rows[a][0])
    name = lambda a: min((x for x in group[find(a)] if x is not None), default=None)
    return sorted(((rows[a][0], name(a), links[a]) for a in range(len(rows))), key=str)


def near(draw, words, edits):
    out = list(words)
    for _ in range(edits):
        out[draw.randrange(len(out))] = f"e{draw.randrange(10**6)}"
    return out


def test_join_against_brute_force(docs, sample):
    draw = random.Random(9)
    base = [random_words(draw, 120, 5000) for _ in range(4)]
    rows = [(i, " ".join(near(draw, base[i % 4], draw.randrange(5)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " , "), (53, "two words"), (54, "Two, words!"), (55, "a b c d e"), (55, "a b c d e"), (56, " ".join(random_words(draw, 4000, 10**6))), (None, "a b c d e f")]
    rows += [(-1, "same words again in two rows"), (0, "same words again in two rows"), (None, "same words again in two rows"), (None, "no name here either but twice"), (None, "no name here either but twice")]
    ten = " ".join(f"t{i}" for i in range(14))  # ten n-grams; of nine and ten, eight are shared below: a tie
    rows += [(60, ten), (61, " ".join(f"t{i}" for i in range(12)))]
    for r in (rows, sample):
        got = sorted((tuple(x)[:3] for x in jaccard_join.jaccard_join(docs(*r)).collect()), key=str)
        assert got == similar(r)


def test_join_of_a_large_class_in_small_blocks(docs, monkeypatch):
    """A class much larger than a bucket, loosely linked, and sets that share a passage."""
    for name, value in {"LIMIT": 12, "WIDE": 16, "GROUP_GRAMS": 2000, "PART": 6, "BLOCK": 20}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    draw = random.Random(2)
    base, passage = random_words(draw, 150, 5000), random_words(draw, 40, 5000)
    rows = [(i, " ".join(near(draw, base, draw.randrange(4)))) for i in range(90)]
    rows += [(200 + i, " ".join(random_words(draw, 60, 5000) + passage)) for i in range(60)]
    got = sorted((tuple(x)[:3] for x in jaccard_join.jaccard_join(docs(*rows)).collect()), key=str)
    assert got == similar(rows)


def test_join_keep_one_and_empty(docs):
    empty = docs((1, "x")).where("doc_id < 0")
    assert jaccard_join.jaccard_join(empty).count() == 0 and jaccard_join.keep_one(empty).count() == 0
    text = " ".join(f"u{i}" for i in range(60))
    kept = jaccard_join.keep_one(docs((5, text), (3, text + " more"), (9, text), (9, text), (7, None), (8, "alone in here with words"), (7, None)))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 7, 8] and kept.columns[:2] == ["doc_id", "text"]
    clash = docs((None, text), (-1, text), (-1, text), (0, text + " x")).selectExpr("*", "1 did", "2 as __did", "3 as GONE")
    for one in (jaccard_join.keep_one(clash), exact_dedup.keep_one(clash, "min")):
        assert sorted(r.doc_id for r in one.collect()) in ([-1], [-1, 0]) and one.columns == clash.columns


def test_recall_of_runs():
    assert 1 - (1 - jaccard_join._chance()) ** jaccard_join.runs_for(0.9998) >= 0.9998


def test_runs_of_split_buckets_are_independent():
    """Pairs at the threshold whose large buckets are split to full depth: how many meet
    in a bucket of any run, by their own buckets and by the formula."""
    runs, n, m = 3, 400, 400
    draw = np.random.default_rng(6)
    values, first = [], [0]
    for _ in range(n):
        pool = draw.integers(0, 1 << 63, 10 * m // 9 + 1, dtype=np.uint64)
        for own in (pool[:m], pool[m // 9 :][:m]):  # 8 of 10 distinct n-grams are shared
            values.append(np.sort(own))
            first.append(first[-1] + len(own))
    values, first = np.concatenate(values), np.array(first)
    nodes = jaccard_join._nodes(values, first, runs).to_pylist()
    level = [(i, x) for i, own in enumerate(nodes) for x in own]
    for depth in range(6):
        buckets = collections.defaultdict(set)
        for i, node in level:
            buckets[node].add(i)
        level = sorted((i, node) for i, node in level if len(buckets[node]) > 1)
        if depth < 5:
            at, node = (np.array(x, dtype=np.int64) for x in zip(*level, strict=True))
            entry, made = jaccard_join._below(values, first, at, node)
            level = list(zip(at[entry].tolist(), made.tolist(), strict=True))
    met = [own for own in buckets.values() if len(own) > 1]
    pairs = {min(s) // 2 for s in met if len({x // 2 for x in s}) == 1 and len(s) == 2}
    missed = 1 - len(pairs) / n
    want = (1 - jaccard_join._chance(8 / 9)) ** runs
    assert missed < want + 4 * (want * (1 - want) / n) ** 0.5


def test_few_labels_are_few_files(spark):
    """However many shuffle partitions there are, since each costs a task and a file a round."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(before, ("64", "false"), strict=True):
            spark.conf.set(k, v)
        found = components(spark.range(600).selectExpr("2 * id a", "2 * id + 1 b"))
        assert len(found.inputFiles()) <= max(32, spark.sparkContext.defaultParallelism)
        assert all(r.root == r.id // 2 * 2 for r in found.collect()) and found.count() == 1200
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_components_of_a_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.id: r.root for r in components(path).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[101] == 100


def boilerplate(n, copies=8, shared=60, own=60, edits=3):
    """Texts of one long common passage and words of their own, some of them with near
    copies; the passage itself has a word changed here and there."""
    draw = random.Random(n)
    passage = [f"p{i}" for i in range(shared)]
    rows = []
    for i in range(n):
        words = [f"w{draw.randrange(40 * n)}" for _ in range(own)]
        head = [*passage]
        if i % 3 == 0:
            head[draw.randrange(shared)] = f"x{i}"
        rows.append((i, " ".join(head + words)))
        if i % (n // copies) == 0:
            for k in range(2):
                rows.append((10 * n + 2 * i + k, " ".join(head + near(draw, words, edits))))
    return rows


def test_texts_with_one_passage_are_parted_by_their_own_words(docs, monkeypatch):
    """No rows of all against all: what is compared grows as the table does."""
    for name, value in {"LIMIT": 12, "WIDE": 20}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    made, rest = [], jaccard_join._rest
    compare = jaccard_join.Classes._compare

    def counted(self, parts):
        made[-1].append(sum(p.count() for p in parts))
        return compare(self, parts)

    def kept(dense, roots, scratch):
        found = rest(dense, roots, scratch)
        made[-1].append(0 if found is None else found.count())
        return found

    monkeypatch.setattr(jaccard_join.Classes, "_compare", counted)
    monkeypatch.setattr(jaccard_join, "_rest", kept)
    for n in (64, 192):
        rows = boilerplate(n)
        made.append([])
        got = {(r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(docs(*rows)).collect()}
        assert got == set(similar(rows))
    assert sum(made[1]) <= 4 * sum(made[0])


def test_texts_that_are_mostly_one_passage(docs, monkeypatch):
    """What is left of a text by the passage is little or nothing: such texts meet."""
    for name, value in {"LIMIT": 12, "WIDE": 20}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    draw, rows = random.Random(5), []
    passage = [f"p{i}" for i in range(100)]
    for i in range(108):
        rows.append((i, " ".join(passage + [f"w{draw.randrange(9000)}" for _ in range((0, 4, 12, 18, 25, 40)[i % 6])])))
    got = {(r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(docs(*rows)).collect()}
    assert got == set(similar(rows))
