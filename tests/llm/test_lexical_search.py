import math
import re
from collections import Counter

import numpy as np

from gridloom.llm import lexical_search as ls

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(TERM, text or "")]


def brute(rows, items, k=10):
    own = [(i, Counter(terms(t))) for i, t in rows]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n_docs, total = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for i, c, n in own:
            m = 25 + (75 * n * n_docs) // total
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k])]
    return out


def rows_of(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_whole_table_equals_brute_force(spark, docs, sample):
    rows = [(i, t) for i, t, _ in sample]
    items = [(n, " ".join((t or "").split()[5:40])) for n, (i, t, _) in enumerate(sample[::9])] + [(900, "Of the and the; nosuchterm!"), (901, None), (902, "")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(rows, items), key=str)
    for bounds in ({}, {"shard_docs": 7}, {"shard_bytes": 3000}):
        index = ls.build(docs(*rows), **bounds)
        assert rows_of(ls.search(index, asked)) == want
    assert rows_of(ls.search(index, asked, k=3, block_items=4)) == sorted(brute(rows, items, 3), key=str)


def test_ties_copies_and_nameless_rows(spark, docs):
    """A third of the rows are copies; equal scores go by doc_id, nameless ones last."""
    rng = np.random.default_rng(8)
    rows = [(i, "the hot passage of words") for i in range(100, 140)] + [(i, " ".join(rng.choice(list("abcdefgh"), 6))) for i in range(60)]
    rows += [(None, "the hot passage of words"), (None, None), (3, ""), (4, "..."), (5, "dup dup"), (5, "dup dup"), (None, "dup dup")]
    items = [("x", "hot passage"), ("x", "HOT passage"), (None, "a b c b a"), ("y", "dup")]
    asked = spark.createDataFrame([(*r, 1, "z") for r in items], "item_id string, text string, score int, rank string")
    index = ls.build(docs(*rows), shard_docs=16)
    assert rows_of(ls.search(index, asked)) == sorted(brute(rows, items), key=str)


def test_saved_index_is_opened_again(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    ls.build(docs((1, "one two"), (2, "two three three"), (3, "four")), path)
    index = ls.open_index(spark, path)
    asked = spark.createDataFrame([(7, "three two")], "item_id long, text string")
    assert rows_of(ls.search(index, asked)) == brute([(1, "one two"), (2, "two three three"), (3, "four")], [(7, "three two")])
    assert index.agg({"n_docs": "sum"}).first()[0] == 3


def test_empty_tables(spark, docs):
    asked = spark.createDataFrame([(7, "three two")], "item_id long, text string")
    assert ls.search(ls.build(docs((1, "a")).where("false")), asked).collect() == []
    assert ls.search(ls.build(docs((1, None), (2, "..."))), asked).collect() == []
    assert ls.search(ls.build(docs((1, "two"))), asked.where("false")).collect() == []


def test_a_term_in_every_document_still_counts_by_its_weight(spark, docs):
    rows = [(i, "all " + "all " * (i % 3)) for i in range(20)]
    asked = [(1, "all")]
    got = rows_of(ls.search(ls.build(docs(*rows)), spark.createDataFrame(asked, "item_id long, text string")))
    assert got == sorted(brute(rows, asked), key=str)


def test_trees_keep_the_order_of_lists():
    """Each level holds the root's postings, parted by document and in order of impact."""
    rng = np.random.default_rng(2)
    ids, n = np.arange(13), np.full(13, 9)
    doc = rng.integers(0, 13, 120)
    hashes = rng.integers(0, 6, 120).astype(np.uint64)
    made = ls.shard(ids, np.ones(13, bool), n, hashes, doc, {i: b"t%d" % i for i in range(6)}, (13, 120))
    shard = ls.Shard(made)
    for level in range(shard.levels + 1):
        assert sorted(shard.impact[level]) == sorted(shard.impact[0])
    lists = [(int(shard.starts[i]), int(shard.starts[i + 1])) for i in range(6)]
    assert all((np.diff(shard.impact[0][a:b].astype(int)) <= 0).all() for a, b in lists)
    best = [[]]
    shard.search([{b"t0": 1}], 13, best)
    assert [-s for s, _ in best[0]] == shard.impact[0][lists[0][0] : lists[0][1]].tolist()
