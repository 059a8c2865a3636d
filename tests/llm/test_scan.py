import collections
import gzip
import json
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import decontaminate, language_id, lm_scoring, packing, pretoken, queries, token_counts, toxicity, warc
from gridloom.llm.attention import CLASSES, CONTEXT, Attention, Words, blocks, classes_of
from gridloom.llm.session import Scratch

ODD = ["", "Hi there!!  it's  12345 ", "É́ x\x1cy", "\tfoo\n\nbar  baz   q 3.14 ''s <|endoftext|> hi", "ΑΣ ΣΑΣ bc", "Don't STOP!!'sun 　x", "日本語 １２ ² ½", "  ", "\n \n", "a \n b  c", "x" * 3000, "'", "é'", "'S we'LL", "İstanbul ǅ"]


def test_token_counts_equal_the_library(docs, sample):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.vocabulary())
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (101, None)] + [(200 + i, t) for i, t, _ in sample]
    want = sorted((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows)
    assert sorted(tuple(r) for r in token_counts.token_counts(docs(*rows)).collect()) == want
    assert token_counts.token_counts(docs(*rows).where("doc_id < 0")).count() == 0


def test_counts_of_every_code_point():
    """Classes and lower case of all code points that may be letters, against the library."""
    counter = token_counts.counter(token_counts.vocabulary())
    texts = [f"a{chr(c)}b 1{chr(c)}2" for c in [*range(0xD800), *range(0xE000, 0x30000)]]
    for i in range(0, len(texts), 20_000):
        part = texts[i : i + 20_000]
        differs = np.flatnonzero(counter.count(part) != np.array([len(x) for x in counter._encode(part)]))
        assert not len(differs), [hex(ord(part[k][1])) for k in differs[:5]]


def test_a_full_cache_changes_nothing():
    counter = token_counts.Counter(token_counts.vocabulary())
    texts = [f"zqx{i} wvu{i} hello" for i in range(50)]
    want = counter.count(texts)
    counter.cache.limit = 3
    assert (counter.count(texts[:20]) == want[:20]).all() and (counter.count(texts) == want).all()


def test_ids_equal_the_library(sample):
    from tokenizers import Tokenizer

    library, ranks = packing.vocabulary()
    own, plain = packing.encoder(library, ranks), Tokenizer.from_file(library)
    texts = ODD + [t for _, t, _ in sample]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids, t[:40]


def test_packing_round_trip(docs, sample):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary()[0])
    rows = [(i, t) for i, t, _ in sample] + [(10_000, None), (10_001, ""), (10_002, "ab " * 5000), (10_003, "same"), (10_003, "same")]
    got = packing.pack(docs(*rows)).collect()
    ids = {i: np.append(plain.encode(t or "", add_special_tokens=False).ids, 0).astype("<u4") for i, t in rows}
    by_doc = collections.defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
    for i, x in ids.items():
        pieces = sorted(set(by_doc[i]))
        assert sum(n for *_, n in pieces) == len(x) and [p for p, *_ in pieces] == list(range(len(pieces)))
        assert all(n == 2048 for *_, n in pieces[1:]) and (len(x) > 2048 or len(pieces) == 1)
    full = collections.defaultdict(list)
    for r in got:
        full[r.sequence_id].append((r.offset, r.length))
    for s in full.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    whole = {r.sequence_id: r for r in packing.sequences(docs(*rows)).collect()}
    assert len(whole) == len(full) and sum(len(r.ids) for r in whole.values()) == sum(len(x) for i, x in ids.items()) + len(ids[10_003])
    assert collections.Counter(d for r in whole.values() for d in r.doc_ids) == collections.Counter(r.doc_id for r in got)
    short = next(r for r in whole.values() if len(r.doc_ids) > 1 and len(ids[r.doc_ids[0]]) <= 2048)
    assert short.ids[: len(ids[short.doc_ids[0]])] == ids[short.doc_ids[0]].tolist()
    lengths = sorted((r.length for r in got), reverse=True)
    assert len(full) <= len(first_fit(lengths)) and packing.pack(docs((1, "x")).where("doc_id < 0")).count() == 0


def first_fit(lengths, room=2048):
    bins = []
    for n in lengths:
        for i, b in enumerate(bins):
            if b + n <= room:
                bins[i] += n
                break
        else:
            bins.append(n)
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_whole_and_tight(seed):
    draw = np.random.default_rng(seed)
    counts = np.zeros(101, dtype=np.int64)
    lengths = draw.integers(1, 101, 400) if seed else np.full(50, 34)
    np.add.at(counts, lengths, 1)
    bins = packing.plan(counts, 100)
    used = np.zeros_like(counts)
    for own, times in bins:
        assert sum(own) <= 100
        np.add.at(used, own, times)
    assert (used == counts).all()
    assert sum(t for _, t in bins) <= max(-(-int(lengths.sum()) // 100) * 1.03, len(first_fit(sorted(lengths.tolist(), reverse=True), 100)))


def test_two_replace_the_smallest():
    counts = np.zeros(11, dtype=np.int64)
    counts[[6, 3, 2]] = 1, 1, 2
    assert packing.plan(counts, 10)[0] == ([6, 2, 2], 1)


BENCH = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "short item here"), (3, None), (4, "!!!"), (5, "one two three four five six seven eight nine ten"), (None, "lost words in a null item")]


def contaminated(rows, items, k=10):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    grams = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(k, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[a : a + n])] |= set() if i is None else {str(i)}
    out = []
    for i, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in grams:
                    hit |= set(range(a, a + n))
                    found |= grams[tuple(w[a : a + n])]
        out.append((i, len(w), len(hit), len(found), decontaminate.items_digest(list(found)), bool(hit)))
    return sorted(out, key=str)


def test_decontamination_against_brute_force(docs, spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    rows = [(1, "x ONE two, three four-five six seven eight nine ten eleven y"), (2, None), (3, ""), (4, "a short   Item HERE. short item"), (5, "one two three"), (6, "one two three four five six seven eight nine ten " * 3), (6, "clean"), (None, "short item here"), (7, "some lost words in a null item"), (8, "word " * 60_000 + "short item here")]
    want = contaminated(rows, BENCH)
    for most in (decontaminate.MAX_ENTRIES, 12, 4):
        got = decontaminate.report(docs(*rows), bench, max_entries=most)
        assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str) == want
    for most in (decontaminate.MAX_ENTRIES, 4):
        assert sorted(str(r.doc_id) for r in decontaminate.remove(docs(*rows), bench, max_entries=most).collect()) == ["2", "3", "5", "6"]
        out = decontaminate.remove(docs(*rows), bench, mode="span", max_entries=most)
        cut = {r.doc_id: r.text for r in out.collect()}
        assert cut[1] == "x  y" and cut[5] == "one two three" and cut[4] == "a . short item" and cut[7] == "some " and out.columns == docs(*rows).columns
    assert decontaminate.report(docs(*rows), bench.where("item_id < 0")).where("contaminated").count() == 0
    assert decontaminate.report(docs(*rows).where("doc_id < 0"), bench).count() == 0


FILL = ["der", "the", "and", "house", "tree", "walk", "green", "river", "stone", "light"]


def speech(draw, n, *extra):
    words = [draw.choice(FILL) + str(draw.randrange(60)) for _ in range(n)] + list(extra)
    draw.shuffle(words)
    return " ".join(words)


def test_toxicity_held_out(docs, spark):
    draw = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, speech(draw, draw.randrange(20, 80), *(["vile", "awful"] if bad else []))))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "..."), (1003, speech(draw, 3000, "vile", "awful")), (1003, "x"), (None, "vile awful")]
    marks = spark.createDataFrame([*labels, (5, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs(*rows), marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95
    kept = toxicity.reject(docs(*rows), marks)
    assert kept.columns == docs(*rows).columns and kept.count() == sum(not r.predicted for r in got)
    # Held-out labels have no influence.
    other = marks.withColumn("toxic", (marks.toxic + 1) % 2).where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").unionByName(marks.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    assert sorted((str(r.doc_id), r.score) for r in toxicity.toxicity(docs(*rows), other).collect()) == sorted((str(r.doc_id), r.score) for r in got)
    assert {r.score for r in toxicity.toxicity(docs(*rows), marks.where("doc_id < 0")).collect()} == {0.0}
    assert toxicity.toxicity(docs(*rows).where("doc_id < 0"), marks).count() == 0


def test_language_held_out(docs, sample):
    rows = list(sample) + [(9000, None, "en"), (9001, "123 !?", "en"), (9002, "", None), (None, "the and of", "en")]
    got = {r.doc_id: r for r in language_id.identify(docs(*rows)).collect()}
    held = [(got[i].lang_pred, x) for i, _, x in sample if got[i].held_out]
    assert len(held) > 20 and np.mean([a == b for a, b in held]) > 0.95
    assert [(got[i].lang_pred, got[i].score) for i in (9000, 9001, 9002)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 and r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    nothing = language_id.identify(docs((1, "text", None))).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]
    assert language_id.identify(docs(*rows).where("doc_id < 0")).count() == 0


def test_language_pieces_change_nothing(monkeypatch):
    rows = [("the house and the tree " * 9, "en"), ("der baum und das haus " * 9, "de")] * 6
    df, n = language_id.document_frequencies([t for t, _ in rows])
    model = language_id.learn(rows, np.log((n + 1) / (df + 1)) + 1)
    texts = ["the tree " * 300, "", "und der baum", "7"]
    want = model(texts)
    monkeypatch.setattr(language_id, "PIECE", 50)
    got = model(texts)
    assert got[0] == want[0] == ["en", "und", "de", "und"] and np.allclose(got[1], want[1])


def test_language_sample_does_not_follow_the_order_of_the_table(spark):
    draw = random.Random(4)
    rows = [(i, f"{chr(97 + i // 40) * 3} " * draw.randrange(20, 60), f"l{i // 40}") for i in range(400)]
    rows += [(1000 + i, "zzz " * 20_000, "long") for i in range(20)]
    made = [language_id.train(spark.createDataFrame(r, "doc_id long, text string, lang string").coalesce(1), max_bytes=20_000) for r in (rows, rows[::-1])]
    assert made[0].langs == made[1].langs == sorted({x for *_, x in rows})
    assert np.array_equal(made[0].weights, made[1].weights)
    assert made[0](["ccc ccc", "jjj jjj", "zzz zzz"])[0] == ["l2", "l9", "long"]


def test_language_bytes_are_shared():
    assert language_id.shares({"a": 10, "b": 500, "c": 900}, 310) == {"a": 10, "b": 150, "c": 150}
    assert language_id.chosen([(2, 7, "a", 5), (1, 8, "a", 5), (3, 9, "b", 800)], 110) == {(8, "a"): 5, (7, "a"): 5, (9, "b"): 12}


def words_of(draw, n, size=40, longest=3):
    """Distinct words of random ids, the last the end."""
    sizes = np.append(draw.integers(1, longest + 1, n - 1), 1)
    flat = np.append(draw.integers(0, size - 1, int(sizes[:-1].sum())), size - 1)
    first = np.concatenate([[0], np.cumsum(sizes)])
    return Words(flat, first, flat[first[:-1]])


def test_attention_gradients():
    draw = np.random.default_rng(0)
    of = ((np.arange(40) % 3) * CLASSES + np.arange(40) % 5).astype(np.int32)
    model = Attention.fresh(np.ones(40), of)
    model.p = {k: v.astype(np.float64) + (draw.normal(0, 0.1, v.shape) if k in ("groups", "classes", "away") else 0) for k, v in model.p.items()}
    words = words_of(draw, 30)
    numbers = draw.integers(0, 30, 100)
    whole = blocks(numbers, np.array([0, 40, 47, 100]), 29)
    target = of[words.anchor][whole.target]
    run = lambda: model.step(words.summed(model.p["embed"])[whole.read], whole.begins, target, whole.real)
    _, grads, dx = run()
    by_id = np.zeros_like(model.p["embed"])
    np.add.at(by_id, words.flat, np.repeat(np.stack([dx.reshape(-1, dx.shape[-1])[whole.read.ravel() == w].sum(axis=0) for w in range(30)]), np.diff(words.first), axis=0))
    grads["embed"] = by_id
    for name, grad in grads.items():
        at = np.unravel_index(int(np.abs(grad).argmax()), grad.shape)
        old, eps = model.p[name][at], 1e-5
        model.p[name][at] = old + eps
        up = run()[0]
        model.p[name][at] = old - eps
        down = run()[0]
        model.p[name][at] = old
        assert np.isclose((up - down) / (2 * eps), grad[at], rtol=0.02, atol=1e-6), name


def test_each_word_is_scored_once_and_causally():
    draw = np.random.default_rng(3)
    words = words_of(draw, 50)
    mass = np.bincount(words.anchor, minlength=40).astype(float)
    model = Attention.fresh(mass, classes_of(mass, draw.random((40, 8))))
    texts = [draw.integers(0, 50, n) for n in (1, 5, 16, 17, 31, 32, 33, 100, 700)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = blocks(np.concatenate(texts), first, 49)
    model.follow(iter([(words, whole)] * 20), 0.02, 8)
    together = model.score(words, whole)
    alone = lambda t: model.score(words, blocks(t, np.array([0, len(t)]), 49))
    assert len(together) == first[-1]
    for t, a, b in zip(texts, first[:-1], first[1:], strict=True):
        assert np.allclose(together[a:b], alone(t), atol=1e-4)
    changed = texts[-1].copy()
    changed[60:] = (changed[60:] + 1) % 50
    a, b = alone(texts[-1]), alone(changed)
    assert np.allclose(a[:60], b[:60], atol=1e-4) and not np.allclose(a[61:], b[61:])
    # What is read reaches into the next block but one at most: 16 to 31 words back.
    far = texts[-1].copy()
    far[300] = (far[300] + 1) % 50
    moved = np.flatnonzero(np.abs(alone(far) - a) > 1e-6)
    assert 301 in moved and moved.max() < 300 + CONTEXT
    one = [words.anchor[i] for i in range(50)]
    total = sum(10 ** alone(np.array([7, one.index(x)]))[1] for x in {model.of[a]: a for a in one}.values())
    assert total < 1 + 1e-3


def test_words_of_many_ids_are_summed():
    draw = np.random.default_rng(6)
    sizes = np.concatenate([draw.integers(1, 30, 300), [1, 5_000, 8, 9, 1]])
    first = np.concatenate([[0], np.cumsum(sizes)])
    flat = draw.integers(0, 40, first[-1])
    words, embed = Words(flat, first, flat[first[:-1]]), draw.normal(size=(40, 16))
    want = np.stack([embed[flat[a:b]].sum(axis=0) for a, b in zip(first[:-1], first[1:], strict=True)])
    some = draw.permutation(305)[:99]
    assert np.allclose(words.summed(embed), want) and np.allclose(words.summed(embed, some), want[some])
    assert words.summed(embed, some[:0]).shape == (0, 16)


def test_attention_of_large_weights_stays_in_range():
    """Far from 0, exponentials are taken less each row's largest; the results go on as
    before."""
    draw = np.random.default_rng(7)
    of = ((np.arange(40) % 3) * CLASSES + np.arange(40) % 5).astype(np.int32)
    model = Attention.fresh(np.ones(40), of)
    words = words_of(draw, 30)
    whole = blocks(draw.integers(0, 30, 400), np.array([0, 40, 47, 400]), 29)
    target = of[words.anchor][whole.target]
    for k in ("groups", "classes"):
        model.p[k] = draw.normal(size=model.p[k].shape).astype(np.float32)
    x = words.summed(model.p["embed"])[whole.read]
    want, plain = model.score(words, whole), model.step(x, whole.begins, target, whole.real)
    # The same shift of all of a row's logits changes nothing.
    for by in (-200, 200):
        moved = Attention(model.p | {"away": model.p["away"] + np.float32(by), "group_bias": model.p["group_bias"] + np.float32(by), "class_bias": model.p["class_bias"] + np.float32(by)}, of)
        assert np.allclose(moved.score(words, whole), want, atol=1e-3)
        loss, g, dx = moved.step(x, whole.begins, target, whole.real)
        assert np.isclose(loss, plain[0], rtol=1e-3) and np.allclose(dx, plain[2], atol=1e-4) and all(np.allclose(g[k], plain[1][k], atol=1e-3) for k in g)
    model.p["query"] = model.p["query"] * np.float32(1e4)
    assert np.isfinite(model.score(words, whole)).all() and all(np.isfinite(v).all() for v in model.step(x, whole.begins, target, whole.real)[1].values())


STEPS = """
import resource
import numpy as np
from gridloom.llm.attention import Attention, Words, blocks, classes_of
draw = np.random.default_rng(8)
words = Words(draw.integers(0, 40, 3000), np.arange(3001), np.arange(3000) % 40)
model = Attention.fresh(np.ones(40), classes_of(np.ones(40), draw.random((40, 8))))
texts = [(words, blocks(draw.integers(0, 3000, 80_000), np.arange(0, 80_001, 400), 0)) for _ in range(5)]
model.follow(iter(texts), 0.02, 512)
faults = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
model.follow(iter(texts), 0.02, 512)
print(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - faults)
"""


def test_steps_use_their_memory_again():
    """A step's arrays aren't given back and faulted in page by page for the next one."""
    found = subprocess.run([sys.executable, "-c", STEPS], cwd=Path(lm_scoring.__file__).parents[2], capture_output=True, text=True, check=True, timeout=100)
    assert int(found.stdout) < 8_000


def told(rows):
    return {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, t in rows}


def test_lm_base_against_brute_force(docs, sample):
    rows = [(i, t) for i, t, _ in sample] + [(5000, None), (5001, ""), (5002, "unseenword " * 3), (5003, "Das das DAS"), (5004, "long words " * 20_000)]
    every = [*rows, (None, "no name"), rows[0]]
    tokens = told(rows)
    counts = collections.Counter(w for i, t in every if i is not None and zlib.crc32(str(i).encode()) % 10 for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for head in (50, 10**6):
        got = lm_scoring.lm_scores(docs(*every), head=head).collect()
        assert len(got) == len(every)
        for r in got:
            own = tokens[r.doc_id] if r.doc_id is not None else ["no", "name", None]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
            assert np.isclose(r.base_score, sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rtol=1e-9)
            assert r.score < 0 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    assert lm_scoring.lm_scores(docs(*rows).where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_model_beats_the_base_on_held_out_texts(spark, sf):
    rows = lm_scoring.lm_scores(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").repartition(4))
    row = rows.where("held_out").selectExpr("sum(score) / sum(n_tokens) s", "sum(base_score) / sum(n_tokens) b", "avg(cast(score > base_score as int)) better").first()
    assert row.s > row.b + (0.05 if sf == "sf0.01" else 0.2) and row.better > 0.9


def test_word_shares_of_a_class_sum_to_one(docs, sample):
    """A model that always gives the classes' shares of the corpus is the base, but for
    the smoothing of words that weren't seen."""
    rows = [(i, t) for i, t, _ in sample]
    plain = lm_scoring.train
    lm_scoring.train = lambda docs, counts, files, folds: Attention.fresh(counts.mass, classes_of(counts.mass, counts.spread))
    try:
        got = lm_scoring.lm_scores(docs(*rows)).collect()
    finally:
        lm_scoring.train = plain
    s, b = (sum(getattr(r, c) for r in got) / sum(r.n_tokens for r in got) for c in ("score", "base_score"))
    assert abs(s - b) < 0.05


def test_lm_network_learns_from_every_training_row(docs, sample):
    rows = [(i, t) for i, t, _ in sample if t]
    files = packing.vocabulary()
    table = docs(*rows)
    scratch = Scratch(table.sparkSession)
    counts = lm_scoring.count(table, files, 10, scratch)
    reads = {i: lm_scoring._Reader(files)(lm_scoring.pa.array([t], lm_scoring.pa.large_string())) for i, t in rows}
    learned = [x for i, x in reads.items() if zlib.crc32(str(i).encode()) % 10]
    mass = np.zeros(lm_scoring.IDS)
    for x in learned:
        np.add.at(mass, x.distinct.anchor, x.counts)
    assert (mass == counts.mass).all() and counts.distinct.sum() == len({k for x in learned for k in x.keys.tolist()}) + 1
    want = np.zeros_like(counts.spread)
    for x in learned:
        own, part = lm_scoring._spread(x)
        want[own] += part
    assert np.allclose(want, counts.spread, rtol=1e-4)
    model = lm_scoring.train(table, counts, files, 10)
    start = Attention.fresh(counts.mass, model.of).p["embed"]
    moved = (model.p["embed"] != start).any(axis=1)
    read = np.zeros(lm_scoring.IDS, dtype=bool)
    for x in learned:
        for w in set(x.words[:-1].tolist()):
            read[x.distinct.flat[x.distinct.first[w] : x.distinct.first[w + 1]]] = True
    assert moved[read].mean() > 0.99 and moved[~read].sum() <= 1  # the end stands before each text
    scratch.close()


PAGES = [(1, "http://e.org/a", "<html lang='fr'><head><title>T &amp; t</title><script>var x='<p>no</p>'</script></head><body><p>Un <b>deux</b></p><p>trois&nbsp;quatre<a href='/x?a=1&amp;b'>l</a><!-- <a href=z> --></body></html>"), (2, None, None), (3, "http://e.org/\r\nX: y", "no tags < at all"), (3, "u", "<p>unclosed <style>p{}"), (None, "u", "é")]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    source = warc.responses(pages)
    every = source.unionByName(warc.derive(source).select(*source.columns))
    path = str(tmp_path / "w")
    assert {r.warc_type: r.records for r in warc.write_files(every, path).collect()} == {"response": 5, "metadata": 5, "conversion": 5}
    key = lambda r: (r.warc_type, tuple(map(tuple, r.headers)), bytes(r.block))
    assert sorted(map(key, warc.read_files(spark, path).collect())) == sorted(map(key, every.collect()))
    (tmp_path / "f").mkdir()
    whole = b"".join(gzip.compress(warc.serialize([tuple(h) for h in r.headers], bytes(r.block))) for r in every.collect())
    (tmp_path / "f" / "a.warc.gz").write_bytes(whole)
    assert sorted(map(key, warc.read_warc(spark, str(tmp_path / "f"))
        .collect())) == sorted(map(key, every.collect()))


def test_warc_codings_and_repeated_headers():
    page = "<p>caf\u00e9</p>".encode("latin-1")
    chunked = lambda x: b"3\r\n" + x[:3] + b"\r\n" + f"{len(x) - 3:x};q\r\n".encode() + x[3:] + b"\r\n0\r\n\r\n"
    for extra, body in (("", page), ("Transfer-Encoding: chunked\r\n", chunked(page)), ("Content-Encoding: gzip\r\n", gzip.compress(page)), ("Content-Encoding: deflate\r\nTransfer-Encoding: chunked\r\n", chunked(zlib.compress(page)))):
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; Charset=\"ISO-8859-1\"\r\n{extra}\r\n".encode() + body
        headers = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Payload-Digest", "sha1:A"), ("WARC-Payload-Digest", "md5:B")]
        _, (own, text) = warc.derived(headers, block)
        assert text.decode() == "caf\u00e9" and [v for k, v in own if k == "WARC-Payload-Digest"] == ["sha1:A", "md5:B"]
    assert warc.decoded([("Transfer-Encoding", "chunked"), ("Content-Encoding", "gzip")], b"zz\r\nno") == b"zz\r\nno"


def test_warc_links_and_text(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    source = {dict(map(tuple, r.headers))["WARC-Record-ID"]: (r, dict(map(tuple, r.headers))) for r in warc.responses(pages).collect()}
    rows = warc.derive(warc.responses(pages)).collect()
    text = {(r.page_id, r.target_uri): r.text for r in rows if r.warc_type == "conversion"}
    assert text[1, "http://e.org/a"] == "Un deux\ntrois quatrel" and text[2, None] == "" and text[3, "u"] == "unclosed" and text[None, "u"] == "é"
    conversions = {r.record_id for r in rows if r.warc_type == "conversion"}
    for r in rows:
        own, (of, headers) = dict(map(tuple, r.headers)), source[r.refers_to]
        assert r.page_id == of.page_id and own["WARC-Payload-Digest"] == headers["WARC-Payload-Digest"] and own.get("WARC-Target-URI") == headers.get("WARC-Target-URI") == own.get("WARC-Refers-To-Target-URI")
        assert own["WARC-Block-Digest"] == warc.digest(bytes(r.block)) and int(own["Content-Length"]) == len(r.block) == r.content_length
        if r.warc_type == "metadata":
            about = json.loads(bytes(r.block))
            assert about["conversion"] in conversions and about["source"] == r.refers_to and dict(about["source-headers"]) == headers
            if r.page_id == 1:
                assert about["links"] == ["/x?a=1&b"] and about["title"] == "T & t" and about["lang"] == "fr" and about["http-status"] == "HTTP/1.1 200 OK"
    assert warc.derive(warc.responses(pages.where("page_id < 0"))).count() == 0
    more = spark.createDataFrame([(1, "u", "<p>a</p>", 7, "x"), (1, "u", "<p>a</p>", 7, "x"), (2, "v", "<p>long " + "word " * 200_000 + "</p>", 7, "x")], "page_id long, url string, html string, block int, headers string")
    found = warc.derive(warc.responses(more)).where("warc_type = 'conversion'").collect()
    assert sorted(len(r.text) for r in found) == [1, 1, 1_000_004] and len({r.record_id for r in found}) == 2
    assert warc.derive(warc.derive(warc.responses(pages))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sample, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = queries.queries()[name](spark, "/root/testdata/sf0.001")
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == sorted(str([r[i] for i in order]) for r in want.fetchall())


def test_odd_texts_are_told():
    assert [pretoken.is_odd(t) for t in ("plain text", "don't", "it's", "x '", "a<|b", "Σ")] == [False, True, True, False, True, True]


def plain_page(page):
    """Markup by regular expressions, for pages whose tags are closed and don't nest."""
    import html as entities

    text = re.sub(r"<!--.*?-->|<(script|style|noscript|template|title)\b[^>]*>.*?</\1\s*>", " ", page, flags=re.S | re.I)
    text = re.sub(r"\s+", " ", text)
    text = re.sub(r"</?(?:p|div|li|br|tr|h1)\b[^>]*>", "\n", text, flags=re.I)
    text = re.sub(r"<[/!]?[a-zA-Z][^>]*>", "", re.sub(r"</?t[dh]\b[^>]*>", "\\t", text, flags=re.I))
    lines = (" ".join(entities.unescape(x).split()) for x in text.split("\n"))
    return "\n".join(x for x in lines if x), re.findall(r"<a [^>]*href=\"([^\"]*)\"", re.sub(r"<!--.*?-->", "", page))


PIECES = st.sampled_from(["word ", "a &amp; b", "<p>", "</p>", "<br/>", "<td>", "</td>", "<b class=x>", "</b>", "<!-- <p>no</p> -->", "<script>if (a < b) x()</script>", "<STYLE>p{}</style >", "<a href=\"/u?a=1\">", "</a>", "\n", "<title>t</title>", "<div id='q'>", "é", "1 < 2 ", "<h1>"])


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECES, max_size=25))
def test_markup_equals_regular_expressions(pieces):
    page = "".join(pieces)
    found = warc.read_page(page)
    text, links = plain_page(page)
    assert (found["text"], found["links"]) == (text, links)


@pytest.mark.parametrize("piece", ["<a ", "<title>", "<br ", "<td ", "<html ", "<a \"", "<p '", "<script>", "<!--", "<![CDATA[", "< ", "<a href ", "</", "<a href=x ", "<html lang ", "<<", "&amp", "<title></title", "<a>\""])
def test_a_hostile_page_takes_time_in_proportion(piece):
    import time

    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    warc.read_page(page)
    assert time.process_time() - began < 8  # some tenths of a second where the machine is free


def test_usual_tags_take_few_calls():
    import cProfile
    import pstats

    page = '<p class="x">word <a href="/u">b</a></p>\n' * 500
    profile = cProfile.Profile()
    found = profile.runcall(warc.read_page, page)
    assert found["links"] == ["/u"] * 500 and found["text"] == "\n".join(["word b"] * 500)
    assert pstats.Stats(profile).total_calls < 10 * 2000  # the tags


def test_record_ids_are_version_5_names():
    import uuid

    assert warc.record_id("response", 7, None, "é") == f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'response\x1f7\x1f\x1fé')}>"


def test_quotes_interrupted_and_unclosed_tags():
    read = warc.read_page
    assert read("<div title=\"a > b\">x</div>")["text"] == "x"
    assert read("a <b <i>c</i>")["text"] == "a <b c" and read("a < b > c")["text"] == "a < b > c" and read("x<p>y <a href=q")["text"] == "x\ny <a href=q"
    assert read("<title>never closed")["title"] is None and read("<title> A &lt; B </title>")["title"] == "A < B"
    assert read("<html><html lang=de-AT>")["lang"] == "de-AT" and read("<a name=x><a HREF = '/y'>")["links"] == ["/y"]


def test_records_without_id_and_lower_case_names(spark):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>t"
    meta, text = warc.derived([("warc-type", "response"), ("warc-record-id", "<urn:y>"), ("warc-target-uri", "u")], block)
    assert dict(text[0])["WARC-Refers-To"] == "<urn:y>" and dict(text[0])["WARC-Target-URI"] == "u" == dict(text[0])["WARC-Refers-To-Target-URI"]
    meta, text = warc.derived([("WARC-Type", "response"), ("WARC-Target-URI", "u")], block)
    assert "WARC-Refers-To" not in dict(text[0]) and dict(meta[0])["WARC-Concurrent-To"] == dict(text[0])["WARC-Record-ID"]
    rows = spark.createDataFrame([(1, "response", [("WARC-Type", "response")], block)], warc.RECORDS)
    assert {(r.refers_to, r.text) for r in warc.derive(rows).collect()} == {(None, None), (None, "t")}


def test_warc_files_hold_any_bytes(spark, tmp_path):
    draw = random.Random(3)
    blocks = [bytes(draw.randrange(256) for _ in range(n)) for n in (0, 1, 5, 3000, 200_000)] + [b"\r\n\r\n" * 5, b"WARC/1.1\r\n"]
    rows = [(i, "resource", [("WARC-Type", "resource"), ("WARC-Record-ID", f"<urn:{i}>"), ("X-\u00e9", "\u00e9"), ("Content-Length", str(len(b)))], b) for i, b in enumerate(blocks)]
    path = str(tmp_path / "files")
    warc.write_warc(spark.createDataFrame(rows, warc.RECORDS).repartition(2), path)
    got = {(dict(map(tuple, r.headers))["WARC-Record-ID"], bytes(r.block)) for r in warc.read_warc(spark, path + "/*.gz").collect()}
    assert got == {(f"<urn:{i}>", b) for i, b in enumerate(blocks)}
    data = b"".join(gzip.compress(warc.serialize([(k, v) for k, v in r[2]], r[3])) for r in rows)
    for step in (7, 1 << 16):
        assert [b for _, b in warc.stream(data, step)] == blocks
    assert [b for _, b in warc.stream(gzip.decompress(data))] == blocks
    with pytest.raises(ValueError, match="ends within"):
        list(warc.stream(gzip.compress(warc.serialize(rows[3][2], rows[3][3])[:-500])))


def plain_rates(texts, toxic, asked):
    """Log-likelihoods by word from dictionaries, as the module's text has them: numbers
    of different words before a word or a pair, discounted, with what was taken shared."""
    import math

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    before, pair_before = [collections.defaultdict(set) for _ in "ab"], [collections.defaultdict(set) for _ in "ab"]
    for text, c in zip(texts, toxic, strict=True):
        w = words(text)
        for i, x in enumerate(w):
            before[c][x].add(w[i - 1] if i else None)
            if i:
                pair_before[c][w[i - 1], x].add(w[i - 2] if i > 1 else None)

    def discounted(seen, by):
        n = [{k: len(v) for k, v in seen[c].items()} for c in (0, 1)]
        total = [max(1.0, sum(x.values())) for x in n]
        keys = set(n[0]) | set(n[1])
        return n, total, [{k: max(0.0, n[c].get(k, 0) - by - toxicity.CONTRAST * n[1 - c].get(k, 0) * total[c] / total[1 - c]) for k in keys} for c in (0, 1)], keys

    n, total, kept, keys = discounted(before, toxicity.WHOLE)
    taken = {k: sum(n[c].get(k, 0) - kept[c][k] for c in (0, 1)) for k in keys}
    shared = lambda k: (taken.get(k, 0) + 0.5) / (sum(taken.values()) + 0.5 * (len(keys) + 1))
    base = lambda c, k: (kept[c].get(k, 0) + (total[c] - sum(kept[c].values())) * shared(k) + 1e-9) / total[c]
    m, _, pairs, _ = discounted(pair_before, toxicity.WHOLE_PAIRS)
    out = []
    for c in (0, 1):
        context, left = collections.Counter(), collections.Counter()
        for (a, b), v in m[c].items():
            context[a] += v
            left[a] += pairs[c][a, b]
        rates = []
        for text in asked:
            w, log = words(text), 0.0
            for i, x in enumerate(w):
                p = base(c, x)
                if i and context[w[i - 1]]:
                    a = w[i - 1]
                    p = pairs[c].get((a, x), 0) / context[a] + (context[a] - left[a]) / context[a] * p
                log += math.log(p)
            rates.append(log / max(1, len(w)))
        out.append(rates)
    return np.array(out)


def test_smoothed_probabilities_equal_dictionaries(monkeypatch):
    import pyarrow as pa

    from gridloom.llm import bytewords as bw

    draw = random.Random(6)
    texts = [" ".join(draw.choice("ab cd ef gh ij kl mn".split()) for _ in range(draw.randrange(1, 40))) for _ in range(60)]
    toxic = np.array([i % 3 == 0 for i in range(60)], dtype=np.int64)
    texts = [t + " bad worse worst" * int(y) for t, y in zip(texts, toxic, strict=True)]
    asked = ["ab cd bad worse worst", "", "never seen", "ab ab ab", texts[0], "gh"]
    for whole, pairs in ((3, 12), (1, 1), (0, 2)):
        monkeypatch.setattr(toxicity, "WHOLE", whole)
        monkeypatch.setattr(toxicity, "WHOLE_PAIRS", pairs)
        got, n = toxicity.fit(texts, toxic).rates(bw.words(pa.array(asked), bw.LOWER_ALNUM, lower=True))
        assert np.allclose(got, plain_rates(texts, toxic.tolist(), asked)) and n.tolist() == [5, 0, 2, 3, n[4], 1]


def test_the_sample_is_the_first_by_hash(spark, docs, monkeypatch):
    """A bound on the hash changes nothing but what is put in order."""
    rows = [(i, f"text {i} of these words " + "nasty " * (i % 4 == 0)) for i in range(3000)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(3000)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity.F, "broadcast", lambda df, real=toxicity.F.broadcast: (seen.append({r[0] for r in df.collect()}), real(df))[1])
    toxicity.train(docs(*rows), labels, per_class=50)
    by_hash = {r["doc_id"]: r["h"] for r in spark.range(3000).selectExpr("id as doc_id", "xxhash64(id) as h").collect()}
    want = set()
    for c in (True, False):
        own = [i for i in range(3000) if (i % 4 == 0) == c and zlib.crc32(str(i).encode()) % 5]
        want |= set(sorted(own, key=by_hash.get)[:50])
    assert seen[-1] == want
