import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import spelling as sp


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, min_chars=6, min_count=5, ratio=5, every=199):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_chars and c >= min_count}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


WORD = st.text(alphabet="abé", min_size=1, max_size=7)


@settings(max_examples=300, deadline=None)
@given(st.sets(WORD, max_size=40), WORD)
def test_the_trie_finds_each_neighbour_once(words, word):
    ordered = sorted(words)
    trie = sp.Trie(ordered, list(range(1, len(ordered) + 1)))
    got = trie.near(word)
    assert sorted(got) == sorted((w, i + 1) for i, w in enumerate(ordered) if one_edit(w, word))


def test_deep_tries_need_no_recursion():
    words = ["a" * i for i in range(1, 3000)]
    trie = sp.pickle.loads(sp.pickle.dumps(sp.Trie(words, [1] * len(words))))
    assert sorted(trie.near("a" * 1500)) == [("a" * 1499, 1), ("a" * 1501, 1)]


def test_rows_equal_brute_force_with_small_shards(spark, docs, sample):
    rows = [(i, t) for i, t, _ in sample]
    want = brute(rows)
    assert any(r[1] for r in want)
    assert {tuple(r) for r in sp.variants(docs(*rows)).collect()} == want
    got = sp.variants(docs(*rows), shard_words=50, shard_chars=500, group_bytes=20_000).collect()
    assert {tuple(r) for r in got} == want


def test_chains_ties_and_letters(spark, docs):
    text = " ".join(["colours"] * 625 + ["colour"] * 125 + ["colou"] * 25 + ["coloux"] * 5 + ["Àbcdefg"] * 30 + ["àbcdefg"] * 6 + ["xbcdefg"] * 30)
    got = {r["word"]: r for r in sp.variants(docs((1, text), (None, text)), min_chars=5, every=10**12).collect()}
    assert got["coloux"]["form"] == "colour" and got["coloux"]["root"] == "colours" and got["colou"]["root"] == "colours"
    assert got["àbcdefg"]["form"] == "xbcdefg"  # as frequent as the other and before it
    assert got["Àbcdefg"]["form"] is None and got["Àbcdefg"]["n_near"] == 2
    assert {tuple(r) for r in got.values()} == brute([(1, text), (None, text)], 5, every=10**12)


def test_edge_cases(spark, docs):
    assert sp.variants(docs((1, "a")).where("false")).collect() == []
    assert sp.variants(docs((1, None), (2, ""), (3, "short word 123"))).collect() == []
    long = "q" * 5000
    rows = [(i, f"{long} {long}x the words repeat") for i in range(6)] + [(9, "repeat " * 20)] * 2
    got = {tuple(r) for r in sp.variants(docs(*rows), shard_chars=1000).collect()}
    assert got == brute(rows)


def test_texts_longer_than_a_piece(monkeypatch):
    text = "Some Words über words, some WORDS"
    whole = sp._runs(text)
    monkeypatch.setattr(sp, "PIECE", 5)
    assert sp._runs(text) == whole == Counter({"some": 2, "words": 3, "über": 1})
