import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import bytewords as bw

TEXT = st.text(alphabet=st.sampled_from("aB3é \t\n.,\x0b-ß日"), max_size=60)


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_equal_the_patterns(texts):
    for pattern, table, low in ((r"[^\x20\x09-\x0D]+", bw.NOT_SPACE, False), (r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bw.LOWER_ALNUM, True)):
        found = bw.words(pa.array(texts, pa.string()), table, lower=low)
        want = [re.findall(pattern, lower(t or "") if low else t or "") for t in texts]
        got = [[x.decode() for x in found.text(int(a), int(b))] for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
        assert got == want
        assert found.counts.tolist() == [len(x) for x in want]


def test_hashes_depend_on_the_word_only():
    found = bw.words(pa.array(["the cat", None, "a the", "cat " * 5]), bw.NOT_SPACE)
    h = found.hashes()
    assert h[0] == h[3] and h[1] == h[4] and h[0] != h[1]
    w = bw.window_hashes(h, 2)
    assert w[4] == w[5] and w[0] != w[4]
    assert bw.within(found.doc, 2).tolist() == [True, False, True, False, True, True, True, True]


def test_long_texts_hash_like_short_ones(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000))
    whole = bw.words(pa.array([text]), bw.NOT_SPACE).hashes()
    monkeypatch.setattr(bw, "SEGMENT", 64)
    assert (bw.words(pa.array([text]), bw.NOT_SPACE).hashes() == whole).all()
    assert len(bw.window_hashes(whole, 9999)) == 0


def test_chunks_keep_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["a" * 10, None, "", "b" * 50, "c"])], ["i", "text"])
    parts = list(bw.chunks(iter([batch, batch.slice(0, 0)]), "text", 12))
    assert [x for p in parts for x in p.column(0).to_pylist()] == [0, 1, 2, 3, 4] and len(parts) > 1


def test_ragged():
    assert bw.ragged(np.array([5, 0]), np.array([2, 3])).tolist() == [5, 6, 0, 1, 2]
