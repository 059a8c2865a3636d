import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import fingerprint as fp


def plain_digest(text: str) -> str:
    """The digest, triplet by triplet."""
    raw = text.encode() + bytes(fp.THIRD)
    counts = [0] * fp.BUCKETS
    for i in range(len(raw) - fp.THIRD):
        counts[int(fp._DRAWN[0][raw[i]] ^ fp._DRAWN[1][raw[i + fp.SECOND]] ^ fp._DRAWN[2][raw[i + fp.THIRD]])] += 1
    order = sorted(counts)
    edges = [order[fp.BUCKETS * q // 4 - 1] for q in (1, 2, 3)]
    levels = [sum(c > e for e in edges) for c in counts]
    size, step = len(raw) - fp.THIRD, 0
    while size and fp.BASE**step <= size * (1 + 1e-12):
        step += 1
    body = bytes(a << 6 | b << 4 | c << 2 | d for a, b, c, d in zip(*[iter(levels)] * 4, strict=True))
    return bytes([min(step, 255)]).hex() + body.hex()


def plain_likeness(a: str, b: str) -> float:
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    far = sum(abs((p >> s & 3) - (q >> s & 3)) for p, q in zip(x[1:], y[1:], strict=True) for s in (0, 2, 4, 6)) / fp.BUCKETS
    steps = min(max(abs(x[0] - y[0]) - 1, 0), fp.MOST_STEPS)
    return 1 - min(1, (far + fp.PER_STEP * steps) / fp.FARTHEST)


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        changed = text[: len(text) - k] + after[:k]
        own, other = plain_digest(text), plain_digest(changed)
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, other, plain_likeness(own, other), plain_likeness(own, plain_digest(after))))
    return out


def test_rows_equal_brute_force(spark, docs):
    rng = np.random.default_rng(4)
    syllables = ["ba", "lo", "mé", "st", "日", " ", ", ", "\n"]
    rows = [(i * 3, "".join(rng.choice(syllables, int(rng.integers(0, 400))))) for i in range(60)]
    rows += [(1, None), (2, ""), (4, "ab"), (5, "x" * 30), (None, "no name " * 9), (7, rows[0][1])]
    got = [tuple(r) for r in fp.fingerprints(docs(*rows)).collect()]
    want = brute(rows)
    key = lambda r: (r[0] is None, r[0] or 0)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_whole_table_is_told_apart(spark, docs, sample):
    got = fp.fingerprints(docs(*[(i, t) for i, t, _ in sample])).collect()
    assert len(got) == len(sample)
    assert sum(r["near_edited"] > r["near_next"] for r in got) >= 0.97 * len(got)
    assert np.median([r["near_edited"] for r in got]) > 0.5 > np.median([r["near_next"] for r in got])
    assert all(0 <= r[x] <= 1 for r in got for x in ("near_edited", "near_next"))


def test_hot_and_repeated_rows(spark, docs):
    """A third of the rows is one row, another third shares a doc_id."""
    rows = [(5, "the same row again")] * 40 + [(6, f"text {i} of one name") for i in range(40)] + [(i, f"own text {i}") for i in range(10, 50)]
    found = fp.fingerprints(docs(*rows))
    got = found.collect()
    assert len(got) == 120 and len({r["fingerprint"] for r in got if r["doc_id"] == 5}) == 1
    # 39 of the equal rows are followed by one like them; the last by the largest doc_id
    same = [r for r in got if r["doc_id"] == 5 and r["near_next"] == 1.0]
    assert len(same) == 39
    # among the rows of one doc_id each follows another: a chain, whatever its order
    shas = {hashlib.sha256(fp.edited(a[1], b[1]).encode()).hexdigest() for a in rows[40:80] for b in [*rows[40:80], rows[0]]}
    assert {r["edited_sha256"] for r in got if r["doc_id"] == 6} <= shas


def test_long_texts_go_piece_by_piece(monkeypatch):
    texts = ["word %d " % i * 50 for i in range(5)] + ["", "z" * 1000]
    whole = fp.digests(texts)
    monkeypatch.setattr(fp, "STEP", 97)
    assert (fp.digests(texts) == whole).all()


def test_empty_table_single_row_and_likeness_column(spark, docs):
    assert fp.fingerprints(docs((1, "a")).where("false")).collect() == []
    one = fp.fingerprints(docs((1, "abcdef"))).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    a, b = plain_digest("some text here"), plain_digest("another text there")
    found = spark.createDataFrame([(a, b), (a, a), (None, a)], "a string, b string").select(fp.likeness(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r["x"] for r in found] == [pytest.approx(plain_likeness(a, b)), 1.0, None]
