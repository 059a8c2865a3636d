"""Words and word windows of many texts at once, as numpy arrays over UTF-8 bytes.

The word patterns used here are decided by single bytes (every byte of a non-ASCII
character is a word byte), so words can be found without decoding the text. Hashes are
64-bit polynomials over randomly drawn byte values, finished with a bijective mixer;
the constants come from a fixed seed, so every process computes the same values.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed in one step; keeps temporaries at a few tens of MB for any text length.
SEGMENT = 1 << 18
#: Bytes of text handled together.
CHUNK = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20_240_229))


def _odd() -> int:
    return int(_RNG.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 1


_BYTE_VALUES = [_RNG.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1) for _ in range(2)]
_BYTE_BASES = [_odd(), _odd()]
_WORD_BASES = [_odd(), _odd()]

#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing: digits, a-z and all non-ASCII)
LOWER_ALNUM = np.zeros(256, dtype=bool)
LOWER_ALNUM[0x30:0x3A] = LOWER_ALNUM[0x61:0x7B] = LOWER_ALNUM[0x80:] = True
#: Lower-cases A-Z only.
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(maxsize=12)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    return _powers(base, max(1 << 16, 1 << max(0, int(n - 1)).bit_length()))[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@functools.cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


@functools.cache
def keep_freed() -> None:
    """Let this process use up to 64 MB of freed memory again before it goes back, with
    arrays of up to 16 MB among it: those that each of many steps makes anew would be
    faulted in page by page each time. ``release`` gives it back."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):
        return
    mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD
    mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


def release() -> None:
    """Give freed memory back: workers outlive a task and share an executor."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The same rows, in batches whose texts have about ``size`` bytes or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()
    release()


@dataclass
class Words:
    """Words of several texts. ``doc`` is the row of each word; ``first`` the index of
    each row's first word, with the total at the end."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, variant: int = 0) -> np.ndarray:
        out = np.empty(len(self.start), dtype=np.uint64)
        base, values = _BYTE_BASES[variant], _BYTE_VALUES[variant]
        back, i, n = inverse(base), 0, len(self.start)
        while i < n:
            lo = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, lo + SEGMENT, "right")))
            hi = int(self.end[j - 1])
            total = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum(values[self.raw[lo:hi]] * powers(base, hi - lo), out=total[1:])
            s, e = self.start[i:j] - lo, self.end[i:j] - lo
            out[i:j] = mix((total[e] - total[s]) * powers(back, hi - lo + 1)[s])
            i = j
        return out

    def text(self, i: int, j: int) -> list[bytes]:
        """Words i .. j-1."""
        return [self.raw[s:e].tobytes() for s, e in zip(self.start[i:j].tolist(), self.end[i:j].tolist(), strict=True)]


def words(column: pa.Array, pattern: np.ndarray, lower: bool = False) -> Words:
    """All words of a string column: runs of the bytes that ``pattern`` marks."""
    raw, offsets = text_bytes(column)
    if lower:
        raw = TO_LOWER[raw]
    inside = pattern[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    before &= ~edge[:-1]
    start = np.flatnonzero(inside & ~before)
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets, "left")
    doc = np.repeat(np.arange(len(column)), np.diff(first))
    return Words(raw, start, end, doc, first)


def window_hashes(word_hashes: np.ndarray, k: int, variant: int = 0) -> np.ndarray:
    """Hash of the k words from each position; position i stands for words i .. i+k-1."""
    n = len(word_hashes)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    base = _WORD_BASES[variant]
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(word_hashes * powers(base, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(inverse(base), n - k + 1))


def within(doc: np.ndarray, k: int) -> np.ndarray:
    """True where the window of k words stays inside one text."""
    return doc[: len(doc) - k + 1] == doc[k - 1 :] if len(doc) >= k else np.zeros(0, dtype=bool)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0] .. starts[0]+lengths[0]-1, starts[1] .. and so on."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return np.arange(total, dtype=np.int64) + shift
