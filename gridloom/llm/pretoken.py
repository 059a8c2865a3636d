"""Pre-tokens of many texts at once, and a bounded cache of what each encodes to.

The two BPE vocabularies used here split a text into pre-tokens by Unicode class and
then merge inside each pre-token only. So a text's tokens are those of its pre-tokens,
and a pre-token seen before need not be merged again. The splitting is done on code
point arrays. Texts with anything the array form doesn't cover (contractions, the
vocabulary's special strings, characters that libraries class differently) are left to the
tokenizer library itself.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from collections.abc import Callable
from itertools import chain

import numpy as np

from gridloom.llm import bytewords as bw

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

BREAK, SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(6)
_SEPARATOR = "\U0010ffff"
#: White_Space of Unicode.
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Left to the library: contractions, special strings, separators that some regex
#: engines take as white space, the separator used here, and the letters whose lower
#: case depends on context.
_ODD = re.compile("'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])|<\\||[\x1c-\x1fİΣ\u180e]|" + _SEPARATOR)


@functools.cache
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    kind = {"L": LETTER, "N": NUMBER}
    for i in range(0x110000):
        c = unicodedata.category(chr(i))
        if c == "Cn":
            table[i] = UNKNOWN
        elif c[0] in kind:
            table[i] = kind[c[0]]
    table[_WHITE] = SPACE
    table[0x10FFFF] = BREAK
    return table


#: One of these is in every odd text; plain substring searches are the fast first look.
_HINTS = ("'", "<|", "\x1c", "\x1d", "\x1e", "\x1f", "İ", "Σ", "\u180e", _SEPARATOR)


def is_odd(text: str) -> bool:
    """Whether a text is left to the library. Characters that this Python's Unicode
    doesn't know may be letters to the library, which may be of a later version."""
    if any(x in text for x in _HINTS) and _ODD.search(text) is not None:
        return True
    if text.isascii():
        return False
    return bool((_classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)] == UNKNOWN).any())


@functools.cache
def byte_characters() -> list[str]:
    """The characters by which byte-level vocabularies write the bytes 0 .. 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


@functools.cache
def _written() -> dict[int, str]:
    return dict(enumerate(byte_characters()))


def written(text: str) -> str:
    """A pre-token as byte-level vocabularies write it."""
    return text.encode().decode("latin-1").translate(_written())


class PreTokens:
    """``start``/``end`` index ``codes``; ``first[i]`` is text i's first pre-token."""

    def __init__(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray):
        self.codes, self.start, self.end, self.first = codes, start, end, first

    def hashes(self) -> np.ndarray:
        base = bw._BYTE_BASES[0]
        n = len(self.codes)
        total = np.zeros(n + 1, dtype=np.uint64)
        # Odd multipliers keep code points apart; lengths enter to separate zeros.
        np.cumsum((self.codes.astype(np.uint64) + np.uint64(1)) * np.uint64(bw._BYTE_BASES[1]) * bw.powers(base, n), out=total[1:])
        return bw.mix((total[self.end] - total[self.start]) * bw.powers(bw.inverse(base), n + 1)[self.start])

    def text(self, i: int) -> str:
        return self.codes[self.start[i] : self.end[i]].tobytes().decode("utf-32-le")


def split(texts: list[str], spaced: bool) -> PreTokens:
    """Pre-tokens of texts that are not odd.

    spaced: a space belongs to the run of letters, numbers or other characters that it
    precedes, other white space forms pre-tokens of its own, and numbers stay together.
    Otherwise white space is dropped and each number character stands alone.
    """
    codes = np.frombuffer((_SEPARATOR.join([*texts, ""])).encode("utf-32-le"), dtype=np.uint32)
    kind = _classes()[codes]
    n = len(codes)
    cut = np.ones(n, dtype=bool)
    cut[1:] = kind[1:] != kind[:-1]
    cut |= kind == BREAK
    if not spaced:
        cut |= kind == NUMBER
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n)
    what = kind[start]
    if spaced:
        white = what == SPACE
        follows = np.zeros(len(start), dtype=bool)  # a visible run follows this white space
        follows[:-1] = white[:-1] & (what[1:] != BREAK)
        joined = follows & (codes[end - 1] == 0x20)
        prefix = np.zeros(len(start), dtype=bool)
        prefix[1:] = joined[:-1]
        lone = follows & ~joined & (end - start > 1)  # its last character stands alone
        extra = end[lone] - 1
        new_start = start - prefix
        new_end = end - joined
        keep = (new_end > new_start) & (what != BREAK)
        new_end[lone] -= 1
        start = np.concatenate([new_start[keep], extra])
        end = np.concatenate([new_end[keep], extra + 1])
        if len(extra):
            order = np.argsort(start, kind="stable")
            start, end = start[order], end[order]
    else:
        keep = (what != SPACE) & (what != BREAK)
        start, end = start[keep], end[keep]
    edges = np.concatenate([[0], np.flatnonzero(kind == BREAK) + 1])[: len(texts) + 1]
    first = np.searchsorted(start, edges, "left")
    return PreTokens(codes, start, end, first)


class Cache:
    """Token ids of pre-tokens, by hash. Emptied when it has ``limit`` entries, so its
    memory is bounded; that changes how often something is encoded, never what."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = 600_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int32)
        self.flat = np.zeros(0, dtype=np.uint16)

    def look_up(self, pre: PreTokens) -> tuple[np.ndarray, np.ndarray]:
        """Per pre-token, where its ids start in ``flat`` and how many they are."""
        keys, sample, inverse = np.unique(pre.hashes(), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.limit:
            self.clear()
        spot = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        ok = spot < len(self.keys)
        known[ok] = self.keys[spot[ok]] == keys[ok]
        if not known.all():
            new = np.flatnonzero(~known)
            ids = self.encode([pre.text(i) for i in sample[new].tolist()])
            size = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
            flat = np.fromiter(chain.from_iterable(ids), dtype=np.uint16, count=int(size.sum()))
            at = len(self.flat) + np.concatenate([[0], np.cumsum(size, dtype=np.int64)[:-1]])
            self.flat = np.concatenate([self.flat, flat])
            self.keys = np.insert(self.keys, spot[new], keys[new])
            self.at = np.insert(self.at, spot[new], at)
            self.size = np.insert(self.size, spot[new], size)
            spot = np.searchsorted(self.keys, keys)
        spot = spot[inverse]
        return self.at[spot], self.size[spot]
