"""Token counts under a word-end BPE vocabulary.

Whole-token shortcut. Before any text is read, each vocabulary string that ends a word
is encoded alone by the library; those that come back as their one own token are proven
whole. A pre-token that is one of them counts one, with no merging. Only the rest is
given to the library, once per distinct pre-token while it stays in a bounded cache.

Edge cases: a null or empty text has 0 bytes and 0 tokens. Very long texts are handled
like others, one at a time. Repeated rows each get a row. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm import bytewords as bw
from gridloom.llm import pretoken
from gridloom.llm.session import tune

LIMIT = 2048
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Counts tokens with one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.cache = pretoken.Cache(self._merge)
        self.whole = self._prove()

    def _encode(self, items: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(items, add_special_tokens=False)]

    def _merge(self, items: list[str]) -> list[list[int]]:
        """Ids of single pre-tokens: the library's merges without its splitting."""
        merge = self.library.model.tokenize
        return [[y.id for y in merge(pretoken.written(x))] for x in items]

    def _prove(self) -> np.ndarray:
        """Sorted hashes of the strings that encode alone as one token."""
        end = "</w>"
        byte_of = {c: b for b, c in enumerate(pretoken.byte_characters())}
        found, ids = [], []
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            if token.endswith(end):
                try:
                    text = bytes(byte_of[c] for c in token[: -len(end)]).decode()
                except (KeyError, UnicodeDecodeError):
                    continue
                if text and not pretoken.is_odd(text) and unicodedata.normalize("NFC", text).lower() == text:
                    found.append(text)
                    ids.append(i)
        proven = [t for t, i, got in zip(found, ids, self._encode(found), strict=True) if got == [i]]
        pre = pretoken.split(proven, spaced=False)
        alone = np.diff(pre.first) == 1
        return np.sort(pre.hashes()[pre.first[:-1][alone]])

    def count(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), dtype=np.int64)
        strange = [bool(t) and pretoken.is_odd(t) for t in texts]
        plain = [i for i, t in enumerate(texts) if t and not strange[i]]
        odd = [i for i, t in enumerate(texts) if strange[i]]
        if odd:
            out[odd] = [len(x) for x in self._encode([texts[i] for i in odd])]
        if plain:
            pre = pretoken.split([_normal(texts[i]) for i in plain], spaced=False)
            hashes = pre.hashes()
            whole = np.zeros(len(hashes), dtype=bool)
            spot = np.minimum(np.searchsorted(self.whole, hashes), len(self.whole) - 1)
            if len(self.whole):
                whole = self.whole[spot] == hashes
            rest = np.flatnonzero(~whole)
            each = np.ones(len(hashes), dtype=np.int64)
            if len(rest):
                _, each[rest] = self.cache.look_up(pretoken.PreTokens(pre.codes, pre.start[rest], pre.end[rest], pre.first))
            total = np.concatenate([[0], np.cumsum(each)])
            out[plain] = total[pre.first[1:]] - total[pre.first[:-1]]
        return out


def _normal(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row.

    One pass over the texts, no shuffle. ``path``: the vocabulary file, at the same
    place on every executor.
    """
    tune(docs.sparkSession)
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.chunks(batches):
            _, offsets = bw.text_bytes(batch.column(1))
            counts = counter(path).count([x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
