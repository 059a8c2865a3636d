"""A small causal self-attention language model over words read as subword ids, in numpy.

A word enters as the sum of the embeddings of its subword ids. One attention layer and
one feed-forward layer work on blocks of ``STRIDE`` places: a place attends to itself,
to those before it in its block and to the whole block before, so windows of ``CONTEXT``
places overlap, every word is scored once and with at least CONTEXT - STRIDE words
before it where there are any, and keys and values are made once. Texts begin with a
block of their own, so a text's score doesn't depend on what it is scored with.

The output is factored, so that few exponentials are needed for each word: the network
gives the probability of the next word's group and that of its class in the group; the
word's share of its class is its count over the whole training corpus. Classes are of
anchors: a word's anchor is its longest subword id. Groups hold the anchors that occur
in the same texts as the same frequent ones; in a group the most frequent anchors are
classes of their own and the others share the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from gridloom.llm import bytewords as bw

CONTEXT = 32
STRIDE = 16
WIDTH = 16
HIDDEN = 32
CLUSTERS = 24
CLASSES = 32  # in a group
SHARED = 4  # of these, for the anchors that have none of their own
SHORT = 8  # subword ids of a word that are added for all words at once


def classes_of(counts: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """Class of every anchor, as group * CLASSES + class in the group. counts: of each
    anchor; beside: how often the texts it is in have each of some frequent anchors."""
    order = np.argsort(-counts, kind="stable")
    k = beside.shape[1]
    profile = beside + 0.5 * (beside.sum(axis=0) + 1e-6) / (beside.sum() + 1e-6 * k)
    profile = np.sqrt(profile / profile.sum(axis=1, keepdims=True))
    seen = order[: max(1, int((counts > 0).sum()))]
    seen = seen[:4096]  # centres follow the frequent ones; every anchor goes to the nearest
    centre = profile[seen[np.linspace(0, len(seen) - 1, min(CLUSTERS, len(seen))).astype(int)]]
    for _ in range(15):
        near = (profile[seen] @ centre.T).argmax(axis=1)
        for c in range(len(centre)):
            own = seen[near == c]
            if len(own):
                centre[c] = profile[own].mean(axis=0)
                centre[c] /= np.linalg.norm(centre[c])
    group = np.unique((profile @ centre.T).argmax(axis=1), return_inverse=True)[1]
    out = np.empty(len(counts), dtype=np.int32)
    for g in range(int(group.max()) + 1):
        own = order[group[order] == g]
        alone = CLASSES - SHARED
        place = np.arange(len(own))
        # Those beyond share by frequency, each class with four times the anchors of the one before.
        far = np.maximum(place - alone, 0) / max(1, len(own) - alone)
        shared = alone + np.minimum(SHARED - 1, np.maximum(0, SHARED - 1 + np.floor(np.log(np.maximum(far, 1e-9)) / np.log(4)))).astype(int)
        out[own] = g * CLASSES + np.where(place < alone, place, shared)
    return out


def _normal(draw: np.random.Generator, *shape: int, scale: float = 0.1) -> np.ndarray:
    return draw.normal(0, scale, shape).astype(np.float32)


def _exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """Exponentials less what was taken from each row so that they stay in range, their
    sums by the last axis, and what was taken: nothing, where they stay in range as is."""
    if z.size and z.max() < 60:
        e = np.exp(z)
        total = _total(e)
        if total.min() > 1e-20:
            return e, total, 0.0
    top = z.max(axis=-1, keepdims=True)
    e = np.exp(z - top)
    return e, _total(e), top[..., 0]


def _softmax(z: np.ndarray) -> np.ndarray:
    """By the last axis."""
    e, total, _ = _exponentials(z)
    e /= total[..., None]
    return e


def _log_total(z: np.ndarray) -> np.ndarray:
    """Logarithms of the summed exponentials of the last axis."""
    _, total, top = _exponentials(z)
    return np.log(total) + top


def _total(z: np.ndarray) -> np.ndarray:
    """Sums of the last axis, as a product, which is faster on short rows."""
    return (z.reshape(-1, z.shape[-1]) @ np.ones(z.shape[-1], z.dtype)).reshape(z.shape[:-1])


def _columns(z: np.ndarray) -> np.ndarray:
    """Sums of the first axis, likewise."""
    return (np.ones(len(z), z.dtype) @ z.reshape(len(z), -1)).reshape(z.shape[1:])


def _by_kind(kind: np.ndarray, kinds: int) -> tuple[np.ndarray, list[int]]:
    """Rows in the order of ``kind``, and where each kind begins and ends."""
    order = np.argsort(kind.astype(np.int16), kind="stable")  # a radix sort
    return order, np.searchsorted(kind[order], np.arange(kinds + 1)).tolist()


def _sums(number: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each number."""
    d = rows.shape[1]
    return np.bincount((number[:, None] * d + np.arange(d)).ravel(), rows.ravel(), n * d).reshape(n, d).astype(rows.dtype)


def _numbered(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in any order, and each value's place there. ``table``: of whole
    numbers, longer than any value; what it holds doesn't matter."""
    at = np.arange(len(values))
    table[values] = at
    found = values[table.take(values) == at]
    table[found] = at[: len(found)]
    return found, table.take(values)


@dataclass
class Words:
    """Distinct words of some texts: their subword ids ``flat[first[i] : first[i + 1]]``
    and anchors."""

    flat: np.ndarray
    first: np.ndarray
    anchor: np.ndarray

    def summed(self, embed: np.ndarray, some: np.ndarray | None = None) -> np.ndarray:
        """Each word's vector, or those of some of the words."""
        first, size = self.first[:-1], np.diff(self.first)
        if some is not None:
            first, size = first.take(some), size.take(some)
        if not len(size):
            return np.zeros((0, embed.shape[1]), embed.dtype)
        # Words of most ids first: those that have a further id are then the first ones.
        order = np.argsort(-np.minimum(size, SHORT + 1).astype(np.int16), kind="stable")
        at, size = first.take(order), size.take(order)
        more = np.searchsorted(-np.minimum(size, SHORT + 1), -np.arange(SHORT + 1)).tolist()
        added = embed.take(self.flat.take(at), axis=0)
        for j, m in enumerate(more[1:SHORT], 1):
            added[:m] += embed.take(self.flat.take(at[:m] + j), axis=0)
        if m := more[SHORT]:
            left = size[:m] - SHORT
            ids = self.flat.take(_ragged(at[:m] + SHORT, left))
            added[:m] += np.add.reduceat(embed.take(ids, axis=0), np.cumsum(left) - left, axis=0)
        out = np.empty_like(added)
        out[order] = added
        return out


@dataclass
class Blocks:
    """Texts as blocks of STRIDE places: the word read and the one that follows, as
    numbers of ``Words``; whether a place is of the text; whether a block begins one."""

    read: np.ndarray
    target: np.ndarray
    real: np.ndarray
    begins: np.ndarray

    def __getitem__(self, part: slice) -> Blocks:
        return Blocks(self.read[part], self.target[part], self.real[part], self.begins[part])


def blocks(words: np.ndarray, first: np.ndarray, lead: int) -> Blocks:
    """words: numbers of the words of texts one after the other; ``lead``: the word that
    stands before a text's first."""
    sizes = np.diff(first)
    each = -(-sizes // STRIDE)
    begin = np.concatenate([[0], np.cumsum(each)])
    n = int(begin[-1])
    at = np.arange(len(words)) + np.repeat(begin[:-1] * STRIDE - first[:-1], sizes)
    read, target, real = np.full(n * STRIDE, lead), np.full(n * STRIDE, lead), np.zeros(n * STRIDE, bool)
    target[at] = words
    real[at] = True
    before = np.append(lead, words[:-1])
    before[first[:-1][sizes > 0]] = lead
    read[at] = before
    begins = np.zeros(n, bool)
    begins[begin[:-1][sizes > 0]] = True
    return Blocks(*(x.reshape(n, STRIDE) for x in (read, target, real)), begins)


#: Attention is kept by blocks of keys: for each, rows for the queries of the block itself
#: and then for those of the next one.
_AWAY = np.arange(CONTEXT)[:, None] - np.arange(STRIDE)[None, :]  # places from key to query
_FUTURE = np.where(_AWAY < 0, np.float32(-1e9), np.float32(0))


def _with_next(y: np.ndarray) -> np.ndarray:
    """Rows of each block but the last and of the next one, as overlapping views."""
    b, n = y.shape[:2]
    return np.lib.stride_tricks.as_strided(y, (b - 1, 2 * n, *y.shape[2:]), y.strides, writeable=False)


def _met(y: np.ndarray) -> np.ndarray:
    """Sums for queries of what their own block and the one before hold for them."""
    n = y.shape[1] // 2
    out = y[:, :n].copy()
    out[1:] += y[:-1, n:]
    return out


def _attended(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of attention, and their sums for each query; less what is taken from
    a query's rows so that they stay in range, where they don't as is."""
    if z.max() < 60:
        e = np.exp(z)
        total = _met(_total(e))
        if total.min() > 1e-20:
            return e, total
    top, n = z.max(axis=2), z.shape[1] // 2
    own = top[:, :n].copy()
    np.maximum(own[1:], top[:-1, n:], out=own[1:])
    z[:, :n] -= own[:, :, None]
    z[:-1, n:] -= own[1:, :, None]
    e = np.exp(z, out=z)
    return e, _met(_total(e))


@dataclass
class Attention:
    p: dict[str, np.ndarray]
    of: np.ndarray  # class of each anchor

    @staticmethod
    def fresh(counts: np.ndarray, of: np.ndarray, seed: int = 5) -> Attention:
        """Weights that give the classes' own shares of the anchors' counts."""
        draw = np.random.Generator(np.random.PCG64(seed))
        v, d = len(counts), WIDTH
        groups = int(of.max()) // CLASSES + 1
        weight = counts + 0.1
        by_group = np.bincount(of, weight, groups * CLASSES).reshape(groups, CLASSES)
        with np.errstate(divide="ignore"):
            inside = np.maximum(np.log(by_group / by_group.sum(axis=1, keepdims=True)), -1e9)  # classes without anchors stay there
        p = {
            "embed": _normal(draw, v, d), "away": np.zeros(CONTEXT, np.float32), "query": _normal(draw, d, d, scale=0.3), "key": _normal(draw, d, d, scale=0.3),
            "value": _normal(draw, d, d, scale=0.3), "in": _normal(draw, d, HIDDEN, scale=0.3), "in_bias": np.zeros(HIDDEN, np.float32), "out": _normal(draw, HIDDEN, d, scale=0.2),
            "groups": np.zeros((d, groups), np.float32), "group_bias": np.log(by_group.sum(axis=1) / weight.sum()).astype(np.float32),
            "classes": np.zeros((groups, d, CLASSES), np.float32), "class_bias": inside.astype(np.float32),
        }
        return Attention(p, of)

    def _inputs(self) -> np.ndarray:
        """Weights of queries, which are scaled, keys and values, side by side."""
        p = self.p
        return np.concatenate([p["query"] * p["query"].dtype.type(1 / np.sqrt(WIDTH)), p["key"], p["value"]], axis=1)

    def _forward(self, x: np.ndarray, begins: np.ndarray) -> dict[str, np.ndarray]:
        """Activations of blocks with inputs ``x`` [block, place, width]. The first block
        has nothing before it."""
        p, (b, n, d) = self.p, x.shape
        flat = x.reshape(-1, d)
        every = np.empty((b + 1, n, 3 * d), x.dtype)
        every[b] = 0
        np.matmul(flat, self._inputs(), out=every[:b].reshape(-1, 3 * d))
        q, k, v = _with_next(every[:, :, :d]), every[:b, :, d : 2 * d], every[:b, :, 2 * d :]
        z = q @ k.transpose(0, 2, 1)
        z += p["away"][np.maximum(_AWAY, 0)] + _FUTURE.astype(x.dtype)
        z[np.append(begins[1:], True), n:] = -1e9
        a, total = _attended(z)
        seen = _met(a @ v)
        seen /= total[:, :, None]
        seen = seen.reshape(-1, d)
        h = flat + seen
        r = h @ p["in"]
        r += p["in_bias"]
        np.maximum(r, 0, out=r)
        y = r @ p["out"]
        y += h
        return {"x": flat, "q": q, "k": k, "v": v, "a": a, "total": total, "seen": seen, "h": h, "r": r, "y": y}

    def _logits(self, y: np.ndarray, edges: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Of groups, and of the classes in the target's group; rows stand in the order of
        these groups, which begin and end at ``edges``."""
        p, z = self.p, np.empty((len(y), CLASSES), y.dtype)
        by_group = y @ p["groups"]
        by_group += p["group_bias"]
        for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if j > i:
                np.matmul(y[i:j], p["classes"][k], out=z[i:j])
                z[i:j] += p["class_bias"][k]
        return by_group, z

    def _log_probability(self, y: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithm for each row's target class."""
        order, edges = _by_kind(target // CLASSES, len(self.p["class_bias"]))
        kind, inside = np.divmod(target.take(order), CLASSES)
        rows = np.arange(len(y))
        out = np.empty(len(y))
        by_group, z = self._logits(y.take(order, axis=0), edges)
        found = by_group.take(rows * by_group.shape[1] + kind).astype(np.float64) - _log_total(by_group)
        out[order] = found + z.take(rows * CLASSES + inside) - _log_total(z)
        return out

    def step(self, x: np.ndarray, begins: np.ndarray, target: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss a word, gradients, and that of the inputs; target: classes."""
        p, (b, n, d) = self.p, x.shape
        f = self._forward(x, begins)
        # Places of the text in the order of their targets' groups.
        own = np.flatnonzero(real.ravel())
        t = target.ravel().take(own)
        order, edges = _by_kind(t // CLASSES, len(p["class_bias"]))
        own, (kind, inside) = own.take(order), np.divmod(t.take(order), CLASSES)
        y, rows, m = f["y"].take(own, axis=0), np.arange(len(own)), max(1, len(own))
        g = {"classes": np.zeros_like(p["classes"]), "class_bias": np.zeros_like(p["class_bias"])}
        by_group, z = self._logits(y, edges)
        # Gradients are those of the summed loss until the end.
        loss = 0.0
        e, z = _softmax(by_group), _softmax(z)
        for probability, at in ((e.reshape(-1), rows * e.shape[1] + kind), (z.reshape(-1), rows * CLASSES + inside)):
            found = probability.take(at)
            loss -= np.log(found + 1e-30).sum()
            probability[at] = found - 1
        g["groups"], g["group_bias"] = y.T @ e, _columns(e)
        dy_own = e @ p["groups"].T
        for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if j > i:
                g["classes"][k], g["class_bias"][k] = y[i:j].T @ z[i:j], _columns(z[i:j])
                dy_own[i:j] += z[i:j] @ p["classes"][k].T
        dy = np.zeros_like(f["y"])
        dy[own] = dy_own
        g["out"] = f["r"].T @ dy
        du = dy @ p["out"].T
        du *= f["r"] > 0
        g["in"], g["in_bias"] = f["h"].T @ du, _columns(du)
        dy += du @ p["in"].T
        # Of attention, by what is divided by the sums, with a block of zeros at the end.
        dh, less = np.zeros((b + 1, n, d), dy.dtype), np.zeros((b + 1, n), dy.dtype)
        np.divide(dy.reshape(b, n, d), f["total"][:, :, None], out=dh[:b])
        less[:b] = _total(dh[:b] * f["seen"].reshape(b, n, d))
        dh, less, a = _with_next(dh), _with_next(less), f["a"]
        ds = dh @ f["v"].transpose(0, 2, 1)
        ds -= less[:, :, None]
        ds *= a
        g["away"] = np.bincount(np.maximum(_AWAY, 0).ravel(), (_columns(ds) * (_AWAY >= 0)).ravel(), CONTEXT).astype(p["away"].dtype)
        every = np.empty((b, n, 3 * d), dy.dtype)
        every[:, :, :d] = _met(ds @ f["k"])
        np.matmul(ds.transpose(0, 2, 1), f["q"], out=every[:, :, d : 2 * d])
        np.matmul(a.transpose(0, 2, 1), dh, out=every[:, :, 2 * d :])
        every = every.reshape(-1, 3 * d)
        moved = f["x"].T @ every
        moved[:, :d] *= moved.dtype.type(1 / np.sqrt(d))
        for i, w in enumerate(("query", "key", "value")):
            g[w] = moved[:, i * d : (i + 1) * d]
        dy += every @ self._inputs().T
        dy *= dy.dtype.type(1 / m)
        return float(loss / m), {k: v * v.dtype.type(1 / m) for k, v in g.items()}, dy

    def follow(self, texts: Iterator[tuple[Words, Blocks]], rate: float, batch: int = 64, seed: int = 13) -> tuple[np.ndarray, float]:
        """Adam over all of the texts, where each word is predicted once; how often each
        id was read, and the summed loss."""
        bw.keep_freed()
        draw = np.random.Generator(np.random.PCG64(seed))
        # All weights but the embeddings are views of one row.
        names = [k for k in self.p if k != "embed"]
        flat, at = np.concatenate([self.p[k].ravel() for k in names]), 0
        for k in names:
            v = self.p[k]
            self.p[k] = flat[at : at + v.size].reshape(v.shape)
            at += v.size
        mean, square = np.zeros_like(flat), np.zeros_like(flat)
        embed, size = self.p["embed"], len(self.p["embed"])
        own_square, met, count = np.zeros(size, np.float32), np.zeros(size, np.int64), np.zeros(size, np.int64)
        id_table = np.zeros(size, np.int64)
        total, i = 0.0, 0
        for words, whole in texts:
            target = self.of[words.anchor].take(whole.target)
            sizes = np.diff(words.first)
            table = np.zeros(len(sizes), np.int64)
            # Batches are runs of blocks, in any order: a run's first block has lost the one
            # before it. The first steps take small ones, so that short corpora have some.
            runs, lo = [], 0
            while lo < len(whole.begins):
                run = min(batch, 16 << (i + len(runs)) // 8)
                runs.append((lo, lo + run))
                lo += run
            for k in draw.permutation(len(runs)).tolist():
                lo, hi = runs[k]
                part = whole[lo:hi]
                number, inverse = _numbered(part.read.ravel(), table)
                ids = words.flat.take(_ragged(words.first.take(number), sizes.take(number)))
                of_word = np.repeat(np.arange(len(number)), sizes.take(number))
                vectors = words.summed(embed, number)
                i += 1
                loss, g, dx = self.step(vectors.take(inverse, axis=0).reshape(*part.read.shape, -1), part.begins, target[lo:hi], part.real)
                share = part.real.sum() / ((hi - lo) * STRIDE)  # a batch that isn't full moves the weights by its share only
                total += loss * part.real.sum()
                lr = np.float32(rate * min(1.0, i / 20) * share)
                d = np.concatenate([g[k].ravel() for k in names])
                mean += np.float32(0.1) * (d - mean)
                square += np.float32(0.01) * (d * d - square)
                flat -= lr * (mean / np.float32(1 - 0.9**i)) / (np.sqrt(square / np.float32(1 - 0.99**i)) + np.float32(1e-8))
                # Words' gradients, then those of their ids; one step size for an id's row.
                by_word = _sums(inverse, dx, len(number))
                own, place = _numbered(ids, id_table)
                d = _sums(place, by_word.take(of_word, axis=0), len(own))
                met[own] += 1
                own_square[own] = np.float32(0.95) * own_square[own] + np.float32(0.05) * (d * d).mean(axis=1)
                sure = (1 - 0.95 ** met[own]).astype(np.float32)
                embed[own] -= lr * d / (np.sqrt(own_square[own] / sure) + np.float32(1e-7))[:, None]
            count += np.bincount(words.flat, np.repeat(np.bincount(whole.read.ravel(), minlength=len(sizes)), sizes), size).astype(np.int64)
        return count, total

    def score(self, words: Words, whole: Blocks) -> np.ndarray:
        """log10 probability of the class of each place's word, where it is real."""
        bw.keep_freed()
        vectors = words.summed(self.p["embed"])
        target = self.of[words.anchor].take(whole.target)
        out = np.zeros(whole.read.shape)
        step = 512
        for lo in range(0, len(whole.begins), step):
            back = int(lo > 0)  # with the block before, whose places are known already
            part = whole[lo - back : lo + step]
            y = self._forward(vectors.take(part.read, axis=0), part.begins)["y"][back * STRIDE :]
            own = np.flatnonzero(part.real[back:].ravel())
            out[lo : lo + step].reshape(-1)[own] = self._log_probability(y.take(own, axis=0), target[lo : lo + step].ravel().take(own)) / np.log(10)
        return out[whole.real]


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = int(lengths.sum())
    return np.arange(total) + np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
