"""Bit predictors over hashed contexts, and their logistic mixing.

A token, a word or the empty one that ends a text, is coded after a state of the text before it, which also has a kind, of which there
are fewer.  It is written as its bytes and a space, each byte in a prefix code that the byte before it chooses, and every bit is predicted from seven
contexts: the last 3 and 4 bytes of the word, these with the kind, the word so far, that with the kind, and that with the state.

A context's slot holds how often the bit was 0 and 1 in training texts, each count in a byte (exact to 31, then in eighths of
an octave).  An adaptive state map per predictor gives the probability that such a pair of counts really stands for; the
stretched probabilities are mixed by weights, which are chosen by a gate (how much evidence three of the contexts have)
and learned online, batch by batch, by Newton steps; and an adaptive map by the bits seen of the byte refines the mix.

Everything works on arrays of all bits of some tokens.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

from . import common as C

U64 = np.uint64
BATCH = 1 << 15  # bytes whose bits are worked on at once, and of a step of learning
ORDERS = (3, 4)
PREDICTORS = 2 * len(ORDERS) + 3
INPUTS = PREDICTORS + 1  # and a constant
BITS = (20, 22, 21, 22, 22, 22, 22)  # log2 of the slots of each
GROUPS = ((0, 1, 2), (3, 4), (5, 6))  # predictors whose counts one task holds, 64 MB at most
GATES, STEPS, STATES = 64, 33, 1 << 16
_A, _B = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


# ---- layout

class Laid:
    """Bytes of tokens, each with its final space, and the contexts of every byte."""

    def __init__(self, words: pa.Array, state: np.ndarray, kinds: np.ndarray):
        """kinds: of each state."""
        offsets, raw = C.buffers(words.cast(pa.large_binary()))
        n = len(offsets) - 1
        self.start = offsets + np.arange(n + 1)
        self.size = np.diff(self.start)
        self.byte = np.full(int(self.start[-1]), 32, np.uint8)
        inside = np.ones(len(self.byte), bool)
        inside[self.start[1:] - 1] = False
        self.byte[inside] = raw
        self.token = np.repeat(np.arange(n), self.size)
        self.state, self.kind = state, kinds[state]

    @cached_property
    def place(self) -> np.ndarray:
        return np.arange(len(self.byte)) - np.repeat(self.start[:-1], self.size)

    @cached_property
    def pair(self) -> np.ndarray:
        """Each byte with the one before it, which is a space at a word's start."""
        before = np.full(len(self.byte), 32, np.int64)
        before[1:] = self.byte[:-1]
        return before * 256 + self.byte

    @cached_property
    def _last(self) -> dict[int, np.ndarray]:
        """Hashes of the last bytes, by their number."""
        key, out = np.zeros(len(self.byte), U64), {}
        for j in range(1, ORDERS[-1] + 1):
            before = np.full(len(self.byte), 32, np.uint8)
            before[j:] = self.byte[:-j]
            before[self.place < j] = 32
            key |= before.astype(U64) << U64(8 * j)
            if j in ORDERS:
                out[j] = C.mix((key + U64(j)) * _A)
        return out

    @cached_property
    def _so_far(self) -> np.ndarray:
        """Hashes of the word so far."""
        n, first = len(self.byte), np.repeat(self.start[:-1], self.size)
        pw, back = C.powers(n)
        sums = np.zeros(n + 1, U64)
        np.cumsum((self.byte.astype(U64) + U64(1)) * pw[:n], out=sums[1:], dtype=U64)
        return C.mix(((sums[:-1] - sums[first]) * pw[len(pw) - 1 - first] * U64(back)) ^ (self.place.astype(U64) * _A))

    def context(self, i: int) -> np.ndarray:
        """The context hash of predictor i at every byte, as a number of 32 bits."""
        if i not in self.__dict__.setdefault("_held", {}):
            k = len(ORDERS)
            h = self._last[ORDERS[i % k]] if i < 2 * k else self._so_far
            if i >= k and i != 2 * k:
                beside = (self.state if i == PREDICTORS - 1 else self.kind).astype(U64) + U64(1)
                h = C.mix(h + np.repeat(beside * (_A if i == PREDICTORS - 1 else _B), self.size))
            self._held[i] = (h >> U64(32)).astype(np.int64)
        return self._held[i]


# ---- bits

def _huffman(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """(node, bit) of each symbol's path."""
    heap = [(int(c) * 256 + 1, b) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    child = []
    while len(heap) > 1:
        (c, x), (d, y) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (c + d, 256 + len(child)))
        child.append((x, y))
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256 + len(child))]
    for node in range(len(child) - 1, -1, -1):
        for bit in (0, 1):
            paths[child[node][bit]] = [*paths[256 + node], (node, bit)]
    return paths[:256]


class Code:
    """A prefix code of bytes for each byte before: Huffman's, of their counts behind it."""

    def __init__(self, counts: np.ndarray):
        seen = counts.any(1)
        rare = _huffman(counts.sum(0))
        paths = [p for b in range(256) for p in (_huffman(counts[b]) if seen[b] else rare)]
        self.length = np.array([len(p) for p in paths], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.node = np.array([x for p in paths for x, _ in p], np.uint8)  # the bits seen of the byte
        self.bit = np.array([x for p in paths for _, x in p], np.uint8)

    def spell(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of bytes behind bytes: how many bits each has; node, its part of the slots' hash, and bit of all of them."""
        n = self.length[pair]
        j = np.arange(int(n.sum())) + np.repeat(self.at[pair] - np.cumsum(n) + n, n)
        node = self.node[j].astype(np.int64)
        return n, node, _STEP[node], self.bit[j].astype(np.int64)


_STEP = (np.arange(256) * 0x9E3779B1) & 0xFFFFFFFF


@dataclass(frozen=True)
class Slots:
    """Where a table keeps the bits of a context."""

    bits: tuple[int, ...] = BITS

    @property
    def base(self) -> np.ndarray:
        return np.r_[0, np.cumsum([1 << b for b in self.bits])].astype(np.int64)

    def of(self, i: int, context: np.ndarray, n: np.ndarray, step: np.ndarray) -> np.ndarray:
        h = np.repeat(context, n)
        h += step
        h &= (1 << self.bits[i]) - 1
        h += int(self.base[i])
        return h


def batches(laid: Laid) -> Iterator[slice]:
    for a in range(0, len(laid.byte), BATCH):
        yield slice(a, a + BATCH)


class Counts:
    """Pairs of counts by slot, of some predictors: 32 bits each, and what is too much for that."""

    MOST = 1 << 30

    def __init__(self, slots: Slots, code: Code, predictors: tuple[int, ...]):
        self.slots, self.code, self.predictors = slots, code, predictors
        self.first = 2 * int(slots.base[predictors[0]])
        self.table = np.zeros(2 * int(slots.base[predictors[-1] + 1]) - self.first, np.uint32)
        self.over: list[np.ndarray] = []

    def add(self, laid: Laid, count: np.ndarray) -> None:
        """count: of each token."""
        for q in batches(laid):
            n, _, step, bit = self.code.spell(laid.pair[q])
            times = np.repeat(count[laid.token[q]], n)
            much = times > self.MOST // BATCH
            some = np.where(much, 0, times).astype(np.uint32)
            for i in self.predictors:
                at = self.slots.of(i, laid.context(i)[q], n, step)
                at *= 2
                at += bit - self.first
                if much.any():
                    self.over.append(np.stack([at[much], times[much]]))
                np.add.at(self.table, at, some)
                now = np.take(self.table, at)
                if now.max(initial=0) > self.MOST:
                    high = np.unique(at[now > self.MOST])
                    self.over.append(np.stack([high, self.table[high].astype(np.int64)]))
                    self.table[high] = 0

    def parts(self, per: int) -> Iterator[tuple[int, bytes]]:
        """(number, compressed counts) of the parts of a whole table, `per` counts each, that these lie in."""
        over = np.concatenate(self.over, 1) if self.over else np.zeros((2, 0), np.int64)
        for p in range(self.first // per, -(-(self.first + len(self.table)) // per)):
            a, b = max(0, p * per - self.first), min(len(self.table), (p + 1) * per - self.first)
            own = self.table[a:b]
            held = own > 0
            n = own[held]
            big = n > 254
            high = over[:, (over[0] >= a) & (over[0] < b)] - np.array([[a], [0]])
            if len(n) or high.size:
                yield p, zlib.compress(pickle.dumps((a + self.first - p * per, b - a, np.packbits(held), np.where(big, 255, n).astype(np.uint8), n[big], high)), 1)


def add_part(sums: np.ndarray, part: bytes) -> None:
    """Adds a compressed part to int64 counts."""
    at, size, held, n, big, high = pickle.loads(zlib.decompress(part))
    own = sums[at : at + size]
    n = n.astype(np.int64)
    n[n == 255] = big
    own[np.flatnonzero(np.unpackbits(held, count=size))] += n
    np.add.at(own, high[0], high[1])


# ---- states: a pair of counts, a byte each

def _sizes() -> np.ndarray:
    q = np.arange(256)
    return np.where(q < 32, q, np.rint(32 * 2.0 ** ((q - 32) / 8))).astype(np.float64)


SIZE = _sizes()


def level(n: np.ndarray) -> np.ndarray:
    """The byte of a count."""
    n = np.asarray(n)
    return np.where(n < 32, n, 32 + np.rint(8 * np.log2(np.maximum(n, 32) / 32)).clip(0, 223)).astype(np.uint8)


def states(table: np.ndarray) -> np.ndarray:
    """Pairs of counts as 16-bit states."""
    q = level(table)
    return (q[0::2].astype(np.uint16) << 8) | q[1::2]


_N = SIZE[np.arange(STATES) >> 8] + SIZE[np.arange(STATES) & 255]
EVIDENCE = np.digitize(_N, [1, 3, 16]).astype(np.int64)
_PRIOR = (SIZE[np.arange(STATES) & 255] + 0.4) / (_N + 0.8)
_STRONG = 6.0  # what the formula counts for beside what was seen


# ---- mixing

class Mixer:
    """State maps, weights by gate with the curvature of what they were learned from, and the adaptive map."""

    _START = (np.tile(20 / (1 + np.exp(-np.linspace(-8, 8, STEPS))), (255, 1)), np.full((255, STEPS), 20.0))

    def __init__(self) -> None:
        self.w = np.full((GATES, INPUTS), 0.25)
        self.w[:, -1] = 0
        self.h = np.tile(np.eye(INPUTS) * 2.0, (GATES, 1, 1))
        self.hit, self.all = np.zeros((PREDICTORS, STATES)), np.zeros((PREDICTORS, STATES))
        self.map_hit, self.map_all = (x.copy() for x in self._START)
        self.steps = 0
        self.refresh()

    def refresh(self) -> None:
        p = (self.hit + _STRONG * _PRIOR) / (self.all + _STRONG)
        self.stretch = np.log(p / (1 - p)).astype(np.float32)

    def inputs(self, u: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(inputs, gate) of the bits of states u, one array per predictor."""
        x = np.empty((INPUTS, len(u[0])), np.float32)
        for i in range(PREDICTORS):
            np.take(self.stretch[i], u[i], out=x[i], mode="clip")
        x[-1] = 0.3
        return x, np.take(EVIDENCE, u[-3]) * 16 + np.take(EVIDENCE, u[-2]) * 4 + np.take(EVIDENCE, u[-1])

    def mix(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        w = self.w.astype(np.float32).T.copy()
        z = np.take(w[-1], gate) * np.float32(0.3)
        for i in range(PREDICTORS):
            t = np.take(w[i], gate)
            t *= x[i]
            z += t
        return np.clip(z, -14, 14, out=z)

    def learn(self, u: list[np.ndarray], y: np.ndarray, node: np.ndarray, times: np.ndarray) -> None:
        """One step: bits y, each so many times, after states u that don't hold them."""
        x, gate = self.inputs(u)
        z = self.mix(x, gate)
        p = 1 / (1 + np.exp(-z))
        hit = y * times
        at = node * STEPS + np.rint((np.clip(z, -8, 8) + 8) * ((STEPS - 1) / 16)).astype(np.int64)
        self.map_all += np.bincount(at, times, 255 * STEPS).reshape(255, STEPS)
        self.map_hit += np.bincount(at, hit, 255 * STEPS).reshape(255, STEPS)
        for i in range(PREDICTORS):
            np.add.at(self.all[i], u[i], times)
            np.add.at(self.hit[i], u[i], hit)
        order = np.argsort(gate.astype(np.uint8), kind="stable")
        cut = np.searchsorted(gate[order], np.arange(GATES + 1))
        x, e, s = x[:, order].astype(np.float64), ((y - p) * times)[order], (p * (1 - p) * times)[order]
        for g in np.flatnonzero(np.diff(cut)):
            own = slice(cut[g], cut[g + 1])
            self.h[g] += (x[:, own] * s[own]) @ x[:, own].T
            self.w[g] += np.clip(np.linalg.solve(self.h[g], x[:, own] @ e[own]), -0.3, 0.3)
        self.steps += 1
        if self.steps & (self.steps - 1) == 0 or self.steps % 16 == 0:
            self.refresh()

    def cost(self, u: list[np.ndarray], y: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Minus the log2 probability of each bit."""
        z = self.mix(*self.inputs(u))
        at = (np.clip(z, -8, 8) + 8) * ((STEPS - 1) / 16)
        low = np.minimum(at.astype(np.int64), STEPS - 2)
        at -= low
        refined = self.refined.astype(np.float32).reshape(-1)
        low += node * STEPS
        p = np.take(refined, low) * (1 - at) + np.take(refined, low + 1) * at
        p += 1 / (1 + np.exp(-z))
        p *= 0.5
        np.clip(p, 1e-6, 1 - 1e-6, out=p)
        return -np.log2(np.abs((1 - y).astype(np.float32) - p))

    def learned(self) -> tuple:
        """What can be added to what other tasks learned: weights times curvature, and all counts."""
        start = Mixer._START
        maps = [np.flatnonzero(self.all), self.all[self.all > 0], self.hit[self.all > 0]]
        return np.einsum("gij,gj->gi", self.h, self.w), self.h, self.map_hit - start[0], self.map_all - start[1], maps

    @classmethod
    def of(cls, got: tuple | None) -> Mixer:
        """The mixer of what tasks have learned: each gate's weights are the mean by the curvature behind them."""
        out = cls()
        if got:
            hw, h, hit, all_, (at, n, k) = got
            out.w = np.linalg.solve(h, hw[:, :, None])[:, :, 0]
            out.map_hit += hit
            out.map_all += all_
            np.add.at(out.all.reshape(-1), at, n)
            np.add.at(out.hit.reshape(-1), at, k)
            out.refresh()
        out.h = out.all = out.hit = None  # all that scoring needs is in the weights and maps
        return out

    @property
    def refined(self) -> np.ndarray:
        return self.map_hit / self.map_all


def add_learned(a: tuple | None, b: tuple) -> tuple:
    if a is None:
        return b
    at = np.concatenate([a[4][0], b[4][0]])
    maps = np.unique(at, return_inverse=True)
    sums = [np.bincount(maps[1], np.concatenate([a[4][k], b[4][k]]), len(maps[0])) for k in (1, 2)]
    return *(x + y for x, y in zip(a[:4], b[:4], strict=True)), [maps[0], *sums]


def bits(laid: Laid, code: Code, slots: Slots, table: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Per batch: the token of each bit, its states, the bits and their nodes."""
    for q in batches(laid):
        n, node, step, bit = code.spell(laid.pair[q])
        u = [np.take(table, slots.of(i, laid.context(i)[q], n, step)).astype(np.int64) for i in range(PREDICTORS)]
        yield np.repeat(laid.token[q], n), u, bit, node


# ---- states of a text

def clusters(follows: np.ndarray, k: int) -> np.ndarray:
    """A cluster, from 1 to k, of each guide; follows[i, j]: how often guide j was the next one after guide i.

    Guides are alike where the same ones stand around them; centres start at the commonest and at those farthest from all
    others, and move to their clusters' means."""
    n = len(follows)
    around = (follows + follows.T).astype(float)
    weight = np.sqrt(around.sum(1))
    x = np.sqrt(around / np.maximum(around.sum(1, keepdims=True), 1))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    k = min(k, n)
    if not k:
        return np.zeros(0, np.int64)
    centre = [int(weight.argmax())]
    near = x @ x[centre[0]]
    while len(centre) < k:
        centre.append(int(((1 - near) * weight).argmax()))
        near = np.maximum(near, x @ x[centre[-1]])
    m = x[centre]
    for _ in range(30):
        own = (x @ m.T).argmax(1)
        for c in range(k):
            v = (x[own == c] * weight[own == c, None]).sum(0)
            if v.any():
                m[c] = v / np.linalg.norm(v)
    return own + 1


def last_before(guide: np.ndarray, text: np.ndarray, carried: int) -> np.ndarray:
    """Of each token, the guide (or -1) last met before it in its text; carried: the first text's from before."""
    n = len(guide)
    at = np.full(n, -1, np.int64)
    np.maximum.accumulate(np.where(guide >= 0, np.arange(n), -1)[:-1], out=at[1:])
    size = np.bincount(text)
    first = np.repeat(np.cumsum(size) - size, size)
    out = np.where(at >= first, guide[at], -1)
    if carried >= 0 and n:
        out[(text == text[0]) & (at < first)] = carried
    return out
