"""Language-model scoring by logistic context mixing of bit predictors.

How a token's bits are predicted and mixed stands in `mixing`.  A token is coded after a state of the text before it: the cluster of
the guide word last met.  Guides are the most frequent short words of training texts (by 16 bits of a hash), and their clusters come from which guide follows
which, so that a state tells languages and ways of writing apart.  As a token's bits depend on the text before only through the
state, each distinct (state, word) is coded once, however often it occurs: pairs are counted over the corpus by a shuffle, of
any number, and bits are counted, learned and scored on pairs.

Counts of training pairs make tables of hashed contexts (of a fixed size, summed over tasks part by part).  A share of the training
texts, by a hash, stands back from the first table; weights, state maps and the adaptive map are learned on it, so that no text has
helped to count its own bits.  Then its counts join the table, and all pairs are scored.  Held-out texts are read only to be scored:
no guide, count, code or weight depends on them.

score is the log10 probability of the coded text (lower-cased words with a space after each, and an end), bits_per_byte
the same in bits over the coded bytes.  base_score is the unigram model of tokens with 0.1 added to each count.  Scores of at most
FREQUENT pairs are broadcast, under 64-bit hashes; all others meet their texts in a shuffled join of the words themselves.

Null texts are empty: one token, the end.  Rows of one id are scored each; null ids are training rows.  Without
training texts every bit has the probability that the untrained maps give.  Texts of any length are read whole, in stretches.  An empty
table gives no rows.  Columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import mixing as M

FREQUENT = 1 << 19  # pairs broadcast with their scores
GUIDES, SHORT = 512, 6  # guide words, told apart by BUCKETS values of their hash, and their most bytes
BUCKETS = 1 << 16
STATES, KINDS = 24, 12  # clusters of them, and clusters of those
PARTS = 64
PER_TASK = 1_500_000  # pairs whose bits one task counts
APART = 4  # one in so many training texts teaches the weights
STRETCH, PIECE = 400_000, 128_000  # bytes of text read at once, and of words whose bits are worked on
_GRAPH = C.lut_of("graph")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOBS = "kind int, part int, v binary"


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))


def _apart() -> F.Column:
    """Whether a training text stands back from the first table."""
    return F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(APART)) == 0


# ---- reading

@dataclass
class Tokens:
    """Words of some texts of a batch, or of a stretch of one."""

    first: int  # the first text's row in the batch
    n: int  # texts
    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  # of each word, from 0
    hash: np.ndarray
    guide: np.ndarray  # each word's value as a guide, or -1
    before: np.ndarray  # that of the guide last met before it in the text, or -1
    at_end: np.ndarray  # that of each text's last guide
    last: bool  # whether the texts end here

    def words(self, q: np.ndarray) -> pa.Array:
        """The words q, lower-cased."""
        size = self.end[q] - self.start[q]
        offsets = np.r_[0, np.cumsum(size)]
        at = np.arange(offsets[-1]) + np.repeat(self.start[q] - offsets[:-1], size)
        return pa.Array.from_buffers(pa.large_binary(), len(q), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[self.raw[at]])])


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def tokens(batch: pa.RecordBatch, guides: np.ndarray | None = None) -> Iterator[Tokens]:
    """guides: the value of each bucket of short words, -1 for none."""
    offsets, raw = C.buffers(C.text_column(batch, "text"))
    for a, b in C.slices(offsets, STRETCH):
        lo, hi, carried = int(offsets[a]), int(offsets[b]), -1
        while True:
            cut = hi
            if hi - lo > STRETCH:  # one text: up to white space
                cut = lo + STRETCH
                while cut < hi and _GRAPH[raw[cut]]:
                    gap = np.flatnonzero(_GRAPH[raw[cut : cut + STRETCH]] == 0)
                    cut += int(gap[0]) if len(gap) else len(raw[cut : min(hi, cut + STRETCH)])
                cut = min(cut, hi)
            own, off = raw[lo:cut], offsets[a : b + 1] - offsets[a] if cut - lo == offsets[b] - offsets[a] else np.array([0, cut - lo])
            start, end, text, h = C.words(own, off, _GRAPH)
            guide = np.full(len(h), -1, np.int64) if guides is None else np.where(end - start <= SHORT, guides[_bucket(h)], -1)
            before = M.last_before(guide, text, carried)
            at_end = np.full(b - a, -1, np.int64)
            at_end[0] = carried
            if len(h):
                q = np.r_[np.flatnonzero(np.diff(text)), len(text) - 1]
                at_end[text[q]] = np.where(guide[q] >= 0, guide[q], before[q])
            yield Tokens(a, b - a, own, start, end, text, h, guide, before, at_end, cut == hi)
            if cut == hi:
                break
            lo, carried = cut, int(at_end[0])


def hashes(words: pa.Array) -> np.ndarray:
    """The hash that each word has in a text; 0 for the empty one."""
    laid = M.Laid(words, np.zeros(len(words), np.int64), np.zeros(1, np.int64))
    out = np.zeros(len(words), np.uint64)
    _, _, text, h = C.words(laid.byte, np.r_[0, np.cumsum(laid.size)], _GRAPH)
    out[text] = h
    return out


def _key(h: np.ndarray, state: np.ndarray) -> np.ndarray:
    return C.mix(h + state.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal keys together, and where each group starts in it."""
    order = np.argsort(key)
    own = key[order]
    return order, np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(key)])


class Keys:
    """Places of sorted 64-bit keys, found through the top bits."""

    TOP = 20

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.start = np.searchsorted(keys >> np.uint64(64 - self.TOP), np.arange((1 << self.TOP) + 1).astype(np.uint64)).astype(np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """-1 where it isn't held."""
        top = (key >> np.uint64(64 - self.TOP)).astype(np.int64)
        at, end, out = self.start[top], self.start[top + 1], np.full(len(key), -1, np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.keys[at[left]] == key[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


class Pile:
    """Rows (key, state, word, counts) that are added up by key, and given out where they become many."""

    def __init__(self, names: list[str], most: int = 800_000):
        self.names, self.most, self.held, self.size = names, most, [], 0  # 32 bits hold what most rows count

    def add(self, key: np.ndarray, state: np.ndarray, words: Callable[[np.ndarray], pa.Array], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        order, first = _groups(key)
        at = order[first]
        one = key[at]
        self.held.append((one, state[at].astype(np.int16), words(at).cast(pa.binary()), *(np.add.reduceat(c[order], first, dtype=np.int32) for c in counts)))
        self.size += len(one)
        if self.size > self.most:
            self._merge()
            if self.size > self.most // 2:
                yield from self.out()

    def _merge(self) -> None:
        key, state, words, *counts = zip(*self.held, strict=True)
        key = np.concatenate(key)
        order, first = _groups(key)
        at = order[first]
        one = key[at]
        own = pa.concat_arrays(words).take(pa.array(at))
        self.held = [(one, np.concatenate(state)[at], own, *(np.add.reduceat(np.concatenate(c)[order], first, dtype=np.int32) for c in counts))]
        self.size = len(one)

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._merge()
            _, state, words, *counts = self.held[0]
            for a in range(0, len(state), 50_000):
                q = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(state[q], pa.int32()), words[q], *(pa.array(c[q].astype(np.int64)) for c in counts)], names=["s", "word", *self.names])
        self.held, self.size = [], 0


@C.trimmed
def _short_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the short words of a task, by bucket."""
    out = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for t in tokens(batch):
            out += np.bincount(_bucket(t.hash[t.end - t.start <= SHORT]), minlength=BUCKETS)
    at = np.flatnonzero(out)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["at", "c"])


def _pairs(batches: Iterator[pa.RecordBatch], guides: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of (state, word): of training texts, of those that stand apart, and of all."""
    pile = Pile(["ct", "cf", "t"])
    empty = pa.array([b""], pa.large_binary())
    for batch in batches:
        kind = batch.column(1).to_numpy()
        for t in tokens(batch, guides):
            k, s = kind[t.first + t.text], np.maximum(t.before, 0)
            yield from pile.add(_key(t.hash, s), s, t.words, [k == 0, k == 1, np.ones(len(k))])
            if t.last:
                k, s = kind[t.first : t.first + t.n], np.maximum(t.at_end, 0)
                yield from pile.add(_key(np.zeros(t.n, np.uint64), s), s, lambda at: empty.take(pa.array(np.zeros(len(at), np.int64))), [k == 0, k == 1, np.ones(len(k))])
    yield from pile.out()


# ---- the model

def _of_task(kind: int, blobs: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for part, v in blobs:
        yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([v], pa.binary())], names=["kind", "part", "v"])


def _laid(batches: Iterator[pa.RecordBatch], kinds: np.ndarray) -> Iterator[tuple[pa.RecordBatch, M.Laid]]:
    """Batches of (s, word, ...) in pieces of bounded size."""
    for batch in batches:
        offsets, _ = C.buffers(batch.column(1).cast(pa.large_binary()))
        for a, b in C.slices(offsets + np.arange(len(offsets)), PIECE):
            own = batch.slice(a, b - a)
            yield own, M.Laid(own.column(1), own.column(0).to_numpy(), kinds)


class Model:
    """Counts of the corpus and what was learned from them."""

    def __init__(self, docs: DataFrame, *, bits: tuple[int, ...] = M.BITS, frequent: int = FREQUENT):
        self.frequent = frequent
        kind = F.when(held_out(), 2).when(_apart(), 1).otherwise(0)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("kind", kind)
        train = self.docs.where("kind < 2").select("text")
        self.guides, self.kinds = self._guides(train)
        guides = self.guides
        raw = self.docs.select("text", "kind").mapInArrow(C.trimmed(lambda it: _pairs(it, guides)), "s int, word binary, ct long, cf long, t long")
        # by the word, so that its states meet: c is the token's count, lead marks one of its rows
        dealt = raw.repartition(F.col("word")).groupBy("word", "s").agg(*[F.sum(x).alias(x) for x in ("ct", "cf", "t")])
        by = "(partition by word)"
        full = dealt.selectExpr("s", "word", "ct", "cf", "t", f"sum(ct + cf) over {by} as c", f"s = min(s) over {by} as lead")
        pairs = C.written(full, "pairs")
        got = pairs.agg(F.coalesce(F.sum(F.expr("ct + cf")), F.lit(0)), F.count(F.when(F.expr("lead and c > 0"), 1)), F.count(F.when(F.expr("ct > 0"), 1)), F.count(F.when(F.expr("cf > 0"), 1))).first()
        self.tokens, self.vocabulary = int(got[0]), int(got[1])
        self.code, self.slots = M.Code(self._bytes(pairs)), M.Slots(bits)
        table = self._tables(pairs, (int(got[2]), int(got[3])))
        self.mixer = self._learn(pairs, table(0), int(got[3]))
        self.scored = self._score_pairs(pairs, table(1))
        C.removed(pairs, table.held)

    def _guides(self, train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The state of each bucket, -1 where it is no guide, and the kind of each state (of state 0, without a guide, 0)."""
        counted = train.mapInArrow(_short_words, "at long, c long").groupBy("at").agg(F.sum("c").alias("c"))
        rows = counted.orderBy(F.desc("c"), "at").limit(GUIDES).collect()
        ids, n = np.full(BUCKETS, -1, np.int64), len(rows)
        ids[[r.at for r in rows]] = np.arange(n)

        @C.trimmed
        def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(n * n, np.int64)
            for batch in batches:
                for t in tokens(batch, ids):
                    q = np.flatnonzero((t.guide >= 0) & (t.before >= 0))
                    out += np.bincount(t.before[q] * n + t.guide[q], minlength=n * n)
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["at", "c"])

        follows = np.zeros(n * n, np.int64)
        if not n:
            return ids, np.zeros(1, np.int64)
        for r in train.mapInArrow(follow, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).collect():  # at most GUIDES squared
            follows[r.at] = r.c
        follows = follows.reshape(n, n)
        state = M.clusters(follows, STATES)
        own = np.eye(STATES + 1, dtype=np.int64)[state]
        return np.where(ids >= 0, state[ids], -1), np.r_[0, M.clusters((own.T @ follows @ own)[1:, 1:], KINDS)]

    def _bytes(self, pairs: DataFrame) -> np.ndarray:
        """How often each byte stands behind each."""
        kinds = self.kinds

        @C.trimmed
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(1 << 16)
            for batch, laid in _laid(batches, kinds):
                out += np.bincount(laid.pair, np.repeat(batch.column(2).to_numpy(), laid.size), 1 << 16)
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at].astype(np.int64))], names=["at", "c"])

        out = np.zeros(1 << 16, np.int64)
        for r in pairs.where("ct + cf > 0").selectExpr("s", "word", "ct + cf as c").mapInArrow(run, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).collect():  # at most 65,536
            out[r.at] = r.c
        return out.reshape(256, 256)

    def _few(self, df: DataFrame, size: int) -> DataFrame:
        """df in few partitions: each task has a table of its own."""
        return df.coalesce(max(2, -(-size // PER_TASK)))  # a union puts single partitions into one

    def _tables(self, pairs: DataFrame, sizes: tuple[int, int]) -> Callable[[int], np.ndarray]:
        """The state table as a function of the kind: 0 without the texts that stand apart, 1 with them."""
        slots, code, kinds = self.slots, self.code, self.kinds
        total = 2 * int(slots.base[-1])
        per = -(-total // (2 * PARTS)) * 2

        def count(kind: int, group: tuple[int, ...]):
            @C.trimmed
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                counts = M.Counts(slots, code, group)
                for batch, laid in _laid(batches, kinds):
                    counts.add(laid, batch.column(2).to_numpy())
                yield from _of_task(kind, counts.parts(per))

            return run

        @C.trimmed
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for kind, p, v in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    own = sums.setdefault(p, [np.zeros(max(0, min((p + 1) * per, total) - p * per), np.int64) for _ in range(2)])
                    M.add_part(own[kind], v)
            for p, (first, more) in sums.items():
                yield from _of_task(0, [(p, M.states(first).tobytes())])
                first += more
                yield from _of_task(1, [(p, M.states(first).tobytes())])

        some = None
        for kind, (c, n) in enumerate(zip(("ct", "cf"), sizes, strict=True)):
            own = self._few(pairs.where(f"{c} > 0").selectExpr("s", "word", f"{c} as c"), n)
            for group in M.GROUPS:
                x = own.mapInArrow(count(kind, group), _BLOBS)
                some = x if some is None else some.unionByName(x)
        held = C.written(some.repartition(PARTS, "part").mapInArrow(add, _BLOBS), "states")

        def table(kind: int) -> np.ndarray:
            out = np.zeros(total // 2, np.uint16)
            for r in held.where(F.col("kind") == kind).select("part", "v").toLocalIterator():  # the table's own size, part by part
                out[r.part * per // 2 : r.part * per // 2 + len(r.v) // 2] = np.frombuffer(r.v, np.uint16)
            return out

        table.held = held
        return table

    def _learn(self, pairs: DataFrame, table: np.ndarray, size: int) -> M.Mixer:
        slots, code, kinds = self.slots, self.code, self.kinds
        held = pairs.sparkSession.sparkContext.broadcast(table)

        @C.trimmed
        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mixer = M.Mixer()
            for batch, laid in _laid(batches, kinds):
                times = batch.column(2).to_numpy().astype(float)
                for token, u, y, node in M.bits(laid, code, slots, held.value):
                    mixer.learn(u, y, node, times[token])
            if mixer.steps:
                yield from _of_task(0, [(mixer.steps % 16, pickle.dumps(mixer.learned()))])

        @C.trimmed
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = None
            for batch in batches:
                for v in batch.column(2).to_pylist():
                    got = M.add_learned(got, pickle.loads(v))
            if got:
                yield from _of_task(0, [(0, pickle.dumps(got))])

        # in an order that doesn't depend on anything but the pairs learned from
        h = F.xxhash64("word", "s")
        dealt = pairs.where("cf > 0").selectExpr("s", "word", "cf as c").repartition(max(1, -(-size // (PER_TASK // 2))), h).sortWithinPartitions(h, "word", "s")
        got = None
        for r in dealt.mapInArrow(learn, _BLOBS).repartition(4, "part").mapInArrow(add, _BLOBS).collect():  # at most four
            got = M.add_learned(got, pickle.loads(r.v))
        held.destroy()
        return M.Mixer.of(got)

    def _score_pairs(self, pairs: DataFrame, table: np.ndarray) -> DataFrame:
        """s, word, c, t and cost, in bits, of every pair."""
        slots, code, kinds = self.slots, self.code, self.kinds
        held = pairs.sparkSession.sparkContext.broadcast((table, self.mixer))

        @C.trimmed
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, mixer = held.value
            for batch, laid in _laid(batches, kinds):
                cost = np.zeros(batch.num_rows)
                for token, u, y, node in M.bits(laid, code, slots, table):
                    cost += np.bincount(token, mixer.cost(u, y, node), batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cost)], names=["s", "word", "c", "t", "cost"])

        out = C.written(pairs.select("s", "word", "c", "t").mapInArrow(run, "s int, word binary, c long, t long, cost double"), "scored")
        held.destroy()
        return out

    def score(self) -> DataFrame:
        sc = self.docs.sparkSession.sparkContext
        norm = float(np.log10(self.tokens + 0.1 * (self.vocabulary + 1)))
        # the lowest number of which all pairs are few enough to broadcast
        level = F.floor(F.log2("t") * 8)
        least, n = None, 0
        for lv, k in sorted(((r[0], r[1]) for r in self.scored.groupBy(level).count().collect()), reverse=True):
            n += k
            if n > self.frequent:
                break
            least = lv
        frequent = F.lit(False) if least is None else level >= F.lit(least)
        some = self.scored.where(frequent).select("s", "word", "c", "cost").toArrow().combine_chunks()
        words = pa.concat_arrays(some.column(1).chunks) if some.num_rows else pa.array([], pa.binary())
        key = _key(hashes(words), some.column(0).to_numpy())
        order = np.argsort(key, kind="stable")
        held = sc.broadcast((Keys(key[order]), some.column(2).to_numpy()[order], some.column(3).to_numpy()[order]))
        tokens_, guides = self.tokens, self.guides

        @C.trimmed
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, count, price = held.value
            worth, known = np.log10(count + 0.1) - norm, count > 0
            empty = pa.array([b""], pa.large_binary())
            for batch in batches:
                n = batch.num_rows
                sums = {k: np.zeros(n, np.int64) for k in ("n_tokens", "n_bytes", "n_known")} | {k: np.zeros(n) for k in ("base", "cost")}
                rare: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

                def take(t: Tokens, text: np.ndarray, h: np.ndarray, s: np.ndarray, size: np.ndarray, words: Callable[[np.ndarray], pa.Array]) -> None:
                    own = slice(t.first, t.first + t.n)
                    sum_ = lambda name, v: np.add(sums[name][own], np.bincount(text, v, t.n), out=sums[name][own], casting="unsafe")
                    sum_("n_tokens", np.ones(len(h)))
                    sum_("n_bytes", size + 1)
                    key = _key(h, s)
                    at = keys.find(key)
                    met = at >= 0
                    one = np.maximum(at, 0)
                    if len(count):
                        sum_("n_known", known[one] & met)
                        sum_("base", worth[one] * met)
                        sum_("cost", price[one] * met)
                    miss = np.flatnonzero(~met)
                    if len(miss):
                        rare.append((text[miss] + t.first, s[miss], words(miss)))

                for t in tokens(batch, guides):
                    take(t, t.text, t.hash, np.maximum(t.before, 0), t.end - t.start, t.words)
                    if t.last:
                        take(t, np.arange(t.n), np.zeros(t.n, np.uint64), np.maximum(t.at_end, 0), np.zeros(t.n), lambda q: empty.take(pa.array(np.zeros(len(q), np.int64))))
                text, s, words = zip(*rare, strict=True) if rare else ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [pa.array([], pa.large_binary())])
                text = np.concatenate(text)
                order = np.argsort(text, kind="stable")
                cut = np.searchsorted(text[order], np.arange(n + 1))
                fields = [pa.array(np.concatenate(s)[order], pa.int32()), pa.concat_arrays(words).take(pa.array(order)).cast(pa.binary())]
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(fields, ["s", "word"]))
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums.values()), lists], names=["doc_id", *sums, "rare"])

        schema = "doc_id long, n_tokens long, n_bytes long, n_known long, base double, cost double, rare array<struct<s: int, word: binary>>"
        part = C.written(self.docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), "scores")
        rare = part.select("_row", F.explode("rare").alias("r")).select("_row", "r.s", "r.word")
        met = rare.join(self.scored.where(~frequent), ["word", "s"]).groupBy("_row").agg(
            F.count(F.when(F.col("c") > 0, 1)).alias("_known"),
            F.sum(F.log10(F.col("c") + F.lit(0.1)) - F.lit(norm)).alias("_base"),
            F.sum("cost").alias("_cost"),
        )
        cost = F.col("cost") + F.coalesce("_cost", F.lit(0.0))
        return part.drop("rare").join(met, "_row", "left").select(
            "doc_id",
            held_out().alias("held_out"),
            "n_tokens",
            (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
            F.lit(tokens_).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
            (-cost * F.lit(float(np.log10(2.0)))).alias("score"),
            (cost / F.col("n_bytes")).alias("bits_per_byte"),
        )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Model(spark.read.parquet(f"{sf_dir}/documents.parquet")).score()
