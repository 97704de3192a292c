"""N-gram Jaccard join by set relations.

A document's set is its distinct shingles of `width` words, as 64-bit hashes.  Documents of one set are one class and are
joined once.  Shingles have one global order, by how often their sketch bucket occurs in the corpus, rarest first; two sets
of Jaccard >= t share one of the first  n - ceil(t n) + 1  shingles of each (n: set size).  These prefixes are indexed:
every list holds (class, size, position), sorted by size.

Index skipping: a list is cut into blocks by size and, for each entry, whole blocks are skipped whose sizes cannot
reach t, and in the rest entries whose positions leave too little behind them.  Signatures: a set's signature holds the parity of its
shingles in each of about as many buckets as it has shingles; two sets differ by at least the bits that their signatures differ by, so
that stars of at most FEW members lose, before any set is moved, the members that cannot join any other.  Answer skipping: candidates form stars, a
centre and the classes that may join it; a class is compared with the centre once, and keeps what it has more and less
than the centre.  Members that join their centre are in one component, whatever they are to each other.  A member that does not join
meets the others, a block at a time, and is compared with those that are in no component with it yet; the intersection comes from
the two differences:  |y n z| = |x| - |x-y| - |x-z| + |(x-y) n (x-z)| + |(y-x) n (z-x)|.  So no pair within a group becomes a row, and
no link that matters to a component is lost.

Links become components by passing the smallest label along in rounds, each kept as a table.
Null, empty or wordless texts have empty sets and are linked with nothing.  Repeated rows of one doc_id are one document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WIDTH = 5
PERCENT = 80
INDEX_PART = 400_000  # index entries of a task
_LUT = C.lut_of("graph")
_ENTRY = np.dtype([("h", "<u8"), ("cls", "<i8"), ("size", "<i4"), ("pos", "<i4")])
BLOCK = 64
SKETCH_BITS = 22
FEW = 64  # members of a star whose signatures are compared with one another
STAR = 2048  # members of a star that a task holds at once


def sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle) of every text's set, by text and then by shingle."""
    n = len(offsets) - 1
    _, _, t, h = C.words(raw, offsets, _LUT)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    r = C.runs(h, width)
    at = np.flatnonzero(t[: len(r)] == t[width - 1 :][: len(r)]) if len(r) else np.zeros(0, np.int64)
    owner, value = t[at], r[at]
    count = np.bincount(t, minlength=n)
    first = np.r_[0, np.cumsum(count)[:-1]]
    for k in range(1, width):
        few = np.flatnonzero(count == k)
        if len(few):
            v = h[first[few]].copy()
            for j in range(1, k):
                v = C.mix(v + h[first[few] + j] * np.uint64(2 * j + 1))
            owner, value = np.r_[owner, few], np.r_[value, C.mix(v ^ np.uint64(k))]
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[keep], value[keep]


def _classes(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, class) of each text: the class is a hash of its set."""
    size = np.bincount(owner, minlength=n)
    total = np.zeros(n, np.uint64)
    if len(owner):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        total[owner[starts]] = np.add.reduceat(C.mix(value + np.uint64(0x9E37)), starts) ^ C.mix(np.bitwise_xor.reduceat(value, starts))
    return size, C.mix(total + size.astype(np.uint64)).view(np.int64)


def _each(batches: Iterator[pa.RecordBatch], width: int, most: int = C.SLICE_BYTES):
    for batch in batches:
        offsets, raw = C.buffers(C.text_column(batch, "text"))
        for a, b in C.slices(offsets, most):
            owner, value = sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
            yield batch, a, b, owner, value, *_classes(owner, value, b - a)


def _signatures(owner: np.ndarray, value: np.ndarray, size: np.ndarray) -> pa.Array:
    """Of each text's set, a bit per bucket of its shingles: whether their number is odd.  2**k buckets, 64 at least."""
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    base = np.r_[0, np.cumsum(bits)]
    at = base[owner] + (value & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(base[-1])) & 1).astype(np.uint8)
    offsets = pa.py_buffer((base // 8).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(size), [None, offsets, pa.py_buffer(np.packbits(odd, bitorder="little"))])


def _may_join(x: tuple[int, int, int], y: tuple[int, int, int], percent: int) -> bool:
    """Whether two sets, as (size, bits, signature), can reach percent: they differ by the bits at least that the signatures differ by."""
    (n, bits, a), (m, other, b) = x, y
    while bits > other:
        bits //= 2
        a = (a >> bits) ^ (a & ((1 << bits) - 1))
    while other > bits:
        other //= 2
        b = (b >> other) ^ (b & ((1 << other) - 1))
    return 100 * min(n, m) >= percent * max(n, m) and (100 + percent) * (a ^ b).bit_count() <= (100 - percent) * (n + m)


def _narrowed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Stars by what may join whom: of each star, rows (centre, cls, n, sig) one after another, the groups that may hold links."""
    out: list[tuple[int, int]] = []

    def split(star: list[tuple[int, tuple[int, int, int]]]) -> None:
        up = list(range(len(star)))

        def root(i: int) -> int:
            while up[i] != i:
                i = up[i]
            return i

        for i in range(len(star)):
            for j in range(i):
                a, b = root(i), root(j)
                if a != b and _may_join(star[i][1], star[j][1], percent):
                    up[max(a, b)] = min(a, b)
        out.extend((star[r][0], star[i][0]) for i in range(len(star)) if (r := root(i)) != i)

    def given() -> pa.RecordBatch:
        c, m = zip(*out, strict=True)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(m, pa.int64())], names=["centre", "member"])

    now, star = None, []
    for batch in batches:
        for centre, cls, n, sig in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if centre != now:
                split(star)
                now, star = centre, []
            star.append((cls, (n, 8 * len(sig), int.from_bytes(sig, "little"))))
        if out:
            yield given()
    split(star)
    if out:
        yield given()


def _rank(value: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The commonness of each shingle: its bucket's, in steps of a quarter of a power of 2."""
    return sketch[(value >> np.uint64(64 - int(len(sketch)).bit_length() + 1)).astype(np.int64)]


def _sketch(docs: DataFrame, width: int, bits: int) -> np.ndarray:
    """How common each of 2**bits buckets of shingles is over all documents: one byte each, so its size is fixed."""
    blocks = 64
    per = (1 << bits) // blocks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << bits, np.uint32)
        for *_, value, _, _ in _each(batches, width):
            n += np.bincount((value >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
        for k in range(blocks):
            own = n[k * per : (k + 1) * per]
            if own.any():
                kind = np.uint8 if own.max() < 256 else np.uint32
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(own.astype(kind).tobytes(), 1)], pa.binary())], names=["block", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = zlib.decompress(v)
                sums.setdefault(k, np.zeros(per, np.int64))
                sums[k] += np.frombuffer(n, np.uint8 if len(n) == per else np.uint32)
        for k, n in sums.items():
            level = np.ceil(np.log2(n + 1) * 4).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "v"])

    out = np.zeros(1 << bits, np.uint8)
    for k, v in docs.mapInArrow(count, "block int, v binary").repartition(blocks, "block").mapInArrow(add, "block int, v binary").collect():
        out[k * per : (k + 1) * per] = np.frombuffer(v, np.uint8)
    return out


def _entries(batches: Iterator[pa.RecordBatch], width: int, percent: int, sketch: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """doc rows (part -1: doc_id, size, cls) and prefix entries, packed by index part."""
    held: list[np.ndarray] = []
    n_held = 0

    def packed() -> Iterator[pa.RecordBatch]:
        e = np.concatenate(held)
        held.clear()
        # copies in a task are one entry
        e = e[np.unique(e[["h", "cls"]], return_index=True)[1]]
        part = (C.mix(e["h"]) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        e, part = e[order], part[order]
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        for a in range(0, len(edge) - 1, 256):
            rows = [(int(part[s]), e[s:t].tobytes()) for s, t in zip(edge[a:-1][:256], edge[a + 1 :][:256], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "v"])

    for _, a, b, owner, value, size, cls in _each(batches, width):
        if not len(owner):
            continue
        rank = _rank(value, sketch)
        order = np.lexsort((value, rank, owner))
        owner, value = owner[order], value[order]
        first = np.r_[0, np.cumsum(size)[:-1]]
        pos = np.arange(len(owner)) - first[owner]
        reach = size - -(-percent * size // 100) + 1
        keep = pos < reach[owner]
        e = np.empty(int(keep.sum()), _ENTRY)
        o = owner[keep]
        e["h"], e["cls"], e["size"], e["pos"] = value[keep], cls[o], size[o], pos[keep]
        held.append(e)
        n_held += len(e)
        if n_held > 1_000_000:
            yield from packed()
            n_held = 0
    if held:
        yield from packed()


def _stars(e: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(centre, member) over the lists of sorted entries; every pair that passes the filters is in some star."""
    edge = np.flatnonzero(np.r_[True, e["h"][1:] != e["h"][:-1], True])
    length = np.diff(edge)
    out_c, out_m = [], []
    # lists of two need no search
    two = edge[:-1][length == 2]
    out_c.append(two)
    out_m.append(two + 1)
    size, pos = e["size"].astype(np.int64), e["pos"].astype(np.int64)

    def passes(i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        need = -(-percent * (size[i] + size[j]) // (100 + percent))
        return (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])) & (1 + np.minimum(size[i] - pos[i] - 1, size[j] - pos[j] - 1) >= need)

    for s, n in zip(edge[:-1][length > 2].tolist(), length[length > 2].tolist(), strict=True):
        # which stars each entry is in already, as sets of centres
        inside: list[set[int]] = [set() for _ in range(n)]
        tops = size[s : s + n]
        least = 0
        for i in range(n):
            # sorted by size, largest first: blocks that end before the smallest partner of i
            end = int(np.searchsorted(-tops, -(-(-percent * tops[i] // 100)), side="right"))
            least = i + 1
            for a in range(least, end, BLOCK):
                j = np.arange(s + a, s + min(a + BLOCK, end))
                for m in (j[passes(s + i, j)] - s).tolist():
                    if inside[i].isdisjoint(inside[m]):
                        inside[i].add(i)
                        inside[m].add(i)
                        out_c.append([s + i])
                        out_m.append([s + m])
    c, m = (np.concatenate([np.asarray(x, np.int64) for x in y]) for y in (out_c, out_m))
    if len(two):
        ok = np.ones(len(c), bool)
        ok[: len(two)] = passes(c[: len(two)], m[: len(two)])
        c, m = c[ok], m[ok]
    return e["cls"][c], e["cls"][m]


def _lists(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    by: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for p, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(p, []).append(np.frombuffer(v, _ENTRY))
    for p in list(by):
        e = np.concatenate(by.pop(p))
        # shingles that occur once have no partner
        order = np.argsort(e["h"], kind="stable")
        h = e["h"][order]
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        same[:-1] |= same[1:]
        e = e[order[same]]
        if not len(e):
            continue
        e = e[np.unique(e[["h", "cls"]], return_index=True)[1]]
        e = e[np.lexsort((e["cls"], -e["size"], e["h"]))]
        c, m = _stars(e, percent)
        if len(c):
            pair = np.unique(np.stack([c, m], 1), axis=0)
            for a in range(0, len(pair), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(pair[a : a + 100_000, 0]), pa.array(pair[a : a + 100_000, 1])], names=["centre", "member"])


def _blob(v: pa.Array, i: int) -> np.ndarray:
    return np.frombuffer(v[i].as_buffer(), np.uint64)


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """What each member has less and more than its centre, and whether they join."""
    for batch in batches:
        less, more, joined, nx, ny = [], [], [], [], []
        for i in range(batch.num_rows):
            x, y = _blob(batch.column(2), i), _blob(batch.column(3), i)
            at = np.minimum(np.searchsorted(x, y), max(len(x) - 1, 0))
            same = x[at] == y
            both = int(same.sum())
            hit = np.zeros(len(x), bool)
            hit[at[same]] = True
            join = 100 * both >= percent * (len(x) + len(y) - both)
            joined.append(join)
            nx.append(len(x))
            ny.append(len(y))
            less.append(x[~hit].tobytes())
            more.append(y[~same].tobytes())
        kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(v, k) for v, k in zip((joined, nx, ny, less, more), kinds, strict=True)]], names=["centre", "member", "joined", "nx", "ny", "less", "more"])


class _Block:
    """Members of a star, whose centre joins some of them, and which of them are known to be in one component."""

    def __init__(self, percent: int):
        self.percent, self.rows, self.at, self.up, self.sizes = percent, [], {}, [], None

    def hold(self, member: int, joined: bool, nx: int, ny: int, less: np.ndarray, more: np.ndarray) -> None:
        self.at[member] = len(self.rows)
        self.rows.append((member, less, more))
        # 0 stands for the centre
        self.up.append(0 if joined else len(self.rows))
        self.nx = nx
        self.sizes = None
        self.ny = getattr(self, "ny", [])
        self.ny.append(ny)

    def root(self, i: int) -> int:
        while i and self.up[i - 1] != i:
            i = self.up[i - 1]
        return i

    def ask(self, member: int, ny: int, less: np.ndarray, more: np.ndarray) -> Iterator[int]:
        """Members that link with this one, without those that are in one component with it already."""
        if self.sizes is None:
            self.sizes = tuple(np.array(x) for x in zip(*((n, len(a), len(b)) for n, (_, a, b) in zip(self.ny, self.rows, strict=True)), strict=True)) if self.rows else (np.zeros(0),) * 3
        nz, lz, mz = self.sizes
        most = self.nx - len(less) - lz + np.minimum(len(less), lz) + np.minimum(len(more), mz)
        most = np.minimum(most, np.minimum(ny, nz))
        able = np.flatnonzero(100 * most >= self.percent * (ny + nz - most))
        mine = {self.root(self.at[member] + 1)} if member in self.at else set()
        for i in able[np.argsort(-most[able], kind="stable")].tolist():
            z, a, b = self.rows[i]
            r = self.root(i + 1)
            if z == member or r in mine:
                continue
            both = self.nx - len(less) - len(a) + len(np.intersect1d(less, a, True)) + len(np.intersect1d(more, b, True))
            if 100 * both >= self.percent * (ny + int(nz[i]) - both):
                mine.add(r)
                yield z
        first = min(mine, default=0)
        for r in mine:
            if r and r != first:
                self.up[r - 1] = first


def _derive(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of members of one star from their differences to its centre; rows come by (centre, block), held ones first."""
    block, key, out = None, None, []
    for batch in batches:
        names = batch.schema.names
        col = {n: batch.column(names.index(n)).to_pylist() for n in names if n not in ("less", "more")}
        less, more = batch.column(names.index("less")), batch.column(names.index("more"))
        for i in range(batch.num_rows):
            now = (col["centre"][i], col["block"][i])
            if now != key:
                block, key = _Block(percent), now
            if col["kind"][i] == 0:
                block.hold(col["member"][i], col["joined"][i], col["nx"][i], col["ny"][i], _blob(less, i).copy(), _blob(more, i).copy())
            elif block.rows:
                out += [(col["member"][i], z) for z in block.ask(col["member"][i], col["ny"][i], _blob(less, i), _blob(more, i))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], names=["a", "b"])
            out = []


def components(edges: DataFrame, least: DataFrame, rounds: int = 60) -> DataFrame:
    """(cls, component): the smallest `doc` over all classes reachable by edges (a, b).  least: (cls, doc).

    Every round an edge's end learns the smallest label among its neighbours, and then the label that its own
    label has by now; a chain halves with each round."""
    both = C.written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    nodes = both.select(F.col("a").alias("cls")).distinct()
    labels = C.written(nodes.join(least, "cls").select("cls", F.col("doc").alias("own"), F.col("doc").alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("cls").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "cls"), "cls", "left").select("cls", "own", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        # the label of the class that owns my label, and of my old label's owner the smallest that its members see
        hook = step.groupBy(F.col("old").alias("own")).agg(F.min("label").alias("hook"))
        hooked = step.join(hook, "own", "left").select("cls", "own", "old", F.least("label", F.coalesce("hook", "label")).alias("label"))
        hooked = C.written(hooked, "labels")
        jump = hooked.select(F.col("own").alias("label"), F.col("label").alias("jump"))
        new = C.written(hooked.join(jump, "label", "left").select("cls", "own", "old", F.least("label", F.coalesce("jump", "label")).alias("label")), "labels")
        moved = new.where("label <> old").limit(1).count()
        labels = new.select("cls", "own", "label")
        if not moved:
            return labels.select("cls", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")


def _narrow(stars: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """stars without what signatures rule out; those of more than FEW members as they are."""
    small = stars.groupBy("centre").agg(F.count("*").alias("n")).where(F.col("n") <= FEW).select("centre")
    ends = stars.join(small, "centre", "left_semi").select("centre", F.explode(F.array("centre", "member")).alias("cls")).distinct()
    signs = named.join(ends.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.max("n_shingles").alias("n"), F.first("sig").alias("sig"))
    met = ends.join(signs, "cls").select("centre", "cls", "n", "sig").repartition("centre").sortWithinPartitions("centre", "cls")
    few = met.mapInArrow(lambda it: _narrowed(it, percent), "centre long, member long")
    return few.unionByName(stars.join(small, "centre", "left_anti")).distinct()


def join(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n_shingles, cls, component_id of every document.  sketch_bits orders shingles, whatever it is the result is the same;
    buckets tell shingles apart that are more frequent than a few deviations of a bucket's load."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    got = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    sketch = docs.sparkSession.sparkContext.broadcast(_sketch(docs.select("text"), width, sketch_bits))
    parts = max(8, int(got[0] / 6 * (100 - percent) / 100 / INDEX_PART))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, owner, value, size, cls in _each(batches, width):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size.astype(np.int64)), pa.array(cls), _signatures(owner, value, size)], names=["doc_id", "n_shingles", "cls", "sig"])

    index = docs.select("text").mapInArrow(lambda it: _entries(it, width, percent, sketch.value, parts), "part int, v binary")
    stars = C.written(index.repartition(parts, "part").mapInArrow(lambda it: _lists(it, percent), "centre long, member long").distinct(), "stars")
    named = C.written(docs.mapInArrow(rows, "doc_id long, n_shingles long, cls long, sig binary"), "classes")
    stars = C.written(_narrow(stars, named, percent), "narrowed")
    first = named.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("doc"))
    # sets of one document of each class that stands in a star
    wanted = stars.select(F.explode(F.array("centre", "member")).alias("cls")).distinct()
    chosen = first.join(wanted, "cls").select(F.col("doc").alias("doc_id"), "cls")
    chosen = C.written(chosen, "chosen")
    filter_ = docs.sparkSession.sparkContext.broadcast(_bloom(chosen, "doc_id"))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some():
            for batch in batches:
                ids = batch.column(0)
                ok = _maybe(filter_.value, ids.fill_null(-1).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
                if ok.any():
                    yield batch.filter(pa.array(ok))

        for batch, a, b, owner, value, size, cls in _each(some(), width):
            edge = np.r_[0, np.cumsum(size)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(cls), pa.array([value[edge[k] : edge[k + 1]].tobytes() for k in range(b - a)], pa.binary())], names=["doc_id", "cls", "v"])

    # what the filter lets through by chance is of no star, or a copy
    of = docs.mapInArrow(full, "doc_id long, cls long, v binary").groupBy("cls").agg(F.first("v").alias("v"))
    pairs = stars.join(of.withColumnRenamed("cls", "member").withColumnRenamed("v", "vy"), "member").join(of.withColumnRenamed("cls", "centre").withColumnRenamed("v", "vx"), "centre")
    told = C.written(pairs.select("centre", "member", "vx", "vy").mapInArrow(lambda it: _compare(it, percent), "centre long, member long, joined boolean, nx long, ny long, less binary, more binary"), "told")
    links = told.where("joined").select(F.col("centre").alias("a"), F.col("member").alias("b"))
    # only stars with a member apart from the centre go on
    n = told.groupBy("centre").agg(F.count("*").alias("n"), F.max(~F.col("joined")).alias("some")).where("some and n > 1").select("centre", F.ceil(F.col("n") / STAR).cast("int").alias("blocks"))
    own = told.join(n, "centre")
    held = own.withColumn("block", F.pmod(F.xxhash64("member"), "blocks").cast("int")).withColumn("kind", F.lit(0))
    asks = own.where("not joined").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("kind", F.lit(1))
    cols = ["centre", "block", "kind", "member", "joined", "nx", "ny", "less", "more"]
    met = held.select(cols).unionByName(asks.select(cols)).repartition("centre", "block").sortWithinPartitions("centre", "block", "kind")
    more = met.mapInArrow(lambda it: _derive(it, percent), "a long, b long")
    found = components(links.unionByName(more), first)
    return named.join(found, "cls", "left").join(first, "cls", "left").groupBy("doc_id").agg(
        F.first("n_shingles").alias("n_shingles"),
        F.first("cls").alias("cls"),
        F.min(F.coalesce("component", "doc", "doc_id")).alias("component_id"),
    )


def _bloom(ids: DataFrame, col: str, bits_per: int = 12, most: int = 1 << 27) -> np.ndarray:
    """A Bloom filter of at most `most` bits, filled on the executors."""
    n = ids.count()
    m = 1 << int(min(np.log2(most), max(10, np.ceil(np.log2(max(n, 1) * bits_per)))))
    blocks = 16
    per = m // blocks

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(m, bool)
        for b in batches:
            for at in _places(b.column(0).to_numpy(), m):
                own[at] = True
        for k in range(blocks):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(own[k * per : (k + 1) * per]).tobytes()], pa.binary())], names=["block", "v"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(v, np.uint8)
                got[k] = got[k] | x if k in got else x
        for k, v in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["block", "v"])

    out = np.zeros(m // 8, np.uint8)
    for k, v in ids.select(col).mapInArrow(fill, "block int, v binary").repartition(blocks, "block").mapInArrow(either, "block int, v binary").collect():
        out[k * per // 8 : (k + 1) * per // 8] = np.frombuffer(v, np.uint8)
    return out


def _places(ids: np.ndarray, m: int) -> Iterator[np.ndarray]:
    h = C.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B9))
    for k in range(4):
        yield ((h >> np.uint64(16 * k % 37)) % np.uint64(m)).astype(np.int64)


def _maybe(filter_: np.ndarray, ids: np.ndarray) -> np.ndarray:
    ok = np.ones(len(ids), bool)
    for at in _places(ids, len(filter_) * 8):
        ok &= (filter_[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return ok


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The documents that are the smallest of their component, and those without a doc_id, with all their columns."""
    keep = join(docs, **how).where("doc_id <> component_id").select("doc_id")
    gone = C.written(keep, "gone")
    held = docs.sparkSession.sparkContext.broadcast(_bloom(gone, "doc_id"))

    def split(batches: Iterator[pa.RecordBatch], maybe: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            ok = _maybe(held.value, ids.fill_null(-1).cast(pa.int64()).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(ok == maybe))

    # only documents that the filter doubts are moved to meet the list of those that go
    sure = docs.mapInArrow(lambda it: split(it, False), docs.schema)
    doubt = docs.mapInArrow(lambda it: split(it, True), docs.schema)
    return sure.unionByName(doubt.join(gone, "doc_id", "left_anti").select(docs.columns))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT min(doc_id) AS class, list(doc_id) AS members FROM (SELECT doc_id, list(hash(g) ORDER BY hash(g)) AS k FROM s GROUP BY doc_id) GROUP BY k),
r AS (SELECT s.doc_id, g FROM s JOIN c ON s.doc_id = c.class),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * m >= 80 * (a.n + b.n - m)),
l AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
t AS (SELECT class AS d, class AS c FROM c UNION SELECT l.y, t.c FROM t JOIN l ON l.x = t.d)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(k.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT unnest(members) AS doc_id, m.c FROM c JOIN (SELECT d, min(c) AS c FROM t GROUP BY d) m ON c.class = m.d) k USING (doc_id)
"""
