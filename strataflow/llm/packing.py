"""Best-fit packing with certified bin counts.

Documents become token ids and an end id; only longer ones than a sequence are cut, and then the first piece
is the short one, so a document has at most one piece that is no full sequence.  Pieces are dealt to
partitions of a bounded size and packed by best-fit decreasing.  Each partition bounds its bin count from
below by dual feasible functions over its histogram of lengths; a partition whose count meets the bound is
certified.  Partitions with a gap give up the worse filled part of their bins, certified ones only the
few worst filled ones (what rounding up left over); neighbours pool them and run best-fit decreasing again, and the new
packing stands where it saves bins.  This is repeated over wider neighbourhoods until the whole corpus
meets its own bound or a round saves nothing.  Only histograms of lengths and counts reach the driver.

Null text: empty, one piece of one end id.  Null and repeated ids are packed as often as they occur.  Texts of any length,
also of one word or of white space alone, are encoded whole.  An added token's text stands for that token, as the library has it.
Empty tables give no rows.  Columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LENGTH = 2048
PART = 100_000  # pieces that one task packs
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", sequence_id long, offset long, open boolean"
#: the split of byte-level vocabularies before merging, as the tokenizers library has it
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: characters on whose class two regex engines might differ
_RARE = "[^\x00-\u04ff\u2010-\u2027\u20ac]"
BLANKS = 1000


class Encoder:
    """Token ids of the tokenizers library as little-endian 32-bit bytes.

    Texts of common scripts are merged by tiktoken over the same vocabulary, which gives the same ids in
    less than half the time.  A text with a rarer character, an added token or a run of more than BLANKS white-space
    characters (which exhausts the other library's stack) goes to the tokenizers library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {x.content for x in self.tokenizer.get_added_tokens_decoder().values()}
        own = "|".join(re.escape(x) for x in sorted(added))
        self.slow = re.compile(rf"{_RARE}|\s{{{BLANKS},}}" + (f"|{own}" if own else ""))
        # the printable stand-ins of bytes: themselves where printable, else from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        ranks = {bytes(byte[c] for c in k): v for k, v in self.tokenizer.get_vocab(with_added_tokens=True).items() if k not in added}
        self.fast = tiktoken.Encoding(path, pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", self.tokenizer.encode(x, add_special_tokens=False).ids if self.slow.search(x) else self.fast.encode_ordinary(x)).tobytes() for x in texts]


_encoder: dict[str, Encoder] = {}


def pieces_of(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    if n <= length:
        return [(0, n)]
    head = n % length
    cuts = ([0] if head else []) + list(range(head, n, length))
    return [(a, b - a) for a, b in zip(cuts, [*cuts[1:], n], strict=True)]


def pieces(docs: DataFrame, tokenizer: str, end: int = 0, length: int = LENGTH) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoder:
            _encoder[tokenizer] = Encoder(tokenizer)
        encoder, last = _encoder[tokenizer], np.array([end], "<u4").tobytes()
        for batch in batches:
            col = C.text_column(batch, "text")
            offsets, _ = C.buffers(col)
            ids = batch.column(0).to_pylist()
            for a, b in C.slices(offsets, 1_000_000):
                rows = []
                for doc, own in zip(ids[a:b], encoder.encode(col.slice(a, b - a).to_pylist()), strict=True):
                    own += last
                    for k, (s, n) in enumerate(pieces_of(len(own) // 4, length)):
                        rows.append((doc, k, s, n, zlib.crc32(own[4 * s : 4 * (s + n)])))
                doc, k, s, n, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECES)


def lower_bound(hist: np.ndarray) -> int:
    """Bins that any packing needs; hist[w]: items of size w, of 0 .. capacity.

    The best of the functions f_e (items over capacity - e count whole, those under e not at all) for each
    e up to half, and u_k (rounding in steps of 1 / k) after f_e, for small k.
    """
    cap = len(hist) - 1
    w = np.arange(cap + 1, dtype=np.int64)
    hist = hist.astype(np.int64)
    count, size = np.cumsum(hist), np.cumsum(hist * w)
    e = np.arange(0, cap // 2 + 1)
    below = np.where(e > 0, size[np.maximum(e - 1, 0)], 0)
    whole = count[-1] - count[cap - e]
    best = int((-(-(whole * cap + size[cap - e] - below) // cap)).max())
    for k in range(1, 21):
        up, exact = (k + 1) * w // cap, (k + 1) * w % cap == 0
        # in units of 1 / (k * cap)
        u = np.where(exact, w * k, up * cap)
        best = max(best, -(-int((hist * u).sum()) // (k * cap)))
    return best


def best_fit(lengths: np.ndarray, cap: int) -> np.ndarray:
    """The bin of each item, by best-fit decreasing; ties go to the bin opened or filled last."""
    order = np.argsort(-lengths, kind="stable")
    out = np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(cap + 1)]
    mask, bins = 0, 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        free = mask >> n
        if free:
            r = n + (free & -free).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
            r -= n
        else:
            b, r = bins, cap - n
            bins += 1
        out[i] = b
        if r:
            if not room[r]:
                mask |= 1 << r
            room[r].append(b)
    return out


def _pack_rows(t: pa.Table, round_: int, part: int, cap: int) -> pa.Table:
    """One partition's rows with sequence_id, offset and open (whether the next round may take the row)."""
    lengths = t.column("length").to_numpy()
    bins = best_fit(lengths, cap)
    n = int(bins.max()) + 1
    if "sequence_id" in t.column_names:
        old = len(np.unique(t.column("sequence_id").to_numpy()))
        if n >= old:
            return t
    fill = np.bincount(bins, lengths, n)
    gap = n - lower_bound(np.bincount(lengths, minlength=cap + 1))
    # what is given up: a quarter of the bins, the worst filled, where a gap is; else the few that rounding left
    k = min(n, max(16, n // 4) if gap else 4)
    worst = np.zeros(n, bool)
    worst[np.argsort(fill, kind="stable")[:k]] = True
    worst &= fill < cap
    order = np.lexsort((t.column("start").to_numpy(), bins))
    at = np.zeros(len(bins), np.int64)
    sums = np.cumsum(lengths[order]) - lengths[order]
    first = np.r_[True, bins[order][1:] != bins[order][:-1]]
    at[order] = sums - np.repeat(sums[first], np.diff(np.r_[np.flatnonzero(first), len(order)]))
    seq = ((round_ << 24 | part) << 32) + bins
    own = t.select(["doc_id", "piece", "start", "length", "ids_crc32"])
    return own.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(at)).append_column("open", pa.array(worst[bins]))


def _pack(df: DataFrame, round_: int, cap: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)  # about PART narrow rows
        if sum(b.num_rows for b in own):
            yield from _pack_rows(pa.Table.from_batches(own), round_, TaskContext.get().partitionId(), cap).to_batches()

    return df.mapInArrow(run, _PACKED)


def pack(rows: DataFrame, *, length: int = LENGTH, part: int = PART, rounds: int = 4) -> DataFrame:
    """Pieces with sequence_id and offset."""
    rows = C.written(rows, "pieces")
    hist = np.zeros(length + 1, np.int64)
    for n, c in rows.groupBy("length").count().collect():  # at most `length` rows
        hist[n] = c
    total = int(hist.sum())
    if not total:
        return rows.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    least = lower_bound(hist)
    full = rows.where(F.col("length") == length)
    # a full sequence needs no search; it is numbered by its document and piece where it lies
    loose = rows.where(F.col("length") < length)
    parts = -(-int(total - hist[length]) // part) or 1
    # dealt by place, so that rows of one id (null, or repeated) are spread as any others
    dealt = loose.withColumn("_row", F.monotonically_increasing_id()).repartition(parts, F.xxhash64("_row")).drop("_row")
    packed = C.written(_pack(dealt, 0, length), "packed")
    count = lambda df: df.select("sequence_id").distinct().count()
    used = int(hist[length]) + count(packed)
    wide = 1
    for k in range(1, rounds):
        if used <= least:
            break
        wide *= 64
        given = packed.where("open")
        groups = max(1, parts // wide, given.count() // part)
        pool = given.withColumn("_group", F.pmod(F.xxhash64(F.shiftright("sequence_id", 32)), F.lit(groups))).repartition(groups, "_group").drop("_group")
        packed = C.written(packed.where("not open").unionByName(_pack(pool, k, length)), "packed")
        now = int(hist[length]) + count(packed)
        if now == used and groups == 1:
            break
        used = now
    alone = F.monotonically_increasing_id() + F.lit(1 << 61)
    return packed.drop("open").unionByName(full.select("*", alone.alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path()))
