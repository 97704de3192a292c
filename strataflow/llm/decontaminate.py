"""Benchmark decontamination.

Words: A-Z lower-cased, then runs of digits, letters a-z and all non-ASCII characters.  A window is `width`
consecutive words of a benchmark item; an item with fewer words, but at least one, is one window.  The
distinct windows become a hash set; document windows of the same lengths are scanned for it, every hit is
verified word by word, and all words inside a verified window are hit.

Up to `broadcast_bytes` of benchmark text the set is broadcast (sorted hashes, places and one buffer of words: about five times
the text) and documents never move.  Beyond it the windows of the documents are hashed to rows and joined with the windows of the
benchmark by shuffle; candidates then meet the benchmark's windows themselves, word by word.  Both ways give the same rows.

Null texts have no words.  Empty benchmark: nothing is contaminated.  Items that share a window are all
counted.  A null item id is an item like any other, but has no part in the digest; rows of one id, null or not, are documents of their own.
Extra columns are ignored by `scan`, and kept by `remove_documents` and `remove_spans`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WIDTH = 10
BROADCAST_BYTES = 16_000_000
_LUT = C.lut_of("alnum")
_SCAN = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, spans array<struct<start: long, end: long>>"


class Windows:
    """Distinct hashes of windows by length, and where the windows of each stand in one buffer of words."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        self.width, self.ids = width, [i for i, _ in items]
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        buffer, size = [], 0
        for number, (_, text) in enumerate(items):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            s, e, _, h = C.words(raw, np.array([0, len(raw)]), _LUT)
            if not len(s):
                continue
            k = min(width, len(s))
            low = _LUT[raw].tobytes()
            own = b" ".join([low[p:q] for p, q in zip(s.tolist(), e.tolist(), strict=True)])
            ends = np.cumsum(e - s + 1) - 1
            first = size + ends - (e - s)
            held.setdefault(k, []).append((C.runs(h, k), np.full(len(s) - k + 1, number), first[: len(s) - k + 1], size + ends[k - 1 :]))
            buffer.append(own)
            size += len(own)
        self.buffer = b"".join(buffer)
        #: by length: sorted hashes, and of each its item and its place in the buffer
        self.held: dict[int, tuple[np.ndarray, ...]] = {}
        # one bit per possible top of a hash: nearly all document windows end here
        self.tops = {}
        for k, own in held.items():
            h, number, a, b = (np.concatenate(x) for x in zip(*own, strict=True))
            order = np.argsort(h, kind="stable")
            self.held[k] = (h[order], number[order].astype(np.int32), a[order], b[order])
            self.tops[k] = np.zeros(1 << 20, bool)
            self.tops[k][(h >> np.uint64(44)).astype(np.int64)] = True

    def candidates(self, h: np.ndarray, text: np.ndarray, k: int) -> np.ndarray:
        """Places of words from which a window of k words may occur."""
        if len(h) < k:
            return np.zeros(0, np.int64)
        r = C.runs(h, k)
        at = np.flatnonzero(self.tops[k][(r >> np.uint64(44)).astype(np.int64)])
        at = at[text[at] == text[at + k - 1]]
        v = self.held[k][0]
        return at[v[np.minimum(np.searchsorted(v, r[at]), len(v) - 1)] == r[at]]

    def items(self, k: int, h: int, words: bytes) -> frozenset[int]:
        """The items that hold this window."""
        v, number, a, b = self.held[k]
        lo, hi = np.searchsorted(v, np.uint64(h), "left"), np.searchsorted(v, np.uint64(h), "right")
        return frozenset(int(n) for n, p, q in zip(number[lo:hi], a[lo:hi], b[lo:hi], strict=True) if self.buffer[p:q] == words)


def _digest(ids: Iterable[str | None]) -> str:
    return hashlib.sha256(",".join(sorted(x for x in ids if x is not None)).encode()).hexdigest()


def _spans(inside: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[dict[str, int]]:
    """Byte ranges of words that are hit and follow each other."""
    w = np.flatnonzero(inside)
    edge = np.flatnonzero(np.diff(w) > 1)
    return [{"start": int(s[w[x]]), "end": int(e[w[y]])} for x, y in zip(np.r_[0, edge + 1], np.r_[edge, len(w) - 1], strict=True)] if len(w) else []


def _scan_batches(batches: Iterator[pa.RecordBatch], windows: Windows, id_col: str, text_col: str) -> Iterator[pa.RecordBatch]:
    none = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        offsets, raw = C.buffers(C.text_column(batch, text_col))
        ids = batch.column(batch.schema.get_field_index(id_col))
        n = batch.num_rows
        n_words, n_hit, n_items = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        sha, spans = [none] * n, [[] for _ in range(n)]
        for a, b in C.slices(offsets):
            own = raw[offsets[a] : offsets[b]]
            s, e, text, h = C.words(own, offsets[a : b + 1] - offsets[a], _LUT)
            n_words[a:b] = np.bincount(text, minlength=b - a)
            hit = np.zeros(len(s) + 1, np.int32)
            found: dict[int, set[int]] = {}
            known: dict[tuple[int, bytes], frozenset[int]] = {}
            low = None
            for k in windows.held:
                at = windows.candidates(h, text, k)
                if not len(at):
                    continue
                low = _LUT[own].tobytes() if low is None else low
                r = C.runs(h, k)[at].tolist()
                for i, x in zip(at.tolist(), r, strict=True):
                    key = b" ".join([low[p:q] for p, q in zip(s[i : i + k].tolist(), e[i : i + k].tolist(), strict=True)])
                    if (k, key) not in known:
                        known[k, key] = windows.items(k, x, key)
                    its = known[k, key]
                    if its:
                        hit[i] += 1
                        hit[i + k] -= 1
                        found.setdefault(int(text[i]), set()).update(its)
            if found:
                inside = np.cumsum(hit[:-1]) > 0
                n_hit[a:b] = np.bincount(text[inside], minlength=b - a)
                for t, its in found.items():
                    ids_of = {windows.ids[x] for x in its}
                    sha[a + t], n_items[a + t] = _digest(ids_of), len(ids_of)
                    p, q = np.searchsorted(text, [t, t + 1])
                    base = offsets[a + t] - offsets[a]
                    spans[a + t] = _spans(inside[p:q], s[p:q] - base, e[p:q] - base)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n_words), pa.array(n_hit), pa.array(n_items), pa.array(sha), pa.array(spans, kind)],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "spans"],
        )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, tuple[np.ndarray, ...]]]:
    """(batch, rows a..b, their bytes, their words)."""
    for batch in batches:
        offsets, raw = C.buffers(C.text_column(batch, "text"))
        for a, b in C.slices(offsets):
            own = raw[offsets[a] : offsets[b]]
            yield batch, a, b, own, C.words(own, offsets[a : b + 1] - offsets[a], _LUT)


def _window_rows(batches: Iterator[pa.RecordBatch], ks: list[int]) -> Iterator[pa.RecordBatch]:
    """(_row, k, h) of every window of the given lengths; a hash once per document."""
    for batch, a, _, _, (_, _, text, h) in _texts(batches):
        rows = batch.column(batch.schema.get_field_index("_row"))
        for k in ks:
            r = C.runs(h, k)
            ok = np.flatnonzero(text[: len(r)] == text[len(text) - len(r) :]) if len(r) else np.zeros(0, np.int64)
            pair = np.unique(np.stack([text[ok].astype(np.uint64), r[ok]], 1), axis=0)
            for c in range(0, len(pair), 500_000):
                own = pair[c : c + 500_000]
                yield pa.RecordBatch.from_arrays([rows.take(pa.array(a + own[:, 0].astype(np.int64))), pa.array(np.full(len(own), k, np.int32)), pa.array(own[:, 1].view(np.int64))], names=["_row", "k", "h"])


def _words_of(low: bytes, s: np.ndarray, e: np.ndarray, i: int, k: int) -> bytes:
    return b" ".join([low[p:q] for p, q in zip(s[i : i + k].tolist(), e[i : i + k].tolist(), strict=True)])


def _item_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(item_id, k, h, words) of every window of the benchmark; equal ones of an item once."""
    for batch, a, b, own, (s, e, text, h) in _texts(batches):
        ids, low = batch.column(batch.schema.get_field_index("item_id")).to_pylist(), _LUT[own].tobytes()
        for t in range(b - a):
            p, q = np.searchsorted(text, [t, t + 1])
            if p < q:
                k = int(min(width, q - p))
                r = C.runs(h[p:q], k).view(np.int64).tolist()
                rows = list({(x, _words_of(low, s, e, int(p) + i, k)) for i, x in enumerate(r)})
                hs, words = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([ids[a + t]] * len(rows), pa.string()), pa.array(np.full(len(rows), k, np.int32)), pa.array(hs, pa.int64()), pa.array(words, pa.binary())], names=["item_id", "k", "h", "words"])


def _candidate_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_row, k, h, words, places) of the windows in `own`, (k, h) pairs of each document."""
    for batch, a, b, raw, (s, e, text, h) in _texts(batches):
        low, own = _LUT[raw].tobytes(), batch.column(batch.schema.get_field_index("own")).slice(a, b - a).to_pylist()
        rows = batch.column(batch.schema.get_field_index("_row")).slice(a, b - a).to_pylist()
        for t in range(b - a):
            p, q = np.searchsorted(text, [t, t + 1])
            found: dict[tuple[int, int, bytes], list[int]] = {}
            for k in {x["k"] for x in own[t]}:
                r = C.runs(h[p:q], k).view(np.int64)
                for i in np.flatnonzero(np.isin(r, [x["h"] for x in own[t] if x["k"] == k])).tolist():
                    found.setdefault((k, int(r[i]), _words_of(low, s, e, int(p) + i, k)), []).append(i)
            if found:
                ks, hs, words = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([rows[t]] * len(ks), pa.int64()), pa.array(ks, pa.int32()), pa.array(hs, pa.int64()), pa.array(words, pa.binary()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["_row", "k", "h", "words", "places"])


def _hit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scan's rows of documents with their hit windows and items."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch, a, b, _, (s, e, text, _) in _texts(batches):
        own = batch.slice(a, b - a)
        col = lambda n, own=own: own.column(own.schema.get_field_index(n))
        offsets = np.cumsum(np.r_[0, pc.binary_length(C.text_column(own, "text").cast(pa.large_binary())).to_numpy()])
        n_hit, spans = [], []
        for t, windows in enumerate(col("windows").to_pylist()):
            p, q = np.searchsorted(text, [t, t + 1])
            hit = np.zeros(q - p + 1, np.int64)
            for w in windows or ():
                for i in w["places"]:
                    hit[i] += 1
                    hit[i + w["k"]] -= 1
            inside = np.cumsum(hit[:-1]) > 0
            n_hit.append(int(inside.sum()))
            spans.append(_spans(inside, s[p:q] - offsets[t], e[p:q] - offsets[t]))
        n_words = np.bincount(text, minlength=b - a)
        ids = col("items").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [col("doc_id"), pa.array(n_words), pa.array(n_hit, pa.int64()), pc.fill_null(col("n_items"), 0), pa.array([_digest(x or ()) for x in ids]), pa.array(spans, kind), col("_row")],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "spans", "_row"],
        )


def _broadcast(spark: SparkSession, items: DataFrame, width: int, most: int) -> Broadcast | None:
    """The windows, if the benchmark's texts are at most `most` bytes."""
    size = items.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("item_id"), F.lit(0)) + 8), F.lit(0))).first()[0]
    if size > most:
        return None
    return spark.sparkContext.broadcast(Windows([(r[0], r[1]) for r in items.collect()], width))


def scan(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, spans (byte ranges of hit words that follow each other)."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    held = _broadcast(spark, items, width, broadcast_bytes)
    if held is not None:
        return docs.mapInArrow(lambda it: _scan_batches(it, held.value, "doc_id", "text"), _SCAN)
    return _scan_by_join(_numbered(docs), items, width).drop("_row")


def _scan_by_join(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """The same for a benchmark of any size, with the column _row of docs."""
    rows = C.written(items.mapInArrow(lambda it: _item_rows(it, width), "item_id string, k int, h long, words binary"), "windows")
    ks = [r[0] for r in rows.select("k").distinct().collect()]  # at most `width` lengths
    # a window that many items share stands once here
    seen = docs.select("_row", "text").mapInArrow(lambda it: _window_rows(it, ks), "_row long, k int, h long")
    met = seen.join(rows.select("k", "h").distinct(), ["k", "h"]).groupBy("_row").agg(F.collect_list(F.struct("k", "h")).alias("own"))
    found = C.written(docs.select("_row", "text").join(met, "_row").mapInArrow(_candidate_rows, "_row long, k int, h long, words binary, places array<long>"), "met")
    key = ["k", "h", "words"]
    windows = found.join(rows.select(*key).distinct(), key).groupBy("_row").agg(F.collect_list(F.struct("k", "places")).alias("windows"))
    of = found.join(rows, key).select("_row", "item_id").distinct().groupBy("_row").agg(F.count("*").alias("n_items"), F.collect_list("item_id").alias("items"))
    return docs.select("_row", "doc_id", "text").join(windows, "_row", "left").join(of, "_row", "left").mapInArrow(_hit_rows, _SCAN + ", _row long")


def _numbered(docs: DataFrame) -> DataFrame:
    """docs as a table with a number of each row."""
    if "_row" in docs.columns:
        raise ValueError("documents have a column _row, which the join for large benchmarks needs")
    return C.written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def remove_documents(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents without a hit word, with all their columns.  Where the windows are broadcast, texts don't move."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    held = _broadcast(docs.sparkSession, items, width, broadcast_bytes)
    if held is None:
        own = _numbered(docs)
        hit = _scan_by_join(own.select("_row", F.lit(None).cast("long").alias("doc_id"), "text"), items, width).where("n_hit > 0").select("_row")
        return own.join(hit, "_row", "left_anti").select(docs.columns)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array(range(batch.num_rows), pa.int64())
            text = batch.column(batch.schema.get_field_index("text"))
            for got in _scan_batches(iter([pa.RecordBatch.from_arrays([ids, text], names=["doc_id", "text"])]), held.value, "doc_id", "text"):
                yield batch.filter(pa.array(got.column(2).to_numpy() == 0))

    return docs.mapInArrow(clean, docs.schema)


def remove_spans(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """All documents; the bytes of each hit span, from its first to its last word, are cut out of `text`."""
    own = _numbered(docs)
    as_docs = own.select(F.col("_row").alias("doc_id"), "text")
    spans = scan(as_docs, benchmark, **how).where("n_hit > 0").select(F.col("doc_id").alias("_row"), F.col("spans").alias("_spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            for i, own in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if own and texts[i] is not None:
                    raw, out, done = texts[i].encode(), [], 0
                    for x in own:
                        out.append(raw[done : x["start"]])
                        done = x["end"]
                    texts[i] = b"".join([*out, raw[done:]]).decode()
            arrays = [pa.array(texts, batch.schema.field(at).type) if j == at else batch.column(j) for j in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names[:-1])

    kept = own.join(spans, "_row", "left")
    return kept.select(*[own[c] for c in docs.columns], spans["_spans"].alias("_cut")).mapInArrow(cut, docs.schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return scan(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bk AS (SELECT item_id, w, least(10, len(w)) AS k FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bk)),
ks AS (SELECT DISTINCT k FROM win),
dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks),
hits AS (SELECT doc_id, dp.k, i, item_id FROM dp JOIN win ON dp.k = win.k AND array_to_string(w[i:i + dp.k - 1], ' ') = win.s),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
