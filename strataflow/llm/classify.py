"""Quality classifier by positive-unlabelled learning.

A text becomes counts of bytes and words (no language, source or id).  A small network is fitted on the
driver to two bounded samples, trusted positives and unlabelled texts, each the `sample` rows of the smallest
hash: it minimises the non-negative unbiased risk  pi R+(f) + max(0, Ru-(f) - pi R+-(f))  of the logistic
loss, where pi is the estimated class prior: the share of label 1 among all labelled rows, or, where no label 0
exists, the mean of a first fit over unlabelled rows divided by its mean over positives.  A line fitted to the
labelled samples, each row weighing as many rows as it stands for, turns f into a score.

Null texts are empty and get a score like any other.  Without positive labels every score is 0.5.  Several
labels of one document count as their mean.  Rows of equal text get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SAMPLE = 20_000
HIDDEN = 16
SLICE = 400_000  # bytes of text that are described at once
_GRAPH = C.lut_of("graph")
#: byte classes: a-z, A-Z, digits, from 0x80, sentence marks, other marks
_KIND = np.full(256, 6, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 3
for _c in b".,;:'\"-()":
    _KIND[_c] = 4
for _c in b"!?":
    _KIND[_c] = 5
_KIND[[9, 10, 11, 12, 13, 32]] = 7
N_FEATURES = 17


def text_features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of N_FEATURES per text."""
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES))
    size = np.diff(offsets)
    some = np.maximum(size, 1)
    text = np.repeat(np.arange(n), size)
    kinds = np.bincount(text * 8 + _KIND[raw], minlength=8 * n).reshape(n, 8)
    letters = np.maximum(kinds[:, [0, 1, 3]].sum(1), 1)
    out[:, 0] = np.log1p(size)
    out[:, 1:8] = kinds[:, 1:] / some[:, None]
    out[:, 8] = kinds[:, 1] / letters
    s, e, t, h = C.words(raw, offsets, _GRAPH)
    count = np.bincount(t, minlength=n)
    words = np.maximum(count, 1)
    out[:, 9] = np.bincount(t, e - s, n) / words / 10
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
    out[:, 10] = np.bincount(t[same], minlength=n) / words
    out[:, 11] = np.bincount(t[(e - s) == 1], minlength=n) / words
    if len(h):
        # distinct words in stretches of 64 words, so that the share doesn't fall with length
        first = np.r_[0, np.cumsum(count)[:-1]]
        stretch = (np.arange(len(h)) - first[t]) // 64
        key = C.mix(h ^ C.mix((t.astype(np.uint64) << np.uint64(32)) + stretch.astype(np.uint64)))
        out[:, 12] = np.bincount(t[np.unique(key, return_index=True)[1]], minlength=n) / words
        end = _KIND[raw[e - 1]]
        out[:, 13] = np.bincount(t[end == 6], minlength=n) / words
        out[:, 14] = np.bincount(t[end == 5], minlength=n) / words
        out[:, 15] = np.bincount(t[(_KIND[raw[s]] == 1)], minlength=n) / words
    out[:, 16] = np.bincount(text[raw == 10], minlength=n) / words
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    line: tuple[float, float]
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.line[0] * self.raw(x) + self.line[1], -30, 30)))


def _descend(pos: np.ndarray, unl: np.ndarray, prior: float | None, steps: int, seed: int = 7, share: np.ndarray | None = None) -> tuple:
    """Adam on the non-negative risk; without a prior, on the plain risk of positives against unlabelled rows.

    share: how often each unlabelled row is drawn; without it, all alike."""
    rng = np.random.default_rng(seed)
    d = pos.shape[1]
    p = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for k in range(1, steps + 1):
        a, b = pos[rng.integers(0, len(pos), 1024)], unl[rng.integers(0, len(unl), 2048) if share is None else rng.choice(len(unl), 2048, p=share)]
        x = np.concatenate([a, b])
        h = np.tanh(x @ p[0] + p[1])
        f = h @ p[2] + p[3][0]
        s, n = sig(f), len(a)
        g = np.zeros(len(x))
        if prior is None:
            g[:n], g[n:] = (s[:n] - 1) / n, s[n:] / len(b)
        else:
            soft = np.logaddexp(0, f)
            negative = soft[n:].mean() - prior * soft[:n].mean()
            if negative >= 0:
                g[:n], g[n:] = prior * ((s[:n] - 1) - s[:n]) / n, s[n:] / len(b)
            else:  # step back from what the flexible model explains too well
                g[:n], g[n:] = prior * s[:n] / n, -s[n:] / len(b)
        dh = (g[:, None] * p[2]) * (1 - h * h)
        grads = [x.T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
        for i, q in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * q
            v[i] = 0.999 * v[i] + 0.001 * q * q
            p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
    return p


def learn(pos: np.ndarray, neg: np.ndarray, unl: np.ndarray, steps: int = 1500, counts: tuple[int, int] | None = None) -> Model | None:
    """counts: of all rows of label 1 and of label 0, of which pos and neg are samples."""
    if not len(pos):
        return None
    n_pos, n_neg = counts or (len(pos), len(neg))
    each = np.r_[np.full(len(pos), n_pos / len(pos)), np.full(len(neg), n_neg / max(len(neg), 1))]
    share = None if len(unl) else each / each.sum()
    unl = unl if len(unl) else np.concatenate([pos, neg])
    every = np.concatenate([pos, unl])
    mean, scale = every.mean(0), every.std(0) + 1e-3
    z = lambda x: np.clip((x - mean) / scale, -8, 8)
    if len(neg):
        prior = n_pos / (n_pos + n_neg)
    else:
        p = _descend(z(pos), z(unl), None, steps, share=share)
        g = lambda x: (1 / (1 + np.exp(-np.clip(np.tanh(z(x) @ p[0] + p[1]) @ p[2] + p[3][0], -30, 30)))).mean()
        prior = min(0.99, max(0.01, g(unl) / g(pos)))
    p = _descend(z(pos), z(unl), min(prior, 0.99), steps, share=share)
    model = Model(mean, scale, p[0], p[1], p[2], float(p[3][0]), (1.0, 0.0), prior)
    if len(neg):  # a line through the labelled samples at the rates of all labelled rows, by Newton steps
        x = np.concatenate([model.raw(pos), model.raw(neg)])
        y = np.r_[np.ones(len(pos)), np.zeros(len(neg))]
        a, t = np.stack([x, np.ones(len(x))], 1), np.array([1.0, 0.0])
        u = each / each.mean()
        for _ in range(25):
            q = 1 / (1 + np.exp(-np.clip(a @ t, -30, 30)))
            t = t - np.linalg.solve((a * (u * q * (1 - q))[:, None]).T @ a / len(x) + 1e-3 * np.eye(2), a.T @ (u * (q - y)) / len(x) + 1e-3 * (t - [1, 0]))
        if t[0] > 0:
            model.line = (float(t[0]), float(t[1]))
    return model


def _matrix(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    offsets, raw = C.buffers(C.text_column(batch, "text"))
    for a, b in C.slices(offsets, SLICE):
        yield a, b, text_features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def features(docs: DataFrame) -> DataFrame:
    """doc_id and x: the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in _matrix(batch):
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), N_FEATURES).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), flat], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit(feats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of rows that aren't held out."""
    given = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).alias("y"))
    rows = feats.where(~held_out()).join(given, "doc_id", "left")
    conds = ("y", "not y", "y is null")
    counts = rows.agg(*[F.count(F.when(F.expr(c), 1)) for c in conds]).first()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))

    def take(cond: str, n: int) -> list:
        # about 1.3 samples get past the threshold, so no task sends the driver a sample of its own
        cut = min(1 << 30, int((1.3 * sample + 200) / max(n, 1) * (1 << 30)))
        return [r[0] for r in rows.where(cond).where(place < cut).orderBy(place, "doc_id").select("x").limit(sample).collect()]

    pos, neg, unl = (np.array(take(c, n), float).reshape(-1, N_FEATURES) for c, n in zip(conds, counts, strict=True))
    return learn(pos, neg, unl, counts=(counts[0], counts[1]))


def scored(feats: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score."""
    held = feats.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
            s = held.value.score(x) if held.value else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    return feats.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The documents of a score of at least `least`, with all their columns; the texts don't move."""
    held = docs.sparkSession.sparkContext.broadcast(fit(C.written(features(docs), "features"), labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.full(batch.num_rows, 0.5)
            if held.value:
                for a, b, x in _matrix(batch):
                    ok[a:b] = held.value.score(x)
            yield batch.filter(pa.array(ok >= least))

    return docs.mapInArrow(run, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = C.written(features(spark.read.parquet(f"{sf_dir}/documents.parquet")), "features")
    out = scored(feats, fit(feats, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
