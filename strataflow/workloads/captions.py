"""Clip captions: frame sampling, candidate scores, selection and source summaries, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stages import Module, native
from ..operators import structural as ops
from ..pipeline import Pipeline

#: fixed values: where in a clip frames are taken; length from which a caption costs; candidates of a clip
FRACTIONS = (0.0, 1 / 3, 2 / 3, 1.0)
FREE, LONG, CANDIDATES = 24, 32, 4


def frame_indices(n: Column, start: Column, end: Column) -> Column:
    """Indices at FRACTIONS of a clip's span in a video of n frames; halves round to even."""
    at = lambda f: F.least(n - 1, F.greatest(F.lit(0), F.bround((n - 1) * (start + (end - start) * F.lit(f)), 0).cast("long")))
    return F.array(*[at(f) for f in FRACTIONS])


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def overlap(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(common, left, right) distinct tokens."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.size(F.array_intersect(x, y)), F.size(x), F.size(y)


def f1(a: Column, b: Column) -> Column:
    n, x, y = overlap(a, b)
    return F.when(n == 0, 0.0).otherwise(2.0 * n / (x + y))


def score(text: Column) -> Column:
    """Length up to FREE, variety, less what is over LONG; -inf without tokens."""
    t = tokens(text)
    n = F.size(t)
    return F.when(n == 0, F.lit(float("-inf"))).otherwise(F.least(n, F.lit(FREE)) + 5.0 * F.size(F.array_distinct(t)) / n - 1.5 * F.greatest(F.lit(0), n - LONG))


def best(candidates: Column) -> Column:
    """The first place (from 0) of the best score; exactly CANDIDATES are given."""
    scored = F.transform(candidates, lambda c, i: F.struct(score(c).alias("s"), (-i).alias("i")))
    return F.when(F.size(candidates) == CANDIDATES, -F.array_max(scored)["i"]).otherwise(F.raise_error(F.lit("a clip has four candidates")).cast("int"))


class ClipCaptions(Pipeline):
    """source (id, clips) -> clips -> candidates -> the chosen caption -> the source's summary."""

    def __init__(self, generate: Module | None = None):
        self.generate = generate or native(lambda clip: clip["candidates"])

    def forward(self, source, clips):
        some = native(lambda c: c, fails=lambda c: F.when(F.size(c) < 1, "a source has clips"))
        clip = ops.expand(some(clips))
        told = self.generate(clip)
        chosen = native(lambda c, t: F.struct(c["clip_index"].alias("clip_index"), best(t).alias("chosen"), F.element_at(t, best(t) + 1).alias("caption"), f1(F.element_at(t, best(t) + 1), c["reference"]).alias("f1")))(clip, told)
        return chosen, native(lambda s, c: F.struct(s.alias("source"), F.size(c).alias("clips"), F.coalesce(F.aggregate(c, F.lit(0.0), lambda a, x: a + x["f1"]) / F.nullif(F.size(c), F.lit(0)), F.lit(0.0)).alias("mean_f1")))(source, ops.reduce(chosen))


def replicated(clips: DataFrame, times: int, col: str = "id") -> DataFrame:
    """Every row `times` times, its id with the suffix __sample_000 and so on; a generator, no join."""
    n = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    return clips.withColumn("_n", n).withColumn(col, F.format_string("%s__sample_%03d", F.col(col).cast("string"), "_n")).drop("_n")
