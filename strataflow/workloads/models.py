"""Detection and prompting graphs.  Models are plugged in; the stand-ins are deterministic."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..failures import CompileError
from ..functions.stages import Module, native
from ..pipeline import Pipeline


def confident(scores: Column, least: float) -> Column:
    return F.size(F.filter(scores, lambda x: x >= F.lit(least)))


class DetectSegment(Pipeline):
    """image (path, scores) -> boxes -> masks -> overlay record.  Colours are seeded by the row, not by its place in a batch."""

    def __init__(self, least: float = 0.25, alpha: float = 0.5):
        self.least, self.alpha = least, alpha

    def forward(self, path, scores):
        least, alpha = self.least, self.alpha
        boxes, n = native(lambda s: (F.filter(s, lambda x: x >= F.lit(least)), confident(s, least)), outputs=2)(scores)
        masks, m = native(lambda b: (F.transform(b, lambda x, i: i), F.size(b)), outputs=2)(boxes)
        seed = native(lambda p: F.xxhash64(p))(path)
        return native(lambda p, b, k, s: F.struct(p.alias("input_path"), b.alias("boxes"), k.alias("masks"), F.lit(alpha).alias("overlay_alpha"), s.alias("seed")))(path, n, m, seed)


class TwoModels(Pipeline):
    """prompt -> first answer -> refined prompt -> second answer -> record of all three."""

    def __init__(self, first: Module | None = None, second: Module | None = None):
        self.first = first or native(lambda p: F.concat(F.lit("A: "), p))
        self.second = second or native(lambda p: F.concat(F.lit("B: "), p))

    def forward(self, prompt):
        a = self.first(prompt)
        refined = native(lambda p, x: F.concat(F.lit("Improve: "), p, F.lit(" | "), x))(prompt, a)
        b = self.second(refined)
        return native(lambda p, x, y: F.struct(p.alias("prompt"), x.alias("model_a"), y.alias("model_b")))(prompt, a, b)


def with_options(stages: dict[str, Module], overrides: dict[str, dict]) -> dict[str, Module]:
    """Stages with some options replaced; an unknown stage is an error."""
    if unknown := set(overrides) - set(stages):
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    if any("runtime_env" in o for o in overrides.values()):
        raise CompileError("one Spark application has one Python environment; run such stages as separate jobs")
    return {k: m.options(**overrides[k]) if k in overrides else replace(m) for k, m in stages.items()}


