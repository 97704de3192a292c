"""Page recognition: documents to pages, a recogniser that is plugged in, and assembly; stems and run figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stages import Module, native
from ..operators import structural as ops
from ..pipeline import Pipeline


def stem(path: Column) -> Column:
    """The file name of a path or URI without its last suffix; an error for names that can't be a file's."""
    name = F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"([^/]*)$", 1)
    base = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1)
    return F.when((base == "") | base.startswith("."), F.raise_error(F.concat(F.lit("no file name in "), path)).cast("string")).otherwise(base)


def is_remote(path: Column) -> Column:
    return path.startswith("hdfs://")


class PageAssembly(Pipeline):
    """document (path, pages) -> recognised pages -> text with its counts.

    recognise: a stage from a page to its text; without one, pages are their text.  A page that fails
    suppresses its document alone."""

    def __init__(self, recognise: Module | None = None):
        self.recognise = recognise or native(lambda page: page)

    def forward(self, path, pages):
        page = ops.expand(native(lambda p: F.coalesce(p, F.array().cast("array<string>")))(pages))
        text = self.recognise(page)
        texts, raw = ops.reduce_aligned(text, page, members=text)
        done = native(lambda p, t: F.struct(p.alias("path"), F.array_join(t, "\n\n").alias("markdown"), F.size(t).alias("pages")))(path, texts)
        return done, native(lambda d: F.length(d["markdown"]))(done), native(lambda d: d["pages"])(done)


def scale_metrics(result: DataFrame, seconds: float) -> DataFrame:
    """documents, failed, pages and pages_per_s of assembled documents (o0, v0: the page count)."""
    return result.agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("o") != "PRESENT").alias("failed"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("pages"),
    ).withColumn("pages_per_s", F.col("pages") / F.lit(max(seconds, 1e-9)))


def recommend(cpus: int, pages: int, profile: str = "smoke") -> dict[str, int]:
    """Partition counts for rendering, recognition and assembly: shares of the CPUs by profile."""
    shares = {"smoke": (1, 1, 1), "conservative": (4, 2, 1), "shared": (8, 4, 2)}
    if profile not in shares:
        raise ValueError(f"unknown profile: {profile}")
    total = sum(shares[profile])
    parts: Callable[[int], int] = lambda s: max(1, min(pages or 1, cpus * s // total))
    render, read, assemble = (parts(s) for s in shares[profile])
    return {"render": render, "recognise": read, "assemble": assemble}
