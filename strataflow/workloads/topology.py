"""Nested graphs over generated records: documents of pages of tables, videos of frames, and sibling levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stages import native
from ..operators import structural as ops
from ..pipeline import Pipeline

_seq = lambda n: F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
_ids = lambda v: F.array_join(F.transform(v, lambda x: x.cast("string")), ",")


class DocumentTopology(Pipeline):
    """document (name, table counts) -> pages -> tables -> cells; ids are collected in order on the way back."""

    def forward(self, name, counts):
        page = ops.expand(native(lambda c: F.transform(c, lambda n, i: F.struct(i.alias("page"), n.alias("tables"))))(counts))
        layout = native(lambda p: F.concat(F.lit("layout-"), p["page"].cast("string")))(page)
        text = native(lambda p: F.concat(F.lit("ocr-"), p["page"].cast("string")))(page)
        merged = native(lambda p, a, b: F.struct(p["page"].alias("page"), a.alias("layout"), b.alias("text")))(page, layout, text)
        table = ops.expand(native(lambda p: _seq(p["tables"]))(page))
        cells = native(lambda t: t + 1)(table)
        tables = ops.reduce(table, members=cells)
        done = native(lambda m, t: F.struct(m["page"].alias("page"), F.concat_ws("/", m["layout"], m["text"]).alias("text"), _ids(t).alias("tables")))(merged, tables)
        pages = ops.reduce(done)
        return name, native(lambda p: F.array_join(F.transform(p, lambda x: x["tables"]), "|"))(pages), native(lambda p: F.size(p))(pages)


class VideoCaption(Pipeline):
    """video -> frames -> captions -> summary."""

    def forward(self, name, frames):
        frame = ops.expand(native(_seq)(frames))
        caption = native(lambda v, f: F.concat(v, F.lit("#"), f.cast("string")))(ops.broadcast(name, frame), frame)
        return native(lambda c: F.array_join(c, " "))(ops.reduce(caption))


class VideoMultimodal(Pipeline):
    """Two sibling levels of one video, each reduced to it before they meet."""

    def forward(self, name, frames, chunks):
        frame, chunk = ops.expand(native(_seq)(frames)), ops.expand(native(_seq)(chunks))
        seen = ops.reduce(native(lambda f: F.concat(F.lit("f"), f.cast("string")))(frame))
        heard = ops.reduce(native(lambda a: F.concat(F.lit("a"), a.cast("string")))(chunk))
        return native(lambda n, f, a: F.concat(n, F.lit(":"), F.array_join(f, ","), F.lit(";"), F.array_join(a, ",")))(name, seen, heard)
