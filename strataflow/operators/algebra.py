"""Outcomes as Column expressions.

A port is a struct column (o, v, c): outcome, value, cause.  v is null unless PRESENT, where null is a value too;
c is null unless FAILED or SUPPRESSED.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..failures import DROPPED, FAILED, PRESENT, SUPPRESSED

_BAD = (FAILED, SUPPRESSED)


def text() -> Column:
    """No cause."""
    return F.lit(None).cast("string")


def port(o: Column, v: Column, c: Column | None = None) -> Column:
    return F.struct(o.alias("o"), v.alias("v"), (text() if c is None else c.cast("string")).alias("c"))


def present(v: Column) -> Column:
    return port(F.lit(PRESENT), v)


def gate(ports: list[Column]) -> tuple[Column, Column]:
    """(outcome, cause) of a call before it runs; PRESENT: it runs."""
    bad = fold(lambda a, b: a | b, [p["o"].isin(*_BAD) for p in ports])
    dropped = fold(lambda a, b: a | b, [p["o"] == DROPPED for p in ports])
    cause = text()
    for p in reversed(ports):
        cause = F.when(p["o"].isin(*_BAD), p["c"]).otherwise(cause)
    return F.when(bad, SUPPRESSED).when(dropped, DROPPED).otherwise(PRESENT), cause


def filtered(source: Column, mask: Column) -> Column:
    """The source first, then the mask's own outcome, then its value; a mask without a boolean is an error."""
    sound = F.when(mask["v"].isNull(), F.raise_error(F.lit("a mask must be true or false")).cast("boolean")).otherwise(mask["v"])
    keep = (source["o"] == PRESENT) & (mask["o"] == PRESENT)
    o = F.when(source["o"] != PRESENT, source["o"]).when(mask["o"] != PRESENT, mask["o"]).when(sound, PRESENT).otherwise(DROPPED)
    v = F.when(keep & F.coalesce(mask["v"], F.lit(False)), source["v"])
    return port(o, v, F.when(source["o"] != PRESENT, source["c"]).when(mask["o"] != PRESENT, mask["c"]))


def sortable(kind: T.DataType) -> bool:
    """Whether Spark's own order covers the type, as far as known."""
    if isinstance(kind, T.ArrayType):
        return sortable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(sortable(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.NumericType, T.StringType, T.BooleanType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType))


def group_columns(key: Column, members: Column, values: list[Column], plain: bool = False) -> list[Column]:
    """Aggregates of a child level from which `reduced` makes the parent's item.  plain: all values are sortable."""
    bad = members["o"].isin(*_BAD)
    # all values of a member are held and sorted once; the key leads the struct and is unique in its group, so payloads are never compared
    held = F.collect_list(F.when(members["o"] == PRESENT, F.struct(key.alias("k"), *[v["v"].alias(f"v{i}") for i, v in enumerate(values)])))
    by_key = F.sort_array(held) if plain else F.array_sort(held, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
    out = [F.min(F.when(bad, key)).alias("bm"), F.min_by(members["c"], F.when(bad, key)).alias("bmc"), by_key.alias("held")]
    for i, v in enumerate(values):
        worst = F.when((members["o"] == PRESENT) & (v["o"] != PRESENT), key)
        out += [F.min(worst).alias(f"bv{i}"), F.min_by(v["c"], worst).alias(f"bvc{i}")]
    return out


def reduced(expansion: Column, i: int, kind: str) -> Column:
    """The parent's item; expansion: the outcome of the port whose value was expanded."""
    bm, bv = F.col("bm"), F.col(f"bv{i}")
    o = F.when(expansion["o"] == DROPPED, DROPPED).when(expansion["o"] != PRESENT, SUPPRESSED).when(bm.isNotNull() | bv.isNotNull(), SUPPRESSED).otherwise(PRESENT)
    v = F.when(o == PRESENT, F.coalesce(F.col("held")[f"v{i}"], F.array().cast(kind)))
    c = F.when(o != SUPPRESSED, None).when(expansion["o"] != PRESENT, expansion["c"]).when(bm.isNotNull(), F.col("bmc")).otherwise(F.col(f"bvc{i}"))
    return port(o, v, c)
