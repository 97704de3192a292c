"""From a graph to one lazy DataFrame per level.

A level's frame has the key columns _k0 .. _kn and a struct column per port.  Expansion is a generator, a
filter a CASE, a broadcast a join on the key's prefix, a reduction one ordered aggregate joined to the parent.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..failures import FAILED, PRESENT, SUPPRESSED
from ..functions.stages import Module, python_stage
from ..operators import algebra as A
from .builder import Graph, Level, Node, Port


RANGE = 20_000  # rows of a range, where there are few


def keys(level: Level) -> list[str]:
    return [f"_k{i}" for i in range(level.depth + 1)]


def with_coordinates(df: DataFrame, order: list[str] | None) -> DataFrame:
    """_k0: 0 .. n-1 in the given order, without bringing all rows to one task.

    Rows are dealt by ranges of their keys, whose borders are literals taken from a sample, so that every reading of the rows deals
    them alike; each is numbered in its range and shifted by the number of rows before that.  One shuffle moves the
    rows, and only one count per range is known outside the executors.  Without an order, rows stay where they lie."""
    if order:
        keys_, spark = [F.col(c) for c in order], df.sparkSession
        n = df.select(*keys_).count()
        ranges = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE) or 1)
        drawn = df.select(*keys_).sample(False, min(1.0, 100 * ranges / n), 7).orderBy(*keys_).collect() if ranges > 1 else []
        kinds = [df.schema[c].dataType for c in order]
        if not drawn:  # one range
            return df.withColumn("_k0", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
        cut = [drawn[len(drawn) * k // ranges] for k in range(1, ranges)]
        if len(order) == 1:  # compared as they are; nulls come first, so that no border is needed among them
            own = dealt(df, [F.lit(v).cast(kinds[0]) for (v,) in cut if v is not None], keys_[0])
        else:
            own = dealt(df, [F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(row, kinds, order, strict=True)]) for row in cut], F.struct(*keys_))
        within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    else:
        own = df.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
        within = F.col("_at").bitwiseAND((1 << 33) - 1) + 1  # the place in the partition
    counts = own.groupBy("_part").count()
    before = counts.select("_part", F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    numbered = own.withColumn("_within", within).join(F.broadcast(before), "_part", "left")  # a row per range
    return numbered.withColumn("_k0", (F.col("_within") - 1 + F.coalesce("_before", F.lit(0))).cast("long")).drop("_part", "_within", "_before", "_at")


def dealt(df: DataFrame, borders: list[Column], x: Column) -> DataFrame:
    """_part: how many of the ascending borders are less than x, found by halving: a projection of compiled code per binary digit."""
    held, out = F.array(*borders), df.withColumn("_part", F.lit(0))
    for k in reversed(range(len(borders).bit_length())):
        at = F.col("_part")
        out = out.withColumn("_part", F.when(F.get(held, at + F.lit((1 << k) - 1)) < x, at + F.lit(1 << k)).otherwise(at))
    return out


class Lowering:
    def __init__(self, graph: Graph, source: DataFrame, columns: list[str], persist: bool = False):
        self.graph, self.frames, self.persist = graph, {}, persist
        root = graph.sources[0].level
        self.frames[root.number] = source.select("_k0", *[A.present(F.col(c)).alias(p.name) for p, c in zip(graph.sources, columns, strict=True)])
        for node in graph.nodes:
            getattr(self, f"_{node.op}")(node)

    def _add(self, port_columns: dict[Port, Column]) -> None:
        level = next(iter(port_columns)).level.number
        self.frames[level] = self.frames[level].select("*", *[c.alias(p.name) for p, c in port_columns.items()])

    # -- calls
    def _call(self, node: Node) -> None:
        module, layout, static = node.detail
        if module.native:
            self._native(node, module, layout, static)
        else:
            self._python(node, module, layout, static)

    def _siblings(self, level: Level) -> Any:
        return Window.partitionBy(*keys(level)[:-1]) if level.depth else Window.partitionBy("_k0")

    def _native(self, node: Node, module: Module, layout: tuple, static: dict) -> None:
        ports = [F.col(p.name) for p in node.inputs]
        args = [p["v"] for p, n in zip(ports, layout, strict=True) if n is None]
        named = {n: p["v"] for p, n in zip(ports, layout, strict=True) if n} | static
        o, c = A.gate(ports)
        level = node.outputs[0].level
        # what several expressions read is a column of its own, so that compiled code has it once and stays small enough for the JIT
        frame = self.frames[level.number].withColumns({"_o": o, "_c": c})
        runs = F.col("_o") == PRESENT
        group, barrier = A.text(), A.text()
        if module.fails_group is not None:
            key, group, barrier = F.col(keys(level)[-1]), F.col("_gc"), F.col("_gb")
            frame = frame.withColumn("_gc", F.when(runs, module.fails_group(*args, **named).cast("string")))
            frame = frame.withColumn("_gb", F.min_by("_gc", F.when(group.isNotNull(), key)).over(self._siblings(level)))
        own = module.fails(*args, **named).cast("string") if module.fails is not None else A.text()
        frame = frame.withColumn("_why", F.when(runs, F.coalesce(group, own)))
        out = F.when(~runs, F.col("_o")).when(F.col("_why").isNotNull(), FAILED).when(barrier.isNotNull(), SUPPRESSED).otherwise(PRESENT)
        why = F.when(~runs, F.col("_c")).otherwise(F.coalesce("_why", barrier))
        frame = frame.withColumns({"_out": out, "_c": why})
        values = module.target(*args, **named)
        values = values if isinstance(values, tuple) else (values,)
        self.frames[level.number] = frame
        self._add({p: A.port(F.col("_out"), F.when(F.col("_out") == PRESENT, v), F.col("_c")) for p, v in zip(node.outputs, values, strict=True)})
        self.frames[level.number] = self.frames[level.number].drop("_o", "_c", "_why", "_out", "_gc", "_gb")

    def _python(self, node: Node, module: Module, layout: tuple, static: dict) -> None:
        level = node.outputs[0].level
        frame = self.frames[level.number]
        if module.replicas:
            frame = frame.repartition(module.replicas)
        types = [T._parse_datatype_string(t) for t in module.types]
        names = [p.name for p in node.outputs]
        schema = T.StructType([*frame.schema.fields, *[T.StructField(n, T.StructType([T.StructField("o", T.StringType()), T.StructField("v", t), T.StructField("c", T.StringType())])) for n, t in zip(names, types, strict=True)]])
        run = python_stage(module, layout, static, [p.name for p in node.inputs], names, [to_arrow_type(t) for t in types])
        frame = frame.mapInArrow(run, schema)
        # a group failure suppresses its siblings that would have been present
        first = F.col(names[0])
        w = self._siblings(level)
        barrier = F.when(first["o"] == "GROUP", F.col(keys(level)[-1]))
        frame = frame.withColumn("_g", F.min(barrier).over(w)).withColumn("_gc", F.min_by(first["c"], barrier).over(w))
        for n in names:
            p = F.col(n)
            hit = (p["o"] == PRESENT) & F.col("_g").isNotNull()
            o = F.when(p["o"] == "GROUP", FAILED).when(hit, SUPPRESSED).otherwise(p["o"])
            frame = frame.withColumn(n, A.port(o, F.when(~hit, p["v"]), F.when(hit, F.col("_gc")).otherwise(p["c"])))
        self.frames[level.number] = frame.drop("_g", "_gc")
        if self.persist:  # a stage that several branches read runs once
            self.frames[level.number] = self.frames[level.number].persist()

    # -- structure
    def _expand(self, node: Node) -> None:
        parent, child = node.inputs[0].level, node.outputs[0].level
        values = [F.col(p.name)["v"] for p in node.inputs]
        sound = F.when(values[0].isNull(), F.raise_error(F.lit("a call that is expanded gives lists")).cast("int")).otherwise(F.size(values[0]))
        same = [F.when(F.coalesce(F.size(v), F.lit(-1)) == sound, v).otherwise(F.raise_error(F.lit("aligned groups differ in length")).cast(self._type(p))) for v, p in zip(values, node.inputs, strict=True)]
        rows = self.frames[parent.number].where(F.col(node.inputs[0].name)["o"] == PRESENT)
        if len(same) == 1:
            zipped = F.when(sound > 0, values[0])
        else:  # one struct per child, so that lengths, checked above, are the only thing that ties the arrays
            zipped = F.transform(F.sequence(F.lit(0), F.size(same[0]) - 1), lambda i: F.struct(*[F.get(s, i).alias(f"e{k}") for k, s in enumerate(same)]))
            zipped = F.when(F.size(same[0]) > 0, zipped)
        new = f"_k{child.depth}"
        carried = self._carried(child)
        out = rows.select(*keys(parent), *[F.col(c).alias(to) for to, c in carried.items()], F.posexplode(zipped).alias(new, "_e"))
        self.frames[child.number] = out.select(*keys(parent), *carried, F.col(new).cast("long").alias(new), *[A.present(F.col("_e")[f"e{i}"] if len(same) > 1 else F.col("_e")).alias(p.name) for i, p in enumerate(node.outputs)])

    def _carried(self, child: Level) -> dict[str, str]:
        """What the generator hands down to a new level: ancestors' columns, known by now, that it or a level below broadcasts."""
        there, above = self.frames[child.parent.number].columns, child.lineage()[:-1]
        wanted = [n.inputs[0] for n in self.graph.nodes if n.op == "broadcast" and child in n.outputs[0].level.lineage() and n.inputs[0].level in above]
        return {f"from_{p.name}": c for p in wanted for c in (f"from_{p.name}", p.name) if c in there}

    def _type(self, port: Port) -> T.DataType:
        return self.frames[port.level.number].schema[port.name].dataType["v"].dataType

    def _filter(self, node: Node) -> None:
        mask = self._type(node.inputs[1])
        if not isinstance(mask, T.BooleanType):
            raise TypeError(f"a mask is boolean, not {mask.simpleString()}")
        self._add({node.outputs[0]: A.filtered(F.col(node.inputs[0].name), F.col(node.inputs[1].name))})

    def _broadcast(self, node: Node) -> None:
        source, out = node.inputs[0], node.outputs[0]
        if f"from_{source.name}" in self.frames[out.level.number].columns:  # came down with the expansion
            self._add({out: F.col(f"from_{source.name}")})
            return
        above = self.frames[source.level.number].select(*keys(source.level), F.col(source.name).alias(out.name))
        # an equi-join on the key's prefix; Spark broadcasts the ancestor only where it is small
        self.frames[out.level.number] = self.frames[out.level.number].join(above, keys(source.level), "left")

    def _reduce(self, node: Node) -> None:
        *values, members = node.inputs
        child, parent = members.level, members.level.parent
        key = F.col(keys(child)[-1])
        cols = A.group_columns(key, F.col(members.name), [F.col(v.name) for v in values], all(A.sortable(self._type(v)) for v in values))
        groups = self.frames[child.number].groupBy(*keys(parent)).agg(*cols)
        expansion = F.col(child.producer.name)
        types = [f"array<{self._type(v).simpleString()}>" for v in values]
        joined = self.frames[parent.number].join(groups, keys(parent), "left")
        out = joined.select("*", *[A.reduced(expansion, i, t).alias(p.name) for i, (p, t) in enumerate(zip(node.outputs, types, strict=True))])
        self.frames[parent.number] = out.drop(*[c for c in groups.columns if c not in keys(parent)])

    def output(self, port: Port) -> DataFrame:
        """Keys, o, v and c of a port; order by the keys where order matters."""
        return self.frames[port.level.number].select(*keys(port.level), f"{port.name}.*")

