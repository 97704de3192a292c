"""Pipelines, executors and run results."""

from __future__ import annotations

import inspect
import re
import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .failures import BrokenContract, PRESENT, CompileError, ContractError, ExecutionError, OutputIssue
from .plans.builder import Graph, Port, trace
from .plans.lowering import Lowering, keys, with_coordinates


class Pipeline:
    """Subclasses define forward(self, port, ...) with one positional parameter per source column, or forward(self, *ports) and
    the number of sources."""

    sources: int | None = None

    def forward(self, *ports: Port) -> Any:
        raise NotImplementedError

    def compile(self, optimize: bool = True) -> Graph:
        if self.sources is not None:
            return trace(self.forward, self.sources, optimize)
        params = list(inspect.signature(self.forward).parameters.values())
        if any(p.kind not in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) for p in params):
            raise CompileError("forward() takes positional parameters only")
        return trace(self.forward, len(params), optimize)

    def plan(self, source: DataFrame, columns: list[str], order: list[str] | None = None, optimize: bool = True, persist: bool = False) -> Plan:
        """Lazy DataFrames of the outputs over a source frame; order: columns that fix the coordinates."""
        return Plan(self.compile(optimize), source, columns, order, persist)

    def run(self, *columns: list, spark: SparkSession | None = None, schema: str | None = None, **how: Any) -> RunResult:
        """Over in-memory columns of equal length; schema: DDL 'a int, b string' where types can't be inferred."""
        with Executor(self, spark=spark) as e:
            return e.run(*columns, schema=schema, **how)


class Plan:
    def __init__(self, graph: Graph, source: DataFrame, columns: list[str], order: list[str] | None, persist: bool = False):
        if len(columns) != len(graph.sources):
            raise CompileError(f"the pipeline has {len(graph.sources)} sources")
        self.graph = graph
        frame = source if "_k0" in source.columns else with_coordinates(source.select(*dict.fromkeys([*columns, *(order or [])])), order)
        self.lowering = Lowering(graph, frame, columns, persist)

    def output(self, *path: int) -> DataFrame:
        """The frame (keys, o, v, c) of the output port at this place of the output tree."""
        x = self.graph.output
        for i in path:
            x = x[i]
        return self.lowering.output(x)

    def frames(self, *paths: tuple[int, ...]) -> DataFrame:
        """Several output ports of one level side by side: keys, and o0, v0, c0, o1, ..."""
        ports = []
        for path in paths:
            x = self.graph.output
            for i in path:
                x = x[i]
            ports.append(x)
        cols = [F.col(p.name)[f].alias(f"{f}{i}") for i, p in enumerate(ports) for f in ("o", "v", "c")]
        return self.lowering.frames[ports[0].level.number].select(*keys(ports[0].level), *cols)

    def collect(self) -> Any:
        """The output tree with a list per port, in coordinate order; issues in place of values that aren't present."""

        def of(x: Any) -> Any:
            if isinstance(x, tuple):
                return tuple(of(y) for y in x)
            df = self.lowering.output(x)
            return [_plain(r["v"]) if r["o"] == PRESENT else OutputIssue(r["o"], r["c"]) for r in df.orderBy(*keys(x.level)).collect()]

        return of(self.graph.output)

    def metrics(self) -> DataFrame:
        """Entities by level, and items by outcome of every port."""
        out = None
        for number, frame in sorted(self.lowering.frames.items()):
            for c in [c for c in frame.columns if c.startswith("p")]:
                own = frame.groupBy(F.col(c)["o"].alias("outcome")).count().select(F.lit(number).alias("level"), F.lit(c).alias("port"), "outcome", F.col("count").alias("items"))
                out = own if out is None else out.unionByName(own)
        return out


def _plain(v: Any) -> Any:
    if isinstance(v, list):
        return [_plain(x) for x in v]
    return v.asDict(True) if hasattr(v, "asDict") else v


@dataclass
class RunResult:
    outputs: Any
    elapsed: float
    input_batches: int = 1
    metrics: list[dict] = field(default_factory=list)


class Executor:
    """Runs a pipeline again and again on one session; it stops the session only if it started it."""

    def __init__(self, pipeline: Pipeline, spark: SparkSession | None = None):
        self.pipeline, self.graph = pipeline, pipeline.compile()
        self._own = spark is None and SparkSession.getActiveSession() is None
        self.spark = spark or SparkSession.builder.getOrCreate()
        self._closed = False

    def __enter__(self) -> Executor:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()

    def close(self) -> None:
        if not self._closed and self._own:
            self.spark.stop()
        self._closed = True

    def run(self, *columns: list, schema: str | None = None, input_batch_size: int | None = None, with_metrics: bool = False) -> RunResult:
        if self._closed:
            raise ExecutionError("the executor is closed")
        columns = tuple(tuple(c) for c in columns)
        if len({len(c) for c in columns}) != 1 or len(columns) != len(self.graph.sources):
            raise ValueError("one column per source, all of one length")
        began, rows = time.time(), list(zip(*columns, strict=True))
        names = [f"s{i}" for i in range(len(columns))]
        size = input_batch_size or max(1, len(rows))
        parts, metrics = [], []
        try:
            for a in range(0, max(1, len(rows)), size):
                own = [(a + i, *r) for i, r in enumerate(rows[a : a + size])]
                ddl = schema or (None if own else ", ".join(f"{n} string" for n in names))
                if ddl:
                    kinds = [f.dataType.simpleString() for f in self.spark.createDataFrame([], ddl).schema.fields]
                    frame = self.spark.createDataFrame(own, ", ".join(["_k0 long", *(f"{n} {k}" for n, k in zip(names, kinds, strict=True))]))
                else:
                    frame = self.spark.createDataFrame(own, ["_k0", *names])
                plan = Plan(self.graph, frame, names, None)
                parts.append(plan.collect())
                if with_metrics:
                    metrics += [r.asDict() for r in plan.metrics().collect()]
        except PythonException as e:
            self._closed = True
            # the worker's error is told apart by its type, which starts a line of its own; a user's error may be called alike
            broken = re.search(rf"^{BrokenContract.__module__}\.{BrokenContract.__qualname__}(?::|$)", str(e), re.M)
            raise (ContractError if broken else ExecutionError)(str(e)) from e
        return RunResult(_joined(parts), time.time() - began, len(parts), metrics)


def _joined(parts: list) -> Any:
    if isinstance(parts[0], tuple):
        return tuple(_joined([p[i] for p in parts]) for i in range(len(parts[0])))
    return [x for p in parts for x in p]


def run(pipeline: Pipeline, *columns: list, **how: Any) -> RunResult:
    return pipeline.run(*columns, **how)
