"""Stages: native Column functions, and batched Python functions or classes."""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import pyarrow as pa

from ..failures import DROPPED, FAILED, PRESENT, SUPPRESSED, BrokenContract, CompileError, GroupFailure, RecordFailure, cause_text
from .recovery import RecoveryPolicy

_uid = itertools.count()
#: instances of class stages in this Python worker, made once
_instances: dict[int, Any] = {}


@dataclass(frozen=True, eq=False)
class Module:
    """A callable stage.  native: takes and gives Columns.  Otherwise `target` is a function of lists, or a class with run()."""

    target: Any
    native: bool = False
    types: tuple[str, ...] = ()
    outputs: int = 1
    init: tuple[tuple, dict] = ((), {})
    batch_size: int = 1024
    replicas: int | None = None
    recovery: RecoveryPolicy = RecoveryPolicy()
    fails: Callable | None = None
    fails_group: Callable | None = None
    uid: int = field(default_factory=lambda: next(_uid))

    def pre_init(self, *args: Any, **kw: Any) -> Module:
        return replace(self, init=(args, kw), uid=next(_uid))

    def returns(self, *types: str) -> Module:
        """DDL of each output; native stages need only their number."""
        if len(types) == 1 and isinstance(types[0], int):
            if types[0] < 1:
                raise CompileError("a stage has at least one output")
            return replace(self, outputs=types[0], uid=next(_uid))
        return replace(self, types=types, outputs=len(types), uid=next(_uid))

    def options(self, **kw: Any) -> Module:
        """batch_size, replicas, recovery."""
        if wrong := set(kw) - {"batch_size", "replicas", "recovery"}:
            raise CompileError(f"unknown options: {sorted(wrong)}")
        for name in ("batch_size", "replicas"):
            if name in kw and (type(kw[name]) is not int or kw[name] < 1):
                raise CompileError(f"{name} is an integer from 1")
        if "recovery" in kw and not isinstance(kw["recovery"], RecoveryPolicy):
            raise CompileError("recovery is a RecoveryPolicy")
        return replace(self, uid=next(_uid), **kw)

    def __call__(self, *ports: Any, **kw: Any) -> Any:
        from ..plans.builder import active

        return active().call(self, ports, kw)


def native(fn: Callable | None = None, *, outputs: int = 1, fails: Callable | None = None, fails_group: Callable | None = None) -> Any:
    """A stage of Column expressions.  fails, fails_group: Columns to the cause's Column, null where the row doesn't fail."""
    if fn is None:
        return lambda f: native(f, outputs=outputs, fails=fails, fails_group=fails_group)
    return Module(fn, native=True, outputs=outputs, fails=fails, fails_group=fails_group)


def function(fn: Callable | None = None, *, returns: str | tuple[str, ...] = "string") -> Any:
    """A stage of a Python function of lists."""
    if fn is None:
        return lambda f: function(f, returns=returns)
    types = (returns,) if isinstance(returns, str) else tuple(returns)
    return Module(fn, types=types, outputs=len(types))


def module(cls: type, *, returns: str | tuple[str, ...] = "string") -> Module:
    """A stage of a class, made once per worker, whose run() takes lists."""
    return function(cls, returns=returns)


def _callable(m: Module) -> Callable:
    if not isinstance(m.target, type):
        return m.target
    if m.uid not in _instances:
        _instances[m.uid] = m.target(*m.init[0], **m.init[1])
    return _instances[m.uid].run


def run_rows(m: Module, layout: tuple[str | None, ...], static: dict[str, Any], rows: list[tuple]) -> list:
    """Values of the rows, each a tuple of m.outputs, or a failure."""
    call = _callable(m)
    columns = [list(c) for c in zip(*rows, strict=True)]
    args = [c for c, name in zip(columns, layout, strict=True) if name is None]
    got = call(*args, **{n: c for c, n in zip(columns, layout, strict=True) if n}, **static)
    if m.outputs == 1:
        got = (got,)
    elif not isinstance(got, (list, tuple)) or len(got) != m.outputs:
        raise BrokenContract(f"the stage has {m.outputs} outputs")
    for c in got:
        if not isinstance(c, (list, tuple)) or len(c) != len(rows):
            raise BrokenContract(f"an output is a list or tuple of {len(rows)} values")
    out = []
    for values in zip(*got, strict=True):
        group = next((v for v in values if isinstance(v, GroupFailure)), None)
        record = next((v for v in values if isinstance(v, RecordFailure)), None)
        out.append(group or record or values)
    return out


def python_stage(m: Module, layout: tuple, static: dict, inputs: list[str], outputs: list[str], types: list[pa.DataType]) -> Callable:
    """A function for mapInArrow: appends m's output structs to every batch; re-batches across parents; recovers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = lambda rows: run_rows(m, layout, static, rows)
        held: list[pa.RecordBatch] = []
        ready: list[list] = []  # [gate, cause, values or None] of each held row, in order
        late: list[list[int]] = []

        def attempt(at: list[int]) -> None:
            rows = [ready[i][3] for i in at]
            try:
                got = call(rows)
            except BrokenContract:
                raise
            except Exception:
                if m.recovery.kind == "abort":
                    raise
                if m.recovery.at_tail:
                    late.append(at)
                    return
                got = m.recovery.again(call, rows)
            for i, v in zip(at, got, strict=True):
                ready[i][2] = v

        tail = _Tail()

        def with_outputs(b: pa.RecordBatch, own: list[list]) -> pa.RecordBatch:
            cols = list(b.columns)
            for k, t in enumerate(types):
                o, v, c = [], [], []
                for gate, cause, got, _ in own:
                    failed = isinstance(got, (GroupFailure, RecordFailure))
                    o.append(gate if gate != PRESENT else "GROUP" if isinstance(got, GroupFailure) else FAILED if failed else PRESENT)
                    v.append(None if gate != PRESENT or failed else got[k])
                    c.append(cause_text(got.cause) if failed else cause)
                cols.append(pa.StructArray.from_arrays([pa.array(o, pa.string()), pa.array(v, t), pa.array(c, pa.string())], ["o", "v", "c"]))
            return pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *outputs])

        def flush() -> Iterator[pa.RecordBatch]:
            """Everything that is decided; a dispatch that waits for the end goes to the tail, as one batch."""
            if late:
                rows = pa.Table.from_batches(held)
                for at in late:
                    tail.add(rows.take(pa.array(at)).combine_chunks().to_batches()[0])
                waits = {i for at in late for i in at}
                late.clear()
            else:
                waits = set()
            first = 0
            for b in held:
                own = range(first, first + b.num_rows)
                first += b.num_rows
                if waits.isdisjoint(own):
                    yield with_outputs(b, [ready[i] for i in own])
                else:
                    kept = [i for i in own if i not in waits]
                    if kept:
                        yield with_outputs(b.take(pa.array([i - own.start for i in kept])), [ready[i] for i in kept])
            held.clear()
            ready.clear()

        def recovered() -> Iterator[pa.RecordBatch]:
            for b in tail.read():
                rows = [tuple(x["v"] for x in row) for row in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in inputs), strict=True)]
                yield with_outputs(b, [[PRESENT, None, v, None] for v in m.recovery.again(call, rows)])

        waiting: list[int] = []
        for b in batches:
            cols = [b.column(b.schema.get_field_index(n)).to_pylist() for n in inputs]
            for row in zip(*cols, strict=True):
                gate, cause = gated(row)
                ready.append([gate, cause, None, tuple(x["v"] for x in row)])
                if gate == PRESENT:
                    waiting.append(len(ready) - 1)
                    if len(waiting) >= m.batch_size:
                        attempt(waiting)
                        waiting = []
            held.append(b)
            if len(ready) >= max(20_000, 4 * m.batch_size):
                if waiting:
                    attempt(waiting)
                    waiting = []
                yield from flush()
        if waiting:
            attempt(waiting)
        yield from flush()
        yield from recovered()

    return run


class _Tail:
    """Dispatches that run again when all others are through; they wait in a file, so a task never holds its partition."""

    def __init__(self) -> None:
        self.file = self.out = None

    def add(self, batch: pa.RecordBatch) -> None:
        if self.out is None:
            self.file = tempfile.TemporaryFile()
            self.out = pa.ipc.new_stream(self.file, batch.schema)
        self.out.write_batch(batch)

    def read(self) -> Iterator[pa.RecordBatch]:
        if self.out is not None:
            self.out.close()
            self.file.seek(0)
            yield from pa.ipc.open_stream(self.file)
            self.file.close()


def gated(row: tuple[dict, ...]) -> tuple[str, str | None]:
    """Whether a stage runs on these inputs: failed before dropped before present; the first decisive input's cause."""
    for x in row:
        if x["o"] in (FAILED, SUPPRESSED):
            return SUPPRESSED, x["c"]
    return (DROPPED, None) if any(x["o"] == DROPPED for x in row) else (PRESENT, None)
