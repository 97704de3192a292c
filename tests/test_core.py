import itertools
import random
import sys

import pytest
from pyspark import cloudpickle

import strataflow as sf
from strataflow import GroupFailure, OutputIssue, Pipeline, RecordFailure, RecoveryPolicy, ops
from strataflow.functions.stages import gated

D = OutputIssue("DROPPED")
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this module


def run(spark, forward, *cols, **how):
    pipeline = type("P", (Pipeline,), {"forward": lambda self, *ports: forward(*ports), "sources": len(cols)})
    return pipeline().run(*cols, spark=spark, **how).outputs


# ---- a small interpreter of the outcome rules, on nested Python lists, beside the engine

class Item:
    def __init__(self, outcome, value=None, cause=None):
        self.outcome, self.value, self.cause = outcome, value, cause

    def shown(self):
        return self.value if self.outcome == "PRESENT" else OutputIssue(self.outcome, self.cause)


def calls(fn, rows, groups):
    """fn of each row of Items whose inputs are all present; groups: of each row, its siblings' number."""
    out = []
    for row in rows:
        bad = next((x for x in row if x.outcome in ("FAILED", "SUPPRESSED")), None)
        if bad:
            out.append(Item("SUPPRESSED", None, bad.cause))
        elif any(x.outcome == "DROPPED" for x in row):
            out.append(Item("DROPPED"))
        else:
            v = fn(*[x.value for x in row])
            out.append(Item("FAILED", v, v.cause) if isinstance(v, (RecordFailure, GroupFailure)) else Item("PRESENT", v))
    for g in set(groups):
        own = [x for x, k in zip(out, groups) if k == g]
        barrier = next((x for x in own if isinstance(x.value, GroupFailure)), None)
        for x in own if barrier else ():
            if x.outcome == "PRESENT":
                x.outcome, x.cause = "SUPPRESSED", barrier.cause
    return out


def masked(items, masks):
    out = []
    for x, m in zip(items, masks):
        bad = next((y for y in (x, m) if y.outcome in ("FAILED", "SUPPRESSED")), None)
        drop = "DROPPED" in (x.outcome, m.outcome) or not bad and m.value is False
        out.append(Item("SUPPRESSED", None, bad.cause) if bad and bad is m else x if bad else Item("DROPPED") if drop else x)
    return out


def collected(parents, children):
    """Lists of the present children's values; a failed child suppresses, a parent that isn't present gives its own outcome."""
    out = []
    for p, own in zip(parents, children):
        if p.outcome != "PRESENT":
            out.append(Item("DROPPED") if p.outcome == "DROPPED" else Item("SUPPRESSED", None, p.cause))
            continue
        bad = next((x for x in own if x.outcome in ("FAILED", "SUPPRESSED")), None)
        out.append(Item("SUPPRESSED", None, bad.cause) if bad else Item("PRESENT", [x.value for x in own if x.outcome == "PRESENT"]))
    return out


def cut(v):
    return RecordFailure(f"no cut of {v}") if v % 11 == 7 else [v * 3 + k for k in range(v % 5)]


def price(v, limit):
    if v % 17 == 3:
        return RecordFailure(f"odd {v}")
    return GroupFailure(f"spoilt {v}") if v % 23 == 5 else v - limit


@pytest.mark.parametrize("seed", range(4))
def test_engine_against_an_interpreter(spark, seed):
    """Two levels with empty groups, masks, failures of both kinds, and a broadcast, in one pipeline."""
    r = random.Random(seed)
    roots, limits = [r.randrange(60) for _ in range(25)], [r.randrange(9) for _ in range(25)]
    stage = lambda fn, kind: sf.function(lambda *cols, fn=fn: [fn(*x) for x in zip(*cols)], returns=kind).options(batch_size=r.choice([1, 3, 50]))

    def forward(root, limit):
        top = ops.expand(stage(cut, "array<int>")(root))
        kept = ops.filter(top, sf.native(lambda v: v % 4 != 1)(top))
        low = ops.expand(stage(cut, "array<int>")(kept))
        paid = stage(price, "int")(low, ops.broadcast(limit, low))
        inner = ops.reduce(paid)
        return kept, paid, inner, ops.reduce(inner)

    got = run(spark, forward, roots, limits, schema="a int, b int")
    present = lambda vs: [Item("PRESENT", v) for v in vs]
    tops = calls(cut, [(x,) for x in present(roots)], range(25))
    top = [present(x.value) if x.outcome == "PRESENT" else [] for x in tops]
    flat, of = [x for own in top for x in own], [i for i, own in enumerate(top) for _ in own]
    kept = masked(flat, [Item("PRESENT", x.value % 4 != 1) for x in flat])
    lows = calls(cut, [(x,) for x in kept], of)
    low = [present(x.value) if x.outcome == "PRESENT" else [] for x in lows]
    under, where = [x for own in low for x in own], [i for i, own in enumerate(low) for _ in own]
    paid = calls(price, [(x, Item("PRESENT", limits[of[i]])) for x, i in zip(under, where)], where)
    inner = collected(lows, [[p for p, i in zip(paid, where) if i == k] for k in range(len(lows))])
    outer = collected(tops, [[x for x, i in zip(inner, of) if i == k] for k in range(25)])
    for mine, theirs in zip((kept, paid, inner, outer), got, strict=True):
        assert [x.shown() for x in mine] == theirs


def test_null_is_a_value_and_masks_keep_places(spark):
    half = sf.function(lambda x: [None if v % 2 else v // 2 for v in x], returns="int")
    some = sf.native(lambda v: v > 4)
    assert run(spark, lambda v: (half(v), ops.filter(half(v), some(v))), [3, 4, 9, 12]) == ([None, 2, None, 6], [D, D, None, 6])


def test_tail_recovery_in_a_large_partition(spark):
    """One dispatch of many fails; only it waits for the end, and places stay."""

    def f(x):
        if 40_004 in x:
            raise KeyError("sour")
        return [v + 1 for v in x]

    values = list(range(60_000))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    for policy, bad in ((RecoveryPolicy.isolate_tail(), [40_004]),):
        out = run(spark, lambda v, policy=policy: sf.function(f, returns="int").options(batch_size=100, recovery=policy)(v), values)
        assert [i for i, x in enumerate(out) if isinstance(x, OutputIssue)] == bad
        assert [x for i, x in enumerate(out) if i not in bad] == [v + 1 for v in values if v not in bad]
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_retry_at_the_tail(spark, tmp_path):
    """A dispatch that fails once is run again after all others."""
    mark = str(tmp_path / "failed")

    def f(x):
        import os

        if 5 in x and not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("once")
        return [v * v for v in x]

    m = sf.function(f, returns="int").options(batch_size=3, recovery=RecoveryPolicy.retry_tail(1))
    assert run(spark, lambda v: m(v), list(range(10))) == [v * v for v in range(10)]


def test_halving_finds_each_bad_row():
    tried = []

    def call(rows):
        tried.append([r[0] for r in rows])
        if any(r[0] in "fh" for r in rows):
            raise ValueError("sour")
        return [r[0].upper() for r in rows]

    got = RecoveryPolicy.isolate_tail().again(call, [(c,) for c in "abcdefgh"])
    assert [x if isinstance(x, str) else None for x in got] == ["A", "B", "C", "D", "E", None, "G", None]
    assert tried[0] == list("abcdefgh") and ["a", "b", "c", "d"] in tried and ["f"] in tried and ["h"] in tried


class ContractError(Exception):
    """A user's own error of the same name."""


def test_abort_and_contract(spark):
    def boom(x):
        raise ValueError("boom")

    with pytest.raises(sf.ExecutionError):
        run(spark, lambda v: sf.function(boom, returns="int")(v), [1])
    with pytest.raises(sf.ContractError):
        run(spark, lambda v: sf.function(lambda x: [], returns="int")(v), [1, 2])

    def mine(x):
        raise ContractError("mine")

    def theirs(x):
        raise sf.ContractError("strataflow.failures.BrokenContract said in the text")

    for fn in (mine, theirs):  # told apart by type: these are a stage's own errors
        with pytest.raises(sf.ExecutionError):
            run(spark, lambda v, fn=fn: sf.function(fn, returns="int")(v), [1])
        again = sf.function(fn, returns="int").options(recovery=RecoveryPolicy.isolate_tail())
        assert all(x.outcome == "FAILED" for x in run(spark, lambda v, again=again: again(v), [1, 2]))


def test_multi_output_and_static(spark):
    m = sf.function(lambda x, k=1: ([v + k for v in x], [RecordFailure(17) if v == 2 else v for v in x]), returns=("int", "int"))
    a, b = run(spark, lambda v: m(v, k=5), [1, 2])
    assert a == [6, OutputIssue("FAILED", "17")] and b == [1, OutputIssue("FAILED", "17")]


def test_class_stage_and_batches(spark):
    class Add:
        def __init__(self, k):
            self.k = k

        def run(self, x):
            return [v + self.k for v in x]

    p = sf.module(Add, returns="int").pre_init(3)
    assert run(spark, lambda v: p(v), list(range(15)), input_batch_size=4) == list(range(3, 18))
    assert run(spark, lambda v: p(v), [], schema="a int") == []


def test_gate_table():
    for row in itertools.product(("PRESENT", "DROPPED", "FAILED", "SUPPRESSED"), repeat=2):
        o, _ = gated(tuple({"o": x, "c": x} for x in row))
        bad = {"FAILED", "SUPPRESSED"} & set(row)
        assert o == ("SUPPRESSED" if bad else "DROPPED" if "DROPPED" in row else "PRESENT")


def _compile(fn):
    class P(Pipeline):
        def forward(self, a):
            return fn(a)

    return P().compile()


def test_compile_checks():
    m = sf.native(lambda x: x)
    group = sf.native(lambda x: x)
    for bad in (
        lambda a: m(),
        lambda a: m(1),
        lambda a: m(a, k=[a]),
        lambda a: ops.expand(a),
        lambda a: (),
        lambda a: ops.reduce(a),
        lambda a: m(a, ops.expand(group(a))),
        lambda a: ops.broadcast(ops.expand(group(a)), a),
        lambda a: ops.filter(a, ops.expand(group(a))),
        lambda a: ops.expand_aligned(group(a), group(a)),
    ):
        with pytest.raises(sf.CompileError):
            _compile(bad)
    with pytest.raises(TypeError):
        _compile(lambda a: a if a else a)
    with pytest.raises(sf.CompileError):
        ops.expand(None)


def test_interning_and_rewrite():
    def forward(a):
        x = ops.expand(sf.native(lambda v: v)(a))
        y = ops.expand(sf.native(lambda v: v)(x))
        assert ops.filter(x, x) is ops.filter(x, x)
        assert ops.broadcast(a, a) is a
        z = ops.broadcast(ops.broadcast(a, x), y)
        assert z is ops.broadcast(a, y)
        return z

    assert "rewrite" in _compile(forward).explain_text()


def test_policy_checks():
    for bad in (("abort", 1), ("retry_batch", 0), ("isolate_tail", 2), ("other", 0)):
        with pytest.raises(ValueError):
            RecoveryPolicy(*bad)
    with pytest.raises(ValueError):
        RecoveryPolicy("retry_batch", True)
