"""What a row costs doesn't grow with the table: ranges, members of a group and compiled code."""

import datetime
import os
import random
import re

import pytest
from pyspark.sql import functions as F

import strataflow as sf
from strataflow import catalogue, ops
from strataflow.operators.relational import expand_from
from strataflow.plans import lowering

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def executed(spark, make):
    """The physical plan before it adapts, with all joins shuffled."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        return make()._jdf.queryExecution().executedPlan()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def code_size(spark, plan):
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(plan)))


@tables
def test_aligned_members_are_held_once(spark):
    """reduce_aligned_members: a list for the lineitems and one for the members, sorted without a lambda."""
    plan = plan_of(catalogue.QUERIES["reduce_aligned_members"](spark, DATA))
    assert plan.count("collect_list(") == 2 and "array_sort(" not in plan


def test_members_without_an_order_of_their_own(spark):
    """Maps can't be sorted; the place in the group decides."""

    class Maps(sf.Pipeline):
        def forward(self, a):
            return ops.reduce(sf.native(lambda x: F.create_map(F.lit("k"), x))(ops.expand(sf.native(lambda x: x)(a))))

    assert Maps().run([[3, 1, 2], []], spark=spark, schema="a array<int>").outputs == [[{"k": 3}, {"k": 1}, {"k": 2}], []]


@pytest.mark.parametrize("kind", ["int", "date", "string", "double", "two"])
def test_ranges_are_found_by_halving(spark, monkeypatch, kind):
    """drop_propagation: a row is compared with as many borders as their number has binary digits."""
    monkeypatch.setattr(lowering, "RANGE", 5)
    rng = random.Random(kind)
    n, day = 400, datetime.date(2020, 1, 1)
    make = {"int": int, "date": lambda i: day + datetime.timedelta(i), "string": lambda i: f"{i:05d}é"[rng.randrange(4) :] + str(i), "double": lambda i: float("nan") if i == 7 else i / 3, "two": lambda i: i % 9}[kind]
    rows = [(make(i), i) for i in range(n)] + [(None, n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, {"two": "int", "double": "double", "string": "string", "date": "date", "int": "bigint"}[kind].join(["k ", ", i bigint"]))
    order = ["k", "i"] if kind == "two" else ["k"]
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = lowering.with_coordinates(df, order)
        plan = plan_of(got)
        assert "lambda" not in plan and len(re.findall(r"\bCASE WHEN", plan)) <= 2 * 6  # 36 borders; rows are read twice
        assert [r.i for r in got.orderBy("_k0").collect()] == [r.i for r in df.orderBy(*order).collect()]
        assert sorted(r._k0 for r in got.collect()) == list(range(n + 1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


@tables
@pytest.mark.parametrize("name", ["failure_dominates_drop", "drop_propagation", "expand_from_orders"])
def test_no_row_meets_every_border(spark, monkeypatch, name):
    monkeypatch.setattr(lowering, "RANGE", 50)  # several ranges on a small table
    plan = plan_of(catalogue.QUERIES[name](spark, DATA))
    assert "_part" in plan and "lambda" not in plan


@tables
def test_single_arrays_are_expanded_as_they_are(spark):
    """multi_output_failure: no lambda builds children; null children and empty groups stay what they are."""
    assert "lambda" not in plan_of(catalogue.QUERIES["multi_output_failure"](spark, DATA))
    same = sf.native(lambda x: x)

    class Items(sf.Pipeline):
        def forward(self, a):
            x = ops.expand(same(a))
            return x, ops.reduce(x)

    assert Items().run([[1, None, 2], [], [None]], spark=spark, schema="a array<int>").outputs == ([1, None, 2, None], [[1, None, 2], [], [None]])


@tables
def test_compiled_code_stays_in_the_jit(spark):
    """reduce_truth_table: the JVM leaves methods of more than 8000 bytes to its interpreter."""
    assert code_size(spark, executed(spark, lambda: catalogue.QUERIES["reduce_truth_table"](spark, DATA))) < 8000


@tables
@pytest.mark.parametrize("name", ["reduce_empty_groups", "reduce_value_dropped", "record_failure_reduce"])
def test_coordinates_come_from_orders_alone(spark, name):
    """No window has a join with lineitems below it."""
    lines = plan_of(catalogue.QUERIES[name](spark, DATA)).split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for k, x in enumerate(lines):
        if "Window [row_number" in x:
            below = lines[k + 1 :]
            end = next((j for j, y in enumerate(below) if depth(y) <= depth(x)), len(below))
            assert not any("Join" in y or "l_orderkey" in y for y in below[:end])


def test_children_move_once(spark):
    """expand_from_orders: dealt by the parent's key for the join, and not again; a repeated key has a group for each parent."""
    parents = spark.createDataFrame([(0, 10), (1, 20), (2, 10)], "_k0 bigint, k bigint")
    children = spark.createDataFrame([(10, 2), (10, 1), (20, 5), (30, 1)], "ck bigint, n bigint")
    make = lambda: expand_from(parents, children, "k", "ck", ["n"], F.col("n"))
    assert executed(spark, make).toString().count("Exchange hashpartitioning") == 2
    got = sorted((r._k0, r._k1, r.v) for r in make().collect())
    assert got == [(0, 0, 1), (0, 1, 2), (1, 0, 5), (2, 0, 1), (2, 1, 2)]
