"""Queries of the dataflow operators over the test tables, each with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .failures import RecordFailure
from .functions.recovery import RecoveryPolicy
from .functions.stages import function, native
from .operators import structural as ops
from .operators.relational import expand_from, uncommitted
from .pipeline import Pipeline, Plan
from .plans.lowering import with_coordinates
from .workloads import captions, documents, models, topology

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: documents with their coordinate, and their lines; benchmark items likewise, with the words of their lines
_D = "d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS k0, * FROM documents)"
_L = _D + ", l AS (SELECT k0, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k1 FROM d)"
_B = "b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS k0, * FROM benchmark), bl AS (SELECT k0, item_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k1 FROM b), bw AS (SELECT k0, k1, item_id, unnest(string_split(line, ' ')) AS w, generate_subscripts(string_split(line, ' '), 1) - 1 AS k2 FROM bl)"
_O = "o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS k0, * FROM orders), i AS (SELECT k0, o_orderkey, l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS k1 FROM lineitem l JOIN o ON l_orderkey = o_orderkey)"


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = "WITH " + sql if not sql.lstrip().upper().startswith("SELECT") else sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def plan(forward: Callable, source: DataFrame, columns: list[str], order: list[str]) -> Plan:
    query = type("Query", (Pipeline,), {"forward": lambda self, *ports: forward(*ports), "sources": len(columns)})
    return query().plan(source, columns, order)


def docs(spark: SparkSession, d: str, forward: Callable, *columns: str) -> Plan:
    return plan(forward, table(spark, d, "documents"), list(columns) or ["text"], ["doc_id"])


def items(spark: SparkSession, d: str, forward: Callable, *columns: str) -> Plan:
    return plan(forward, table(spark, d, "benchmark"), list(columns) or ["text"], ["item_id"])


def orders(spark: SparkSession, d: str, forward: Callable) -> Plan:
    """Sources: o_orderkey, o_orderstatus, and the order's lineitems as an ordered array (empty for none).  Coordinates come
    from the orders alone, so that no reading for them groups lineitems."""
    own = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag"]
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*own))).alias("lines"))
    kind = "array<struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in lines.schema["lines"].dataType.elementType.fields) + ">>"
    numbered = with_coordinates(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])
    src = numbered.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("lines", F.coalesce("lines", F.array().cast(kind)))
    return plan(forward, src, ["o_orderkey", "o_orderstatus", "lines"], ["o_orderkey"])


lines_of = native(lambda t: F.split(t, "\n", -1))
words_of = native(lambda t: F.split(t, " ", -1))
length = native(lambda t: F.length(t).cast("long"))
keep_array = native(lambda x: x)


def flat(df: DataFrame, *cols) -> DataFrame:
    return df.select(*[F.col(c).alias(c[1:]) for c in df.columns if c.startswith("_k")], *cols)


# ---- sources and calls

@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS k0, doc_id FROM documents")
def source_coordinates(spark, d):
    return flat(docs(spark, d, lambda x: x, "doc_id").output(), F.col("v").alias("doc_id"))


@query("SELECT k0, doc_id, k0 // 24 AS batch FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS k0, doc_id FROM documents)")
def input_batches(spark, d):
    return flat(with_coordinates(table(spark, d, "documents").select("doc_id"), ["doc_id"]), "doc_id", F.floor(F.col("_k0") / 24).alias("batch"))


@query(_D + " SELECT k0, 'PRESENT' AS o, lang || '-' || source AS v FROM d")
def call_native(spark, d):
    join = native(lambda a, b: F.concat(a, F.lit("-"), b))
    return flat(docs(spark, d, lambda a, b: join(a, b), "lang", "source").output(), "o", "v")


@query(_D + " SELECT k0, n_chars * 2 AS twice, length(text) AS n FROM d")
def call_multi_output(spark, d):
    both = native(lambda n, t: (n * 2, F.length(t).cast("long")), outputs=2)
    return flat(docs(spark, d, lambda n, t: both(n, t), "n_chars", "text").frames((0,), (1,)), F.col("v0").alias("twice"), F.col("v1").alias("n"))


@query(_D + " SELECT k0, doc_id * 10 + n_chars + 7 AS v FROM d")
def call_keyword_static(spark, d):
    add = native(lambda x, by=0, plus=0: x * 10 + by + F.lit(plus))
    return flat(docs(spark, d, lambda a, b: add(a, by=b, plus=7), "doc_id", "n_chars").output(), "v")


@query(_D + " SELECT k0, CAST(len(string_split(text, ' ')) AS BIGINT) AS v FROM d")
def call_python_batch(spark, d):
    count = function(lambda t: [len(x.split(" ")) for x in t], returns="bigint").options(batch_size=64)
    return flat(docs(spark, d, lambda t: count(t)).output(), "v")


# ---- structure

@query(_L + " SELECT k0, k1, line AS v FROM l")
def expand_lines(spark, d):
    return flat(docs(spark, d, lambda t: ops.expand(lines_of(t))).output(), "v")


@query(_B + " SELECT k0, row_number() OVER (PARTITION BY k0 ORDER BY k1, k2) - 1 AS k1, w, CAST(length(w) AS BIGINT) AS n FROM bw")
def expand_aligned_words(spark, d):
    def forward(t):
        split = native(lambda x: (F.split(x, "[ \n]", -1), F.transform(F.split(x, "[ \n]", -1), lambda w: F.length(w).cast("long"))), outputs=2)
        return ops.expand_aligned(*split(t))

    return flat(items(spark, d, forward).frames((0,), (1,)), F.col("v0").alias("w"), F.col("v1").alias("n"))


@query(_O + " SELECT k0, k1, l_partkey AS v FROM i")
def expand_from_orders(spark, d):
    parents = with_coordinates(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
    rows = expand_from(parents, table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], F.col("l_partkey"))
    return flat(rows, "v")


_long = native(lambda t: F.length(t) > 100)


@query(_L + " SELECT k0, k1, CASE WHEN length(line) > 100 THEN 'PRESENT' ELSE 'DROPPED' END AS o, CASE WHEN length(line) > 100 THEN length(line) END AS n FROM l")
def filter_outcomes(spark, d):
    def forward(t):
        line = ops.expand(lines_of(t))
        return ops.filter(length(line), _long(line))

    return flat(docs(spark, d, forward).output(), "o", F.col("v").alias("n"))


@query(_L + " SELECT k0, k1, CASE WHEN length(line) > 100 AND length(line) % 2 = 0 THEN 'PRESENT' ELSE 'DROPPED' END AS o FROM l")
def filter_chained(spark, d):
    def forward(t):
        line = ops.expand(lines_of(t))
        return ops.filter(ops.filter(line, _long(line)), native(lambda x: F.length(x) % 2 == 0)(line))

    return flat(docs(spark, d, forward).output(), "o")


@query(_L + " SELECT k0, k1, CASE WHEN length(line) % 5 = 0 THEN 'FAILED' WHEN length(line) > 100 THEN 'PRESENT' ELSE 'DROPPED' END AS o, CASE WHEN length(line) % 5 = 0 THEN 'mask ' || length(line) END AS c FROM l")
def filter_failed_mask(spark, d):
    bad = native(lambda x: F.length(x) > 100, fails=lambda x: F.when(F.length(x) % 5 == 0, F.concat(F.lit("mask "), F.length(x).cast("string"))))

    def forward(t):
        line = ops.expand(lines_of(t))
        return ops.filter(line, bad(line))

    return flat(docs(spark, d, forward).output(), "o", "c")


@query(_L + " SELECT k0, k1, lang AS v FROM l")
def broadcast_parent(spark, d):
    return flat(docs(spark, d, lambda t, g: ops.broadcast(g, ops.expand(lines_of(t))), "text", "lang").output(), "v")


@query(_B + " SELECT k0, k1, k2, item_id AS v FROM bw")
def broadcast_two_level(spark, d):
    return flat(items(spark, d, lambda t, i: ops.broadcast(i, ops.expand(words_of(ops.expand(lines_of(t))))), "text", "item_id").output(), "v")


@query(_B + " SELECT k0, k1, k2, item_id + length(line) AS v FROM bw JOIN bl USING (k0, k1, item_id)")
def broadcast_chain(spark, d):
    def forward(t, i):
        line = ops.expand(lines_of(t))
        word = ops.expand(words_of(line))
        total = native(lambda a, b: a + F.length(b))
        return total(ops.broadcast(ops.broadcast(i, line), word), ops.broadcast(line, word))

    return flat(items(spark, d, forward, "text", "item_id").output(), "v")


@query(_L + " SELECT k0, 'PRESENT' AS o, coalesce(string_agg(line, chr(10) ORDER BY k1) FILTER (WHERE length(line) > 100), '') AS v FROM l GROUP BY k0")
def reduce_ordered(spark, d):
    def forward(t):
        line = ops.expand(lines_of(t))
        return ops.reduce(ops.filter(line, _long(line)))

    return flat(docs(spark, d, forward).output(), "o", F.array_join("v", "\n").alias("v"))


@query(_O + " SELECT o.k0, count(k1) AS n, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY k1), '') AS v FROM o LEFT JOIN i ON o.k0 = i.k0 GROUP BY o.k0")
def reduce_empty_groups(spark, d):
    number = native(lambda x: x["l_linenumber"])
    out = orders(spark, d, lambda k, s, ls: ops.reduce(number(ops.expand(keep_array(ls))))).output()
    return flat(out, F.size("v").cast("long").alias("n"), F.array_join(F.col("v").cast("array<string>"), ",").alias("v"))


@query(_O + " SELECT o.k0, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY k1) FILTER (WHERE l_quantity > 25), '') AS parts, coalesce(string_agg(l_returnflag, ',' ORDER BY k1) FILTER (WHERE l_quantity > 25), '') AS flags FROM o LEFT JOIN i ON o.k0 = i.k0 GROUP BY o.k0")
def reduce_aligned_members(spark, d):
    def forward(k, s, ls):
        line = ops.expand(keep_array(ls))
        part, flag, many = native(lambda x: (x["l_partkey"], x["l_returnflag"], x["l_quantity"] > 25), outputs=3)(line)
        return ops.reduce_aligned(part, flag, members=ops.filter(line, many))

    out = orders(spark, d, forward).frames((0,), (1,))
    return flat(out, F.array_join(F.col("v0").cast("array<string>"), ",").alias("parts"), F.array_join("v1", ",").alias("flags"))


@query(_B + ", g AS (SELECT k0, k1, string_agg(CAST(length(w) AS VARCHAR), ',' ORDER BY k2) AS s FROM bw GROUP BY k0, k1) SELECT k0, string_agg(s, '|' ORDER BY k1) AS v FROM g GROUP BY k0")
def reduce_nested(spark, d):
    out = items(spark, d, lambda t: ops.reduce(ops.reduce(length(ops.expand(words_of(ops.expand(lines_of(t)))))))).output()
    return flat(out, F.array_join(F.transform("v", lambda x: F.array_join(x.cast("array<string>"), ",")), "|").alias("v"))


@query(_D + " SELECT k0, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n FROM d")
def group_value_port(spark, d):
    def forward(t):
        group = lines_of(t)
        ops.expand(group)
        return native(lambda g: F.size(g).cast("long"))(group)

    return flat(docs(spark, d, forward).output(), F.col("v").alias("n"))


@query(_L + " SELECT CASE WHEN length(line) % 5 = 0 THEN 'FAILED' WHEN length(line) > 100 THEN 'PRESENT' ELSE 'DROPPED' END AS o, count(*) AS n FROM l GROUP BY 1")
def output_issues(spark, d):
    return filter_failed_mask(spark, d).groupBy("o").agg(F.count("*").alias("n"))


# ---- outcomes

def _outcome(x, pick: int):
    """A port whose outcome follows a key's base-4 digit: 0 present, 1 dropped, 2 failed, 3 suppressed."""
    digit = lambda v: F.floor(v / 4**pick) % 4
    gone = native(lambda v: v, fails=lambda v: F.when(digit(v) == 3, f"up{pick}"))(x)
    fail = native(lambda a, v: a, fails=lambda a, v: F.when(digit(v) == 2, f"bad{pick}"))(gone, x)
    return ops.filter(fail, native(lambda v: digit(v) != 1)(x))


@query("n AS (SELECT n_nationkey AS k0, n_nationkey % 4 AS a, n_nationkey // 4 % 4 AS b FROM nation) SELECT CAST(k0 AS BIGINT) AS k0, CASE WHEN a >= 2 OR b >= 2 THEN 'SUPPRESSED' WHEN a = 1 OR b = 1 THEN 'DROPPED' ELSE 'PRESENT' END AS o, CASE WHEN a = 2 THEN 'bad0' WHEN a = 3 THEN 'up0' WHEN b = 2 THEN 'bad1' WHEN b = 3 THEN 'up1' END AS c FROM n")
def call_gate_truth_table(spark, d):
    both = native(lambda a, b: a + b)
    return flat(plan(lambda x: both(_outcome(x, 0), _outcome(x, 1)), table(spark, d, "nation"), ["n_nationkey"], ["n_nationkey"]).output(), "o", "c")


@query(_O + ", m AS (SELECT k0, k1, l_linenumber % 4 AS a, l_partkey % 4 AS b FROM i), g AS (SELECT k0, min(k1) FILTER (WHERE a >= 2) AS bm, arg_min(CASE WHEN a = 2 THEN 'bad0' ELSE 'up0' END, k1) FILTER (WHERE a >= 2) AS bmc, min(k1) FILTER (WHERE a = 0 AND b > 0) AS bv, arg_min(CASE b WHEN 2 THEN 'bad1' WHEN 3 THEN 'up1' END, k1) FILTER (WHERE a = 0 AND b > 0 ) AS bvc0, count(*) FILTER (WHERE a = 0) AS n FROM m GROUP BY k0), f AS (SELECT g.*, (SELECT CASE b WHEN 2 THEN 'bad1' WHEN 3 THEN 'up1' END FROM m WHERE m.k0 = g.k0 AND m.k1 = g.bv) AS bvc FROM g) SELECT o.k0, CASE WHEN bm IS NOT NULL OR bv IS NOT NULL THEN 'SUPPRESSED' ELSE 'PRESENT' END AS o, CASE WHEN bm IS NOT NULL THEN bmc WHEN bv IS NOT NULL THEN bvc END AS c, CASE WHEN bm IS NULL AND bv IS NULL THEN coalesce(n, 0) END AS n FROM o LEFT JOIN f ON o.k0 = f.k0")
def reduce_truth_table(spark, d):
    def forward(k, s, ls):
        line = ops.expand(keep_array(ls))
        code = native(lambda x: x["l_linenumber"] % 4 + 4 * (x["l_partkey"] % 4))(line)
        return ops.reduce(_outcome(code, 1), members=_outcome(code, 0))

    return flat(orders(spark, d, forward).output(), "o", "c", F.when(F.col("o") == "PRESENT", F.size("v").cast("long")).alias("n"))


@query(_O + " SELECT k0, CASE WHEN o_orderstatus = 'F' THEN 'DROPPED' ELSE 'PRESENT' END AS o, CASE WHEN o_orderstatus <> 'F' THEN o_orderkey * 2 END AS v FROM o")
def drop_propagation(spark, d):
    def forward(k, s, ls):
        return native(lambda a, b: a + b)(ops.filter(k, native(lambda x: x != "F")(s)), k)

    return flat(orders(spark, d, forward).output(), "o", "v")


@query(_O + " SELECT k0, CASE WHEN o_orderkey % 3 = 0 THEN 'SUPPRESSED' WHEN o_orderstatus = 'F' THEN 'DROPPED' ELSE 'PRESENT' END AS o, CASE WHEN o_orderkey % 3 = 0 THEN 'bad ' || o_orderkey END AS c FROM o")
def failure_dominates_drop(spark, d):
    bad = native(lambda x: x, fails=lambda x: F.when(x % 3 == 0, F.concat(F.lit("bad "), x.cast("string"))))

    def forward(k, s, ls):
        return native(lambda a, b: a + b)(ops.filter(k, native(lambda x: x != "F")(s)), bad(k))

    return flat(orders(spark, d, forward).output(), "o", "c")


_cause = lambda x: F.concat(F.lit("line "), x["l_linenumber"].cast("string"))
_GROUP = ", g AS (SELECT k0, arg_min('line ' || l_linenumber, k1) FILTER (WHERE {bad}) AS c, count(*) AS n FROM i GROUP BY k0) "


@query(_O + _GROUP.format(bad="l_returnflag = 'R'") + "SELECT o.k0, CASE WHEN c IS NULL THEN 'PRESENT' ELSE 'SUPPRESSED' END AS o, c, CASE WHEN c IS NULL THEN coalesce(n, 0) END AS n FROM o LEFT JOIN g ON o.k0 = g.k0")
def record_failure_reduce(spark, d):
    read = native(lambda x: x["l_partkey"], fails=lambda x: F.when(x["l_returnflag"] == "R", _cause(x)))
    out = orders(spark, d, lambda k, s, ls: ops.reduce(read(ops.expand(keep_array(ls))))).output()
    return flat(out, "o", "c", F.when(F.col("o") == "PRESENT", F.size("v").cast("long")).alias("n"))


@query(_O + " SELECT k0, k1, CASE WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'PRESENT' END AS o0, CASE WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'PRESENT' END AS o1, CASE WHEN l_returnflag <> 'R' THEN l_suppkey END AS v1 FROM i")
def multi_output_failure(spark, d):
    read = native(lambda x: (x["l_partkey"], x["l_suppkey"]), outputs=2, fails=lambda x: F.when(x["l_returnflag"] == "R", _cause(x)))
    return flat(orders(spark, d, lambda k, s, ls: read(ops.expand(keep_array(ls)))).frames((0,), (1,)), "o0", "o1", "v1")


@query(_O + " SELECT o.k0, CASE WHEN any_value(o_orderstatus) = 'P' THEN 'SUPPRESSED' WHEN any_value(o_orderstatus) = 'F' THEN 'DROPPED' ELSE 'PRESENT' END AS o, CASE WHEN any_value(o_orderstatus) = 'P' THEN 'pending' END AS c, CASE WHEN any_value(o_orderstatus) NOT IN ('P', 'F') THEN count(k1) END AS n FROM o LEFT JOIN i ON o.k0 = i.k0 GROUP BY o.k0")
def failed_expand_reduce(spark, d):
    group = native(lambda x, s: x, fails=lambda x, s: F.when(s == "P", "pending"))

    def forward(k, s, ls):
        return ops.reduce(ops.expand(group(ops.filter(ls, native(lambda x: x != "F")(s)), s)))

    out = orders(spark, d, forward).output()
    return flat(out, "o", "c", F.when(F.col("o") == "PRESENT", F.size("v").cast("long")).alias("n"))


@query(_O + " SELECT o.k0, CASE WHEN count(*) FILTER (WHERE l_quantity > 45) > 0 THEN 'SUPPRESSED' ELSE 'PRESENT' END AS o, CAST(NULL AS VARCHAR) AS c FROM o LEFT JOIN i ON o.k0 = i.k0 GROUP BY o.k0")
def reduce_value_dropped(spark, d):
    def forward(k, s, ls):
        line = ops.expand(keep_array(ls))
        return ops.reduce(ops.filter(line, native(lambda x: x["l_quantity"] <= 45)(line)), members=line)

    return flat(orders(spark, d, forward).output(), "o", "c")


@query(_O + ", g AS (SELECT k0, arg_min('line ' || l_linenumber, k1) AS c FROM i WHERE l_quantity >= 49 GROUP BY k0) SELECT k0, k1, CASE WHEN l_quantity >= 49 THEN 'FAILED' WHEN g.c IS NOT NULL THEN 'SUPPRESSED' ELSE 'PRESENT' END AS o, CASE WHEN l_quantity >= 49 THEN 'line ' || l_linenumber ELSE g.c END AS c FROM i LEFT JOIN g USING (k0)")
def group_failure_siblings(spark, d):
    read = native(lambda x: x["l_partkey"], fails_group=lambda x: F.when(x["l_quantity"] >= 49, _cause(x)))
    return flat(orders(spark, d, lambda k, s, ls: read(ops.expand(keep_array(ls)))).output(), "o", "c")


def _poisoned(xs):
    if any(x % 97 == 5 for x in xs):
        raise ValueError(f"poison {[x for x in xs if x % 97 == 5][0]}")
    return [x * 10 for x in xs]


@query(_D + " SELECT k0, CASE WHEN doc_id % 97 = 5 THEN 'FAILED' ELSE 'PRESENT' END AS o, CASE WHEN doc_id % 97 = 5 THEN 'builtins.ValueError: poison ' || doc_id END AS c, CASE WHEN doc_id % 97 <> 5 THEN doc_id * 10 END AS v FROM d")
def recovery_isolate(spark, d):
    stage = function(_poisoned, returns="bigint").options(batch_size=16, recovery=RecoveryPolicy.isolate_tail())
    return flat(docs(spark, d, lambda x: stage(x), "doc_id").output(), "o", "c", "v")


@query(_D + " SELECT k0, 'PRESENT' AS o, doc_id + 1 AS v FROM d")
def recovery_retry(spark, d):
    seen: set[int] = set()

    def flaky(xs):
        if xs[0] not in seen:
            seen.add(xs[0])
            raise OSError("first attempt")
        return [x + 1 for x in xs]

    stage = function(flaky, returns="bigint").options(batch_size=32, recovery=RecoveryPolicy.retry_batch(2))
    return flat(docs(spark, d, lambda x: stage(x), "doc_id").output(), "o", "v")


@query(_D + " SELECT k0, CASE WHEN doc_id % 11 = 3 THEN 'FAILED' ELSE 'PRESENT' END AS o, CASE WHEN doc_id % 11 = 3 THEN 'id ' || doc_id END AS c FROM d")
def record_failure_python(spark, d):
    stage = function(lambda xs: [RecordFailure(f"id {x}") if x % 11 == 3 else x for x in xs], returns="bigint")
    return flat(docs(spark, d, lambda x: stage(x), "doc_id").output(), "o", "c")


@query(_D + " SELECT k0, ((doc_id + 1) * 2 - 3) * ((doc_id + 1) * 2 - 3) AS v FROM d")
def shared_stage_pipeline(spark, d):
    step = native(lambda x, by=1, plus=0: x * F.lit(by) + F.lit(plus))
    return flat(docs(spark, d, lambda x: native(lambda y: y * y)(step(step(step(x, plus=1), by=2), plus=-3)), "doc_id").output(), "v")


@query(_D + " SELECT k0, 11 * doc_id + 1 AS v FROM d")
def branch_join(spark, d):
    def forward(x):
        return native(lambda a, b: a + b)(native(lambda v: v * 10)(x), native(lambda v: v + 1)(x))

    return flat(docs(spark, d, forward, "doc_id").output(), "v")


# ---- workloads

@query("n AS (SELECT n_nationkey AS k, p, CASE WHEN (n_nationkey + p) % 3 = 1 THEN 0 ELSE 2 END AS t FROM nation, range(3) r(p)), g AS (SELECT k, p, CASE t WHEN 0 THEN '' ELSE '0,1' END AS s FROM n) SELECT CAST(k AS BIGINT) AS k0, 'doc-' || k AS name, string_agg(s, '|' ORDER BY p) AS tables, 3 AS pages FROM g GROUP BY k")
def w_document_topology(spark, d):
    src = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("doc-"), F.col("n_nationkey").cast("string")).alias("name"), F.array(*[F.when((F.col("n_nationkey") + p) % 3 == 1, 0).otherwise(2) for p in range(3)]).alias("counts"))
    out = topology.DocumentTopology().plan(src, ["name", "counts"], ["n_nationkey"]).frames((0,), (1,), (2,))
    return flat(out, F.col("v0").alias("name"), F.col("v1").alias("tables"), F.col("v2").alias("pages"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS k0, coalesce((SELECT string_agg(n_name || '#' || f, ' ' ORDER BY f) FROM range(n_nationkey % 5) r(f)), '') AS v FROM nation")
def w_video_caption(spark, d):
    src = table(spark, d, "nation").withColumn("n", F.col("n_nationkey") % 5)
    return flat(topology.VideoCaption().plan(src, ["n_name", "n"], ["n_nationkey"]).output(), "v")


@query("SELECT CAST(n_nationkey AS BIGINT) AS k0, n_name || ':' || coalesce((SELECT string_agg('f' || f, ',' ORDER BY f) FROM range(n_nationkey % 5) r(f)), '') || ';' || coalesce((SELECT string_agg('a' || f, ',' ORDER BY f) FROM range(n_nationkey % 3) r(f)), '') AS v FROM nation")
def w_video_multimodal(spark, d):
    src = table(spark, d, "nation").withColumn("f", F.col("n_nationkey") % 5).withColumn("a", F.col("n_nationkey") % 3)
    return flat(topology.VideoMultimodal().plan(src, ["n_name", "f", "a"], ["n_nationkey"]).output(), "v")


@query("g AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS t, count(*) AS n FROM conversations GROUP BY conv_id) SELECT row_number() OVER (ORDER BY conv_id) - 1 AS k0, 'conv-' || conv_id AS path, CAST(length(t) AS BIGINT) AS chars, n AS pages FROM g")
def w_page_assemble(spark, d):
    src = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("pages")).withColumn("path", F.concat(F.lit("conv-"), F.col("conv_id").cast("string")))
    out = documents.PageAssembly().plan(src, ["path", "pages"], ["conv_id"]).frames((0,), (1,), (2,))
    return flat(out, F.col("v0")["path"].alias("path"), F.col("v1").cast("long").alias("chars"), F.col("v2").cast("long").alias("pages"))


@query("SELECT page_id, CASE WHEN contains(n, '.') THEN regexp_replace(n, '\\.[^.]*$', '') ELSE n END AS stem FROM (SELECT page_id, 'page-' || regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS n FROM pages)")
def w_stem(spark, d):
    bare = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, d, "pages").select("page_id", documents.stem(F.concat(F.regexp_extract(bare, r"^(.*/)[^/]*$", 1), F.lit("page-"), F.regexp_extract(bare, r"([^/]*)$", 1))).alias("stem"))


_TOK = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


#: each document beside the benchmark item whose id is the remainder of its own
_BESIDE = "d AS (SELECT d.*, b.text AS item FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"


def _beside(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    return table(spark, d, "documents").withColumn("item_id", F.col("doc_id") % F.lit(items.count())).join(items, "item_id")


@query(f"{_BESIDE}, t AS (SELECT doc_id, {_TOK.format('text')} AS a, {_TOK.format('item')} AS b FROM d) SELECT doc_id, CAST(len(list_intersect(a, b)) AS BIGINT) AS common, CAST(len(a) AS BIGINT) AS n_left, CAST(len(b) AS BIGINT) AS n_right FROM t")
def w_token_f1(spark, d):
    n, x, y = captions.overlap(F.col("text"), F.col("item"))
    return _beside(spark, d).select("doc_id", n.cast("long").alias("common"), x.cast("long").alias("n_left"), y.cast("long").alias("n_right"))


_CANDIDATES = ("text", "item", "source || ' ' || text", "lang || ' ' || source")
_SCORE = "CASE WHEN len(t) = 0 THEN CAST('-inf' AS DOUBLE) ELSE least(len(t), 24) + 5.0 * len(list_distinct(t)) / len(t) - 1.5 * greatest(0, len(t) - 32) END"


@query(_BESIDE + ", c AS (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS i, regexp_extract_all(lower({x}), '[a-z0-9]+') AS t FROM d" for i, x in enumerate(_CANDIDATES)) + f"), s AS (SELECT doc_id, i, {_SCORE} AS s FROM c) SELECT doc_id, CAST(arg_min(i, struct_pack(a := -s, b := i)) AS INTEGER) AS chosen FROM s GROUP BY doc_id")
def w_caption_select(spark, d):
    four = F.array("text", "item", F.concat("source", F.lit(" "), "text"), F.concat("lang", F.lit(" "), "source"))
    return _beside(spark, d).select("doc_id", captions.best(four).alias("chosen"))


@query("SELECT source, count(*) AS clips, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY source")
def w_source_summary(spark, d):
    src = table(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "n_chars"))).alias("clips"))

    def forward(source, clips):
        n = ops.reduce(native(lambda x: x["n_chars"])(ops.expand(keep_array(clips))))
        return native(lambda s, c: F.struct(s.alias("source"), F.size(c).cast("long").alias("clips"), F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x).alias("total")))(source, n)

    return plan(forward, src, ["source", "clips"], ["source"]).output().select("v.*")


@query("p AS (SELECT o_orderkey, o_orderkey % 500 + 1 AS n, (o_orderkey % 7) / 10.0::DOUBLE AS s, (o_orderkey % 7) / 10.0::DOUBLE + 0.25::DOUBLE AS e FROM orders) SELECT o_orderkey, " + ", ".join(f"CAST(least(n - 1, greatest(0, round_even((n - 1) * (s + (e - s) * {f}::DOUBLE), 0))) AS BIGINT) AS f{i}" for i, f in enumerate(("0.0", "(1.0::DOUBLE/3)", "(2.0::DOUBLE/3)", "1.0"))) + " FROM p")
def w_frame_indices(spark, d):
    k = F.col("o_orderkey")
    s = (k % 7) / F.lit(10.0)
    at = captions.frame_indices(k % 500 + 1, s, s + F.lit(0.25))
    return table(spark, d, "orders").select("o_orderkey", *[at[i].alias(f"f{i}") for i in range(4)])


@query("SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x >= 0.25::FLOAT)) AS BIGINT) AS boxes FROM embeddings")
def w_confidence_count(spark, d):
    src = table(spark, d, "embeddings").withColumn("path", F.concat(F.col("vec_id").cast("string"), F.lit(".jpg")))
    out = models.DetectSegment().plan(src, ["path", "embedding"], ["vec_id"]).output().select(F.regexp_extract("v.input_path", r"^\d+", 0).cast("long").alias("vec_id"), F.col("v")["boxes"].cast("long").alias("boxes"))
    return out


@query("SELECT row_number() OVER (ORDER BY item_id) - 1 AS k0, 'A: ' || text AS model_a, 'B: Improve: ' || text || ' | A: ' || text AS model_b FROM benchmark")
def w_prompt_refine(spark, d):
    return flat(plan(lambda p: models.TwoModels().forward(p), table(spark, d, "benchmark"), ["text"], ["item_id"]).output(), F.col("v")["model_a"].alias("model_a"), F.col("v")["model_b"].alias("model_b"))


@query("SELECT item_id || '__sample_' || lpad(CAST(n AS VARCHAR), 3, '0') AS id FROM benchmark, range(3) r(n)")
def w_sample_replicate(spark, d):
    return captions.replicated(table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id")), 3)


@query(_L + " SELECT 'lines' AS level, count(*) AS entities, count(*) FILTER (WHERE length(line) > 100) AS present FROM l UNION ALL SELECT 'documents', count(*), count(*) FROM d")
def run_metrics(spark, d):
    lines = filter_outcomes(spark, d).agg(F.lit("lines").alias("level"), F.count("*").alias("entities"), F.count_if(F.col("o") == "PRESENT").alias("present"))
    own = source_coordinates(spark, d).agg(F.lit("documents").alias("level"), F.count("*").alias("entities"), F.count("doc_id").alias("present"))
    return lines.unionByName(own)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def committed_resume(spark, d):
    return uncommitted(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")
