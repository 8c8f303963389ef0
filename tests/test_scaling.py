"""Work per task and per plan: how inputs are dealt, how often a plan repeats itself."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from sourcesift.functions.text import has
from sourcesift.operators import correlate, graph
from sourcesift.operators.matching import order_findings
from sourcesift.plans import corpora
from sourcesift.plans.queries import QUERIES
from sourcesift.sources import sinks


def test_orders_are_dealt_evenly_whatever_their_files(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    keys = spark.range(20_000).select(F.col("id").alias("o_orderkey"))
    for part in range(4 * cores):  # one large file and many small ones
        some = keys if part == 0 else keys.filter(f"o_orderkey = {part}").withColumn("o_orderkey", F.col("o_orderkey") + 20_000)
        some.coalesce(1).write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    made = corpora.code_corpus(spark, str(tmp_path))
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 + 4 * cores - 1
    assert max(sizes) < 20_000 / cores


def test_tasks_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpora, "TASK_ROWS", 100)
    spark.range(10_001).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    made = corpora.code_corpus(spark, str(tmp_path))
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 10_001 and max(sizes) <= 110
    assert made.select("artifact_id").distinct().count() == 10_001


def test_enclosing_functions_works_out_each_hop_once(spark):
    findings = spark.createDataFrame([(1, "r", 90), (1, "q", 90), (2, "r", 5)], "artifact_id bigint, rule_id string, pos int")
    starts = spark.createDataFrame(
        [(1, 0, 10, "function", "a", None, 1), (1, 60, 70, "arrow", "b", "on", 2)],
        "artifact_id bigint, r_pos int, r_end int, kind string, name string, caller string, r_line int",
    )
    out = correlate.enclosing_functions(findings, starts)
    rows = sorted(tuple(r) for r in out.collect())
    near, far = ("arrow", "b", "on", 2), ("function", "a", None, 1)
    assert rows == sorted((1, rule, 90, hop, *f) for rule in "qr" for hop, f in enumerate([near, far]))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 6  # one as-of join, four hops, the rules of a place


@pytest.mark.parametrize("literal", ["eval", ".innerHTML", "10.", "a", "$(", "Date().getTime()", "it's \\\\ a", "${x}"])
def test_has_is_contains(spark, literal):
    texts = ["", None, literal, f"x{literal}y", literal[1:], literal[:-1], "HTML .outerHTML", "é" + literal]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.selectExpr(has("t", literal)).collect()]
    assert got == [None if t is None else literal in t for t in texts]


def test_report_lines_work_out_findings_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(v):
        runs.add(1)
        return v

    artifacts = spark.createDataFrame([(1, "a.js", "abc"), (2, "b.js", "é"), (None, "c.js", "")], "artifact_id bigint, path string, src string")
    rows = [(1, "r", "C", "low", "v", "x", "d", "", 3, 1), (1, "q", "C", "critical", "w", "x", "d", None, 9, 2), (None, "r", "C", "low", "v", "x", "d", "", 0, 1)]
    findings = spark.createDataFrame(
        rows, "artifact_id bigint, rule_id string, category string, severity string, value string, context string, description string, cwe string, pos int, line int"
    ).withColumn("value", F.udf(counted)("value"))
    got = [tuple(r) for r in sinks.report_lines(artifacts, findings).collect()]
    assert runs.value == len(rows)
    critical = '{"rule":"q","category":"C","severity":"critical","value":"w","context":"x","description":"d","pos":9,"line":2}'
    low = ',{"rule":"r","category":"C","severity":"low","value":"v","context":"x","description":"d","cwe":"","pos":3,"line":1}'
    assert [r for r in sorted(got, key=str) if r[0] == 1] == [
        (1, 0, 0, '{"metadata":{"filename":"a.js","size":3,"total":2},"findings":['), (1, 1, 1, critical), (1, 1, 2, low), (1, 2, 0, '],"total":2}'),
    ]
    assert [r[3] for r in sorted(got, key=str) if r[0] == 2] == ['{"metadata":{"filename":"b.js","size":2,"total":0},"findings":[', '],"total":0}']
    assert (None, 2, 0, '],"total":0}') in got


@pytest.fixture
def counted(spark):
    """A column that counts how often it is worked out, and the count."""
    runs = spark.sparkContext.accumulator(0)

    def count(v):
        runs.add(1)
        return v

    return F.udf(count), runs


def test_order_findings_works_them_out_once(spark, counted):
    count, runs = counted
    rows = [(None, "r", "low", 3), (2, "r", "high", 3), (2, "q", "high", 3), (1, "r", "critical", 9), (1, "r", "critical", 9), (1, "r", "odd", None)]
    findings = spark.createDataFrame(rows, "artifact_id bigint, rule_id string, severity string, pos int").withColumn("rule_id", count("rule_id"))
    got = [tuple(r) for r in order_findings(findings).collect()]
    assert got == [rows[5], rows[3], rows[4], rows[2], rows[1], rows[0]] and runs.value == len(rows)


def test_enclosing_functions_works_findings_out_once(spark, counted):
    count, runs = counted
    findings = spark.createDataFrame([(1, "r", 90), (1, "q", 90), (2, "r", 5), (None, "r", 5)], "artifact_id bigint, rule_id string, pos int")
    starts = spark.createDataFrame(
        [(1, 60, 70, "arrow", "b", "on", 2), (2, 0, 3, "function", "a", None, 1), (None, 0, 3, "function", "a", None, 1)],
        "artifact_id bigint, r_pos int, r_end int, kind string, name string, caller string, r_line int",
    )
    rows = {(r.artifact_id, r.rule_id, r.name) for r in correlate.enclosing_functions(findings.withColumn("rule_id", count("rule_id")), starts).collect()}
    assert rows == {(1, "r", "b"), (1, "q", "b"), (2, "r", "a")} and runs.value == 4


def test_chunk_findings_work_modules_out_once(spark, counted):
    count, runs = counted
    bodies = ["".join(f"d({i});" for i in range(30)), "d(1);" * 60, "nothing"]
    rows = [(1, "webpack5", "main", str(i), f"m{i}", body) for i, body in enumerate(bodies)] + [(None, "webpack4", "c", "7", "admin", "")]
    modules = spark.createDataFrame(rows, "artifact_id bigint, format string, chunk string, module_id string, name string, module_src string")
    got = {(r.artifact_id, r.rule_id, r.value) for r in graph.chunk_findings(modules.withColumn("module_src", count("module_src"))).collect()}
    assert got == {
        (1, "chunk-hub", "Hub module: m0 (30 deps)"), (1, "chunk-hot-module", "Hot module: m1 (61 refs)"), (None, "chunk-admin-module", "Admin logic in chunk c: admin"),
        (1, "chunk-format", "Webpack webpack5: 3 modules"), (None, "chunk-format", "Webpack webpack4: 1 modules"),
    }
    assert runs.value == len(rows)


def test_suppressions_are_found_once(spark):
    plan = QUERIES["suppress_findings"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("Join LeftAnti") == 2
