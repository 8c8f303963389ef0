"""Taint flows at size: what is shuffled, what is worked out once, and the same rows for odd keys."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sourcesift.operators import taint

EDGES = "artifact_id bigint, path string, var string, used string"
SEEDS = "artifact_id bigint, path string, var string, source_id string, pos int"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def test_names_and_pairs(spark):
    rng = random.Random(2)
    texts = ["", "a.b.c", ".a", "a.", "a..b", "1.5 + $x.y_z", "é.a.b", "a.b a.b a", *("".join(rng.choices("ab.$ 1é\n", k=40)) for _ in range(200))]

    def expected(text):
        chains = [m.group().split(".") for m in re.finditer(r"[A-Za-z0-9_$]+(?:\.[A-Za-z0-9_$]+)*", text)]
        return {n for c in chains for n in [*c, *(f"{x}.{y}" for x, y in zip(c, c[1:]))]}

    rows = spark.createDataFrame([(x,) for x in texts], "x string").selectExpr("x", f"{taint._names_in('x')} AS names").collect()
    assert all(set(r["names"]) == expected(r.x) and len(r["names"]) == len(set(r["names"])) for r in rows)
    long = spark.createDataFrame([("a" * 1_000_000 + " " + "b." * 100_000,)], "x string").selectExpr(f"size({taint._names_in('x')}) AS n")
    assert long.first().n == 3


def test_propagation_shuffles_links_once_and_sorts_nothing(spark):
    chain = [(1, "p", f"v{i + 1}", f"v{i}") for i in range(7)] + [(1, "p", "v1", "v3"), (1, "p", "w", "v0"), (1, "p", "w", "v2")]
    edges = spark.createDataFrame([*chain, *chain, (None, "p", "x", "v0"), (2, None, "x", "v0"), (3, "p", "x", "v0")], EDGES)
    seeds = spark.createDataFrame(
        [(1, "p", "v0", "b", 1), (1, "p", "v0", "a", 2), (1, "p", "v2", "c", 3), (None, "p", "v0", "a", 1), (2, None, "v0", "a", 1), (4, "p", "alone", "a", 1)], SEEDS
    )
    out = taint.propagate_taint(seeds, edges)
    plan = plan_of(out)
    assert plan.count("ShuffledHashJoin") == 5 and "SortMergeJoin" not in plan
    got = sorted((r.artifact_id, r.var, r.source_id, r.hop) for r in out.collect())
    assert got == [
        (1, "v0", "a", 0), (1, "v1", "a", 1), (1, "v2", "c", 0), (1, "v3", "c", 1), (1, "v4", "c", 2), (1, "v5", "c", 3),
        (1, "v6", "c", 4), (1, "v7", "c", 5), (1, "w", "a", 1), (4, "alone", "a", 0),
    ]


def test_contexts_do_not_travel_with_every_name(spark):
    text = "var q = location.hash; el.innerHTML = q; " + "x.y(z); " * 20 + "eval(q + q);"
    rows = [(1, "a", text), (1, "a", text), (2, "b", text), (None, "c", text), (3, None, text), (4, "d", "el.innerHTML = q;"), (5, "e", "")]
    df = spark.createDataFrame(rows, "artifact_id bigint, path string, src string")
    tainted = spark.createDataFrame(
        [(1, "a", "q", "s", 0), (2, "b", "q", "s", 0), (2, "other", "q", "s", 0), (None, "c", "q", "s", 0), (3, None, "q", "s", 0), (5, "e", "q", "s", 0)],
        "artifact_id bigint, path string, var string, source_id string, hop int",
    )
    out = taint.taint_sinks_reached(df, tainted)
    exploded = [n.output().mkString(",") for n in nodes(out._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Generate"]
    columns = {c.split("#")[0] for o in exploded for c in o.split(",")}
    assert columns == {"artifact_id", "path", "id", "var"}
    found = sorted((r.artifact_id, r.path, r.sink_id, r["var"], r.hop) for r in out.collect() if r["var"] == "q")
    one = [("eval", "q", 0), ("innerhtml", "q", 0)]
    assert found == sorted([(1, "a", *f) for f in one * 2] + [(2, "b", *f) for f in one])
    assert {r.context for r in out.collect() if r.sink_id == "eval"} == {"eval(q + q);"}


def test_flows_are_worked_out_once_for_the_fallback(spark):
    runs = spark.sparkContext.accumulator(0)

    def count(v):
        runs.add(1)
        return v

    columns = "artifact_id bigint, path string, rule_id string, severity string, value string, context string, cwe string, pos int, line int"
    flows = spark.createDataFrame([(1, "a", "taint-flow", "high", "v", "c", "", 1, 1), (None, "b", "taint-flow", "high", "v", "c", "", 1, 1)], columns)
    rest = spark.createDataFrame([(i, "p", "taint-flow", "low", "f", "c", "", 1, 1) for i in (1, 2, None)], columns)
    got = taint.with_fallback(flows.withColumn("artifact_id", F.udf(count, "bigint")("artifact_id")), rest).collect()
    assert sorted((r.artifact_id or 0, r.value) for r in got) == [(0, "f"), (0, "v"), (1, "v"), (2, "f")] and runs.value == 2


@pytest.mark.parametrize("keys", [(None, 1), (1, None)])
def test_fallback_of_rows_with_odd_keys(artifacts, spark, keys):
    text = "const data = document.cookie; eval(data);"
    rows = [(keys[0], "a", text), (keys[1], "b", text), (7, "c", text), (7, "c", text)]
    out = taint.scan_taint_fallback(spark.createDataFrame(rows, "artifact_id bigint, path string, src string"))
    got = sorted((str(r.artifact_id), r.value) for r in out.collect() if "eval" in r.value)
    assert [k for k, _ in got] == ["1", "7", "7", "None"] and len({v.split("(src")[0] for _, v in got}) == 1
