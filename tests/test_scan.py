"""The scan: offsets, windows, guards, first occurrence, long texts, plan shape."""

import re

import pytest
from conftest import SF
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sourcesift.functions.dialect import java_regex, re2_regex
from sourcesift.operators.matching import explode_matches, order_findings, scan_rules
from sourcesift.operators.surface import scan_race
from sourcesift.rules.model import Guard, Rule, rules_table
from sourcesift.rules.packs import PACKS, register_pack
from sourcesift.rules.surface import spec
from sourcesift.sources.corpus import read_table_corpus


def found(df):
    return {(r.path, r.rule_id, r.value) for r in df.collect()}


def test_offsets_point_at_the_match(spark, artifacts):
    text = "é1 ab\nab " + "x" * 5000 + "ab\n" + "ab" * 3
    rows = explode_matches(artifacts(a=text), [spec("ab", "ab", ("ab",))], windows={"w": (3, 5)}, line=True).collect()
    assert sorted(r.pos for r in rows) == [m.start() for m in re.finditer("ab", text)]
    for r in rows:
        assert text[r.pos : r.pos + 2] == r.m == "ab"
        assert r.w == text[max(r.pos - 3, 0) : r.pos + 5]
        assert r.line == text[: r.pos].count("\n") + 1


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab é\n1", max_size=300), min_size=1, max_size=4))
def test_offsets_on_random_texts(spark, texts):
    df = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "artifact_id bigint, path string, src string")
    rows = explode_matches(df, [spec("x", r"a+\b")], line=True).collect()
    expected = {
        (i, m.start(), m.group()) for i, t in enumerate(texts) for m in re.finditer(r"a+\b", t, re.ASCII)
    }
    assert {(r.artifact_id, r.pos, r.m) for r in rows} == expected


def test_many_matches_and_one_long_line(spark, artifacts):
    text = "eval(x);" * 120_000  # about 1 MB without a newline
    rows = explode_matches(artifacts(big=text, empty=""), [spec("eval", r"\beval\s*\(", ("eval",))], windows={"w": (8, 8)})
    out = rows.agg(F.count("*"), F.sum("pos"), F.min(F.length("w"))).first()
    assert out[0] == 120_000
    assert out[1] == sum(8 * i for i in range(120_000))
    assert out[2] == 8


def test_first_occurrence_and_guards(artifacts):
    df = artifacts(
        a="eval(1); eval(2); el.innerHTML = x;" + " " * 250 + "DomSanitizer; b.innerHTML = y;",
        b='password = "placeholder"; password = "secret-1"; password = "secret-1"',
    )
    security = scan_rules(df, PACKS["security"])
    assert security.filter("rule_id = 'xss-eval'").count() == 1
    assert [r.pos for r in security.filter("rule_id = 'xss-innerhtml'").collect()] == [20]
    assert {r.value for r in scan_rules(df, PACKS["credentials"]).filter("rule_id = 'hardcoded-password'").collect()} == {"secret-1"}


def test_counters_read_from_storage(artifacts):
    read = 'localStorage.getItem("k");'
    df = artifacts(
        second=f"a = {read} b = {read} c++; b++;", ending=f"total = {read} al += 1;", both=f"a = {read} a++; b = parseInt({read} b + 1;",
        inside=f"a = {read} b = {read} a++; b++;", far=f"a = {read} 1; 2; 3; a++;", too_far=f"a = {read} 1; 2; 3; 4; a++;",
        other=f"a = {read} b++;", none="a++;", empty="",
    )
    rows = {(r.path, r.value.split(": ")[1], r.pos) for r in scan_race(df).filter("rule_id = 'race-counter'").collect()}
    assert rows == {
        ("second", "b", 31), ("ending", "al", 3), ("both", "a", 0), ("both", "b", 36), ("inside", "a", 0), ("far", "a", 0),
    }


def test_ascii_word_edge_next_to_accents(artifacts):
    rows = explode_matches(artifacts(a="éeval(1) xeval(2) eval(3)"), [spec("e", r"\beval\(")]).collect()
    assert sorted(r.pos for r in rows) == [1, 18]


@pytest.mark.parametrize("pack", sorted(PACKS))
def test_every_rule_is_portable_and_hits(spark, pack):
    from sourcesift.plans.corpora import code_corpus

    for rule in PACKS[pack]:
        assert java_regex(rule.pattern) and re2_regex(rule.pattern)
    hit = {r.rule_id for r in scan_rules(code_corpus(spark, SF), PACKS[pack]).select("rule_id").distinct().collect()}
    assert hit == {r.rule_id for r in PACKS[pack]}


def test_user_pack_with_predicate(artifacts):
    rule = Rule("todo", "info", "Notes", r"TODO\(([a-z]+)\)", ("TODO",), groups=1, value="g1",
                guards=(Guard("value", lambda target: f"length({target}) > 2", keep=True),))
    register_pack("notes", [rule])
    assert found(scan_rules(artifacts(a="TODO(al) TODO(bea)"), PACKS.pop("notes"))) == {("a", "todo", "bea")}


def test_rules_table_and_order(spark, artifacts):
    assert rules_table(spark, "security", PACKS["security"]).count() == 53
    rows = order_findings(scan_rules(artifacts(a="localStorage.x; eval(1)"), PACKS["security"])).collect()
    assert [r.severity for r in rows] == ["critical", "medium"]


def test_scan_needs_no_shuffle_and_reads_two_columns(spark):
    corpus = read_table_corpus(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text")
    plan = scan_rules(corpus, PACKS["security"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert sorted(c.split(":")[0] for c in schema.split(",")) == ["doc_id", "text"]
