"""The whole scan and what it is made of: one text pass, decoding to the end, linear patterns, report, steps, streams."""

import base64
import glob
import json
import random
import time
from dataclasses import replace

import pytest
from conftest import SF
from pyspark.sql import functions as F

from sourcesift.functions.dialect import SPACE_CHARS, java_regex, re2_regex
from sourcesift.functions.text import rx
from sourcesift.operators import findings, graph, taint
from sourcesift.operators.extract import DEPENDENCY_RULES, dependency_versions
from sourcesift.operators.matching import Raw, explode_matches, findings_of, match_table, raw_of, scan_rules
from sourcesift.operators.normalise import decode_literals, decode_text, normalise, normalise_with_literals
from sourcesift.rules import extended, extraction, surface
from sourcesift.rules import taint as t
from sourcesift.rules.model import Linear, Rule
from sourcesift.rules.packs import PACKS
from sourcesift.sources import sinks
from sourcesift.sources.corpus import read_table_corpus
from sourcesift.streaming import scan as streaming

LINEAR = [
    r for rules in [*PACKS.values(), extended.RACE, t.SINKS, t.ASSIGNMENTS, t.FUNCTION_STARTS, surface.FALLBACK_SOURCES, surface.FALLBACK_SINKS,
                    extraction.CALL_NAMES, DEPENDENCY_RULES]
    for r in rules if isinstance(r.pattern, Linear)
]
# what to repeat so that every head lacks its tail
HEADS = {
    "weak-random-password": "Math.random() ", "cmd-injection": "exec( ", "crypto-broken-entropy": "btoa( ", "angular-guard": "canActivate: [",
    "xss-jquery-html": "$( .html", "xss-jquery-dom": "$(", "ng-tmpl-inject": "DomSanitizer ", "proto-jsonparse": "JSON.parse(",
    "postmsg-wildcard": ".postMessage( ", "err-tostring": ".toString() ", "upload-ext-client": ".name.split(", "race-counter": "localStorage.getItem ab",
    "jquery-html": ".html(", "jquery-append": ".after(", "reassignment": "ab0=", "member": "ab0.", "method": "ab0({", "localStorage": "localStorage.getItem(",
    "sessionStorage": "sessionStorage.getItem(", "jQuery .html()": "$( .html", "call": "ab0(",
}


def test_every_linear_rule_is_tried():
    assert len(LINEAR) >= 24 and {r.rule_id for r in LINEAR if ":quoted" not in r.rule_id} == set(HEADS)


@pytest.mark.parametrize("rule", LINEAR, ids=lambda r: r.rule_id)
def test_one_long_line_costs_little(artifacts, rule):
    head = HEADS.get(rule.rule_id) or f'"{rule.rule_id.split(":")[0]}" '
    name = {"reassignment": "a" * 1_000_000 + " =;", "member": "a" * 1_000_000 + " =", "method": "a" * 1_000_000 + " {", "call": "a" * 1_000_000 + " ("}
    texts = {"heads": head * (1_000_000 // len(head)), "name": name.get(rule.rule_id, "")}
    df = artifacts(**texts).repartition(2)
    explode_matches(artifacts(a="x"), [rule]).count()  # compiled before
    start = time.time()
    explode_matches(df, [rule]).count()
    assert time.time() - start < 5


def test_linear_patterns_find_what_the_plain_ones_find(spark):
    rng = random.Random(1)
    bits = [
        "child_process", "exec(", "exec ( ", "+", ")", "(", "btoa(", '.split("").reverse', "canActivate: [", "]", "A,B", "$(", "jQuery (", ").html(", ".html(",
        ".append(", ".after( ", ").append(x", "DomSanitizer", "bypassSecurityTrustHtml(`", "JSON.parse(", ".postMessage(", "a, '*'", ",\n'*'", ".toString()",
        ".toString(\n", ".toString ( )", "innerHTML =", "innerText\n=", "textContent=", ".name.split(", ".NAME.match(", "jpg", "Math.random()",
        "Math.random(\n)", "math.RANDOM ( )", "password", "\n", "\r", " ", "x", "abc9", "9z", "=", "= 1;", "{", "){", ";", "foo(", "localStorage.getItem(k);",
        "sessionStorage.getItem (", "é", "$", "a.b", ".c =", "total =", "al++;", "al += 1", '"lodash"', "'d3'", '"4.1"', "jquery@3.1", '"JQuery"', " ",
    ]
    rows = [(i, "p", "".join(rng.choices(bits, k=rng.randint(1, 25)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "artifact_id long, path string, src string").repartition(8)
    linear = [replace(r, rule_id=f"{i}", gate=()) for i, r in enumerate(LINEAR)]
    plain = [replace(r, pattern="".join(r.pattern)) for r in linear]
    assert not any(isinstance(r.pattern, Linear) for r in plain)
    got, want = (sorted(map(tuple, explode_matches(df, rules, line=True).collect())) for rules in (linear, plain))
    assert got == want and len({r[2] for r in want}) > len(linear) - 3


@pytest.mark.parametrize("rule", [r for r in LINEAR if r.rule_id in ("reassignment", "member", "method", "call")], ids=lambda r: r.rule_id)
def test_words_without_a_match_set_no_marks(spark, rule):
    hit = {"reassignment": "a = 1;", "member": "a.b = 1;", "method": "a() {", "call": "a("}[rule.rule_id]
    df = spark.createDataFrame([("some words, " * 1000 + hit,)], "src string")
    assert df.selectExpr(f"regexp_count(src, {rx(rule.pattern.linear)}) AS n").first().n <= 3


def test_classes_in_java(spark):
    """Java's spelling asks less per character, but holds the same ones."""
    assert java_regex(r"[a-cX-Z0-2_-]") == "[abcXYZ012_-]" and java_regex(r"[^a-c\x61-c]") == r"[^abc\x61-c]" and re2_regex("[a-c]") == "[a-c]"
    codes = [i for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    chars = spark.createDataFrame([(i, chr(i)) for i in codes], "id int, c string").cache()
    for pattern, want in {r"^\s$": set(map(ord, SPACE_CHARS)), r"^[^\s]$": None, r"(?i)^[a-f2-4]$": set(map(ord, "abcdefABCDEF234")), r"^[\x0a-c]$": set(range(10, 100))}.items():
        got = {r.id for r in chars.filter(f"c RLIKE {rx(pattern)}").collect()}
        assert got == want if want is not None else not got & set(map(ord, SPACE_CHARS)) and len(got) == len(codes) - len(SPACE_CHARS)
    edges = {r.id for r in chars.filter(f"concat(c, '(x') RLIKE {rx(r'^.?[(]x')} AND concat(c, 'x') RLIKE {rx(r'(?:^|[^a])' + chr(92) + 'bx')}").collect()}
    assert not edges & set(map(ord, "_09azAZ")) and {ord("é"), ord("$"), ord("(")} <= edges


def test_a_text_with_marks_in_it(artifacts):
    text = 'm$1 \\ $0 ${x} "$(a).html(b)" eval(1); eval("$2")'
    rows = explode_matches(artifacts(a=text), [surface.spec("e", r"(e)(v)al\(", ("eval",), 2)]).collect()
    assert [(r.m, r.g1, r.g2, r.pos) for r in sorted(rows, key=lambda r: r.pos)] == [("eval(", "e", "v", text.index("eval(1")), ("eval(", "e", "v", text.index('eval("'))]


def test_literals_inside_literals(artifacts):
    inner = base64.b64encode(b'atob("' + base64.b64encode(b"admin/panel") + b'")').decode()
    df = artifacts(
        split=f'x = atob("{inner[:8]}" + \'{inner[8:]}\');', codes='y = "a" + String.fromCharCode(98, 99) + "d";', joined='[ "ad", "min" ].join("") + "/x"',
        not_one='[0x01,0x02] atob("*") "a" - "b"', none="plain", empty="",
    )
    texts = {r.path: r.src for r in decode_text(df).collect()}
    assert texts["codes"] == 'y = "abcd";' and texts["joined"] == '"admin/x"' and texts["none"] == "plain" and texts["empty"] == ""
    assert texts["not_one"] == '[0x01,0x02] atob("*") "a" - "b"'
    assert texts["split"] == 'x = "atob(\\"' + base64.b64encode(b"admin/panel").decode() + '\\")";'
    rows = {(r.path, r.kind, r["round"], r.value) for r in decode_literals(df).collect()}
    assert ("split", "concat", 0, inner) in rows and ("split", "base64", 1, 'atob("' + base64.b64encode(b"admin/panel").decode() + '")') in rows
    assert {("codes", "char_codes", 0, "bc"), ("codes", "concat", 1, "abcd"), ("joined", "array_join", 0, "admin"), ("joined", "concat", 1, "admin/x")} <= rows


def test_long_lists_of_literals(artifacts):
    df = artifacts(a="[" + ",".join(f'"p{i}"' for i in range(5000)) + '].join("")', b=" + ".join(f'"q{i}"' for i in range(5000)))
    texts = {r.path: r.src for r in decode_text(df).collect()}
    assert texts == {"a": '"' + "".join(f"p{i}" for i in range(5000)) + '"', "b": '"' + "".join(f"q{i}" for i in range(5000)) + '"'}


def test_whole_scan_reads_normalised_texts_at_true_places(artifacts):
    df = artifacts(
        a='/* scan-ignore: all */ eval(1);\nel["innerHTML"] = x;\nuse("lodash", "4.17.20");',
        b='y = "ev" + "al(2)"; z = \'in\' + \'nocent\';',
        c="head\n[[11],{\n101:function(e,t,d){" + "".join(f"d({i});" for i in range(30)) + 'import "@angular/core"}}]',
        none="", plain="nothing here",
    )
    scan = findings.WholeScan(df)
    rows = {(r.path, r.rule_id): r for r in scan.findings.collect()}
    assert rows["a", "xss-innerhtml"].line == 2 and rows["a", "xss-innerhtml"].pos == 34
    assert rows["a", "dep-lodash"].line == 3 and rows["b", "xss-eval"].value == "eval(" and rows["c", "chunk-hub"].line == 3
    kept = {(r.path, r.rule_id) for r in scan.kept.collect()}
    assert ("a", "xss-eval") not in kept and {("a", "dep-lodash"), ("a", "xss-innerhtml")} <= kept
    report = {r.filename: r for r in scan.report.collect()}
    assert report["a"].suppressed >= 1 and report["a"].total + report["a"].suppressed == sum(p == "a" for p, _ in rows)
    assert (report["none"].total, report["none"].score, report["none"].risk, report["plain"].size) == (0, 0, "LOW", 12)


def test_match_table_reads_the_texts_once(spark):
    texts = read_table_corpus(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text")
    corpus = normalise_with_literals(texts)
    raws = [Raw("sinks", tuple(t.SINKS), 100, 250, only="contains(_src, 'location')"), Raw("refs", tuple(DEPENDENCY_RULES))]
    table = match_table(corpus, {n: PACKS[n] for n in findings.WIRED}, raws, literals="literals")
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Python" not in plan
    assert "documents.parquet" not in findings.full_scan(texts)._jdf.queryExecution().executedPlan().toString()


def test_match_table_holds_what_the_single_scans_find(spark):
    from sourcesift.plans.corpora import mixed_corpus

    df = mixed_corpus(spark, SF)
    raws = [Raw("sinks", tuple(t.SINKS), 100, 250), Raw("refs", tuple(DEPENDENCY_RULES))]
    table = match_table(df, {"credentials": PACKS["credentials"], "web3": PACKS["web3"]}, raws).cache()
    for pack in ("credentials", "web3"):
        assert sorted(map(str, findings_of(table, packs=[pack]).collect())) == sorted(map(str, scan_rules(df, PACKS[pack]).collect()))
    alone = explode_matches(df, t.SINKS, windows={"before": (100, 0), "after": (0, 250)}, line=True).select("path", "rule_id", "m", "pos", "line", "before", "after")
    assert sorted(map(tuple, raw_of(table, "sinks").select(alone.columns).collect())) == sorted(map(tuple, alone.collect()))
    table.unpersist()


def test_taint_runs_no_job_while_it_is_built(spark, artifacts):
    df = artifacts(a="var q = location.hash; el.innerHTML = q;")
    hits = taint.taint_hits(df)
    spark.sparkContext.setJobGroup("built", "building alone")
    flows = taint.flows_of(hits)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("built")
    spark.sparkContext.setJobGroup("", "")
    assert flows.filter("sink_id = 'innerhtml'").count() >= 1


def test_versions_stand_where_they_were_found(artifacts):
    df = artifacts(a='x\n"lodash" : {},\n "lodash", y = "4.0.1"; lodash@4.17.20 "lodash": "1.0"', b='"d3": "5.1"\n"d3": "6.0"', c="none")
    rows = {(r.path, r.package): (r.version, r.how, r.pos, r.line) for r in dependency_versions(df).collect()}
    assert rows == {("a", "lodash"): ("4.0.1", "specific", 18, 3), ("b", "d3"): ("5.1", "specific", 0, 1)}


def test_a_step_of_ones_own(artifacts):
    rule = Rule("todo", "info", "Notes", r"TODO\((\w+)\)", ("TODO",), groups=1, value="g1")
    findings.register_step("notes", lambda scan: scan_rules(scan.artifacts, [rule]))
    try:
        rows = findings.full_scan(artifacts(a="TODO(ann) eval(1)")).collect()
    finally:
        findings.STEPS.pop("notes")
    assert {r.rule_id for r in rows} >= {"todo", "xss-eval"}
    assert {r.rule_id for r in findings.WholeScan(artifacts(a="TODO(ann) eval(1)"), steps=["race"]).findings.collect()} == set()


def test_one_document_per_artifact(artifacts, tmp_path):
    df = artifacts(a='eval(1); document.cookie; el.innerHTML = "x";', b="nothing", c='password = "secret-1"')
    sinks.write_reports(df, scan_rules(df, PACKS["security"] + PACKS["credentials"]), str(tmp_path / "out"))
    documents = {}
    for folder in glob.glob(f"{tmp_path}/out/artifact_id=*"):
        (file,) = glob.glob(f"{folder}/part-*")
        document = json.load(open(file, encoding="utf-8"))
        documents[document["metadata"]["filename"]] = document
    assert {n: d["total"] for n, d in documents.items()} == {"a": 3, "b": 0, "c": 1}
    assert all(len(d["findings"]) == d["total"] == d["metadata"]["total"] for d in documents.values())
    assert [f["severity"] for f in documents["a"]["findings"]] == ["critical", "high", "low"] and documents["c"]["findings"][0]["cwe"] == "CWE-798"


def test_sarif_rules_name_their_weakness(artifacts):
    rules = sinks.sarif_rules(scan_rules(artifacts(a='password = "secret-1"; eval(1)'), PACKS["security"] + PACKS["credentials"]))
    made = [json.loads(r.json) for r in sinks.sarif_rule_json(rules).orderBy("rule_index").collect()]
    assert [m["id"] for m in made] == ["hardcoded-password", "xss-eval"]
    assert made[0]["relationships"][0]["target"]["id"] == "CWE-798" and made[0]["shortDescription"]["text"] and "relationships" not in made[1]


def test_stream_forgets_after_the_horizon_and_drops_late_rows(spark, tmp_path):
    schema = "path string, content_md5 string, ts timestamp"
    batches = [
        [("p", "h", "2024-01-01 00:00:00")], [("p", "h", "2024-01-01 01:00:00"), ("p", "other", "2024-01-01 01:00:00")],
        [("new", "n", "2024-01-05 00:00:00")], [("p", "h", "2024-01-05 01:00:00")], [("late", "l", "2024-01-02 00:00:00")],
    ]
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(batches):
        made = spark.createDataFrame(rows, "path string, content_md5 string, t string").selectExpr("path", "content_md5", "to_timestamp(t) AS ts")
        made.coalesce(1).write.parquet(f"{tmp_path}/b{i}")
        (file,) = glob.glob(f"{tmp_path}/b{i}/part-*")
        (tmp_path / "in" / f"{i}.parquet").write_bytes(open(file, "rb").read())
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = streaming.append_batches(streaming.stream_dedupe(stream, "1 day"), f"{tmp_path}/out", f"{tmp_path}/check")
        query.awaitTermination()
    rows = sorted((r.path, r.content_md5, str(r.ts)) for r in spark.read.schema(schema).parquet(f"{tmp_path}/out/*").collect())
    assert rows == [
        ("new", "n", "2024-01-05 00:00:00"), ("p", "h", "2024-01-01 00:00:00"), ("p", "h", "2024-01-05 01:00:00"), ("p", "other", "2024-01-01 01:00:00"),
    ]
    state = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert state and state[-1] <= 2  # what is older than the horizon is gone


def test_normalise_keeps_other_columns(spark):
    df = spark.sql("SELECT 1L AS artifact_id, 'p' AS path, '&lt;a&gt; x = !0; (0, m.f)(1); o[\"k\"] = \"a\" + \"b\"' AS src, 'kept' AS more")
    row = normalise(df).first()
    assert (row.src, row.more) == ('<a> x = !0; m.f(1); o.k = "ab"', "kept")
    assert graph.placed_modules(df).count() == 0 and df.select(F.lit(1)).count() == 1
