import json

import pytest
from pyspark.sql import functions as F

from graftwork.operators import resolve
from graftwork.plans import QUERIES
from graftwork.sources import readers, rust, sinks
from graftwork.sources.toml import TomlSource
from graftwork.streaming import events

SPAN = {"file_name": "f.rs", "line_start": 1, "line_end": 1, "column_start": 1, "column_end": 2, "is_primary": True, "byte_start": 0, "byte_end": 1}


def test_compiler_messages(spark, tmp_path):
    offer = SPAN | {"suggested_replacement": "x", "suggestion_applicability": "MachineApplicable"}
    lines = [
        "not json", json.dumps({"reason": "build-finished"}), json.dumps({"reason": "compiler-message", "message": {"message": "no level"}}),
        json.dumps({"package_id": "p", "reason": "compiler-message", "target": {"name": "t", "kind": ["lib"]}, "message": {"level": "error", "message": "m", "code": None, "spans": [SPAN, {"file_name": "broken"}], "children": [{"level": "help", "message": "try", "spans": [offer], "children": [{"level": "note", "message": "deep", "spans": [offer | {"suggested_replacement": "y"}]}]}]}}),
        json.dumps({"reason": "compiler-message", "message": {"level": "warning", "message": "w", "code": {"code": "dead_code"}, "spans": [{"file_name": 7, "line_start": "bad"}]}}),
    ]
    (tmp_path / "log.json").write_text("\n".join(lines))
    for got in (readers.read_messages(spark, str(tmp_path / "log.json")), readers.parse_messages(spark.createDataFrame([(x,) for x in lines], "value string"))):
        by = {r.level: r for r in got.collect()}
        assert set(by) == {"error", "warning"} and by["warning"].code == "dead_code" and by["error"].code is None
        assert [s.file_name for s in by["error"].spans] == ["f.rs"] and by["warning"].spans == []
        assert [(s.level, s.suggested_replacement) for s in by["error"].suggestions] == [("help", "x"), ("note", "y")]


def test_metadata_and_selectors(spark, tmp_path):
    doc = {"workspace_root": "/w", "workspace_members": ["a 1"], "packages": [{"id": "a 1", "name": "a", "manifest_path": "/w/a", "dependencies": [{"name": "serde", "rename": None, "kind": None}], "targets": [{"name": "a", "kind": ["lib"], "src_path": "/w/a/lib.rs"}]}, {"id": "x", "name": "x"}]}
    (tmp_path / "meta.json").write_text(json.dumps(doc, indent=1))
    members = readers.read_metadata(spark, str(tmp_path / "meta.json"))
    assert [r.package.name for r in members.collect()] == ["a"]
    assert readers.metadata_targets(members).first().src_path == "/w/a/lib.rs" and readers.metadata_dependencies(members).first().name == "serde"
    (tmp_path / "roots.txt").write_text("# c\n\n a::b \n  # d\nc::d\n")
    assert [r.selector for r in readers.read_selectors(spark, str(tmp_path / "roots.txt")).orderBy("ord").collect()] == ["a::b", "c::d"]
    assert readers.read_document(spark, str(tmp_path / "none.json"), "a int, b string").collect() == [(None, None)]


def test_toml_source(spark, tmp_path):
    for name, text in (("a", '[package]\nname = "a"\nd = 2020-01-01\n'), ("b", "broken = [")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "Cargo.toml").write_text(text)
    spark.dataSource.register(TomlSource)
    got = {r.path.split("/")[-2]: r for r in spark.read.format("toml").load(str(tmp_path)).collect()}
    assert json.loads(got["a"].manifest)["package"]["name"] == "a" and got["b"].status == "syntax"


SOURCE = """use a::b::{C, d as e, self};
use n::{p::{q, r}, s as t};
use x::*;
pub(crate) async fn run() {}
struct S;
#[test]
fn hidden() {}
// a
// b
// c
// d
// e
enum E {}
mod child;
#[path = "other.rs"]
pub(crate) mod named;
trait T {}
"""


def test_source_scan(spark):
    files = spark.createDataFrame([("/w/src/lib.rs", SOURCE), ("/w/src/child.rs", "mod deep;")], "path string, text string")
    assert {(r.kind, r.name) for r in readers.scan_items(files).collect()} == {("fn", "run"), ("struct", "S"), ("enum", "E"), ("mod", "child"), ("trait", "T"), ("mod", "deep")}
    assert {r.name for r in readers.scan_items(files, public_only=True).collect()} == {"run"}
    walked = readers.crawl(files, files.select("path").filter(F.col("path").endswith("lib.rs")))
    assert {(r.name, tuple(r.module_path)) for r in walked.filter("kind = 'mod'").collect()} == {("child", ()), ("deep", ("child",))}
    mods = {r.module: r.candidates for r in readers.declared_modules(files).collect()}
    assert mods["child"] == ["/w/src/child.rs", "/w/src/child/mod.rs"] and mods["deep"][0] == "/w/src/child/deep.rs"
    got = {(r.name, tuple(r.target), r.glob) for r in readers.imports(files).collect()}
    assert got == {("C", ("a", "b", "C"), False), ("e", ("a", "b", "d"), False), ("self", ("a", "b", "self"), False), ("*", ("x",), True), ("q", ("n", "p", "q"), False), ("r", ("n", "p", "r"), False), ("t", ("n", "s"), False)}
    assert mods["named"] == ["/w/src/other.rs"]
    assert [r.module for r in readers.automod(files, F.lit("/w/src")).collect()] == ["child", "lib"]
    assert readers.token_counts(files, "mod").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "b int, a string")
    for _ in range(2):
        sinks.append_rows(df, str(tmp_path / "log"))
    back = spark.read.text(str(tmp_path / "log")).collect()
    assert [r.value for r in back] == ['{"a":"x","b":1}'] * 2
    sinks.write_report(df, str(tmp_path / "report.json"))
    assert json.loads((tmp_path / "report.json").read_text()) == {"a": "x", "b": 1}
    files = spark.createDataFrame([("src/a.rs", "fn a() {}")], "path string, text string")
    assert sinks.write_tree(files, str(tmp_path / "out")) == 1 and sinks.write_tree(files, str(tmp_path / "out")) == 1
    (tmp_path / "foreign").mkdir()
    (tmp_path / "foreign" / "x").write_text("")
    with pytest.raises(FileExistsError):
        sinks.write_tree(files, str(tmp_path / "foreign"))
    with pytest.raises(ValueError, match="outside"):
        sinks.write_tree(spark.createDataFrame([(f"a/../b{i}", "") for i in range(6)] + [("../escaped.txt", "")], "path string, text string"), str(tmp_path / "out"))
    assert not (tmp_path / "escaped.txt").exists()
    edited = spark.createDataFrame([("src/a.rs", "fn b() {}"), ("src/none.rs", "")], "path string, text string")
    assert sinks.rewrite_sources(files, edited, str(tmp_path / "out")) == 1 and (tmp_path / "out/src/a.rs").read_text() == "fn b() {}" and not (tmp_path / "out/src/none.rs").exists()
    assert sinks.summary_lines(df, "t", ["b"]) == ["t: b=1"]
    e = sinks.event(df, "done", F.lit("ok"), F.lit(0).cast("bigint"), {"n": F.col("b")}).first()
    assert e.event == "done" and e.elapsed_ms > 0 and e.fields == {"n": "1"}


def test_event_stream(spark, tmp_path):
    log = tmp_path / "in"
    spark.createDataFrame([(60_000 * i, 5 * i, "ok" if i % 2 else "bad") for i in range(6)], "timestamp_ms bigint, elapsed_ms bigint, status string").coalesce(1).write.json(str(log))
    q = events.append_log(events.read_event_log(spark, str(log)), str(tmp_path / "copy"), str(tmp_path / "state"))
    q.awaitTermination(60)
    assert spark.read.json(str(tmp_path / "copy")).count() == 6
    out = events.status_counts(events.read_event_log(spark, str(log)), "2 minutes").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    out.awaitTermination(60)
    assert sorted((r.status, r.n) for r in spark.table("counts").collect()) == [("bad", 1)] * 3 + [("ok", 1)] * 3


def test_suggestions_of_any_depth(spark):
    note = {"level": "note", "message": "deep", "spans": [SPAN | {"suggested_replacement": "y"}]}
    for i in range(30):
        note = {"level": "help", "message": f"m{i}", "children": [note, {"message": 3, "spans": [{"file_name": "x"}, 7]}]}
    line = json.dumps({"reason": "compiler-message", "message": {"level": "error", "message": "m", "children": [note]}})
    got = readers.parse_messages(spark.createDataFrame([(line,)], "value string")).first()
    assert [(s.level, s.suggested_replacement, s.byte_start) for s in got.suggestions] == [("note", "y", 0)]


def test_broken_and_awkward_sources(spark):
    texts = {"open": "fn a( {", "none": None, "empty": "", "string": 'const A: &str = "}"; fn b() { let c = \'{\'; }', "comment": "/* { */ mod m { /* } */ }", "raw": 'fn r() { r#"}"# }'}
    got = {r.path: r for r in rust.parse_files(spark.createDataFrame(list(texts.items()), "path string, text string")).collect()}
    assert {k for k, r in got.items() if r.status != "ok"} == {"open"}
    assert [i.name for i in got["string"]["items"]] == ["A", "b"] and [i.name for i in got["comment"]["items"]] == ["m"] and got["none"]["items"] == []


def test_marked_sources(spark):
    files = spark.createDataFrame([("a", "#[keep]\nfn a() {}"), ("b", "fn b() {}"), ("c", "#[keep]\nfn c( {"), ("d", "impl X { #[m::keep] fn d() {} }")], "path string, text string")
    assert {r.path for r in resolve.marked_sources(rust.parse_files(files), files, "(?:m::)?keep").collect()} == {"a", "c", "d"}


def test_a_file_stays_in_its_row(spark):
    """What a file keeps comes with its items and imports; of one name in a module the last import counts."""
    files = spark.createDataFrame([(7, "use a::x;\nuse b::x;\nuse c::*;\nmod m { use d::x; use super::*; }\nfn f() {}"), (8, "fn broken( {")], "k int, text string").withColumn("path", F.lit("lib.rs"))
    parsed = rust.parse_files(files, keep=("k",), items=("kind", "name", "attrs"))
    assert parsed.columns == ["path", "k", "status", "items", "uses"] and {r.k: r.status for r in parsed.collect()} == {7: "ok", 8: "syntax"}
    assert {(r.k, r.kind, r.name) for r in rust.items_of(parsed).collect()} == {(7, "Mod", "m"), (7, "Fn", "f")}
    assert {(r.k, tuple(r.module), tuple(r.target)) for r in rust.uses_of(parsed).collect()} == {(7, (), ("b", "x")), (7, (), ("c",)), (7, ("m",), ("d", "x")), (7, ("m",), ("super",))}
    assert {r.k: r.inherits for r in rust.inherits(parsed).collect()} == {7: True, 8: False}
    assert rust.parse_files(files, items=(), uses=False).columns == ["path", "status"]


@pytest.mark.parametrize("name", ["parse_status", "use_trees", "source_items", "registered_callables", "module_candidates"])
def test_sources_are_parsed_once_on_all_cores(spark, name):
    """A table of one small file isn't one task's work, and no row is joined to what it was parsed from."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
