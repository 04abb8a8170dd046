"""Operators on small hand-written tables: cycles, ties, nulls, empty tables."""

import random
import re
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from graftwork.functions import arguments, hashing, ident, kleene
from graftwork.operators import audit, closure, diag, edges, edits, loops, order, preflight, resolve, spans, verdict

GRAPH = {
    "a::open_source_entry": ["b::compute", "c::adjust"],
    "a::internal_entry": ["b::unused_public"],
    "b::compute": ["d::Worker::new", "b::helper", "d::Worker::run", "d::<Worker as Transform>::transform", "d::hash", "d::shared", "d::Mode(Enum)"],
    "b::helper": ["d::hash", "d::Mode(Enum)"],
    "b::unused_public": ["d::unused_public"],
    "c::unused": ["d::unused_public"],
    "c::adjust": ["d::Worker::new", "d::Worker::run", "d::normalize"],
    "d::Worker::new": ["e::seed", "d::Worker(Struct)"],
    "d::Worker::run": ["e::finish", "d::Score(Type)"],
    "d::Worker::unused_method": ["e::unused_leaf"],
    "d::<Worker as Transform>::transform": ["d::Worker::run", "e::mix", "d::Transform(Trait)"],
    "d::<Worker as Default>::default": ["d::Worker::new"],
    "d::hash": ["e::mix", "d::Mode(Enum)", "d::SALT(Const)", "d::Score(Type)"],
    "d::normalize": ["d::hash"],
    "d::shared": ["d::hash"],
    "d::unused_public": ["d::unused_private"],
    "d::unused_private": ["e::unused_leaf"],
    "d::SALT(Const)": ["e::DEFAULT_SEED(Const)", "d::Score(Type)"],
    "d::Score(Type)": ["e::Score(Type)"],
    "e::mix": ["e::DEFAULT_SEED(Const)", "e::Score(Type)"],
    "e::finish": ["e::mix"],
    "e::seed": ["e::DEFAULT_SEED(Const)"],
    "e::tempting_but_unused": ["e::unused_leaf"],
}


def walk(links, roots):
    seen, work = set(roots), list(roots)
    while work:
        for x in links.get(work.pop(), ()):
            if x not in seen:
                seen.add(x)
                work.append(x)
    return seen


def edge_rows(spark, links):
    return spark.createDataFrame([(a, b) for a, bs in links.items() for b in bs], "src string, dst string")


def test_five_crate_graph_with_cycles(spark):
    links = GRAPH | {"x": ["y"], "y": ["x"], "e::seed": ["e::seed", "e::DEFAULT_SEED(Const)", "e::mix"]}
    got = closure.reach(edge_rows(spark, links), spark.createDataFrame([("a::open_source_entry",), (None,)], "node string"))
    names = {r.node for r in got.collect()}
    assert names == walk(links, ["a::open_source_entry"])
    assert len([n for n in names if "(" not in n]) == 13 and len([n for n in names if n.endswith(")")]) == 7
    every = spark.createDataFrame([(n,) for n in {*links, *(x for v in links.values() for x in v)}], "node string")
    assert {"a::internal_entry", "x", "d::<Worker as Default>::default", "e::unused_leaf"} <= {r.node for r in closure.unreachable(every, got).collect()}


def test_many_roots_random_graph_and_depth(spark):
    rng = random.Random(1)
    links = {str(i): [str(rng.randrange(60)) for _ in range(rng.randint(0, 2))] for i in range(60)}
    roots = spark.createDataFrame([(str(r), str(r)) for r in range(10)], "root string, node string")
    got = closure.reach(edge_rows(spark, links), roots, by=("root",))
    have = {}
    for r in got.collect():
        have.setdefault(r.root, set()).add(r.node)
    assert have == {str(r): walk(links, [str(r)]) for r in range(10)}
    assert {r.node for r in closure.reach(edge_rows(spark, links), roots.limit(1).select("node"), max_depth=0).collect()} <= {str(i) for i in range(10)}
    assert closure.reach(edge_rows(spark, links), roots.limit(0), by=("root",)).count() == 0


def test_package_closure_keeps_a_foreign_root(spark):
    deps = spark.createDataFrame([("app", "lib"), ("lib", "serde"), ("out", "app")], "package string, dep_package string")
    members = spark.createDataFrame([("app",), ("lib",)], "package string")
    roots = spark.createDataFrame([("out",)], "package string")
    assert {r.package for r in closure.package_closure(deps, members, roots).collect()} == {"out", "app", "lib"}


def test_chains_end_on_cycles(spark):
    aliases = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("q", "r")], "path string, target string")
    got = closure.resolve_chain(spark.createDataFrame([(s,) for s in "abcxq"], "start string"), aliases, spark.createDataFrame([("c",)], "path string"))
    assert {r.start: r.target for r in got.collect()} == {"a": "c", "b": "c", "c": "c", "x": None, "q": None}


def test_module_tree_visits_a_file_once(spark):
    declared = spark.createDataFrame([("lib", "a", ["a.rs", "a/mod.rs"]), ("a.rs", "b", ["a/b.rs", "a/b/mod.rs"]), ("lib", "c", ["c.rs"]), ("a/b/mod.rs", "up", ["lib"])], "path string, module string, candidates array<string>")
    files = spark.createDataFrame([("lib",), ("a.rs",), ("a/b/mod.rs",)], "path string")
    got = closure.module_tree(declared, files, spark.createDataFrame([("lib",)], "path string"))
    assert {r.path: (r.module_path, r.depth) for r in got.collect()} == {"lib": ([], 0), "a.rs": (["a"], 1), "a/b/mod.rs": (["a", "b"], 2)}
    assert [r.module for r in closure.missing_modules(declared, files).collect()] == ["c"]


def test_unknown_evidence_spreads(spark):
    cand = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    links = spark.createDataFrame([("a", "b"), ("b", "z"), ("d", "e")], "owner string, dep string")
    ev = spark.createDataFrame([("a", False, True, False, False), ("c", True, False, True, False), ("d", True, True, False, False), ("z", False, True, True, True)], "id string, mapped boolean, referenced boolean, failed boolean, mentioned boolean")
    assert {r.id: r.direct for r in closure.blocked_by_unknown(cand, links, ev).collect()} == {"a": True, "b": False, "c": True}


def test_innermost_spans(spark):
    table = spark.createDataFrame([("outer", "callable", "f", 1, 0, 900, 5), ("inner", "callable", "f", 300, 4, 310, 9), ("item", "item", "f", 304, 0, 305, 9), ("twin", "callable", "f", 300, 4, 310, 9), ("other", "callable", "g", 1, 0, 9, 9)], "id string, kind string, file string, start_line int, start_col int, end_line int, end_col int")
    points = spark.createDataFrame([(1, "f", 300, 4), (2, "f", 310, 9), (3, "f", 310, 10), (4, "f", 304, 1), (5, "f", 901, 0), (6, "h", 1, 1), (7, "f", 300, 3)], "point int, file string, line int, col int")
    got = {r.point: r.owner for r in spans.innermost(points, table).collect()}
    assert got == {1: "inner", 2: "inner", 3: "outer", 4: "inner", 5: None, 6: None, 7: "outer"}


def test_offsets_round_trip(spark):
    text = "ab\n\nçd\nx"
    df = spark.createDataFrame([(i,) for i in range(len(text) + 2)], "o int").withColumn("t", F.lit(text)).withColumn("p", spans.position_of(F.col("t"), F.col("o")))
    for r in df.withColumn("back", spans.offset_of(F.col("t"), F.col("p.line"), F.col("p.col"))).collect():
        if r.o > len(text):
            assert r.p is None
        else:
            assert (r.p.line, r.p.col, r.back) == (text[: r.o].count("\n") + 1, r.o - (text[: r.o].rfind("\n") + 1), r.o)


def test_adjacent_dedup_keeps_separated_equals(spark):
    rows = spark.createDataFrame([(0, None, 1, "k", "A"), (1, None, 1, "k", "B"), (2, None, 1, "k", "A"), (3, "f", 1, "k", "A"), (4, "f", 1, "k", "A")], "ord int, file string, line int, kind string, code string").withColumn("run", F.lit(1))
    got = order.sorted_adjacent_dedup(rows, ["file", "line", "kind"], ["file", "line", "kind", "code"], ["run"], "ord")
    assert sorted(r.ord for r in got.collect()) == [0, 1, 2, 3]
    assert order.full_dedup(rows, ["file", "code"], "ord").count() == 3


def test_budgets(spark):
    rows = spark.createDataFrame([(i, i % 3, None if i == 4 else "x") for i in range(10)], "id int, p int, s string")
    got = order.ordered_budget(rows, 4, [F.col("p"), F.col("id")])
    assert sorted(r.id for r in got.filter("queried").collect()) == [0, 3, 6, 9] and got.count() == 10
    assert order.ordered_budget(rows, 0, [F.col("id")]).filter("queried").count() == 0


def brute_greedy(items):
    out = []
    for s, e, r in sorted(set(items)):
        if out and (s < out[-1][1] or (s, e) == out[-1][:2]):
            continue
        out.append((s, e, r))
    return out


def test_greedy_edits(spark):
    rng = random.Random(2)
    rows = [(f, s, s + rng.randint(0, 4), rng.choice("xyz")) for f in range(30) for s in [rng.randrange(20) for _ in range(8)]]
    got = edits.greedy_intervals(spark.createDataFrame(rows, "file int, start int, stop int, payload string"), "file", "start", "stop", "payload").collect()
    for f in range(30):
        assert sorted((r.start, r.stop, r.payload) for r in got if r.file == f) == brute_greedy([x[1:] for x in rows if x[0] == f])


def test_edits_are_applied_from_the_right(spark):
    files = spark.createDataFrame([("a", "hello world"), ("b", "same"), ("c", "")], "file string, text string")
    e = [("a", 0, 5, "bye"), ("a", 5, 5, ","), ("a", 3, 8, "no"), ("a", 6, 11, "world"), ("b", 0, 4, "same"), ("b", 9, 12, "x"), ("c", 0, 0, "new")]
    got = {r.file: (r.text, r.applied) for r in edits.apply_edits(files, spark.createDataFrame(e, "file string, start int, stop int, replacement string")).collect()}
    assert got == {"a": ("bye, world", 2), "b": ("same", 0), "c": ("new", 1)}


def test_source_edits(spark):
    src = "use a::{B, C};\nuse x::D;\n    pub fn f() {}\n"
    r = spark.range(1).select(edits.remove_use_name(F.lit(src), "D").alias("d"), edits.remove_use_name(F.lit(src), "B").alias("b"), edits.insert_above(F.lit(src), F.lit(3), "#[allow(dead_code)]").alias("i"), edits.collapse_separators(F.lit("a::::b::::::c")).alias("c"), edits.strip_absolute_roots(F.lit("::Foo<::serde::X>"), ["serde"]).alias("s")).first()
    assert "D;" not in r.d and "B" not in r.b.split(";")[0] and "    #[allow(dead_code)]\n    pub fn" in r.i and r.c == "a::b::c" and r.s == "Foo<::serde::X>"
    c = spark.createDataFrame([("f", "suggestions", "edit"), ("f", "imports", "edit"), ("g", "items", "allow"), ("g", "items", "structural"), ("h", "items", "allow")], "file string, pass string, kind string")
    assert sorted((x.file, x["pass"], x.kind, x.state) for x in edits.passes_that_run(c).collect()) == [("f", "imports", "edit", "skipped"), ("f", "suggestions", "edit", "applied"), ("g", "items", "allow", "deferred"), ("g", "items", "structural", "applied"), ("h", "items", "allow", "applied")]


def fnv(data, h=0xCBF29CE484222325):
    for b in data:
        h = (h ^ b) * 1099511628211 % 2**64
    return h


def test_hashes(spark):
    texts = ["", "a", "foobar", "é😀", "x" * 300]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = df.select("t", hashing.fnv1a64(F.col("t")).alias("h"), hashing.fingerprint(F.col("t")).alias("p"), hashing.seeded_score(F.col("t"), 99).alias("s"), hashing.cache_key([F.col("t"), F.lit("b")]).alias("k")).collect()
    for r in got:
        if r.t is None:
            assert r.h is None and r.p is None
        else:
            data = r.t.encode()
            assert (int(r.h), r.p, int(r.s), r.k) == (fnv(data), f"{fnv(data):016x}", fnv(data, 99 ^ 0xCBF29CE484222325), f"{fnv(data + b'\0b\0'):016x}")


def test_kleene_tables(spark):
    rows = [("tt", True), ("tt", True), ("tn", True), ("tn", None), ("fn", False), ("fn", None), ("ff", False), ("nn", None)]
    got = {r.g: (r.a, r.o) for r in spark.createDataFrame(rows, "g string, v boolean").groupBy("g").agg(kleene.kleene_all(F.col("v")).alias("a"), kleene.kleene_any(F.col("v")).alias("o")).collect()}
    assert got == {"tt": (True, True), "tn": (None, True), "fn": (False, None), "ff": (False, False), "nn": (None, None)}
    empty = spark.createDataFrame([], "v boolean").agg(kleene.kleene_all(F.col("v")), kleene.kleene_any(F.col("v"))).first()
    assert tuple(empty) == (True, False)


def test_conditions(spark):
    facts = arguments.triple_facts(F.lit("x86_64-unknown-linux-gnu"))
    def value(text, features=(), everything=False):
        c = kleene.parse(text)
        return spark.range(1).select(kleene.check_time(c, facts, F.array(*[F.lit(f) for f in features]).cast("array<string>"), F.lit("app"), F.lit(everything))).first()[0]
    assert value('#[cfg(feature = "fast")]', ["fast"]) is True and value('feature = "fast"') is None and value('feature = "fast"', ["app/fast"]) is True and value('feature = "q"', (), True) is True
    assert value("cfg(unix)") is True and value("windows") is False and value('target_os = "macos"') is False and value("custom_flag") is None and value("not(custom_flag)") is None
    assert value('any(unix, feature = "x")') is True and value('all(windows, feature = "x")') is False and value('all(unix, not(feature = "x"))') is None
    assert value('cfg_attr(target_pointer_width = "64", derive(Debug))') is True
    assert kleene.parse("all(") is None and kleene.parse("other(unix)") is None and kleene.parse('a = "b" c') is None
    test = spark.range(1).select(kleene.parse_time(kleene.parse("not(test)"), facts), kleene.parse_time(kleene.parse('feature = "x"'), facts)).first()
    assert tuple(test) == (True, None)


def test_targets_and_arguments(spark):
    rows = {"aarch64-apple-darwin": ("aarch64", "macos", "unix", "little"), "i686-pc-windows-msvc": ("x86", "windows", "windows", "little"), "wasm32-unknown-unknown": ("wasm32", "none", "wasm", "little"), "s390x-unknown-linux-gnu": ("s390x", "linux", "unix", "big")}
    for triple, want in rows.items():
        m = spark.range(1).select(arguments.triple_facts(F.lit(triple))).first()[0]
        assert tuple(m[k][0] for k in ("target_arch", "target_os", "target_family", "target_endian")) == want
    m = spark.range(1).select(arguments.printed_facts(F.array(F.lit("unix"), F.lit('target_os="linux"'), F.lit(' target_feature="sse" '), F.lit('target_feature="avx"'), F.lit("")))).first()[0]
    assert m == {"target_feature": ["avx", "sse"], "target_os": ["linux"], "unix": []}
    args = lambda *a: F.array(*[F.lit(x) for x in a]).cast("array<string>")
    r = spark.range(1).select(
        arguments.enabled_features(args("--features", "b,a c", "--features=d", "-p", "x")), arguments.enabled_features(args()), arguments.package_scope(args("-p", "x", "--package=y")),
        arguments.covers_target(args("--bin", "b"), F.lit("bin"), F.lit("b")), arguments.covers_target(args("--bin", "b"), F.lit("lib"), F.lit("l")), arguments.covers_target(args("--test=t"), F.lit("test"), F.lit("t")), arguments.covers_target(args(), F.lit("lib"), F.lit("l")),
        arguments.features_enabled(args("a"), F.lit("p"), args("p/a"), F.lit(False)),
    ).first()
    assert tuple(r) == (["a", "b", "c", "d"], [], ["x", "y"], True, False, True, True, True)


def test_include_paths():
    s = arguments.static_include
    assert s('"a/b.txt"') == ("relative", "a/b.txt") and s('concat!(env!("CARGO_MANIFEST_DIR"), "/x", "y")') == ("manifest", "xy")
    assert s('concat!("a", env!("CARGO_MANIFEST_DIR"))')[0] == "unknown" and s('env!("OUT_DIR")')[0] == "unknown" and s("path()")[0] == "unknown"
    assert arguments.confined("/o", "a/b") and not arguments.confined("/o", "../x") and not arguments.confined("/o", "/etc")


def test_identifiers(spark):
    a = lambda *x: F.array(*[F.lit(i) for i in x]).cast("array<string>")
    r = spark.range(1).select(
        ident.free_id(F.lit("p"), a("m"), F.lit("f")), ident.method_id(F.lit("p"), a("m", "T"), F.lit("f")), ident.package_of(F.lit("plain")),
        ident.normalized(a("m", "n"), a("super", "super", "X")), ident.normalized(a("m"), a()), ident.aliased(a("A", "b"), a("x", "y")),
        ident.output_slug(F.lit(7), F.lit("::a  b::")), ident.output_slug(F.lit(1), F.lit("::")), ident.first_ticked(F.lit("x `` `a`")), ident.all_ticked(F.lit("`a` `` `b")),
        ident.diagnostic_symbol(F.lit("E0609"), F.lit("no field `q` on type `Foo`"), F.lit(None).cast("string")), ident.diagnostic_symbol(F.lit("E0560"), F.lit("struct `Bar` has no field `q`"), F.lit(None).cast("string")),
        ident.is_workspace_source(F.lit("/w/a/src/x.rs"), "/w"), ident.is_workspace_source(F.lit("/w/target/x.rs"), "/w"), ident.occurrences(F.lit("ab a_b b ab"), "ab"),
    ).first()
    assert tuple(r) == ("p::m::f", "p::m::T::f", "plain", ["m", "super", "X"], [], ["x", "y", "b"], "0007-a_b", "0001-root", None, ["a"], "Foo", "Bar", True, False, 2)


def test_slugs_of_long_ordinals(spark):
    slugs = [r.s for r in spark.createDataFrame([(9999,), (10_000,), (10_001,), (123_456,)], "n bigint").orderBy("n").select(ident.output_slug(F.col("n"), F.lit("a b")).alias("s")).collect()]
    assert slugs == ["9999-a_b", "10000-a_b", "10001-a_b", "123456-a_b"]


DIAG = "run string, ord int, level string, message string, code string, package_id string, target struct<name:string,kind:array<string>,src_path:string>, rendered string, spans array<struct<file_name:string,line_start:bigint,column_start:bigint,column_end:bigint,is_primary:boolean>>, suggestions array<struct<suggested_replacement:string>>"


def diags(spark, *rows):
    full = [Row(run=r.get("run", "r"), ord=i, level=r.get("level", "error"), message=r.get("message", "m"), code=r.get("code"), package_id=r.get("package"), target=r.get("target"), rendered=r.get("rendered"), spans=r.get("spans", []), suggestions=r.get("suggestions", [])) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, DIAG)


def test_baseline_keys(spark):
    primary = [("f.rs", 1, 2, 3, True), ("a.rs", 9, 2, 3, True), ("z.rs", 9, 2, 3, False)]
    moved = [("a.rs", 5, 5, 5, True), ("f.rs", 7, 7, 7, True)]
    base = diags(spark, {"code": "E1", "spans": primary, "rendered": "x"}, {"code": "cargo-stderr", "rendered": "one"})
    now = diags(spark, {"code": "E1", "spans": moved, "rendered": "y"}, {"code": "cargo-stderr", "rendered": "two"}, {"code": "E1", "spans": moved, "package": "p"}, {"level": "warning"})
    assert tuple(diag.against_baseline(now, base).first()) == (1, 2)
    assert not diag.all_known(now, base, True, True) and diag.all_known(now.limit(1), base, True, True) and not diag.all_known(now.limit(1), base, False, True) and not diag.all_known(now.limit(0), base, True, True)
    assert diag.exact_signature(base.limit(1)).first()[1] != diag.exact_signature(now.limit(1)).first()[1]
    assert diag.shape_signature(base.limit(1)).first()[1] == diag.shape_signature(now.limit(1)).first()[1]


def test_rules(spark):
    rows = diags(spark, {"code": "E0277", "message": "x: From<y>"}, {"code": "E0277"}, {"code": "E0425"}, {"code": "E0425", "level": "warning"}, {"code": "E9999"}, {}, {"level": "warning", "code": "non_snake_case", "message": "variable `A`"}, {"level": "warning", "code": "dead_code", "message": "field `x` is never read"}, {"code": "E0583"})
    assert sorted(r.ord for r in diag.widening_candidates(rows).collect()) == [0, 2, 8]
    got = rows.select("ord", diag.hazard(F.col("level"), F.col("code"), F.col("message")).alias("h"), diag.is_repairable(F.col("level"), F.col("code"), F.col("message")).alias("r")).orderBy("ord").collect()
    assert [r.h.severity if r.h else None for r in got] == ["high", "high", "high", "high", "medium", None, "high", None, "blocker"]
    assert [r.ord for r in got if r.r] == [7]


def test_mismatches_and_fallbacks(spark):
    rows = diags(spark, {"code": "E0432", "message": "unresolved `p::t::App`", "suggestions": [(" Account ",)]}, {"code": "E0432", "message": "unresolved `p::x`", "rendered": "try `Other`"})
    entries = spark.createDataFrame([("Account", "Account", 1), ("p::t::App", None, 0), ("p::x", None, 0)], "symbol string, name string, matches int")
    assert [r.ord for r in diag.api_mismatches(rows, entries).collect()] == [0]
    runs = spark.createDataFrame([("r", False, False, ""), ("s", False, True, "note\nerror: boom\n"), ("t", False, False, "\n  first\n"), ("u", True, False, "")], "run string, success boolean, timed_out boolean, stderr string")
    got = {(r.run, r.code, r.message) for r in diag.with_fallback(rows, runs).collect() if r.code != "E0432"}
    assert got == {("s", "cargo-stderr", "error: boom"), ("s", "cargo-timeout", "the check timed out"), ("t", "cargo-stderr", "first")}


def test_root_resolution(spark):
    wanted = spark.createDataFrame([("x::helper", None), ("helper", "app"), ("Gone", None), ("many", None), ("main", None)], "symbol string, package_hint string")
    symbols = spark.createDataFrame([("app::helper", "app"), ("lib::helper", "lib"), *[(f"p{i}::many", f"p{i}") for i in range(5)], ("app::main", "app")], "id string, package string")
    got = {r.symbol: (r.outcome, r.roots) for r in diag.resolve_roots(wanted, symbols, spark.createDataFrame([("app::main",)], "id string"), 3).collect()}
    assert got == {"x::helper": ("matched", ["app::helper", "lib::helper"]), "helper": ("matched", ["app::helper"]), "Gone": ("no_match", []), "many": ("too_many_matches", []), "main": ("marked_root", [])}


def test_audits(spark):
    d = spark.createDataFrame([("a", "used"), ("a", None), ("b", "blocked_by_unknown"), ("b", "prunable")], "package string, decision string")
    assert sorted(tuple(r) for r in audit.contract(d, by=("package",)).collect()) == [("a", 1, 0, 1, False), ("b", 0, 1, 1, False)]
    s = spark.createDataFrame([("a", "reachable_items"), (None, "unknown_surfaces")], "package string, surface string")
    got = {r.package: r for r in audit.surface_audit(s, spark.createDataFrame([("a",), ("z",)], "package string"), spark.createDataFrame([("root",)], "package string")).collect()}
    assert set(got) == {"a", "z", "root", "<unknown-package>"} and got["a"].reachable_items == 1 and got["z"].macro_surfaces == 0 and got["<unknown-package>"].unknown_surfaces == 1
    e = spark.createDataFrame([(1, 2, ["y"], "k"), (0, 3, ["x"], "k")], "ord int, n int, d array<string>, g string")
    assert tuple(audit.evidence_sum(e, ["n"], ["d"], ["g"]).first()) == ("k", 5, ["x", "y"])
    p = spark.createDataFrame([("fn", True, False, False, False, False, False, False), ("fn", False, False, False, False, True, False, True), ("fn", False, False, False, False, False, False, False)], "kind string, cfg_inactive boolean, source_file_pruned boolean, rendered_absent boolean, structural_pruned boolean, unmapped boolean, failed_query boolean, proven boolean")
    r = audit.usage_proof(p).first()
    assert (r.required, r.proven, r.unproven, r.cfg_inactive, r.unmapped) == (3, 1, 2, 1, 1)


def test_preflight(spark):
    t = {
        "workspace": spark.createDataFrame([("/w/Cargo.toml",)], "manifest string"),
        "members": spark.createDataFrame([("a", "/w/a/Cargo.toml", "/w/a/lib.rs", "/w/a/build.rs"), ("b", "/w/b/Cargo.toml", None, None)], "package string, manifest string, entry string, build_script string"),
        "manifests": spark.createDataFrame([("/w/a/Cargo.toml", "syntax")], "manifest string, status string"),
        "metadata": spark.createDataFrame([("/w/Cargo.toml", "ok")], "manifest string, status string"),
        "files": spark.createDataFrame([("/w/Cargo.toml",), ("/w/a/Cargo.toml",), ("/w/a/lib.rs",), ("/w/a/x.rs",), ("/w/a/x/mod.rs",)], "path string"),
        "rust_files": spark.createDataFrame([("/w/a/x.rs", "syntax"), ("/w/a/x.rs", "syntax")], "path string, status string"),
        "targets": spark.createDataFrame([("a", "bin", "x", ["/w/a/x.rs", "/w/a/x/mod.rs"]), ("a", "bin", None, []), ("a", "test", "t", ["/w/a/t.rs"]), ("a", "test", "t", ["/w/a/t.rs"])], "package string, kind string, name string, candidates array<string>"),
        "dependencies": spark.createDataFrame([("a", "/w/q", False), ("a", None, False), ("a", None, True)], "package string, path string, workspace boolean"),
        "modules": spark.createDataFrame([("/w/a/lib.rs", "x", ["/w/a/x.rs"]), ("/w/a/lib.rs", "y", ["/w/a/y.rs"])], "path string, module string, candidates array<string>"),
    }
    got = sorted(r.code for r in preflight.workspace_findings(t).collect())
    assert got == sorted(["missing-package-manifest", "missing-build-script", "missing-path-dependency", "missing-target-source", "ambiguous-target-source", "duplicate-target-name", "missing-target-name", "missing-module-file", "manifest-syntax-error", "rust-syntax-error", "rust-syntax-error"])
    assert tuple(preflight.counters(t).first()) == (2, 1, 1, 1, 1)


def test_verdicts(spark):
    v = lambda *a: spark.range(1).select(verdict.final_verdict(*[F.lit(x) for x in a])).first()[0]
    assert v("accepted", "hazards_detected", "accepted", 0) == "failed" and v("accepted", "ready_for_feedback", "not_required", 5) == "accepted" and v("accepted", "x", "accepted", 0) == "accepted"
    assert v("accepted", "x", "accepted", 1) == "review_required" and v("baseline_limited", "x", "accepted", 0) == "baseline_limited" and v("rejected", "x", "failed", 0) == "failed" and v("missing", "x", "accepted", 0) == "failed"
    h = spark.createDataFrame([("cfg_gated_roots", [(True,)]), ("cfg_gated_roots", []), ("cfg_gated_roots", [(True,), (None,)]), ("x", [(True,)])], "code string, details array<struct<covered:boolean>>")
    assert [r[0] for r in h.select(verdict.error_discharged(F.col("code"), F.col("details"))).collect()] == [True, False, False, False]
    f = spark.createDataFrame([("r", False, [("p", ["a", "q/b"], False), ("p", ["c"], True)]), ("s", True, [("p", ["a"], False)])], "run string, all_features boolean, details array<struct<package:string,features:array<string>,covered:boolean>>")
    assert {tuple(r) for r in verdict.uncovered_features(f).collect()} == {("r", "p/a,q/b", 1), ("s", "", 0)}


@pytest.mark.parametrize(
    ("change", "label", "passed"),
    [
        ({}, "slice_check_passed", True),
        ({"timed_out": True}, "slice_generation_failed", False),
        ({"preflight_ok": False}, "slice_preflight_failed", False),
        ({"preflight_only": True, "feedback_ok": None}, "slice_preflight_passed", True),
        ({"feedback_ok": None}, "slice_generation_failed", False),
        ({"errors": 1}, "slice_feedback_failed", False),
        ({"errors": 1, "all_known": True}, "slice_baseline_limited_passed", True),
        ({"errors": 1, "all_known": True, "semantic_warnings": 1}, "slice_semantic_warning_failed", False),
        ({"semantic_warnings": 1}, "slice_semantic_warning_failed", False),
        ({"warnings": 1, "stop_on_warning": True}, "slice_feedback_failed", False),
        ({"validation_status": "rejected", "matrix_gate": "failed"}, "slice_production_matrix_failed", False),
        ({"baseline_ok": False}, "baseline_failed", False),
    ],
)
def test_corpus_labels(spark, change, label, passed):
    row = {"timed_out": False, "exit_code": 0, "preflight_ok": True, "feedback_ok": True, "errors": 0, "warnings": 0, "semantic_warnings": 0, "all_known": False, "preflight_only": False, "deny_warnings": False, "stop_on_warning": False, "baseline_ok": True, "validation_status": None, "matrix_gate": None} | change
    schema = "timed_out boolean, exit_code int, preflight_ok boolean, feedback_ok boolean, errors int, warnings int, semantic_warnings int, all_known boolean, preflight_only boolean, deny_warnings boolean, stop_on_warning boolean, baseline_ok boolean, validation_status string, matrix_gate string"
    r = spark.createDataFrame([tuple(row.values())], schema).withColumn("label", verdict.corpus_label()).withColumn("passed", verdict.corpus_passed(F.col("label"))).first()
    assert (r.label, r.passed) == (label, passed)


def test_corpus_labels_of_errors_with_semantic_warnings(spark):
    rows = spark.createDataFrame([(1, True), (2, False)], "n int, all_known boolean").withColumns({
        "timed_out": F.lit(False), "exit_code": F.lit(0), "preflight_ok": F.lit(True), "feedback_ok": F.lit(True), "errors": F.lit(1), "warnings": F.lit(0), "semantic_warnings": F.lit(1), "preflight_only": F.lit(False),
        "deny_warnings": F.lit(False), "stop_on_warning": F.lit(False), "baseline_ok": F.lit(True), "validation_status": F.lit(None).cast("string"), "matrix_gate": F.lit(None).cast("string"),
    })
    got = rows.withColumn("label", verdict.corpus_label()).withColumn("passed", verdict.corpus_passed(F.col("label"))).orderBy("n").collect()
    assert [(r.label, r.passed) for r in got] == [("slice_semantic_warning_failed", False), ("slice_feedback_failed", False)]


def test_loops(spark):
    bad, worse, good = diags(spark, {"code": "E1"}), diags(spark, {"code": "E2"}), diags(spark).limit(0)
    seen = []
    def check(n, roots):
        seen.append(sorted(r.id for r in roots.collect()) if roots is not None else [])
        return loops.Attempt([bad, worse, good][min(n, 3) - 1], n >= 3)
    out = loops.feedback_loop(check, lambda said, roots: said.select(F.col("code").alias("id")), 3)
    assert (out.status, out.attempts) == ("accepted", 3) and seen == [[], ["E1"], ["E1", "E2"]]
    assert loops.feedback_loop(lambda n, r: loops.Attempt(bad, False), None, 3).status == "exhausted"
    assert loops.feedback_loop(lambda n, r: loops.Attempt(bad, False), lambda s, r: s.select(F.col("code").alias("id")), 5).status == "repeated"
    assert loops.feedback_loop(lambda n, r: loops.Attempt(bad, False), None, 2, baseline=loops.Attempt(bad, False)).status == "baseline_limited"
    assert loops.repair_loop(lambda n: loops.Attempt(diags(spark, {"level": "warning", "code": "unused_imports"}), True), 2).status == "repeated"
    lines = lambda n: diags(spark, {"code": "E1", "spans": [("f", n, 1, 1, True)]})
    assert loops.repair_loop(lambda n: loops.Attempt(lines(n), False, repaired=True), 4).status == "low_progress"


def test_resolution(spark):
    items = spark.createDataFrame([("p", ["m"], "T", "Struct"), ("p", [], "U", "Enum"), ("p", [], "f", "Fn")], "package string, module_path array<string>, name string, kind string")
    aliases = spark.createDataFrame([("p", [], "Alias", ["m", "T"]), ("p", ["k"], "Loop", ["k", "Loop"])], "package string, module_path array<string>, name string, target array<string>")
    wanted = spark.createDataFrame([(1, "p", ["m", "x"], ["T"]), (2, "p", [], ["Alias"]), (3, "p", ["m"], ["U"]), (4, "p", ["k"], ["Loop"]), (5, "p", [], ["f"])], "id int, package string, module_path array<string>, path array<string>")
    assert {r.id: r.canonical for r in resolve.canonical_types(wanted, items, aliases).collect()} == {1: "p::m::T", 2: "p::m::T", 3: "p::U", 4: "p::Loop", 5: "p::f"}
    globs = spark.createDataFrame([("p", ["k"], ["super"])], "package string, module_path array<string>, prefix array<string>")
    assert {tuple(r.module_path) + (r.name,) for r in resolve.inherited_aliases(aliases, globs).collect()} == {("Alias",), ("k", "Loop"), ("k", "Alias")}
    assert spark.range(1).select(resolve.peeled_receiver(F.lit("(&mut x.clone().unwrap())?"))).first()[0] == "x"
    assert resolve.single_marked(spark.createDataFrame([("p", "a", True), ("p", "b", False)], "package string, name string, marked boolean")).first().target == "a"
    with pytest.raises(Exception, match="several marked"):
        resolve.single_marked(spark.createDataFrame([("p", "a", True), ("p", "b", True)], "package string, name string, marked boolean")).collect()


@pytest.mark.parametrize(("budget", "marked"), [(0, 0), (1, 1), (3, 3), (4, 4), (9, 4)])
def test_budget_of_repeated_rows(spark, budget, marked):
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (2, None)], "k int, v string")
    got = order.ordered_budget(rows, budget, [F.col("k")]).collect()
    assert sorted((r.k, r.v or "") for r in got) == [(1, "x")] * 3 + [(2, "")]
    assert sum(r.queried for r in got) == marked and all(r.k == 1 for r in got if r.queried) == (budget < 4)


def test_pins_are_given_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a")], "id int, name string")
    with pytest.raises(ValueError, match="twice"):
        order.pinned(rows, spark.createDataFrame([(1, "a"), (2, "a")], "pin int, name string"), ["name"])


def test_chains_of_length_and_cycles(spark):
    aliases = [(f"p{i}", f"p{i + 1}") for i in range(40)] + [("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("dead", "nowhere")]
    starts = spark.createDataFrame([("p0",), ("p39",), ("c0",), ("dead",), ("p40",), ("unknown",)], "start string")
    got = closure.resolve_chain(starts, spark.createDataFrame(aliases, "path string, target string"), spark.createDataFrame([("p40",)], "path string"))
    assert {r.start: r.target for r in got.collect()} == {"p0": "p40", "p39": "p40", "c0": None, "dead": None, "p40": "p40", "unknown": None}


def test_closure_merges_its_layers(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(25)] + [(25, 0)], "src int, dst int")
    got = closure.reach(edges, spark.createDataFrame([(0,)], "node int"))
    assert {(r.node, r.depth) for r in got.collect()} == {(i, i) for i in range(26)}


def test_no_folder_of_the_machine(spark):
    from graftwork.operators import staging

    class Bare:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_folder(Bare())


def edge_sums(rows):
    out = {}
    for r in rows:
        n, total = out.get(r.owner, (0, 0))
        out[r.owner] = (n + 1, total + r.dep)
    return out


def test_ufcs_counts_are_those_of_the_edges(spark):
    """Ids under several keys, repeated rows, owners that meet themselves, nulls; and no row for each edge."""
    rnd = random.Random(3)
    methods = [("p", rnd.choice("ABC"), rnd.choice(["x", "y", None]), rnd.randrange(2), rnd.choice([None, *range(40)])) for _ in range(90)]
    calls = [(rnd.choice([None, *range(30)]), "p", rnd.choice(["A", "B", "C", None]), rnd.choice(["x", "y", "z", None]), rnd.randrange(2)) for _ in range(60)]
    methods = spark.createDataFrame(methods, "package string, type_path string, trait_path string, method int, id bigint")
    calls = spark.createDataFrame(calls, "owner bigint, package string, type_path string, trait_path string, method int")
    want = edge_sums(edges.ufcs_method(calls, methods).collect())
    assert want and {r.owner: (r.n, r.total) for r in edges.ufcs_counts(calls, methods).collect()} == want


def test_method_counts_are_those_of_the_edges(spark):
    """An id under two receivers counts once for an owner; calls without a receiver keep their single match."""
    rnd = random.Random(5)
    methods = [("p", rnd.choice("ABC"), rnd.randrange(4), rnd.randrange(40)) for _ in range(60)] + [("p", "A", 9, 3)]
    calls = [(rnd.choice([None, *range(30)]), "p", rnd.choice(["A", "B", "C", None]), rnd.choice([0, 1, 2, 3, 9])) for _ in range(80)]
    index = resolve.methods_by_receiver(spark.createDataFrame(methods, "package string, type_path string, method int, id bigint"))
    calls = spark.createDataFrame(calls, "owner bigint, package string, type_path string, method int")
    want = edge_sums(resolve.edges_by_method(calls, index).collect())
    assert want and {r.owner: (r.n, r.total) for r in resolve.method_edge_counts(calls, index).collect()} == want


def test_trait_bound_counts_are_those_of_the_edges(spark):
    rnd = random.Random(7)
    methods = [("p", rnd.choice(["x", "y", None]), rnd.randrange(3), rnd.choice([None, *range(40)])) for _ in range(90)]
    calls = [(rnd.choice([None, *range(30)]), "p", rnd.choice(["x", "y", "z", None]), rnd.randrange(3)) for _ in range(60)]
    methods = spark.createDataFrame(methods, "package string, trait_path string, method int, id bigint")
    calls = spark.createDataFrame(calls, "owner bigint, package string, bound string, method int")
    want = edge_sums(edges.trait_bound_method(calls, methods).collect())
    assert want and {r.owner: (r.n, r.total) for r in edges.trait_bound_counts(calls, methods).collect()} == want


def test_trait_bound_edges_reads_every_call(spark):
    """Nearly every order has a line of a bound method, whatever its quantity."""
    from graftwork.plans import ORACLES, QUERIES

    folder = "/root/testdata/sf0.001"
    assert "l_quantity" not in ORACLES["trait_bound_edges"]
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").filter("l_quantity < 50").select("l_orderkey").distinct()
    assert QUERIES["trait_bound_edges"](spark, folder).count() >= lines.count() * 0.9


def test_slugs_of_any_text(spark):
    """The first 96 characters of the cleaned text: runs at the ends, at the cut, and nothing but runs."""
    rnd = random.Random(9)
    texts = ["", "___", "é" * 200, "-_-", "a" * 95 + "_ b", "a" * 96 + " ", "\n\n" + "é\U0001f600" * 50 + "a" * 94 + "__ \n" + "b" * 300] + ["".join(rnd.choices("aZ9-_ é\n\U0001f600", k=rnd.randrange(300))) for _ in range(200)]
    clean = [re.sub("^_+|_+$", "", re.sub("_+", "_", re.sub("[^A-Za-z0-9_-]", "_", x))) for x in texts]
    got = spark.createDataFrame(list(enumerate(texts)), "n bigint, t string").orderBy("n").select(ident.output_slug(F.col("n"), F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == [f"{n:04}-{(c or 'root')[:96]}" for n, c in enumerate(clean)]


def test_slugs_stop_where_they_are_full(spark):
    """A text of many megabytes costs no more than its start."""
    long = spark.range(40).select("id", F.repeat(F.lit("ab cd\n"), F.lit(500_000)).alias("t")).persist()
    assert long.count() == 40
    start = time.monotonic()
    assert long.select(F.length(ident.output_slug(F.col("id"), F.col("t"))).alias("n")).agg(F.sum("n")).first()[0] == 40 * 101
    assert time.monotonic() - start < 20
