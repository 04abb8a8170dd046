"""Names, sources and arguments on the star tables."""

from pyspark.sql import functions as F

from graftwork.functions import arguments, ident
from graftwork.operators import audit, closure, diag, edits, order, resolve, spans, verdict
from graftwork.plans.registry import Tables, query
from graftwork.sources import readers

words = lambda *x: F.array(*[F.lit(i) for i in x]).cast("array<string>")


@query("""
WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS s FROM documents)
SELECT doc_id, count(*) AS n, min(s) AS first FROM l WHERE s <> '' AND NOT starts_with(s, '#') GROUP BY doc_id
""")
def selector_lines(t: Tables):
    return readers.selectors(t.documents.select("doc_id", "text"), "text").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("selector").alias("first"))


@query("SELECT p_name AS id, arg_max(p_brand, p_partkey) AS brand, max(p_partkey) AS ord FROM part GROUP BY p_name")
def last_wins(t: Tables):
    return resolve.last_wins(t.part.select(F.col("p_name").alias("id"), F.col("p_brand").alias("brand"), F.col("p_partkey").alias("ord")))


@query("SELECT c_mktsegment AS package, c_nationkey AS module_path, min(c_name) AS path FROM customer GROUP BY ALL")
def module_index(t: Tables):
    return resolve.module_files(t.customer.select(F.col("c_mktsegment").alias("package"), F.col("c_nationkey").alias("module_path"), F.col("c_name").alias("path")))


@query("""
WITH links AS (SELECT DISTINCT l_partkey AS part, 's' || l_suppkey AS s FROM lineitem)
SELECT part, string_agg(s, ',' ORDER BY s) AS inputs FROM links GROUP BY part
""")
def type_inputs(t: Tables):
    paths = t.lineitem.groupBy(F.col("l_partkey").alias("part")).agg(F.collect_list(F.array(F.concat(F.lit("s"), F.col("l_suppkey")))).alias("p"))
    return paths.select("part", F.array_join(resolve.type_inputs(F.col("p")), ",").alias("inputs"))


@query("""
SELECT DISTINCT p_brand AS package, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS alias, p_type AS dep_package FROM part
WHERE p_type <> 'PROMO' OR p_brand IN ('Brand#1', 'Brand#2')
""")
def dependency_rows(t: Tables):
    raw = t.part.select(F.col("p_brand").alias("package"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("rename"), F.col("p_type").alias("name"), F.when(F.col("p_type") == "PROMO", "dev").alias("kind"))
    entries = t.part.select(F.col("p_brand").alias("package")).distinct().withColumn("kind", F.when(F.col("package").isin("Brand#1", "Brand#2"), words("test")).otherwise(words("lib")))
    return resolve.dependency_rows(raw, entries)


@query("""
SELECT p_brand AS package, p_type AS src_path, coalesce(string_agg(DISTINCT p_name, ',' ORDER BY p_name) FILTER (p_size > 45), '') AS features FROM part GROUP BY ALL
""")
def required_features(t: Tables):
    targets = t.part.select(F.col("p_brand").alias("package"), F.col("p_type").alias("src_path")).distinct()
    tables = t.part.filter("p_size > 45").select(F.col("p_brand").alias("package"), F.col("p_type").alias("path"), F.array("p_name").alias("features"))
    return resolve.required_features(targets, tables).select("package", "src_path", F.array_join("required_features", ",").alias("features"))


@query("SELECT s_nationkey AS package, min(s_name) AS target FROM supplier GROUP BY s_nationkey")
def marked_targets(t: Tables):
    first = t.supplier.groupBy("s_nationkey").agg(F.min("s_name").alias("m"))
    rows = t.supplier.join(first, "s_nationkey").select(F.col("s_nationkey").alias("package"), F.col("s_name").alias("name"), (F.col("s_name") == F.col("m")).alias("marked"))
    return resolve.single_marked(rows)


@query("SELECT page_id FROM pages WHERE starts_with(url, 'https://') AND ends_with(url, '.html') AND NOT list_contains(string_split(url, '/'), 'en')")
def workspace_sources(t: Tables):
    path = F.regexp_replace(F.regexp_replace("url", "/en/", "/target/"), r"\.html$", ".rs")
    return t.pages.filter(ident.is_workspace_source(path, "https:/")).select("page_id")


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'macro_blocked' WHEN event_type IN ('view', 'click', 'purchase') THEN 'benign' WHEN user_id % 2 = 0 THEN 'dependency_risk' ELSE 'benign' END AS method,
  CASE WHEN event_type = 'error' THEN 'unresolved_method_inside_macro_or_attribute_context' WHEN event_type = 'view' THEN 'unresolved_method_has_primitive_turbofish' WHEN event_type = 'click' THEN 'unresolved_method_receiver_has_external_anchor'
    WHEN event_type = 'purchase' THEN 'unresolved_method_looks_like_common_external_receiver' WHEN user_id % 2 = 0 THEN 'unresolved_method_name_matches_project_method' ELSE 'unresolved_method_has_no_project_local_method_match' END AS method_reason,
  CASE WHEN event_type = 'error' THEN 'unresolved_path_inside_macro_or_attribute_context' WHEN event_type = 'view' THEN 'unresolved_path_has_external_root' WHEN event_type = 'click' THEN 'unresolved_path_has_external_dependency_root'
    WHEN event_type = 'purchase' THEN 'unresolved_path_has_retained_external_import' WHEN user_id % 5 = 0 THEN 'unresolved_path_is_derived_default_call' WHEN user_id % 2 = 0 THEN 'unresolved_path_anchor_matches_project_local_identifier' ELSE 'unresolved_path_has_no_project_local_identifier' END AS path
FROM events
""")
def unresolved_classes(t: Tables):
    e = F.col("event_type")
    flags = {"in_macro": e == "error", "primitive_turbofish": e == "view", "external_anchor": e == "click", "external_receiver": e == "purchase", "project_method": F.col("user_id") % 2 == 0,
             "root": F.when(e == "view", "std").otherwise("x"), "external_root": e == "click", "imported": e == "purchase", "derived_default": F.col("user_id") % 5 == 0, "project_local": F.col("user_id") % 2 == 0}
    rows = t.events.withColumns(flags)
    return rows.select("event_id", resolve.unresolved_method()["category"].alias("method"), resolve.unresolved_method()["reason"].alias("method_reason"), resolve.unresolved_path()["reason"].alias("path"))


@query("SELECT DISTINCT l_partkey AS target FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def retained_references(t: Tables):
    kept = t.orders.filter("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    return spans.retained_references(t.lineitem.select(F.col("l_orderkey").alias("owner"), F.col("l_partkey").alias("target")), kept)


@query("""
SELECT c_custkey AS id FROM customer WHERE c_mktsegment <> 'HOUSEHOLD' AND c_acctbal >= 0 AND c_custkey NOT IN (SELECT user_id FROM events) AND c_custkey NOT IN (SELECT l_suppkey FROM lineitem)
""")
def skipped_queries(t: Tables):
    every = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Module").otherwise("Item").alias("kind"))
    return audit.skipped_queries(every, t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("id")), t.events.select(F.col("user_id").alias("id")), t.lineitem.select(F.col("l_suppkey").alias("id"))).select("id")


@query("""
WITH off AS (SELECT o_custkey AS ord, 'p' || l_suppkey AS name, 'x::' || o_orderkey AS symbol FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O')
SELECT DISTINCT o.ord FROM off o WHERE EXISTS (SELECT 1 FROM supplier WHERE 'p' || s_suppkey = o.name AND s_acctbal > 5000)
  AND o.ord IN (SELECT ord FROM off JOIN orders ON 'x::' || o_orderkey = symbol WHERE o_totalprice > 300000)
""")
def api_mismatches(t: Tables):
    off = t.orders.filter("o_orderstatus = 'O'").join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = off.groupBy(F.col("o_custkey").alias("ord")).agg(
        F.collect_set(F.struct(F.concat(F.lit("p"), F.col("l_suppkey")).alias("suggested_replacement"))).alias("suggestions"),
        F.array_join(F.collect_set(F.concat(F.lit("`x::"), F.col("o_orderkey"), F.lit("`"))), " ").alias("message"),
    ).withColumns({"run": F.lit(1), "code": F.lit("E0432"), "rendered": F.lit(None).cast("string")})
    matched = t.supplier.filter("s_acctbal > 5000").select(F.lit("s").alias("symbol"), F.concat(F.lit("p"), F.col("s_suppkey")).alias("name"), F.lit(1).alias("matches"))
    missing = t.orders.filter("o_totalprice > 300000").select(F.concat(F.lit("x::"), F.col("o_orderkey")).alias("symbol"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("matches"))
    return diag.api_mismatches(rows, matched.unionByName(missing)).select("ord")


@query("""
WITH pins(pin, c_mktsegment, c_nationkey, c_name) AS (VALUES (1, 'BUILDING', NULL, NULL), (2, NULL, NULL, 'Customer#000000007'), (3, 'NOPE', 3, NULL), (4, 'MACHINERY', 5, NULL))
SELECT p.pin, count(c.c_custkey) AS matches, count(c.c_custkey) = 1 AS ok FROM pins p LEFT JOIN customer c ON (p.c_mktsegment IS NULL OR p.c_mktsegment = c.c_mktsegment)
  AND (p.c_nationkey IS NULL OR p.c_nationkey = c.c_nationkey) AND (p.c_name IS NULL OR p.c_name = c.c_name) GROUP BY p.pin
""")
def pinned_roots(t: Tables):
    pins = t.spark.createDataFrame([(1, "BUILDING", None, None), (2, None, None, "Customer#000000007"), (3, "NOPE", 3, None), (4, "MACHINERY", 5, None)], "pin int, c_mktsegment string, c_nationkey int, c_name string")
    return order.pinned(t.customer.withColumn("id", F.col("c_custkey")), pins, ["c_mktsegment", "c_nationkey", "c_name"])


@query("""
SELECT 0 AS producer, n_nationkey::BIGINT AS ord, n_name AS text FROM nation
UNION ALL (SELECT 1, s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 5)
""")
def shared_cap(t: Tables):
    return order.shared_cap([t.nation.select(F.col("n_nationkey").cast("bigint").alias("ord"), F.col("n_name").alias("text")), t.supplier.select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("text"))], 30)


@query("""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'linux' WHEN 1 THEN 'windows' ELSE 'none' END AS os, CASE p_size % 3 WHEN 0 THEN 'unix' WHEN 1 THEN 'windows' ELSE 'wasm' END AS family, CASE p_size % 3 WHEN 2 THEN '32' ELSE '64' END AS width FROM part
""")
def target_facts(t: Tables):
    triple = F.element_at(words("x86_64-unknown-linux-gnu", "aarch64-pc-windows-msvc", "wasm32-unknown-unknown"), F.col("p_size") % 3 + 1)
    m = t.part.select("p_partkey", arguments.triple_facts(triple).alias("m"))
    return m.select("p_partkey", F.col("m.target_os")[0].alias("os"), F.col("m.target_family")[0].alias("family"), F.col("m.target_pointer_width")[0].alias("width"))


@query("""
WITH c AS (SELECT l_orderkey AS file, l_returnflag = 'R' AS s, l_linestatus = 'O' AS allow_, l_returnflag = 'A' AS k FROM lineitem),
g AS (SELECT file, bool_or(s) AS any_s, bool_or(k) AS any_k FROM c GROUP BY file)
SELECT file, count(*) FILTER (any_s AND NOT s) AS skipped, count(*) FILTER (NOT (any_s AND NOT s) AND NOT k AND allow_ AND any_k) AS deferred FROM c JOIN g USING (file) GROUP BY file
""")
def repair_passes(t: Tables):
    kind = F.when(F.col("l_returnflag") == "A", "structural").when(F.col("l_linestatus") == "O", "allow").otherwise("edit")
    c = t.lineitem.select(F.col("l_orderkey").alias("file"), F.when(F.col("l_returnflag") == "R", "suggestions").otherwise("items").alias("pass"), kind.alias("kind"))
    return edits.passes_that_run(c).groupBy("file").agg(F.count_if(F.col("state") == "skipped").alias("skipped"), F.count_if(F.col("state") == "deferred").alias("deferred"))


@query("SELECT (sum(l_linenumber) + sum(l_suppkey) + sum(l_partkey) + sum(l_quantity::BIGINT) + sum(l_orderkey % 7) + sum(l_orderkey % 11))::BIGINT AS total_changes, (sum(l_linenumber) + sum(l_suppkey) + sum(l_partkey) + sum(l_quantity::BIGINT) + sum(l_orderkey % 7))::BIGINT AS total_without_lint_allows FROM lineitem")
def repair_totals(t: Tables):
    names = ["removed_items", "removed_imports", "path_edits", "suggestion_edits", "added_dead_code_allows", "added_lint_allows"]
    parts = [F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey"), F.col("l_quantity"), F.col("l_orderkey") % 7, F.col("l_orderkey") % 11]
    return edits.repair_totals(t.lineitem.select(*[p.cast("bigint").alias(n) for p, n in zip(parts, names)]))


@query("""
SELECT l_orderkey AS run, coalesce(string_agg(DISTINCT 'p' || l_suppkey || '/f' || l_linenumber, ',' ORDER BY 'p' || l_suppkey || '/f' || l_linenumber) FILTER (l_returnflag = 'R'), '') AS features,
  CASE WHEN bool_or(l_returnflag = 'R') THEN 1 ELSE 0 END AS runs FROM lineitem GROUP BY l_orderkey
""")
def uncovered_features(t: Tables):
    detail = F.struct(F.concat(F.lit("p"), F.col("l_suppkey")).alias("package"), F.array(F.concat(F.lit("f"), F.col("l_linenumber"))).alias("features"), (F.col("l_returnflag") != "R").alias("covered"))
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("run")).agg(F.collect_list(detail).alias("details")).withColumn("all_features", F.lit(False))
    return verdict.uncovered_features(rows)


@query("""
SELECT o_orderkey, nullif(concat_ws(' ', CASE WHEN o_custkey % 3 > 0 THEN '--ra-file-budget ' || (48 + o_custkey % 3) END, CASE WHEN o_custkey % 5 > 0 THEN '--ra-method-call-budget ' || (1000 + o_custkey % 5) END,
  CASE WHEN o_custkey % 2 > 0 THEN '--ra-path-budget ' || (2000 + o_custkey % 2) END), '') AS advice FROM orders
""")
def budget_advice(t: Tables):
    k = F.col("o_custkey")
    rows = t.orders.withColumns({"skipped_files": k % 3, "top_down_skipped_files": F.lit(0), "unqueried_method_calls": k % 5, "unqueried_paths": k % 2, "file_budget": F.lit(48), "method_call_budget": F.lit(1000), "path_budget": F.lit(2000)})
    return rows.select("o_orderkey", verdict.budget_advice(False).alias("advice"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'slice_preflight_failed' WHEN o_custkey % 4 > 0 THEN CASE WHEN o_custkey % 7 <> 0 THEN 'slice_feedback_failed' WHEN o_orderpriority = '1-URGENT' THEN 'slice_semantic_warning_failed' ELSE 'slice_baseline_limited_passed' END
  WHEN o_orderpriority = '1-URGENT' THEN 'slice_semantic_warning_failed' ELSE 'slice_check_passed' END AS label,
  NOT (o_orderstatus = 'P') AND o_orderpriority <> '1-URGENT' AND (o_custkey % 4 = 0 OR o_custkey % 7 = 0) AS passed
FROM orders
""")
def corpus_labels(t: Tables):
    k, no = F.col("o_custkey"), F.lit(False)
    none = F.lit(None).cast("string")
    rows = t.orders.withColumns({
        "timed_out": no, "exit_code": F.lit(0), "preflight_ok": F.col("o_orderstatus") != "P", "feedback_ok": F.lit(True), "errors": k % 4, "warnings": F.lit(0), "semantic_warnings": (F.col("o_orderpriority") == "1-URGENT").cast("int"),
        "all_known": k % 7 == 0, "preflight_only": no, "deny_warnings": no, "stop_on_warning": no, "baseline_ok": F.lit(True), "validation_status": none, "matrix_gate": none,
    })
    return rows.withColumn("label", verdict.corpus_label()).select("o_orderkey", "label", verdict.corpus_passed(F.col("label")).alias("passed"))


@query("""
SELECT o_orderkey AS run, 'cargo-stderr' AS code, CASE WHEN o_custkey % 2 = 0 THEN 'error: ' || o_custkey ELSE 'note ' || o_custkey END AS message FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT o_orderkey, 'cargo-timeout', 'the check timed out' FROM orders WHERE o_orderpriority = '1-URGENT'
""")
def fallback_rows(t: Tables):
    said = t.lineitem.select(F.col("l_orderkey").alias("run"), F.lit("error").alias("level"), F.lit("m").alias("message"), F.lit("E1").alias("code"), F.lit(None).cast("string").alias("rendered")).distinct()
    text = F.concat(F.lit("\n  note "), F.col("o_custkey"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("\nerror: "), F.col("o_custkey"))).otherwise(""))
    runs = t.orders.select(F.col("o_orderkey").alias("run"), (F.col("o_orderstatus") != "F").alias("success"), (F.col("o_orderpriority") == "1-URGENT").alias("timed_out"), text.alias("stderr"))
    return diag.with_fallback(said, runs).filter("code <> 'E1'").select("run", "code", "message")


@query("""
WITH m AS (SELECT o_custkey AS path, o_orderstatus AS module, o_orderkey FROM orders), f AS (SELECT l_orderkey FROM lineitem)
SELECT DISTINCT path, module FROM m WHERE (path, module) NOT IN (SELECT path, module FROM m WHERE o_orderkey IN (SELECT l_orderkey FROM f))
""")
def missing_modules(t: Tables):
    declared = t.orders.groupBy(F.col("o_custkey").alias("path"), F.col("o_orderstatus").alias("module")).agg(F.collect_list("o_orderkey").alias("candidates"))
    return closure.missing_modules(declared, t.lineitem.select(F.col("l_orderkey").alias("path"))).select("path", "module")
