"""Diagnostics: reading, rules, keys and comparisons (OP-05, OP-06, OP-24 to OP-27, OP-43 to OP-44c, OP-50, OP-58, OP-59, OP-63c, OP-65, OP-91).

A diagnostic is a row (run, ord, level, message, code, package_id,
target<name, kind[], src_path>, rendered, spans[], suggestions[]).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.functions.hashing import fingerprint, short_digest
from graftwork.functions.ident import all_ticked, diagnostic_symbol, sorted_distinct

SPAN = """struct<file_name:string,line_start:bigint,line_end:bigint,column_start:bigint,column_end:bigint,is_primary:boolean,
text:array<struct<text:string>>,byte_start:bigint,byte_end:bigint,suggested_replacement:string,suggestion_applicability:string>"""
#: A message's notes stay text: they may nest to any depth.
MESSAGE = f"struct<level:string,message:string,code:struct<code:string>,rendered:string,spans:array<{SPAN}>,children:string>"
SUGGESTION = "struct<level:string,message:string,file_name:string,byte_start:bigint,byte_end:bigint,suggested_replacement:string,applicability:string>"


def record_schema() -> str:
    return f"reason string, package_id string, target struct<name:string,kind:array<string>,src_path:string>, message {MESSAGE}"


PLACE = ("line_start", "line_end", "column_start", "column_end")


def _complete(spans: Column) -> Column:
    """Spans without a required field go, their diagnostic stays."""
    needed = ("file_name", "line_start", "line_end", "column_start", "column_end", "is_primary")
    every = lambda s: F.forall(F.array(*[s[n].isNotNull() for n in needed]), lambda x: x)
    return F.coalesce(F.filter(spans, every), F.from_json(F.lit("[]"), f"array<{SPAN}>"))


def diagnostics(records: DataFrame, run: Column | None = None, ordinal: Column | None = None) -> DataFrame:
    """Compiler messages among parsed records; those without level or message are dropped."""
    m = F.col("_m")
    kept = records.withColumnRenamed("message", "_m").filter((F.col("reason") == "compiler-message") & m.level.isNotNull() & m.message.isNotNull())
    return kept.select(
        (run if run is not None else F.lit("run")).alias("run"),
        (ordinal if ordinal is not None else F.monotonically_increasing_id()).alias("ord"),
        m.level.alias("level"),
        m.message.alias("message"),
        m.code.code.alias("code"),
        "package_id",
        "target",
        m.rendered.alias("rendered"),
        _complete(m.spans).alias("spans"),
        suggestions(m).alias("suggestions"),
    )


def _whole(value) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def nested_suggestions(children: str | None) -> list[tuple]:
    """Replacements of notes and their notes, depth first; a note's level and message go with its own."""
    out: list[tuple] = []
    try:
        notes = json.loads(children) if children else []
    except ValueError:
        return out
    work = list(reversed(notes)) if isinstance(notes, list) else []
    while work:
        note = work.pop()
        if not isinstance(note, dict):
            continue
        text = lambda key: note[key] if isinstance(note.get(key), str) else ""
        spans = note.get("spans")
        for s in spans if isinstance(spans, list) else []:
            if not isinstance(s, dict) or not all(_whole(s.get(k)) for k in PLACE) or not all(isinstance(s.get(k), str) for k in ("file_name", "suggested_replacement")):
                continue
            at = [s[k] if _whole(s.get(k)) else None for k in ("byte_start", "byte_end")]
            how = s.get("suggestion_applicability")
            out.append((text("level"), text("message"), s["file_name"], *at, s["suggested_replacement"], how if isinstance(how, str) else None))
        below = note.get("children")
        work += reversed(below) if isinstance(below, list) else []
    return out


def suggestions(message: Column) -> Column:
    """Replacements of a message and of its notes, own spans first, then depth first.

    The notes are parsed in Arrow batches, as no schema bounds their depth.
    """
    placed = lambda s: F.forall(F.array(*[s[n].isNotNull() for n in ("file_name", "suggested_replacement", *PLACE)]), lambda x: x)
    own = F.transform(
        F.filter(message["spans"], placed),
        lambda s: F.struct(
            message["level"].alias("level"), message["message"].alias("message"), s["file_name"].alias("file_name"), s["byte_start"].alias("byte_start"), s["byte_end"].alias("byte_end"),
            s["suggested_replacement"].alias("suggested_replacement"), s["suggestion_applicability"].alias("applicability"),
        ),
    )
    below = F.udf(nested_suggestions, f"array<{SUGGESTION}>", useArrow=True)(message["children"])
    return F.concat(F.coalesce(own, F.from_json(F.lit("[]"), f"array<{SUGGESTION}>")), below)


WIDENING = [
    ("E0405", "missing-trait", "high"),
    ("E0412", "missing-type", "high"),
    ("E0422", "missing-type", "high"),
    ("E0425", "missing-value", "high"),
    ("E0432", "unresolved-path", "high"),
    ("E0433", "unresolved-path", "high"),
    ("E0463", "missing-crate", "high"),
    ("E0583", "missing-module-file", "high"),
    ("E0599", "missing-method-or-associated-item", "medium"),
    ("E0560", "struct-field-surface-mismatch", "medium"),
    ("E0609", "struct-field-surface-mismatch", "medium"),
    ("E0277", "missing-conversion-trait-impl", "medium"),
]
CONVERSION = r": (From|Into|TryFrom|TryInto)<"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = WIDENING) -> DataFrame:
    return spark.createDataFrame(rules, "code string, kind string, confidence string")


def classify(rows: DataFrame, rules: DataFrame, guard: Column | None = None, code: str = "code") -> DataFrame:
    """Inner join with a small rule table; `guard` is what a rule needs beyond its code."""
    joined = rows.join(F.broadcast(rules.withColumnRenamed("code", "_code")), F.col(code) == F.col("_code")).drop("_code")
    return joined.filter(guard) if guard is not None else joined


ACTIONS = {
    "missing-trait": "keep the trait, its import or the feature that defines it",
    "missing-type": "keep the type, its re-export or the feature that defines it",
    "missing-value": "keep the function, constant, static or import",
    "unresolved-path": "keep the module path or restore the package",
    "missing-crate": "restore the dependency in the manifest",
    "missing-module-file": "restore the module's file or drop its declaration",
    "missing-method-or-associated-item": "keep the receiver's impls, its traits' imports and bounds",
    "struct-field-surface-mismatch": "keep all fields of the owning struct",
    "missing-conversion-trait-impl": "keep the conversion's impl",
}


def widening_candidates(rows: DataFrame) -> DataFrame:
    """Errors that may be mended by keeping more symbols.

    Adds kind, confidence, symbol, file_name and line_start of the first
    primary span, how many suggestions there are and how many of them are
    machine-applicable, and the action, in words of our own.
    """
    guard = (F.col("code") != "E0277") | F.col("message").rlike(CONVERSION)
    found = classify(rows.filter("level = 'error'"), rule_table(rows.sparkSession), guard)
    primary = F.try_element_at(F.filter("spans", lambda s: s["is_primary"]), F.lit(1))
    action = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    how_many = lambda keep: F.coalesce(F.size(F.filter("suggestions", keep)), F.lit(0)).cast("bigint")
    fields = rows.schema["suggestions"].dataType.elementType.fieldNames()
    sure = (lambda s: F.coalesce(s["applicability"] == "MachineApplicable", F.lit(False))) if "applicability" in fields else (lambda s: F.lit(False))
    return found.withColumns({
        "symbol": diagnostic_symbol(F.col("code"), F.col("message"), F.col("rendered")), "file_name": primary["file_name"], "line_start": primary["line_start"],
        "n_suggestions": how_many(lambda s: F.lit(True)), "n_machine_applicable": how_many(sure), "action": action[F.col("kind")],
    })


def is_semantic_hazard(level: Column, code: Column, message: Column) -> Column:
    named = code.isin("unreachable_patterns", "irrefutable_let_patterns", "bindings_with_variant_name")
    snake = (code == "non_snake_case") & message.contains("variable `")
    text = message.contains("unreachable pattern") | message.contains("irrefutable")
    return (level == "warning") & (F.coalesce(named, F.lit(False)) | F.coalesce(snake, F.lit(False)) | text)


#: Kind and severity by code, after semantic warnings.
HAZARD_KINDS = {
    ("cargo-timeout",): ("feedback-timeout", "blocker"),
    ("cargo-stderr",): ("cargo-shape-failure", "blocker"),
    ("E0463",): ("missing-crate", "blocker"),
    ("E0583",): ("missing-module-file", "blocker"),
    ("E0560", "E0609"): ("needs-field-surface", "high"),
    ("E0277", "E0405", "E0412", "E0422", "E0425", "E0432", "E0433", "E0599"): ("needs-widening", "high"),
}


def hazard(level: Column, code: Column, message: Column) -> Column:
    """STRUCT<kind, severity>, null for none; the first rule that fits decides, a code's at any level."""
    out = lambda kind, severity: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))
    rule = F.when(is_semantic_hazard(level, code, message), out("semantic-warning", "high"))
    for codes, (kind, severity) in HAZARD_KINDS.items():
        rule = rule.when(code.isin(*codes), out(kind, severity))
    return rule.when((level == "error") & code.isNotNull(), out("unclassified-compiler-error", "medium"))


SEVERITIES = {"blocker": 0, "high": 1, "medium": 2, "low": 3}


def hazards(rows: DataFrame) -> DataFrame:
    """Distinct (kind, severity, code, message), most severe first."""
    found = rows.withColumn("_h", hazard(F.col("level"), F.col("code"), F.col("message"))).filter("_h is not null")
    distinct = found.select("_h.kind", "_h.severity", "code", "message").dropDuplicates(["kind", "code", "message"])
    rank = F.lit(4)
    for name, r in SEVERITIES.items():
        rank = F.when(F.col("severity") == name, r).otherwise(rank)
    return distinct.orderBy(rank, "kind", "code", "message")


NOUNS = ("associated constant", "associated function", "associated items", "constant", "enum", "field", "fields", "function", "method", "module", "static", "struct", "trait", "type alias", "union", "variant", "variants")


def is_repairable(level: Column, code: Column, message: Column) -> Column:
    dead = (code == "dead_code") & message.rlike(f"({'|'.join(NOUNS)}) `")
    return (level == "warning") & F.coalesce(code.isin("unused_imports", "unused_macros") | dead, F.lit(False))


def primary_files(spans: Column) -> Column:
    """Sorted distinct files of primary spans."""
    return sorted_distinct(F.transform(F.filter(spans, lambda s: s["is_primary"]), lambda s: s["file_name"]))


def _target(kinds: str) -> Column:
    t = F.col("target")
    return F.when(t.isNull(), "").otherwise(F.concat(F.array_join(t["kind"], kinds), F.lit(":"), t["name"]))


def _bars(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])


def baseline_key(digest=fingerprint) -> Column:
    """What makes two runs' diagnostics the same; the rendered text counts only without a primary file."""
    files = F.array_join(primary_files(F.col("spans")), ",")
    printed = F.when(files == "", F.coalesce(digest(F.col("rendered")), F.lit(""))).otherwise("")
    return _bars(F.col("level"), F.col("code"), F.col("package_id"), _target(","), files, printed, F.col("message"))


def runner_key() -> Column:
    """The same key with the runner's digest; the two kinds don't mix."""
    return baseline_key(short_digest)


def against_baseline(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row (known_errors, new_errors): rows, not distinct keys."""
    keys = baseline.filter("level = 'error'").select(baseline_key().alias("_key")).distinct().withColumn("_known", F.lit(True))
    errors = current.filter("level = 'error'").withColumn("_key", baseline_key())
    joined = errors.join(keys, "_key", "left")
    return joined.agg(F.count_if(F.col("_known")).alias("known_errors"), F.count_if(F.col("_known").isNull()).alias("new_errors"))


def all_known(current: DataFrame, baseline: DataFrame, current_failed: bool, baseline_failed: bool) -> bool:
    """Both runs failed with errors, and every current error key is a baseline one."""
    if not (current_failed and baseline_failed):
        return False
    keys = baseline.filter("level = 'error'").select(baseline_key().alias("_key"))
    own = current.filter("level = 'error'").select(baseline_key().alias("_key"))
    if keys.isEmpty() or own.isEmpty():
        return False
    return own.join(keys.distinct(), "_key", "left_anti").isEmpty()


def new_semantic_hazards(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row (row_count, key_count) of semantic hazards that the baseline lacks: one reader counts rows, the other distinct keys."""
    mark = is_semantic_hazard(F.col("level"), F.col("code"), F.col("message"))
    own = current.filter(mark).select(baseline_key().alias("_key"))
    new = own.join(baseline.filter(mark).select(baseline_key().alias("_key")).distinct(), "_key", "left_anti")
    return new.agg(F.count("*").alias("row_count"), F.count_distinct("_key").alias("key_count"))


def exact_line() -> Column:
    """A diagnostic with its positions."""
    spans = F.transform(F.filter("spans", lambda s: s["is_primary"]), lambda s: F.concat_ws(":", s["file_name"], s["line_start"].cast("string"), s["column_start"].cast("string"), s["column_end"].cast("string")))
    return _bars(F.col("level"), F.col("code"), F.col("message"), F.array_join(spans, ","))


def shape_line() -> Column:
    """A diagnostic without positions: package, target and sorted distinct files instead."""
    return _bars(F.col("level"), F.col("code"), F.col("package_id"), _target("+"), F.col("message"), F.array_join(primary_files(F.col("spans")), ","))


def exact_signature(rows: DataFrame, by: str = "run") -> DataFrame:
    """(run, signature): all rows with positions, sorted, repeats kept."""
    return signature(rows.withColumn("_line", exact_line()), by, "_line")


def shape_signature(rows: DataFrame, by: str = "run") -> DataFrame:
    """(run, signature) of the rows' shapes."""
    return signature(rows.withColumn("_line", shape_line()), by, "_line")


def line_digest(line: Column) -> Column:
    """What a signature says, as an aggregate of bounded size: the number of lines and two sums of their hashes."""
    total = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), line).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return F.concat_ws(":", F.count(line).cast("string"), total(3), total(4))


def signature(rows: DataFrame, by: str, line: str) -> DataFrame:
    """Order-insensitive text over a group's lines."""
    return rows.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("signature"))


def replacements(suggested: Column, rendered: Column) -> Column:
    """Trimmed non-empty replacements, else the rendered text's plain tokens; sorted, distinct."""
    offered = F.filter(F.transform(suggested, lambda s: F.trim(s["suggested_replacement"])), lambda x: x != "")
    plain = F.filter(all_ticked(rendered), lambda x: ~x.contains("::"))
    return sorted_distinct(F.when(F.size(offered) > 0, offered).otherwise(plain))


def api_mismatches(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(run, ord) of unresolved paths with no match of their own, for which a suggested name has one; at most once a diagnostic.

    entries: (symbol, name, matches).
    """
    open_ = rows.filter(F.col("code").isin("E0432", "E0433"))
    offered = open_.select("run", "ord", F.explode(replacements(F.col("suggestions"), F.col("rendered"))).alias("name"))
    matched = offered.join(entries.filter("matches > 0").select("name").distinct(), "name", "left_semi").select("run", "ord").distinct()
    paths = open_.select("run", "ord", F.explode(F.concat(all_ticked(F.col("message")), all_ticked(F.col("rendered")))).alias("symbol")).filter(F.col("symbol").contains("::"))
    missing = paths.join(entries.filter("matches = 0").select("symbol").distinct(), "symbol", "left_semi").select("run", "ord").distinct()
    return matched.join(missing, ["run", "ord"])


def glob_bucket(entries: DataFrame) -> DataFrame:
    """Adds `bucket`: private_upstream before missing_export, each only for entries without a match and with provider modules."""
    open_ = (F.col("matches") == 0) & (F.size("module_roots") > 0)
    return entries.withColumn("bucket", F.when(open_ & (F.size("internal_globs") > 0), "private_upstream").when(open_, "missing_export"))


def resolve_roots(wanted: DataFrame, symbols: DataFrame, marked: DataFrame, most: int) -> DataFrame:
    """Each wanted (symbol, package_hint) with its project symbols and outcome.

    Symbols match on the last path segment, and on the package where a hint is
    given. The outcome is marked_root, no_match, too_many_matches or matched.
    """
    name = lambda c: F.substring_index(c, "::", -1)
    left = wanted.select("symbol", "package_hint").distinct().withColumn("name", name(F.col("symbol")))
    right = symbols.select("id", "package", name(F.col("id")).alias("name")).distinct()
    skip = marked.select(F.col("id"), F.lit(True).alias("_marked")).distinct()
    joined = left.join(right, (left["name"] == right["name"]) & (left["package_hint"].isNull() | (left["package_hint"] == right["package"])), "left").drop(right["name"]).join(skip, "id", "left")
    grouped = joined.groupBy("symbol", "package_hint").agg(F.count("id").alias("matches"), F.count_if(F.col("_marked")).alias("_m"), F.array_sort(F.collect_set(F.when(F.col("_marked").isNull(), F.col("id")))).alias("roots"))
    outcome = F.when(F.col("matches") == 0, "no_match").when(F.col("matches") > most, "too_many_matches").when(F.col("matches") == F.col("_m"), "marked_root").otherwise("matched")
    return grouped.select("symbol", "package_hint", "matches", outcome.alias("outcome"), F.when(outcome == "matched", F.col("roots")).otherwise(F.array().cast("array<string>")).alias("roots"))


def with_fallback(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds rows for runs (run, success, timed_out, stderr) that failed without a diagnostic, and for those that timed out.

    The message is the first line that starts with `error:`, else the first
    line that isn't blank.
    """
    lines = F.filter(F.transform(F.split("stderr", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    said = F.coalesce(F.try_element_at(F.filter(lines, lambda x: x.startswith("error:")), F.lit(1)), F.try_element_at(lines, F.lit(1)), F.lit("check failed"))
    silent = runs.filter("not success").join(rows.select("run").distinct(), "run", "left_anti")
    extra = silent.select("run", F.lit("error").alias("level"), said.alias("message"), F.lit("cargo-stderr").alias("code"), F.col("stderr").alias("rendered"))
    late = runs.filter("timed_out").select("run", F.lit("error").alias("level"), F.lit("the check timed out").alias("message"), F.lit("cargo-timeout").alias("code"), F.lit(None).cast("string").alias("rendered"))
    return rows.unionByName(extra, allowMissingColumns=True).unionByName(late, allowMissingColumns=True)


def counts_by_level(rows: DataFrame, by: str = "run") -> DataFrame:
    return rows.groupBy(by).agg(F.count_if(F.col("level") == "error").alias("error_count"), F.count_if(F.col("level") == "warning").alias("warning_count"))


def feedback_status(errors: Column, warnings: Column, partial: Column) -> Column:
    return F.when(errors > 0, "errors").when(warnings > 0, "warnings").when(partial, "partial").otherwise("clean")


def metrics(rows: DataFrame, by: str = "run") -> DataFrame:
    """Counters of each run's diagnostics, and its status."""
    level, code, message = F.col("level"), F.col("code"), F.col("message")
    found = rows.groupBy(by).agg(
        F.count("*").alias("diagnostics"),
        F.count_if(level == "error").alias("errors"),
        F.count_if(level == "warning").alias("warnings"),
        F.count_if((level == "error") & code.isin([c for c, _, _ in WIDENING]) & ((code != "E0277") | message.rlike(CONVERSION))).alias("widening_candidates"),
        F.count_if(hazard(level, code, message).isNotNull()).alias("widening_hazards"),
        F.count_if(is_semantic_hazard(level, code, message)).alias("semantic_warnings"),
        F.count_if(is_repairable(level, code, message)).alias("repairable_warnings"),
        F.sum(F.size("suggestions")).alias("suggestions"),
        F.count_distinct("code").alias("distinct_codes"),
    )
    return found.withColumn("status", feedback_status(F.col("errors"), F.col("warnings"), F.lit(False)))


def feedback_summary(reports: DataFrame, rows: DataFrame, entries: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """One row with the counters of all reports (run, readable, resolved) and the status.

    Candidates and hazards count once a run, as their reports list them.
    entries: (run, symbol, name, matches, roots, module_roots, internal_globs,
    globs, outcome) of the root resolution; `resolved` is null for a report
    whose roots were not looked for, and false where that failed. An
    unreadable report makes a run without findings partial. The baseline's
    counters are null without one.
    """
    spark = rows.sparkSession
    c = F.col
    read = reports.agg(F.count_if("readable").alias("reports"), F.count_if(~c("readable")).alias("unreadable_reports"), F.count_if("resolved").alias("resolution_reports"), F.count_if(~c("resolved")).alias("resolution_errors"))
    said = rows.agg(F.count("*").alias("diagnostics"), F.count_if(c("level") == "error").alias("errors"), F.count_if(c("level") == "warning").alias("warnings"))
    wide = widening_candidates(rows).select("run", "kind", "code", "symbol", "file_name", "line_start", "message").distinct().agg(F.count("*").alias("widening_candidates"))
    marked = rows.select("run", hazard(c("level"), c("code"), c("message")).alias("h"), "code", "message").filter("h is not null")
    risky = marked.select("run", "h.kind", "code", "message").distinct().agg(F.count("*").alias("widening_hazards"))
    bucket = glob_bucket(entries)
    some = lambda name: F.coalesce(F.size(name) > 0, F.lit(False))
    found = bucket.agg(
        F.coalesce(F.sum(F.when(c("outcome") == "matched", F.size("roots")).otherwise(0)), F.lit(0)).alias("resolution_matched_roots"),
        F.count_if(c("outcome") == "no_match").alias("resolution_skipped_no_match"),
        F.count_if(c("outcome") == "too_many_matches").alias("resolution_skipped_too_many_matches"),
        F.count_if(some("globs") | some("module_roots") | some("internal_globs")).alias("glob_import_context_entries"),
        F.count_if(c("bucket") == "missing_export").alias("glob_import_missing_export_candidates"),
        F.count_if(c("bucket") == "private_upstream").alias("glob_import_private_upstream_candidates"),
    )
    drift = api_mismatches(rows, entries).agg(F.count("*").alias("source_api_mismatch_candidates"))
    if baseline is None:
        known = spark.range(1).select(*[F.lit(None).cast("bigint").alias(f"feedback_baseline_{n}") for n in ("known_errors", "new_errors")], F.lit(None).cast("boolean").alias("feedback_baseline_compared"))
    else:
        known = against_baseline(rows, baseline).select(c("known_errors").alias("feedback_baseline_known_errors"), c("new_errors").alias("feedback_baseline_new_errors"), F.lit(True).alias("feedback_baseline_compared"))
    out = read
    for one in (said, wide, risky, found, drift, known):  # a row each
        out = out.join(F.broadcast(one))
    return out.withColumn("status", feedback_status(c("errors"), c("warnings"), c("unreadable_reports") > 0))


def suggestion_count(rows: DataFrame, applicability: str | None = None) -> DataFrame:
    """One row (n): suggestions of all diagnostics, of one applicability if it is named."""
    keep = (lambda s: F.lit(True)) if applicability is None else (lambda s: F.coalesce(s["applicability"] == applicability, F.lit(False)))
    return rows.agg(F.coalesce(F.sum(F.coalesce(F.size(F.filter("suggestions", keep)), F.lit(0))), F.lit(0)).alias("n"))


def code_list(rows: DataFrame, ordinal: str = "ord") -> DataFrame:
    """(code, ord): distinct codes by where they are first seen; empty and missing ones aside."""
    return rows.filter((F.col("code").isNotNull()) & (F.col("code") != "")).groupBy("code").agg(F.min(ordinal).alias(ordinal))


def sum_ints(rows: DataFrame, column: str) -> DataFrame:
    """One row (total) of a text column's whole numbers; other values count nothing."""
    return rows.agg(F.coalesce(F.sum(F.col(column).try_cast("bigint")), F.lit(0)).alias("total"))


def counts_by_kind(rows: DataFrame, kinds: tuple[str, ...] = ("fn", "enum", "trait", "struct", "mod")) -> DataFrame:
    """(kind, n) of every kind, zero where there is none."""
    every = rows.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return every.join(rows.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").fillna(0, subset=["n"])
