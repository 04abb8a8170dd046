"""Decision tables over run reports (OP-29, OP-55, OP-84 to OP-90)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Warnings that an accepted check answers.
DISCHARGED = (
    "conditional_compilation_attrs",
    "custom_attribute_macros",
    "custom_derive_macros",
    "custom_macro_invocations",
    "dynamic_callback_boundaries",
    "semantic_analyzer_unavailable",
    "semantic_file_budget_exhausted",
    "semantic_file_failures",
    "semantic_inventory_available",
    "semantic_inventory_not_applied",
    "semantic_inventory_partially_applied",
    "semantic_method_call_budget_exhausted",
    "semantic_path_budget_exhausted",
    "semantic_reduction_hints_applied",
    "semantic_unresolved_method_calls",
    "semantic_unresolved_paths",
    "syntactic_method_fallback_cap",
    "syntactic_method_fallbacks",
)


def warning_discharged(code: Column) -> Column:
    return code.isin(*DISCHARGED)


def review_warnings(hazards: DataFrame, by: str = "run") -> DataFrame:
    """Warning hazards that nothing discharges, per run."""
    return hazards.groupBy(by).agg(F.count_if((F.col("severity") == "warning") & ~warning_discharged(F.col("code"))).alias("review_warning_hazards"))


def error_discharged(code: Column, details: Column) -> Column:
    """Only gated roots, with details, all of which the arguments cover (`covered`)."""
    return (code == "cfg_gated_roots") & (F.size(details) > 0) & F.forall(details, lambda d: F.coalesce(d["covered"], F.lit(False)))


def blocks_validation(preset: Column, status: Column, errors_open: Column) -> Column:
    return preset & (status == "hazards_detected") & (errors_open > 0)


def uncovered_features(hazards: DataFrame, by: str = "run") -> DataFrame:
    """(run, features, runs): the union of the features that no argument covers, as `package/feature`; none under all-features."""
    detail = hazards.select(by, "all_features", F.explode("details").alias("d")).filter(~F.coalesce("d.covered", F.lit(False)))
    each = detail.select(by, "all_features", F.col("d.package").alias("p"), F.explode("d.features").alias("f"))
    text = F.when(F.col("f").contains("/") | F.col("p").isNull(), F.col("f")).otherwise(F.concat("p", F.lit("/"), "f"))
    wanted = each.filter("not all_features").groupBy(by).agg(F.array_sort(F.collect_set(text)).alias("_f"))
    return hazards.select(by).distinct().join(wanted, by, "left").select(by, F.coalesce(F.array_join("_f", ","), F.lit("")).alias("features"), F.when(F.col("_f").isNull(), 0).otherwise(1).alias("runs"))


def proof_status() -> Column:
    """Of a row with the rollup's counters."""
    c = F.col
    limited = (c("skipped_files") > 0) | (c("unqueried_method_calls") > 0) | (c("unqueried_paths") > 0)
    root_limited = (c("selected_root_skipped_files") > 0) | (c("selected_root_unqueried_method_calls") > 0) | (c("selected_root_unqueried_paths") > 0)
    rooted = (
        F.when(c("selected_root_failed_files") > 0, "selected_root_failed")
        .when(root_limited, "selected_root_limited")
        .when(limited, "selected_root_complete_workspace_limited")
        .otherwise("complete")
    )
    whole = F.when(c("failed_files") > 0, "workspace_failed").when(limited, "workspace_limited").when(c("source_files") == 0, "empty").otherwise("complete")
    return F.when(c("selected_root_source_files") > 0, rooted).otherwise(whole)


BLOCKING = ("empty", "not_available", *(f"{scope}_{state}" for scope in ("workspace", "selected_root") for state in ("limited", "failed")))


def proof_blocks(status: Column) -> Column:
    return status.isin(*BLOCKING)


def proof_errors() -> Column:
    sums = lambda p: F.col(f"{p}failed_files") + F.col(f"{p}skipped_files") + F.col(f"{p}unqueried_method_calls") + F.col(f"{p}unqueried_paths")
    return F.when(F.col("selected_root_source_files") > 0, sums("selected_root_")).otherwise(sums(""))


def proof_warnings() -> Column:
    rooted = F.col("skipped_files") + F.col("unqueried_method_calls") + F.col("unqueried_paths")
    return F.when(F.col("selected_root_source_files") > 0, rooted).otherwise(F.col("unresolved_method_calls") + F.col("unresolved_paths"))


def budget_advice(only_roots: bool) -> Column:
    """Flags that would cover what the budgets left out; null when nothing was."""
    p = "selected_root_" if only_roots else ""
    files = F.col(f"{p}skipped_files") if only_roots else F.greatest(F.col("skipped_files") - F.col("top_down_skipped_files"), F.lit(0))
    parts = (("file", files), ("method-call", F.col(f"{p}unqueried_method_calls")), ("path", F.col(f"{p}unqueried_paths")))
    flag = lambda name, unmet: F.when(unmet > 0, F.concat(F.lit(f"--ra-{name}-budget "), (F.col(f"{name.replace('-', '_')}_budget") + unmet).cast("string")))
    return F.nullif(F.concat_ws(" ", *[flag(n, u) for n, u in parts]), F.lit(""))


def final_verdict(feedback: Column, readiness: Column, matrix: Column, review: Column) -> Column:
    """accepted, review_required, baseline_limited or failed; the first rule that fits decides."""
    calm = matrix.isin("accepted", "not_required")
    return (
        F.when(readiness == "hazards_detected", "failed")
        .when(matrix == "failed", "failed")
        .when((matrix == "baseline_limited") | (feedback == "baseline_limited"), "baseline_limited")
        .when((feedback == "accepted") & calm & ((readiness == "ready_for_feedback") | (review == 0)), "accepted")
        .when((feedback == "accepted") & calm, "review_required")
        .otherwise("failed")
    )


def row_status(status: Column) -> Column:
    return F.when(status.isin("accepted", "generated"), "accepted").otherwise("rejected")


def attempts(feedback: Column, repair: Column, check: Column) -> Column:
    """The largest of the loops' counts and the check's, at least one; one more where a loop checks at all."""
    loops = (feedback > 0) | (repair > 0)
    return F.greatest(feedback, repair, check.cast("int"), F.lit(1)) + F.when((check | loops) & loops, 1).otherwise(0)


def accepted(success: Column, new_hazards: Column, warnings: Column, deny: Column, repairable: Column | None = None) -> Column:
    ok = success & (new_hazards == 0) & (~deny | (warnings == 0))
    return ok if repairable is None else ok & (repairable == 0)


def baseline_limited(all_known: Column, new_hazards: Column, warnings: Column, deny: Column, repairable: Column | None = None) -> Column:
    return accepted(all_known, new_hazards, warnings, deny, repairable)


def deferred_repair_runs(deny: Column, deferred: Column, errors: Column, warnings: Column, new_hazards: Column) -> Column:
    return deny & deferred & (errors == 0) & (warnings > 0) & (new_hazards == 0)


def corpus_label() -> Column:
    """Of a row (timed_out, exit_code, preflight_ok, feedback_ok, errors, warnings, semantic_warnings, all_known,
    preflight_only, deny_warnings, stop_on_warning, baseline_ok, validation_status, matrix_gate); ok columns are null where a report is missing.
    """
    c = F.col
    broken = c("timed_out") | c("exit_code").isNull()
    red = (c("exit_code") != 0) | ~F.coalesce("feedback_ok", F.lit(False)) | (c("errors") > 0)
    known = F.when(c("semantic_warnings") > 0, "slice_semantic_warning_failed").when((c("warnings") > 0) & (c("deny_warnings") | c("stop_on_warning")), "slice_feedback_failed").otherwise("slice_baseline_limited_passed")
    label = (
        F.when(~F.coalesce("baseline_ok", F.lit(True)), "baseline_failed")
        .when(broken, "slice_generation_failed")
        .when(~c("preflight_ok"), "slice_preflight_failed")
        .when(c("preflight_only"), F.when((c("exit_code") == 0) & c("preflight_ok"), "slice_preflight_passed").otherwise("slice_generation_failed"))
        .when(c("feedback_ok").isNull(), "slice_generation_failed")
        .when(red, F.when(c("all_known"), known).otherwise("slice_feedback_failed"))
        .when(c("semantic_warnings") > 0, "slice_semantic_warning_failed")
        .when(c("stop_on_warning") & (c("warnings") > 0), "slice_feedback_failed")
        .otherwise("slice_check_passed")
    )
    return F.when((c("validation_status") == "rejected") & (c("matrix_gate") == "failed"), "slice_production_matrix_failed").otherwise(label)


PASSING = ("slice_check_passed", "slice_preflight_passed", "slice_baseline_limited_passed")


def corpus_passed(label: Column) -> Column:
    c = F.col
    strict = (c("semantic_warnings") > 0) | ((c("stop_on_warning") | c("deny_warnings")) & (c("warnings") > 0))
    return F.when(strict, False).when(F.coalesce("validation_status", F.lit("")) != "", c("validation_status") == "accepted").otherwise(label.isin(*PASSING))
