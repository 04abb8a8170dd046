"""Feedback, repair and widening loops (OP-80 to OP-82b).

The checks themselves run elsewhere; a loop takes a function that returns an
attempt's diagnostics. State between attempts is a few signatures, so it stays
on the driver; diagnostics and root sets are tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.operators import diag
from graftwork.operators.staging import Rounds


@dataclass
class Attempt:
    """What one check gave."""

    diagnostics: DataFrame
    success: bool
    timed_out: bool = False
    repaired: bool = False


@dataclass
class Outcome:
    status: str
    attempts: int
    history: list[dict] = field(default_factory=list)
    roots: DataFrame | None = None


def _facts(attempt: Attempt, baseline: Attempt | None) -> dict:
    rows = attempt.diagnostics.withColumn("run", F.lit("now"))
    level, code, message = F.col("level"), F.col("code"), F.col("message")
    flags = [F.count_if(level == "error"), F.count_if(level == "warning"), F.count_if(diag.is_repairable(level, code, message))]
    errors, warnings, repairable, exact, shape = rows.agg(*flags, diag.line_digest(diag.exact_line()), diag.line_digest(diag.shape_line())).first()
    empty = rows.limit(0)
    before = baseline.diagnostics if baseline else empty
    return {
        "errors": errors,
        "warnings": warnings,
        "repairable": repairable,
        "new_hazards": diag.new_semantic_hazards(rows, before).first()[0],
        "all_known": bool(baseline) and diag.all_known(rows, before, not attempt.success, not baseline.success),
        "exact": exact,
        "shape": shape,
    }


def _verdict(a: Attempt, f: dict, deny: bool, repair: bool) -> str | None:
    calm = f["new_hazards"] == 0 and not (deny and f["warnings"]) and not (repair and f["repairable"])
    if a.success and calm:
        return "accepted"
    if f["all_known"] and calm:
        return "baseline_limited"
    return "timed_out" if a.timed_out else None


def feedback_loop(check: Callable[[int, DataFrame | None], Attempt], widen: Callable[[DataFrame, DataFrame | None], DataFrame] | None, limit: int, baseline: Attempt | None = None, deny_warnings: bool = False, roots: DataFrame | None = None, verify: bool = True) -> Outcome:
    """Check, and until it is accepted widen the roots by what all attempts so far have said.

    Stops at an accepted or baseline-limited check, a time-out, an exact repeat
    of an earlier attempt, a repeat in shape, or a root set that is empty or
    was seen. After the last attempt's widening one more check verifies it.
    """
    seen_exact: set[str] = set()
    seen_shape: set[str] = set()
    seen_roots: set[tuple] = set()
    said: DataFrame | None = None
    history: list[dict] = []
    for n in range(1, limit + 1 + int(verify and widen is not None)):
        attempt = check(n, roots)
        facts = _facts(attempt, baseline) | {"attempt": n}
        history.append(facts)
        if verdict := _verdict(attempt, facts, deny_warnings, False):
            return Outcome(verdict, n, history, roots)
        if facts["exact"] in seen_exact:
            return Outcome("repeated", n, history, roots)
        if facts["shape"] in seen_shape:
            return Outcome("repeated_shape", n, history, roots)
        seen_exact.add(facts["exact"])
        seen_shape.add(facts["shape"])
        if n > limit or widen is None:
            break
        said = attempt.diagnostics if said is None else said.unionByName(attempt.diagnostics, allowMissingColumns=True)
        wider = Rounds(said.sparkSession, "roots").save(widen(said, roots).select("id").distinct())
        mark = wider.agg(F.count("*"), F.bit_xor(F.xxhash64("id"))).first()
        if not mark[0] or tuple(mark) in seen_roots:
            return Outcome("no_new_roots", n, history, roots)
        seen_roots.add(tuple(mark))
        roots = wider
    return Outcome("exhausted", len(history), history, roots)


def repair_loop(check: Callable[[int], Attempt], limit: int, baseline: Attempt | None = None, deny_warnings: bool = False) -> Outcome:
    """Check and repair until accepted; success with repairable warnings isn't enough.

    Low progress ends the loop: a repaired previous attempt, errors, and the
    shape of an earlier attempt again.
    """
    seen_exact: set[str] = set()
    seen_shape: set[str] = set()
    repaired = False
    history: list[dict] = []
    for n in range(1, limit + 1):
        attempt = check(n)
        facts = _facts(attempt, baseline) | {"attempt": n}
        history.append(facts)
        if verdict := _verdict(attempt, facts, deny_warnings, True):
            return Outcome(verdict, n, history)
        if facts["exact"] in seen_exact:
            return Outcome("repeated", n, history)
        if repaired and facts["errors"] > 0 and facts["shape"] in seen_shape:
            return Outcome("low_progress", n, history)
        seen_exact.add(facts["exact"])
        seen_shape.add(facts["shape"])
        repaired = attempt.repaired
    return Outcome("exhausted", limit, history)
