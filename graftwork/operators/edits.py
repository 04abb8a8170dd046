"""Text edits (OP-47, OP-67, OP-83, OP-83b)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_REPLACEMENT = 256 * 1024


def usable_suggestions(rows: DataFrame) -> DataFrame:
    """Machine-applicable replacements of at most 256 KiB without NUL."""
    text = F.col("suggested_replacement")
    return rows.filter((F.col("applicability") == "MachineApplicable") & (F.octet_length(text) <= MAX_REPLACEMENT) & (F.instr(text, "\0") == 0))


def _greedy(edits: Column) -> Column:
    """Accepted ones of sorted distinct edits: none may start before the last accepted one's end, nor repeat its range."""
    empty = F.slice(edits, 1, 0)

    def step(acc: Column, e: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        clash = (e["start"] < last["stop"]) | ((e["start"] == last["start"]) & (e["stop"] == last["stop"]))
        return F.when(F.coalesce(clash, F.lit(False)), acc).otherwise(F.concat(acc, F.array(e)))

    return F.aggregate(edits, empty, step)


def greedy_intervals(rows: DataFrame, group: str, start: str, stop: str, payload: str) -> DataFrame:
    """(group, start, stop, payload) of the accepted intervals of each group.

    A group's list is one row; groups have to be of bounded size, as a file's
    edits are.
    """
    packed = F.struct(F.col(start).alias("start"), F.col(stop).alias("stop"), F.col(payload).alias("payload"))
    lists = rows.groupBy(group).agg(F.array_sort(F.collect_set(packed)).alias("_e"))
    kept = lists.select(group, F.explode(_greedy(F.col("_e"))).alias("_x"))
    return kept.select(group, F.col("_x.start").alias(start), F.col("_x.stop").alias(stop), F.col("_x.payload").alias(payload))


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(file, text, applied): accepted edits (file, start, stop, replacement) put into each text, from right to left.

    Edits outside the text and edits that change nothing are removed first.
    """
    inside = edits.join(files, "file").filter((F.col("start") >= 0) & (F.col("start") <= F.col("stop")) & (F.col("stop") <= F.length("text")))
    real = inside.filter(F.substr("text", F.col("start") + 1, F.col("stop") - F.col("start")) != F.col("replacement"))
    kept = greedy_intervals(real, "file", "start", "stop", "replacement")
    lists = kept.groupBy("file").agg(F.reverse(F.array_sort(F.collect_list(F.struct("start", "stop", "replacement")))).alias("_e"))

    def put(text: Column, e: Column) -> Column:
        return F.concat(F.substr(text, F.lit(1), e["start"].cast("int")), e["replacement"], F.substr(text, (e["stop"] + 1).cast("int")))

    out = files.join(lists, "file", "left")
    return out.select("file", F.when(F.col("_e").isNull(), F.col("text")).otherwise(F.aggregate("_e", F.col("text"), put)).alias("text"), F.coalesce(F.size("_e"), F.lit(0)).alias("applied"))


def collapse_separators(text: Column) -> Column:
    """`::::` and longer runs become `::`."""
    return F.regexp_replace(text, "::(?:::)+", "::")


def strip_absolute_roots(text: Column, packages: list[str]) -> Column:
    """A leading `::` before anything but a known package goes."""
    known = "|".join(packages) or r"(?!)"
    return F.regexp_replace(text, rf"(?<![\w>:])::(?!(?:{known})\b)(?=[A-Za-z_])", "")


def remove_use_name(text: Column, name: str) -> Column:
    """Take a name out of `use` declarations: the whole line, or its place in a group, multi-line ones too."""
    whole = rf"(?m)^[ \t]*(?:pub(?:\([\w: ]+\))?[ \t]+)?use[ \t]+(?:[\w]+::)*{name}[ \t]*;[ \t]*\n?"
    grouped = rf"(?<=[{{,])\s*{name}\s*(?:,|(?=}}))"
    return F.regexp_replace(F.regexp_replace(text, whole, ""), grouped, "")


def _without_spans(text: str, spans: list) -> str:
    """Names at these (start, stop) taken out of `use` trees: with their comma, and with the whole declaration once it is empty."""
    for start, stop in sorted({(s[0], s[1]) for s in spans}, reverse=True):
        if not 0 <= start < stop <= len(text):
            continue
        after = re.compile(r"\s*,[ \t]*").match(text, stop)
        before = re.search(r",\s*$", text[:start])
        if after:
            text = text[:start] + text[after.end() :]
        elif before:
            text = text[: before.start()] + text[stop:]
        else:
            text = text[:start] + text[stop:]
    text = re.sub(r"(?:\w+::)*\{\s*\}\s*,?\s*(?=[^;{}]*\}\s*;)", "", text)
    return re.sub(r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?use[ \t]+(?:\w+::)*(?:\{\s*\})?[ \t]*;[ \t]*\n?", "", text)


def remove_import_spans(files: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, text) without the imported names at spans (file, start, stop), in Arrow batches; spans outside a text are ignored."""
    lists = spans.groupBy("file").agg(F.collect_set(F.struct("start", "stop")).alias("_s"))
    cut = F.udf(_without_spans, "string", useArrow=True)
    out = files.join(lists, "file", "left")
    return out.select("file", F.when(F.col("_s").isNull(), F.col("text")).otherwise(cut("text", F.coalesce("_s", F.from_json(F.lit("[]"), "array<struct<start:bigint,stop:bigint>>")))).alias("text"))


def path_root_edits(files: DataFrame, spans: DataFrame) -> DataFrame:
    """Edits (file, start, stop, replacement) that take the leading `::` off the paths at spans (file, start, stop)."""
    at = spans.join(files, "file").filter((F.col("start") >= 0) & (F.col("stop") <= F.length("text")) & (F.substr("text", F.col("start").cast("int") + 1, F.lit(2)) == "::"))
    return at.select("file", "start", (F.col("start") + 2).alias("stop"), F.lit("").alias("replacement"))


def item_removals(items: DataFrame, files: DataFrame) -> DataFrame:
    """Edits that remove whole items (file, start_line, end_line), their line ends included."""
    from graftwork.operators.spans import line_starts

    starts = files.select("file", F.concat(line_starts(F.col("text")), F.array(F.length("text"))).alias("_l"))
    at = lambda line: F.coalesce(F.try_element_at("_l", line.cast("int")), F.element_at("_l", -1))
    return items.join(starts, "file").select("file", at(F.col("start_line")).cast("bigint").alias("start"), at(F.col("end_line") + 1).cast("bigint").alias("stop"), F.lit("").alias("replacement"))


def insert_above(text: Column, line: Column, attribute: str) -> Column:
    """Put an attribute, as deeply indented, above the nearest item that starts on or before the line."""
    lines = F.split(text, "\n")
    starts = F.transform(F.sequence(F.lit(1), F.size(lines)), lambda i: F.when((i <= line) & F.element_at(lines, i).rlike(r"^\s*(pub(\([\w: ]+\))?\s+)?(struct|enum|union|trait|type|fn|mod|const|static)\s"), i))
    at = F.array_max(starts)
    indent = F.regexp_extract(F.element_at(lines, at), r"^(\s*)", 1)
    put = F.array_join(F.concat(F.slice(lines, F.lit(1), at - 1), F.array(F.concat(indent, F.lit(attribute))), F.slice(lines, at, F.size(lines))), "\n")
    return F.when(at.isNull(), text).otherwise(put)


PASSES = ("suggestions", "path_syntax", "imports", "items")


def passes_that_run(candidates: DataFrame) -> DataFrame:
    """Candidates (file, pass, kind) that may change their file.

    A file touched by suggestions is left alone by later passes; inserting an
    allow attribute waits while the file has any structural candidate, and
    then counts as deferred.
    """
    flags = candidates.groupBy("file").agg(F.bool_or(F.col("pass") == "suggestions").alias("_s"), F.bool_or(F.col("kind") == "structural").alias("_k"))
    runs = F.when(F.col("_s") & (F.col("pass") != "suggestions"), "skipped").when((F.col("kind") == "allow") & F.col("_k"), "deferred").otherwise("applied")
    return candidates.join(flags, "file").withColumn("state", runs).drop("_s", "_k")


def repair_totals(changes: DataFrame) -> DataFrame:
    """Sum of the six counters, and of five without the lint allows: two readers count differently."""
    six = ["removed_items", "removed_imports", "path_edits", "suggestion_edits", "added_dead_code_allows", "added_lint_allows"]
    total = lambda names: F.coalesce(F.sum(sum((F.coalesce(n, F.lit(0)) for n in names), F.lit(0))), F.lit(0))
    return changes.agg(total(six).alias("total_changes"), total(six[:-1]).alias("total_without_lint_allows"))
