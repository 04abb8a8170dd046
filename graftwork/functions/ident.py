"""Symbol ids, paths and tokens as expressions (OP-14, OP-14b, OP-16, OP-23, OP-62 to OP-64, OP-68, OP-77)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

TICK = r"`([^`]*)`"


def joined(parts: Column) -> Column:
    return F.array_join(parts, "::")


def free_id(package: Column, path: Column, name: Column) -> Column:
    return joined(F.concat(F.array(package), path, F.array(name)))


def method_id(package: Column, type_path: Column, name: Column, trait_path: Column | None = None, trait_inputs: Column | None = None) -> Column:
    """`pkg::Type::name`, or `pkg::<Type as Trait<In, In>>::name` where there is a trait; inputs show only when there are any."""
    plain = joined(F.concat(F.array(package), type_path, F.array(name)))
    if trait_path is None:
        return plain
    inputs = F.lit("") if trait_inputs is None else F.when(F.size(trait_inputs) > 0, F.concat(F.lit("<"), F.array_join(F.transform(trait_inputs, joined), ", "), F.lit(">"))).otherwise("")
    through = F.concat(package, F.lit("::<"), joined(type_path), F.lit(" as "), joined(trait_path), inputs, F.lit(">::"), name)
    return F.when(trait_path.isNull(), plain).otherwise(through)


def item_id(package: Column, module: Column, name: Column, kind: Column) -> Column:
    return F.concat(joined(F.concat(F.array(package), module, F.array(name))), F.lit("("), kind, F.lit(")"))


def package_of(ident: Column) -> Column:
    """Text before the first `::`; the whole id without one."""
    return F.substring_index(ident, "::", 1)


def _rest(segments: Column) -> Column:
    return F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0)))


def _first(segments: Column) -> Column:
    return F.try_element_at(segments, F.lit(1))


def normalized(module: Column, segments: Column) -> Column:
    """Resolve a leading `crate`, `self` or `super`; only the first `super` counts."""
    parent = F.slice(module, F.lit(1), F.greatest(F.size(module) - 1, F.lit(0)))
    first = _first(segments)
    return (
        F.when(first == "crate", _rest(segments))
        .when(first == "self", F.concat(module, _rest(segments)))
        .when(first == "super", F.concat(parent, _rest(segments)))
        .otherwise(segments)
    )


def aliased(segments: Column, target: Column) -> Column:
    """Put an alias's target (null for none) in place of the first segment, once."""
    return F.when(target.isNull(), segments).otherwise(F.concat(target, _rest(segments)))


def sorted_distinct(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def is_workspace_source(path: Column, root: str) -> Column:
    """A `.rs` file under the root with no `target` directory on the way."""
    relative = F.substr(path, F.lit(len(root.rstrip("/")) + 2))
    return path.endswith(".rs") & path.startswith(root.rstrip("/") + "/") & ~F.array_contains(F.split(relative, "/"), "target")


def first_ticked(text: Column) -> Column:
    """The first back-ticked token; null when there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, TICK, 1), F.lit(""))


def all_ticked(text: Column) -> Column:
    """All non-empty back-ticked tokens, in order; an empty array for null."""
    found = F.regexp_extract_all(text, F.lit(TICK), F.lit(1))
    return F.coalesce(F.filter(found, lambda x: x != ""), F.array().cast("array<string>"))


def field_owner(text: Column) -> Column:
    """The token after ` on type `, else the one after `struct `."""
    after = lambda mark: F.when(F.instr(text, mark) > 0, first_ticked(F.substr(text, F.instr(text, mark) + len(mark))))
    return F.coalesce(after(" on type "), after("struct "))


def diagnostic_symbol(code: Column, message: Column, rendered: Column) -> Column:
    """The symbol that a diagnostic is about."""
    owner = F.when(code.isin("E0560", "E0609"), F.coalesce(field_owner(message), field_owner(rendered)))
    return F.coalesce(owner, first_ticked(message), first_ticked(rendered))


#: After what is no name at the start, at most 96 letters, digits, hyphens, or runs of anything else that a name follows.
SLUG = r"^[^A-Za-z0-9-]*+((?:[A-Za-z0-9-]|[^A-Za-z0-9-]++(?=[A-Za-z0-9-])){0,96}+)"


def output_slug(ordinal: Column, text: Column) -> Column:
    """`0001-name`: other characters to `_`, runs collapsed, ends trimmed, at most 96.

    The pattern stops where the slug is full, so a long text costs no more than a short one.
    """
    clean = F.regexp_replace(F.regexp_extract(text, SLUG, 1), "[^A-Za-z0-9-]+", "_")
    clean = F.when(clean == "", "root").otherwise(clean)
    number = ordinal.cast("string")
    return F.concat(F.lpad(number, F.greatest(F.length(number), F.lit(4)), F.lit("0")), F.lit("-"), clean)  # lpad cuts what is longer


def occurrences(text: Column, name: str) -> Column:
    """How often an identifier occurs between identifier boundaries."""
    return F.regexp_count(text, F.lit(rf"(?<![A-Za-z0-9_])\Q{name}\E(?![A-Za-z0-9_])"))


def snippet(text: Column, limit: int = 160) -> Column:
    """White space collapsed, cut to the limit."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit)


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))
