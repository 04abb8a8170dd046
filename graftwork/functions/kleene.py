"""Three-valued conditions (OP-20 to OP-22, OP-57).

Spark's AND, OR and NOT over nullable booleans are Kleene's already; what is
added here are the aggregates, and a parser from condition text to a column.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def kleene_all(value: Column) -> Column:
    """Aggregate AND: false beats unknown beats true; true over no rows."""
    return F.when(F.coalesce(F.bool_or(~value), F.lit(False)), False).when(F.count("*") > F.count(value), F.lit(None)).otherwise(True)


def kleene_any(value: Column) -> Column:
    """Aggregate OR: true beats unknown beats false; false over no rows."""
    return F.when(F.coalesce(F.bool_or(value), F.lit(False)), True).when(F.count("*") > F.count(value), F.lit(None)).otherwise(False)


def survives(value: Column) -> Column:
    """Only what is definitely false is pruned."""
    return ~F.coalesce(value == F.lit(False), F.lit(False))


@dataclass(frozen=True)
class Condition:
    """op is all, any, not, flag or equals."""

    op: str
    name: str = ""
    value: str = ""
    parts: tuple[Condition, ...] = ()


TOKEN = re.compile(r'\s*(?:(?P<name>[A-Za-z_][\w:-]*)|(?P<text>"(?:[^"\\]|\\.)*")|(?P<mark>[(),=]))')


def parse(text: str) -> Condition | None:
    """A condition, bare or in cfg(...) or as the first argument of cfg_attr(...); None when it can't be read."""
    tokens, at = [], 0
    text = re.sub(r"^\s*#!?\[(.*)\]\s*$", r"\1", text, flags=re.S)
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m:
            return None
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    try:
        found, rest = _condition(tokens, 0)
    except (IndexError, ValueError):
        return None
    if rest != len(tokens):
        return None
    if found.op == "call":
        if found.name == "cfg" and len(found.parts) == 1 or found.name == "cfg_attr" and found.parts:
            found = found.parts[0]
        else:
            return None
    return _checked(found)


def _condition(tokens: list[tuple[str, str]], at: int) -> tuple[Condition, int]:
    kind, name = tokens[at]
    if kind != "name":
        raise ValueError(name)
    at += 1
    if at < len(tokens) and tokens[at] == ("mark", "="):
        kind, value = tokens[at + 1]
        if kind != "text":
            raise ValueError(value)
        return Condition("equals", name, re.sub(r"\\(.)", r"\1", value[1:-1])), at + 2
    if at < len(tokens) and tokens[at] == ("mark", "("):
        parts, at = [], at + 1
        while tokens[at] != ("mark", ")"):
            part, at = _condition(tokens, at)
            parts.append(part)
            if tokens[at] == ("mark", ","):
                at += 1
            elif tokens[at] != ("mark", ")"):
                raise ValueError(tokens[at][1])
        return Condition(name if name in ("all", "any", "not") else "call", name, parts=tuple(parts)), at + 1
    return Condition("flag", name), at


def _checked(c: Condition) -> Condition | None:
    if c.op == "call" or c.op == "not" and len(c.parts) != 1:
        return None
    return c if all(_checked(p) for p in c.parts) else None


#: Flags and keys that a target's facts decide; without a fact they are false.
KNOWN_FLAGS = ("unix", "windows", "debug_assertions", "test", "proc_macro")
KNOWN_KEYS = ("target_arch", "target_os", "target_family", "target_env", "target_vendor", "target_pointer_width", "target_endian")


def parse_time(c: Condition, facts: Column) -> Column:
    """What a parser may decide: features are unknown, `test` is false.

    `facts` is a map from key to an array of values; flags have an empty array.
    """
    if c.op == "flag" and c.name == "test":
        return F.lit(False)
    if c.op == "equals" and c.name == "feature":
        return F.lit(None).cast("boolean")
    return _value(c, facts, lambda p: parse_time(p, facts))


def check_time(c: Condition, facts: Column, features: Column, package: Column, all_features: Column) -> Column:
    """What a check's arguments decide: a feature is true or unknown, never false."""
    if c.op == "equals" and c.name == "feature":
        named = F.array_contains(features, F.lit(c.value)) | F.array_contains(features, F.concat(package, F.lit("/" + c.value)))
        return F.when(all_features | F.coalesce(named, F.lit(False)), F.lit(True))
    return _value(c, facts, lambda p: check_time(p, facts, features, package, all_features))


def _value(c: Condition, facts: Column, inner) -> Column:
    if c.op == "not":
        return ~inner(c.parts[0])
    if c.op in ("all", "any"):
        out = F.lit(c.op == "all")
        for p in c.parts:
            out = out & inner(p) if c.op == "all" else out | inner(p)
        return out
    values = F.try_element_at(facts, F.lit(c.name))
    if c.op == "flag":
        return F.when(values.isNotNull(), True).otherwise(F.lit(False) if c.name in KNOWN_FLAGS else F.lit(None).cast("boolean"))
    has = F.coalesce(F.array_contains(values, c.value), F.lit(False))
    return has if c.name in KNOWN_KEYS else F.when(has, F.lit(True))
