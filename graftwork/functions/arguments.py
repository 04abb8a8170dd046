"""Build arguments, target triples and static include paths (OP-69 to OP-69d)."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = {"lib": None, "bin": "bins", "example": "examples", "test": "tests", "bench": "benches"}


def enabled_features(args: Column) -> Column:
    """Features after `--features x` or `--features=x`, split at commas and spaces; sorted, distinct."""
    n = F.size(args)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    values = F.transform(
        at,
        lambda i: F.when(F.element_at(args, i).startswith("--features="), F.substr(F.element_at(args, i), F.lit(12)))
        .when((i > 1) & F.try_element_at(args, i - 1).isin("--features", "-F"), F.element_at(args, i))
        .otherwise(""),
    )
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(values, lambda v: F.split(v, "[, ]+"))), lambda v: v != "")))


def all_features(args: Column) -> Column:
    return F.array_contains(args, "--all-features")


def features_enabled(required: Column, package: Column, enabled: Column, everything: Column) -> Column:
    """Every required feature, bare or as `package/feature`, is enabled; vacuously for none."""
    one = lambda f: F.array_contains(enabled, f) | F.coalesce(F.array_contains(enabled, F.concat(package, F.lit("/"), f)), F.lit(False))
    return everything | F.forall(required, one)


def _followed(args: Column, flag: str, value: Column) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.size(args), F.lit(1)))
    return F.exists(at, lambda i: (F.try_element_at(args, i) == flag) & (F.try_element_at(args, i + 1) == value))


def covers_target(args: Column, kind: Column, name: Column) -> Column:
    """A target is covered by --all-targets, its plural, `--kind name` or `--kind=name`; a library by --lib or no target flag at all."""
    any_flag = F.exists(args, lambda a: a.rlike(r"^--(lib|bins?|examples?|tests?|benches|bench|all-targets)(=.*)?$"))
    out = F.array_contains(args, "--all-targets")
    for k, plural in KINDS.items():
        if plural is None:
            own = F.array_contains(args, "--lib") | ~any_flag
        else:
            own = F.array_contains(args, f"--{plural}") | F.coalesce(_followed(args, f"--{k}", name), F.lit(False)) | F.array_contains(args, F.concat(F.lit(f"--{k}="), name))
        out = out | ((kind == k) & own)
    return F.coalesce(out, F.lit(False))


def package_scope(args: Column) -> Column:
    """Packages after `-p x`, `--package x` or `--package=x`, in order."""
    n = F.size(args)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    found = F.transform(
        at,
        lambda i: F.when(F.element_at(args, i).startswith("--package="), F.substr(F.element_at(args, i), F.lit(11)))
        .when((i > 1) & F.try_element_at(args, i - 1).isin("-p", "--package"), F.element_at(args, i))
        .otherwise(""),
    )
    return F.filter(found, lambda v: v != "")


def triple_facts(triple: Column) -> Column:
    """map(key -> values) of arch, vendor, os, env, family, pointer width and endianness."""
    part = lambda i: F.try_element_at(F.split(triple, "-"), F.lit(i))
    raw = part(1)
    arch = F.when(raw.rlike("^i[3-6]86$"), "x86").when(raw.startswith("armv") | raw.startswith("thumb"), "arm").when(raw == "powerpc64le", "powerpc64").when(raw.startswith("riscv32"), "riscv32").when(raw.startswith("riscv64"), "riscv64").otherwise(raw)
    named = F.when(part(3) == "darwin", "macos").when(part(3).startswith("wasi"), "wasi").otherwise(part(3))
    os = F.when(triple.contains("windows"), "windows").when(triple.contains("android"), "android").when(triple.contains("linux"), "linux").when(triple.contains("-ios"), "ios").when(named.isNull() | (named == "unknown"), "none").otherwise(named)
    family = F.when(os == "windows", "windows").when(raw.startswith("wasm"), "wasm").when(os.isin("linux", "android", "macos", "ios", "freebsd", "netbsd", "openbsd", "solaris"), "unix")
    env = F.when(F.size(F.split(triple, "-")) > 3, F.regexp_replace(part(4), "^(gnu|musl).*$", "$1")).otherwise("")
    width = F.when(raw.rlike("64") | (raw == "s390x"), "64").when(raw.isin("avr", "msp430"), "16").otherwise("32")
    endian = F.when(raw.isin("powerpc", "powerpc64", "s390x", "sparc64", "mips", "mips64"), "big").otherwise("little")
    facts = {"target_arch": arch, "target_vendor": part(2), "target_os": os, "target_env": env, "target_pointer_width": width, "target_endian": endian}
    pairs = [F.struct(F.lit(k).alias("key"), F.array(v).alias("value")) for k, v in facts.items()]
    pairs.append(F.when(family.isNotNull(), F.struct(F.lit("target_family").alias("key"), F.array(family).alias("value"))))
    pairs.append(F.when(family.isin("unix", "windows"), F.struct(family.alias("key"), F.array().cast("array<string>").alias("value"))))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.isNotNull()))


def printed_facts(lines: Column) -> Column:
    """map(key -> values) from an array of printed lines: `flag` or `key="value"`."""
    clean = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    keys = F.array_sort(F.array_distinct(F.transform(clean, lambda x: F.substring_index(x, "=", 1))))
    values = lambda k: F.array_sort(F.transform(F.filter(clean, lambda x: x.startswith(F.concat(k, F.lit("=")))), lambda x: F.regexp_replace(F.substr(x, F.length(k) + 2), '^"|"$', "")))
    return F.map_from_arrays(keys, F.transform(keys, values))


PART = re.compile(r'\s*(?:"((?:[^"\\]|\\.)*)"|env!\s*\(\s*"([^"]*)"\s*,?\s*\))\s*(,|$)', re.S)


def static_include(expression: str) -> tuple[str, str | None]:
    """(kind, path) of an include argument: kind is relative, manifest or unknown.

    A literal, or a concat! of literals in which env!("CARGO_MANIFEST_DIR")
    may come once, first.
    """
    text = expression.strip()
    m = re.fullmatch(r"concat!\s*\((.*)\)", text, re.S)
    inner, at, out, manifest = (m[1] if m else text).strip(), 0, [], False
    while at < len(inner):
        p = PART.match(inner, at)
        if not p or (not m and p[3] == ","):
            return "unknown", None
        if p[2] is not None:
            if p[2] != "CARGO_MANIFEST_DIR" or out or manifest or not m:
                return "unknown", None
            manifest = True
        else:
            out.append(re.sub(r"\\(.)", r"\1", p[1]))
        at = p.end()
    if not out and not manifest:
        return "unknown", None
    path = "".join(out)
    return ("manifest", path.lstrip("/")) if manifest else ("relative", path)


def confined(root: str, path: str) -> bool:
    """Whether a path, taken from the root and normalised, stays below it."""
    whole = posixpath.normpath(posixpath.join(root, path))
    return whole == posixpath.normpath(root) or whole.startswith(posixpath.normpath(root) + "/")
