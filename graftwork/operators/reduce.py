"""Hazard rows of retained items, and what the reducer keeps (§2.13, §2.14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUT_DIR = r'\binclude!\s*[(\[{]\s*concat!\s*\(\s*env!\s*\(\s*"OUT_DIR"'
INCLUDE = r"\binclude!\s*[(\[{]"
STANDARD_MACROS = (
    "assert assert_eq assert_ne cfg column compile_error concat dbg debug_assert debug_assert_eq debug_assert_ne env eprint eprintln file format format_args include include_bytes include_str "
    "line macro_rules matches module_path option_env panic print println stringify thread_local todo unimplemented unreachable vec write writeln"
).split()
STANDARD_DERIVES = "Clone Copy Debug Default Eq Hash Ord PartialEq PartialOrd".split()
STANDARD_ATTRIBUTES = (
    "allow automatically_derived cfg cfg_attr cold deny deprecated derive doc expect export_name forbid global_allocator ignore inline link link_name link_section macro_export macro_use must_use no_link "
    "no_mangle non_exhaustive panic_handler path proc_macro proc_macro_attribute proc_macro_derive repr should_panic target_feature test track_caller used warn"
).split()


def _any(texts: Column, pattern: str) -> Column:
    return F.exists(texts, lambda x: x.rlike(pattern))


def hazard_flags() -> dict[str, Column]:
    """Code -> condition over an item (kind, text, attrs, is_root, scoped)."""
    t, a = F.col("text"), F.col("attrs")
    others = lambda names: "(?:" + "|".join(names) + ")"
    include = t.rlike(INCLUDE) & ~t.rlike(OUT_DIR)
    derives = F.flatten(F.transform(F.filter(a, lambda x: x.rlike(r"^derive\s*\(")), lambda x: F.regexp_extract_all(x, F.lit(r"[(,]\s*(?:\w+::)*(\w+)\s*(?=[,)])"), F.lit(1))))
    return {
        "cfg_gated_roots": F.col("is_root") & _any(a, r"^cfg\s*\("),
        "conditional_compilation_attrs": _any(a, r"^cfg(?:_attr)?\s*\("),
        "source_include_macros": include & ~F.col("scoped"),
        "scoped_source_include_macros": include & F.col("scoped"),
        "out_dir_source_include_macros": t.rlike(OUT_DIR),
        "compile_env_macros": t.rlike(r'\b(?:option_)?env!\s*\(\s*"(?!CARGO_MANIFEST_DIR"|OUT_DIR")'),
        "dynamic_callback_boundaries": t.rlike(r"\bdyn\s+(?:for\s*<[^>]*>\s*)?Fn(?:Mut|Once)?\b"),
        "trait_object_surfaces": t.rlike(r"\bdyn\s+(?!(?:for\s*<[^>]*>\s*)?Fn(?:Mut|Once)?\b)[A-Za-z_:]"),
        "function_pointer_surfaces": t.rlike(r"(?<!\w)fn\s*\("),
        "custom_macro_invocations": t.rlike(rf"\b(?!{others(STANDARD_MACROS)}!)[A-Za-z_]\w*!\s*[(\[{{]"),
        "custom_derive_macros": F.exists(derives, lambda d: ~d.isin(*STANDARD_DERIVES)),
        "custom_attribute_macros": F.exists(a, lambda x: ~F.regexp_extract(x, r"^(\w+)", 1).isin(*STANDARD_ATTRIBUTES)),
    }


def hazard_rows(items: DataFrame) -> DataFrame:
    """(id, code, severity) of retained items (id, text, attrs, is_root, scoped): every code whose condition holds.

    Gated roots and what a build script puts in are errors, the rest warnings.
    """
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), code) for code, c in hazard_flags().items()])
    each = items.select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("code"))
    return each.withColumn("severity", F.when(F.col("code").isin("cfg_gated_roots", "out_dir_source_include_macros"), "error").otherwise("warning"))


def build_script_rows(packages: DataFrame) -> DataFrame:
    """(id, code, severity) of retained packages (package, build_script) that have a build script."""
    return packages.filter("build_script is not null").select(F.col("package").alias("id"), F.lit("retained_build_scripts").alias("code"), F.lit("warning").alias("severity"))


def fallback_hazards(edges: DataFrame, most: int = 8) -> DataFrame:
    """(id, code, severity) of owners whose method calls were resolved by name alone, and of those with too many names for it."""
    per = edges.filter("kind = 'single_name'").groupBy(F.col("owner").alias("id")).agg(F.count("*").alias("_n"))
    code = F.explode(F.filter(F.array(F.lit("syntactic_method_fallbacks"), F.when(F.col("_n") > most, "syntactic_method_fallback_cap")), lambda x: x.isNotNull()))
    return per.select("id", code.alias("code"), F.lit("warning").alias("severity"))


def format_captures(text: Column) -> Column:
    """Names that a format string captures: `{name}` and `{name:?}`, not `{{name}}`, positions or empty braces."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, r"\{\{|\}\}", " "), F.lit(r"\{([A-Za-z_]\w*)(?::[^{}]*)?\}"), F.lit(1)))


def live_impls(impls: DataFrame, reached: DataFrame) -> DataFrame:
    """Trait impls (id, self_type, trait, external_trait) that render: the self type and the trait are both reached; a trait from outside always is."""
    live = lambda c: reached.select(F.col("id").alias(c)).distinct()
    own = impls.join(live("self_type"), "self_type", "left_semi")
    known = own.join(live("trait").withColumn("_live", F.lit(True)), "trait", "left")
    return known.filter(F.col("external_trait") | F.col("_live")).select("id")


def impl_members(impls: DataFrame, members: DataFrame, reached: DataFrame) -> DataFrame:
    """Members (impl, id, required) that rendered impls (id) keep: required ones, and optional ones that are reached."""
    live = reached.select("id").distinct().withColumn("_live", F.lit(True))
    own = members.join(impls.select(F.col("id").alias("impl")), "impl", "left_semi").join(live, "id", "left")
    return own.filter(F.col("required") | F.col("_live")).select("impl", "id")


def kept_fields(fields: DataFrame, uses: DataFrame) -> DataFrame:
    """Struct fields (owner, name, public, attributed, generic) that stay: public, attributed or generic ones, and those used by name (owner, name)."""
    used = uses.select("owner", "name").distinct().withColumn("_used", F.lit(True))
    kept = fields.join(used, ["owner", "name"], "left")
    return kept.filter(F.col("public") | F.col("attributed") | F.col("generic") | F.col("_used")).select("owner", "name")


def kept_imports(imports: DataFrame, uses: DataFrame, bindings: DataFrame) -> DataFrame:
    """Imports (file, name, target) that stay: their target is used in the file, or the name is and no local binding explains it."""
    by_target = uses.filter("target is not null").select("file", "target").distinct().withColumn("_t", F.lit(True))
    by_name = uses.filter("target is null").select("file", "name").distinct().join(bindings.select("file", "name").distinct(), ["file", "name"], "left_anti").withColumn("_n", F.lit(True))
    kept = imports.join(by_target, ["file", "target"], "left").join(by_name, ["file", "name"], "left")
    return kept.filter(F.col("_t") | F.col("_n")).select("file", "name", "target")


def render_set(selected: DataFrame, widened: DataFrame, unknown: DataFrame) -> DataFrame:
    """(id, why) of what is rendered: selected, then what checks widened, then what unknown evidence retains; the first reason counts."""
    sides = [s.select("id", F.lit(i).alias("_r")) for i, s in enumerate((selected, widened, unknown))]
    every = sides[0].unionByName(sides[1]).unionByName(sides[2]).groupBy("id").agg(F.min("_r").alias("_r"))
    names = F.array(*[F.lit(x) for x in ("selected", "widened", "unknown_retention")])
    return every.select("id", F.element_at(names, F.col("_r") + 1).alias("why"))


def usage_class(reached: Column, blocked: Column, proven: Column) -> Column:
    """used, blocked_by_unknown, prunable or unused_candidate, in this order."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(reached), "used").when(yes(blocked), "blocked_by_unknown").when(yes(proven), "prunable").otherwise("unused_candidate")
