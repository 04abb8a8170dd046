"""Readers of captured tool output and of source texts (OP-01, OP-05 to OP-12b, §2.1)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.functions.ident import occurrences
from graftwork.operators.diag import diagnostics, record_schema
from graftwork.sources import rust


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Diagnostics of a JSON-lines file; lines that aren't JSON are dropped, incomplete parts of a line alone."""
    records = spark.read.schema(record_schema() + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return diagnostics(records.select("reason", "package_id", "target", "message"), F.input_file_name())


def parse_messages(lines: DataFrame, text: str = "value", run: str | None = None, ordinal: str | None = None) -> DataFrame:
    """Diagnostics of lines already in a table."""
    keep = [c for c in (run, ordinal) if c]
    parsed = lines.select(*keep, F.from_json(text, record_schema()).alias("_r")).select(*keep, "_r.*")
    return diagnostics(parsed, F.col(run) if run else None, F.col(ordinal) if ordinal else None)


PACKAGE = """struct<id:string,name:string,manifest_path:string,
dependencies:array<struct<name:string,rename:string,kind:string,path:string>>,
targets:array<struct<name:string,kind:array<string>,src_path:string,`required-features`:array<string>>>>"""
METADATA = f"packages array<{PACKAGE}>, workspace_members array<string>, workspace_root string"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(root, package struct) of workspace members in captured metadata documents."""
    return workspace_members(spark.read.schema(METADATA).option("multiLine", True).json(path))


def workspace_members(doc: DataFrame) -> DataFrame:
    each = doc.select("workspace_root", "workspace_members", F.explode("packages").alias("package"))
    return each.filter(F.array_contains("workspace_members", F.col("package.id"))).select(F.col("workspace_root").alias("root"), "package")


def metadata_targets(members: DataFrame) -> DataFrame:
    return members.select(F.col("package.name").alias("package"), F.explode("package.targets").alias("t")).select("package", "t.name", "t.kind", "t.src_path", F.col("t.required-features").alias("features"))


def metadata_dependencies(members: DataFrame) -> DataFrame:
    return members.select(F.col("package.name").alias("package"), F.explode("package.dependencies").alias("d")).select("package", "d.name", "d.rename", "d.kind", "d.path")


def selectors(texts: DataFrame, text: str = "value") -> DataFrame:
    """(the other columns, ord, selector): trimmed lines, without blank ones and comments."""
    keep = [c for c in texts.columns if c != text]
    lines = texts.select(*keep, F.posexplode(F.split(text, "\r?\n")).alias("ord", "_l")).select(*keep, "ord", F.trim("_l").alias("selector"))
    return lines.filter((F.col("selector") != "") & ~F.col("selector").startswith("#"))


def read_selectors(spark: SparkSession, path: str) -> DataFrame:
    """(ord, selector) of a file of root selectors."""
    return selectors(spark.read.text(path, wholetext=True))


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document, or a single null row where there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(schema).option("multiLine", True).json(path)
    empty = spark.createDataFrame([], schema)
    return spark.range(1).select(*[F.lit(None).cast(t).alias(n) for n, t in empty.dtypes])


def read_sources(spark: SparkSession, path: str, glob: str = "*.rs") -> DataFrame:
    """(path, text) of source files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def manifest_files(files: DataFrame, name: str = "Cargo.toml", skip: tuple[str, ...] = ("target", "node_modules", "__pycache__")) -> DataFrame:
    """(path) of manifests among listed files, sorted; folders that hold output, or whose names start with a dot, are left out."""
    parts = F.split("path", "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    hidden = F.exists(folders, lambda x: x.isin(*skip) | (x.startswith(".") & ~x.isin(".", "..")))
    return files.filter((F.element_at(parts, -1) == name) & ~hidden).select("path").distinct().orderBy("path")


PARSED_KINDS = ("lib", "proc-macro", "bin", "example", "test", "bench")


def local_packages(members: DataFrame, files: DataFrame) -> DataFrame:
    """(name, root, entry, target_name, target_kinds) of targets that can be parsed and whose source is there."""
    each = members.select(F.col("package.name").alias("name"), F.regexp_replace("package.manifest_path", r"/[^/]*$", "").alias("root"), F.explode("package.targets").alias("t"))
    fits = each.filter(F.arrays_overlap("t.kind", F.array(*[F.lit(k) for k in PARSED_KINDS])))
    out = fits.select("name", "root", F.col("t.src_path").alias("entry"), F.coalesce("t.name", "name").alias("target_name"), F.col("t.kind").alias("target_kinds"))
    return out.join(files.select(F.col("path").alias("entry")).distinct(), "entry", "left_semi").select("name", "root", "entry", "target_name", "target_kinds")


PUB = r"(?:pub(?:\([^)]*\))?\s+)?"
NAME = r"([A-Za-z_]\w*)"
PATTERNS = {
    "fn": re.compile(r'(?:(?:pub(?:\([^)]*\))?|async|const|unsafe|extern\s+"[^"]+"|extern)\s+)*fn\s+' + NAME),
    "enum": re.compile(PUB + r"enum\s+" + NAME),
    "trait": re.compile(PUB + r"(?:unsafe\s+)?trait\s+" + NAME),
    "struct": re.compile(PUB + r"struct\s+" + NAME),
    "mod": re.compile(r"(?:pub\s+)?mod\s+" + NAME + r"(?:;|\s*\{)"),
}
LOOK_BACK = 5


def attributes_above(lines: list[str], i: int) -> Iterator[str]:
    """Attribute lines among the five before line i, up to the first other one; blank lines are passed over."""
    for line in reversed(lines[max(i - LOOK_BACK, 0) : i]):
        line = line.strip()
        if line and not line.startswith("#["):
            return
        if line:
            yield line


def scanned(text: str) -> list[dict]:
    lines, out = re.split(r"\r\n|\r|\n", text), []
    for i, line in enumerate(lines):
        line = line.strip()
        for kind, pattern in PATTERNS.items():
            if m := pattern.match(line):
                if not any("cfg(test)" in a or a == "#[test]" for a in attributes_above(lines, i)):
                    out.append({"number": i + 1, "kind": kind, "name": m[1], "public": line.startswith("pub")})
                break
    return out


def scan_items(files: DataFrame, public_only: bool = False) -> DataFrame:
    """(path, number, kind, name, public): declarations found line by line; the first pattern that fits a line decides,
    and what a test attribute stands above is skipped.

    A file stays in its row, so nothing is shuffled.
    """
    found = F.udf(scanned, "array<struct<number:bigint,kind:string,name:string,public:boolean>>", useArrow=True)
    each = files.select("path", F.explode(found(F.coalesce("text", F.lit("")))).alias("i")).select("path", "i.*")
    return each.filter("public") if public_only else each


def crawl(files: DataFrame, entries: DataFrame, public_only: bool = False) -> DataFrame:
    """(path, module_path, number, kind, name, public) of items in files that the entries reach through module declarations."""
    from graftwork.operators.closure import module_tree

    parsed = rust.parse_files(files, items=("kind", "name", "module", "attrs", "inline"), uses=False)
    declared = rust.declared_modules(parsed).select("path", F.concat_ws("::", F.concat("module", F.array("name"))).alias("module"), "candidates")
    tree = module_tree(declared, files, entries).select("path", "module_path")
    return scan_items(files, public_only).join(tree, "path").select("path", "module_path", "number", "kind", "name", "public")


def declared_modules(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, *keep, module, candidates) of `mod x;`: an explicit path, else x.rs, else x/mod.rs, below the file's own folder."""
    parsed = rust.parse_files(files, keep=keep, items=("kind", "name", "module", "attrs", "inline"), uses=False)
    return rust.declared_modules(parsed).select("path", *keep, F.col("name").alias("module"), "candidates")


def automod(files: DataFrame, folder: Column) -> DataFrame:
    """Modules of a folder's files, sorted, without mod.rs."""
    name = F.regexp_extract("path", r"([^/]*)\.rs$", 1)
    return files.filter((F.regexp_replace("path", r"/[^/]*$", "") == folder) & (name != "") & (name != "mod")).select("path", name.alias("module")).orderBy("module")


def imports(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, *keep, module, name, target, glob) of `use` declarations, groups of any depth flattened.

    `a::{self}` gives the key `self` and keeps it in its target; a later entry
    of a name overwrites an earlier one of its module.
    """
    return rust.uses_of(rust.parse_files(files, keep=keep, items=())).select("path", *keep, "module", "name", "target", "glob")


def token_counts(files: DataFrame, name: str) -> DataFrame:
    return files.select("path", occurrences(F.col("text"), name).alias("n")).filter("n > 0")
