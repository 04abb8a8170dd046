"""Items, modules and imports of Rust sources (OP-07, OP-08, OP-11 to OP-12b, OP-16), in Arrow batches.

A file is read as tokens and its items as a tree: what a declaration's body
holds is skipped, but for modules, impls and the use trees between. A file
whose brackets don't match is a row with status `syntax`.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# words and brackets come first, as most tokens are; what may begin a literal is left to the patterns after them
TOKEN = re.compile(
    r"""(?:(?P<name>(?![bcr]+\#*["'])(?:r\#)?[^\W\d]\w*)|(?P<space>\s+|//[^\n]*)|(?P<one>[{}()\[\];,<>&\#!])"""
    r"""|(?P<block>/\*)|(?P<raw>b?c?r(?P<hash>\#*)")|(?P<string>[bc]?"(?:[^"\\]|\\.)*")|(?P<char>b?'(?:[^'\\\n]|\\(?:[^u]|u\{[^}]*\}))[^'\n]{0,3}?')"""
    r"""|(?P<life>'[A-Za-z_]\w*)|(?P<word>(?:r\#)?[^\W\d]\w*)|(?P<number>\d[\w.]*?(?=[^\w.]|\.\.|$))|(?P<sep>::|->|=>|\.\.=?|.))\s*""",
    re.S | re.X,
)
EDGE = re.compile(r"/\*|\*/")
CLOSE = {"(": ")", "[": "]", "{": "}"}
KINDS = {"struct": "Struct", "enum": "Enum", "union": "Union", "type": "Type", "trait": "Trait", "const": "Const", "static": "Static", "mod": "Mod", "fn": "Fn"}
QUALIFIERS = {"pub", "default", "async", "unsafe", "extern", "const", "safe", "auto"}

Token = tuple[str, int]  # text and offset


class Broken(ValueError):
    """Brackets that don't match, or a text that ends too early."""


def tokens_of(text: str) -> list[Token]:
    out: list[Token] = []
    at, n = 0, len(text)
    while at < n:
        for m in TOKEN.finditer(text, at):
            kind = m.lastgroup
            if kind == "name" or kind == "word":
                w = m[kind]
                out.append((w[2:] if w.startswith("r#") else w, m.start()))
            elif kind == "block":
                at = _comment_end(text, m.end("block"))
                break
            elif kind == "raw":
                start, at = m.start(), text.find('"' + m["hash"], m.end("raw"))
                if at < 0:
                    raise Broken("string")
                at += 1 + len(m["hash"])
                out.append((text[start:at], start))
                break
            elif kind != "space":
                out.append((m[kind], m.start()))
        else:
            break
    return out


def _comment_end(text: str, at: int) -> int:
    depth = 1
    while depth:
        edge = EDGE.search(text, at)
        if not edge:
            raise Broken("comment")
        depth, at = depth + (1 if edge[0] == "/*" else -1), edge.end()
    return at


def matched(tokens: list[Token]) -> dict[int, int]:
    """For each opening bracket the index of its closing one."""
    open_: list[int] = []
    out: dict[int, int] = {}
    for i, (t, _) in enumerate(tokens):
        if t in CLOSE:
            open_.append(i)
        elif t in ")]}":
            if not open_ or CLOSE[tokens[open_[-1]][0]] != t:
                raise Broken("bracket")
            out[open_.pop()] = i
    if open_:
        raise Broken("bracket")
    return out


class Parser:
    """Items of one file, with their module paths below the file's own."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = tokens_of(text)
        self.ends = matched(self.tokens)
        #: The i-th token's text; empty for the few places behind the last that the rules look at.
        self.word = [*[t for t, _ in self.tokens], *[""] * 16].__getitem__
        self.items: list[dict] = []
        self.uses: list[dict] = []
        self.lines = [m.end() for m in re.finditer("\n", text)]
        self.block(0, len(self.tokens), [], None)

    def line(self, i: int) -> int:
        return bisect.bisect_right(self.lines, self.tokens[min(i, len(self.tokens) - 1)][1]) + 1

    def raw(self, a: int, b: int) -> str:
        """The text of tokens a to b, b included."""
        return self.text[self.tokens[a][1] : self.tokens[b][1] + len(self.tokens[b][0])] if b >= a else ""

    def attributes(self, i: int) -> tuple[int, list[str]]:
        out = []
        while self.word(i) == "#":
            inner = i + 1 + (self.word(i + 1) == "!")
            if self.word(inner) != "[":
                break
            end = self.ends[inner]
            if inner == i + 1:
                out.append(re.sub(r"\s+", " ", self.raw(inner + 1, end - 1)))
            i = end + 1
        return i, out

    def skip_to(self, i: int, end: int, stops: str) -> int:
        """The first of the stops outside brackets."""
        word, ends = self.word, self.ends
        while i < end and (w := word(i)) not in stops:
            i = ends[i] + 1 if w in CLOSE else i + 1
        return i

    def block(self, i: int, end: int, module: list[str], impl: dict | None) -> None:
        while i < end:
            first = i
            i, attrs = self.attributes(i)
            if i >= end:
                return
            public = self.word(i) == "pub"
            while self.word(i) in QUALIFIERS and not (self.word(i) == "const" and self.word(i + 1) not in ("fn", "unsafe", "async", "extern")):
                if self.word(i) == "extern" and self.word(i + 1) == "crate":
                    break
                i += 1
                if self.word(i) == "(" and self.word(i - 1) == "pub":
                    i = self.ends[i] + 1
                elif self.word(i).startswith('"'):
                    i += 1
            w = self.word(i)
            if w == "use":
                stop = self.skip_to(i, end, ";")
                self.use_tree(i + 1, stop, [], module, public, self.line(i))
                i = stop + 1
            elif w == "impl":
                body = self.skip_to(i, end, "{")
                self.block(body + 1, self.ends.get(body, body), module, self.impl_head(i + 1, body, attrs))
                i = self.ends.get(body, body) + 1
            elif w in KINDS or (w == "macro_rules" and self.word(i + 1) == "!"):
                i = self.declared(w, i, end, first, attrs, public, module, impl)
            elif w == "extern" or w == "{":
                i = self.skip_to(i, end, ";{")
                i = self.ends.get(i, i) + 1
            else:
                i = self.invoked(i, end, first, attrs, module)

    def declared(self, w: str, i: int, end: int, first: int, attrs: list[str], public: bool, module: list[str], impl: dict | None) -> int:
        name = self.word(i + (2 if w == "macro_rules" else 1 + (w in ("static", "const") and self.word(i + 1) == "mut")))
        stop = self.skip_to(i, end, ";" if w in ("const", "static", "type") else ";{")
        last = self.ends.get(stop, min(stop, len(self.tokens) - 1))
        if w == "macro_rules" and self.word(last + 1) == ";":
            last += 1
        inline = w == "mod" and self.word(stop) == "{"
        kind = "Macro" if w == "macro_rules" else "Method" if impl is not None and w == "fn" else KINDS[w]
        if impl is None or w == "fn":
            self.items.append({
                "kind": kind, "name": name, "module": list(module), "public": public, "attrs": attrs, "inline": inline, "start_line": self.line(first), "end_line": self.line(last), "text": self.raw(first, last),
                **(impl or {"type_path": None, "self_is_path": None, "trait_path": None, "trait_inputs": None}),
            })
        if inline and not is_test(attrs):
            self.block(stop + 1, last, [*module, name], None)
        return last + 1

    def invoked(self, i: int, end: int, first: int, attrs: list[str], module: list[str]) -> int:
        """A macro among the items; `bitflags!` declares the struct that it names first."""
        stop = self.skip_to(i, end, ";!({[")
        if self.word(stop) != "!":
            return max(self.ends.get(stop, stop) + 1, i + 1)
        body = self.skip_to(stop, end, "({[")
        close = self.ends.get(body, body)
        if self.word(stop - 1) == "bitflags":
            names = [self.word(k + 1) for k in range(body + 1, close) if self.word(k) == "struct"]
            if names:
                self.items.append({"kind": "Struct", "name": names[0], "module": list(module), "public": False, "attrs": attrs, "inline": False, "start_line": self.line(first), "end_line": self.line(close), "text": self.raw(first, close), "type_path": None, "self_is_path": None, "trait_path": None, "trait_inputs": None})
        return close + 1 + (self.word(close + 1) == ";")

    def impl_head(self, i: int, body: int, attrs: list[str]) -> dict:
        i = self.angles(i) if self.word(i) == "<" else i
        cut = where = body
        depth = 0
        for k in range(i, body):
            t = self.word(k)
            depth += (t == "<") - (t == ">")
            if depth == 0 and t == "for" and cut == body and self.word(k + 1) != "<":
                cut = k
            if depth == 0 and t == "where":
                where = k
                break
        of_trait = cut < where
        own = self.path(cut + 1 if of_trait else i, where)
        trait = self.path(i + (self.word(i) in ("!", "?")), cut) if of_trait else None
        inputs = sorted(set(map(tuple, self.input_types(i, cut)))) if of_trait else None
        return {"type_path": own, "self_is_path": own is not None, "trait_path": trait, "trait_inputs": [list(x) for x in inputs] if inputs is not None else None}

    def angles(self, i: int) -> int:
        depth, word = 0, self.word
        while i < len(self.tokens):
            w = word(i)
            depth += (w == "<") - (w == ">")
            i += 1
            if depth == 0:
                return i
        raise Broken("angle")

    def path(self, i: int, stop: int) -> list[str] | None:
        """The segments of a plain path type, without its generic arguments; None for any other type."""
        out, i = [], i + (self.word(i) == "::")
        while i < stop:
            if not re.fullmatch(r"[^\W\d]\w*", self.word(i)) or self.word(i) in ("dyn", "fn"):
                return None
            out.append(self.word(i))
            i += 1
            if self.word(i) == "<":
                i = self.angles(i)
            if i >= stop:
                break
            if self.word(i) != "::":
                return None
            i += 1
            if self.word(i) == "<":
                i = self.angles(i)
        return out or None

    def input_types(self, i: int, stop: int) -> Iterator[list[str]]:
        """Path types among generic arguments, through nested arguments and references."""
        while i < stop and self.word(i) != "<":
            i += 1
        if i >= stop:
            return
        close = self.angles(i) - 1
        part, depth, parts = i + 1, 0, []
        for k in range(i + 1, close + 1):
            t = self.word(k)
            if depth == 0 and (t == "," or k == close):
                parts.append((part, k))
                part = k + 1
            depth += (t in "<([") - (t in ">)]") if len(t) == 1 else 0
        for a, b in parts:
            while a < b and (self.word(a) in ("&", "mut") or self.word(a).startswith("'")):
                a += 1
            own = self.path(a, b)
            if own:
                yield own
                yield from self.input_types(a, b)

    def use_tree(self, i: int, stop: int, prefix: list[str], module: list[str], public: bool, line: int) -> None:
        """Flatten a use tree; an entry's place in `uses` is its order."""
        i += self.word(i) == "::"
        here = list(prefix)
        while i < stop:
            w = self.word(i)
            if w == "{":
                close, a = self.ends[i], i + 1
                while a < close:
                    b = self.skip_to(a, close, ",")
                    self.use_tree(a, b, here, module, public, line)
                    a = b + 1
                return
            if w == "*":
                self.uses.append({"module": list(module), "name": "*", "target": here, "glob": True, "public": public, "line": line})
                return
            if self.word(i + 1) == "::" and i + 1 < stop:
                here, i = [*here, w], i + 2
                continue
            name = self.word(i + 2) if self.word(i + 1) == "as" and i + 2 < stop else w
            self.uses.append({"module": list(module), "name": name, "target": [*here, w], "glob": False, "public": public, "line": line})
            return


def is_test(attrs: list[str]) -> bool:
    return any(re.fullmatch(r"cfg\s*\(\s*test\s*\)", a) for a in attrs)


PATHS = "array<string>"
ITEM = {
    "kind": "string", "name": "string", "module": PATHS, "public": "boolean", "attrs": PATHS, "inline": "boolean", "start_line": "bigint", "end_line": "bigint", "text": "string",
    "type_path": PATHS, "self_is_path": "boolean", "trait_path": PATHS, "trait_inputs": f"array<{PATHS}>",
}
USE = {"module": PATHS, "name": "string", "target": PATHS, "glob": "boolean", "public": "boolean", "line": "bigint"}
_paths = pa.list_(pa.string())
_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), PATHS: _paths, f"array<{PATHS}>": pa.list_(_paths)}
#: Files whose items are held at once by a task.
FILES = 500


def _lists(rows: list[list[dict]], fields: dict[str, str]) -> pa.Array:
    """Each file's rows as a list of structs, made field by field."""
    offsets = pa.array([0, *accumulate(map(len, rows))], pa.int32())
    flat = [x for own in rows for x in own]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array([x[f] for x in flat], _ARROW[t]) for f, t in fields.items()], names=list(fields)))


def _last_uses(uses: list[dict]) -> list[dict]:
    """Of entries with one name in a module the last, and every glob."""
    named = {(*u["module"], u["name"]): u for u in uses if not u["glob"]}
    return [*named.values(), *[u for u in uses if u["glob"]]]


def parse_files(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = (), items: Iterable[str] = tuple(ITEM), uses: bool = True) -> DataFrame:
    """(path, *keep, status, items, uses) of each file; status is ok or syntax. A null text is an empty file.

    A file stays in its row with the columns to keep, so nothing has to be
    joined to it again. `items` names the fields that are asked for; without
    any, or without `uses`, that column is left out. Of uses with one name in a
    module the last is given.
    """
    fields = {f: ITEM[f] for f in items}
    out = ["status", *(["items"] if fields else []), *(["uses"] if uses else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, FILES):
                batch = whole.slice(at, FILES)
                status, found, used = [], [], []
                for t in batch.column(0).to_pylist():
                    try:
                        p = Parser(t or "")
                    except (Broken, KeyError, RecursionError):
                        status.append("syntax")
                        found.append([])
                        used.append([])
                    else:
                        status.append("ok")
                        found.append(p.items)
                        used.append(_last_uses(p.uses))
                made = [pa.array(status, pa.string())]
                made += [_lists(found, fields)] if fields else []
                made += [_lists(used, USE)] if uses else []
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=["path", *keep, *out])

    source = files.select(F.col(text).alias("_text"), F.col(path).alias("path"), *keep)
    struct = lambda of: "array<struct<" + ",".join(f"{f}:{t}" for f, t in of.items()) + ">>"
    types = {"status": "string", "items": struct(fields), "uses": struct(USE)}
    return source.mapInArrow(run, ", ".join([*[f"`{c}` {t}" for c, t in source.dtypes[1:]], *[f"{c} {types[c]}" for c in out]]))


def _kept(parsed: DataFrame) -> list[str]:
    return [c for c in parsed.columns if c not in ("status", "items", "uses")]


def items_of(parsed: DataFrame) -> DataFrame:
    """(path, columns kept, ord, item's fields): later rows of a name overwrite earlier ones (`resolve.last_wins`)."""
    keep = _kept(parsed)
    return parsed.select(*keep, F.posexplode("items").alias("ord", "i")).select(*keep, "ord", "i.*").filter(~F.exists("attrs", lambda a: a.rlike(r"^cfg\s*\(\s*test\s*\)$")))


def uses_of(parsed: DataFrame) -> DataFrame:
    """(path, columns kept, module, name, target, glob, public, line): of entries with one name in a module the last, and every glob."""
    keep = _kept(parsed)
    return parsed.select(*keep, F.explode("uses").alias("u")).select(*keep, "u.*")


def _of_parent(use: Column) -> Column:
    return use["glob"] & F.array_contains(use["target"], "super")


def inherits(parsed: DataFrame) -> DataFrame:
    """Adds `inherits`: whether a module of the file imports everything of a parent."""
    return parsed.withColumn("inherits", F.exists("uses", _of_parent))


def super_glob(uses: DataFrame) -> DataFrame:
    """(path, module) of modules that import everything of a parent, and so inherit its aliases."""
    return uses.filter(F.col("glob") & F.array_contains("target", "super")).select("path", "module").distinct()


def declared_modules(parsed: DataFrame) -> DataFrame:
    """(path, columns kept, module, name, candidates, explicit) of modules in files of their own.

    An explicit `#[path]` is the one candidate, else x.rs and then x/mod.rs
    below the file's own folder and its inline modules.
    """
    found = items_of(parsed).filter("kind = 'Mod' and not inline")
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    stem = F.regexp_extract("path", r"([^/]*)\.rs$", 1)
    base = F.when(stem.isin("mod", "lib", "main"), folder).otherwise(F.concat(folder, F.lit("/"), stem))
    base = F.array_join(F.concat(F.array(base), "module"), "/")
    given = F.try_element_at(F.filter(F.transform("attrs", lambda a: F.regexp_extract(a, r'^path\s*=\s*"([^"]+)"$', 1)), lambda x: x != ""), F.lit(1))
    plain = F.array(F.concat(base, F.lit("/"), "name", F.lit(".rs")), F.concat(base, F.lit("/"), "name", F.lit("/mod.rs")))
    there = F.when(given.startswith("/"), given).otherwise(F.concat(F.when(F.size("module") > 0, base).otherwise(folder), F.lit("/"), given))
    return found.select(*_kept(parsed), "module", "name", F.when(given.isNotNull(), F.array(there)).otherwise(plain).alias("candidates"), given.isNotNull().alias("explicit"))
