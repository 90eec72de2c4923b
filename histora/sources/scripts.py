"""TypeScript and JavaScript: definitions, imports and exports, alias maps, and the files that imports mean.

A file is scanned once, in an Arrow batch. The scan blanks comments and the inside of
strings, matches brackets, and then reads the statements at the top level; so a brace
in a string or a keyword in a comment is never taken for code. What follows from the
scan, aliases, candidates, barrels, is joins.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import TO_END, directory
from ..operators.graph import _folded
from ..operators.keep import kept

SCRIPTS = r"\.(?:[cm]?[jt]s|[jt]sx)$"
#: How deep a chain of barrels is followed.
MOST_HOPS = 8
MOST_EXTENDS = 6

_OPEN, _CLOSE = "([{", ")]}"
_REGEX_BEFORE = set("(,=:[!&|?{};\n") | {"n"}  # n: after return


#: A line that goes on with the statement before it, and an end of a line that a statement can't have.
_GOES_ON = re.compile(r"\s*(?:[.?:&|+*=,)\]}]|=>|extends\b|implements\b|as\b|satisfies\b)")
_OPEN_END = re.compile(r"(?:[=,(+&|?:.]|=>)\s*$")
#: Where something may begin that is no code, the inside of strings, and where brackets and statements end.
_MARK = re.compile(r"[/'\"`{}]")
_INSIDE = {q: re.compile(rf"(?:[^{q}\\\n]++|\\(?:[\s\S]|\Z))*+") for q in "'\""}
_IN_TEMPLATE = re.compile(r"(?:[^`\\$]++|\\(?:[\s\S]|\Z)|\$(?!\{))*+")
_LINE = re.compile(r"[^\n]+")
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_BRACKET = re.compile(r"[()\[\]{}]")
_STOP = re.compile(r"[()\[\]{};\n]")
_NEXT_DECLARATOR = re.compile(r"[(\[{,]")


@dataclass
class Scan:
    """A text with comments and strings blanked, its brackets matched and its strings kept by place."""

    text: str
    bare: str = ""
    pairs: dict[int, int] = field(default_factory=dict)
    strings: dict[int, str] = field(default_factory=dict)
    lines: list[int] = field(default_factory=list)
    depths: list[tuple[int, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._blank()
        self.lines = [m.start() for m in re.finditer("\n", self.text)]
        stack: list[int] = []
        marks = [(0, 0)]
        for m in _BRACKET.finditer(self.bare):
            at = m.start()
            if self.bare[at] in _OPEN:
                stack.append(at)
                marks.append((at + 1, len(stack)))
            elif stack:
                self.pairs[stack.pop()] = at
                marks.append((at, len(stack)))
        self.depths = marks

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.lines, at) + 1

    def depth(self, at: int) -> int:
        return self.depths[bisect.bisect_right(self.depths, (at, 1 << 30)) - 1][1]

    def _blank(self) -> None:
        text, out, i, n = self.text, list(self.text), 0, len(self.text)

        def wipe(a: int, b: int) -> None:
            out[a:b] = _LINE.sub(lambda m: " " * len(m[0]), text[a:b])

        templates: list[int] = []  # depth of braces inside each open ${
        while mark := _MARK.search(text, i):
            i = mark.start()
            c = text[i]
            if c == "/" and text.startswith("//", i):
                end = text.find("\n", i)
                end = n if end < 0 else end
                wipe(i, end)
                i = end
            elif c == "/" and text.startswith("/*", i):
                end = text.find("*/", i + 2)
                end = n if end < 0 else end + 2
                wipe(i, end)
                i = end
            elif c in "'\"":
                end = _INSIDE[c].match(text, i + 1).end()
                self.strings[i] = text[i + 1 : end]
                wipe(i + 1, end)
                i = end + 1
            elif c == "`" or (c == "}" and templates and templates[-1] == 0):
                if c == "}":
                    templates.pop()
                begin = i + 1
                end = _IN_TEMPLATE.match(text, begin).end()
                if c == "`":
                    self.strings[i] = text[begin:end]
                wipe(begin, end)
                if end < n and text[end] == "$":
                    templates.append(0)
                    end += 1
                i = end + 1
            elif c == "/" and (prior := "".join(out[max(0, i - 40) : i]).rstrip(" ")) is not None and (not prior or prior[-1] in "(,=:[!&|?{};\n" or prior.endswith("return")) and (m := _REGEX.match(text, i)):
                wipe(i, m.end())
                i = m.end()
            else:
                if templates and c in "{}":
                    templates[-1] += 1 if c == "{" else -1
                i += 1
        self.bare = "".join(out)

    def literal(self, at: int) -> str | None:
        """The string that begins at a place."""
        return self.strings.get(at)

    def end_of(self, at: int) -> int:
        """End of the statement that begins at a place: a semicolon or an empty bracket level at a line's end."""
        i, n = at, len(self.bare)
        while stop := _STOP.search(self.bare, i):
            i = stop.start()
            c = self.bare[i]
            if c in _OPEN:
                i = self.pairs.get(i, n - 1) + 1
                continue
            if c == ";":
                return i
            if c in _CLOSE:
                return i - 1
            if c == "\n" and not _GOES_ON.match(self.bare, i) and not _OPEN_END.search(self.bare[max(0, i - 60) : i]):
                return i - 1
            i += 1
        return n - 1


_DECLARATION = re.compile(
    r"(?P<export>export\s+)?(?P<default>default\s+)?(?P<declare>declare\s+)?(?:abstract\s+)?(?:async\s+)?"
    r"(?P<kind>function\b\s*\*?|class\b|enum\b|const\s+enum\b|interface\b|type\b(?=\s+[\w$]+\s*[=<])|const\b|let\b|var\b)\s*(?P<name>[\w$]+)?"
)
_IMPORT = re.compile(r"import\s+(?P<type>type\s+)?(?:(?P<what>[^'\"`;]*?)\s*from\s*)?(?P<quote>['\"])")
_REEXPORT = re.compile(r"export\s+(?P<type>type\s+)?(?P<what>\*(?:\s*as\s+[\w$]+)?|\{[^}]*\})\s*from\s*(?P<quote>['\"])")
_LIST = re.compile(r"export\s+(?P<type>type\s+)?\{(?P<what>[^}]*)\}(?!\s*from)")
_DEFAULT = re.compile(r"export\s+default\s+(?!function\b|class\b|async\s+function\b|abstract\b)")
_COMMON = re.compile(r"module\.exports\s*=\s*\{([^}]*)\}")
_COMMON_ONE = re.compile(r"(?:module\.)?exports\.([\w$]+)\s*=\s*([\w$]+)\s*(?:;|$)", re.M)
_DECORATOR = re.compile(r"(?m)^[ \t]*@[\w.]+(?:\(.*\))?[ \t]*\n\s*\Z")
_CALLS = re.compile(r"\b(?P<how>import|require)\s*\(\s*(?P<quote>['\"`])")
_METHOD = re.compile(r"(?P<head>(?:@[\w.]+(?:\([^)]*\))?\s*)*)(?:(?:public|private|protected|static|readonly|override|async|get|set|abstract)\s+)*\*?(?P<name>[\w$#]+)\s*(?:<[^>(]*>)?(?P<rest>\(|=\s*(?:async\s*)?(?:\(|[\w$]+\s*=>))")
_JSX = re.compile(r"<\s*(?:[A-Z][\w.]*|[a-z][\w-]*|>)(?:[\s/>]|$)")
_WRAPPERS = tuple((w, re.compile(p)) for w, p in (("forwardRef", r"(?:React\.)?forwardRef\b"), ("memo", r"(?:React\.)?memo\b"), ("styled", r"styled[.(]"), ("hoc", r"with[A-Z]\w*\(")))
_CALLABLE = re.compile(r"(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>|<[^>]*>\s*\()")
_CALLABLE_ROUND = re.compile(r"(?:async\s*)?\(")
_IS_CLASS = re.compile(r"class\b")
_ASSIGNED = re.compile(r"\s*(?::[^=;]+?)?\s*=(?![=>])\s*")
_REQUIRED = re.compile(r"require\s*\(\s*['\"`]")
_NAME = re.compile(r"\s*([\w$]+)")
#: Where a statement may begin, and what those that count begin with.
_AFTER = re.compile(r"[;}\n]")
_HEAD = re.compile(r"[ \t]*(?=export\b|import\b|function\b|async\b|class\b|abstract\b|const\b|let\b|var\b|enum\b|interface\b|type\b|declare\b|module\.exports|exports\.)")


def _names(what: str) -> Iterator[tuple[str, str, bool]]:
    """Parts of a braced list: original name, name given to it, and whether it is a type alone."""
    for part in what.strip().strip("{}").split(","):
        m = re.match(r"\s*(type\s+)?([\w$]+)(?:\s+as\s+([\w$]+))?\s*$", part)
        if m:
            yield m[2], m[3] or m[2], bool(m[1])


def read_script(text: str, scan: Scan | None = None) -> dict[str, list[tuple]]:
    """Definitions (kind, name, start, end, parent, exported, wrapper), imports (kind, spec, name, local, line, types) and exports (name, kind, spec, original). scan: of the text, if it is at hand."""
    s = scan or Scan(text)
    defs: list[list] = []
    imports: list[tuple] = []
    exports: list[tuple] = []
    taken: set[int] = set()

    def value_kind(name: str, at: int, end: int) -> tuple[str, str]:
        """Kind and wrapper of a value."""
        value = s.bare[at : end + 1].strip()
        wrapper = next((w for w, p in _WRAPPERS if p.match(value)), "none")
        callable_ = _CALLABLE.match(value) is not None or bool("=>" in value and _CALLABLE_ROUND.match(value))
        if wrapper != "none":
            return "component", wrapper
        if _IS_CLASS.match(value):
            return "class", wrapper
        if callable_:
            return ("component" if name[:1].isupper() and _JSX.search(value) else "function"), wrapper
        return "const", wrapper

    def walk_class(name: str, at: int, end: int) -> None:
        for m in _METHOD.finditer(s.bare, at + 1, end):
            if s.depth(m.start("name")) != s.depth(at + 1) or m["name"] in {"if", "for", "while", "switch", "return", "catch", "function", "new", "super"}:
                continue
            opened = m.end() - 1
            if m["rest"].startswith("="):
                stop = s.end_of(m.end("name"))
            else:
                body = s.bare.find("{", s.pairs.get(opened, opened))
                if body < 0 or ";" in s.bare[s.pairs.get(opened, opened) : body]:
                    continue  # a signature
                stop = s.pairs.get(body, body)
            begin = m.start() + len(m[0]) - len(m[0].lstrip())
            defs.append(["method", m["name"], s.line(begin), s.line(stop), name, False, "none"])

    for m in (h for p in (0, *(a.end() for a in _AFTER.finditer(s.bare))) if (h := _HEAD.match(s.bare, p))):
        at = m.end()
        if s.depth(at) or at in taken:
            continue
        taken.add(at)
        if (i := _IMPORT.match(s.bare, at)) and (spec := s.literal(i.start("quote"))) is not None:
            line, types, what = s.line(at), bool(i["type"]), (i["what"] or "").strip()
            if not what:
                imports.append(("side_effect", spec, None, None, line, False))
            if star := re.search(r"\*\s*as\s+([\w$]+)", what):
                imports.append(("namespace", spec, "*", star[1], line, types))
            if braces := re.search(r"\{[^}]*\}", what):
                imports.extend(("named", spec, a, b, line, types or t) for a, b, t in _names(braces[0]))
            if first := re.match(r"([\w$]+)\s*(?:,|$)", what):
                imports.append(("default", spec, "default", first[1], line, types))
            continue
        if (r := _REEXPORT.match(s.bare, at)) and (spec := s.literal(r.start("quote"))) is not None:
            if r["what"].startswith("*"):
                alias = re.search(r"as\s+([\w$]+)", r["what"])
                exports.append((alias[1] if alias else "*", "namespace" if alias else "star", spec, "*"))
            else:
                exports.extend((b, "reexport", spec, a) for a, b, t in _names(r["what"]) if not (t or r["type"]))
            imports.append(("reexport", spec, None, None, s.line(at), bool(r["type"])))
            continue
        if r := _LIST.match(s.bare, at):
            exports.extend((b, "local", None, a) for a, b, t in _names(r["what"]) if not (t or r["type"]))
            continue
        if r := _COMMON.match(s.bare, at):
            for part in r[1].split(","):
                if p := re.match(r"\s*([\w$]+)(?:\s*:\s*([\w$]+))?\s*$", part):
                    exports.append((p[1], "local", None, p[2] or p[1]))
            continue
        if r := _COMMON_ONE.match(s.bare, at):
            exports.append((r[1], "local", None, r[2]))
            continue
        if r := _DEFAULT.match(s.bare, at):
            end = s.end_of(r.end())
            value = s.bare[r.end() : end + 1].strip()
            if re.fullmatch(r"[\w$]+", value):
                exports.append(("default", "local", None, value))
            else:
                inner = re.search(r"\bfunction\s+([\w$]+)", value)
                kind, wrapper = value_kind("Default", r.end(), end)
                name = inner[1] if inner else "default"
                defs.append([kind, name, s.line(at), s.line(end), None, True, wrapper])
                exports.append(("default", "local", None, name))
            continue
        d = _DECLARATION.match(s.bare, at)
        if not d or d["declare"]:
            continue
        kind, name, exported = d["kind"].split()[-1].rstrip("*"), d["name"], bool(d["export"])
        if kind in ("interface", "type"):
            continue
        if kind in ("function", "class", "enum"):
            body = s.bare.find("{", d.end())
            if kind == "function":
                round_ = s.bare.find("(", d.end())
                body = s.bare.find("{", s.pairs.get(round_, round_)) if round_ >= 0 else -1
                tail = s.bare[s.pairs.get(round_, 0) + 1 : body] if body >= 0 else ";"
                if re.search(r";|\n\s*(?:export|function)\b", tail):
                    continue  # a signature
            if body < 0:
                continue
            end = s.pairs.get(body, len(s.bare) - 1)
            name = name or "default"
            begin = at
            while before := _DECORATOR.search(s.bare, max(0, s.bare.rfind("\n", 0, max(0, s.bare.rfind("\n", 0, begin)))), begin):
                begin = before.start()
            made = "component" if kind == "function" and name[:1].isupper() and _JSX.search(s.bare, body, end) else kind
            defs.append([made, name, s.line(begin), s.line(end), None, exported, "none"])
            if kind == "class":
                walk_class(name, body, end)
            if exported:
                exports.append(("default" if d["default"] else name, "local", None, name))
            continue
        # const, let, var: a definition for each declarator
        at_name, stop = d.start("name"), s.end_of(at)
        while name:
            eq = _ASSIGNED.match(s.bare, at_name + len(name))
            if not eq:
                break
            cut = eq.end()
            while cut <= stop:
                near = _NEXT_DECLARATOR.search(s.bare, cut, stop + 1)
                cut = near.start() if near else stop + 1
                if not near or s.bare[cut] == ",":
                    break
                cut = s.pairs.get(cut, cut) + 1
            end = min(cut - 1, stop)
            required = _REQUIRED.match(s.bare, eq.end())
            if not required:
                one, wrapper = value_kind(name, eq.end(), end)
                first = at if at_name == d.start("name") else at_name
                defs.append([one, name, s.line(first), s.line(end), None, exported, wrapper])
                if exported:
                    exports.append((name, "local", None, name))
                if one == "class" and (body := s.bare.find("{", eq.end())) >= 0:
                    walk_class(name, body, s.pairs.get(body, end))
            more = _NAME.match(s.bare, cut + 1) if cut < stop and s.bare[cut] == "," else None
            at_name, name = (more.start(1), more[1]) if more else (0, None)
    for c in _CALLS.finditer(s.bare):
        spec = s.literal(c.start("quote"))
        if spec is not None and "${" not in spec:
            imports.append(("dynamic" if c["how"] == "import" else "require", spec, None, None, s.line(c.start()), False))
    marked = {original for _, kind, _, original in exports if kind == "local"}
    for row in defs:
        row[5] = row[5] or (row[4] is None and row[1] in marked)
    return {"defs": [tuple(r) for r in defs], "imports": imports, "exports": exports}


SCANNED = (
    "path string, defs array<struct<kind:string,name:string,start:int,end:int,parent:string,exported:boolean,wrapper:string>>, "
    "imports array<struct<kind:string,spec:string,name:string,local:string,line:int,types:boolean>>, exports array<struct<name:string,kind:string,spec:string,original:string>>"
)


def scan_scripts(files: DataFrame) -> DataFrame:
    """path with arrays of definitions, imports and exports, for the script files of files (path, text). Declarations alone (.d.ts) are left out."""

    schema = to_arrow_schema(T.StructType.fromDDL(SCANNED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_script(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path").cast(schema.field("path").type), *(pa.array([f[k.name] for f in found], k.type) for k in list(schema)[1:])], schema=schema)

    return files.where(F.col("path").rlike(SCRIPTS) & ~F.col("path").rlike(r"\.d\.[cm]?ts$")).select("path", "text").mapInArrow(run, SCANNED)


def definitions(scanned: DataFrame) -> DataFrame:
    return scanned.select("path", F.explode("defs").alias("x")).select("path", "x.*")


def imports(scanned: DataFrame) -> DataFrame:
    return scanned.select("path", F.explode("imports").alias("x")).select("path", "x.*")


def exports(scanned: DataFrame) -> DataFrame:
    return scanned.select("path", F.explode("exports").alias("x")).select("path", "x.*")


# -- alias maps --------------------------------------------------------------------


_STRING = re.compile(r'"(?:\\.|[^"\\])*"')
_BEFORE_END = re.compile(r"(?:\s|//[^\n]*\n|/\*(?s:.*?)\*/)*[}\]]")
_PLAIN = re.compile(r'(?s:.)[^",/]*')


def read_jsonc(text: str | None) -> dict:
    """JSON with comments and trailing commas; anything else is an empty object."""
    text = text or ""
    try:  # most are plain JSON, which the walk would leave as it is
        value = json.loads(text)
        return value if isinstance(value, dict) else {}
    except ValueError:
        pass
    out, i = [], 0
    while i < len(text):
        if text[i] == '"':
            m = _STRING.match(text, i)
            if not m:
                return {}
            out.append(m[0])
            i = m.end()
        elif text.startswith("//", i):
            i = (text.find("\n", i) + 1 or len(text) + 1) - 1
        elif text.startswith("/*", i):
            end = text.find("*/", i)
            i = end + 2 if end >= 0 else len(text)
        elif text[i] == "," and _BEFORE_END.match(text, i + 1):
            i += 1
        else:
            m = _PLAIN.match(text, i)
            out.append(m[0])
            i = m.end()
    try:
        value = json.loads("".join(out))
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


#: The package that a specifier names.
PACKAGE_NAME = r"^(@[^/]+/[^/]+|[^/@][^/]*)"
_CONFIG = "path string, extends array<string>, base string, has_paths boolean, paths array<struct<pattern:string,target:string,nth:int>>"


def _configs(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.path, batch.text, strict=True):
                config = read_jsonc(text)
                options = config.get("compilerOptions") if isinstance(config.get("compilerOptions"), dict) else {}
                more = config.get("extends") or []
                paths = options.get("paths") if isinstance(options.get("paths"), dict) else {}
                flat = [{"pattern": p, "target": t, "nth": n} for p, ts in paths.items() if isinstance(ts, list) for n, t in enumerate(ts) if isinstance(t, str)]
                rows.append((path, [more] if isinstance(more, str) else [x for x in more if isinstance(x, str)], options.get("baseUrl"), bool(paths), flat))
            yield pd.DataFrame(rows, columns=["path", "extends", "base", "has_paths", "paths"])

    config = files.where(F.element_at(F.split("path", "/"), -1).rlike(r"^(?:tsconfig|jsconfig).*\.json$|^base\.json$") | F.col("path").rlike(r"tsconfig/[^/]+\.json$"))
    return config.select("path", "text").mapInPandas(run, _CONFIG)


def alias_map(files: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """Aliases of every tsconfig.json and jsconfig.json: workspace, prefix, target, exact, nth.

    A chain of ``extends`` is followed, at most MOST_EXTENDS long; of configurations that map one
    pattern, the nearest to the leaf holds. Targets are relative to the base url of the
    configuration that states them, else to its directory. ``packages`` (name, dir) find configurations that are
    extended by a package's name. files: path, text.
    """
    configs = kept(_configs(files))
    named = kept(packages) if packages is not None else files.sparkSession.createDataFrame([], "name string, dir string")
    leaves = configs.where(F.element_at(F.split("path", "/"), -1).isin("tsconfig.json", "jsconfig.json"))
    frontier = leaves.select(F.col("path").alias("leaf"), "path", F.lit(0).alias("depth"))
    chain = frontier
    for k in range(1, MOST_EXTENDS + 1):
        at = frontier.join(configs, "path").select("leaf", "path", F.explode("extends").alias("to"))
        near = at.where(F.startswith("to", F.lit("."))).select("leaf", _folded(F.concat_ws("/", F.nullif(directory("path"), F.lit("")), "to")).alias("to"))
        by_name = at.where(~F.startswith("to", F.lit("."))).withColumn("name", F.regexp_extract("to", PACKAGE_NAME, 1)).join(named, "name")
        far = by_name.select("leaf", F.concat("dir", F.coalesce(F.nullif(F.substring(F.col("to"), F.length("name") + 1, F.lit(TO_END)), F.lit("")), F.lit("/tsconfig.json"))).alias("to"))
        tried = near.unionByName(far).select("leaf", F.explode(F.array("to", F.concat("to", F.lit(".json")), F.concat("to", F.lit("/tsconfig.json")))).alias("path"))
        frontier = tried.join(configs.select("path"), "path", "left_semi").join(chain.select("leaf", "path"), ["leaf", "path"], "left_anti").distinct().select("leaf", "path", F.lit(k).alias("depth"))
        frontier = kept(frontier)
        if frontier.isEmpty():
            break
        chain = chain.unionAll(frontier)
    each = chain.join(configs, "path").withColumn("home", directory("path"))
    stated = each.select("leaf", "depth", "path", _folded(F.concat_ws("/", F.nullif("home", F.lit("")), F.coalesce("base", F.lit(".")))).alias("base"), F.explode("paths").alias("x"))
    best = stated.groupBy("leaf", "x.pattern").agg(F.min(F.struct("depth", "path")).alias("of"))
    held = stated.select("leaf", "depth", "path", "base", "x.*").join(best.select("leaf", "pattern", "of.*"), ["leaf", "pattern", "depth", "path"])
    star = F.endswith("pattern", F.lit("*"))
    target = _folded(F.concat_ws("/", F.nullif("base", F.lit("")), F.regexp_replace("target", r"\*$", "")))
    rows = held.select(
        directory("leaf").alias("workspace"),
        F.regexp_replace("pattern", r"\*$", "").alias("prefix"),
        F.when(star & F.endswith("target", F.lit("/*")) & (target != ""), F.concat(target, F.lit("/"))).otherwise(target).alias("target"),
        (~star).alias("exact"),
        "nth",
    )
    # an explicit base url maps bare specifiers, after all patterns
    based = each.where("base is not null").groupBy("leaf").agg(F.min_by(F.struct("home", "base"), "depth").alias("x"))
    root = _folded(F.concat_ws("/", F.nullif("x.home", F.lit("")), "x.base"))
    return rows.unionByName(based.select(directory("leaf").alias("workspace"), F.lit("").alias("prefix"), F.when(root != "", F.concat(root, F.lit("/"))).otherwise("").alias("target"), F.lit(False).alias("exact"), F.lit(0).alias("nth"))).distinct()


# -- resolution --------------------------------------------------------------------

_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
_SWAPPED = ("ts", "tsx")


def _meant(paths: DataFrame) -> DataFrame:
    """The stems that may mean each file, and its place in each one's order: stem, nth, path; ``_means`` gives the file by the first two. A .js may stand for a .ts.

    A file is meant by a few stems, while a stem may mean fifteen files: so files are told their stems, not stems exploded to files.
    """
    whole = [F.when(F.endswith("path", F.lit(e)), F.struct(F.substring(F.col("path"), F.lit(1), F.length("path") - len(e)).alias("stem"), F.lit(n).alias("nth"))) for n, e in enumerate(_ENDINGS)]
    swapped = []
    for n, e in enumerate(_SWAPPED, len(_ENDINGS)):
        ends = rf"\.([cm]?){e}$"
        swapped += [F.when(F.col("path").rlike(ends), F.struct(F.regexp_replace("path", ends, f".$1{j}").alias("stem"), F.lit(n).alias("nth"))) for j in ("js", "jsx")]
    return paths.select("path", F.explode(F.filter(F.array(*whole, *swapped), lambda x: x.isNotNull())).alias("x")).select("x.stem", "x.nth", "path")


def _means(stem: str, nth: str) -> Column:
    """The file that a stem means in its nth place."""
    out = F.concat(stem, F.element_at(F.array(*map(F.lit, _ENDINGS)), F.least(F.col(nth), F.lit(len(_ENDINGS) - 1)) + 1))
    for n, e in enumerate(_SWAPPED, len(_ENDINGS)):
        out = F.when(F.col(nth) == n, F.regexp_replace(stem, r"\.([cm]?)jsx?$", f".$1{e}")).otherwise(out)
    return out


def package_targets(manifests: DataFrame) -> DataFrame:
    """What each subpath of a workspace's package may mean: name, dir, sub, nth, stem. manifests: path, text; ``exports``, ``source``, ``module`` and ``main`` in this order, then index and src/index."""

    def leaves(value) -> Iterator[str]:
        if isinstance(value, str):
            yield value
        elif isinstance(value, dict):
            for key in sorted(value, key=lambda k: ("source", "development", "import", "module", "default", "require", "node", "types").index(k) if k in ("source", "development", "import", "module", "default", "require", "node", "types") else 99):
                if key != "types":
                    yield from leaves(value[key])
        elif isinstance(value, list):
            for v in value:
                yield from leaves(v)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.path, batch.text, strict=True):
                m = read_jsonc(text)
                if not isinstance(m.get("name"), str):
                    continue
                home, exported = path.rpartition("/")[0], m.get("exports")
                subs = exported if isinstance(exported, dict) and any(k.startswith(".") for k in exported) else {".": exported} if exported else {}
                for sub, value in subs.items():
                    rows += [(m["name"], home, sub, n, v) for n, v in enumerate(leaves(value))]
                mains = [m[k] for k in ("source", "module", "main") if isinstance(m.get(k), str)]
                rows += [(m["name"], home, ".", 100 + n, v) for n, v in enumerate([*mains, "./index", "./src/index"])]
                rows += [(m["name"], home, "./*", 200, "./*"), (m["name"], home, "./*", 201, "./src/*")]
            yield pd.DataFrame(rows, columns=["name", "dir", "sub", "nth", "stem"])

    found = manifests.where(F.endswith("path", F.lit("package.json"))).select("path", "text").mapInPandas(run, "name string, dir string, sub string, nth int, stem string")
    return found.withColumn("stem", _folded(F.concat_ws("/", F.nullif("dir", F.lit("")), "stem")))


def resolve(specs: DataFrame, files: DataFrame, aliases: DataFrame, targets: DataFrame) -> DataFrame:
    """importer, spec, target and how: relative, alias, workspace, external or unresolved.

    specs: importer, spec; files: path; aliases as of alias_map; targets as of package_targets. A relative
    specifier is taken from the importer's directory; an alias only if its workspace
    encloses the importer, the nearest one first, then the longest prefix; then a workspace's package.
    """
    base = directory("importer")
    # read by each way to resolve, so the texts are scanned once; numbered, so that tries carry a number and not both texts
    specs = kept(specs.distinct().withColumn("id", F.monotonically_increasing_id()))
    relative = specs.where(F.col("spec").rlike(r"^\.")).select("id", F.lit(0).alias("o"), F.array(F.lit(0)).alias("rank"), _folded(F.concat_ws("/", F.nullif(base, F.lit("")), "spec")).alias("stem"))
    bare = specs.where(~F.col("spec").rlike(r"^[./]"))
    # an alias meets specifiers by its first segment, as far as it has a whole one, and workspaces by an ancestor of the importer
    parents = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(F.split("importer", "/")) - 1)), lambda i: F.array_join(F.slice(F.split("importer", "/"), F.lit(1), i), "/")))
    placed = bare.select("id", "spec", F.explode(F.array_distinct(parents)).alias("workspace"))
    fits = placed.join(aliases, "workspace").where(F.when(F.col("exact"), F.col("spec") == F.col("prefix")).otherwise(F.startswith("spec", "prefix")))
    by_alias = fits.select("id", F.lit(1).alias("o"), F.array(-F.length("workspace"), -F.length("prefix"), "nth").alias("rank"), F.concat("target", F.substring(F.col("spec"), F.length("prefix") + 1, F.lit(TO_END))).alias("stem"))
    name = F.regexp_extract("spec", PACKAGE_NAME, 1)
    sub = F.concat(F.lit("."), F.substring(F.col("spec"), F.length(name) + 1, F.lit(TO_END)))
    owned = bare.select("id", name.alias("name"), sub.alias("asked")).join(targets, "name")
    star = F.regexp_replace("sub", r"\*.*$", "")
    inner = F.substring(F.col("asked"), F.length(star) + 1, F.lit(TO_END))
    hit = owned.where((F.col("sub") == F.col("asked")) | (F.contains("sub", F.lit("*")) & F.startswith("asked", star) & (F.col("asked") != ".")))
    stem = F.when(F.contains("sub", F.lit("*")), F.replace("stem", F.lit("*"), inner)).otherwise(F.col("stem"))
    by_package = hit.select("id", F.lit(2).alias("o"), F.array((F.col("sub") != F.col("asked")).cast("int"), "nth", F.lit(0)).alias("rank"), stem.alias("stem"))

    tried = relative.unionByName(by_alias).unionByName(by_package)
    # of the files that a stem may mean the first in order is taken, whatever meets it; the file follows from stem and place
    first = _meant(files).groupBy("stem").agg(F.min("nth").alias("nth"))
    found = tried.join(first, "stem").select("id", F.struct("o", "rank", "nth", "stem").alias("x"), F.lit(False).alias("known"))
    known = bare.select("id", name.alias("_name")).join(targets.select(F.col("name").alias("_name")).distinct(), "_name").select("id", F.lit(None).cast(found.schema["x"].dataType).alias("x"), F.lit(True).alias("known"))
    best = found.unionAll(known).groupBy("id").agg(F.min("x").alias("x"), F.bool_or("known").alias("known"))
    each = specs.join(best, "id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    external = F.col("spec").rlike(r"^(?:@[a-z0-9][\w.-]*/[\w.-]+|[a-z][\w.-]*|node:\w+)(?:/.*)?$") & ~F.col("known")
    ways = F.element_at(F.array(F.lit("relative"), F.lit("alias"), F.lit("workspace")), F.col("x.o") + 1)
    how = F.when(F.col("x").isNotNull(), ways).when(external, "external").otherwise("unresolved")
    return each.select("importer", "spec", _means("x.stem", "x.nth").alias("target"), how.alias("how"))


def chase(wanted: DataFrame, exported: DataFrame, resolved: DataFrame, hops: int = MOST_HOPS) -> DataFrame:
    """The file that defines each name asked of a file, through at most ``hops`` barrels: first, name, target, original and via, the barrels passed.

    wanted: first (the file that is asked), name; exported: path, name, kind, spec, original; resolved:
    importer, spec, target. A name that a barrel takes from outside the tree ends there; one that nobody defines stays with the first file.
    Where a name leads doesn't depend on who asks, so each is followed once.
    """
    # what each hop joins is made once: for a file's name what defines it, whether it is passed on, and to where, if that is known
    passing = F.col("kind").isin("reexport", "namespace")
    onward = kept(exported.where("spec is not null").join(resolved.where("target is not null").select(F.col("importer").alias("path"), "spec", F.col("target").alias("to")), ["path", "spec"]).select("path", "name", "kind", "to", "original"))
    to = F.struct("to", "original")
    told = exported.where((F.col("kind") == "local") | passing).select("path", "name", F.when(~passing, F.col("original")).alias("found"), passing.alias("out"), F.lit(None).cast("struct<to:string,original:string>").alias("to"))
    told = told.unionAll(onward.where(passing).select("path", "name", F.lit(None).cast("string"), F.lit(True), to))
    names = kept(told.groupBy(F.col("path").alias("file"), F.col("name").alias("seek")).agg(F.min("found").alias("found"), F.bool_or("out").alias("out"), F.collect_set("to").alias("to")))
    # names that a file passes on from outside the tree: the trail ends there
    names = names.select("file", "seek", "found", F.when(F.col("out") & (F.size("to") == 0), True).alias("ends"), "to")
    stars = onward.where("kind = 'star'").select(F.col("path").alias("file"), "to").distinct()
    key = ["first", "name"]
    frontier = wanted.select(*key).distinct().select(*key, F.col("first").alias("file"), F.col("name").alias("seek"), F.array().cast("array<string>").alias("via"))
    trail = None
    for hop in range(hops + 1):
        state = kept(frontier.join(names, ["file", "seek"], "left").withColumn("hop", F.lit(hop)))
        if trail is not None and state.isEmpty():
            break
        # beyond the first file only ends count: a trail that is lost is no better than none
        trail = state.drop("to") if trail is None else trail.unionByName(state.drop("to").where("found is not null or ends is not null"))
        open_ = state.where("found is null and ends is null")
        passed = F.concat("via", F.array("file")).alias("via")
        named = open_.select(*key, "seek", passed, F.explode("to").alias("x")).select(*key, F.col("x.to").alias("file"), F.when(F.col("x.original") == "*", F.col("seek")).otherwise(F.col("x.original")).alias("seek"), "via")
        unnamed = open_.where((F.coalesce(F.size("to"), F.lit(0)) <= 0) & (F.col("seek") != "default")).drop("to").join(stars, "file").select(*key, F.col("to").alias("file"), "seek", passed)
        frontier = named.unionByName(unnamed).where(~F.array_contains("via", F.col("file"))).distinct()
    # a definition before an end outside the tree, then the shortest trail and its name; without either the first file
    rank = F.struct(F.col("found").isNull().alias("none"), F.col("ends").isNull().alias("lost"), F.col("hop"), F.concat_ws("|", "via", "file").alias("way"))
    best = trail.groupBy(*key).agg(F.min_by(F.struct("file", "found", "seek", "via"), rank).alias("x"))
    return best.select(*key, F.col("x.file").alias("target"), F.coalesce("x.found", "x.seek").alias("original"), F.col("x.via").alias("via"))


def symbol_edges(files: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """Imports from symbol to file: importer, name, local, target, original, via and how, of scripts in files (path, text), types left out. scanned: their scan, if it is at hand."""
    scanned = kept(scan_scripts(files)) if scanned is None else scanned
    every = imports(scanned).where("not types")
    packages = kept(package_targets(files))
    aliases = alias_map(files, packages.select("name", "dir").distinct())
    resolved = kept(resolve(every.select(F.col("path").alias("importer"), "spec"), files, aliases, packages))
    asked = every.where("kind in ('named', 'default')").select(F.col("path").alias("importer"), "spec", "name", "local")
    names = kept(asked.join(resolved.where("target is not null"), ["importer", "spec"]))
    asked = names.withColumnRenamed("target", "first")
    return asked.join(chase(asked, exports(scanned), resolved), ["first", "name"]).drop("first")


def script_edges(files: DataFrame) -> DataFrame:
    """File edges of scripts: importer, target, over all kinds of import, barrels not followed."""
    every = imports(scan_scripts(files)).where("not types").select(F.col("path").alias("importer"), "spec").distinct()
    packages = kept(package_targets(files))
    found = resolve(every, files, alias_map(files, packages.select("name", "dir").distinct()), packages)
    return found.where("target is not null and target <> importer").select("importer", "target").distinct()
