"""Imports of Go, Rust and Python files, late imports, and registries that dispatch by a key."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TO_END, directory, is_test_path
from .scripts import SCRIPTS, Scan, read_script, resolve

# -- Go ----------------------------------------------------------------------------


def go_imports(files: DataFrame) -> DataFrame:
    """importer and module of the imports of Go files, single and grouped. files: path, text."""
    text = F.regexp_replace("text", r"(?m)//[^\n]*$", "")
    groups = F.array_join(F.regexp_extract_all(text, F.lit(r"(?s)\bimport\s*\(([^)]*)\)"), F.lit(1)), "\n")
    quoted = F.regexp_extract_all(groups, F.lit(r'"([^"]+)"'), F.lit(1))
    single = F.regexp_extract_all(text, F.lit(r'(?m)^\s*import\s+(?:[\w.]+\s+)?"([^"]+)"'), F.lit(1))
    return files.where(F.endswith("path", F.lit(".go"))).select(F.col("path").alias("importer"), F.explode(F.array_distinct(F.concat(quoted, single))).alias("module"))


def go_modules(files: DataFrame) -> DataFrame:
    """dir and name of the modules that go.mod files declare."""
    return files.where(F.element_at(F.split("path", "/"), -1) == "go.mod").select(directory("path").alias("dir"), F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1).alias("name")).where("name <> ''")


def go_edges(files: DataFrame) -> DataFrame:
    """importer, target: the first file of the package that an import of the own module means; tests stand for no package.

    An import meets its module by the importer's directories, and the package by each
    directory above a file.
    """
    parents = F.transform(F.sequence(F.lit(0), F.size(F.split("importer", "/")) - 1), lambda i: F.array_join(F.slice(F.split("importer", "/"), F.lit(1), i), "/"))
    placed = go_imports(files).select("importer", "module", F.explode(parents).alias("dir")).join(go_modules(files), "dir")
    inner = placed.where((F.col("module") == F.col("name")) | F.startswith("module", F.concat("name", F.lit("/"))))
    sub = F.regexp_replace(F.substring(F.col("module"), F.length("name") + 1, F.lit(TO_END)), "^/+", "")
    asked = inner.withColumn("sub", sub).where("sub <> ''").select("importer", F.concat_ws("/", F.nullif("dir", F.lit("")), "sub").alias("package"))
    sources = files.where(F.endswith("path", F.lit(".go")) & ~F.endswith("path", F.lit("_test.go"))).select("path")
    n = F.size(F.split("path", "/"))
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))
    packages = sources.where(n > 1).select("path", F.explode(above).alias("package")).groupBy("package").agg(F.min("path").alias("target"))
    return asked.join(packages, "package").select("importer", "target").where("importer <> target").distinct()


# -- Rust --------------------------------------------------------------------------


def rust_uses(files: DataFrame) -> DataFrame:
    """importer, kind (use or mod) and name of the crate's own items that a file takes; braces are spread out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.path, batch.text, strict=True):
                bare = re.sub(r"//[^\n]*|/\*.*?\*/", "", text or "", flags=re.S)
                for m in re.finditer(r"\buse\s+crate::([^;]+);", bare):
                    rows += [(path, "use", x) for x in _spread(re.sub(r"\s+as\s+\w+|\s+", "", m[1]))]
                rows += [(path, "mod", m[1]) for m in re.finditer(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;", bare)]
            yield pd.DataFrame(rows, columns=["importer", "kind", "name"])

    return files.where(F.endswith("path", F.lit(".rs"))).select("path", "text").mapInPandas(run, "importer string, kind string, name string").distinct()


def _spread(path: str) -> list[str]:
    """The paths of a use: a::{b, c::{d}} is a::b and a::c::d."""
    at = path.find("{")
    if at < 0:
        return [path.removesuffix("::*").removesuffix("::self")]
    out, depth, start = [], 0, at + 1
    for i in range(at, len(path)):
        depth += (path[i] == "{") - (path[i] == "}")
        if (path[i] == "," and depth == 1) or (path[i] == "}" and depth == 0):
            if path[start:i]:
                out += [path[:at] + x if x != "self" else path[:at].removesuffix("::") for x in _spread(path[start:i])]
            start = i + 1
    return out


def rust_edges(files: DataFrame) -> DataFrame:
    """importer, target. A use is a module's file with its last item or without, below the importer's src, else the root's; a mod is a file beside the importer."""
    parts = F.split("importer", "/")
    src = F.array_join(F.slice(parts, F.lit(1), F.array_position(parts, "src").cast("int")), "/")
    steps = F.split("name", "::")
    stems = F.array(F.array_join(steps, "/"), F.array_join(F.slice(steps, F.lit(1), F.greatest(F.lit(1), F.size(steps) - 1)), "/"))
    roots = F.when(F.array_contains(parts, "src"), F.array(src, F.lit("src"))).otherwise(F.array(F.lit("src")))
    by_use = F.flatten(F.transform(stems, lambda s: F.flatten(F.transform(roots, lambda r: F.array(F.concat(r, F.lit("/"), s, F.lit(".rs")), F.concat(r, F.lit("/"), s, F.lit("/mod.rs")))))))
    home = directory("importer")
    # a module file's own modules are in the directory of its name, unless it is mod.rs, lib.rs or main.rs
    leaf = F.regexp_replace(F.element_at(parts, -1), r"\.rs$", "")
    inner = F.when(leaf.isin("mod", "lib", "main"), home).otherwise(F.concat_ws("/", F.nullif(home, F.lit("")), leaf))
    beside = F.flatten(F.transform(F.array(home, inner), lambda d: F.transform(F.array(F.lit(".rs"), F.lit("/mod.rs")), lambda e: F.concat(F.concat_ws("/", F.nullif(d, F.lit("")), F.col("name")), e))))
    tried = rust_uses(files).select("importer", "kind", "name", F.posexplode(F.when(F.col("kind") == "use", by_use).otherwise(beside)).alias("nth", "path"))
    found = tried.join(files.select("path"), "path").groupBy("importer", "kind", "name").agg(F.min_by("path", "nth").alias("target"))
    return found.select("importer", "target").where("importer <> target").distinct()


# -- late imports and dispatch -----------------------------------------------------


def _late_python(path: str, text: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError):
        return

    def type_only(test: ast.expr) -> bool:
        return any(isinstance(n, (ast.Name, ast.Attribute)) and (getattr(n, "id", None) or getattr(n, "attr", None)) == "TYPE_CHECKING" for n in ast.walk(test))

    def walk(node: ast.AST, inside: bool, optional: bool) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            deeper = inside or isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef))
            if isinstance(child, ast.If) and type_only(child.test):
                for other in child.orelse:
                    yield from walk(ast.Module([other], []), inside, optional)
                continue
            if isinstance(child, ast.Try):
                caught = {getattr(n, "id", getattr(n, "attr", "")) for h in child.handlers if h.type for n in ast.walk(h.type)}
                yield from walk(ast.Module(child.body, []), inside, optional or bool(caught & {"ImportError", "ModuleNotFoundError"}))
                yield from walk(ast.Module([*child.handlers, *child.orelse, *child.finalbody], []), inside, optional)
                continue
            if inside and isinstance(child, ast.ImportFrom):
                for a in child.names:
                    yield path, "." * child.level + (child.module or ""), a.name, child.lineno, optional
            elif inside and isinstance(child, ast.Import):
                for a in child.names:
                    yield path, a.name, None, child.lineno, optional
            else:
                yield from walk(child, deeper, optional)

    yield from walk(tree, False, False)


def late_imports(files: DataFrame) -> DataFrame:
    """Imports below the top level: importer, spec, name, line, optional. Python's by its syntax tree, without those for types; scripts' dynamic imports and inner requires, of literals alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch.path, batch.text, strict=True):
                if path.endswith(".py"):
                    rows += _late_python(path, text)
                else:
                    scan = Scan(text or "")
                    for m in re.finditer(r"\b(import|require)\s*\(\s*(['\"`])", scan.bare):
                        spec = scan.literal(m.start(2))
                        if spec and "${" not in spec and (m[1] == "import" or scan.depth(m.start())):
                            rows.append((path, spec, None, scan.line(m.start()), False))
            yield pd.DataFrame(rows, columns=["importer", "spec", "name", "line", "optional"])

    return files.where(F.endswith("path", F.lit(".py")) | F.col("path").rlike(SCRIPTS)).select("path", "text").mapInPandas(run, "importer string, spec string, name string, line int, optional boolean")


def _python_targets(specs: DataFrame, files: DataFrame) -> DataFrame:
    """importer, spec, name, target of Python modules: dotted names match the end of a path, the shortest path first, as source roots aren't known."""
    level = F.length(F.regexp_extract("spec", r"^(\.*)", 1))
    base = F.split(directory("importer"), "/")
    up = F.when(level > 0, F.array_join(F.slice(base, F.lit(1), F.greatest(F.lit(0), F.size(base) - (level - 1))), "/")).otherwise("")
    stem = F.concat_ws("/", F.nullif(up, F.lit("")), F.nullif(F.replace(F.regexp_replace("spec", r"^\.+", ""), F.lit("."), F.lit("/")), F.lit("")))
    tried = specs.select("importer", "spec", "name", F.posexplode(F.array_compact(F.array(F.concat_ws("/", stem, "name"), stem))).alias("nth", "stem"))
    names = files.where(F.endswith("path", F.lit(".py"))).select("path", F.regexp_replace("path", r"(?:/__init__)?\.py$", "").alias("module"))
    parts = F.split("module", "/")
    ends = names.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("stem"))
    rank = F.struct("nth", F.length("path"), "path")
    return tried.join(ends, "stem").groupBy("importer", "spec", "name").agg(F.min_by("path", rank).alias("target"))


def late_edges(files: DataFrame) -> DataFrame:
    """importer, target, line, optional of late imports that mean a file of the tree."""
    late = late_imports(files).checkpoint()  # read by each way to resolve, so the texts are scanned once
    python = late.where(F.endswith("importer", F.lit(".py")))
    found = _python_targets(python.select("importer", "spec", "name").distinct(), files).withColumnsRenamed({"importer": "_i", "spec": "_s", "name": "_n"})
    python = python.join(found, (F.col("importer") == F.col("_i")) & (F.col("spec") == F.col("_s")) & F.col("name").eqNullSafe(F.col("_n")))
    scripts = late.where(~F.endswith("importer", F.lit(".py")))
    spark = files.sparkSession
    none = spark.createDataFrame([], "workspace string, prefix string, target string, exact boolean, nth int")
    no_packages = spark.createDataFrame([], "name string, dir string, sub string, nth int, stem string")
    resolved = resolve(scripts.select("importer", "spec"), files.select("path"), none, no_packages).where("target is not null")
    scripts = scripts.join(resolved.select("importer", "spec", "target"), ["importer", "spec"])
    cols = ["importer", "target", "line", "optional"]
    return python.select(*cols).unionByName(scripts.select(*cols)).where("importer <> target").distinct()


_ARM = "path string, symbol string, at int, arm int, line int, fact string, part int, nth int, name string, spec string, original string"


class _Arms(ast.NodeVisitor):
    """What the arms of a file's conditions say: texts that are compared, names that are imported, names that are returned."""

    def __init__(self, path: str) -> None:
        self.path, self.within, self.rows, self.arms = path, [], [], 0

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:  # noqa: N802
        self.within.append((node.name, node.lineno))
        self.generic_visit(node)
        self.within.pop()

    visit_AsyncFunctionDef = visit_FunctionDef  # noqa: N815

    def visit_If(self, node: ast.If) -> None:  # noqa: N802
        said: list[tuple] = [("key", 0, k, c.value, None, None) for k, c in enumerate(ast.walk(node.test)) if isinstance(c, ast.Constant) and isinstance(c.value, str)]
        for part, statement in enumerate(node.body):
            match statement:
                case ast.ImportFrom(module=module, names=names, level=level):
                    said += [("import", part, k, a.asname or a.name, "." * level + (module or ""), a.name) for k, a in enumerate(names)]
                case ast.Return(value=ast.expr() as value):
                    said += [("return", part, k, n.id, None, None) for k, n in enumerate(ast.walk(value)) if isinstance(n, ast.Name)]
        self.arms += 1
        self.rows += [(self.path, *function, self.arms, node.lineno, *row) for function in self.within for row in said]
        self.generic_visit(node)


def _python_arms(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.path, batch.text, strict=True):
                seen = _Arms(path)
                try:
                    seen.visit(ast.parse(text or ""))
                except (SyntaxError, ValueError, RecursionError):
                    continue
                rows += seen.rows
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ARM.split(", ")])

    return files.select("path", "text").mapInPandas(run, _ARM)


def _python_registries(files: DataFrame) -> DataFrame:
    """Arms that return what they import, of functions with two of them or more, by joining what their arms say."""
    arms = _python_arms(files).checkpoint()  # read for each fact, so the texts are parsed once
    arm = ["path", "symbol", "at", "arm"]
    of = lambda fact: arms.where(F.col("fact") == fact)
    keys = of("key").groupBy(*arm).agg(F.min_by("name", "nth").alias("key"))
    imports = of("import").groupBy(*arm, "name").agg(F.max_by(F.struct("spec", "original"), F.struct("part", "nth")).alias("x"))
    given = of("return").join(imports, [*arm, "name"]).groupBy(*arm, "line", "part").agg(F.min_by("x", "nth").alias("x"))
    several = given.groupBy("path", "symbol", "at").agg(F.count("*").alias("n")).where("n >= 2").select("path", "symbol", "at")
    return given.join(several, ["path", "symbol", "at"]).join(keys, arm, "left").select("path", "symbol", "key", "x.spec", F.col("x.original").alias("name"), "line")


def _dispatch_script(path: str, text: str) -> Iterator[tuple]:
    scan = Scan(text or "")
    names = {local: (spec, name) for kind, spec, name, local, _, _ in read_script(text or "")["imports"] if kind in ("named", "default") and local}
    arms = []
    for m in re.finditer(r"\bcase\s+(['\"`])", scan.bare):
        key = scan.literal(m.start(1))
        stop = re.compile(r"\bcase\b|\bdefault\s*:|\}").search(scan.bare, m.end())
        back = re.compile(r"\breturn\s+(?:new\s+|await\s+)?([\w$]+)").search(scan.bare, m.end(), stop.start() if stop else len(scan.bare))
        if back and back[1] in names:
            arms.append((path, None, key, *names[back[1]], scan.line(m.start())))
    if len(arms) >= 2:
        yield from arms
    entries = []
    for m in re.finditer(r"(?:^|[{,]\s*)\s*(?:(['\"`])[^'\"`]*['\"`]|([\w$]+))\s*:\s*(?:async\s*)?(?:\(\s*\)\s*=>\s*)?import\s*\(\s*(['\"`])", scan.bare, re.M):
        key = m[2] or scan.literal(m.start(1))
        entries.append((path, None, key, scan.literal(m.start(3)), None, scan.line(m.start(3))))
    if len(entries) >= 2:
        yield from entries


def dispatch_registries(files: DataFrame) -> DataFrame:
    """Targets that a registry names by key: path, symbol, key, spec, name, line.

    A registry has two branches or more, each with its own import that it returns (Python),
    two cases that return what is imported, or two keys whose values import a literal (scripts).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, t in zip(batch.path, batch.text, strict=True) for r in _dispatch_script(p, t)]
            yield pd.DataFrame(rows, columns=["path", "symbol", "key", "spec", "name", "line"])

    sources = files.where(~is_test_path("path"))
    scripts = sources.where(F.col("path").rlike(SCRIPTS)).select("path", "text").mapInPandas(run, "path string, symbol string, key string, spec string, name string, line int")
    return _python_registries(sources.where(F.endswith("path", F.lit(".py")))).unionByName(scripts)


def dispatch_targets(files: DataFrame) -> DataFrame:
    """registry, key, target, symbol: the file that each key of a registry means."""
    found = dispatch_registries(files).withColumnRenamed("path", "importer").checkpoint()  # read by each way to resolve
    python = found.where(F.endswith("importer", F.lit(".py")))
    p = _python_targets(python.select("importer", "spec", "name").distinct(), files).withColumnsRenamed({"importer": "_i", "spec": "_s", "name": "_n"})
    python = python.join(p, (F.col("importer") == F.col("_i")) & (F.col("spec") == F.col("_s")) & F.col("name").eqNullSafe(F.col("_n"))).drop("_i", "_s", "_n")
    spark = files.sparkSession
    none = spark.createDataFrame([], "workspace string, prefix string, target string, exact boolean, nth int")
    no_packages = spark.createDataFrame([], "name string, dir string, sub string, nth int, stem string")
    scripts = found.where(~F.endswith("importer", F.lit(".py")))
    resolved = resolve(scripts.select("importer", "spec"), files.select("path"), none, no_packages).where("target is not null")
    scripts = scripts.join(resolved.select("importer", "spec", "target"), ["importer", "spec"])
    cols = [F.col("importer").alias("registry"), "key", "target", F.col("name").alias("symbol")]
    return python.select(*cols).unionByName(scripts.select(*cols)).distinct()


def dispatch_seeds(targets: DataFrame, covered: DataFrame, owners: DataFrame) -> DataFrame:
    """A flow for each target of a registry that no flow covers and a feature owns: feature, flow, path. covered: path; owners: path, feature."""
    from ..functions.text import slugify

    free = targets.join(covered.select(F.col("path").alias("target")), "target", "left_anti").join(owners.withColumnRenamed("path", "target"), "target")
    word = slugify(F.regexp_replace(F.coalesce("symbol", F.regexp_extract("target", r"([^/]+?)(?:\.\w+)?$", 1)), "(?<=[a-z0-9])(?=[A-Z])", "-"))
    return free.select("feature", F.concat(F.lit("run-"), word, F.lit("-flow")).alias("flow"), F.col("target").alias("path")).distinct()
