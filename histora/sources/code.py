"""Routes, symbols and imports out of source text.

Most sources are rules: files that a rule's path pattern takes, and a pattern whose
groups become columns. They run as ``regexp_extract_all`` on the whole text, inside
the engine. Python sources need a syntax tree and are parsed in Arrow batches.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One source of anchors: which files, which pattern, and the groups of method (0: none) and name."""

    source: str
    files: str
    pattern: str
    method: int
    name: int
    needs: str = ""  # a string the text must hold


RULES = (
    Rule("fastapi", r"\.py$", r"@(\w+)\.(get|post|put|patch|delete)\(\s*['\"]([^'\"]*)", 2, 3, "@"),
    Rule("flask", r"\.py$", r"@\w+\.route\(\s*['\"]()([^'\"]+)", 0, 2, ".route("),
    Rule("django", r"urls\.py$", r"\b(?:re_)?path\(\s*r?['\"]()([^'\"]*)", 0, 2, "path("),
    Rule("express", r"\.[jt]s$", r"\b(?:app|router)\.(get|post|put|patch|delete|all)\(\s*['\"`]([^'\"`]+)", 1, 2, "("),
    Rule("fastify", r"\.[jt]s$", r"\b(?:fastify|server|instance)\.(get|post|put|patch|delete)\(\s*['\"`]([^'\"`]+)", 1, 2, "("),
    Rule("nest", r"\.ts$", r"@(Get|Post|Put|Patch|Delete)\(\s*['\"]?([^'\")]*)", 1, 2, "@"),
    Rule("go_router", r"\.go$", r"\.(GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete|HandleFunc|Handle)\(\s*\"([^\"]+)", 1, 2, "("),
    Rule("rails_routes", r"config/routes\.rb$", r"(?m)^\s*(get|post|put|patch|delete|resources?|root)\s+[:'\"]([\w/:#-]+)", 1, 2, ""),
    Rule("rails_models", r"app/models/.*\.rb$", r"()class\s+(\w+)\s*<\s*(?:ApplicationRecord|ActiveRecord::Base)", 0, 2, "class"),
    Rule("rails_jobs", r"app/jobs/.*\.rb$", r"()class\s+(\w+Job)\b", 0, 2, "class"),
    Rule("prisma_models", r"\.prisma$", r"(?m)^()model\s+(\w+)", 0, 2, "model"),
    Rule("orm_tables", r"\.[jt]s$|\.py$", r"()(?:pgTable|mysqlTable|sqliteTable|__tablename__\s*=)\s*\(?\s*['\"](\w+)", 0, 2, ""),
    Rule("trpc", r"\.ts$", r"()(\w+)\s*:\s*(?:public|protected|admin)?[pP]rocedure\b", 0, 2, "rocedure"),
    Rule("jobs", r"\.[jt]s$|\.py$", r"()(?:cron\.schedule|createJob|defineJob|@shared_task|@celery\.task)\W+['\"]?([\w\s*/,-]*)", 0, 2, ""),
    Rule("cli_commands", r"\.py$|\.[jt]s$|\.go$", r"()(?:@\w+\.command\(\s*['\"]|\.command\(\s*['\"]|Use:\s*\")([\w-]+)", 0, 2, ""),
    Rule("js_exports", r"\.[jt]sx?$", r"export\s+(?:default\s+)?(?:async\s+)?(function|class|const|type|interface|enum)\s+(\w+)", 1, 2, "export"),
    Rule("js_imports", r"\.[jt]sx?$", r"()(?:from\s+|import\s*\(\s*|require\(\s*|import\s+)['\"]([^'\"]+)", 0, 2, ""),
    Rule("go_imports", r"\.go$", r"(?m)^()\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$", 0, 2, "\""),
    Rule("rust_modules", r"\.rs$", r"(?m)^\s*(pub\s+)?mod\s+(\w+)\s*;", 1, 2, "mod "),
    Rule("url_literals", r"\.[jt]sx?$", r"()(?:fetch|axios(?:\.\w+)?|useSWR|\$fetch)\(\s*['\"`]([^'\"`]+)", 0, 2, "("),
)

#: Anchors that paths alone give: source, path pattern, group of the name.
PATH_RULES = (
    ("next_app", r"(?:^|/)app/(?:.*/)?([^/()@]+)/(?:\([^/]*\)/)*(?:page|route)\.[jt]sx?$", 1),
    ("next_pages", r"(?:^|/)pages/(?:api/)?([^/_.\[]+)", 1),
    ("react_router", r"(?:^|/)app/routes/([^/.]+)", 1),
    ("sveltekit", r"(?:^|/)src/routes/(?:\([^/]*\)/)?([^/+()]+)/", 1),
    ("mvc_controllers", r"(?:^|/)(?:app/controllers|app/Http/Controllers)/(?:.*/)?(\w+?)_?[cC]ontroller\.\w+$", 1),
    ("rails_views", r"(?:^|/)app/views/([^/]+)/", 1),
    ("rails_stimulus", r"(?:^|/)(\w+)_controller\.js$", 1),
    ("go_packages", r"^(?:cmd|internal|pkg)/([^/]+)/", 1),
    ("rust_crates", r"^crates/([^/]+)/", 1),
    ("rust_src", r"^src/([^/]+?)(?:/|\.rs$)", 1),
    ("python_packages", r"^(?:src/)?([A-Za-z_]\w*)/__init__\.py$", 1),
    ("js_lib", r"^lib/([^/.]+)", 1),
    ("workspaces", r"^(?:apps|packages)/([^/]+)/package\.json$", 1),
)


def from_text(files: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """source, path, method, name for every match of every rule in files (path, text). One pass over the texts."""
    found = []
    for r in rules:
        takes = F.col("path").rlike(r.files)
        if r.needs:
            takes = takes & F.contains(F.col("text"), F.lit(r.needs))
        methods = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.method)) if r.method else F.regexp_extract_all("text", F.lit(r.pattern), F.lit(1))
        names = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.name))
        method = (lambda m: F.nullif(F.upper(F.trim(m)), F.lit(""))) if r.method else (lambda m: F.lit(None).cast("string"))
        rows = _zipped(methods, names, r.source, method)
        found.append(F.when(takes, rows).otherwise(F.array().cast("array<struct<source:string,method:string,name:string>>")))
    return files.where("text is not null").select("path", F.explode(F.concat(*found)).alias("x")).select("x.source", "path", "x.method", "x.name")


def _zipped(methods, names, source: str, method):
    def one(m, n):
        return F.struct(F.lit(source).alias("source"), method(m).alias("method"), n.alias("name"))

    return F.zip_with(methods, names, one)


def from_paths(files: DataFrame) -> DataFrame:
    """source, path, name for paths that a convention takes."""
    each = [F.when(F.col("path").rlike(p), F.struct(F.lit(s).alias("source"), F.lower(F.regexp_extract("path", p, g)).alias("name"))) for s, p, g in PATH_RULES]
    return files.select("path", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x")).select("x.source", "path", "x.name").where("name <> ''")


def anchors(files: DataFrame) -> DataFrame:
    """Anchor candidates of all sources: source, name, files."""
    both = from_text(files).select("source", "path", "name").unionByName(from_paths(files))
    return both.groupBy("source", "name").agg(F.array_sort(F.collect_set("path")).alias("paths"))


PYTHON = "path string, kind string, name string, start int, end int, module string, level int"


def _python_rows(path: str, text: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError):
        yield path, "error", None, None, None, None, None
        return
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            yield path, "class" if isinstance(node, ast.ClassDef) else "function", node.name, node.lineno, node.end_lineno, None, None
        elif isinstance(node, ast.Import):
            for a in node.names:
                yield path, "import", a.name, node.lineno, node.end_lineno, a.name, 0
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                yield path, "import", a.name, node.lineno, node.end_lineno, node.module or "", node.level


def python_symbols(files: DataFrame) -> DataFrame:
    """Definitions with their lines, and imports, of Python files; a file that doesn't parse gives one row of kind error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PYTHON.split(", ")]
        for batch in batches:
            rows = [r for p, t in zip(batch.path, batch.text, strict=True) for r in _python_rows(p, t)]
            yield pd.DataFrame(rows, columns=names).astype({"start": "Int32", "end": "Int32", "level": "Int32"})

    return files.where(F.endswith("path", F.lit(".py"))).select("path", "text").mapInPandas(parse, PYTHON)


def python_candidates(imports: DataFrame) -> DataFrame:
    """Files that an import may mean, in order: importer, module, name, nth, path."""
    base = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    up = F.when(F.col("level") > 0, F.array_join(F.slice(base, F.lit(1), F.greatest(F.size(base) - (F.col("level") - 1), F.lit(0))), "/")).otherwise("")
    dotted = F.regexp_replace("module", r"\.", "/")
    stem = F.regexp_replace(F.concat_ws("/", F.nullif(up, F.lit("")), F.nullif(dotted, F.lit(""))), "^/", "")
    stems = F.array(F.concat_ws("/", stem, "name"), stem, F.concat(F.lit("src/"), F.concat_ws("/", stem, "name")), F.concat(F.lit("src/"), stem))
    tried = F.flatten(F.transform(stems, lambda s: F.array(F.concat(s, F.lit(".py")), F.concat(s, F.lit("/__init__.py")))))
    return imports.where("kind = 'import'").select(F.col("path").alias("importer"), "module", "name", F.posexplode(tried).alias("nth", "path"))


def python_edges(files: DataFrame) -> DataFrame:
    """importer, target over the Python files of a tree."""
    tried = python_candidates(python_symbols(files)).join(files.select("path"), "path")
    return tried.groupBy("importer", "module", "name").agg(F.min_by("path", "nth").alias("target")).select("importer", "target").where("importer <> target").distinct()


def executable_lines(files: DataFrame) -> DataFrame:
    """Lines that are neither blank nor only comment: path, loc. Block comments are dropped first."""
    bare = F.when(F.col("path").rlike(r"\.py$|\.rb$|\.sh$"), F.col("text")).otherwise(F.regexp_replace("text", r"(?s)/\*.*?\*/", ""))
    comment = F.when(F.col("path").rlike(r"\.py$|\.rb$|\.sh$"), F.lit(r"^\s*#")).otherwise(F.lit(r"^\s*//"))
    lines = F.split(F.coalesce(bare, F.lit("")), r"\r?\n", -1)
    return files.select("path", F.size(F.filter(lines, lambda x: (F.length(F.trim(x)) > 0) & ~F.regexp_like(x, comment))).alias("loc"))


#: Profiles: name, marks in a manifest or path that raise its score.
PROFILES = (
    ("next_app_router", r"(?:^|/)app/(?:.*/)?(?:page|layout|route)\.[jt]sx?$"),
    ("next_pages_react", r"(?:^|/)pages/.*\.[jt]sx?$|(?:^|/)src/App\.[jt]sx?$"),
    ("react_router_framework", r"(?:^|/)app/routes/.*\.[jt]sx?$|react-router\.config\."),
    ("fastapi_family", r"(?:^|/)routers?/.*\.py$|(?:^|/)main\.py$"),
    ("django", r"(?:^|/)(?:manage|urls|wsgi)\.py$"),
    ("go_server", r"\.go$"),
    ("rust", r"Cargo\.toml$"),
)


def profile_scores(files: DataFrame) -> DataFrame:
    """Profiles by the number of files that bear their mark, best first, ties by name; ``default`` has the floor of 0."""
    each = F.explode(F.concat(F.array(F.lit("default")), F.filter(F.array(*[F.when(F.col("path").rlike(p), F.lit(n)) for n, p in PROFILES]), lambda x: x.isNotNull())))
    scored = files.select(each.alias("profile")).groupBy("profile").agg(F.count("*").alias("score"))
    return scored.select("profile", F.when(F.col("profile") == "default", 0).otherwise(F.col("score")).alias("score")).orderBy(F.desc("score"), "profile")


def match_routes(refs: DataFrame, routes: DataFrame) -> DataFrame:
    """Calls and the routes that serve them. refs: caller, url; routes: pattern, handler.

    Joined by the number of segments and the first fixed segment if both have one; then
    compared segment by segment.
    """
    from ..functions.text import url_matches, url_template

    def keyed(df: DataFrame, c: str) -> DataFrame:
        parts = F.split(F.regexp_replace(F.col(c), "^/+|/+$", ""), "/")
        return df.withColumn("_n", F.size(parts)).withColumn("_first", parts[0])

    a = keyed(refs.withColumn("template", url_template("url")), "template")
    b = keyed(routes, "pattern")
    open_first = F.col("_first").rlike(r"^(?:[:{\[<]|\$\{)")
    fixed = a.join(b.where(~open_first), ["_n", "_first"])
    free = a.join(b.where(open_first).drop("_first"), "_n")
    return fixed.unionByName(free).where(url_matches(F.col("template"), F.col("pattern"))).select("caller", "url", "pattern", "handler").distinct()
