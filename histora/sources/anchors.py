"""Anchors: what a tree's routes, models, jobs, packages and manifests name as features.

Every source gives hits, rows of (source, name, path, method, pattern); ``candidates`` gathers
them to features. Sources that read paths alone are column expressions or small functions of a path; those that read
text share one scan of the files, an Arrow batch at a time. What spans files (a router
that another file mounts, members of a workspace, medians of a crate) is joined afterwards.
"""

from __future__ import annotations

import fnmatch
import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import directory, is_test_path
from .scripts import Scan, read_jsonc, read_script

HIT = "source string, name string, path string, method string, pattern string"

#: Words that name no feature by themselves. FIXED VALUES.
NOISE = frozenset(
    (
        "src", "app", "pages", "routes", "api", "lib", "libs", "components", "component", "shared", "common", "utils", "util", "helpers", "helper",
        "hooks", "config", "configs", "controllers", "controller", "models", "model", "views", "view", "services", "service", "handlers",
        "handler", "middleware", "internal", "core", "main", "index", "page", "layout", "route", "schemas", "schema", "types", "type", "public",
        "private",
    )
)
#: Places that hold no product. FIXED VALUES.
NO_PRODUCT = frozenset(
    (
        "__stories__", "stories", "storybook", "examples", "example", "playground", "playgrounds", "demo", "demos", "sample", "samples",
        "fixtures", "fixture", "mocks", "mock", "__generated__", "generated", "node_modules", "vendor", "dist", "build",
    )
)


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", text or "").lower()).strip("-")


def _named(text: str) -> str | None:
    """The slug of a text, or None if it names nothing."""
    s = slug(text)
    return s if s and s not in NOISE else None


def _joined(*parts: str | None) -> str:
    """A url of its parts."""
    return "/" + "/".join(p.strip("/") for p in parts if p and p.strip("/"))


def url_slug(pattern: str) -> str | None:
    """The first fixed segment of a url that names something; api and versions don't."""
    for seg in pattern.split("/"):
        if seg and not re.match(r"[:{\[<*$(]|v\d+$", seg) and (s := _named(seg)):
            return s
    return None


# -- by path -----------------------------------------------------------------------

#: Conventions of file routing: roots, endings of route files. FIXED VALUES.
FILE_ROUTES = {
    "next-app-router": (("app/", "src/app/"), ("/page.tsx", "/page.jsx", "/page.ts", "/page.js", "/route.ts", "/route.js")),
    "next-pages": (("pages/", "src/pages/"), (".tsx", ".jsx", ".ts", ".js")),
    "remix": (("app/routes/",), (".tsx", ".jsx", ".ts", ".js")),
    "react-router": (("app/routes/",), (".tsx", ".jsx", ".ts", ".js")),
    "astro": (("src/pages/", "pages/"), (".astro", ".tsx", ".ts", ".js")),
    "sveltekit": (("src/routes/",), ("+page.svelte", "+server.ts", "+server.js", "+page.ts")),
    "nuxt": (("pages/", "src/pages/"), (".vue",)),
    "tanstack-router": (("src/routes/", "src/pages/"), (".tsx", ".jsx", ".ts", ".js")),
    "vite": (("src/pages/", "src/routes/"), (".tsx", ".jsx", ".ts", ".js")),
}
PYTHON_ROUTES = ("urls.py", "router.py", "routers.py", "routes.py")
MARKERS = frozenset(("", "page", "route", "layout", "index", "+page", "+server", "_app", "_document", "_index", "_layout", "_route"))
CONTROLLERS = ("_controller.rb", "Controller.php", "_controller.ex", "Controller.cs", "Controller.java", "Controller.kt")
GO_ROOTS = ("cmd", "internal", "pkg", "modules", "apps")
GO_EXCLUDED = frozenset(
    (
        "vendor", "testdata", "examples", "example", "docs", ".git", "third_party", "node_modules",
    )
)
RUST_EXCLUDED = frozenset(
    (
        "target", "tests", "benches", "bench", "examples", "example", "vendor", "vendored", "external-crates", "third_party", "third-party",
        ".git", "node_modules",
    )
)


def file_route(path: str, stack: str, workspace: str = "") -> str | None:
    """The feature that a route file belongs to by a convention, or None."""
    if stack in ("django", "fastapi", "flask", "starlette"):
        parts = path.split("/")
        if not path.endswith(".py"):
            return None
        if parts[-1] in PYTHON_ROUTES:
            return _named(parts[-2]) if len(parts) > 1 else None
        return _named(parts[-1][:-3]) if len(parts) > 1 and parts[-2] == "routers" and parts[-1] != "__init__.py" else None
    roots, endings = FILE_ROUTES.get(stack, ((), ()))
    base = f"{workspace.strip('/')}/" if workspace else ""
    rest = next((path[len(base + r) :] for r in roots if path.startswith(base + r)), None)
    ending = next((e for e in endings if path.endswith(e)), None)
    if rest is None or ending is None:
        return None
    *dirs, name = rest.split("/")
    own = ending.lstrip("/")
    stem = (name[: -len(own)] if name.endswith(own) else name).rstrip(".")

    def first(segments: list[str]) -> str | None:
        for seg in (s.rstrip("+") for s in segments):
            if seg and not re.match(r"\[.*\]$|\$|\(.*\)$|_", seg) and slug(seg) not in NOISE and seg.lower() not in NOISE:
                return slug(seg)
        return None

    found = first(dirs)
    if stem in MARKERS:
        return found or next((s for d in dirs if re.match(r"\(.+\)$", d) and (s := _named(d[1:-1]))), None)
    return found or first(stem.split("."))


def app_route(path: str) -> tuple[str, str] | None:
    """Url and method of an app-directory file, whatever the stack: PAGE or API, or None."""
    m = re.search(r"(?:^|/)app/((?:.*/)?)(page|route)\.[jt]sx?$", path)
    if not m:
        return None
    segments = [s for s in m[1].split("/") if s and not re.match(r"\(.*\)$|@", s)]
    if any(s.startswith("_") for s in segments):
        return None
    opened = [re.sub(r"^\[+(\.\.\.)?([^\]]+)\]+$", lambda x: ("*" if x[1] else ":") + x[2], s) for s in segments]
    return "/" + "/".join(opened), "PAGE" if m[2] == "page" else "API"


def _path_hits(path: str, stack: str, workspace: str) -> Iterator[tuple]:
    parts = path.split("/")
    leaf = parts[-1]
    if (name := file_route(path, stack, workspace)) and not re.search(r"(?:\.|_)(?:test|spec)\.", path):
        yield "route", name, path, None, None
    if (route := app_route(path)) and (name := url_slug(route[0])):
        yield "approuter-keyless", name, path, route[1], route[0]
    for ending in CONTROLLERS:
        if leaf.endswith(ending):
            if name := _named(leaf[: -len(ending)]):
                yield "mvc", name, path, None, None
            break
    if leaf.endswith(".go") and not GO_EXCLUDED & set(parts) and len(parts) > 1:
        unit = parts[1] if parts[0] in GO_ROOTS and len(parts) > 2 else parts[0] if len(parts) == 2 else None
        if unit and slug(unit):
            real = not leaf.endswith(("_test.go", ".pb.go", "_gen.go"))
            yield "go-package", slug(unit), path, "real" if real else None, None
    if leaf.endswith(".rs") and "src" in parts[:-1] and not RUST_EXCLUDED & set(parts):
        at = len(parts) - 1 - parts[::-1].index("src")
        crate, after = "/".join(parts[:at]), parts[at + 1 :]
        if after[0] == "bin" and len(after) > 1:
            if after[1].endswith(".rs"):
                yield "rust-module", after[1][:-3], path, "bin", crate
        elif len(after) > 1:
            yield "rust-module", after[0], path, "folder", crate
        elif after[0] not in ("lib.rs", "main.rs", "mod.rs"):
            yield "rust-module", after[0][:-3], path, "flat", crate
    if path.startswith("app/views/") and len(parts) > 3 and leaf.endswith((".erb", ".haml", ".slim")) and parts[2] not in ("layouts", "shared", "application") and (name := _named(parts[2])):
        yield "rails-views", name, path, None, None
    if re.match(r"app/javascript/(?:src/)?controllers/", path) and leaf.endswith("_controller.js") and (name := _named(leaf[: -len("_controller.js")])):
        yield "rails-stimulus", name, path, None, None
    if m := re.match(r"(?:.*/)?(?:src/)?pages/(.+)\.vue$", path):
        segs = [s for s in m[1].split("/") if s != "index"]
        pattern = "/" + "/".join(re.sub(r"^\[(?:\.\.\.)?(.+)\]$", r":\1", s) for s in segs)
        if name := url_slug(pattern):
            yield "spa-router", name, path, "PAGE", pattern


def path_hits(files: DataFrame, stack: str = "", workspace: str = "") -> DataFrame:
    """Hits that paths alone give. files: path; stack chooses the convention of file routes, below a workspace if one is named. Tests give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([r for p in batch.path for r in _path_hits(p, stack, workspace)], columns=["source", "name", "path", "method", "pattern"])

    return files.where(~is_test_path("path") | F.endswith("path", F.lit("_test.go"))).select("path").mapInPandas(run, HIT)


def go_packages(hits: DataFrame) -> DataFrame:
    """Go packages that have more than tests and generated files."""
    real = hits.where("source = 'go-package' and method = 'real'").select("name").distinct()
    return hits.where("source = 'go-package'").join(real, "name", "left_semi")


def rust_modules(hits: DataFrame, times: float = 2.0, floor: int = 3) -> DataFrame:
    """Rust modules; the flat ones of a crate with over twice the median number fold into the crate; names that crates share bear the crate's."""
    own = hits.where("source = 'rust-module'").withColumnRenamed("pattern", "crate")
    flat = own.where("method = 'flat'").groupBy("crate").agg(F.countDistinct("name").alias("n"))
    mark = flat.agg((F.greatest(F.expr("percentile(n, 0.5)"), F.lit(float(floor))) * times).alias("mark"))
    folded = flat.crossJoin(F.broadcast(mark)).where("n > mark").select("crate", F.lit("flat").alias("method"), F.lit(True).alias("fold"))  # one row
    leaf = F.element_at(F.split("crate", "/"), -1)
    units = own.join(folded, ["crate", "method"], "left").withColumn("name", F.when(F.col("fold"), F.when(leaf == "", "root").otherwise(leaf)).otherwise(F.col("name")))
    shared = units.groupBy("name").agg(F.countDistinct("crate").alias("crates"))
    name = F.when((F.col("crates") > 1) & (leaf != ""), F.concat_ws("-", leaf, "name")).otherwise(F.col("name"))
    return units.join(shared, "name").select("source", F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-").alias("name"), "path", "method", F.col("crate").alias("pattern"))


# -- by text -----------------------------------------------------------------------

Reader = Callable[[str, str], Iterator[tuple]]
_VERBS = "get|post|put|patch|delete|head|options|all"


# FIXED VALUES: the forms in which the framework declares routes, by its own interface.
def _fastapi(path: str, text: str) -> Iterator[tuple]:
    prefix = {m[1]: (p[1] if (p := re.search(r"prefix\s*=\s*['\"]([^'\"]*)['\"]", m[2])) else "") for m in re.finditer(r"(\w+)\s*(?::\s*\w+\s*)?=\s*APIRouter\(([^)]*)\)", text)}
    for m in re.finditer(r"@(\w+)\.(get|post|put|patch|delete|head|options)\(\s*['\"]([^'\"]*)['\"]", text):
        yield "fastapi-route", "", path, m[2].upper(), _joined(prefix.get(m[1], ""), m[3])
    for m in re.finditer(r"\.include_router\(\s*([\w.]+)\s*(?:,\s*([^)]*))?\)", text):
        p = re.search(r"prefix\s*=\s*['\"]([^'\"]*)['\"]", m[2] or "")
        if p:
            yield "fastapi-mount", m[1].split(".")[0], path, None, p[1]


# FIXED VALUES: the forms in which the framework declares routes, by its own interface.
def _fastify(path: str, text: str) -> Iterator[tuple]:
    if "fastify" not in text.lower():
        return
    for m in re.finditer(rf"\b(?:fastify|server|instance|app)\s*\.\s*({_VERBS})\s*(?:<[^>]*>)?\(\s*(['\"`])([^'\"`]+)\2", text):
        yield "fastify-route", url_slug(m[3]) or "root", path, m[1].upper(), m[3]
    scan = Scan(text)
    for m in re.finditer(r"\.\s*route\s*(?:<[^>]*>)?\(\s*\{", scan.bare):
        body = text[m.end() : scan.pairs.get(m.end() - 1, len(text))]
        url = re.search(r"\burl\s*:\s*['\"`]([^'\"`]+)", body)
        if url:
            verbs = re.search(r"\bmethod\s*:\s*(\[[^\]]*\]|['\"`]\w+)", body)
            for verb in re.findall(r"\w+", verbs[1]) if verbs else ["GET"]:
                yield "fastify-route", url_slug(url[1]) or "root", path, verb.upper(), url[1]


# FIXED VALUES: the forms in which the framework declares routes, by its own interface.
def _express(path: str, text: str) -> Iterator[tuple]:
    if re.search(r"['\"]@nestjs/|fastify|koa-router|@koa/router", text):
        return
    routers = {"app", "router", "server", "api"} | set(re.findall(r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::\s*[\w.$<>\[\] ]+?)?\s*=\s*(?:express\s*\.\s*)?Router\s*\(", text))
    mounts = {m[4]: m[3] for m in re.finditer(r"\b([A-Za-z_$][\w$]*)\.use\s*\(\s*(['\"`])([^'\"`]+)\2\s*,(?:[^;]*?,)?\s*([A-Za-z_$][\w$]*)\s*\)", text)}
    for m in re.finditer(rf"\b([A-Za-z_$][\w$]*)\.({_VERBS})\s*\(\s*(['\"`])(/[^'\"`]*|\*)\3", text):
        if m[1] in routers:
            pattern = _joined(mounts.get(m[1]), m[4])
            yield "express-route", url_slug(pattern) or "root", path, m[2].upper(), pattern
    for m in re.finditer(r"\b([A-Za-z_$][\w$]*)\.route\s*\(\s*(['\"`])([^'\"`]+)\2\s*\)((?:\s*\.\s*\w+\s*\((?:[^()]|\([^()]*\))*\))*)", text):
        if m[1] in routers:
            pattern = _joined(mounts.get(m[1]), m[3])
            for verb in re.findall(rf"\.\s*({_VERBS})\s*\(", m[4]):
                yield "express-route", url_slug(pattern) or "root", path, verb.upper(), pattern


DJANGO_VIEWS = ("ViewSet", "APIView", "TemplateView", "RedirectView", "ListView", "DetailView", "CreateView", "UpdateView", "DeleteView", "FormView", "View")


def _django(path: str, text: str) -> Iterator[tuple]:
    leaf = path.rsplit("/", 1)[-1]
    app = path.split("/")[-2] if "/" in path else "root"
    if leaf in ("urls.py", "urlconf.py"):
        for m in re.finditer(r"\b(?:path|re_path|url)\(\s*[rR]?['\"]([^'\"]*)['\"]\s*,\s*([^\n]*)", text):
            mounted = re.search(r"include\(\s*\(?\s*[rR]?['\"]?([\w./]+)", m[2])
            pattern = _joined(re.sub(r"\(\?P(<\w+>)[^)]*\)", r"\1", m[1].strip("^$")))
            if mounted:
                yield "django-mount", mounted[1], path, None, pattern
            else:
                yield "django", _named(app) or url_slug(pattern) or "root", path, "URL", pattern
        for m in re.finditer(r"\.register\(\s*[rR]?['\"]([^'\"]+)['\"]\s*,\s*([\w.]+)", text):
            yield "django", _named(m[1]) or "root", path, "REST", _joined(m[1])
    if leaf in ("views.py", "viewsets.py", "api.py"):
        for m in re.finditer(r"(?m)^class\s+([A-Za-z_]\w*)\s*\(\s*([^)]*)\)\s*:", text):
            if re.search(r"(?:" + "|".join(DJANGO_VIEWS) + r")\b", m[2]) and (name := _named(re.sub(r"(?:ViewSet|APIView|View)$", "", m[1]))):
                yield "django-view", name, path, "VIEW", m[1]


GO_ROUTERS = r"chi\.NewRouter\(|gin\.(?:Default|New)\(|echo\.New\(|fiber\.New\(|http\.NewServeMux\(|httprouter\.New\(|mux\.NewRouter\("


def _go_router(path: str, text: str) -> Iterator[tuple]:
    if path.endswith("_test.go") or {"testdata", "examples", "example"} & set(path.split("/")):
        return
    groups = {m[1]: m[3] for m in re.finditer(r"(\w+)\s*:?=\s*(\w+)\.Group\(\s*\"([^\"]*)\"", text)}
    for m in re.finditer(r"\b(\w+)\.(Get|Post|Put|Patch|Delete|Head|Options|Connect|Trace|Method|Handle|HandleFunc|GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|Any|All|HandlerFunc|PathPrefix)\(\s*\"(?:([A-Z]+)\s+)?(/[^\"]*)\"", text):
        verb = m[3] or ("ANY" if m[2] in ("Handle", "HandleFunc", "Any", "All", "HandlerFunc", "Method", "PathPrefix") else m[2].upper())
        pattern = _joined(groups.get(m[1]), m[4])
        yield "go-router", url_slug(pattern) or "root", path, verb, pattern


def _schema(path: str, text: str) -> Iterator[tuple]:
    kinds = []
    if path.endswith(".prisma"):
        kinds = [("model", r"(?m)^\s*model\s+([A-Za-z_]\w*)\s*\{"), ("enum", r"(?m)^\s*enum\s+([A-Za-z_]\w*)\s*\{")]
    elif path.endswith("db/schema.rb"):
        kinds = [("table", r"create_table\s+[\"']([^\"']+)[\"']")]
    elif path.endswith("models.py"):
        kinds = [("model", r"(?m)^class\s+([A-Za-z_]\w*)\s*\(\s*[^)]*models\.Model[^)]*\)\s*:")]
    elif re.search(r"(?:^|/)schema\.[jt]s$|/schema/[^/]+\.[jt]s$", path):
        kinds = [("table", r"export\s+const\s+([A-Za-z_]\w*)\s*=\s*(?:pgTable|mysqlTable|sqliteTable)\s*\(")]
    for kind, p in kinds:
        for m in re.finditer(p, text):
            if name := _named(m[1]):
                yield "schema", name, path, kind, m[1]


def _rails(path: str, text: str) -> Iterator[tuple]:
    if path.endswith("config/routes.rb"):
        for kind, p in (("resources", r"\bresources\s+:([a-zA-Z_]\w*)"), ("resource", r"\bresource\s+:([a-zA-Z_]\w*)"), ("namespace", r"\bnamespace\s+:([a-zA-Z_]\w*)"), ("verb", r"\b(?:get|post|put|patch|delete)\s+['\"]?[/:]?([a-zA-Z_][\w/]*)['\"]?\s*(?:=>|,\s*to:)")):
            for m in re.finditer(p, re.sub(r"(?m)#.*$", "", text)):
                if name := _named(m[1].split("/")[0]):
                    yield "rails-routes", name, path, kind, m[1]
    elif path.startswith("app/models/"):
        for m in re.finditer(r"class\s+([A-Z]\w*)\s*<\s*(?:ApplicationRecord|ActiveRecord::Base)", text):
            if name := _named(m[1]):
                yield "rails-models", name, path, "model", m[1]
                for a in re.finditer(r"(?m)^\s*(has_many|belongs_to|has_one|has_and_belongs_to_many)\s+:([a-zA-Z_]\w*)", text):
                    yield "rails-association", name, path, a[1], a[2]
    elif path.startswith("app/jobs/") and not path.endswith("/application_job.rb"):
        for m in re.finditer(r"class\s+([A-Z]\w*)\s*<\s*(?:ApplicationJob|ActiveJob::Base|Sidekiq::Job|Sidekiq::Worker)|class\s+([A-Z]\w*)\b[^\n]*\n\s*include\s+Sidekiq::(?:Job|Worker)", text):
            if name := _named(re.sub(r"(?:Job|Worker)$", "", m[1] or m[2])):
                yield "rails-jobs", name, path, "JOB", m[1] or m[2]


_SUFFIX = re.compile(r"(?:Controller|Resolver|Router|Procedure|Schema|Gateway|Service)$")


def _server_api(path: str, text: str) -> Iterator[tuple]:
    if "@nestjs/" in text or "@Controller" in text:
        for m in re.finditer(r"@Controller\b(?:\(\s*(?:['\"`]([^'\"`]*)['\"`]|\{[^}]*?\bpath\s*:\s*['\"`]([^'\"`]+)['\"`][^}]*\})?\s*\))?(?:(?!@Controller).)*?class\s+([A-Za-z_$][\w$]*)((?:(?!@Controller).)*)", text, re.S):
            base = m[1] or m[2] or ""
            for v in re.finditer(r"@(Get|Post|Put|Patch|Delete|Options|Head|All)\s*\(\s*(?:['\"`]([^'\"`]*)['\"`])?", m[4]):
                pattern = _joined(base, v[2])
                yield "server-api", url_slug(pattern) or _named(_SUFFIX.sub("", m[3])) or "root", path, v[1].upper(), pattern
    if re.search(r"type-graphql|@nestjs/graphql", text):
        of = re.search(r"@Resolver\(\s*(?:\(\s*\)?\s*=>\s*|of\s*=>\s*|['\"`])?([A-Za-z_$][\w$]*)", text) or re.search(r"class\s+([A-Za-z_$][\w$]*)", text)
        for m in re.finditer(r"@(Query|Mutation|Subscription)\b\((?:[^()]|\([^()]*\))*\)\s*(?:async\s+)?(\w+)", text):
            given = re.search(r"\bname\s*:\s*['\"`]([^'\"`]+)", m[0])
            yield "server-api", _named(_SUFFIX.sub("", of[1])) or "graph" if of else "graph", path, m[1].upper(), given[1] if given else m[2]
    if re.search(r"@pothos/core|new SchemaBuilder|['\"`]nexus['\"`]", text):
        for m in re.finditer(r"(?:\bbuilder\s*\.\s*|(?<![.\w$]))(query|mutation|subscription)Field\s*\(\s*['\"`]([^'\"`]+)", text):
            yield "server-api", _named(m[2]) or "graph", path, m[1].upper(), m[2]
    if re.search(r"@trpc/server|initTRPC|createTRPCRouter|(?:public|protected)Procedure", text):
        scan = Scan(text)
        for m in re.finditer(r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:t\s*\.\s*router|router|createTRPCRouter|createRouter)\s*\(", scan.bare):
            end = scan.pairs.get(m.end() - 1, len(scan.bare))
            name = _named(_SUFFIX.sub("", re.sub(r"Router$", "", m[1]))) or "root"
            for p in re.compile(r"([A-Za-z_$][\w$]*)\s*:\s*(?:t\s*\.\s*procedure|(?:[A-Za-z_$][\w$]*)?[Pp]rocedure)\b").finditer(scan.bare, m.end(), end):
                verb = re.compile(r"\.\s*(query|mutation|subscription)\s*\(").search(scan.bare, p.end(), min(end, p.end() + 800))
                yield "server-api", name, path, verb[1].upper() if verb else "PROCEDURE", p[1]
    if re.search(r"@koa/router|koa-router", text):
        base = re.search(r"new\s+Router\s*\(\s*\{[^}]*?\bprefix\s*:\s*['\"`]([^'\"`]+)", text)
        vars_ = {"router"} | set(re.findall(r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*new\s+Router\s*\(", text))
        for m in re.finditer(r"\b([A-Za-z_$][\w$]*)\s*\.\s*(get|post|put|patch|delete|del|all)\s*\(\s*['\"`]([^'\"`]+)", text):
            if m[1] in vars_:
                pattern = _joined(base[1] if base else "", m[3])
                yield "server-api", url_slug(pattern) or "root", path, m[2].upper().replace("DEL", "DELETE") if m[2] == "del" else m[2].upper(), pattern


def _jobs(path: str, text: str) -> Iterator[tuple]:
    def hit(name: str, method: str) -> Iterator[tuple]:
        bare = re.sub(r"(?:CronJob|Job|Cron|Worker|Processor|Consumer|Handler|Scheduler|Task)$|_(?:task|job|cron|worker|scheduler)$", "", name)
        if n := _named(bare or name):
            yield "jobs", n, path, method, name

    if path.endswith(".py"):
        marks = (("JOB", r"\bcelery\b|\bshared_task\b", r"@(?:shared_task|[A-Za-z_][\w.]*\.task)\b"), ("CRON", "apscheduler", r"@(?:[A-Za-z_][\w.]*\.)?scheduled_job\b"), ("JOB", r"from\s+rq\b|\bimport\s+rq\b", r"@job\b"))
        for method, needs, mark in marks:
            if re.search(needs, text):
                for m in re.finditer(mark + r"(\((?:[^()]|\([^()]*\))*\))?(?:\s*@[^\n]*)*\s*(?:async\s+)?def\s+([A-Za-z_]\w*)", text):
                    given = re.search(r"name\s*=\s*['\"]([^'\"]+)", m[1] or "")
                    yield from hit(given[1].split(".")[-1] if given else m[2], method)
        if "apscheduler" in text:
            for m in re.finditer(r"\.add_job\s*\(\s*([A-Za-z_][\w.]*)", text):
                yield from hit(m[1].split(".")[-1], "CRON")
        return
    for m in re.finditer(r"@Processor\b(?:\(\s*['\"]([^'\"]+)['\"][^)]*\))?(?:(?!@Processor).)*?class\s+([A-Za-z_$][\w$]*)", text, re.S):
        yield from hit(m[1] or m[2], "JOB")
    if re.search(r"['\"]bullmq['\"]", text):
        for m in re.finditer(r"new\s+Worker\s*(?:<[^>]*>)?\(\s*['\"]([^'\"]+)", text):
            yield from hit(m[1], "JOB")
    if re.search(r"node-cron|['\"]cron['\"]", text):
        for m in re.finditer(r"(?:(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*)?\b(?:cron|nodeCron)\.schedule\s*\(\s*['\"]([^'\"]+)['\"]\s*,\s*(?:([A-Za-z_$][\w$]*)\s*[,)])?", text):
            yield from hit(m[1] or m[3] or re.sub(r"\.\w+$", "", path.rsplit("/", 1)[-1]), "CRON")
    for m in re.finditer(r"\bagenda\.define\s*\(\s*['\"]([^'\"]+)", text):
        yield from hit(m[1], "JOB")
    if "@trigger.dev/" in text:
        for m in re.finditer(r"\b(schedules\.)?(?<![.\w$])?task\s*\(\s*\{[^}]*?\bid\s*:\s*['\"]([^'\"]+)", text):
            yield from hit(m[2], "CRON" if m[1] else "JOB")


def _spa(path: str, text: str) -> Iterator[tuple]:
    if not re.search(r"<Route\b|create(?:Browser|Hash|Memory)Router", text):
        return
    scan = Scan(text)
    for m in re.finditer(r"<Route\b([^>]*?(?:\{(?:[^{}]|\{[^{}]*\})*\}[^>]*?)*)/?>", text):
        at = re.search(r"\bpath\s*=\s*\{?['\"`]([^'\"`]+)", m[1])
        shown = re.search(r"\b(?:element|component)\s*=\s*\{\s*<?\s*([A-Z][\w$]*)", m[1])
        if at and shown and shown[1] not in ("Navigate", "Redirect"):
            pattern = _joined(at[1])
            if name := url_slug(pattern) or _named(re.sub(r"Page$", "", shown[1])):
                yield "spa-router", name, path, "PAGE", pattern
    made = re.search(r"create(?:Browser|Hash|Memory)Router\s*\(\s*\[", scan.bare)
    if made:
        stop = scan.pairs.get(made.end() - 1, len(text))
        opened: list[tuple[int, str]] = []
        for m in re.compile(r"\bpath\s*:\s*(['\"`])").finditer(scan.bare, made.end(), stop):
            around = max((a for a, z in scan.pairs.items() if scan.bare[a] == "{" and a < m.start() < z), default=made.end())
            opened = [(z, p) for z, p in opened if z > m.start()]
            pattern = _joined(*[p for _, p in opened], scan.literal(m.start(1)))
            opened.append((scan.pairs.get(around, stop), scan.literal(m.start(1)) or ""))
            if name := url_slug(pattern):
                yield "spa-router", name, path, "PAGE", pattern


#: Dependencies that are a feature's sign. FIXED VALUES.
DEPENDENCIES = {
    "billing": ("stripe", "@stripe", "@paddle", "paddle-sdk", "lemonsqueezy.js"),
    "auth": ("next-auth", "@auth", "better-auth", "lucia", "@clerk", "clerk", "@workos-inc", "@kinde-oss"),
    "email": ("resend", "@sendgrid", "postmark", "nodemailer", "@aws-sdk/client-ses"),
    "background-jobs": ("inngest", "bullmq", "bull", "@trigger.dev", "agenda"),
    "file-uploads": ("@uploadthing", "uploadthing", "@aws-sdk/client-s3", "@vercel/blob"),
    "analytics": ("posthog-node", "posthog-js", "mixpanel", "@segment"),
    "realtime": ("socket.io", "ws", "@pusher", "pusher", "ably"),
    "ai": ("openai", "anthropic", "@anthropic-ai", "@google/generative-ai", "ai"),
    "i18n": ("next-i18next", "i18next", "react-i18next", "@lingui"),
}
PYTHON_DEPENDENCIES = {
    "billing": ("stripe",),
    "auth": ("django-allauth", "authlib", "python-jose"),
    "background-jobs": ("celery", "rq", "dramatiq"),
    "ai": ("openai", "anthropic", "langchain"),
    "file-uploads": ("boto3",),
    "email": ("sendgrid",),
}


def _first_of(table: dict[str, tuple[str, ...]], dep: str) -> str | None:
    return next((name for name, tokens in table.items() for t in tokens if dep == t or dep.startswith((t + "/", t + "-"))), None)


def _package(path: str, text: str) -> Iterator[tuple]:
    leaf = path.rsplit("/", 1)[-1]
    if leaf == "package.json":
        m = read_jsonc(text)
        for dep in sorted({k for key in ("dependencies", "devDependencies", "peerDependencies") if isinstance(m.get(key), dict) for k in m[key]}):
            if name := _first_of(DEPENDENCIES, dep):
                yield "package", name, path, "dependency", dep
        if "/" in path and isinstance(m.get("name"), str) and (name := _named(m["name"].split("/")[-1])):
            yield "package", name, path, "workspace", m["name"]
    elif leaf in ("pyproject.toml", "requirements.txt"):
        for dep in sorted(set(re.findall(r"(?m)^\s*[\"']?([a-z][a-z0-9_.-]*)(?=[\"'\[<>=~!; ]|$)", text.lower()))):
            if name := _first_of(PYTHON_DEPENDENCIES, dep.replace("_", "-")):
                yield "package", name, path, "dependency", dep


def _config(path: str, text: str) -> Iterator[tuple]:
    leaf = path.rsplit("/", 1)[-1]
    m = read_jsonc(text) if leaf.endswith(".json") else {}

    def hit(kind: str, names: list) -> Iterator[tuple]:
        for n in names:
            if isinstance(n, str) and (s := _named(n)):
                yield "config", s, path, kind, n

    if leaf == "tauri.conf.json":
        windows = [w for key in ("app", "tauri") if isinstance(m.get(key), dict) for w in m[key].get("windows") or [] if isinstance(w, dict)]
        yield from hit("tauri", [w.get("label") or w.get("title") for w in windows])
    elif leaf in ("app.json", "app.config.json") and isinstance(m.get("expo"), dict):
        plugins = m["expo"].get("plugins") or []
        yield from hit("expo", [str(p[0] if isinstance(p, list) else p).removeprefix("expo-") for p in plugins if p])
    elif leaf == "manifest.json" and m.get("manifest_version") == 3:
        yield from hit("chrome", [k for k, key in (("popup", "action"), ("background", "background"), ("content-scripts", "content_scripts"), ("options", "options_page"), ("side-panel", "side_panel")) if key in m])
    elif leaf == "package.json" and isinstance(m.get("engines"), dict) and m["engines"].get("vscode"):
        commands = (m.get("contributes") or {}).get("commands") or []
        yield from hit("vscode", [c.get("title") or c.get("command") for c in commands if isinstance(c, dict)])
    elif leaf == "package.json" and isinstance(m.get("commands"), list) and m.get("author"):
        yield from hit("raycast", [c.get("title") or c.get("name") for c in m["commands"] if isinstance(c, dict)])
    elif leaf == "manifest.yaml":
        yield from hit("slack", re.findall(r"(?m)^\s*-?\s*command:\s*/?([\w-]+)", text))
    elif leaf == "manifest.yml":
        yield from hit("forge", re.findall(r"(?m)^\s*-\s*key:\s*([\w-]+)", text))


def _python_library(path: str, text: str) -> Iterator[tuple]:
    parts = path.split("/")
    if parts[-1] != "__init__.py" or {"tests", "test", "docs", "examples", "scripts"} & set(parts):
        return
    packages = parts[:-1][1:] if parts[0] == "src" else parts[:-1]
    if len(packages) == 2 and not packages[1].startswith("_") and (name := _named(packages[1])):
        yield "python-library", name, path, "submodule", ".".join(packages)
    if len(packages) == 1:
        names = [n for m in re.finditer(r"(?m)^from\s+\.([\w.]+)\s+import\s+(?:\(([^)]*)\)|(.+)$)", text) for n in [m[1].split(".")[0]]]
        for n in sorted(set(names)):
            if not n.startswith("_") and (s := _named(n)):
                yield "python-library", s, path, "export", n
        listed = re.search(r"(?s)^__all__\s*=\s*[\[(]([^\])]*)[\])]", text, re.M)
        for n in re.findall(r"['\"](\w+)['\"]", listed[1]) if listed else []:
            if s := _named(n):
                yield "python-library", s, path, "symbol", n


def _js_library(path: str, text: str) -> Iterator[tuple]:
    leaf = path.rsplit("/", 1)[-1]
    if leaf == "package.json":
        m = read_jsonc(text)
        if {"next", "nuxt", "@remix-run/react", "@sveltejs/kit", "astro", "express", "fastify", "@nestjs/core", "koa", "hapi"} & set(m.get("dependencies") or {}):
            return
        if isinstance(m.get("exports"), dict):
            for sub in m["exports"]:
                if sub.startswith("./") and not sub.endswith(".json") and (name := _named(sub[2:].split("/")[0].split("*")[0])):
                    yield "js-library", name, path, "subpath", sub
    elif re.search(r"(?:^|/)(?:src/)?index\.(?:js|mjs|cjs|ts)$", path):
        for name, kind, spec, _ in read_script(text)["exports"]:
            if spec and spec.startswith("./") and (s := _named(re.sub(r"\.\w+$", "", spec.split("/")[-1]) if "/" not in spec[2:] else spec[2:].split("/")[0])):
                yield "js-library", s, path, "reexport", name


def _rust_workspace(path: str, text: str) -> Iterator[tuple]:
    if path.rsplit("/", 1)[-1] != "Cargo.toml":
        return
    try:
        m = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return
    home = path.rpartition("/")[0]
    space = m.get("workspace")
    if isinstance(space, dict):
        for member in space.get("members") or []:
            yield "cargo-member", "/".join(x for x in (home, str(member).strip("/")) if x), path, "member", json.dumps(space.get("exclude") or [])
    if isinstance(m.get("package"), dict):
        yield "cargo-package", home, path, "package", m["package"].get("name")


READERS: tuple[tuple[str, Reader], ...] = (
    (r"\.py$", _fastapi),
    (r"\.[cm]?[jt]s$", _fastify),
    (r"\.[cm]?[jt]s$", _express),
    (r"\.py$", _django),
    (r"\.go$", _go_router),
    (r"\.prisma$|schema\.(?:rb|[jt]s)$|models\.py$|/schema/[^/]+\.[jt]s$", _schema),
    (r"\.rb$", _rails),
    (r"\.(?:[cm]?[jt]s|[jt]sx)$", _server_api),
    (r"\.(?:py|[cm]?[jt]s|[jt]sx)$", _jobs),
    (r"\.[jt]sx?$", _spa),
    (r"(?:^|/)(?:package\.json|pyproject\.toml|requirements\.txt)$", _package),
    (r"(?:^|/)(?:tauri\.conf\.json|app(?:\.config)?\.json|manifest\.(?:json|ya?ml)|package\.json)$", _config),
    (r"(?:^|/)__init__\.py$", _python_library),
    (r"(?:^|/)package\.json$|index\.(?:js|mjs|cjs|ts)$", _js_library),
    (r"(?:^|/)Cargo\.toml$", _rust_workspace),
)


def text_hits(files: DataFrame, readers: tuple[tuple[str, Reader], ...] = READERS) -> DataFrame:
    """Hits that texts give. files: path, text. Places without product and tests give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(re.compile(p), f) for p, f in readers]
        for batch in batches:
            rows = [r for p, t in zip(batch.path, batch.text, strict=True) if t is not None and not NO_PRODUCT & set(p.split("/")[:-1]) for takes, f in compiled if takes.search(p) for r in f(p, t)]
            yield pd.DataFrame(rows, columns=["source", "name", "path", "method", "pattern"])

    return files.where(~is_test_path("path")).select("path", "text").mapInPandas(run, HIT)


def mounted_fastapi(hits: DataFrame) -> DataFrame:
    """FastAPI routes with the prefix that another file mounts their module under; named by their module where the url names nothing.

    A mount means the module of its name in the nearest directory above or beside; of several prefixes the last one by name holds.
    """
    stem = F.regexp_extract("path", r"([^/]+?)(?:/__init__)?\.py$", 1)
    routes = hits.where("source = 'fastapi-route'").withColumn("module", stem)
    mounts = hits.where("source = 'fastapi-mount'").select(F.col("name").alias("module"), F.col("pattern").alias("_prefix"), directory("path").alias("_home"))
    parts = F.split("path", "/")
    homes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    above = routes.select("path", "module", F.explode(homes).alias("_home")).distinct()
    near = above.join(mounts, ["module", "_home"]).groupBy("path").agg(F.max_by("_prefix", F.struct(F.length("_home"), "_prefix")).alias("_prefix"))
    full = F.regexp_replace(F.concat(F.lit("/"), F.concat_ws("/", F.coalesce("_prefix", F.lit("")), "pattern")), "/+", "/")
    composed = routes.join(near, "path", "left").withColumn("pattern", F.when((full != "/"), F.regexp_replace(full, "/$", "")).otherwise(full))
    named = F.filter(F.split("pattern", "/"), lambda s: (s != "") & ~s.rlike(r"^[:{\[<*$(]|^v\d+$") & ~F.lower(s).isin(*sorted(NOISE)))
    first = F.regexp_replace(F.lower(F.try_element_at(named, F.lit(1))), "[^a-z0-9]+", "-")
    return composed.select("source", F.coalesce(first, F.regexp_replace(F.lower("module"), "[^a-z0-9]+", "-")).alias("name"), "path", "method", "pattern")


def mounted_django(hits: DataFrame) -> DataFrame:
    """Django urls with the prefixes of the files that include theirs, two levels deep."""
    urls = hits.where("source = 'django'")
    module = F.replace(F.regexp_replace("path", r"\.py$", ""), F.lit("/"), F.lit("."))
    mounts = hits.where("source = 'django-mount'").select(F.col("name").alias("of"), F.col("pattern").alias("prefix"), module.alias("by"))

    def ends(c: str) -> Column:
        """All ends of a module's name, by which another may include it."""
        parts = F.split(c, r"\.")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))

    outer = mounts.select(F.col("of").alias("_end"), F.col("prefix").alias("_outer"))
    two = mounts.withColumn("_end", F.explode(ends("by"))).join(outer, "_end").groupBy("of", "prefix", "by").agg(F.min("_outer").alias("_outer"))
    mounts = mounts.join(two, ["of", "prefix", "by"], "left").select(F.col("of").alias("_end"), F.regexp_replace(F.concat_ws("/", F.coalesce("_outer", F.lit("")), "prefix"), "/+", "/").alias("prefix")).distinct()
    named = urls.withColumn("_m", module)
    met = named.select("_m").distinct().withColumn("_end", F.explode(ends("_m"))).join(mounts, "_end").select("_m", "prefix").distinct()
    included = named.join(met, "_m", "left")
    full = F.regexp_replace(F.concat_ws("/", F.coalesce("prefix", F.lit("")), "pattern"), "/+", "/")
    pattern = F.when(full != "/", F.regexp_replace(full, "/$", "")).otherwise(full)
    return included.select("source", "name", "path", "method", F.when(F.startswith(pattern, F.lit("/")), pattern).otherwise(F.concat(F.lit("/"), pattern)).alias("pattern"))


def rust_crates(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Members of Cargo workspaces with their files: name, member, path. Patterns are matched at their own depth; a crate without a manifest bears its directory's name. files: path."""
    members = hits.where("source = 'cargo-member'").select(F.col("name").alias("entry"), F.col("pattern").alias("exclude"))
    depth = F.size(F.split("entry", "/"))
    patterned = members.withColumn("depth", depth)
    parts = F.split("path", "/")
    dirs = files.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("at", "dir")).where(F.size(parts) > 1)
    head = F.regexp_extract("entry", r"^((?:[^/*?\[]+/)*)", 1)

    def matches(dirs: pd.Series, entries: pd.Series) -> pd.Series:
        return pd.Series([fnmatch.fnmatchcase(d, e) for d, e in zip(dirs, entries, strict=True)])

    match = F.pandas_udf(matches, "boolean")
    home = F.regexp_replace(F.col("dir"), "[^/]+$", "")
    # a pattern meets directories of its depth below the part that is fixed
    keyed = patterned.select("entry", "exclude", (F.col("depth") - 1).alias("at"), F.when(F.col("entry").rlike(r"[*?\[]"), head).otherwise(F.regexp_replace("entry", "[^/]+$", "")).alias("head"))
    met = dirs.withColumn("head", home).join(keyed, ["at", "head"])
    own = met.where(F.when(F.col("entry").rlike(r"[*?\[]"), match("dir", "entry")).otherwise(F.col("dir") == F.col("entry")))
    kept = own.where(~F.exists(F.from_json("exclude", "array<string>"), lambda x: (F.col("dir") == x) | F.endswith("dir", F.concat(F.lit("/"), x))))
    named = hits.where("source = 'cargo-package'").select(F.col("name").alias("dir"), F.col("pattern").alias("crate"))
    return kept.select("path", "dir").distinct().join(named, "dir", "left").select(F.coalesce("crate", F.element_at(F.split("dir", "/"), -1)).alias("name"), F.col("dir").alias("member"), "path")


#: Confidence of a source: base, a step for each file, and the cap.
CONFIDENCE = {
    "route": (0.6, 0.05, 0.95), "approuter-keyless": (0.6, 0.05, 0.95), "mvc": (0.7, 0.05, 0.95), "express-route": (0.6, 0.05, 0.95), "fastify-route": (0.6, 0.05, 0.95),
    "go-package": (0.7, 0, 1), "rust-module": (0.7, 0, 1), "rails-routes": (0.95, 0, 1), "rails-models": (0.85, 0, 1), "rails-views": (0.8, 0, 1), "rails-jobs": (0.85, 0, 1),
    "rails-stimulus": (0.8, 0, 1), "config": (0.85, 0, 1), "jobs": (0.85, 0, 1), "server-api": (0.85, 0, 1), "spa-router": (0.8, 0, 1), "fastapi-route": (0.9, 0, 1), "django": (0.78, 0, 1),
}


def candidates(hits: DataFrame) -> DataFrame:
    """Anchors: source, name, paths, routes (their number) and confidence."""
    grouped = hits.groupBy("source", "name").agg(F.array_sort(F.collect_set("path")).alias("paths"), F.count("pattern").alias("routes"))
    n = F.size("paths")
    score = F.lit(0.75)
    for source, (base, step, cap) in CONFIDENCE.items():
        score = F.when(F.col("source") == source, F.least(F.lit(float(cap)), F.round(F.lit(float(base)) + n * F.lit(float(step)), 4))).otherwise(score)
    return grouped.withColumn("confidence", score)


# -- profiles ----------------------------------------------------------------------

#: Roles of files by profile: role, pattern, and the group that names the feature (0: none), the first that matches.
PROFILES: dict[str, tuple[tuple[str, str, int], ...]] = {
    "default": (),
    "next_app_router": (
        ("api", r"(?:^|/)app/(?:\([^/]+\)/)*api/([^/]+)/(?:.*/)?route\.[jt]sx?$", 1),
        ("page", r"(?:^|/)app/(?:\([^/]+\)/)*([^/()\[@_]+)/(?:.*/)?page\.[jt]sx?$", 1),
        ("page", r"(?:^|/)app/(?:\([^/]+\)/)*page\.[jt]sx?$", 0),
        ("layout", r"(?:^|/)app/(?:.*/)?(?:layout|template|loading|error|not-found)\.[jt]sx?$", 0),
        ("action", r"(?:^|/)actions?(?:\.[jt]s$|/)", 0),
        ("component", r"(?:^|/)components/(?:([^/]+)/)?[^/]+\.[jt]sx$", 1),
        ("lib", r"(?:^|/)(?:lib|utils|hooks|server)/", 0),
    ),
    "next_pages_react": (
        ("api", r"(?:^|/)pages/api/([^/.\[]+)", 1),
        ("layout", r"(?:^|/)pages/_(?:app|document|error)\.[jt]sx?$", 0),
        ("page", r"(?:^|/)pages/(?:index|([^/.\[]+))", 1),
        ("page", r"(?:^|/)(?:views|screens|containers)/([^/.]+)", 1),
        ("feature", r"(?:^|/)(?:features|modules)/([^/.]+)", 1),
        ("component", r"(?:^|/)components/(?:([^/]+)/)?[^/]+\.[jt]sx$", 1),
    ),
    "react_router_framework": (
        ("entry", r"(?:^|/)app/(?:root|entry\.(?:client|server))\.[jt]sx$", 0),
        ("page", r"(?:^|/)app/routes/(?:_[^/.]+[+.]?/?)?([a-z0-9-]+)[^/]*", 1),
        ("component", r"(?:^|/)app/components/(?:([^/]+)/)?[^/]+\.[jt]sx$", 1),
    ),
    "fastapi_family": (
        ("entry", r"(?:^|/)(?:main|app|asgi)\.py$", 0),
        ("api", r"(?:^|/)(?:routers?|endpoints|api/v\d+)/([a-z0-9_]+)\.py$", 1),
        ("api", r"(?:^|/)([a-z0-9_]+)/(?:router|routes|endpoints)\.py$", 1),
        ("service", r"(?:^|/)(?:services|crud)/([a-z0-9_]+)\.py$", 1),
        ("schema", r"(?:^|/)(?:schemas|models)/([a-z0-9_]+)\.py$", 1),
    ),
    "django": (
        ("entry", r"(?:^|/)(?:manage|wsgi|asgi)\.py$", 0),
        ("migration", r"(?:^|/)([a-z0-9_]+)/migrations/[^/]+\.py$", 1),
        ("urls", r"(?:^|/)([a-z0-9_]+)/urls\.py$", 1),
        ("view", r"(?:^|/)([a-z0-9_]+)/(?:views|viewsets|api)(?:\.py$|/)", 1),
        ("model", r"(?:^|/)([a-z0-9_]+)/models(?:\.py$|/)", 1),
        ("admin", r"(?:^|/)([a-z0-9_]+)/admin\.py$", 1),
        ("app", r"(?:^|/)([a-z0-9_]+)/(?:apps|forms|serializers|tasks|signals)\.py$", 1),
    ),
}


def _rule_columns(profile: str) -> tuple[Column, Column]:
    path = F.col("path")
    role, feature = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for name, pattern, group in PROFILES[profile]:
        hit = path.rlike(pattern)
        role = role.when(hit, name)
        word = F.regexp_replace(F.lower(F.regexp_extract(path, pattern, group)), "[^a-z0-9]+", "-") if group else F.lit("")
        feature = feature.when(hit, F.when(word.isin("", *sorted(NOISE)), F.lit(None).cast("string")).otherwise(word))
    return role.otherwise("other"), feature.otherwise(F.lit(None).cast("string"))


def file_roles(files: DataFrame, profile: str) -> DataFrame:
    """path, role and feature of each file by a profile; tests have the role test, and the default profile knows no roles. files: path."""
    role, feature = _rule_columns(profile)
    test = is_test_path("path") if profile != "default" else F.lit(False)
    return files.select("path", F.when(test, "test").otherwise(role).alias("role"), F.when(test, F.lit(None).cast("string")).otherwise(feature).alias("feature"))


def profile_scores(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Profiles by the share of files that they give a role, best first; the default has the floor of 0.01. files: path (and by)."""
    by = by or []
    each = None
    for name in PROFILES:
        role, _ = _rule_columns(name)
        own = files.groupBy(*by).agg(F.round(F.count_if(role != "other") / F.count("*"), 4).alias("score")).select(*by, F.lit(name).alias("profile"), F.when(F.lit(name) == "default", 0.01).otherwise(F.col("score")).alias("score"))
        each = own if each is None else each.unionByName(own)
    return each


def composite_roles(files: DataFrame, units: DataFrame) -> DataFrame:
    """path, unit, profile, role and feature: each file by the profile of the deepest unit above it, else the default. units: root, profile."""
    parts = F.split("path", "/")
    roots = F.concat(F.array(F.lit("")), F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>")))
    placed = files.select("path", F.explode(roots).alias("root")).join(units, "root").groupBy("path").agg(F.max_by(F.struct("root", "profile"), F.length("root")).alias("x"))
    whole = files.select("path").join(placed, "path", "left").select("path", F.col("x.root").alias("unit"), F.coalesce("x.profile", F.lit("default")).alias("profile"))
    role, feature = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for name in PROFILES:
        r, f = _rule_columns(name)
        role, feature = role.when(F.col("profile") == name, r), feature.when(F.col("profile") == name, f)
    test = is_test_path("path") & (F.col("profile") != "default")
    return whole.select("path", "unit", "profile", F.when(test, "test").otherwise(role).alias("role"), F.when(test, F.lit(None).cast("string")).otherwise(feature).alias("feature"))
