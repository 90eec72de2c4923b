"""Routes with all that they are mounted under, however deep: a graph of routers that is closed by joins.

Each file is read once, for facts: routers and their own prefixes, routes, mounts, imports and exports. The rest is
tables: a mounted name is followed through imports and exports to the router that it means, mounts become edges
between routers, and prefixes run from the routers that nothing mounts to those below, a level a round, until no
router is left. A chain never comes back to a router that it has passed, so circles end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import _folded
from .scripts import SCRIPTS, Scan

FACT = "path string, kind string, router string, name string, prefix string, target string"
UNIT, ROUTE, MOUNT, IMPORT, EXPORT = "unit", "route", "mount", "import", "export"
#: How many imports and exports a name is followed through.
MOST_HOPS = 8
_NAME = r"[A-Za-z_$][\w$]*"
_VERBS = "get|post|put|patch|delete|head|options|all"


# -- facts -------------------------------------------------------------------------


def _brace_names(inner: str, colon: bool) -> Iterator[tuple[str, str]]:
    """(name outside, name inside) of a braced list."""
    for part in inner.split(","):
        m = re.match(rf"\s*({_NAME})\s*(?:{':' if colon else 'as'}\s*({_NAME}))?\s*$", part)
        if m:
            yield m[1], m[2] or m[1]


def _script_facts(path: str, text: str) -> Iterator[tuple]:
    scan = Scan(text)
    code = scan.bare
    literal = lambda at: scan.literal(at)
    units = set(re.findall(rf"\b({_NAME})\s*(?::[^=;\n]+)?=\s*(?:express\s*\(\s*\)|(?:express\s*\.\s*)?Router\s*\()", code)) | {n for n in ("app", "router") if re.search(rf"\b{n}\s*\.\s*(?:use|route|{_VERBS})\s*\(", code)}
    for u in sorted(units):
        yield path, UNIT, u, None, "", None
        yield path, EXPORT, u, u if re.search(rf"\bexport\s+(?:const|let|var)\s+{re.escape(u)}\b", code) else None, None, None
    for m in re.finditer(rf"\b({_NAME})\s*\.\s*({_VERBS})\s*\(\s*(['\"`])", code):
        if m[1] in units and (at := literal(m.start(3))) is not None and at[:1] in ("/", "*", ""):
            yield path, ROUTE, m[1], m[2].upper(), at, None
    for m in re.finditer(rf"\b({_NAME})\s*\.\s*route\s*\(\s*(['\"`])", code):
        at = literal(m.start(2))
        end = scan.pairs.get(code.index("(", m.start()), m.end())
        chain = re.compile(rf"\s*\.\s*({_VERBS})\s*\(")
        while m[1] in units and at is not None and (v := chain.match(code, end + 1)):
            yield path, ROUTE, m[1], v[1].upper(), at, None
            end = scan.pairs.get(v.end() - 1, v.end())
    for m in re.finditer(rf"\b({_NAME})\s*\.\s*use\s*\(", code):
        if m[1] not in units:
            continue
        end = scan.pairs.get(m.end() - 1, len(code))
        first = re.compile(r"\s*(['\"`])").match(code, m.end())
        prefix = (literal(first.start(1)) or "") if first else ""
        last = re.search(rf"(?:^|[,(\s])(?:require\s*\(\s*(['\"`])\s*\1\s*\)|({_NAME}(?:\s*\.\s*{_NAME})?))\s*,?\s*$", code[m.end() : end])
        spec = re.search(r"require\s*\(\s*(['\"`])[^()]*\)\s*,?\s*$", code[m.end() : end])
        if spec:
            name = f"require:{literal(m.end() + spec.start(1))}"
            yield path, IMPORT, None, name, None, f"{literal(m.end() + spec.start(1))}#default"
            yield path, MOUNT, m[1], re.sub(r"\s", "", name), prefix, None
        elif last and last[2]:
            yield path, MOUNT, m[1], re.sub(r"\s", "", last[2]), prefix, None
    for m in re.finditer(rf"\bimport\s+(?:({_NAME})\s*,?\s*)?(?:\{{([^}}]*)\}}|\*\s*as\s+({_NAME}))?\s*from\s*(['\"])", code):
        spec = literal(m.start(4))
        if m[1]:
            yield path, IMPORT, None, m[1], None, f"{spec}#default"
        for out, own in _brace_names(m[2] or "", False):
            yield path, IMPORT, None, own, None, f"{spec}#{out}"
        if m[3]:
            yield path, IMPORT, None, m[3], None, f"{spec}#*"
    for m in re.finditer(rf"\b(?:const|let|var)\s+(?:({_NAME})|\{{([^}}]*)\}})\s*=\s*require\s*\(\s*(['\"])", code):
        spec = literal(m.start(3))
        if m[1]:
            yield path, IMPORT, None, m[1], None, f"{spec}#default"
        for out, own in _brace_names(m[2] or "", True):
            yield path, IMPORT, None, own, None, f"{spec}#{out}"
    for m in re.finditer(rf"\bexport\s+default\s+({_NAME})\b|\bmodule\.exports\s*=\s*({_NAME})\b", code):
        yield path, EXPORT, m[1] or m[2], "default", None, None
    for m in re.finditer(r"\bexport\s*\{([^}]*)\}(\s*from\s*(['\"]))?", code):
        for inner, out in _brace_names(m[1], False):
            if m[2]:
                yield path, IMPORT, None, f"re:{out}", None, f"{literal(m.start(3))}#{inner}"
            yield path, EXPORT, f"re:{out}" if m[2] else inner, out, None, None
    for m in re.finditer(r"\bmodule\.exports\s*=\s*\{([^}]*)\}", code):
        for out, own in _brace_names(m[1], True):
            yield path, EXPORT, own, out, None, None
    for m in re.finditer(rf"\bexports\.({_NAME})\s*=\s*({_NAME})\b", code):
        yield path, EXPORT, m[2], m[1], None, None


_QUOTED = r"[rR]?['\"]([^'\"]*)['\"]"


def _python_facts(path: str, text: str) -> Iterator[tuple]:
    for m in re.finditer(r"(?m)^from\s+(\.*[\w.]*)\s+import\s+(\([^)]*\)|[^\n#]+)", text):
        for part in m[2].strip("() \n").split(","):
            if n := re.match(r"\s*(\w+)(?:\s+as\s+(\w+))?\s*$", part):
                yield path, IMPORT, None, n[2] or n[1], None, f"{m[1]}#{n[1]}"
    for m in re.finditer(r"(?m)^import\s+([\w.]+)(?:\s+as\s+(\w+))?", text):
        yield path, IMPORT, None, m[2] or m[1], None, f"{m[1]}#*"
    units = {}
    for m in re.finditer(r"(?m)^\s*(\w+)\s*(?::\s*[\w.]+\s*)?=\s*(?:fastapi\.)?(?:APIRouter|FastAPI)\(((?:[^()]|\([^()]*\))*)\)", text):
        p = re.search(r"\bprefix\s*=\s*" + _QUOTED, m[2])
        units[m[1]] = p[1] if p else ""
    for u, prefix in units.items():
        yield path, UNIT, u, None, prefix, None
        yield path, EXPORT, u, u, None, None
    for m in re.finditer(r"@(\w+)\.(get|post|put|patch|delete|head|options|websocket)\(\s*" + _QUOTED, text):
        if m[1] in units:
            yield path, ROUTE, m[1], m[2].upper(), m[3], None
    for m in re.finditer(r"\b(\w+)\.include_router\(\s*([\w.]+)((?:[^()]|\([^()]*\))*)\)", text):
        p = re.search(r"\bprefix\s*=\s*" + _QUOTED, m[3])
        if m[1] in units:
            yield path, MOUNT, m[1], m[2], p[1] if p else "", None
    if not re.search(r"\burlpatterns\b", text):
        return
    lists = [(m[1], m.end()) for m in re.finditer(r"(?m)^(\w+)\s*(?::[^=\n]+)?\+?=\s*(?:\w+\()?\[", text)]
    of = lambda at: next((n for n, begin in reversed(lists) if begin <= at), "urlpatterns")
    for n in dict.fromkeys(["urlpatterns", *(n for n, _ in lists)]):
        yield path, UNIT, n, None, "", None
        yield path, EXPORT, n, n, None, None
    for m in re.finditer(r"\b(?:path|re_path|url)\(\s*" + _QUOTED + r"\s*,\s*(include\(\s*\(?\s*(?:" + _QUOTED + r"|([\w.]+)))?", text):
        at = re.sub(r"\(\?P(<\w+>)[^)]*\)", r"\1", m[1].strip("^$"))
        if m[3]:
            yield path, IMPORT, None, f"include:{m[3]}", None, f"{m[3]}#*"
            yield path, MOUNT, of(m.start()), f"include:{m[3]}.urlpatterns", at, None
        elif m[4]:
            yield path, MOUNT, of(m.start()), m[4].removesuffix(".urls"), at, None
        elif not m[2]:
            yield path, ROUTE, of(m.start()), "URL", at, None
    for r in dict.fromkeys(re.findall(r"(?m)^(\w+)\s*=\s*(?:routers\.)?\w*Router\(", text)):
        yield path, UNIT, r, None, "", None
        for m in re.finditer(rf"\b{r}\.register\(\s*" + _QUOTED, text):
            yield path, ROUTE, r, "REST", m[1], None


_RAILS_LINE = re.compile(
    r"^\s*(?P<word>namespace|scope|resources|resource|get|post|put|patch|delete|member|collection|concern|constraints|authenticate|defaults|Rails\.application\.routes\.draw)\b\s*\(?\s*(?P<rest>[^\n]*?)\s*(?P<do>\bdo\b(?:\s*\|[^|]*\|)?)?\s*$"
)


def _rails_facts(path: str, text: str) -> Iterator[tuple]:
    """Blocks are routers that their lines mount; a resource's block stands under one of its members."""
    stack, n = ["0"], 0
    yield path, UNIT, "0", None, "", None
    for line in re.sub(r"(?m)#.*$", "", text).split("\n"):
        if re.match(r"\s*end\b", line):
            stack = stack[:-1] or ["0"]
            continue
        m = _RAILS_LINE.match(line)
        opened = re.search(r"\bdo\b(?:\s*\|[^|]*\|)?\s*$", line)
        if not m:
            if opened:
                stack.append(stack[-1])
            continue
        word, rest = m["word"], m["rest"]
        names = re.findall(r"(?:^|,)\s*:(\w+)", rest.split("=>")[0])
        given = re.search(r"\bpath:\s*['\"]([^'\"]*)['\"]", rest)
        quoted = re.match(r"['\"]([^'\"]*)['\"]", rest)
        here, at = stack[-1], ""
        if word == "namespace" and (names or quoted):
            at = given[1] if given else names[0] if names else quoted[1]
        elif word == "scope":
            at = given[1] if given else quoted[1] if quoted else names[0] if names else ""
        elif word in ("resources", "resource") and names:
            for name in names:
                shown = given[1] if given else name
                yield path, ROUTE, here, word.upper(), shown, None
                if word == "resources":
                    yield path, ROUTE, here, "RESOURCE", f"{shown}/:id", None
            one = names[-1][:-1] if names[-1].endswith("s") and not names[-1].endswith("ss") else names[-1]
            at = (given[1] if given else names[-1]) + (f"/:{one}_id" if word == "resources" else "")
        elif word in ("get", "post", "put", "patch", "delete") and (names or quoted):
            yield path, ROUTE, here, word.upper(), quoted[1] if quoted else names[0], None
        if opened:
            n += 1
            if word == "member":  # the members of the resource around it
                yield path, UNIT, str(n), None, "", None
                yield path, MOUNT, here, str(n), "", None
            else:
                yield path, UNIT, str(n), None, "", None
                yield path, MOUNT, here, str(n), at, None
            stack.append(str(n))


def router_facts(files: DataFrame) -> DataFrame:
    """What each file says of routers. files: path, text."""

    def facts(path: str, text: str) -> Iterator[tuple]:
        if path.endswith(".py"):
            return _python_facts(path, text)
        return _rails_facts(path, text) if path.endswith(".rb") else _script_facts(path, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, t in zip(batch.path, batch.text, strict=True) for r in facts(p, t)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACT.split(", ")])

    takes = F.col("path").rlike(SCRIPTS) | F.endswith("path", F.lit(".py")) | F.col("path").rlike(r"(?:^|/)config/routes(?:\.rb|/.*\.rb)$")
    return files.where(takes & F.col("text").isNotNull()).select("path", "text").mapInPandas(run, FACT)


# -- names to routers --------------------------------------------------------------


def _spec_paths(spec: Column, path: Column) -> Column:
    """Files that a module's name may mean, in order."""
    home = F.regexp_extract(path, "^(.*/)[^/]*$", 1)
    script = _folded(F.concat(home, spec))
    scripts = F.transform(F.array(*[F.lit(x) for x in ("", ".ts", ".js", ".tsx", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.js")]), lambda x: F.concat(script, x))
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    inner = F.replace(F.regexp_replace(spec, r"^\.+", ""), F.lit("."), F.lit("/"))
    dirs = F.split(F.regexp_replace(path, "/?[^/]*$", ""), "/")
    dirs = F.filter(dirs, lambda x: x != "")
    up = F.array_join(F.slice(dirs, F.lit(1), F.greatest(F.size(dirs) - dots + 1, F.lit(0))), "/")
    # an absolute module is looked for from the importer's own directory up to the root
    bases = F.when(dots > 0, F.array(up)).otherwise(F.transform(F.sequence(F.size(dirs), F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(dirs, F.lit(1), i), "/")))
    stems = F.transform(bases, lambda b: F.concat_ws("/", F.nullif(b, F.lit("")), F.nullif(inner, F.lit(""))))
    python = F.flatten(F.transform(stems, lambda s: F.array(F.concat(s, F.lit(".py")), F.concat(s, F.lit("/__init__.py")))))
    return F.when(F.endswith(path, F.lit(".py")), python).otherwise(scripts)


def _imports(facts: DataFrame, files: DataFrame) -> DataFrame:
    """path, name, to_path and to_name (``*``: the module itself) of the imports of files that exist."""
    own = facts.where(F.col("kind") == IMPORT).select("path", "name", F.substring_index("target", "#", 1).alias("spec"), F.substring_index("target", "#", -1).alias("what")).distinct()
    local = own.where(F.startswith("spec", F.lit(".")) | F.endswith("path", F.lit(".py")))
    # a name that a package gives may be a module of it
    module = local.where(F.endswith("path", F.lit(".py")) & (F.col("what") != "*"))
    below = module.select("path", "name", F.when(F.col("spec").rlike(r"^\.+$"), F.concat("spec", "what")).otherwise(F.concat_ws(".", "spec", "what")).alias("spec"), F.lit("*").alias("what"))
    asked = local.unionByName(below).withColumn("exact", F.col("what") != "*")
    each = asked.select("path", "name", "what", "exact", F.posexplode(_spec_paths(F.col("spec"), F.col("path"))).alias("nth", "to_path"))
    met = each.join(files.select(F.col("path").alias("to_path")).distinct(), "to_path")
    # a module of that name comes before a name in the package
    return met.groupBy("path", "name").agg(F.min(F.struct("exact", "nth", "to_path", "what")).alias("x")).select("path", "name", "x.to_path", F.col("x.what").alias("to_name"))


def mount_edges(facts: DataFrame, files: DataFrame) -> DataFrame:
    """path, router, prefix, to_path and to_router of every mount whose name is followed to a router."""
    facts = facts.checkpoint()
    units = facts.where(F.col("kind") == UNIT).select("path", "router").distinct()
    imports = _imports(facts, files).checkpoint()
    exports = facts.where((F.col("kind") == EXPORT) & F.col("name").isNotNull()).select("path", "name", "router").distinct()
    mounts = facts.where(F.col("kind") == MOUNT).select("path", "router", "prefix", "name").distinct().checkpoint()
    # at: the file in which a name is looked up; member: what is asked of the module that the name may be
    split = F.when(F.startswith("name", F.lit("include:")), F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)).otherwise(F.when(F.startswith("name", F.lit("require:")), F.col("name")).otherwise(F.regexp_replace("name", r"\.[^.]*$", "")))
    member = F.when(F.startswith("name", F.lit("require:")), F.lit(None)).when(F.contains("name", F.lit(".")), F.substring_index("name", ".", -1))
    asked = mounts.select("path", "router", "prefix", F.col("path").alias("at"), split.alias("local"), member.alias("member")).checkpoint()
    found = None
    for _ in range(MOST_HOPS):
        direct = asked.where("member is null").join(units.select(F.col("path").alias("at"), F.col("router").alias("local")), ["at", "local"]).select("path", "router", "prefix", F.col("at").alias("to_path"), F.col("local").alias("to_router"))
        found = direct if found is None else found.unionByName(direct)
        away = asked.join(imports.select(F.col("path").alias("at"), F.col("name").alias("local"), "to_path", "to_name"), ["at", "local"])
        whole = away.withColumn("want", F.when(F.col("to_name") == "*", F.col("member")).otherwise(F.col("to_name"))).where("want is not null")
        rest = F.when(F.col("to_name") == "*", F.lit(None).cast("string")).otherwise(F.col("member"))
        given = whole.select("path", "router", "prefix", "to_path", "want", rest.alias("member")).join(exports.select(F.col("path").alias("to_path"), F.col("name").alias("want"), F.col("router").alias("local")), ["to_path", "want"])
        # an object that is exported whole gives its parts by name
        part = away.where("to_name = 'default' and member is not null").select("path", "router", "prefix", "to_path", F.col("member").alias("want")).join(exports.select(F.col("path").alias("to_path"), F.col("name").alias("want"), F.col("router").alias("local")), ["to_path", "want"])
        asked = given.select("path", "router", "prefix", F.col("to_path").alias("at"), "local", "member").unionByName(part.select("path", "router", "prefix", F.col("to_path").alias("at"), "local", F.lit(None).cast("string").alias("member"))).distinct().checkpoint()
        if asked.isEmpty():
            break
    return found.where("not (path = to_path and router = to_router)").distinct()


# -- closure -----------------------------------------------------------------------


def _below(prefix: Column, more: Column) -> Column:
    """A path under a prefix; neither doubled nor final slashes stay."""
    joined = F.regexp_replace(F.concat_ws("/", F.lit(""), F.coalesce(prefix, F.lit("")), F.coalesce(more, F.lit(""))), "/+", "/")
    return F.when(joined == "/", joined).otherwise(F.regexp_replace(joined, "/$", ""))


def mounted_routes(files: DataFrame) -> DataFrame:
    """Routes with the prefixes of all that they are mounted under: path, router, method, pattern and depth, once for each way to a router.

    files: path, text. A router that nothing mounts stands at the root; what only a circle reaches has no way and gives no route.
    """
    facts = router_facts(files).checkpoint()
    edges = mount_edges(facts, files).checkpoint()
    units = facts.where(F.col("kind") == UNIT).groupBy("path", "router").agg(F.max("prefix").alias("own"))
    mounted = edges.select(F.col("to_path").alias("path"), F.col("to_router").alias("router")).distinct()
    key = F.concat_ws("#", "path", "router")
    front = units.join(mounted, ["path", "router"], "left_anti").select("path", "router", _below(F.lit(""), F.col("own")).alias("full"), F.array(key).alias("chain")).checkpoint()
    ways = front
    below = edges.join(units.select(F.col("path").alias("to_path"), F.col("router").alias("to_router"), F.col("own").alias("to_own")), ["to_path", "to_router"]).checkpoint()
    while True:
        to = F.concat_ws("#", "to_path", "to_router")
        onward = front.join(below, ["path", "router"]).where(~F.array_contains("chain", to))
        front = onward.select(F.col("to_path").alias("path"), F.col("to_router").alias("router"), _below(_below(F.col("full"), F.col("prefix")), F.col("to_own")).alias("full"), F.concat("chain", F.array(to)).alias("chain")).distinct().checkpoint()
        if front.isEmpty():
            break
        ways = ways.unionByName(front)
    routes = facts.where(F.col("kind") == ROUTE).select("path", "router", F.col("name").alias("method"), F.col("prefix").alias("own"))
    return routes.join(ways, ["path", "router"]).select("path", "router", "method", _below(F.col("full"), F.col("own")).alias("pattern"), (F.size("chain") - 1).alias("depth")).distinct()
