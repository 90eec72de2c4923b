"""Call and symbol graphs, links across the network and through stores, and what lies inside symbols and pages."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions.text import is_generated, is_test_path
from ..sources.scripts import SCANNED, SCRIPTS, Scan, read_script
from .keep import kept
from .routes import network_calls

MOST_DEPTH = 4
CROSS_DEPTH = 1
STRETCH = 64
MOST_NODES = 80
#: Words before a round bracket that call nothing.
NO_CALLS = frozenset(
    (
        "if", "for", "while", "switch", "catch", "return", "function", "typeof", "new", "await", "super", "import", "require", "async", "of", "in",
        "do", "else", "yield", "delete", "void",
    )
)

# -- confidence --------------------------------------------------------------------


def import_confidence(resolver: str | Column) -> Column:
    r = F.col(resolver) if isinstance(resolver, str) else resolver
    return F.when(r.isin("static", "alias", "monorepo"), "high").when(r == "regex", "medium").otherwise("low")


def call_confidence(resolved: Column, same_file: Column) -> Column:
    return F.when(resolved & ~same_file, "high").when(resolved, "medium").otherwise("low")


def cross_confidence(literal: Column, interpolated: Column) -> Column:
    return F.when(literal & ~interpolated, "high").when(literal, "medium").otherwise("low")


def closure_confidence(depth: str | Column) -> Column:
    """Of a member found ``depth`` imports away."""
    return 1 / (1 + F.col(depth) if isinstance(depth, str) else 1 + depth)


# -- calls -------------------------------------------------------------------------


def _script_calls(path: str, scan: Scan, spans: list[tuple]) -> Iterator[tuple]:
    inmost: dict[int, tuple] = {}  # symbol around each line: wider spans are painted over by those within
    for d in sorted((d for d in spans if d[0] != "const"), key=lambda d: (d[2] - d[3], d[1])):
        for k in range(d[2], d[3] + 1):
            inmost[k] = d
    for m in re.finditer(r"(?<![\w$.])(?:([A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>)?\(|<\s*([A-Z][\w$]*)(?=[\s/>]))", scan.bare):
        name = m[1] or m[2]
        if name in NO_CALLS:
            continue
        line = scan.line(m.start())
        if re.search(r"(?:function\s*\*?|class)\s*$", scan.bare[max(0, m.start() - 20) : m.start()]):
            continue
        inner = inmost.get(line)
        if inner and (inner[1] != name or line != inner[2]):
            yield path, inner[1], name, line


def _python_calls(path: str, text: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError):
        return

    def walk(node: ast.AST, owner: str | None) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.Call) and owner:
                f = child.func
                if isinstance(f, ast.Name):
                    yield path, owner, f.id, child.lineno
                elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
                    yield path, owner, f.attr if f.value.id in ("self", "cls") else f"{f.value.id}.{f.attr}", child.lineno
            named = isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef))
            yield from walk(child, child.name if named and owner is None or named and isinstance(node, ast.ClassDef) else owner)

    yield from walk(tree, None)


def calls(files: DataFrame) -> DataFrame:
    """Call sites: path, caller (the innermost symbol around), callee, line. files: path, text; tests and generated files are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, t in zip(batch.path, batch.text, strict=True) for r in _read(p, t)[1]]
            yield pd.DataFrame(rows, columns=["path", "caller", "callee", "line"])

    return files.where(_has_calls()).select("path", "text").mapInPandas(run, "path string, caller string, callee string, line int")


def _has_calls() -> Column:
    return (F.endswith("path", F.lit(".py")) | F.col("path").rlike(SCRIPTS)) & ~is_test_path("path") & ~is_generated("path")


def _read(path: str, text: str | None, called: bool = True) -> tuple[dict[str, list[tuple]], Iterator[tuple]]:
    """What ``read_script`` tells and the call sites, by one scan."""
    if path.endswith(".py"):
        return {"defs": [], "imports": [], "exports": []}, _python_calls(path, text)
    scan = Scan(text or "")
    found = read_script(text or "", scan)
    return found, _script_calls(path, scan, found["defs"]) if called else iter(())


def scan_calls(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``scan_scripts`` gives, and path, caller and callee of ``calls``, each once a file: every text is scanned once for both, and the result is written down."""
    schema = to_arrow_schema(T.StructType.fromDDL(f"{SCANNED}, calls array<struct<caller:string,callee:string>>, script boolean"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [_read(p, t, c) for p, t, c in zip(*(batch.column(c).to_pylist() for c in ("path", "text", "called")), strict=True)]
            found = [{**f, "calls": sorted({s[1:3] for s in sites})} for f, sites in read]
            made = [pa.array([f[k.name] for f in found], k.type) for k in list(schema)[1:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("path").cast(schema.field("path").type), *made, batch.column("script")], schema=schema)

    script = F.col("path").rlike(SCRIPTS) & ~F.col("path").rlike(r"\.d\.[cm]?ts$")
    sources = files.select("path", "text", script.alias("script"), _has_calls().alias("called")).where("script or called")
    both = kept(sources.mapInArrow(run, f"{SCANNED}, calls array<struct<caller:string,callee:string>>, script boolean"))
    return both.where("script").select("path", "defs", "imports", "exports"), both.select("path", F.explode("calls").alias("x")).select("path", "x.*")


def call_edges(sites: DataFrame, definitions: DataFrame, imported: DataFrame) -> DataFrame:
    """path, caller, to_path, callee, cross and confidence.

    sites as of ``calls``; definitions: path, name; imported: importer, local, target, original. A name is the
    file's own symbol, else what it imports under that name.
    """
    key = ["path", "callee"]
    # all three meet by the name in a file, callers go along as a set
    asked = sites.groupBy(*key).agg(F.collect_set("caller").alias("callers"))
    own = definitions.select("path", F.col("name").alias("callee")).distinct().withColumn("own", F.lit(True))
    names = imported.select(F.col("importer").alias("path"), F.col("local").alias("callee"), "target", "original").where("target is not null")
    met = asked.join(own, key, "left").join(names, key, "left").where("own or target is not null").withColumn("caller", F.explode("callers"))
    to = lambda mine, other: F.when(F.col("own"), F.col(mine)).otherwise(F.col(other))
    each = met.select("path", "caller", to("path", "target").alias("to_path"), to("callee", "original").alias("callee"), F.col("own").isNull().alias("cross"))
    both = each.where("not (path = to_path and caller = callee)").distinct()
    return both.withColumn("confidence", call_confidence(F.lit(True), ~F.col("cross")))


def call_graph(edges: DataFrame, entries: DataFrame, depth: int = MOST_DEPTH, cross_depth: int = CROSS_DEPTH, most: int = MOST_NODES) -> DataFrame:
    """Symbols that each flow reaches: flow, path, symbol, depth, kind (entry, call, import or deep_call_subtree).

    entries: flow, path, symbol. Calls within a file are followed ``depth`` deep, those into another file
    only from nodes less than ``cross_depth`` deep. Beyond ``most`` nodes, by depth and name, one row stands for the rest.
    """
    seen = kept(entries.select("flow", "path", "symbol", F.lit(0).alias("depth"), F.lit("entry").alias("kind")).distinct())
    frontier, steps = seen, kept(edges.select("path", F.col("caller").alias("symbol"), "to_path", "callee", "cross"))
    for d in range(1, depth + 1):
        near = steps if d <= cross_depth else steps.where("not cross")
        found = frontier.select("flow", "path", "symbol").join(near, ["path", "symbol"]).groupBy("flow", F.col("to_path").alias("path"), F.col("callee").alias("symbol")).agg(F.min("cross").alias("cross"))
        fresh = found.join(seen.select("flow", "path", "symbol"), ["flow", "path", "symbol"], "left_anti")
        frontier = kept(fresh.select("flow", "path", "symbol", F.lit(d).alias("depth"), F.when(F.col("cross"), "import").otherwise("call").alias("kind")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    nth = F.row_number().over(Window.partitionBy("flow").orderBy("depth", "path", "symbol"))
    # the first beyond is the least deep of the rest, so it stands for them
    ranked = seen.withColumn("_nth", nth).where(F.col("_nth") <= most + 1)
    whole = F.col("_nth") <= most
    return ranked.select("flow", F.when(whole, F.col("path")).alias("path"), F.when(whole, F.col("symbol")).alias("symbol"), "depth", F.when(whole, F.col("kind")).otherwise("deep_call_subtree").alias("kind"))


def participants(graph: DataFrame, definitions: DataFrame) -> DataFrame:
    """Lines of the symbols of each flow: flow, path, symbol, start, end, depth, role. definitions: path, name, start, end."""
    spans = definitions.groupBy("path", F.col("name").alias("symbol")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return graph.where("kind <> 'deep_call_subtree'").join(spans, ["path", "symbol"]).select("flow", "path", "symbol", "start", "end", "depth", F.when(F.col("depth") == 0, "entry").otherwise("support").alias("role"))


# -- over the network --------------------------------------------------------------

def client_calls(files: DataFrame) -> DataFrame:
    """caller and url of network calls; absolute urls lose their host."""
    sites = network_calls(files).select("caller", "url").distinct()
    bare = F.regexp_replace("url", r"^https?://[^/]+", "")
    return sites.select("caller", F.when((bare == "") | bare.isNull(), "/").otherwise(bare).alias("url")).distinct()


def _pattern(pattern: Column) -> Column:
    """A route with its open segments as stars."""
    out = F.regexp_replace(pattern, r"/+$", "")
    for p in (r"\[\.\.\.[^\]]+\]", r"\[[^\]]+\]", r"\{[^}]+\}", r":[A-Za-z_][A-Za-z0-9_]*"):
        out = F.regexp_replace(out, p, "*")
    return F.when(out == "", "/").otherwise(out)


def _fixed_words(c: str) -> Column:
    return F.array_distinct(F.filter(F.split(c, "/"), lambda s: (s != "") & ~F.contains(s, F.lit("*"))))


def cross_stack(sites: DataFrame, routes: DataFrame) -> DataFrame:
    """Routes that network calls reach: caller, url, pattern, method, handler, confidence.

    sites: caller, url; routes: pattern, method, handler. A url matches an equal route, or one whose fixed head is the
    url's, whole segments each; a template matches a route that has its fixed parts in order. All are
    equi-joins: by the route, by each head of the url, by the template's rarest fixed word.
    """
    template = F.contains("url", F.lit("${"))
    a = sites.withColumn("template", template).withColumn("u", F.regexp_replace(F.regexp_replace(F.regexp_replace("url", r"\$\{[^}]*\}", "*"), r"[?#].*$", ""), "(?<=.)/+$", "")).checkpoint()  # read by each way to match
    b = routes.withColumn("p", _pattern(F.col("pattern"))).checkpoint()
    plain = a.where("not template")
    exact = plain.join(b, plain["u"] == b["p"])
    parts = F.split("u", "/")
    heads = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    head = F.regexp_replace(F.substring_index("p", "*", 1), "/+$", "")
    open_ = b.withColumn("_head", head).where(F.contains("p", F.lit("*")) & (head != ""))
    by_head = plain.withColumn("_head", F.explode(F.array_distinct(heads))).join(open_, "_head")
    # a template meets routes by the rarest of its fixed words
    by_word = b.withColumn("_w", F.explode(_fixed_words("p")))
    rarity = by_word.groupBy("_w").agg(F.count("*").alias("_df"))
    worded = a.where("template").withColumn("_w", F.explode(_fixed_words("u"))).join(rarity, "_w", "left")
    # a word that no route has: no route matches, so null stands for it and joins nothing
    rarest = worded.groupBy("caller", "url", "template", "u").agg(F.when(F.bool_and(F.col("_df").isNotNull()), F.min_by("_w", F.struct("_df", "_w"))).alias("_w"))
    met = rarest.join(by_word, "_w")
    chunks = F.filter(F.transform(F.split("u", r"\*"), lambda x: F.regexp_replace(x, "/+$", "")), lambda x: x != "")
    rest = F.aggregate(chunks, F.col("p"), lambda left, x: F.when(left.isNull() | ~F.contains(left, x), F.lit(None).cast("string")).otherwise(F.substring(left, F.instr(left, x) + F.length(x), F.length(left))))
    in_order = met.where(rest.isNotNull())
    cols = ["caller", "url", "pattern", "method", "handler", "template"]
    hit = exact.select(*cols).unionByName(by_head.select(*cols)).unionByName(in_order.select(*cols))
    return hit.withColumn("confidence", cross_confidence(F.lit(True), F.col("template"))).drop("template").distinct()


def reverse_cross_stack(sites: DataFrame, routes: DataFrame) -> DataFrame:
    """Callers of each route: handler, pattern, callers, their number."""
    return cross_stack(sites, routes).groupBy("handler", "pattern").agg(F.array_sort(F.collect_set("caller")).alias("files")).select("handler", "pattern", F.array_join("files", ",").alias("callers"), F.size("files").alias("n"))


# -- framework links ---------------------------------------------------------------


def server_actions(files: DataFrame) -> DataFrame:
    """Exported functions of files that begin with the directive, or functions with the directive as their first line: path, name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.path, batch.text, strict=True):
                bare = re.sub(r"\A(?:\s|//[^\n]*\n|/\*.*?\*/)*", "", text or "", flags=re.S)
                defs = read_script(text or "")["defs"]
                if re.match(r"['\"]use server['\"]", bare):
                    rows += [(path, d[1]) for d in defs if d[5] and d[0] in ("function", "const", "component")]
                else:
                    lines = (text or "").split("\n")
                    rows += [(path, d[1]) for d in defs if d[0] in ("function", "component") and any(re.match(r"\s*['\"]use server['\"]", x) for x in lines[d[2] : d[2] + 1])]
            yield pd.DataFrame(rows, columns=["path", "name"])

    return files.where(F.col("path").rlike(SCRIPTS) & F.contains("text", F.lit("use server"))).select("path", "text").mapInPandas(run, "path string, name string").distinct()


def action_links(files: DataFrame, imported: DataFrame, sites: DataFrame) -> DataFrame:
    """Calls of server actions from other files, and actions that forms take: caller, target, symbol. imported as of symbol_edges; sites as of calls."""
    actions = server_actions(files).select(F.col("path").alias("target"), F.col("name").alias("original"))
    names = imported.select("importer", "local", "target", "original").join(actions, ["target", "original"])
    called = names.join(sites.select(F.col("path").alias("importer"), F.col("callee").alias("local")).distinct(), ["importer", "local"], "left_semi")
    prop = F.regexp_extract_all("text", F.lit(r"\b(?:action|formAction|onSubmit|onClick)=\{\s*([A-Za-z_$][\w$]*)\s*\}"), F.lit(1))
    forms = files.where("text is not null").select(F.col("path").alias("importer"), F.explode(prop).alias("local")).distinct()
    return called.unionByName(names.join(forms, ["importer", "local"], "left_semi")).select(F.col("importer").alias("caller"), "target", F.col("original").alias("symbol")).distinct()


def procedures(files: DataFrame) -> DataFrame:
    """Procedures of routers: path, router, name. A router is an object of procedures; its name loses a final Router."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.path, batch.text, strict=True):
                scan = Scan(text or "")
                for m in re.finditer(r"\b(?:const|let|var)\s+([\w$]+)\s*=\s*(?:[\w$.]*\b)?(?:router|createTRPCRouter|createRouter)\s*\(\s*\{", scan.bare):
                    opened, depth = m.end() - 1, scan.depth(m.end())
                    router = re.sub(r"Router$", "", m[1])
                    for p in re.finditer(r"([\w$]+)\s*:\s*(?=[\w$.]*[pP]rocedure\b)", scan.bare[: scan.pairs.get(opened, len(scan.bare))][opened:]):
                        if scan.depth(opened + p.start()) == depth:
                            rows.append((path, router, p[1]))
            yield pd.DataFrame(rows, columns=["path", "router", "name"])

    return files.where(F.col("path").rlike(SCRIPTS) & F.contains("text", F.lit("rocedure"))).select("path", "text").mapInPandas(run, "path string, router string, name string").distinct()


def procedure_links(files: DataFrame) -> DataFrame:
    """Calls of procedures: caller, target, procedure. A call names the client, router, procedure and how it is used."""
    call = r"\b(?:trpc|api|utils|client)\.((?:[\w$]+\.)+)(?:useQuery|useMutation|useInfiniteQuery|useSuspenseQuery|query|mutate|mutateAsync|invalidate|fetch)\b"
    found = files.where("text is not null").select(F.col("path").alias("caller"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(call), F.lit(1)))).alias("way"))
    parts = F.filter(F.split("way", r"\."), lambda s: s != "")
    asked = found.where(F.size(parts) >= 2).select("caller", F.element_at(parts, -2).alias("router"), F.element_at(parts, -1).alias("name"))
    return asked.join(procedures(files), ["router", "name"]).where("caller <> path").select("caller", F.col("path").alias("target"), F.concat_ws(".", "router", "name").alias("procedure")).distinct()


def stores(files: DataFrame) -> DataFrame:
    """Stores and what changes them: path, library, store, mutator."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.path, batch.text, strict=True):
                scan = Scan(text or "")

                def keys(opened: int) -> Iterator[str]:
                    depth = scan.depth(opened + 1)
                    body = scan.bare[: scan.pairs.get(opened, len(scan.bare))]
                    for k in re.compile(r"(?:^|[{,\n])\s*(?:async\s+)?([A-Za-z_$][\w$]*)\s*(?=:\s*(?:async\s*)?(?:\(|[\w$]+\s*=>)|\()").finditer(body, opened):
                        if scan.depth(k.start(1)) == depth:
                            yield k[1]

                for m in re.finditer(r"\bconst\s+(use[\w$]+)\s*=\s*create(?:Store|WithEqualityFn)?\b", scan.bare):
                    opened = scan.bare.find("({", m.end())
                    arrow = re.compile(r"=>\s*\(\s*\{").search(scan.bare, m.end())
                    if arrow:
                        rows += [(path, "zustand", m[1], k) for k in keys(arrow.end() - 1)]
                    elif opened >= 0:
                        rows += [(path, "zustand", m[1], k) for k in keys(opened + 1)]
                for m in re.finditer(r"\bconst\s+([\w$]+)\s*=\s*createSlice\s*\(", scan.bare):
                    inner = re.compile(r"\breducers\s*:\s*\{").search(scan.bare, m.end())
                    if inner:
                        rows += [(path, "redux", m[1], k) for k in keys(inner.end() - 1)]
                rows += [(path, "jotai", m[1], m[1]) for m in re.finditer(r"\bconst\s+([\w$]+)\s*=\s*atom(?:WithStorage)?\b", scan.bare)]
                rows += [(path, "valtio", m[1], m[1]) for m in re.finditer(r"\bconst\s+([\w$]+)\s*=\s*proxy\s*\(", scan.bare)]
            yield pd.DataFrame(rows, columns=["path", "library", "store", "mutator"])

    marks = F.col("text").rlike(r"\b(?:zustand|createSlice|jotai|valtio)\b")
    return files.where(F.col("path").rlike(SCRIPTS) & marks).select("path", "text").mapInPandas(run, "path string, library string, store string, mutator string").distinct()


def store_links(files: DataFrame, imported: DataFrame) -> DataFrame:
    """Files that change a store: caller, target, store, mutator. A file must import the store or its mutator, and use the mutator's name."""
    known = stores(files).withColumnRenamed("path", "target")
    text = files.select(F.col("path").alias("importer"), F.col("text").alias("_text"))
    names = imported.select("importer", "target", "original").distinct().join(known, "target").where("original = store or original = mutator")
    used = names.join(text, "importer").where(F.regexp_like("_text", F.concat(F.lit(r"\b"), F.col("mutator"), F.lit(r"\b"))) & (F.col("importer") != F.col("target")))
    return used.select(F.col("importer").alias("caller"), "target", "store", "mutator").distinct()


#: Linkers by name: what each needs and gives is in its function.
LINKERS = {"http_route": cross_stack, "server_action": action_links, "procedure": procedure_links, "store": store_links}


def framework_links(files: DataFrame, imported: DataFrame, sites: DataFrame, routes: DataFrame, active: tuple[str, ...] = tuple(LINKERS)) -> DataFrame:
    """Links of all active linkers: linker, caller, target."""
    out = files.sparkSession.createDataFrame([], "linker string, caller string, target string")
    given = {
        "http_route": lambda: cross_stack(client_calls(files), routes).select("caller", F.col("handler").alias("target")),
        "server_action": lambda: action_links(files, imported, sites),
        "procedure": lambda: procedure_links(files),
        "store": lambda: store_links(files, imported),
    }
    for name in active:
        out = out.unionByName(given[name]().select(F.lit(name).alias("linker"), "caller", "target").where("caller <> target"))
    return out.distinct()


# -- homes of dispatched flows -----------------------------------------------------


def home_dispatched(journeys: DataFrame, owners: DataFrame, anchors: DataFrame) -> DataFrame:
    """Product of journeys that mostly run dispatched targets: uf, home, by.

    journeys: uf, home, path, dispatched; owners: path, product; anchors: dir, product. The owner of the
    first target holds, by path, else by the deepest anchor above it; other journeys stay where they are.
    """
    from .ownership import nearest_ancestor

    share = journeys.groupBy("uf", "home").agg(F.count_if("dispatched").alias("n"), F.count("*").alias("all"), F.min(F.when(F.col("dispatched"), F.col("path"))).alias("path"))
    moving = share.where("2 * n > all")
    near = nearest_ancestor(moving.select("path").distinct(), anchors.select("dir", F.col("product").alias("feature"))).select("path", F.col("feature").alias("near"))
    placed = share.join(owners.withColumnRenamed("product", "owner"), "path", "left").join(near, "path", "left")
    moves = F.col("n") * 2 > F.col("all")
    home = F.when(moves, F.coalesce("owner", "near", "home")).otherwise(F.col("home"))
    by = F.when(~moves, "stays").when(F.col("owner").isNotNull(), "path").when(F.col("near").isNotNull(), "anchor").otherwise("stays")
    return placed.select("uf", home.alias("home"), by.alias("by"))


# -- inside symbols and pages ------------------------------------------------------


def branches(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Conditional regions inside symbols: path, symbol, kind (if, else, case or ternary), condition, start, end. symbols: path, name, start, end."""

    def script(path: str, text: str) -> Iterator[tuple]:
        scan = Scan(text or "")

        def body(at: int) -> int:
            m = re.compile(r"\s*").match(scan.bare, at)
            first = m.end()
            if scan.bare[first : first + 1] == "{":
                return scan.pairs.get(first, first)
            return scan.end_of(first)

        for m in re.finditer(r"\bif\s*\(", scan.bare):
            stop = scan.pairs.get(m.end() - 1)
            if stop is None:
                continue
            end = body(stop + 1)
            yield path, "if", " ".join(text[m.end() : stop].split()), scan.line(m.start()), scan.line(end)
            other = re.compile(r"[\s;}]*\belse\b(?!\s*if\b)").match(scan.bare, end)
            if other:
                yield path, "else", " ".join(text[m.end() : stop].split()), scan.line(other.end() - 4), scan.line(body(other.end()))
        for m in re.finditer(r"\bcase\s+([^:\n]+):", scan.bare):
            stop = re.compile(r"\bcase\b|\bdefault\s*:|\}").search(scan.bare, m.end())
            end = (stop.start() if stop else len(scan.bare)) - 1
            yield path, "case", text[m.start(1) : m.end(1)].strip(), scan.line(m.start()), scan.line(m.start() + len(scan.bare[m.start() : end].rstrip()) - 1)
        for m in re.finditer(r"\{\s*([\w$.!()]+)\s*(?:\?(?![.?])|&&)\s*[(<]", scan.bare):
            end = scan.pairs.get(m.start(), m.end())
            yield path, "ternary" if "?" in m[0] else "and", m[1], scan.line(m.start()), scan.line(end)

    def python(path: str, text: str) -> Iterator[tuple]:
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError):
            return
        for n in ast.walk(tree):
            if isinstance(n, ast.If):
                yield path, "if", ast.unparse(n.test), n.lineno, n.body[-1].end_lineno
                if n.orelse and not (len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If)):
                    yield path, "else", ast.unparse(n.test), n.orelse[0].lineno, n.orelse[-1].end_lineno
            elif isinstance(n, ast.Match):
                for c in n.cases:
                    yield path, "case", ast.unparse(c.pattern), c.pattern.lineno, c.body[-1].end_lineno

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, t in zip(batch.path, batch.text, strict=True) for r in (python(p, t) if p.endswith(".py") else script(p, t))]
            yield pd.DataFrame(rows, columns=["path", "kind", "condition", "start", "end"])

    found = files.where(F.endswith("path", F.lit(".py")) | F.col("path").rlike(SCRIPTS)).select("path", "text").mapInPandas(run, "path string, kind string, condition string, start int, end int")
    # a branch meets the symbols of its stretch of lines
    stretch = F.explode(F.sequence(F.floor(F.col("start") / STRETCH), F.floor(F.col("end") / STRETCH))).alias("_s")
    spans = symbols.where("start <= end").select("path", F.col("name").alias("symbol"), F.col("start").alias("_a"), F.col("end").alias("_z"), stretch)
    around = found.withColumn("_s", F.floor(F.col("start") / STRETCH)).join(spans, ["path", "_s"]).where("start >= _a and end <= _z")
    inner = F.row_number().over(Window.partitionBy("path", "kind", "condition", "start", "end").orderBy(F.col("_z") - F.col("_a"), "symbol"))
    return around.withColumn("_nth", inner).where("_nth = 1").select("path", "symbol", "kind", "condition", "start", "end")


#: Components that draw rather than do. They are told by lower case or by these directories.
PRIMITIVE_DIRS = ("ui", "components/ui", "design-system", "design_system", "primitives", "primitive", "atoms", "atom")


def page_interior(files: DataFrame, imported: DataFrame) -> DataFrame:
    """What each page renders: page, component, target, product (whether it is more than a primitive), and labels as rows of kind label.

    files: path, text; imported as of symbol_edges. Pages are files of page and route names.
    """
    pages = files.where(F.element_at(F.split("path", "/"), -1).rlike(r"^(?:page|index|route|\+page|_?layout)\.[jt]sx$|(?:Page|Screen|View)\.[jt]sx$"))
    tags = F.array_distinct(F.regexp_extract_all("text", F.lit(r"<\s*([A-Z][\w$]*)"), F.lit(1)))
    shown = pages.select(F.col("path").alias("page"), F.explode(tags).alias("component"))
    named = shown.join(imported.select(F.col("importer").alias("page"), F.col("local").alias("component"), "target").distinct(), ["page", "component"], "left")
    primitive = F.coalesce(F.col("target"), F.lit("")).rlike(r"(?:^|/)(?:" + "|".join(PRIMITIVE_DIRS) + r")/")
    rows = named.select("page", F.lit("component").alias("kind"), F.col("component").alias("name"), "target", (F.col("target").isNotNull() & ~primitive).alias("product"))
    labels = F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(r"<h[1-3][^>]*>\s*([^<{][^<{]{1,80}?)\s*<"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"\b(?:title|label)=['\"]([^'\"]{2,80})['\"]"), F.lit(1))))
    texts = pages.select(F.col("path").alias("page"), F.lit("label").alias("kind"), F.explode(labels).alias("name"), F.lit(None).cast("string").alias("target"), F.lit(False).alias("product"))
    return rows.unionByName(texts)
