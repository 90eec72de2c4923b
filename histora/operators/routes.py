"""Network calls in source text, and the routes that they reach, by a trie of path segments.

Routes are a table of trie edges (node, edge, next), a segment an edge. Calls walk it
level by level: each level is an equi-join of all calls with the edges of the nodes that they
are on, literal segments by (node, segment), open edges by node. A path's rank is
the list of how exact each step was, so the least one is the route that a router would take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# -- call sites --------------------------------------------------------------------

#: Functions that take a url first, and objects whose methods do. FIXED VALUES, by the clients' own interfaces.
FUNCTIONS = ("fetch", "$fetch", "useFetch", "useLazyFetch", "useSWR", "useSWRImmutable", "useSWRMutation", "useQuery", "useMutation", "axios", "ky", "got", "superagent")
OBJECTS = ("axios", "ky", "got", "superagent", "requests", "httpx", "session", "client", "http")
VERBS = ("get", "post", "put", "patch", "delete", "head", "options", "request")


def _site_pattern() -> str:
    """Groups: 1 verb, 2 the mark of an f-string, 3 quote, 4 url, 5 a plus sign after it."""
    functions = "|".join(f.replace("$", r"\$") for f in FUNCTIONS)
    called = rf"(?:(?<![\w$])(?:{functions})|\b(?:{'|'.join(OBJECTS)})\s*\.\s*((?i:{'|'.join(VERBS)})))"
    types = r"(?:<[^>()]*>)?"
    return rf"{called}\s*{types}\s*\(\s*([fF])?(['\"`])([^'\"`]+)\3(?:\s*(\+))?"


SITE = _site_pattern()
#: A request that is built first, and one whose url is a field.
BUILT = r"\bhttp\s*\.\s*NewRequest\s*\(\s*\"([A-Za-z]+)\"\s*,\s*()(\")([^\"]+)\"(?:\s*(\+))?"
FIELD = r"\b(?:axios|\$fetch|request)\s*\(\s*\{()[^}]*?\burl\s*:\s*()(['\"`])([^'\"`]+)\3(?:\s*(\+))?"


def _read(pattern: str):
    """What a match of a call's pattern says."""

    def one(m: Column) -> Column:
        verb, mark, url, plus = (F.regexp_extract(m, pattern, k) for k in (1, 2, 4, 5))
        url = F.when(mark != "", F.regexp_replace(url, r"\{([^{}]*)\}", r"\$\{$1\}")).otherwise(url)
        return F.struct(url.alias("url"), F.when(~F.lower(verb).isin("", "request"), F.upper(verb)).alias("verb"), (plus != "").alias("open_end"))

    return one


def network_calls(files: DataFrame) -> DataFrame:
    """caller, url as it stands, verb (upper case; null where the call doesn't say) and open_end: whether something is appended to the url.

    The holes of f-strings are written as those of templates.
    """
    found = F.concat(*[F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), _read(p)) for p in (SITE, BUILT, FIELD)])
    sites = files.where("text is not null").select(F.col("path").alias("caller"), F.explode(F.array_distinct(found)).alias("s"))
    return sites.select("caller", "s.url", "s.verb", "s.open_end")


# -- the trie ----------------------------------------------------------------------

STATIC, MIXED, OPEN, REST = 0, 1, 2, 3
#: Of whole segments: one that takes all that follows, and one that may be missing.
_REST = r"^(?:\[\.\.\.[^\]]+\]|\*.*|\{[^}:]+:path\}|<path:[^>]+>)$"
_OPTIONAL_REST = r"^\[\[\.\.\.[^\]]+\]\]$"
_OPTIONAL = r"^:\w+\?$"
#: Of a part of a segment that stands for anything.
_HOLE = r"\[[^\]]+\]|\{[^}]+\}|<[^>]+>|:[A-Za-z_]\w*(?:\([^)]*\))?\??"
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+"


def route_paths(routes: DataFrame) -> DataFrame:
    """routes (pattern, ...) with ``segments``, its holes as ``*`` and a rest as ``**``. A route whose last segment may be missing stands twice."""
    raw = F.filter(F.split(F.regexp_replace("pattern", _HOST, ""), "/"), lambda s: s != "")
    plain = lambda s: F.when(s.rlike(_REST) | s.rlike(_OPTIONAL_REST), "**").otherwise(F.regexp_replace(s, _HOLE, "*"))
    last = F.try_element_at("__raw", F.lit(-1))
    optional = F.coalesce(last.rlike(_OPTIONAL_REST) | last.rlike(_OPTIONAL), F.lit(False))
    whole = F.transform("__raw", plain)
    variants = F.when(optional, F.array(whole, F.slice(whole, 1, F.greatest(F.size(whole) - 1, F.lit(0))))).otherwise(F.array(whole))
    return routes.where("pattern is not null").withColumn("__raw", raw).withColumn("segments", F.explode(variants)).drop("__raw")


def _kind(edge: Column) -> Column:
    return F.when(edge == "**", REST).when(edge == "*", OPEN).when(F.contains(edge, F.lit("*")), MIXED).otherwise(STATIC)


def trie(paths: DataFrame) -> DataFrame:
    """Edges: node, edge, next, kind, depth. paths: segments. A node is the path to it, the root the empty one."""
    segments = F.col("segments")
    upto = lambda n: F.array_join(F.slice(segments, F.lit(1), n), "/")
    steps = F.transform(segments, lambda s, i: F.struct(upto(i).alias("node"), s.alias("edge"), upto(i + 1).alias("next"), i.alias("depth")))
    return paths.select(F.explode(steps).alias("e")).select("e.*").distinct().withColumn("kind", _kind(F.col("edge")))


# -- the walk ----------------------------------------------------------------------


def _fits(text: Column, holed: Column) -> Column:
    """Whether a text has the fixed pieces of a segment with holes, in order, the first at its start and the last at its end."""
    pieces = F.split(holed, r"\*")
    first, last = F.element_at(pieces, 1), F.element_at(pieces, -1)
    rest = F.aggregate(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0))),
        F.substring(text, F.length(first) + 1, F.length(text)),
        lambda left, x: F.when(F.contains(left, x), F.substring(left, F.instr(left, x) + F.length(x), F.length(left))),
    )
    return F.startswith(text, first) & F.coalesce(F.endswith(rest, last), F.lit(False))


def url_paths(urls: DataFrame) -> DataFrame:
    """urls (url, open_end) with ``segments``, holes as ``*``; based: a hole stands for whatever comes before the first of them."""
    holed = F.regexp_replace(F.regexp_replace("url", _HOST, ""), r"\$\{[^}]*\}", "\u0001")
    holed = F.when(F.col("open_end"), F.concat(F.regexp_replace(holed, r"[?#].*$", ""), F.when(F.contains(holed, F.lit("?")), "").otherwise("\u0001"))).otherwise(F.regexp_replace(holed, r"[?#].*$", ""))
    split = F.filter(F.split(holed, "/"), lambda s: s != "")
    based = F.startswith(holed, F.lit("\u0001"))
    parts = F.when(F.col("__based"), F.slice("__split", 2, F.greatest(F.size("__split") - 1, F.lit(0)))).otherwise(F.col("__split"))
    return urls.withColumn("__split", split).withColumn("__based", based).withColumn("segments", F.transform(parts, lambda s: F.replace(s, F.lit("\u0001"), F.lit("*")))).select(*urls.columns, "segments", F.col("__based").alias("based"))


def walk(urls: DataFrame, edges: DataFrame) -> DataFrame:
    """Every way of each url through the trie: url, open_end, node and rank, the least the most exact.

    urls: url, open_end, segments, based, each once. A step's rank: 0 the segment itself or a hole that meets one, 1 a segment with a
    hole in it, 2 a hole (for a hole in the url: a fixed segment), 3 all the rest. A based url may begin at any node; the
    shallower one is the more exact.
    """
    edges = edges.checkpoint()
    static, open_, rest = edges.where(F.col("kind") == STATIC), edges.where(F.col("kind").isin(MIXED, OPEN)), edges.where(F.col("kind") == REST)
    keys = ["url", "open_end", "segments"]
    # where a based url begins: after holes alone, at any edge that its first fixed segment names
    lead = F.size("segments") - F.size(F.filter("segments", lambda s: s != "*"))
    opened = urls.where("based").withColumn("at", F.when(F.element_at(F.col("segments"), 1) == "*", F.array_position(F.transform("segments", lambda s: s != "*"), True)).otherwise(1).cast("int"))
    opened = opened.where((F.size("segments") > 0) & (lead < F.size("segments")))
    opened = opened.withColumn("seg", F.element_at("segments", F.col("at")))
    begun = opened.join(static.withColumnRenamed("edge", "seg"), "seg").select(*keys, "at", F.col("next").alias("node"), F.lpad(F.col("depth").cast("string"), 4, "0").alias("rank"))
    at_root = urls.where("not based").select(*keys, F.lit(0).alias("at"), F.lit("").alias("node"), F.lit("").alias("rank"))
    live = at_root.unionByName(begun).checkpoint()
    done = live.where(F.col("at") == F.size("segments"))
    live = live.where(F.col("at") < F.size("segments"))
    while not live.isEmpty():
        here = live.withColumn("seg", F.element_at("segments", F.col("at") + 1))
        holed = F.contains("seg", F.lit("*"))
        step = lambda rank: [*keys, (F.col("at") + 1).alias("at"), F.col("next").alias("node"), F.concat("rank", rank).alias("rank")]
        by_name = here.where(~holed).join(static.withColumnRenamed("edge", "seg"), ["node", "seg"]).select(*step(F.lit("0")))
        met = here.join(open_, "node")
        takes = F.when(F.col("kind") == OPEN, True).when(holed, True).otherwise(_fits(F.col("seg"), F.col("edge")))
        by_hole = met.where(takes).select(*step(F.when(F.col("kind") == MIXED, "1").when(holed, "0").otherwise("2")))
        # a hole in the url may stand for a fixed segment, too
        by_any = here.where(holed).join(static, "node").where((F.col("seg") == "*") | _fits(F.col("edge"), F.col("seg"))).select(*step(F.lit("2")))
        by_rest = here.join(rest, "node").select(*keys, F.size("segments").alias("at"), F.col("next").alias("node"), F.concat("rank", F.lit("3")).alias("rank"))
        moved = by_name.unionByName(by_hole).unionByName(by_any).unionByName(by_rest).checkpoint()
        done = done.unionByName(moved.where(F.col("at") == F.size("segments")))
        live = moved.where(F.col("at") < F.size("segments"))
    return done.select("url", "open_end", "node", "rank")


def resolve_calls(sites: DataFrame, routes: DataFrame) -> DataFrame:
    """The route that each call reaches: caller, url, verb, pattern, method, handler and how.

    sites: caller, url, verb, open_end; routes: pattern, method, handler. The most exact way through the trie
    wins (``exact``); a url that none of them takes whole reaches the open routes with the longest fixed head
    that is the url's (``head``). Of a route's methods the call's own is taken if it is there.
    """
    paths = route_paths(routes).checkpoint()
    ends = paths.select(F.array_join("segments", "/").alias("node"), "pattern", "method", "handler").distinct()
    urls = url_paths(sites.select("url", "open_end").distinct()).checkpoint()
    ways = walk(urls, trie(paths)).join(ends.select("node").distinct(), "node", "left_semi")
    best = ways.groupBy("url", "open_end").agg(F.min_by("node", F.struct("rank", "node")).alias("node")).checkpoint()
    exact = best.join(ends, "node").select("url", "open_end", "pattern", "method", "handler", F.lit("exact").alias("how"))

    # heads: the fixed segments before a route's first hole
    fixed = lambda s: F.slice(s, F.lit(1), F.array_position(F.concat(F.transform(s, lambda x: F.contains(x, F.lit("*"))), F.array(F.lit(True))), True).cast("int") - 1)
    headed = paths.select("pattern", "method", "handler", F.array_join(fixed(F.col("segments")), "/").alias("head"), F.size(fixed(F.col("segments"))).alias("depth")).where((F.col("depth") > 0) & F.exists(paths["segments"], lambda x: F.contains(x, F.lit("*"))))
    over = urls.where("not based").join(best, ["url", "open_end"], "left_anti").withColumn("own", fixed(F.col("segments"))).where(F.size("own") > 0)
    heads = over.select("url", "open_end", F.explode(F.transform(F.sequence(F.lit(1), F.size("own")), lambda n: F.array_join(F.slice("own", F.lit(1), n), "/"))).alias("head"))
    near = heads.join(headed.distinct(), "head")
    nearest = near.groupBy("url", "open_end").agg(F.max("depth").alias("depth"))
    by_head = near.join(nearest, ["url", "open_end", "depth"]).select("url", "open_end", "pattern", "method", "handler", F.lit("head").alias("how"))

    found = sites.distinct().join(exact.unionByName(by_head).distinct(), ["url", "open_end"])
    same = F.coalesce(F.upper("method") == F.col("verb"), F.lit(False))
    any_same = F.max(same).over(Window.partitionBy("caller", "url", "open_end", "verb"))
    return found.withColumn("__same", same).withColumn("__any", any_same).where("__same or not __any").select("caller", "url", "verb", "pattern", "method", "handler", "how").distinct()
