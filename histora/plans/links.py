"""Queries on links between files that are read as tables: routes and the calls that reach them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import conventions as words
from ..operators import graph, regions, routes, seeding
from ..sources import mounts
from .domain import Domain
from .queries import _set_checkpoints, query

_ROUTES_SQL = """rt AS (
  SELECT DISTINCT CASE p_size % 6
    WHEN 0 THEN '/api/' || t || '/[id]' WHEN 1 THEN '/api/' || t || '/' || p_size WHEN 2 THEN '/api/[kind]/' || p_size
    WHEN 3 THEN '/api/' || t || '/[...rest]' WHEN 4 THEN '/api/' || t || '/' || p_size || '/:part.json' ELSE '/' || t || '/[[...rest]]' END AS pattern,
    CASE p_partkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS method, 'src/' || t || '.ts' AS handler,
    CASE p_size % 6
    WHEN 0 THEN ['api', t, '*'] WHEN 1 THEN ['api', t, p_size::VARCHAR] WHEN 2 THEN ['api', '*', p_size::VARCHAR]
    WHEN 3 THEN ['api', t, '**'] WHEN 4 THEN ['api', t, p_size::VARCHAR, '*.json'] ELSE [t, '**'] END AS r
  FROM (SELECT *, lower(p_type) AS t FROM part)
),
rts AS (SELECT * FROM rt UNION ALL SELECT pattern, method, handler, r[:1] FROM rt WHERE pattern LIKE '%[[...%'),
cs AS (
  SELECT DISTINCT 'f' || l_orderkey || '-' || l_linenumber AS caller,
    CASE l_linenumber WHEN 1 THEN '/api/' || t || '/' || q WHEN 2 THEN '/api/' || t || '/' WHEN 3 THEN '/api/${k}/' || q
      WHEN 4 THEN '/api/' || t || '/' || q || '/${x}.json' WHEN 5 THEN '${B}/' || t || '/' || q || '/more'
      WHEN 6 THEN '/api/' || t || '/' || q || '/deep/er' ELSE 'https://h.example/' || t END AS url,
    CASE l_linenumber WHEN 2 THEN 'POST' WHEN 4 THEN 'GET' WHEN 5 THEN 'HEAD' WHEN 6 THEN 'PUT' WHEN 7 THEN 'DELETE' END AS verb,
    CASE l_linenumber WHEN 1 THEN ['api', t, q] WHEN 2 THEN ['api', t, '*'] WHEN 3 THEN ['api', '*', q]
      WHEN 4 THEN ['api', t, q, '*.json'] WHEN 5 THEN [t, q, 'more'] WHEN 6 THEN ['api', t, q, 'deep', 'er'] ELSE [t] END AS u,
    l_linenumber = 5 AS based
  FROM (SELECT *, (l_quantity::INTEGER)::VARCHAR AS q FROM lineitem) JOIN (SELECT *, lower(p_type) AS t FROM part) ON p_partkey = l_partkey
)"""
#: How exact one segment of a url is for one of a route, null if they don't meet.
_STEP = """CASE WHEN {r} = '**' THEN '3' WHEN contains({u}, '*') THEN
    CASE WHEN {r} = '*' THEN '0' WHEN contains({r}, '*') THEN '1' WHEN {u} = '*' OR {r} LIKE replace({u}, '*', '%') THEN '2' END
  ELSE CASE WHEN {r} = '*' THEN '2' WHEN contains({r}, '*') THEN CASE WHEN {u} LIKE replace({r}, '*', '%') THEN '1' END WHEN {r} = {u} THEN '0' END END"""


def _steps(u: str, r: str, first: str = "1") -> str:
    return f"list_transform(range({first}, len({r}) + 1), lambda i: {_STEP.format(u=f'{u}[i]', r=f'{r}[i]')})"


def _calls(d: Domain) -> DataFrame:
    """A file for each line item, whose text calls a url that the part's type and the quantity make."""
    part = d.table("part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_type").alias("t"))
    q = F.col("l_quantity").cast("int").cast("string")
    line = d.table("lineitem").join(part, "l_partkey").withColumn("q", q)
    forms = (
        "fetch('/api/{t}/{q}')", "axios.post('/api/{t}/' + id, body)", "const { data } = useFetch(`/api/${k}/{q}`)", "session.get(f'/api/{t}/{q}/{x}.json')",
        "await ky.head(`${B}/{t}/{q}/more`)", 'http.Put("/api/{t}/{q}/deep/er")', "requests.delete('https://h.example/{t}', timeout=3)",
    )
    form = F.element_at(F.array(*[F.lit(x) for x in forms]), F.col("l_linenumber").cast("int"))
    text = F.replace(F.replace(form, F.lit("{t}"), F.col("t")), F.lit("{q}"), F.col("q"))
    return line.select(F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("path"), text.alias("text"))


def _part_routes(d: Domain) -> DataFrame:
    t, size = F.lower("p_type"), F.col("p_size").cast("string")
    path = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    forms: list[Column] = [path("/api/", t, "/[id]"), path("/api/", t, "/", size), path("/api/[kind]/", size), path("/api/", t, "/[...rest]"), path("/api/", t, "/", size, "/:part.json"), path("/", t, "/[[...rest]]")]
    method = F.element_at(F.array(F.lit("GET"), F.lit("POST"), F.lit("PUT")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return d.table("part").select(F.element_at(F.array(*forms), (F.col("p_size") % 6 + 1).cast("int")).alias("pattern"), method.alias("method"), path("src/", t, ".ts").alias("handler")).distinct()


@query("", f"""WITH {_ROUTES_SQL},
uu AS (SELECT DISTINCT url, u, based FROM cs), rr AS (SELECT DISTINCT r FROM rts),
met AS (
  SELECT url, r, s, '' AS lead FROM (SELECT url, u, r, {_steps('u', 'r')} AS s FROM uu, rr WHERE NOT based AND (len(u) = len(r) OR (r[-1] = '**' AND len(u) >= len(r)))) WHERE NOT list_contains(list_transform(s, lambda x: x IS NULL), true)
  UNION ALL
  SELECT url, r, s, lpad(k::VARCHAR, 4, '0') FROM (
    SELECT url, u, r, k, {_steps('u', 'q', '2')} AS s FROM (SELECT *, r[k + 1:] AS q FROM (SELECT uu.*, r, unnest(range(0, len(r))) AS k FROM uu, rr WHERE based))
    WHERE q[1] = u[1] AND (len(u) = len(q) OR (q[-1] = '**' AND len(u) >= len(q)))) WHERE NOT list_contains(list_transform(s, lambda x: x IS NULL), true)
),
best AS (SELECT url, arg_min(r, (lead || array_to_string(s, ''), array_to_string(r, '/'))) AS r FROM met GROUP BY url),
ex AS (SELECT DISTINCT url, pattern, method, handler, 'exact' AS how FROM best JOIN rts USING (r)),
hd AS (SELECT DISTINCT pattern, method, handler, r[:list_position(list_transform(r, lambda x: contains(x, '*')), true) - 1] AS h FROM rts WHERE contains(array_to_string(r, '/'), '*')),
uh AS (SELECT url, CASE WHEN contains(array_to_string(u, '/'), '*') THEN u[:list_position(list_transform(u, lambda x: contains(x, '*')), true) - 1] ELSE u END AS o FROM uu WHERE NOT based AND url NOT IN (SELECT url FROM best)),
hm AS (SELECT url, pattern, method, handler, len(h) AS n, max(len(h)) OVER (PARTITION BY url) AS most FROM uh JOIN hd ON len(h) > 0 AND o[:len(h)] = h),
fo AS (SELECT * FROM ex UNION ALL SELECT url, pattern, method, handler, 'head' FROM hm WHERE n = most),
al AS (SELECT caller, url, verb, pattern, method, handler, how, coalesce(method = verb, false) AS same FROM cs JOIN fo USING (url))
SELECT DISTINCT caller, url, verb, pattern, method, handler, how FROM (SELECT *, bool_or(same) OVER (PARTITION BY caller, url) AS any_same FROM al) WHERE same OR NOT any_same""")
def route_resolution(d: Domain) -> DataFrame:
    """The route that each call reaches: call sites are read from texts, routes come from parts."""
    _set_checkpoints(d.spark)
    return routes.resolve_calls(routes.network_calls(_calls(d)), _part_routes(d))



# -- journeys ----------------------------------------------------------------------


def _list(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _one(w: str) -> str:
    """A word in the singular, as SQL."""
    return f"CASE WHEN length({w}) <= 3 THEN {w} WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN {w}[:-4] || 'y' WHEN regexp_matches({w}, '(ss|us|is)$') THEN {w} WHEN regexp_matches({w}, '(sses|shes|ches|xes|zzes)$') THEN {w}[:-3] WHEN {w} LIKE '%s' THEN {w}[:-2] ELSE {w} END"


#: What the parts' names, sizes and types make of a flow: where it enters, its feature, its product's label and what sets it off.
_FLOWS_SQL = f"""fl AS (
  SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'list' ELSE 'ping' END || '-' || w1 || '-' || w2 || 's-flow' AS flow, p_partkey AS pos, w1, w2, p_size,
    CASE p_partkey % 6 WHEN 0 THEN 'api-v2-config' WHEN 1 THEN 'data-table' WHEN 2 THEN 'platform-util' WHEN 3 THEN 'x' ELSE lower(p_type) END AS feature,
    CASE p_size % 8 WHEN 0 THEN 'packages/ui/' || w2 || '/index.ts' WHEN 1 THEN 'packages/app-store/' || w2 || p_size || '/api.ts' WHEN 2 THEN 'packages/plugins/' || w1 || '/main.ts'
      WHEN 3 THEN 'packages/lib/' || w1 || '/' || w2 || '.ts' WHEN 4 THEN 'backend/' || w2 || 's/service.py' WHEN 5 THEN 'playground/' || w2 || '.tsx'
      WHEN 6 THEN 'apps/web/modules/' || w1 || '-' || w2 || '/page.tsx' ELSE 'src/routers/v1_' || w2 || 's.py' END AS entry,
    CASE WHEN p_size % 5 = 0 THEN 'Full ' || w2 || ' & more' END AS product, CASE WHEN p_size % 7 = 0 THEN 'scheduled' ELSE 'interactive' END AS trigger, p_brand = 'Brand#2' AS artifact
  FROM (SELECT *, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part)
),
f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY flow, feature ORDER BY pos) AS nth FROM fl) WHERE nth = 1),
dm AS (
  SELECT *, CASE WHEN p_size % 8 = 7 THEN w2 WHEN product IS NOT NULL THEN w2 WHEN p_size % 8 = 6 THEN {_one("(w1 || '_' || w2)")} WHEN p_size % 8 = 4 THEN w2
    ELSE {_one("replace(regexp_replace(feature, '^((api|test|v[0-9]+)-)+', ''), '-', '_')")} END AS domain
  FROM f1
),
pl AS (SELECT CASE p_size % 8 WHEN 1 THEN 'app-store' WHEN 2 THEN 'plugins' WHEN 6 THEN 'apps' END AS root, CASE p_size % 8 WHEN 1 THEN w2 || p_size WHEN 2 THEN w1 WHEN 6 THEN 'web' END AS child FROM dm),
ro AS (SELECT root FROM (SELECT root, count(DISTINCT child) AS c, count(*) AS n FROM pl WHERE root IS NOT NULL GROUP BY root) WHERE c >= 3 AND n <= 8 * c AND c >= 0.25 * n),
kd AS (
  SELECT *, length(domain) = 1 OR domain IN {_list(words.INFRA_DOMAINS)} OR (contains(domain, '_') AND split_part(domain, '_', -1) IN {_list(words.INFRA_DOMAINS)}) AS infra,
    list_bool_and(list_transform(string_split(domain, '_'), lambda w: w IN {_list(words.PRIMITIVE_WORDS)})) AS drawn
  FROM dm
),
rl AS (
  SELECT *, CASE WHEN artifact OR p_size % 8 = 5 THEN 'dev_artifact' WHEN CASE p_size % 8 WHEN 1 THEN 'app-store' WHEN 2 THEN 'plugins' WHEN 6 THEN 'apps' END IN (SELECT root FROM ro) THEN 'plugin' WHEN trigger <> 'interactive' THEN 'system'
    WHEN drawn OR (infra AND p_size % 8 = 0) THEN 'ui_primitive' WHEN infra THEN 'infra_domain' ELSE 'seed' END AS rule
  FROM kd
),
sd AS (
  SELECT flow, feature, rule, CASE rule WHEN 'plugin' THEN 'integration' WHEN 'system' THEN CASE WHEN drawn OR infra THEN w1 || '-' || w2 ELSE domain END ELSE domain END AS domain, {_one("w1")} || '-' || w2 AS resource,
    CASE split_part(flow, '-', 1) WHEN 'create' THEN 'author' WHEN 'list' THEN 'browse' ELSE 'other' END AS intent, CASE rule WHEN 'system' THEN 'system' ELSE 'person' END AS space
  FROM rl
)"""


def _part_flows(d: Domain) -> DataFrame:
    w1, w2 = (F.split("p_name", " ")[k] for k in (0, 1))
    size, pick = F.col("p_size"), lambda values, k: F.element_at(F.array(*values), (k + 1).cast("int"))
    verb = pick([F.lit("create"), F.lit("list"), F.lit("ping")], F.col("p_partkey") % 3)
    feature = pick([F.lit("api-v2-config"), F.lit("data-table"), F.lit("platform-util"), F.lit("x"), F.lower("p_type"), F.lower("p_type")], F.col("p_partkey") % 6)
    text = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    entries = [
        text("packages/ui/", w2, "/index.ts"), text("packages/app-store/", w2, size.cast("string"), "/api.ts"), text("packages/plugins/", w1, "/main.ts"), text("packages/lib/", w1, "/", w2, ".ts"),
        text("backend/", w2, "s/service.py"), text("playground/", w2, ".tsx"), text("apps/web/modules/", w1, "-", w2, "/page.tsx"), text("src/routers/v1_", w2, "s.py"),
    ]
    return d.table("part").select(
        text(verb, "-", w1, "-", w2, "s-flow").alias("flow"), feature.alias("feature"), pick(entries, size % 8).alias("entry"), F.array(F.lit("other/late.ts")).alias("paths"), F.when(size % 5 == 0, text("Full ", w2, " & more")).alias("product"),
        F.when(size % 7 == 0, "scheduled").otherwise("interactive").alias("trigger"), (F.col("p_brand") == "Brand#2").alias("artifact"), F.col("p_partkey").alias("pos"),
    )


@query("", f"WITH {_FLOWS_SQL} SELECT flow, feature, rule, CASE WHEN rule IN ('dev_artifact', 'ui_primitive', 'infra_domain') THEN NULL ELSE domain END AS domain FROM sd")
def journey_seeding(d: Domain) -> DataFrame:
    """Which flows make journeys, and in what domain; the rest with the rule that took them."""
    _set_checkpoints(d.spark)
    return seeding.seeds(seeding.flow_domain(_part_flows(d))).select("flow", "feature", "rule", "domain")


@query("", f"WITH {_FLOWS_SQL} SELECT space, domain, resource, intent, count(*) AS flows, min(flow) AS first_flow FROM sd WHERE rule NOT IN ('dev_artifact', 'ui_primitive', 'infra_domain') GROUP BY ALL")
def journey_seeds(d: Domain) -> DataFrame:
    _set_checkpoints(d.spark)
    return seeding.seeded_journeys(seeding.seeds(seeding.flow_domain(_part_flows(d))))


# -- reach in order ----------------------------------------------------------------


def _layer(d: int) -> str:
    """One layer of the queue's walk, as SQL: what the frontier's edges meet first, ranked, as far as the seed has room."""
    return f"""c{d} AS (SELECT seed, target AS node, arg_min(f.place, (f.place, e.pos)) AS pp, arg_min(e.pos, (f.place, e.pos)) AS ep FROM l{d - 1} f JOIN e ON e.importer = f.node GROUP BY seed, target),
n{d} AS (SELECT seed, count(*) AS n FROM s{d - 1} GROUP BY seed),
l{d} AS (SELECT seed, node, {d} AS depth, n + k AS place FROM (SELECT c.*, n, row_number() OVER (PARTITION BY c.seed ORDER BY pp, ep, c.node) AS k FROM c{d} c JOIN n{d} n ON n.seed = c.seed
  WHERE NOT EXISTS (SELECT 1 FROM s{d - 1} x WHERE x.seed = c.seed AND x.node = c.node)) WHERE n + k <= 8),
s{d} AS (SELECT * FROM s{d - 1} UNION ALL SELECT * FROM l{d})"""


@query("", f"""WITH e AS (SELECT importer, target, min(pos) AS pos FROM (SELECT l_partkey AS importer, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS target, l_orderkey AS pos FROM lineitem)
  WHERE target IS NOT NULL AND importer <> target AND target NOT IN (SELECT p_partkey FROM part WHERE p_size = 7) GROUP BY ALL),
l0 AS (SELECT p_partkey AS seed, p_partkey AS node, 0 AS depth, 1 AS place FROM part), s0 AS (SELECT * FROM l0), {", ".join(_layer(d) for d in (1, 2, 3))} SELECT seed, node, depth, place FROM s3""")
def reach_order(d: Domain) -> DataFrame:
    """The files that each file reaches, in the order of a queue, eight at most; files of one size are passed over."""
    from pyspark.sql.window import Window

    _set_checkpoints(d.spark)
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    edges = d.table("lineitem").select(F.col("l_partkey").alias("importer"), after.alias("target"), F.col("l_orderkey").alias("pos")).where("target is not null")
    part = d.table("part")
    return graph.reach_in_order(edges, part.select(F.col("p_partkey").alias("seed"), F.col("p_partkey").alias("node")), skipped=part.where("p_size = 7").select(F.col("p_partkey").alias("node")))


# -- mounts ------------------------------------------------------------------------


#: Parts whose files one task makes and reads.
PARTS_A_TASK = 5_000


def _mounted_files(d: Domain) -> DataFrame:
    """Three files a part, each of which mounts the next, by the part's name, type and size: of Express, FastAPI or Django."""
    words_ = F.split("p_name", " ")
    part = d.dealt("part", PARTS_A_TASK).select(F.col("p_partkey").cast("string").alias("k"), words_[0].alias("w1"), words_[1].alias("w2"), F.lower("p_type").alias("t"), "p_size", F.col("p_size").cast("string").alias("n"))

    def text(form: str) -> Column:
        out = F.lit(form)
        for name in ("k", "w1", "w2", "t", "n"):
            out = F.replace(out, F.lit("{" + name + "}"), F.col(name))
        return out

    def tree(*files: tuple[str, str, str]) -> Column:
        """(path, text, what large parts have besides)."""
        return F.array(*[F.struct(text(p).alias("path"), F.concat(text(t), F.when(F.col("p_size") > 25, text(more)).otherwise("")).alias("text")) for p, t, more in files])

    express = tree(
        ("m{k}/app.js", "const app = express();\napp.use('/{w1}', auth, require('./r'));\n", ""),
        ("m{k}/r/index.js", "const router = Router();\nconst deep = require('./{w2}');\nrouter.use('/{t}', deep);\nmodule.exports = router;\n", ""),
        ("m{k}/r/{w2}.js", "const router = express.Router();\nmodule.exports = router;\nrouter.get('/:id', h);\n", "router.route('/{n}').post(h);\n"),
    )
    fastapi = tree(
        ("m{k}/main.py", "from .api import top\napp = FastAPI()\napp.include_router(top, prefix='/{w1}')\n", ""),
        ("m{k}/api/__init__.py", "from . import {w2}\ntop = APIRouter()\ntop.include_router({w2}.router, prefix='/{t}')\n", ""),
        ("m{k}/api/{w2}.py", "router = APIRouter()\n@router.get('/{id}')\ndef one(): ...\n", "@router.post('/{n}')\ndef more(): ...\n"),
    )
    django = tree(
        ("m{k}/urls.py", "urlpatterns = [path('{w1}/', include('m{k}.shop.urls'))]\n", ""),
        ("m{k}/shop/urls.py", "urlpatterns = [\n  path('{t}/', include('m{k}.shop.{w2}.urls')),\n]\n", ""),
        ("m{k}/shop/{w2}/urls.py", "urlpatterns = [\n  path('<id>/', one),\n]\n", "urlpatterns += [\n  path('{n}/', more),\n]\n"),
    )
    kind = F.col("p_size") % 3
    # a product with the files' places, not an explode of part alone, whose size Spark would guess at that of a few bytes and broadcast
    each = part.crossJoin(F.broadcast(d.spark.range(3).select(F.col("id").cast("int").alias("i"))))  # three rows
    return each.select(F.explode(F.array(F.get(F.when(kind == 0, express).when(kind == 1, fastapi).otherwise(django), F.col("i")))).alias("f")).select("f.*")


@query("", """WITH p AS (SELECT *, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, lower(p_type) AS t, p_size % 3 AS kind FROM part),
r AS (SELECT *, false AS more FROM p UNION ALL SELECT *, true FROM p WHERE p_size > 25)
SELECT 'm' || p_partkey || CASE kind WHEN 0 THEN '/r/' || w2 || '.js' WHEN 1 THEN '/api/' || w2 || '.py' ELSE '/shop/' || w2 || '/urls.py' END AS path, CASE WHEN kind = 2 THEN 'URL' WHEN more THEN 'POST' ELSE 'GET' END AS method,
  '/' || w1 || '/' || t || '/' || CASE WHEN more THEN p_size::VARCHAR WHEN kind = 0 THEN ':id' WHEN kind = 1 THEN '{id}' ELSE '<id>' END AS pattern, 2 AS depth FROM r""")
def mounted_routes(d: Domain) -> DataFrame:
    """Routes under the prefixes of two files above theirs."""
    _set_checkpoints(d.spark)
    return mounts.mounted_routes(_mounted_files(d)).select("path", "method", "pattern", "depth")


# -- regions -----------------------------------------------------------------------


def _region_files(d: Domain) -> DataFrame:
    """A script a part, with as many branches as its size says and a switch over its words, and a Python file besides."""
    words_, size = F.split("p_name", " "), F.col("p_size")
    ifs = F.array_join(F.transform(F.sequence(F.lit(1), size), lambda k: F.concat(F.lit("  if (a"), k.cast("string"), F.lit(") {\n    go()\n  }\n"))), "")
    script = F.concat(F.lit("function f() {\n"), ifs, F.lit("}\nfunction g() {\n  switch (x) {\n    case '"), words_[0], F.lit("':\n      one()\n    case '"), words_[1], F.lit("':\n      two()\n  }\n}\n"))
    python = F.concat(F.lit("def h(x):\n    if x == '"), words_[0], F.lit("':\n        return 1\n    else:\n        return "), size.cast("string"), F.lit("\n"))
    key = F.col("p_partkey").cast("string")
    rows = F.array(F.struct(F.concat(F.lit("s"), key, F.lit(".ts")).alias("path"), script.alias("text"), size.alias("n")), F.struct(F.concat(F.lit("p"), key, F.lit(".py")).alias("path"), python.alias("text"), F.lit(0).alias("n")))
    return d.dealt("part", 5_000).select(F.explode(rows).alias("r")).select("r.*")


@query("", """WITH p AS (SELECT p_partkey AS k, p_size, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part), i AS (SELECT k, unnest(range(1, least(p_size, 20) + 1)) AS j FROM p)
SELECT 's' || k || '.ts' AS path, 'f' AS symbol, 'if' AS kind, 'a' || j AS condition, 3 * j - 1 AS start, 3 * j + 1 AS last FROM i
UNION ALL SELECT 's' || k || '.ts', 'g', unnest(['switch', 'switch_case', 'switch_case']), unnest(['x', '''' || w1 || '''', '''' || w2 || '''']), 3 * p_size + unnest([4, 5, 7]), 3 * p_size + unnest([9, 6, 8]) FROM p
UNION ALL SELECT 'p' || k || '.py', 'h', unnest(['if', 'else']), unnest(['x == ''' || w1 || '''', '']), unnest([2, 4]), 5 FROM p""")
def branch_regions(d: Domain) -> DataFrame:
    """Conditional regions of scripts and Python files inside their functions, twenty of each at most."""
    files = _region_files(d)
    spans = F.when(F.endswith("path", F.lit(".py")), F.array(F.struct(F.lit("h").alias("name"), F.lit(1).alias("start"), F.lit(5).alias("end")))).otherwise(
        F.array(F.struct(F.lit("f").alias("name"), F.lit(1).alias("start"), (3 * F.col("n") + 2).alias("end")), F.struct(F.lit("g").alias("name"), (3 * F.col("n") + 3).alias("start"), (3 * F.col("n") + 10).alias("end")))
    )
    symbols = files.select("path", F.explode(spans).alias("s")).select("path", "s.*")
    return regions.branch_regions(files, symbols).select("path", "symbol", "kind", "condition", "start", F.col("end").alias("last"))
