"""More registered queries: shaping, classification and text functions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluation as ev
from ..operators import history, incremental, journeys, ownership, sets, shaping, tools
from ..sources import code
from ..sources import history as src
from .domain import Domain
from .queries import query

#: Parts as files of a tree, so that path rules have something to run on.
_TREES = "CASE p_size % 6 WHEN 0 THEN 'apps/' WHEN 1 THEN 'packages/' WHEN 2 THEN 'src/api/' WHEN 3 THEN 'docs/' WHEN 4 THEN 'locales/' ELSE 'tests/' END"
_ENDS = "CASE p_partkey % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.test.ts' WHEN 2 THEN '.json' WHEN 3 THEN '.md' ELSE '/page.tsx' END"
PATH_SQL = f"{_TREES} || lower(replace(p_brand, '#', '')) || '/' || p_partkey || {_ENDS}"
PATHS_SQL = f"WITH f AS (SELECT p_partkey, p_brand, p_type, p_size, {PATH_SQL} AS path FROM part)"


def _tree(d: Domain) -> DataFrame:
    return d.table("part").select("p_partkey", "p_brand", "p_type", "p_size", F.expr(PATH_SQL).alias("path"))


@query("", PATHS_SQL + r""" SELECT p_partkey, CASE WHEN path LIKE 'locales/%' AND path LIKE '%.json' THEN 'locale' END AS artifact, CASE WHEN path LIKE 'docs/%' THEN 'docs' ELSE 'product' END AS surface FROM f""")
def path_classes(d: Domain) -> DataFrame:
    return _tree(d).select("p_partkey", shaping.artifact_kind("path").alias("artifact"), shaping.surface("path").alias("surface"))


@query("", PATHS_SQL + r""" SELECT p_partkey, regexp_matches(path, '(^|/)tests/') OR regexp_matches(path, '\.test\.ts$') AS is_test, regexp_matches(path, '\.(md|json)$|(^|/)docs/') AS non_source FROM f""")
def path_predicates(d: Domain) -> DataFrame:
    return _tree(d).select("p_partkey", text.is_test_path("path").alias("is_test"), text.is_non_source("path").alias("non_source"))


@query("", PATHS_SQL + r""", m AS (SELECT p_brand || p_size AS feature, bool_and(regexp_matches(path, '\.(md|json)$|(^|/)docs/')) AS a FROM f GROUP BY 1)
SELECT feature FROM m WHERE a""")
def non_source_drop(d: Domain) -> DataFrame:
    paths = _tree(d).select(F.concat("p_brand", F.col("p_size").cast("string")).alias("feature"), "path")
    return sets.all_non_source(paths, text.is_non_source("path"))


@query("", PATHS_SQL + r""" SELECT p_brand AS feature, count(*) FILTER (WHERE NOT t) AS kept, count(*) FILTER (WHERE t) AS stripped FROM (SELECT *, regexp_matches(path, '(^|/)tests/') OR regexp_matches(path, '\.test\.ts$') AS t FROM f) GROUP BY 1""")
def test_strip(d: Domain) -> DataFrame:
    return sets.strip_paths(_tree(d).select(F.col("p_brand").alias("feature"), "path"), text.is_test_path("path"))


@query("", PATHS_SQL + r""", w AS (SELECT CASE WHEN regexp_matches(path, '^(apps|packages)/[^/]+/') THEN regexp_extract(path, '^((?:apps|packages)/[^/]+)/', 1) ELSE 'root' END AS workspace FROM f) SELECT workspace, count(*) AS files FROM w GROUP BY 1""")
def partition_plan(d: Domain) -> DataFrame:
    return shaping.partition_plan(_tree(d)).select("workspace", "files")


@query("", PATHS_SQL + " SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(*) AS files FROM f GROUP BY 1")
def files_by_directory(d: Domain) -> DataFrame:
    return shaping.by_directory(_tree(d))


@query("", PATHS_SQL + r""", t AS (SELECT path FROM f WHERE regexp_matches(path, '(^|/)tests/') OR regexp_matches(path, '\.test\.ts$')), m AS (SELECT p_brand AS entity, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM f WHERE NOT (regexp_matches(path, '(^|/)tests/') OR regexp_matches(path, '\.test\.ts$'))),
b AS (SELECT path, list_filter(string_split(path, '/'), lambda x: x NOT IN ('test', 'tests', '__tests__', 'spec', 'e2e')) AS parts FROM t), a AS (SELECT path, parts, unnest(range(1, len(parts))) AS k FROM b)
SELECT DISTINCT entity, path FROM a JOIN m ON m.dir = array_to_string(parts[1:k], '/')""")
def test_neighbourhood(d: Domain) -> DataFrame:
    tree = _tree(d).withColumn("t", text.is_test_path("path"))
    return ownership.local_tests(tree.where("t").select("path"), tree.where("not t").select(F.col("p_brand").alias("entity"), "path"))


@query("", """WITH v AS (SELECT l_suppkey AS id, 'h' || (l_suppkey % 3) AS home, p_type AS candidate, sum(l_linenumber)::BIGINT AS w FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY id) AS t, row_number() OVER (PARTITION BY id ORDER BY w DESC, candidate) AS nth FROM v) SELECT id, CASE WHEN w > 0.18::DOUBLE * t THEN candidate ELSE home END AS home FROM r WHERE nth = 1""")
def late_rehome(d: Domain) -> DataFrame:
    rows = d.table("lineitem").join(d.table("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("id"), F.concat(F.lit("h"), (F.col("l_suppkey") % 3).cast("string")).alias("home"), F.col("p_type").alias("candidate"), F.col("l_linenumber").alias("weight"))
    return shaping.home_votes(rows, 0.18)


@query("", """WITH m AS (SELECT s_nationkey AS uf, s_suppkey AS flow, 'open-' || (s_suppkey % 2) || '-x' AS name FROM supplier), k AS (SELECT *, count(*) OVER (PARTITION BY uf) AS n, count(*) OVER (PARTITION BY uf, split_part(name, '-', 2)) AS c FROM m)
SELECT uf, flow, CASE WHEN n >= 4 AND c >= 2 THEN split_part(name, '-', 2) END AS "case" FROM k""")
def cases_split(d: Domain) -> DataFrame:
    m = d.table("supplier").select(F.col("s_nationkey").alias("uf"), F.col("s_suppkey").alias("flow"), F.concat(F.lit("open-"), (F.col("s_suppkey") % 2).cast("string"), F.lit("-x")).alias("name"))
    return shaping.cases(m, 4, 2)


@query("flow_paths", """, h AS (SELECT s_suppkey AS flow, 'Brand#' || (11 + s_suppkey % 5) AS product FROM supplier), o AS (SELECT p_partkey AS path, p_brand AS owner FROM part WHERE p_size > 3)
SELECT flow, path, product, CASE WHEN owner IS NULL OR owner = product THEN 'own' ELSE 'shared' END AS ledger FROM flow_paths JOIN h USING (flow) LEFT JOIN o USING (path)""")
def span_split(d: Domain) -> DataFrame:
    homes = d.table("supplier").select(F.col("s_suppkey").alias("flow"), F.concat(F.lit("Brand#"), (11 + F.col("s_suppkey") % 5).cast("string")).alias("product"))
    return shaping.split_spans(d.flow_paths, homes, d.table("part").where("p_size > 3").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("product")))


@query("edges", """, o AS (SELECT p_partkey AS importer, p_brand AS feature FROM part WHERE p_size > 10) SELECT DISTINCT feature, target AS path, 'shared' AS role FROM edges JOIN o USING (importer) JOIN part ON p_partkey = target WHERE p_size <= 2""")
def shared_members(d: Domain) -> DataFrame:
    part = d.table("part")
    return shaping.shared_members(part.where("p_size <= 2").select(F.col("p_partkey").alias("path")), d.edges, part.where("p_size > 10").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("feature")))


@query("", "SELECT event_type AS stage, count(*) AS runs, count(*) FILTER (WHERE value < 10) AS fallbacks, (count(*) FILTER (WHERE value < 10))::DOUBLE / count(*) AS fallback_share FROM events GROUP BY 1")
def scan_counters(d: Domain) -> DataFrame:
    e = d.table("events").select(F.col("event_type").alias("stage"), (F.col("value") < 10).alias("fell_back"), F.lit(None).cast("string").alias("degradation"))
    return shaping.scan_counters(e).drop("degradations")


@query("", "SELECT l_partkey AS path, arg_min(l_suppkey, (l_orderkey, l_suppkey)) AS uuid FROM lineitem GROUP BY 1")
def path_index(d: Domain) -> DataFrame:
    return shaping.path_index(d.table("lineitem").select(F.col("l_suppkey").alias("uuid"), F.col("l_orderkey").alias("pos"), F.col("l_partkey").alias("path")))


@query("", "SELECT o_orderkey AS pattern, o_orderstatus AS method, o_custkey AS path, coalesce(c_mktsegment, '') AS uuid FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def route_owner(d: Domain) -> DataFrame:
    routes = d.table("orders").select(F.col("o_orderkey").alias("pattern"), F.col("o_orderstatus").alias("method"), F.col("o_custkey").alias("path"))
    return shaping.routes_index(routes, d.table("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("path"), F.col("c_mktsegment").alias("uuid")))


@query("", "SELECT regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS name, count(DISTINCT p_type) AS workspaces, count(DISTINCT p_partkey) AS paths FROM part GROUP BY 1")
def workspace_merge(d: Domain) -> DataFrame:
    return sets.merge_workspaces(d.table("part").select(F.col("p_type").alias("workspace"), F.col("p_name").alias("name"), F.col("p_partkey").alias("path")))


@query("", """WITH f AS (SELECT l_orderkey AS pos, l_suppkey AS feature, l_partkey % 10 AS name, l_linenumber AS entry_file, l_partkey % 3 AS entry_line FROM lineitem)
SELECT min(pos) AS pos, feature, name, entry_file, entry_line FROM f GROUP BY feature, name, entry_file, entry_line""")
def identical_flows(d: Domain) -> DataFrame:
    return sets.identical_flows(d.table("lineitem").select(F.col("l_orderkey").alias("pos"), F.col("l_suppkey").alias("feature"), (F.col("l_partkey") % 10).alias("name"), F.col("l_linenumber").alias("entry_file"), (F.col("l_partkey") % 3).alias("entry_line")))


@query("", """WITH o AS (SELECT l_partkey AS path, l_linenumber AS symbol, sum(l_suppkey)::BIGINT AS h FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), n AS (SELECT l_partkey AS path, l_linenumber AS symbol, sum(l_suppkey)::BIGINT AS h FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
j AS (SELECT coalesce(o.path, n.path) AS path, coalesce(o.symbol, n.symbol) AS symbol, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'modified' END AS change FROM o FULL JOIN n ON o.path = n.path AND o.symbol = n.symbol)
SELECT * FROM j WHERE change IS NOT NULL""")
def symbol_delta(d: Domain) -> DataFrame:
    side = lambda flag: d.table("lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("symbol")).agg(F.sum("l_suppkey").alias("hash"))
    return sets.hash_diff(side("A"), side("R"), ["path", "symbol"])


@query("", """SELECT p_brand AS feature, p_size AS v, CASE WHEN substr(p_brand, 7, 1) = '1' THEN 'scan' ELSE 'base' END AS origin FROM part""")
def rehydrated(d: Domain) -> DataFrame:
    part = d.table("part").select(F.col("p_brand").alias("feature"), F.col("p_size").alias("v"))
    hit = part.select("feature").distinct().withColumn("touched", F.substring("feature", 7, 1) == "1")
    return incremental.rehydrate(hit, part, part)


@query("", """SELECT count(*) AS n, count(*) FILTER (WHERE hit) AS hits, (count(*) FILTER (WHERE hit))::DOUBLE / count(*) AS precision FROM (SELECT DISTINCT p_name, p_name IN (SELECT p_name FROM part WHERE p_size < 3) AS hit FROM part)""")
def eval_precision(d: Domain) -> DataFrame:
    part = d.table("part")
    none = part.where("false").select(F.col("p_name").alias("expected"), F.col("p_name").alias("alias"))
    slug = text.slugify("p_name")
    return ev.precision(part.where("p_size < 3").select(slug.alias("expected")), none, part.select(slug.alias("found")))


@query("", "SELECT count(*) AS n, avg(CASE WHEN m IN ('core', 'shared') THEN 1 ELSE 0 END) AS generic_rate FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'core' ELSE event_type END AS m FROM events)")
def eval_generic_rate(d: Domain) -> DataFrame:
    return ev.generic_rate(d.table("events").select(F.when(F.col("event_id") % 3 == 0, "core").otherwise(F.col("event_type")).alias("found")))


@query("", r"""WITH t AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM conversations),
f AS (SELECT conv_id, turn, list_transform(t, lambda x: CASE WHEN ends_with(x, 'ing') AND length(x) >= 6 THEN x[:-4] WHEN ends_with(x, 'es') AND length(x) >= 5 THEN x[:-3] WHEN ends_with(x, 's') AND length(x) >= 4 THEN x[:-2] ELSE x END) AS t FROM t)
SELECT conv_id, turn, array_to_string(t, ' ') AS tokens FROM f""")
def folded_tokens(d: Domain) -> DataFrame:
    return d.table("conversations").select("conv_id", "turn", F.array_join(text.tokens("text"), " ").alias("tokens"))


@query("", r"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey WHEN o_orderkey % 3 = 1 THEN o_custkey + 1 ELSE 0 END::INTEGER AS pr FROM orders""")
def pr_number(d: Domain) -> DataFrame:
    c = F.col("o_custkey").cast("string")
    message = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Merge pull request #"), c, F.lit(" from x"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("add y (#"), (F.col("o_custkey") + 1).cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("see #"), c))
    return d.table("orders").select("o_orderkey", F.coalesce(text.pr_number(message), F.lit(0)).alias("pr"))


@query("", """WITH r AS (SELECT DISTINCT '/api/' || p_type || '/:id' AS pattern, p_type AS handler FROM part), c AS (SELECT o_orderkey AS caller, '/api/' || CASE WHEN o_orderkey % 2 = 0 THEN 'ECONOMY' ELSE 'none' END || '/' || o_custkey AS url FROM orders)
SELECT caller, url, pattern, handler FROM c JOIN r ON handler = string_split(url, '/')[3]""")
def route_calls(d: Domain) -> DataFrame:
    routes = d.table("part").select(F.concat(F.lit("/api/"), "p_type", F.lit("/:id")).alias("pattern"), F.col("p_type").alias("handler")).distinct()
    kind = F.when(F.col("o_orderkey") % 2 == 0, "ECONOMY").otherwise("none")
    return code.match_routes(d.table("orders").select(F.col("o_orderkey").alias("caller"), F.concat(F.lit("/api/"), kind, F.lit("/"), F.col("o_custkey").cast("string")).alias("url")), routes)


@query("", """SELECT n_regionkey || '' AS from_dir, n_nationkey || '' AS to_dir, n_name AS dependency FROM nation WHERE (n_regionkey || '') <> (n_nationkey || '')""")
def dependency_edges(d: Domain) -> DataFrame:
    n = d.table("nation")
    packages = n.select(F.col("n_regionkey").cast("string").alias("dir"), F.lit(None).cast("string").alias("name"), F.col("n_name").alias("dependency")).unionAll(n.select(F.col("n_nationkey").cast("string"), F.col("n_name"), F.lit(None).cast("string")))
    return src.dependency_edges(packages)


@query("", "SELECT l_partkey AS path, count(DISTINCT l_suppkey) AS authors, max(l_shipdate) AS last_modified, count(*) AS hunks FROM lineitem GROUP BY 1")
def blame(d: Domain) -> DataFrame:
    b = src.blame(d.table("lineitem").select(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("author"), F.col("l_shipdate").alias("ts")))
    return b.select("path", F.size("authors").cast("long").alias("authors"), "last_modified", "hunks")


@query("commits", "SELECT sha, ts FROM commits ORDER BY ts DESC, sha LIMIT 7000")
def newest_commits(d: Domain) -> DataFrame:
    return src.newest(d.commits.select("sha", "ts"))


@query("line_index fp", """SELECT feature, bug_fixes::DOUBLE / commits AS bug_fix_ratio FROM (SELECT feature, sum(commits) AS commits, sum(bug_fixes) AS bug_fixes FROM line_index JOIN fp USING (path) GROUP BY 1) ORDER BY 2 DESC, feature LIMIT 10""")
def risk_order(d: Domain) -> DataFrame:
    sums = d.line_index.join(d.feature_paths, "path").groupBy("feature").agg(F.sum("commits").alias("commits"), F.sum("bug_fixes").alias("bug_fixes"))
    return tools.worst_first(sums.select("feature", (F.col("bug_fixes") / F.col("commits")).alias("bug_fix_ratio")), 10)


@query("flow_paths", "SELECT flow, path FROM (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY path) AS nth FROM flow_paths) WHERE nth <= 8")
def flow_path_cap(d: Domain) -> DataFrame:
    return tools.top_per(d.flow_paths, "flow", [F.col("path")], 8)


@query("", """WITH n AS (SELECT p_brand AS entity, p_size % 3 AS rung, p_name AS name FROM part) SELECT entity, name, rung FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY rung, length(name), name) AS nth FROM (SELECT DISTINCT * FROM n)) WHERE nth = 1""")
def named_by_rung(d: Domain) -> DataFrame:
    return journeys.name_by_rung(d.table("part").select(F.col("p_brand").alias("entity"), (F.col("p_size") % 3).alias("rung"), F.col("p_name").alias("name")))


@query("", "SELECT event_type AS domain, count(DISTINCT user_id) AS flows FROM events GROUP BY 1 HAVING count(DISTINCT user_id) >= 2")
def domain_journeys(d: Domain) -> DataFrame:
    return journeys.aggregate_domains(d.table("events").select(F.col("user_id").alias("flow"), F.col("event_type").alias("domain")))


@query("touches", """SELECT entity, arg_min(path, (week_idx, path)) AS first_path, min(week_idx) AS birth FROM touches GROUP BY 1""")
def births(d: Domain) -> DataFrame:
    weekly = d.touches.select("entity", "path", history.week_index("ts").alias("week_idx"))
    return weekly.groupBy("entity").agg(F.min_by("path", F.struct("week_idx", "path")).alias("first_path"), F.min("week_idx").alias("birth"))
