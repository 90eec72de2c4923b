"""Queries over the tables' own values for operators on names, paths, tools, crates and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import increments, repos, sets, shaping, tools
from ..sources import anchors, history, intake
from ..streaming import ledger, refresh
from . import commands
from .cases import _scratch
from .domain import Domain
from .queries import _set_checkpoints, query

_PARTS = "pt AS (SELECT *, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, lower(p_type) AS t FROM part)"


#: Parts of one task, where a text is made of each.
PARTS_A_TASK = 5_000


def _parts(d: Domain) -> DataFrame:
    words = F.split("p_name", " ")
    return d.dealt("part", PARTS_A_TASK).withColumns({"w1": words[0], "w2": words[1], "t": F.lower("p_type"), "key": F.col("p_partkey").cast("string")})


def _text(*x: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])


# -- forms -------------------------------------------------------------------------


@query("", """SELECT p_partkey, greatest(1, length('{"p_name":"' || p_name || '","p_size":' || p_size || '}') // 4) AS tokens FROM part""")
def response_sizes(d: Domain) -> DataFrame:
    return d.table("part").select("p_partkey", text.response_tokens(F.col("p_name"), F.col("p_size")).alias("tokens"))


@query("", "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS parts, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def stable_order(d: Domain) -> DataFrame:
    rows = d.table("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"), F.count("*").alias("n"))
    return intake.stable(rows).withColumn("parts", F.array_join(F.col("parts").cast("array<string>"), ","))


# -- candidates and parts ----------------------------------------------------------


@query("", f"""WITH {_PARTS}, c AS (SELECT min(p_partkey) AS id, w1 || '-' || w2 || CASE WHEN t = 'promo' THEN '' ELSE '-' || t END AS name, list_distinct(list((p_size // 5) || t)) AS paths, list_distinct([w1, w2, CASE WHEN t = 'promo' THEN w1 ELSE t END]) AS tokens FROM pt GROUP BY w1, w2, t),
m AS (SELECT a.id AS a, b.id AS b, list_sort(a.tokens) AS ta, list_sort(b.tokens) AS tb, len(list_intersect(a.tokens, b.tokens)) AS k, len(list_intersect(a.paths, b.paths))::DOUBLE / len(list_distinct(list_concat(a.paths, b.paths))) AS j FROM c a JOIN c b ON a.id < b.id)
SELECT a, b FROM m WHERE ta = tb OR (len(ta) >= 2 AND len(ta) < len(tb) AND k = len(ta)) OR (len(tb) >= 2 AND len(tb) < len(ta) AND k = len(tb)) OR j >= 0.7""")
def merge_pairs(d: Domain) -> DataFrame:
    """Candidates that are one: a name and type each, whose paths are the sizes that it has."""
    p = _parts(d)
    c = p.groupBy("w1", "w2", "t").agg(F.min("p_partkey").alias("id"), F.collect_set(F.concat(F.floor(F.col("p_size") / 5).cast("string"), "t")).alias("paths"))
    name = F.when(F.col("t") == "promo", F.concat_ws("-", "w1", "w2")).otherwise(F.concat_ws("-", "w1", "w2", "t"))
    return shaping.merge_pairs(c.select("id", name.alias("name"), "paths"))


@query("", f"""WITH {_PARTS}, f AS (
  SELECT *, CASE WHEN t IN ('promo', 'large') THEN CASE WHEN p_size % 5 > 0 THEN 'src/main/' || p_partkey || '/' || w2 || '.py' ELSE 'src/extra/' || p_partkey || '/test_' || w1 || '.py' END
      WHEN t = 'small' THEN 'src/one/' || p_partkey || '/Same.tsx' WHEN p_size % 7 = 0 THEN 'src/tests/' || w1 || p_partkey || '.py' WHEN p_size % 11 = 0 THEN 'src/top' || p_partkey || '.py' ELSE 'src/' || w2 || '/' || w1 || p_partkey || '.py' END AS path,
    CASE WHEN t IN ('promo', 'large') THEN t || '-' || CASE WHEN p_size % 5 > 0 THEN 'main' ELSE 'extra' END WHEN t = 'small' THEN t || '-' || p_partkey WHEN p_size % 7 = 0 OR p_size % 11 = 0 THEN t ELSE t || '-' || w2 END AS by_dir,
    CASE WHEN t IN ('promo', 'large') THEN CASE WHEN p_size % 5 > 0 THEN t || '-' || w2 END WHEN t = 'small' THEN t || '-same' WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 11 = 0 THEN t || '-top' || p_partkey ELSE t || '-' || w1 || p_partkey END AS by_stem
  FROM pt),
n AS (SELECT t, count(*) AS total FROM f GROUP BY t),
d AS (SELECT t FROM (SELECT t, by_dir, count(*) AS k FROM f GROUP BY ALL) JOIN n USING (t) GROUP BY t, total HAVING total > 40 AND count(*) > 2 AND max(k) < 0.7 * total),
s AS (SELECT t, by_stem, count(*) AS k, by_stem IS NOT NULL AND count(*) > 1 AS own FROM f GROUP BY t, by_stem),
e AS (SELECT t FROM s JOIN n USING (t) WHERE t NOT IN (SELECT t FROM d) GROUP BY t, total HAVING total > 40 AND count(*) FILTER (WHERE own) > 2 AND greatest(coalesce(max(k) FILTER (WHERE own), 0), coalesce(sum(k) FILTER (WHERE NOT own), 0)) < 0.7 * total)
SELECT t AS feature, path, CASE WHEN t IN (SELECT t FROM d) THEN by_dir WHEN t IN (SELECT t FROM e) AND own THEN by_stem ELSE t END AS part FROM f JOIN s ON s.t = f.t AND s.by_stem IS NOT DISTINCT FROM f.by_stem""".replace("SELECT t AS feature", "SELECT f.t AS feature").replace("CASE WHEN t IN (SELECT t FROM d) THEN by_dir WHEN t IN (SELECT t FROM e) AND own THEN by_stem ELSE t END", "CASE WHEN f.t IN (SELECT t FROM d) THEN by_dir WHEN f.t IN (SELECT t FROM e) AND own THEN f.by_stem ELSE f.t END"))
def split_by_levels(d: Domain) -> DataFrame:
    """Features of many files by their directories or their files' stems."""
    p, size = _parts(d), F.col("p_size")
    flat = F.when(size % 5 > 0, _text("src/main/", F.col("key"), "/", F.col("w2"), ".py")).otherwise(_text("src/extra/", F.col("key"), "/test_", F.col("w1"), ".py"))
    plain = F.when(size % 7 == 0, _text("src/tests/", F.col("w1"), F.col("key"), ".py")).when(size % 11 == 0, _text("src/top", F.col("key"), ".py")).otherwise(_text("src/", F.col("w2"), "/", F.col("w1"), F.col("key"), ".py"))
    path = F.when(F.col("t").isin("promo", "large"), flat).when(F.col("t") == "small", _text("src/one/", F.col("key"), "/Same.tsx")).otherwise(plain)
    return sets.split_features(p.select(F.col("t").alias("feature"), path.alias("path")))


@query("", f"""WITH {_PARTS}, f AS (SELECT p_partkey, w2, CASE WHEN p_partkey % 2 = 0 THEN 'blob' ELSE p_brand END AS feature, p_size % 9 = 0 AS bare FROM pt),
z AS (SELECT feature, count(*) AS n FROM f GROUP BY 1), m AS (SELECT greatest(2 * quantile_cont(n, 0.5), ceil(0.15 * sum(n))) AS mark FROM z),
k AS (SELECT feature, w2, count(*) AS k FROM f WHERE NOT bare GROUP BY ALL HAVING count(*) >= 3), s AS (SELECT feature, count(*) AS domains FROM k GROUP BY 1)
SELECT 'modules/' || CASE WHEN bare THEN '' ELSE f.w2 || '/' END || p_partkey || '.go' AS path, f.feature, CASE WHEN z.n > mark AND domains >= 2 AND k.k IS NOT NULL AND NOT bare THEN f.feature || '/' || f.w2 ELSE f.feature END AS part
FROM f JOIN z USING (feature) CROSS JOIN m LEFT JOIN k ON k.feature = f.feature AND k.w2 = f.w2 LEFT JOIN s ON s.feature = f.feature""")
def subdecomposed(d: Domain) -> DataFrame:
    """The oversized feature by the directories that name domains."""
    _set_checkpoints(d.spark)
    feature = F.when(F.col("p_partkey") % 2 == 0, "blob").otherwise(F.col("p_brand"))
    path = F.when(F.col("p_size") % 9 == 0, _text("modules/", F.col("key"), ".go")).otherwise(_text("modules/", F.col("w2"), "/", F.col("key"), ".go"))
    return repos.subdecompose(_parts(d).select(feature.alias("feature"), path.alias("path"))).select("path", "feature", "part")


# -- tools -------------------------------------------------------------------------

_FLOWS = """fl AS (SELECT p_brand AS feature, l_suppkey AS flow, min(l_partkey) AS lo, max(l_partkey) AS hi, count(DISTINCT l_linenumber) AS bus, sum(l_quantity) AS q, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS paths FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"""


def _tool_features(d: Domain) -> DataFrame:
    p = d.table("part").withColumn("feature", F.col("p_brand"))
    return p.groupBy("feature").agg(
        F.array_sort(F.collect_set(F.col("p_partkey").cast("string"))).alias("paths"), F.array_sort(F.collect_set("p_name")).alias("labels"), F.array_sort(F.collect_set((F.col("p_size") % 4).cast("string"))).alias("authors")
    ).select("*", F.lit(None).cast("string").alias("display_name"), F.array().cast("array<string>").alias("aliases"))


def _tool_flows(d: Domain) -> DataFrame:
    line = d.table("lineitem").join(d.table("part"), F.col("p_partkey") == F.col("l_partkey"))
    return line.groupBy(F.col("p_brand").alias("feature"), F.col("l_suppkey").alias("flow")).agg(
        F.array(F.min("l_partkey").cast("string"), F.max("l_partkey").cast("string")).alias("hotspot_files"), F.countDistinct("l_linenumber").alias("bus_factor"), F.sum("l_quantity").alias("health_score"), F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("paths")
    )


def _tool_symbols(d: Domain) -> DataFrame:
    line = d.table("lineitem").where("l_linenumber <= 3").join(d.table("part"), F.col("p_partkey") == F.col("l_partkey"))
    start = (F.col("l_linenumber") * 10).cast("int")
    ranges = F.array(F.struct(start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end")))
    return line.select(F.col("p_brand").alias("feature"), F.col("l_suppkey").alias("flow"), F.col("l_partkey").cast("string").alias("file"), _text("s", F.col("l_linenumber").cast("string")).alias("symbol"), ranges.alias("ranges"))


@query("", f"""WITH {_FLOWS}, x AS (SELECT feature, string_agg(lo || ',' || hi, ',' ORDER BY flow) AS hot FROM fl GROUP BY 1)
SELECT p_brand AS feature, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey::VARCHAR) AS paths, array_to_string(string_split(any_value(hot), ',')[:5], ',') AS hotspots FROM part LEFT JOIN x ON feature = p_brand
WHERE p_brand IN (SELECT p_brand FROM part WHERE p_name = 'red widget') GROUP BY 1""")
def tool_feature_files(d: Domain) -> DataFrame:
    found = tools.call("get_feature_files", _tool_features(d), _tool_flows(d), "RED WIDGET")
    return found.withColumn("paths", F.array_join("paths", ",")).withColumn("hotspots", F.array_join("hotspots", ","))


@query("", f"WITH {_FLOWS} SELECT feature, flow, paths, q AS health_score FROM fl WHERE feature = 'Brand#2' AND flow = 3")
def tool_flow_files(d: Domain) -> DataFrame:
    return tools.call("get_flow_files", _tool_flows(d), "Brand#2", 3).withColumn("paths", F.array_join("paths", ","))


@query("", f"""WITH {_FLOWS}, x AS (SELECT feature, min(bus) AS bus FROM fl GROUP BY 1)
SELECT p_brand AS feature, count(DISTINCT p_size % 4) AS contributors, coalesce(any_value(bus), count(DISTINCT p_size % 4)) AS bus_factor, coalesce(any_value(bus), count(DISTINCT p_size % 4)) = 1 AS at_risk FROM part LEFT JOIN x ON feature = p_brand
WHERE p_brand IN (SELECT p_brand FROM part WHERE p_name = 'blue gear') GROUP BY 1""")
def tool_feature_owners(d: Domain) -> DataFrame:
    return tools.call("get_feature_owners", _tool_features(d), _tool_flows(d), "Blue Gear").drop("authors")


@query("", f"""WITH {_FLOWS}, s AS (SELECT l_partkey::VARCHAR AS file, 's' || l_linenumber AS symbol, 'https://h/blob/HEAD/' || l_partkey || '#L' || (l_linenumber * 10) || '-L' || (l_linenumber * 10 + l_quantity::INTEGER) AS link FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#2' AND l_suppkey = 3 AND l_linenumber <= 3)
SELECT * FROM s UNION ALL SELECT DISTINCT l_partkey::VARCHAR, NULL, NULL FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#2' AND l_suppkey = 3 AND l_partkey::VARCHAR NOT IN (SELECT file FROM s)""")
def tool_flow_symbols(d: Domain) -> DataFrame:
    found = tools.call("find_symbols_in_flow", _tool_symbols(d), _tool_flows(d), "Brand#2", 3, "https://h")
    return found.select("file", "symbol", F.array_join("links", " ").alias("link"))


@query("", """SELECT DISTINCT l_partkey::VARCHAR AS file, 's' || l_linenumber AS symbol, (l_linenumber * 10)::INTEGER AS start, (l_linenumber * 10 + l_quantity::INTEGER)::INTEGER AS last FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#2' AND l_linenumber <= 3""")
def tool_feature_symbols(d: Domain) -> DataFrame:
    found = tools.call("find_symbols_for_feature", _tool_symbols(d), "Brand#2")
    return found.select("file", "symbol", F.col("ranges")[0]["start"].alias("start"), F.col("ranges")[0]["end"].alias("last"))


# -- sources and profiles ----------------------------------------------------------


@query("", f"""WITH {_PARTS}, f AS (SELECT 'c' || (p_size % 5) AS crate, w1 || '-' || w2 || CASE WHEN p_size % 5 = 4 THEN '-' || p_partkey ELSE '' END AS name, count(*) AS n FROM pt GROUP BY ALL),
k AS (SELECT crate, count(*) AS n FROM f GROUP BY 1), m AS (SELECT 2 * greatest(quantile_cont(n, 0.5), 3) AS mark FROM k),
u AS (SELECT f.crate, f.name AS stem, CASE WHEN k.n > mark THEN f.crate ELSE f.name END AS name FROM f JOIN k USING (crate) CROSS JOIN m), s AS (SELECT name, count(DISTINCT crate) AS crates FROM u GROUP BY 1)
SELECT CASE WHEN crates > 1 THEN crate || '-' || name ELSE name END AS name, crate || '/src/' || stem || '.rs' AS path FROM u JOIN s USING (name)""")
def source_rust_modules(d: Domain) -> DataFrame:
    """Modules of crates: names that crates share bear the crate's, a crate of many flat ones is one."""
    stem = F.when(F.col("p_size") % 5 == 4, F.concat_ws("-", "w1", "w2", "key")).otherwise(F.concat_ws("-", "w1", "w2"))
    files = _parts(d).select(_text("c", (F.col("p_size") % 5).cast("string"), "/src/", stem, ".rs").alias("path")).distinct()
    return anchors.rust_modules(anchors.path_hits(files)).select("name", "path")


@query("", """WITH f AS (SELECT p_size % 4 AS k FROM part)
SELECT * FROM (SELECT 'default' AS profile, 0.01 AS score UNION ALL SELECT 'next_app_router', round((count(*) FILTER (WHERE k = 0))::DOUBLE / count(*), 4) FROM f UNION ALL SELECT 'fastapi_family', round((count(*) FILTER (WHERE k = 1))::DOUBLE / count(*), 4) FROM f
  UNION ALL SELECT 'django', round((count(*) FILTER (WHERE k = 2))::DOUBLE / count(*), 4) FROM f UNION ALL SELECT unnest(['next_pages_react', 'react_router_framework']), 0.0)""")
def profile_scores(d: Domain) -> DataFrame:
    """How well each profile fits files of several frameworks."""
    forms = [_text("web/app/", F.col("w2"), F.col("key"), "/page.tsx"), _text("svc/routers/", F.col("w2"), F.col("key"), ".py"), _text("shop/", F.col("w2"), F.col("key"), "/migrations/0001.py"), _text("notes/", F.col("w1"), F.col("key"), ".txt")]
    return anchors.profile_scores(_parts(d).select(F.element_at(F.array(*forms), (F.col("p_size") % 4 + 1).cast("int")).alias("path")))


# -- commands and streams ----------------------------------------------------------


@query("commits cf fp", """, b AS (SELECT p_brand AS feature, count(*) AS total_commits, count(*) FILTER (WHERE p_size > 25) AS bug_fixes FROM part GROUP BY 1),
c AS (SELECT feature, count(DISTINCT sha) AS n, count(DISTINCT sha) FILTER (WHERE is_bug_fix) AS bugs FROM cf JOIN fp USING (path) JOIN commits USING (sha) GROUP BY 1)
SELECT feature, total_commits + coalesce(n, 0) AS total_commits, bug_fixes + coalesce(bugs, 0) AS bug_fixes FROM b LEFT JOIN c USING (feature)""")
def command_update(d: Domain) -> DataFrame:
    """Stored counts and the commits that a caller's function fetches."""
    base = d.table("part").groupBy(F.col("p_brand").alias("feature")).agg(F.count("*").alias("total_commits"), F.count_if(F.col("p_size") > 25).alias("bug_fixes"), F.lit(50.0).alias("health_score"))
    paths = d.feature_paths.select("feature", F.col("path").cast("string").alias("path"))

    def fetch() -> DataFrame:
        files = d.commit_files.groupBy("sha").agg(F.collect_list(F.col("path").cast("string")).alias("files"))
        message = F.when(F.col("is_bug_fix"), "fix: crash").otherwise("feat: y")
        return d.commits.join(files, "sha").select(F.lpad(F.col("sha").cast("string"), 40, "0").alias("sha"), F.col("author").cast("string").alias("author"), "ts", message.alias("message"), "files")

    return commands.update(base, paths, fetch).select("feature", "total_commits", "bug_fixes")


@query("", """WITH e AS (SELECT 'r' || (user_id % 10) AS repo, event_type || '/' || user_id || '.ts' AS path, date_trunc('milliseconds', ts) AS ts FROM events WHERE event_type <> 'error'),
s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY repo ORDER BY ts)), b AS (SELECT *, sum(new) OVER (PARTITION BY repo ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM s)
SELECT repo, min(ts) AS started, count(*) AS events, count(DISTINCT path) AS paths FROM b GROUP BY repo, burst""")
def watched_bursts(d: Domain) -> DataFrame:
    """File events as a stream, in bursts that an hour of silence ends; events in ignored places don't count."""
    spark = d.spark
    at = _scratch(spark, f"bursts-{uuid.uuid4().hex}")
    path = F.when(F.col("event_type") == "error", "x/node_modules/y.ts").otherwise(_text(F.col("event_type"), "/", F.col("user_id").cast("string"), ".ts"))
    events = d.table("events").select(_text("r", (F.col("user_id") % 10).cast("string")).alias("repo"), path.alias("path"), "ts")
    events.write.json(f"{at}/in")
    last = events.agg(F.max("ts").alias("ts")).select(F.lit("closing").alias("repo"), F.lit("end").alias("path"), (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"))
    for more in (None, last):  # a late event of another repository moves the watermark, so that the last bursts end
        if more is not None:
            more.write.mode("append").json(f"{at}/in")
        ended = refresh.bursts(refresh.file_events(spark, f"{at}/in"), "1 hour").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").outputMode("append").trigger(availableNow=True).start()
        ended.awaitTermination()
    return spark.read.parquet(f"{at}/out").where("repo <> 'closing'").select("repo", "started", "events", "paths")


# -- a map that is kept up to date -------------------------------------------------

#: Files by the parts' names: even parts are the map's, odd ones new, placed by directory, by stem, by a directory's name or not at all.
_FILES_SQL = f"""{_PARTS}, f AS (SELECT *, p_partkey % 2 = 0 AS old, CASE WHEN p_partkey % 2 = 0 THEN 'path' WHEN p_size % 4 = 0 THEN CASE WHEN bool_or(p_partkey % 2 = 0) OVER (PARTITION BY w1, w2) THEN 'dir' ELSE 'folder' END WHEN p_size % 4 = 1 THEN 'stem' WHEN p_size % 4 = 2 THEN 'folder' END AS how,
  CASE WHEN p_partkey % 2 = 0 THEN 'src/' || w2 || '/' || w1 || '/' || p_partkey || '.py' WHEN p_size % 4 = 0 THEN 'src/' || w2 || '/' || w1 || '/deep/' || p_partkey || '.py' WHEN p_size % 4 = 1 THEN 'lib/' || p_partkey || '/v1_' || w2 || '_view.py'
    WHEN p_size % 4 = 2 THEN 'lib/' || w2 || 's/' || p_partkey || '.py' ELSE 'misc/' || p_partkey || '.py' END AS path FROM pt),
a AS (SELECT *, CASE WHEN how IS NOT NULL THEN w2 END AS feature FROM f)"""


def _map(d: Domain) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features, paths and every part's file."""
    p, size = _parts(d), F.col("p_size") % 4
    old = _text("src/", F.col("w2"), "/", F.col("w1"), "/", F.col("key"), ".py")
    new = F.when(size == 0, _text("src/", F.col("w2"), "/", F.col("w1"), "/deep/", F.col("key"), ".py")).when(size == 1, _text("lib/", F.col("key"), "/v1_", F.col("w2"), "_view.py")).when(size == 2, _text("lib/", F.col("w2"), "s/", F.col("key"), ".py")).otherwise(_text("misc/", F.col("key"), ".py"))
    files = p.select("p_partkey", "w2", F.when(F.col("p_partkey") % 2 == 0, old).otherwise(new).alias("path"))
    paths = files.where("p_partkey % 2 = 0").select(F.col("w2").alias("feature"), "path", F.col("p_partkey").alias("pos"))
    features = p.groupBy(F.col("w2").alias("feature")).agg(F.min("p_partkey").alias("pos"), F.count("*").alias("total_commits"), F.count_if(F.col("p_size") > 25).alias("bug_fixes"))
    kept = features.select("*", F.lit(0.5).alias("bug_fix_ratio"), F.array(F.lit("0")).alias("authors"), F.lit("1990-01-01").cast("timestamp_ntz").alias("last_modified"), F.lit(1.0).alias("health_score"))
    return kept, paths, files


@query("", f'WITH {_FILES_SQL} SELECT path, feature, how AS "by" FROM a')
def files_assigned(d: Domain) -> DataFrame:
    """The feature that each file finds: its own, or by directory, stem or a directory's name."""
    _set_checkpoints(d.spark)
    features, paths, files = _map(d)
    return increments.assign_files(features, paths, files)


@query("commits", f""", {_FILES_SQL}, t AS (SELECT DISTINCT feature, sha, author, ts, is_bug_fix, date_diff('second', ts, (SELECT max(ts) FROM commits)) // 86400 AS age FROM lineitem JOIN a ON l_partkey = p_partkey JOIN commits ON sha = l_orderkey WHERE feature IS NOT NULL),
u AS (SELECT *, CASE WHEN age < 30 THEN 1460 ELSE greatest(365, 730 - 2 * (age - 30)) END AS units FROM t),
n AS (SELECT feature, count(*) AS n, count(*) FILTER (WHERE is_bug_fix) AS bugs, count(DISTINCT author) FILTER (WHERE author <> 0) AS authors, max(ts) AS ts, sum(units) FILTER (WHERE is_bug_fix)::DOUBLE / sum(units) AS share FROM u GROUP BY 1),
b AS (SELECT w2 AS feature, count(*) AS total, count(*) FILTER (WHERE p_size > 25) AS fixes FROM pt GROUP BY 1),
x AS (SELECT *, 100.0::DOUBLE / (1.0::DOUBLE + exp(8.0::DOUBLE * (share - 0.55::DOUBLE))) AS base, least(1.0::DOUBLE, (total + n) / 50.0::DOUBLE) AS active FROM b JOIN n USING (feature))
SELECT feature, total + n AS total_commits, fixes + bugs AS bug_fixes, round((fixes + bugs)::DOUBLE / (total + n), 3) AS bug_fix_ratio, authors + 1 AS n_authors, strftime(ts, '%Y-%m-%d') AS last_modified, round(base * active + base * (1 - active) * 0.8, 1) AS health_score FROM x""")
def map_update(d: Domain) -> DataFrame:
    """The map's features after all commits, of which new files count for the features that they found."""
    _set_checkpoints(d.spark)
    features, paths, files = _map(d)
    touched = d.table("lineitem").join(files, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("sha"), "path")
    commits = d.commits.withColumns({"author": F.col("author").cast("string"), "pr_number": F.lit(None).cast("int")})
    last = commits.agg(F.max("ts").alias("ts")).first()["ts"]
    out, _, _ = increments.update_map(features, paths, commits, touched, F.lit(last))
    return out.select("feature", "total_commits", "bug_fixes", "bug_fix_ratio", F.size("authors").cast("long").alias("n_authors"), F.date_format("last_modified", "yyyy-MM-dd").alias("last_modified"), "health_score")


@query("", """WITH c AS (SELECT o_orderkey AS sha, o_custkey % 20 AS feature, o_custkey AS author, o_orderpriority = '1-URGENT' AS bug FROM orders WHERE NOT (o_orderkey % 3 = 0)),
f AS (SELECT DISTINCT feature, sha, l_suppkey AS file FROM c JOIN lineitem ON l_orderkey = sha)
SELECT 'F' || feature AS feature, count(*) AS total_commits, count(*) FILTER (WHERE bug) AS bug_fixes, count(DISTINCT author) AS authors, any_value(files) AS files FROM c LEFT JOIN (SELECT feature, count(DISTINCT file) AS files FROM f GROUP BY 1) USING (feature) GROUP BY feature""")
def ledger_stream(d: Domain) -> DataFrame:
    """Commits as a stream, a third of which a later batch takes back: counts, authors and files of what is left."""
    spark = d.spark
    at = _scratch(spark, f"ledger-{uuid.uuid4().hex}")
    files = d.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("files"))
    orders = d.table("orders").join(files, "o_orderkey", "left")
    event = lambda seq, kind: orders.select(_text("F", (F.col("o_custkey") % 20).cast("string")).alias("feature"), F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), F.col("o_orderkey").cast("string").alias("sha"), F.col("o_custkey").cast("string").alias("author"), (F.col("o_orderpriority") == "1-URGENT").alias("is_bug_fix"), "files")
    gone = event(2, ledger.DROP).where("sha % 3 = 0")
    again = event(1, ledger.ADD).where("sha % 5 = 0")  # the same commits once more
    for batch in (event(1, ledger.ADD), gone.unionByName(again)):
        batch.write.mode("append").parquet(f"{at}/in")
        ended = ledger.start_ledger(spark.readStream.schema(ledger.EVENTS).parquet(f"{at}/in"), f"{at}/out", f"{at}/log")
        ended.awaitTermination()
    return ledger.current(spark.read.parquet(f"{at}/out/*"))


@query("", """WITH f AS (SELECT l_orderkey, string_agg('src/' || l_partkey || '.py', ',' ORDER BY 'src/' || l_partkey || '.py') AS files, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1)
SELECT lpad(o_orderkey::VARCHAR, 40, '0') AS sha, o_custkey::VARCHAR AS author, epoch(o_orderdate)::BIGINT AS seconds, o_orderpriority = '1-URGENT' AS is_bug_fix, coalesce(n, 0) AS n_files, coalesce(files, '') AS files
FROM orders LEFT JOIN f ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1996-01-01'""")
def history_log(d: Domain) -> DataFrame:
    """A history written as a log in text, read by ranges of its bytes, packed by month and read again from a date on."""
    _set_checkpoints(d.spark)
    at = _scratch(d.spark, "log")
    files = d.table("lineitem").select("l_orderkey", _text("src/", F.col("l_partkey").cast("string"), ".py").alias("path")).distinct().groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_list("path")), "\x00").alias("files"))
    message = F.when(F.col("o_orderpriority") == "1-URGENT", "fix: crash\n\nover two lines").otherwise("feat: y")
    head = F.concat_ws("\x1f", F.lpad(F.col("o_orderkey").cast("string"), 40, "0"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string"), F.col("o_custkey").cast("string"), message)
    log = d.table("orders").join(files, "o_orderkey", "left").select(F.concat(head, F.lit("\x1e\n"), F.coalesce("files", F.lit(""))).alias("value"))
    log.write.option("lineSep", "\x00").text(f"{at}/text")
    history.pack_commits(history.read_log(d.spark, f"{at}/text"), f"{at}/packed")
    out = history.read_packed(d.spark, f"{at}/packed", "1996-01-01")
    return out.select("sha", "author", F.unix_seconds("ts").alias("seconds"), "is_bug_fix", F.size("files").cast("long").alias("n_files"), F.array_join("files", ",").alias("files"))


@query("", f"""WITH {_PARTS} SELECT 'truth/' || p_partkey AS path, unnest(['feature', 'flow', CASE WHEN p_size > 25 THEN 'sample' ELSE 'error' END]) AS kind, unnest([w2, w1 || '-' || w2, CASE WHEN p_size > 25 THEN 'src/' || p_partkey || '.ts' END]) AS name,
  unnest([NULL, w2, CASE WHEN p_size > 25 THEN w2 END]) AS owner, unnest([w1 || ',' || t, '', CASE WHEN p_size > 25 THEN '' END]) AS words FROM pt""")
def truth_files(d: Domain) -> DataFrame:
    """Expected features, flows and owners out of a file in YAML a part; a sample without a path is an error."""
    _set_checkpoints(d.spark)
    lines = _text("features:\n  - name: ", F.col("w2"), "\n    aliases: [", F.col("w1"), ", ' ', ", F.col("t"), "]\nflows:\n  - {name: ", F.col("w1"), "-", F.col("w2"), ", feature: ", F.col("w2"), "}\nsamples:\n  - path: ")
    sample = F.when(F.col("p_size") > 25, _text("src/", F.col("key"), ".ts\n    expected: ", F.col("w2"), "\n")).otherwise("''\n")
    files = _parts(d).select(_text("truth/", F.col("key")).alias("path"), F.concat(lines, sample).alias("text"))
    rows = intake.truth_rows(files)
    return rows.select("path", "kind", "name", F.nullif("of", F.lit("")).alias("owner"), F.array_join("words", ",").alias("words"))


@query("", """WITH l AS (SELECT l_orderkey, string_agg(l_linenumber || '=' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) GROUP BY 1)
SELECT o_orderkey, epoch_us(o_orderdate)::BIGINT AS micros, hex(encode(o_orderpriority)) AS raw, coalesce(parts, '') AS parts, o_custkey AS who FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def typed_round_trip(d: Domain) -> DataFrame:
    """Orders with times, bytes, maps and nested fields, written as JSON beside their schema and read again."""
    at = _scratch(d.spark, "typed")
    one = d.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    parts = one.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("l_linenumber", "p")))).alias("parts"))
    orders = d.table("orders").join(parts, "o_orderkey", "left")
    intake.write_typed(orders.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"), F.encode("o_orderpriority", "utf-8").alias("raw"), "parts", F.struct(F.col("o_custkey").alias("who")).alias("s")), at)
    back = intake.read_typed(d.spark, at)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("parts")), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return back.select("o_orderkey", F.unix_micros("ts").alias("micros"), F.hex("raw").alias("raw"), F.coalesce(shown, F.lit("")).alias("parts"), "s.who")
