"""Every registered query: the operators applied to the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, weeks
from ..operators import cochange as co
from ..operators import evaluation as ev
from ..operators import graph, history, incremental, intervals, journeys, metrics, ownership, sets, tools
from .domain import Domain, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(views: str = "", sql: str | None = None):
    """Registers a function of a Domain under its name, with SQL over the named views."""

    def register(f: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = with_views(views, sql) if views else sql
        return f

    return register


# -- metrics -----------------------------------------------------------------------


@query("scored", """, floor AS (SELECT quantile_disc(total_commits, 0.25) AS floor FROM metrics)
SELECT feature, total_commits, bug_fixes, bug_fixes::DOUBLE / total_commits AS bug_fix_ratio, n_authors, strftime(last_modified, '%Y-%m-%d') AS last_modified, health_score,
       CASE WHEN total_commits < floor THEN 'low' ELSE 'high' END AS health_confidence FROM scored, floor""")
def feature_health(d: Domain) -> DataFrame:
    out = metrics.feature_metrics(d.dated_fc, d.feature_paths, F.col("as_of"))
    return out.withColumn("last_modified", F.date_format("last_modified", "yyyy-MM-dd"))


@query("cf commits", "SELECT path, count(*) AS commits, count(*) FILTER (WHERE is_bug_fix) AS bug_fixes FROM cf JOIN commits USING (sha) GROUP BY path")
def file_commit_index(d: Domain) -> DataFrame:
    return metrics.path_commit_index(d.commits, d.commit_files)


@query("line_index", "SELECT path, commits, bug_fixes, bug_fixes::DOUBLE / commits AS bug_fix_ratio FROM line_index WHERE commits >= 5 AND bug_fixes * 100 >= commits * 40")
def hotspots_v2(d: Domain) -> DataFrame:
    return metrics.hotspots(d.line_index)


@query("line_index fp", """SELECT feature, rank, path, commits, bug_fixes FROM (
  SELECT feature, path, commits, bug_fixes, row_number() OVER (PARTITION BY feature ORDER BY bug_fixes::DOUBLE / commits DESC, commits DESC, path) AS rank
  FROM line_index JOIN fp USING (path) WHERE commits >= 3 AND bug_fixes * 100 > commits * 40) WHERE rank <= 5""")
def hotspots_legacy(d: Domain) -> DataFrame:
    return metrics.ranked_hotspots(d.line_index, d.feature_paths)


@query("fc", """SELECT feature, greatest(1, count(*) FILTER (WHERE n * 5 >= total)) AS bus_factor, max(total) AS total_commits FROM (
  SELECT feature, author, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature)::BIGINT AS total FROM fc GROUP BY feature, author) GROUP BY feature""")
def bus_factor(d: Domain) -> DataFrame:
    return metrics.bus_factor(d.fc)


@query("fc", """SELECT feature, strftime(ts, '%G-W%V') AS week, date_diff('day', DATE '0001-01-01', CAST(date_trunc('week', ts) AS DATE)) // 7 AS week_idx,
  count(*) AS total_commits, count(*) FILTER (WHERE is_bug_fix) AS bug_fix_commits, count(*) FILTER (WHERE is_test) AS test_commits FROM fc GROUP BY ALL""")
def weekly_timeline(d: Domain) -> DataFrame:
    return metrics.weekly_timeline(d.fc)


@query("fc", """, t AS (SELECT feature, date_diff('day', DATE '0001-01-01', CAST(date_trunc('week', ts) AS DATE)) // 7 AS w, count(*) AS n, count(*) FILTER (WHERE is_bug_fix) AS b FROM fc GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY w) - 1 AS i, count(*) OVER (PARTITION BY feature) AS k FROM t)
SELECT feature, max(k) AS n_weeks, CASE WHEN max(k) >= 4 THEN (sum(b) FILTER (WHERE i < k // 2))::DOUBLE / (sum(n) FILTER (WHERE i < k // 2))::DOUBLE
  - (sum(b) FILTER (WHERE i >= k // 2))::DOUBLE / (sum(n) FILTER (WHERE i >= k // 2))::DOUBLE END AS health_trend FROM p GROUP BY feature""")
def health_trend(d: Domain) -> DataFrame:
    return metrics.health_trend(metrics.weekly_timeline(d.fc))


@query("fc", """SELECT feature, pr_number, sha, author FROM (
  SELECT *, row_number() OVER (PARTITION BY feature, pr_number ORDER BY ts DESC, sha DESC) AS nth FROM (SELECT *, sha // 4 AS pr_number FROM fc) WHERE is_bug_fix) WHERE nth = 1""")
def pull_requests(d: Domain) -> DataFrame:
    return metrics.pull_requests(d.fc.withColumn("pr_number", F.expr("sha div 4"))).drop("ts")


@query("aged", """, w AS (SELECT *, 1 + sha % 100 AS weight FROM aged), s AS (SELECT feature, sum(units * weight)::DOUBLE AS a, coalesce(sum(units * weight) FILTER (WHERE is_bug_fix), 0)::DOUBLE AS b, sum(weight)::DOUBLE / 100 AS m FROM w GROUP BY feature),
h AS (SELECT feature, greatest(0, 100 - b / a * 200) AS base, least(1, m / 50) AS active FROM s)
SELECT feature, round(base * active + base * (1 - active) * 0.8::DOUBLE, 1) AS health_score FROM h""")
def weighted_health(d: Domain) -> DataFrame:
    return metrics.weighted_health(d.dated_fc.withColumn("weight", 1 + F.col("sha") % 100), F.col("as_of"))


@query("fc", "SELECT quantile_disc(n, 0.25)::BIGINT AS floor FROM (SELECT feature, count(*) AS n FROM fc GROUP BY feature)")
def health_confidence(d: Domain) -> DataFrame:
    return metrics.confidence_floor(d.fc.groupBy("feature").agg(F.count("*").alias("total_commits")))


@query("", """WITH p AS (SELECT p_brand AS feature, 'src/' || p_type || '/' || p_partkey || '.ts' AS path FROM part), c AS (SELECT p_type || '/' || p_partkey || '.ts' AS cov_path, p_size::DOUBLE AS pct FROM part)
SELECT feature, count(*) AS n_files, round(avg(pct), 6) AS coverage_pct FROM p JOIN c ON ends_with(path, cov_path) AND split_part(path, '/', 3) = split_part(cov_path, '/', 2) GROUP BY feature""")
def coverage_mean(d: Domain) -> DataFrame:
    part = d.table("part")
    leaf = F.concat("p_type", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".ts"))
    rows = metrics.coverage_mean(part.select(F.col("p_brand").alias("feature"), F.concat(F.lit("src/"), leaf).alias("path")), part.select(F.concat(F.lit("/"), leaf).alias("cov_path"), F.col("p_size").cast("double").alias("pct")))
    return rows.withColumn("coverage_pct", F.round("coverage_pct", 6))


DIGEST_DAY = "1997-06-02"


@query("commits", f"""SELECT author, p_type AS top_dir, count(DISTINCT sha) AS commits, count(*) AS files FROM commits JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON sha = l_orderkey JOIN part ON p_partkey = l_partkey
WHERE CAST(ts AS DATE) = DATE '{DIGEST_DAY}' GROUP BY ALL""")
def daily_digest(d: Domain) -> DataFrame:
    path = F.concat(F.col("p_type"), F.lit("/"), F.col("p_partkey").cast("string"))
    files = d.commit_files.join(d.table("part").select(F.col("p_partkey").alias("path"), path.alias("full")), "path").select("sha", F.col("full").alias("path"))
    return metrics.digest(d.commits, files, DIGEST_DAY)


@query("", """SELECT event_type AS stage, user_id % 3 AS model, count(*) AS calls, sum(event_id % 1000)::BIGINT AS tokens_in, sum(event_id % 77)::BIGINT AS tokens_out,
  (sum((event_id % 1000) * (1 + user_id % 3)) + sum((event_id % 77) * (5 + user_id % 3)))::DOUBLE / 1e6 AS usd FROM events GROUP BY ALL""")
def cost_rollup(d: Domain) -> DataFrame:
    calls = d.table("events").select(F.col("event_type").alias("stage"), (F.col("user_id") % 3).alias("model"), (F.col("event_id") % 1000).alias("tokens_in"), (F.col("event_id") % 77).alias("tokens_out"))
    prices = d.spark.range(3).select(F.col("id").alias("model"), (F.col("id") + 1).alias("usd_in"), (F.col("id") + 5).alias("usd_out"))
    return metrics.cost_rollup(calls, prices)


# -- co-change ---------------------------------------------------------------------


COCHANGE_SQL = """, n AS (SELECT path, count(*) AS n FROM cf GROUP BY path),
p AS (SELECT a.path AS file_a, b.path AS file_b, count(*) AS together FROM cf a JOIN cf b ON a.sha = b.sha AND a.path < b.path GROUP BY ALL HAVING count(*) >= 2)
SELECT file_a, file_b, together, x.n AS n_a, y.n AS n_b, together::DOUBLE / (x.n + y.n - together) AS score FROM p JOIN n x ON x.path = file_a JOIN n y ON y.path = file_b
WHERE together::DOUBLE / (x.n + y.n - together) >= 0.05"""


@query("cf", COCHANGE_SQL)
def cochange(d: Domain) -> DataFrame:
    return co.cochange(d.commit_files, least_score=0.05, top=None)


@query("cf", COCHANGE_SQL + " ORDER BY score DESC, file_a, file_b LIMIT 40")
def cochange_top(d: Domain) -> DataFrame:
    return co.cochange(d.commit_files, least_score=0.05)


@query("cf", """, own AS (SELECT p_partkey AS path, p_brand AS feature FROM part WHERE p_size > 5), sz AS (SELECT sha, count(*) AS size FROM cf GROUP BY sha),
u AS (SELECT cf.* FROM cf JOIN sz USING (sha) WHERE size <= greatest(1, (SELECT quantile_disc(size, 0.95) FROM sz))),
o AS (SELECT * FROM u WHERE path NOT IN (SELECT path FROM own)), t AS (SELECT DISTINCT sha, feature FROM u JOIN own USING (path)), tot AS (SELECT path, count(*) AS total FROM o GROUP BY path),
c AS (SELECT path, feature, count(*) AS n FROM o JOIN t USING (sha) GROUP BY ALL), f AS (SELECT greatest(2, quantile_disc(n, 0.75)) AS k FROM c),
r AS (SELECT c.*, total, rank() OVER (PARTITION BY path ORDER BY n DESC) AS r FROM c JOIN tot USING (path), f WHERE n >= k AND n >= 0.3 * total),
x AS (SELECT *, count(*) OVER (PARTITION BY path) AS ties FROM r WHERE r = 1)
SELECT path, feature, n, total, n::DOUBLE / total AS share FROM x WHERE ties = 1""")
def cocommit_claims(d: Domain) -> DataFrame:
    owned = d.table("part").where("p_size > 5").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("feature"))
    return co.cocommit_claims(d.commit_files, owned, majority=0.3)


# -- history -----------------------------------------------------------------------


@query("weekly", "SELECT *, bug_fixes::DOUBLE / commits AS bugfix_share FROM weekly")
def entity_weekly_history(d: Domain) -> DataFrame:
    return history.weekly_history(d.touches)


@query("weekly", """, t AS (SELECT entity, week, week_idx, (sum(commits) OVER w)::BIGINT AS trailing_commits, (sum(bug_fixes) OVER w)::BIGINT AS trailing_bugs FROM weekly WINDOW w AS (PARTITION BY entity ORDER BY week_idx RANGE BETWEEN 12 PRECEDING AND CURRENT ROW))
SELECT *, round(100.0::DOUBLE * (1.0::DOUBLE - trailing_bugs::DOUBLE / trailing_commits), 1) AS health_lite FROM t""")
def health_lite_13w(d: Domain) -> DataFrame:
    return history.trailing(history.weekly_history(d.touches))


@query("weekly", """, t AS (SELECT entity, sum(commits)::BIGINT AS total FROM weekly GROUP BY entity), m AS (SELECT quantile_cont(total, 0.5)::DOUBLE AS median FROM t)
SELECT entity, total, median, total < median AS gated FROM t, m""")
def activity_gate(d: Domain) -> DataFrame:
    return history.activity_gate(history.weekly_history(d.touches))


@query("weekly", """, t AS (SELECT entity, sum(commits) AS total FROM weekly GROUP BY entity), g AS (SELECT entity, total < (SELECT quantile_cont(total, 0.5) FROM t) AS gated FROM t),
p AS (SELECT entity, min(week_idx) AS pv FROM weekly WHERE test_commits > 0 GROUP BY entity),
s AS (SELECT entity, pv, coalesce(sum(commits) FILTER (WHERE week_idx < pv), 0)::BIGINT AS nb, coalesce(sum(bug_fixes) FILTER (WHERE week_idx < pv), 0)::DOUBLE AS bb,
  coalesce(sum(commits) FILTER (WHERE week_idx >= pv), 0)::BIGINT AS na, coalesce(sum(bug_fixes) FILTER (WHERE week_idx >= pv), 0)::DOUBLE AS ba FROM weekly LEFT JOIN p USING (entity) GROUP BY entity, pv),
e AS (SELECT *, bb / nb - ba / na AS delta, sqrt(greatest((bb + ba) / (nb + na) * (1 - (bb + ba) / (nb + na)), 1e-12) * (1.0 / nb + 1.0 / na)) AS se FROM s JOIN g USING (entity))
SELECT entity, pv AS pivot_week_idx, nb AS commits_before, na AS commits_after,
  CASE WHEN gated OR pv IS NULL OR nb = 0 OR na = 0 THEN 'insufficient_data' WHEN delta > se THEN 'improved' WHEN -delta > se THEN 'worsened' ELSE 'no_change' END AS verdict FROM e""")
def test_efficacy(d: Domain) -> DataFrame:
    return history.test_efficacy(history.weekly_history(d.touches))


@query("weekly", """, m AS (SELECT entity, quantile_cont(test_commits, 0.75)::DOUBLE AS mark FROM weekly WHERE test_commits > 0 GROUP BY entity),
w AS (SELECT weekly.*, mark, test_commits > mark AS wave, lag(test_commits > mark) OVER x AS prior, lag(week_idx) OVER x AS prior_idx FROM weekly JOIN m USING (entity) WINDOW x AS (PARTITION BY entity ORDER BY week_idx))
SELECT entity, week, week_idx, test_commits, mark FROM w WHERE wave AND NOT coalesce(prior AND prior_idx + 1 = week_idx, false)""")
def test_waves(d: Domain) -> DataFrame:
    return history.test_waves(history.weekly_history(d.touches))


@query("touches", """, f AS (SELECT entity, path, week_idx, count(*) AS n, count(*) FILTER (WHERE is_bug_fix) AS b FROM touches GROUP BY ALL),
r AS (SELECT entity, path, week_idx, sum(n) OVER w AS n, sum(b) OVER w AS b FROM f WINDOW w AS (PARTITION BY entity, path ORDER BY week_idx)),
h AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY week_idx, path) AS nth FROM r WHERE n >= 5 AND b * 100 >= n * 40) SELECT entity, week_idx, path FROM h WHERE nth = 1""")
def hotspot_emergence(d: Domain) -> DataFrame:
    return history.hotspot_emergence(d.touches)


@query("touches", """, t AS (SELECT entity, path, min(week_idx) AS first, max(week_idx) AS last FROM touches GROUP BY ALL), s AS (SELECT entity, min(first) AS birth, max(last) AS fin FROM t GROUP BY entity),
m AS (SELECT DISTINCT feature AS entity, path FROM fp)
SELECT entity, count(*) AS n_files, count(*) FILTER (WHERE coalesce(first, birth) <= birth + ceil((fin - birth) * 0.25)) AS n_existing,
  count(*) FILTER (WHERE coalesce(first, birth) <= birth + ceil((fin - birth) * 0.25))::DOUBLE / count(*) AS confidence FROM m JOIN s USING (entity) LEFT JOIN t USING (entity, path) GROUP BY entity""")
def history_confidence(d: Domain) -> DataFrame:
    return history.history_confidence(d.touches, d.members)


@query("touches flow_paths", """, f AS (SELECT entity, path, min(week_idx) AS first FROM touches GROUP BY ALL), o AS (SELECT flow, path, 'Brand#' || (11 + flow % 5) AS owner FROM flow_paths),
m AS (SELECT fp.feature AS entity, flow, count(*) AS n_shared, max(first) AS week_idx FROM (SELECT DISTINCT feature, path FROM fp) fp JOIN o USING (path) LEFT JOIN f ON f.entity = fp.feature AND f.path = fp.path WHERE owner <> fp.feature GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n_shared DESC, flow) AS rank FROM m) SELECT * FROM r WHERE rank <= 5""")
def cross_cuts(d: Domain) -> DataFrame:
    flows = d.flow_paths.withColumn("owner", F.concat(F.lit("Brand#"), (11 + F.col("flow") % 5).cast("string")))
    return history.cross_cuts(d.touches, d.members, flows)


def _points(d: Domain) -> DataFrame:
    members = d.table("part").select(F.col("p_brand").alias("entity"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"))
    return graph.importer_reach(d.snapshots, members)


@query("points", "SELECT week_idx AS snapshot, entity, reach, members_present FROM points")
def importer_reach(d: Domain) -> DataFrame:
    return _points(d)


@query("steps", """, m AS (SELECT quantile_cont(abs(rel), 0.5) AS band FROM steps WHERE size > 0),
a AS (SELECT entity, count(*) AS n, arg_min(reach, week_idx) AS first, arg_max(reach, week_idx) AS last FROM points WHERE members_present > 0 GROUP BY entity)
SELECT entity, first, last, CASE WHEN (last - first)::DOUBLE / greatest(first, 1) > coalesce(band, 0) THEN 'growing' WHEN (first - last)::DOUBLE / greatest(first, 1) > coalesce(band, 0) THEN 'shrinking' ELSE 'stable' END AS trend FROM a, m WHERE n >= 2""")
def impact_trend(d: Domain) -> DataFrame:
    return history.impact_trend(_points(d).withColumnRenamed("snapshot", "week_idx"))


@query("steps", """, m AS (SELECT quantile_cont(abs(rel), 0.9) AS rm, quantile_cont(size, 0.5) AS sm FROM steps WHERE size > 0), k AS (SELECT entity FROM points GROUP BY entity HAVING count(*) >= 3)
SELECT entity, week_idx, CASE WHEN rel > 0 THEN 'coupling_spike' ELSE 'decoupled' END AS kind, from_reach, reach FROM steps JOIN k USING (entity), m WHERE abs(rel) > rm AND size > sm""")
def impact_events(d: Domain) -> DataFrame:
    return history.impact_events(_points(d).withColumnRenamed("snapshot", "week_idx"))


@query("commits", """, p AS (SELECT sha, ts, row_number() OVER (ORDER BY ts, sha) - 1 AS i, count(*) OVER () AS m FROM commits),
w AS (SELECT round_even(k * (SELECT max(m) - 1 FROM p) / 7.0, 0)::BIGINT AS i FROM range(8) t(k)), s AS (SELECT p.* FROM p JOIN (SELECT DISTINCT i FROM w) USING (i))
SELECT strftime(ts, '%G-W%V') AS week, arg_max(sha, (ts, sha)) AS sha FROM s GROUP BY 1""")
def snapshot_commits(d: Domain) -> DataFrame:
    return history.evenly_spaced(d.commits).select("week", "sha")


# -- intervals ---------------------------------------------------------------------

MERGED_SQL = """, o AS (SELECT *, max(e) OVER (PARTITION BY flow, path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM spans),
g AS (SELECT *, sum(CASE WHEN reached IS NULL OR s > reached + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY flow, path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o),
merged AS (SELECT flow, path, min(s) AS s, max(e) AS e FROM g GROUP BY flow, path, island)"""
LINES_SQL = MERGED_SQL + """, lines AS (SELECT flow, path, unnest(range(s, e + 1)) AS line FROM merged), depth AS (SELECT path, line, count(*) AS n FROM lines GROUP BY ALL)"""


@query("spans", MERGED_SQL + " SELECT flow, path, sum(e - s + 1)::BIGINT AS lines FROM merged GROUP BY ALL")
def span_union(d: Domain) -> DataFrame:
    return intervals.union_length(d.spans, ["flow", "path"])


@query("spans", LINES_SQL + """, h AS (SELECT path, line, line - row_number() OVER (PARTITION BY path ORDER BY line) AS island FROM depth WHERE n >= 2)
SELECT path, min(line) AS start, max(line) AS "end" FROM h GROUP BY path, island""")
def span_shared_mask(d: Domain) -> DataFrame:
    return intervals.shared_mask(d.spans)


@query("spans", LINES_SQL + " SELECT flow, count(*) AS lines, count(*) FILTER (WHERE n >= 2) AS loc_shared, count(*) FILTER (WHERE n < 2) AS loc FROM lines JOIN depth USING (path, line) GROUP BY flow")
def span_owned_shared(d: Domain) -> DataFrame:
    return intervals.owned_shared(d.spans)


@query("spans", "SELECT DISTINCT p_partkey AS path, p_size::BIGINT AS line, flow FROM part JOIN spans ON path = p_partkey AND p_size BETWEEN s AND e")
def line_lookup(d: Domain) -> DataFrame:
    return intervals.line_lookup(d.table("part").select(F.col("p_partkey").alias("path"), F.col("p_size").cast("long").alias("line")), d.spans)


@query("spans", """, l AS (SELECT path, count(DISTINCT line) AS lines FROM (SELECT path, unnest(range(s, e + 1)) AS line FROM spans) GROUP BY path), o AS (SELECT p_partkey AS path, p_brand AS owner, p_size * 3 AS loc FROM part)
SELECT owner, sum(loc)::BIGINT AS loc, sum(least(coalesce(lines, 0), loc))::BIGINT AS loc_on_flow, sum(loc - least(coalesce(lines, 0), loc))::BIGINT AS loc_off_flow FROM o LEFT JOIN l USING (path) GROUP BY owner""")
def on_flow_accounting(d: Domain) -> DataFrame:
    return intervals.on_flow_accounting(d.spans, d.table("part").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("owner"), (F.col("p_size") * 3).alias("loc")))


@query("spans", """, u AS (SELECT n_nationkey AS uf, s_suppkey AS flow FROM supplier JOIN nation ON s_nationkey = n_nationkey), l AS (SELECT DISTINCT uf, path, line FROM (SELECT uf, path, unnest(range(s, e + 1)) AS line FROM spans JOIN u USING (flow)))
SELECT uf, count(*) AS loc, count(DISTINCT path) AS files FROM l GROUP BY uf""")
def journey_lines(d: Domain) -> DataFrame:
    return journeys.journey_lines(d.spans, d.table("supplier").select(F.col("s_nationkey").alias("uf"), F.col("s_suppkey").alias("flow")))


@query("spans", """, l AS (SELECT path, count(DISTINCT line) AS lines FROM (SELECT path, unnest(range(s, e + 1)) AS line FROM spans) GROUP BY path),
x AS (SELECT p_size * 3 AS loc, least(coalesce(lines, 0), p_size * 3) AS lines FROM part LEFT JOIN l ON path = p_partkey), y AS (SELECT *, CASE WHEN loc > 0 THEN lines::DOUBLE / loc ELSE 0 END AS share FROM x)
SELECT sum(loc)::BIGINT AS total_loc, sum(lines)::BIGINT AS attributed_loc, round(quantile_cont(share, 0.1), 6) AS p10, round(quantile_cont(share, 0.5), 6) AS p50, round(quantile_cont(share, 0.9), 6) AS p90 FROM y""")
def line_completeness(d: Domain) -> DataFrame:
    out = ev.line_completeness(d.table("part").select(F.col("p_partkey").alias("path"), (F.col("p_size") * 3).alias("loc")), d.spans)
    return out.select("total_loc", "attributed_loc", *(F.round(p, 6).alias(p) for p in ("p10", "p50", "p90")))


# -- ownership ---------------------------------------------------------------------

LINEAGE_SQL = """, m AS (SELECT DISTINCT p_brand, p_name, o_orderdate < TIMESTAMP '1998-01-01' AS old FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
b AS (SELECT p_brand AS b_id, p_name AS member FROM m WHERE old), n AS (SELECT p_brand AS a_id, p_name AS member FROM m WHERE NOT old),
j AS (SELECT a_id, b_id, count(*) AS k FROM n JOIN b USING (member) GROUP BY ALL), na AS (SELECT a_id, count(*) AS c FROM n GROUP BY 1), nb AS (SELECT b_id, count(*) AS c FROM b GROUP BY 1),
o AS (SELECT a_id, b_id, k, na.c AS ca, nb.c AS cb, k::DOUBLE / (na.c + nb.c - k) AS jaccard FROM j JOIN na USING (a_id) JOIN nb USING (b_id))"""


def _lineage(d: Domain) -> tuple[DataFrame, DataFrame]:
    rows = d.commit_files.join(d.commits, "sha").join(d.feature_paths, "path").select("feature", F.col("dir").alias("member"), (F.col("ts") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("old")).distinct()
    idx = F.col("feature")  # names tell their order, as the SQL has it: Brand#9 comes after Brand#25
    return rows.where("old").select(F.col("feature").alias("b_id"), "member", idx.alias("b_idx")), rows.where("not old").select(F.col("feature").alias("a_id"), "member", idx.alias("a_idx"))


@query("fp", LINEAGE_SQL + ' SELECT a_id, b_id, k AS shared, ca AS n_a, cb AS n_b, jaccard FROM o')
def group_overlap(d: Domain) -> DataFrame:
    base, new = _lineage(d)
    return ownership.overlap(new, base)


@query("fp", LINEAGE_SQL + """, x AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY jaccard DESC, b_id DESC) AS nth FROM o WHERE jaccard >= 0.4),
y AS (SELECT *, jaccard >= 0.7 AND row_number() OVER (PARTITION BY b_id ORDER BY jaccard DESC, a_id) = 1 AS wins FROM x WHERE nth = 1)
SELECT na.a_id, CASE WHEN wins THEN b_id END AS keeps_id, b_id AS related_id, coalesce(jaccard, 0) AS jaccard, CASE WHEN wins THEN 'kept' WHEN b_id IS NOT NULL THEN 'split' ELSE 'fresh' END AS kind FROM na LEFT JOIN y USING (a_id)""")
def lineage_overlap(d: Domain) -> DataFrame:
    _set_checkpoints(d.spark)
    base, new = _lineage(d)
    return ownership.lineage(base, new)


@query("", """WITH f AS (SELECT p_brand AS feature, p_partkey AS path, p_type || p_size AS dir FROM part WHERE p_size % 3 <> 0), a AS (SELECT p_partkey AS path, p_type || p_size AS dir FROM part),
o AS (SELECT dir, min(feature) AS by_dir FROM f GROUP BY dir HAVING min(feature) = max(feature))
SELECT a.path, a.dir, coalesce(f.feature, by_dir) AS feature, CASE WHEN f.feature IS NOT NULL THEN 'path' WHEN by_dir IS NOT NULL THEN 'dir' END AS matched_by FROM a LEFT JOIN f USING (path) LEFT JOIN o ON o.dir = a.dir""")
def owner_lookup(d: Domain) -> DataFrame:
    part = d.table("part").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("feature"), F.concat("p_type", F.col("p_size").cast("string")).alias("dir"), "p_size")
    return ownership.owner_lookup(part.select("path", "dir"), part.where("p_size % 3 <> 0").drop("p_size"))


@query("fp", "SELECT dir, arg_min(feature, (path, feature)) AS feature FROM fp GROUP BY dir")
def first_claimant(d: Domain) -> DataFrame:
    return ownership.first_claimant(d.feature_paths.withColumn("pos", F.col("path")))


@query("", """WITH a AS (SELECT DISTINCT url, nullif(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', ''), '') AS path FROM pages),
d AS (SELECT regexp_extract(path, '^([^/]+)', 1) AS dir, min(regexp_extract(path, '^([^/.]+)', 1)) AS feature FROM a WHERE path LIKE '%/%' GROUP BY 1)
SELECT DISTINCT path, feature, dir FROM a JOIN d ON d.dir = regexp_extract(path, '^([^/]+)', 1) WHERE path LIKE '%/%'""")
def nearest_ancestor(d: Domain) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "^[a-z]+://", "")
    files = d.table("pages").select(path.alias("path")).where("path like '%/%'").distinct()
    host = F.split("path", "/")[0]
    dirs = files.groupBy(host.alias("dir")).agg(F.min(F.split(host, r"\.")[0]).alias("feature"))
    return ownership.nearest_ancestor(files, dirs)


CLAIMS_SQL = """, c AS (SELECT DISTINCT l_suppkey AS f, l_partkey AS path FROM lineitem), s AS (SELECT s_suppkey AS f, s_nationkey % 5 AS depth, s_nationkey % 2 = 0 AS facet FROM supplier),
k AS (SELECT f, count(*) AS flows FROM c GROUP BY f), y AS (SELECT c.f, p_type, count(*) AS dir_files FROM c JOIN part ON p_partkey = path GROUP BY ALL)"""


@query("fp", CLAIMS_SQL + """, r AS (SELECT c.path, c.f, row_number() OVER (PARTITION BY c.path ORDER BY CASE WHEN facet THEN 0 ELSE depth END DESC, facet::INT, dir_files DESC, flows DESC, c.f) AS nth
FROM c JOIN s USING (f) JOIN k USING (f) JOIN part ON p_partkey = path JOIN y ON y.f = c.f AND y.p_type = part.p_type) SELECT path, f AS feature FROM r WHERE nth = 1""")
def primary_owner(d: Domain) -> DataFrame:
    c = d.flow_paths.withColumnRenamed("flow", "feature")
    part = d.table("part").select(F.col("p_partkey").alias("path"), "p_type")
    s = d.table("supplier").select(F.col("s_suppkey").alias("feature"), (F.col("s_nationkey") % 5).alias("module_depth"), (F.col("s_nationkey") % 2 == 0).alias("is_facet"))
    typed = c.join(part, "path")
    dirs = typed.groupBy("feature", "p_type").agg(F.count("*").alias("dir_files"))
    claims = typed.join(s, "feature").join(c.groupBy("feature").agg(F.count("*").alias("flows")), "feature").join(dirs, ["feature", "p_type"])
    return ownership.primary_owners(claims)


@query("", """WITH c AS (SELECT DISTINCT 's' || l_suppkey || '-' || (l_orderkey % 400) AS feature, l_partkey AS path, l_suppkey % 3 AS priority, l_suppkey % 2 AS confidence FROM lineitem),
z AS (SELECT *, count(*) OVER (PARTITION BY feature) AS size FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY priority DESC, confidence DESC, size DESC, feature) AS nth FROM z),
l AS (SELECT *, count(*) FILTER (WHERE nth = 1) OVER (PARTITION BY feature) AS lft FROM r) SELECT feature, path, nth = 1 AS wins FROM l WHERE nth = 1 OR lft = 0""")
def path_claims(d: Domain) -> DataFrame:
    c = d.table("lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("-"), (F.col("l_orderkey") % 400).cast("string")).alias("feature"), F.col("l_partkey").alias("path"), (F.col("l_suppkey") % 3).alias("priority"), (F.col("l_suppkey") % 2).alias("confidence")
    ).distinct()
    return ownership.settle_claims(c)


@query("flow_paths fp", """, p AS (SELECT s_suppkey AS flow, 'Brand#' || (11 + s_suppkey % 5) AS feature FROM supplier)
SELECT flow, feature, count(*) AS shared FROM flow_paths JOIN fp USING (path) WHERE (flow, feature) NOT IN (SELECT (flow, feature) FROM p) GROUP BY ALL""")
def bipartite_secondary(d: Domain) -> DataFrame:
    primary = d.table("supplier").select(F.col("s_suppkey").alias("flow"), F.concat(F.lit("Brand#"), (11 + F.col("s_suppkey") % 5).cast("string")).alias("feature"))
    return ownership.secondary_owners(d.flow_paths, d.feature_paths, primary)


@query("flow_paths", "SELECT a.flow, count(DISTINCT b.flow) FILTER (WHERE b.flow <> a.flow) AS others FROM flow_paths a JOIN flow_paths b USING (path) GROUP BY a.flow")
def flow_overlap_counts(d: Domain) -> DataFrame:
    _set_checkpoints(d.spark)
    return ownership.flow_overlaps(d.flow_paths)


@query("flow_paths fp", """, n AS (SELECT feature, count(*) AS c FROM fp GROUP BY 1), k AS (SELECT fp.feature, flow % 4 AS product, count(DISTINCT path) AS shared FROM fp JOIN flow_paths USING (path) GROUP BY ALL),
r AS (SELECT feature AS dev, product, shared, shared::DOUBLE / c AS share, row_number() OVER (PARTITION BY feature ORDER BY shared::DOUBLE / c DESC, product) AS nth FROM k JOIN n USING (feature) WHERE shared::DOUBLE / c >= 0.5)
SELECT dev, product, shared, share FROM r WHERE nth = 1""")
def member_backfill(d: Domain) -> DataFrame:
    _set_checkpoints(d.spark)
    product = d.flow_paths.select((F.col("flow") % 4).alias("b_id"), F.col("path").alias("member"))
    return ownership.backfill(d.feature_paths.select(F.col("feature").alias("a_id"), F.col("path").alias("member")), product)


@query("", """WITH v AS (SELECT l_suppkey AS uf, p_brand AS pf, sum(l_linenumber)::BIGINT AS span, count(*) FILTER (WHERE l_linenumber = 1) AS entries FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
t AS (SELECT *, sum(span) OVER w AS ts, sum(entries) OVER w AS te, row_number() OVER (PARTITION BY uf ORDER BY span DESC, entries DESC, pf) AS nth FROM v WINDOW w AS (PARTITION BY uf)),
i AS (SELECT s_suppkey AS uf, 'Brand#' || (11 + s_suppkey % 5) AS was FROM supplier), h AS (SELECT i.uf, was, CASE WHEN b.pf IS NULL OR coalesce(t.span * 2 > t.ts AND (t.te = 0 OR t.entries * 2 >= t.te), false) THEN was ELSE b.pf END AS home
FROM i LEFT JOIN t ON t.uf = i.uf AND t.pf = i.was LEFT JOIN (SELECT uf, pf FROM t WHERE nth = 1) b ON b.uf = i.uf) SELECT *, home IS DISTINCT FROM was AS resettled FROM h""")
def conservation_votes(d: Domain) -> DataFrame:
    votes = d.table("lineitem").join(d.table("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("uf"), F.col("p_brand").alias("pf")).agg(F.sum(F.col("l_linenumber").cast("long")).alias("span"), F.count_if(F.col("l_linenumber") == 1).alias("entries"))
    inc = d.table("supplier").select(F.col("s_suppkey").alias("uf"), F.concat(F.lit("Brand#"), (11 + F.col("s_suppkey") % 5).cast("string")).alias("pf"))
    return ownership.conserve(votes, inc)


@query("", """WITH v AS (SELECT DISTINCT p_brand AS entity, p_partkey AS path, p_type AS token FROM part), n AS (SELECT entity, count(DISTINCT path) AS voters FROM v GROUP BY 1), c AS (SELECT entity, token, count(*) AS n FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, token) AS nth FROM c JOIN n USING (entity)) SELECT entity, CASE WHEN n >= 0.2 * voters THEN token END AS token, n, voters FROM r WHERE nth = 1""")
def domain_vote(d: Domain) -> DataFrame:
    return ownership.vote_token(d.table("part").select(F.col("p_brand").alias("entity"), F.col("p_partkey").alias("path"), F.col("p_type").alias("token")), 0.2)


@query("", """WITH r AS (SELECT p_partkey, p_name AS name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS seq FROM part)
SELECT p_partkey, name, seq, substr(sha256('feature|' || name || '|' || seq), 1, 32) AS uuid FROM r""")
def minted_ids(d: Domain) -> DataFrame:
    return ownership.sequence_ids(d.table("part").select("p_partkey", F.col("p_name").alias("name")), "feature", "name", "p_partkey")


@query("fp", LINEAGE_SQL + """, p AS (SELECT a_id, b_id, jaccard, row_number() OVER (ORDER BY jaccard DESC, a_id, b_id) AS n FROM o WHERE jaccard >= 0.5),
w(n, ua, ub, taken) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], false
  UNION ALL SELECT p.n, CASE WHEN list_contains(ua, a_id) OR list_contains(ub, b_id) THEN ua ELSE list_append(ua, a_id) END, CASE WHEN list_contains(ua, a_id) OR list_contains(ub, b_id) THEN ub ELSE list_append(ub, b_id) END,
    NOT (list_contains(ua, a_id) OR list_contains(ub, b_id)) FROM w JOIN p ON p.n = w.n + 1)
SELECT a_id, b_id, jaccard FROM p JOIN w USING (n) WHERE taken""")
def identity_match(d: Domain) -> DataFrame:
    """One-to-one matching of old and new groups, best overlap first; the SQL walks the pairs one by one."""
    base, new = _lineage(d)
    return ownership.greedy_match(ownership.overlap(new, base).where("jaccard >= 0.5"), [F.desc("jaccard"), F.col("a_id"), F.col("b_id")]).select("a_id", "b_id", "jaccard")


@query("", """WITH m AS (SELECT l_suppkey AS flow, p_brand AS feature, max(l_linenumber) = 7 AS a, count(*) AS c FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT flow, feature FROM (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY a::INT DESC, c DESC, feature) AS nth FROM m) WHERE nth = 1""")
def flow_owner(d: Domain) -> DataFrame:
    m = d.table("lineitem").join(d.table("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("flow"), F.col("p_brand").alias("feature")).agg((F.max("l_linenumber") == 7).alias("is_anchor"), F.count("*").alias("confidence"))
    return ownership.flow_owner(m)


@query("", """WITH s AS (SELECT l_suppkey AS feature, p_type AS label, max(l_linenumber) // 7 AS confidence, sum(p_size)::BIGINT AS weight FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS nth, first_value(confidence) OVER w AS c, first_value(weight) OVER w AS x FROM s WINDOW w AS (PARTITION BY feature ORDER BY confidence DESC, weight DESC, label)),
o AS (SELECT s_suppkey AS feature, 'override' AS label, 1 AS nth FROM supplier WHERE s_nationkey = 3)
SELECT feature, label, nth FROM r WHERE (nth = 1 OR (nth = 2 AND confidence = c AND x < 2 * weight)) AND feature NOT IN (SELECT feature FROM o) UNION ALL SELECT * FROM o""")
def product_labels(d: Domain) -> DataFrame:
    rows = d.table("lineitem").join(d.table("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("feature"), F.col("p_type").alias("label")).agg(F.expr("max(l_linenumber) div 7").alias("confidence"), F.sum("p_size").alias("weight"))
    return ownership.cluster_label(rows, d.table("supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("feature"), F.lit("override").alias("label")))


# -- graphs ------------------------------------------------------------------------


@query("edges fp", """, w(seed, node, depth) AS (SELECT DISTINCT feature, path, 0 FROM fp UNION SELECT w.seed, e.target, w.depth + 1 FROM w JOIN edges e ON e.importer = w.node WHERE w.depth < 3)
SELECT seed, node, min(depth) AS depth FROM w GROUP BY ALL""")
def import_reach(d: Domain) -> DataFrame:
    """Reach over imports from all files of each feature, to the operator's depth."""
    return graph.reach(d.edges, d.feature_paths.select(F.col("feature").alias("seed"), F.col("path").alias("node")))


@query("flow_paths", """, e AS (SELECT path AS symbol, count(*) AS fan_in FROM flow_paths GROUP BY 1), m AS (SELECT quantile_cont(fan_in, 0.5)::DOUBLE AS median FROM e)
SELECT symbol, fan_in, median, fan_in >= 2 AND fan_in > 1.5 * median AS shared FROM e, m""")
def fan_in_shared(d: Domain) -> DataFrame:
    return graph.fan_in(d.flow_paths.select(F.col("path").alias("symbol"), "flow"), ratio=1.5)


@query("flow_paths", """, e AS (SELECT path, count(*) AS claims FROM flow_paths GROUP BY 1), m AS (SELECT greatest(3, quantile_disc(claims, 0.9))::BIGINT AS mark FROM e)
SELECT path, claims, mark FROM e, m WHERE claims >= mark AND path::VARCHAR LIKE '%7'""")
def scaffold_filter(d: Domain) -> DataFrame:
    return graph.scaffold(d.flow_paths.withColumnRenamed("flow", "feature"), "7$")


@query("flow_paths", "SELECT path, count(DISTINCT flow % 50) AS products FROM flow_paths GROUP BY path HAVING count(DISTINCT flow % 50) >= greatest(2, ceil(50 * 45 / 100.0))")
def file_lane(d: Domain) -> DataFrame:
    return graph.file_lane(d.flow_paths.select("path", (F.col("flow") % 50).alias("product")), d.spark.range(1).select(F.lit(50).alias("n")), 45)


def _label_rounds(n: int) -> str:
    """SQL for least labels that go to and fro over the pairs (a, b) of e: n rounds are enough where no path is longer than 2n."""
    rounds = ["l0 AS MATERIALIZED (SELECT a, min(b) AS label FROM e GROUP BY a)"]
    for k in range(n):
        rounds.append(f"r{k} AS MATERIALIZED (SELECT b, min(label) AS label FROM e JOIN l{k} USING (a) GROUP BY b)")
        rounds.append(f"l{k + 1} AS MATERIALIZED (SELECT a, min(label) AS label FROM e JOIN r{k} USING (b) GROUP BY a)")
    return ", ".join(rounds)


@query("", f"""WITH e AS MATERIALIZED (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), {_label_rounds(8)}
SELECT a AS node, label AS component FROM l8 UNION ALL SELECT b, min(label) FROM e JOIN l8 USING (a) GROUP BY b""")
def import_components(d: Domain) -> DataFrame:
    """Components over all line items; a part's name sorts before any supplier's, so the least label is a part's."""
    e = d.table("lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b"))
    return graph.components(e)


def _set_checkpoints(spark: SparkSession) -> None:
    """The folder that the cluster names. On one machine, as in tests, a local one stands in; on several it must be named."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    spark.sparkContext.setCheckpointDir(at or "/tmp/histora-checkpoints")


@query("edges", """, c AS (SELECT p_partkey AS node, p_brand AS cluster FROM part), b AS (SELECT x.cluster AS ca, y.cluster AS cb FROM edges JOIN c x ON x.node = importer JOIN c y ON y.node = target), n AS (SELECT cluster, count(*) AS n FROM c GROUP BY 1)
SELECT cluster, n, count(*) FILTER (WHERE ca = cb) AS inner_edges, count(*) FILTER (WHERE ca <> cb) AS outer_edges, CASE WHEN n > 1 THEN (count(*) FILTER (WHERE ca = cb))::DOUBLE / (n * (n - 1)) ELSE 0 END AS cohesion FROM n LEFT JOIN b ON ca = cluster GROUP BY cluster, n""")
def cluster_cohesion(d: Domain) -> DataFrame:
    return graph.cohesion(d.edges, d.table("part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("cluster")))


# -- tools -------------------------------------------------------------------------


def _features(d: Domain) -> DataFrame:
    m = metrics.feature_metrics(d.dated_fc, d.feature_paths, F.col("as_of"))
    paths = d.feature_paths.groupBy("feature").agg(F.array_sort(F.collect_set(F.col("path").cast("string"))).alias("paths"), F.array_sort(F.collect_set("dir")).alias("labels"))
    return m.join(paths, "feature").select("*", F.lit(None).cast("string").alias("display_name"), F.concat(F.lit("parts of "), "feature").alias("description"), F.array().cast("array<string>").alias("aliases"), (F.substring("feature", 7, 2).cast("int") * 1.0).alias("coverage_pct"))


def _changed(d: Domain) -> DataFrame:
    """The files of one large change: the parts of the first type."""
    return d.table("part").where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("path"))


CHANGE = "p_type = 'ECONOMY'"


@query("scored", """SELECT feature, 'parts of ' || feature AS description, round_even(health_score, 0) AS health, round_even(bug_fixes::DOUBLE / total_commits * 100, 1) AS bug_fix_percent, total_commits, n AS file_count, substr(feature, 7, 2)::DOUBLE AS coverage_pct
FROM scored JOIN (SELECT feature, count(*) AS n FROM fp GROUP BY 1) USING (feature)""")
def list_features(d: Domain) -> DataFrame:
    return tools.list_features(_features(d))


@query("scored", """SELECT count(*) AS total_features, sum(bug_fixes)::BIGINT AS total_bug_fixes, round(avg(health_score), 6) AS avg_health_score, count(*) FILTER (WHERE health_score < 50) AS features_at_risk,
  round(avg(substr(feature, 7, 2)::DOUBLE), 6) AS avg_coverage_pct, (SELECT count(*) FROM supplier) AS total_flows FROM scored""")
def repo_summary(d: Domain) -> DataFrame:
    out = tools.repo_summary(_features(d), d.table("supplier"))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_health_score", "avg_coverage_pct")})


@query("scored", """SELECT feature, health_score, bug_fixes, total_commits FROM scored ORDER BY health_score, feature LIMIT 5""")
def tool_hotspots(d: Domain) -> DataFrame:
    flows = d.table("supplier").select(F.lit("none").alias("feature"), F.col("s_name").alias("flow"), F.array().cast("array<string>").alias("hotspot_files"))
    return tools.hotspots(_features(d).withColumn("authors", F.array().cast("array<string>")), flows).select("feature", "health_score", "bug_fixes", "total_commits")


@query("metrics", f"""SELECT feature, n AS files_touched, bug_fixes::DOUBLE / total_commits AS bug_fix_ratio, round(n * (1 + bug_fixes::DOUBLE / total_commits) * (1 - 0.5::DOUBLE * (substr(feature, 7, 2)::DOUBLE / 100)), 6) AS impact,
  CASE WHEN sum(n * (1 + bug_fixes::DOUBLE / total_commits) * (1 - 0.5::DOUBLE * (substr(feature, 7, 2)::DOUBLE / 100))) OVER () >= 8 THEN 'critical' ELSE 'high' END AS risk
FROM metrics JOIN (SELECT p_brand AS feature, count(*) AS n FROM part WHERE {CHANGE} GROUP BY 1) USING (feature)""")
def change_impact(d: Domain) -> DataFrame:
    return tools.change_impact(_features(d), d.feature_paths, _changed(d)).withColumn("impact", F.round("impact", 6))


@query("metrics", f"""SELECT count(*) AS features, round(sum(bug_fixes::DOUBLE / total_commits * n) / sum(n), 2) AS regression_probability, CASE WHEN round(sum(bug_fixes::DOUBLE / total_commits * n) / sum(n), 2) >= 0.6 THEN 'critical'
  WHEN round(sum(bug_fixes::DOUBLE / total_commits * n) / sum(n), 2) >= 0.4 THEN 'high' WHEN round(sum(bug_fixes::DOUBLE / total_commits * n) / sum(n), 2) >= 0.2 THEN 'medium' ELSE 'low' END AS risk
FROM metrics JOIN (SELECT p_brand AS feature, count(*) AS n FROM part WHERE {CHANGE} GROUP BY 1) USING (feature)""")
def regression_risk(d: Domain) -> DataFrame:
    return tools.regression_risk(_features(d), d.feature_paths, _changed(d))


_FOLD = "list_transform(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> ''), lambda t: CASE WHEN ends_with(t, 'ing') AND length(t) >= 6 THEN t[:-4] WHEN ends_with(t, 'es') AND length(t) >= 5 THEN t[:-3] WHEN ends_with(t, 's') AND length(t) >= 4 THEN t[:-2] ELSE t END)"
_CREDIT = """list_sum(list_transform(q, lambda t: CASE WHEN list_contains({0}, t) THEN 1.0::DOUBLE
  WHEN len(list_filter({0}, lambda x: (length(t) >= 3 AND starts_with(x, t)) OR (length(x) >= 3 AND starts_with(t, x)))) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)) / 3"""


@query("", f"""WITH n AS (SELECT p_brand AS feature, count(*) AS file_count, string_agg(DISTINCT p_name, ' ') AS labels FROM part GROUP BY 1),
h AS (SELECT *, {_FOLD.format("feature")} AS a, {_FOLD.format("labels")} AS b, {_FOLD.format("'parts of ' || feature")} AS c, {_FOLD.format("'Brand 34 parts'")} AS q FROM n),
s AS (SELECT feature AS name, round(3 * {_CREDIT.format("a")} + 2 * {_CREDIT.format("b")} + {_CREDIT.format("c")}, 3) AS score, 'parts of ' || feature AS description, file_count::INTEGER AS file_count FROM h)
SELECT * FROM s WHERE score > 0 ORDER BY score DESC, name LIMIT 3""")
def find_feature(d: Domain) -> DataFrame:
    """The three best matches of a text query, scored by tokens; three is the tool's answer."""
    return tools.find_feature(_features(d), "Brand 34 parts")


@query("", f"""WITH e AS (SELECT event_type, (event_id % 2000) + 1 AS path, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 5 END AS n FROM events WHERE event_type = 'error'), f AS (SELECT p_partkey AS path FROM part WHERE p_brand = 'Brand#12')
SELECT 'Brand#12' AS feature, count(*) AS rows, sum(coalesce(n, 1))::BIGINT AS total FROM e JOIN f USING (path)""")
def feature_errors(d: Domain) -> DataFrame:
    e = d.table("events").where("event_type = 'error'").select("event_id", (F.col("event_id") % 2000 + 1).cast("string").alias("path"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 5).alias("count"))
    return tools.feature_errors(_features(d), e, "brand#12")


@query("", f"""WITH e AS (SELECT (event_id % 2000) + 1 AS path, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 5 END AS n FROM events WHERE event_type = 'view'), f AS (SELECT p_partkey AS path FROM part WHERE p_brand = 'Brand#12')
SELECT 'Brand#12' AS feature, count(*) AS rows, sum(coalesce(n, 0))::BIGINT AS total FROM e JOIN f USING (path)""")
def feature_pageviews(d: Domain) -> DataFrame:
    e = d.table("events").where("event_type = 'view'").select("event_id", (F.col("event_id") % 2000 + 1).cast("string").alias("path"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 5).alias("count"))
    return tools.feature_pageviews(_features(d), e, "Brand#12")


# -- sets and snapshots ------------------------------------------------------------


@query("", """WITH o AS (SELECT l_partkey AS path, sum(l_linenumber) AS h FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1), n AS (SELECT l_partkey AS path, sum(l_linenumber) AS h FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' OR l_partkey % 3 = 0 GROUP BY 1),
b AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'modified' END AS change FROM o FULL JOIN n ON o.path = n.path) SELECT * FROM b WHERE change IS NOT NULL""")
def hash_diff(d: Domain) -> DataFrame:
    l = d.table("lineitem")
    cut = lambda day: F.lit(day).cast("timestamp_ntz")
    side = lambda df: df.groupBy(F.col("l_partkey").alias("path")).agg(F.sum("l_linenumber").alias("hash"))
    return sets.hash_diff(side(l.where(F.col("l_shipdate") < cut("1998-01-01"))), side(l.where((F.col("l_shipdate") >= cut("1998-06-01")) | (F.col("l_partkey") % 3 == 0))))


@query("fp", """, h AS (SELECT feature, count(DISTINCT path) AS k FROM fp WHERE path IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50 AND l_tax > 0.075 AND l_returnflag = 'R') GROUP BY 1)
SELECT f.feature, k IS NOT NULL AS touched, coalesce(k, 0) AS changed_paths FROM (SELECT DISTINCT feature FROM fp) f LEFT JOIN h USING (feature)""")
def touched_partition(d: Domain) -> DataFrame:
    changed = d.table("lineitem").where("l_quantity = 50 and l_tax > 0.075 and l_returnflag = 'R'").select(F.col("l_partkey").alias("path"))
    return incremental.touched(d.feature_paths, changed)


@query("", """SELECT p_partkey::VARCHAR AS uuid, p_brand AS name, CASE WHEN p_size > 40 THEN p_size ELSE coalesce(p_size * 2, p_size) END::BIGINT AS total FROM part""")
def carry_forward(d: Domain) -> DataFrame:
    rows = d.table("part").select(F.col("p_partkey").cast("string").alias("uuid"), F.col("p_brand").alias("name"), F.col("p_size").cast("long").alias("total"), "p_size")
    return incremental.carry_forward(rows.drop("p_size"), rows.select("uuid", (F.col("total") * 2).alias("total")), rows.where("p_size > 40").select("uuid"), ["total"])


@query("", "SELECT p_partkey AS path FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49)")
def orphan_files(d: Domain) -> DataFrame:
    owned = d.table("lineitem").where("l_returnflag = 'R' and l_quantity >= 49")
    return incremental.orphans(d.table("part").select(F.col("p_partkey").alias("path")), owned.select(F.col("l_partkey").alias("path")))


@query("fp", """, o AS (SELECT p_partkey AS path, p_name || p_size AS dir, p_brand FROM part), d AS (SELECT dir, min(p_brand) AS feature FROM o WHERE path % 2 = 0 GROUP BY dir HAVING count(DISTINCT p_brand) = 1),
s AS (SELECT o.dir, count(*) AS files, max(feature) AS feature FROM o LEFT JOIN d USING (dir) WHERE path % 2 = 1 GROUP BY 1) SELECT *, CASE WHEN feature IS NOT NULL THEN 'joins' WHEN files >= 3 THEN 'new' ELSE 'left' END AS kind FROM s""")
def orphan_discovery(d: Domain) -> DataFrame:
    part = d.table("part").select(F.col("p_partkey").alias("path"), F.concat("p_name", F.col("p_size").cast("string")).alias("dir"), F.col("p_brand").alias("feature"))
    return incremental.discover(part.where("path % 2 = 1").select("path", "dir"), part.where("path % 2 = 0").select("dir", "feature"))


@query("fc", """, b AS (SELECT feature, count(*) AS n, count(*) FILTER (WHERE is_bug_fix) AS f FROM fc WHERE ts < TIMESTAMP '2000-01-01' GROUP BY 1), k AS (SELECT feature, count(*) AS n, count(*) FILTER (WHERE is_bug_fix) AS f FROM fc WHERE ts >= TIMESTAMP '2000-01-01' GROUP BY 1),
j AS (SELECT b.feature, b.n + coalesce(k.n, 0) AS total_commits, b.f + coalesce(k.f, 0) AS bug_fixes, k.n AS kn, CASE WHEN k.n > 0 THEN 100.0::DOUBLE / (1.0::DOUBLE + exp(8.0::DOUBLE * (k.f::DOUBLE / k.n - 0.55::DOUBLE))) END AS base, least(1.0::DOUBLE, k.n / 50.0::DOUBLE) AS a FROM b LEFT JOIN k USING (feature))
SELECT feature, total_commits, bug_fixes, CASE WHEN kn > 0 THEN round(base * a + base * (1 - a) * 0.8::DOUBLE, 1) ELSE 77.0 END AS health_score FROM j""")
def incremental_update(d: Domain) -> DataFrame:
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    side = lambda df: df.groupBy("feature").agg(F.count("*").alias("n"), F.sum(F.col("is_bug_fix").cast("long")).alias("f"))
    base = side(d.fc.where(F.col("ts") < cut)).select("feature", F.col("n").alias("total_commits"), F.col("f").alias("bug_fixes"), F.lit(77.0).alias("health_score"))
    return incremental.incremental_update(base, side(d.fc.where(F.col("ts") >= cut)).select("feature", F.col("n").alias("new_commits"), F.col("f").alias("new_bugs")))


@query("commits", """SELECT (SELECT count(*) FROM commits WHERE ts > TIMESTAMP '2000-06-01') AS commits_behind, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_shipdate > TIMESTAMP '2000-06-01') AS changed_files,
 (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_shipdate > TIMESTAMP '2000-06-01' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate <= TIMESTAMP '1995-06-01')) AS new_files, 578 AS days, true AS stale""")
def freshness(d: Domain) -> DataFrame:
    cut = lambda day: F.lit(day).cast("timestamp_ntz")
    l = d.table("lineitem").select(F.col("l_partkey").alias("path"), "l_shipdate")
    return incremental.freshness(d.commits, cut("2000-06-01"), cut("2001-12-31"), l.where(F.col("l_shipdate") > cut("2000-06-01")), l.where(F.col("l_shipdate") <= cut("1995-06-01")))


@query("", """WITH e AS (SELECT user_id AS repo, ts, event_type AS path FROM events), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY repo ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM e),
i AS (SELECT *, sum(new) OVER (PARTITION BY repo ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM g) SELECT repo, count(*) AS events, count(DISTINCT path) AS paths, epoch_us(min(ts)) AS started_us, epoch_us(max(ts) + INTERVAL 2 HOUR) AS fired_us FROM i GROUP BY repo, b""")
def quiet_periods(d: Domain) -> DataFrame:
    e = d.table("events").select(F.col("user_id").alias("repo"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("path"))
    return incremental.quiet_periods(e, "2 hours").select("repo", "events", "paths", F.unix_micros("started").alias("started_us"), F.unix_micros("fired").alias("fired_us"))


@query("", """WITH f AS (SELECT l_orderkey AS pos, 'B' || (l_suppkey % 7) AS feature, 'flow' || (l_partkey % 50) AS name, l_linenumber AS entry_file, (l_suppkey % 4) AS entry_line FROM lineitem)
SELECT name, entry_file, entry_line, arg_min(feature, (pos, feature)) AS feature, len(list_distinct(list(feature))) - 1 AS n_secondary FROM f GROUP BY ALL""")
def collapse_flows(d: Domain) -> DataFrame:
    f = d.table("lineitem").select(F.col("l_orderkey").alias("pos"), F.concat(F.lit("B"), (F.col("l_suppkey") % 7).cast("string")).alias("feature"), F.concat(F.lit("flow"), (F.col("l_partkey") % 50).cast("string")).alias("name"), F.col("l_linenumber").alias("entry_file"), (F.col("l_suppkey") % 4).alias("entry_line"))
    return sets.collapse_flows(f).select("name", "entry_file", "entry_line", "feature", F.size("secondary").cast("long").alias("n_secondary"))


@query("", """WITH f AS (SELECT l_suppkey AS flow, l_suppkey % 9 AS feature, l_partkey % 100 AS entry, l_partkey AS path FROM lineitem), o AS (SELECT p_partkey AS path, p_partkey % 9 AS owner FROM part),
s AS (SELECT entry, flow, feature, count(*) FILTER (WHERE owner = feature) AS own FROM f LEFT JOIN o USING (path) GROUP BY ALL),
r AS (SELECT s.*, row_number() OVER (PARTITION BY entry ORDER BY coalesce((eo.owner = feature)::INT, 0) DESC, own DESC, feature, flow) AS nth FROM s LEFT JOIN o eo ON eo.path = entry)
SELECT r.entry, r.flow, r.feature, n_paths FROM r JOIN (SELECT entry, count(DISTINCT path) AS n_paths FROM f GROUP BY 1) USING (entry) WHERE nth = 1""")
def entry_dedup(d: Domain) -> DataFrame:
    f = d.table("lineitem").select(F.col("l_suppkey").alias("flow"), (F.col("l_suppkey") % 9).alias("feature"), (F.col("l_partkey") % 100).alias("entry"), F.col("l_partkey").alias("path"))
    return sets.entry_dedup(f, d.table("part").select(F.col("p_partkey").alias("path"), (F.col("p_partkey") % 9).alias("owner"))).drop("paths")


@query("", """WITH f AS (SELECT p_brand || '/' || p_type AS name, p_brand AS parent, p_partkey AS path FROM part), g AS (SELECT parent, count(DISTINCT name) AS siblings FROM f GROUP BY 1)
SELECT CASE WHEN siblings >= 3 THEN parent ELSE name END AS name, count(DISTINCT path) AS paths, bool_or(siblings >= 3) AS collapsed FROM f JOIN g USING (parent) GROUP BY 1""")
def sibling_collapse(d: Domain) -> DataFrame:
    return sets.collapse_siblings(d.table("part").select(F.concat_ws("/", "p_brand", "p_type").alias("name"), F.col("p_brand").alias("parent"), F.col("p_partkey").alias("path")))


@query("", """WITH s AS (SELECT p_brand || p_size AS feature, p_brand AS top, count(*) AS files FROM part GROUP BY ALL), b AS (SELECT top, arg_max(feature, (files, feature)) AS target FROM s WHERE files >= 3 GROUP BY 1)
SELECT feature, CASE WHEN files >= 3 THEN feature ELSE coalesce(target, feature) END AS becomes FROM s LEFT JOIN b USING (top)""")
def small_merge(d: Domain) -> DataFrame:
    s = d.table("part").groupBy(F.concat("p_brand", F.col("p_size").cast("string")).alias("feature"), F.col("p_brand").alias("top")).agg(F.count("*").alias("files"))
    return sets.merge_small(s)


@query("", """WITH p AS (SELECT p_type || '/' || p_brand || '/' || p_partkey || CASE WHEN p_size % 3 = 0 THEN '.ts' WHEN p_size % 3 = 1 THEN '.py' ELSE '' END AS path FROM part),
k AS (SELECT path, split_part(path, '/', 1) AS top, regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) AS ext, 3 AS depth FROM p), c AS (SELECT *, count(*) OVER (PARTITION BY top, ext, depth) AS n FROM k)
SELECT top, CASE WHEN n > 1 THEN ext ELSE '*' END AS ext, CASE WHEN n > 1 THEN depth ELSE 0 END AS depth, count(*) AS paths, min(path) AS first_path FROM c GROUP BY 1, 2, 3""")
def residual_clusters(d: Domain) -> DataFrame:
    end = F.when(F.col("p_size") % 3 == 0, ".ts").when(F.col("p_size") % 3 == 1, ".py").otherwise("")
    return sets.residual_clusters(d.table("part").select(F.concat(F.concat_ws("/", "p_type", "p_brand", F.col("p_partkey").cast("string")), end).alias("path")))


@query("fp", "SELECT feature, path, is_workspace FROM (SELECT feature, path, dir LIKE 'a%' AS is_workspace FROM fp UNION ALL SELECT 'ws', path, true FROM fp) c WHERE NOT is_workspace OR path NOT IN (SELECT path FROM fp WHERE NOT dir LIKE 'a%')")
def anchor_desink(d: Domain) -> DataFrame:
    c = d.feature_paths.select("feature", "path", F.col("dir").like("a%").alias("is_workspace")).unionAll(d.feature_paths.select(F.lit("ws"), "path", F.lit(True)))
    return sets.desink(c)


@query("", """SELECT CASE WHEN n < 4 AND c < 30 AND c % 2 = 0 THEN 'shared' ELSE feature END AS becomes, feature FROM (SELECT p_brand || p_size AS feature, count(DISTINCT p_partkey) AS n, count(*) AS c FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1)""")
def tiny_and_cold(d: Domain) -> DataFrame:
    f = d.table("part").join(d.table("lineitem"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.concat("p_brand", F.col("p_size").cast("string")).alias("feature")).agg(F.countDistinct("p_partkey").alias("files"), F.count("*").alias("commits"))
    return sets.tiny_and_cold(f.withColumn("flows", F.col("commits") % 2))


@query("", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def dangling_ids(d: Domain) -> DataFrame:
    return sets.dangling(d.table("orders").select("o_orderkey", "o_custkey"), "o_custkey", d.table("customer").where("c_acctbal > 0"), "c_custkey")


# -- journeys ----------------------------------------------------------------------


ROLL_SQL = """WITH f AS (SELECT DISTINCT l_suppkey AS flow, l_partkey AS path, l_linenumber = 1 AS entry FROM lineitem), p AS (SELECT p_brand AS product, p_partkey AS path FROM part)"""


@query("", ROLL_SQL + " SELECT x.flow, y.product, CASE WHEN y.product IS NOT NULL THEN 'entry' END AS by FROM (SELECT DISTINCT flow FROM f) x LEFT JOIN (SELECT flow, min(product) AS product FROM f JOIN p USING (path) WHERE entry GROUP BY 1) y USING (flow)")
def rollup_single(d: Domain) -> DataFrame:
    return _rollup(d, "single_saas")


@query("", """WITH f AS (SELECT DISTINCT l_suppkey AS flow, l_partkey AS path FROM lineitem), p AS (SELECT p_partkey AS path, CASE WHEN p_size <= 28 THEN 'small' ELSE 'large' END AS product FROM part), n AS (SELECT flow, count(*) AS n FROM f GROUP BY 1),
k AS (SELECT flow, product, count(*) AS k FROM f JOIN p USING (path) GROUP BY ALL), r AS (SELECT k.flow, product, row_number() OVER (PARTITION BY k.flow ORDER BY k DESC, product) AS nth FROM k JOIN n USING (flow) WHERE k >= 0.5 * n)
SELECT n.flow, product, CASE WHEN product IS NOT NULL THEN 'overlap' END AS by FROM n LEFT JOIN (SELECT * FROM r WHERE nth = 1) USING (flow)""")
def rollup_universal(d: Domain) -> DataFrame:
    p = d.table("part").select(F.when(F.col("p_size") <= 28, "small").otherwise("large").alias("product"), F.col("p_partkey").alias("path"))
    return journeys.rollup(d.flow_paths, p, "universal")


def _rollup(d: Domain, kind: str) -> DataFrame:
    f = d.table("lineitem").select(F.col("l_suppkey").alias("flow"), F.col("l_partkey").alias("path"), (F.col("l_linenumber") == 1).alias("entry")).distinct()
    return journeys.rollup(f, d.table("part").select(F.col("p_brand").alias("product"), F.col("p_partkey").alias("path")), kind)


@query("", """WITH m AS (SELECT s_nationkey AS uf, l_suppkey AS flow, l_linenumber AS axis, sum(l_quantity)::BIGINT AS loc FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity = 50 GROUP BY ALL),
s AS (SELECT uf, axis, count(DISTINCT flow) >= 4 OR sum(loc) >= 2000 AS ok FROM m GROUP BY ALL), t AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY uf) >= 3 AS many FROM s)
SELECT uf, CASE WHEN many AND ok THEN uf || '/' || axis ELSE uf::VARCHAR END AS part, count(DISTINCT flow) AS flows, sum(loc)::BIGINT AS loc FROM m JOIN t USING (uf, axis) GROUP BY 1, 2""")
def journey_lattice(d: Domain) -> DataFrame:
    m = d.table("lineitem").where("l_quantity = 50").join(d.table("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy(F.col("s_nationkey").alias("uf"), F.col("l_suppkey").alias("flow"), F.col("l_linenumber").alias("axis")).agg(F.sum("l_quantity").cast("long").alias("loc"))
    return journeys.lattice(m, flows=4, loc=2000)


@query("", """SELECT o_custkey AS id, arg_max(o_orderpriority, o_orderkey) AS home, arg_max(o_orderstatus, o_orderkey) AS writer, count(*) FILTER (WHERE moved) AS overturns FROM (
  SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) IS NOT NULL AND lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <> o_orderpriority AS moved FROM orders) GROUP BY 1""")
def overturn_ledger(d: Domain) -> DataFrame:
    return journeys.last_writes(d.table("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("home"), F.col("o_orderstatus").alias("writer")))


@query("", """WITH f AS (SELECT DISTINCT lower(event_type) || '-' || (user_id % 20) || '-items' AS flow, 'd' || (event_id % 3) AS domain, CASE WHEN event_type = 'error' THEN 'cron' ELSE 'interactive' END AS trigger FROM events)
SELECT domain, regexp_extract(flow, '-(.*)s$', 1) AS resource, CASE split_part(flow, '-', 1) WHEN 'view' THEN 'browse' WHEN 'login' THEN 'execute' ELSE 'other' END AS intent, CASE WHEN trigger = 'interactive' THEN 'person' ELSE 'system' END AS space, count(*) AS flows FROM f GROUP BY 1, 2, 3, 4""")
def journey_clusters(d: Domain) -> DataFrame:
    f = d.table("events").select(F.concat(F.lower("event_type"), F.lit("-"), (F.col("user_id") % 20).cast("string"), F.lit("-items")).alias("flow"), F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string")).alias("domain"), F.when(F.col("event_type") == "error", "cron").otherwise("interactive").alias("trigger")).distinct()
    return journeys.cluster(f).drop("members")


# -- functions ---------------------------------------------------------------------


@query("", "SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week, date_diff('day', DATE '0001-01-01', CAST(date_trunc('week', o_orderdate) AS DATE)) // 7 AS week_idx FROM orders")
def iso_week(d: Domain) -> DataFrame:
    return d.table("orders").select("o_orderkey", weeks.iso_week("o_orderdate").alias("week"), weeks.week_index("o_orderdate").alias("week_idx"))


@query("", "SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def slugify(d: Domain) -> DataFrame:
    return d.table("documents").select("doc_id", text.slugify("text").alias("slug"))


@query("", r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', '') AS p FROM pages),
q AS (SELECT page_id, regexp_replace(regexp_replace(p, '/(?:\d+|[0-9a-f]{8,})(/|\.|$)', '/{param}\1', 'g'), '/+$', '') AS t FROM p) SELECT page_id, CASE WHEN t = '' THEN '/' ELSE t END AS template FROM q""")
def url_template(d: Domain) -> DataFrame:
    return d.table("pages").select("page_id", text.url_template("url").alias("template"))


@query("", r"""SELECT conv_id, turn, regexp_matches(text, '(?i)""" + "|".join(text.BUG_FIX) + r"""') AND NOT regexp_matches(text, '(?i)""" + "|".join(text.NOT_BUG_FIX) + r"""') AS is_bug_fix FROM conversations""")
def bugfix_predicate(d: Domain) -> DataFrame:
    return d.table("conversations").select("conv_id", "turn", text.is_bug_fix("text").alias("is_bug_fix"))


@query("", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(d: Domain) -> DataFrame:
    return d.table("documents").select("doc_id", text.content_hash("text").alias("hash"))


@query("", """WITH n AS (SELECT p_brand AS feature, p_name AS nm FROM part), s AS (SELECT feature, list_distinct(list(nm)) AS a FROM n GROUP BY 1)
SELECT x.feature AS f1, y.feature AS f2, len(list_intersect(x.a, y.a))::DOUBLE / (len(x.a) + len(y.a) - len(list_intersect(x.a, y.a))) AS jaccard FROM s x JOIN s y ON x.feature < y.feature AND substr(x.feature, 1, 7) = substr(y.feature, 1, 7)""")
def set_jaccard(d: Domain) -> DataFrame:
    s = d.feature_paths.groupBy("feature").agg(F.collect_set("dir").alias("a")).withColumn("k", F.substring("feature", 1, 7))
    x, y = s.select(F.col("feature").alias("f1"), F.col("a").alias("a1"), "k"), s.select(F.col("feature").alias("f2"), F.col("a").alias("a2"), "k")
    return x.join(y, "k").where("f1 < f2").select("f1", "f2", text.jaccard(F.col("a1"), F.col("a2"), 0.0).alias("jaccard"))


@query("", """SELECT count(*) AS n, count(*) FILTER (WHERE hit) AS hits, (count(*) FILTER (WHERE hit))::DOUBLE / count(*) AS recall FROM (SELECT DISTINCT p_name, p_name IN (SELECT p_name FROM part WHERE p_size < 3) AS hit FROM part)""")
def eval_recall(d: Domain) -> DataFrame:
    part = d.table("part")
    none = part.where("false").select(F.col("p_name").alias("expected"), F.col("p_name").alias("alias"))
    slug = text.slugify("p_name")
    return ev.recall(part.select(slug.alias("expected")), none, part.where("p_size < 3").select(slug.alias("found")))


@query("", """SELECT count(*) AS n, avg(CASE WHEN p_brand = 'Brand#' || (11 + p_partkey % 5) THEN 1 ELSE 0 END) AS accuracy FROM part""")
def eval_attribution(d: Domain) -> DataFrame:
    part = d.table("part")
    none = part.where("false").select(F.col("p_brand").alias("expected"), F.col("p_name").alias("alias"))
    samples = part.select(F.col("p_partkey").alias("path"), F.concat(F.lit("Brand#"), (11 + F.col("p_partkey") % 5).cast("string")).alias("expected"))
    return ev.attribution(samples, d.feature_paths, none)


def _with_checkpoints(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if not spark.sparkContext.getCheckpointDir():
            _set_checkpoints(spark)
        return f(spark, sf_dir)

    return run


for _name in ("identity_match", "import_reach", "import_components", "cocommit_claims", "test_efficacy"):
    QUERIES[_name] = _with_checkpoints(QUERIES[_name])
del _name
