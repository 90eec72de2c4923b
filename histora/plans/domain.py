"""The driver's tables read as a repository's history, and the same as SQL.

orders are commits, line items the files that they change, parts the files with brand as
feature and name as directory, suppliers flows with line ranges. README.md has the table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Domain:
    """Lazy views of one data folder; each reads only the columns it needs."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def dealt(self, name: str, rows: int) -> DataFrame:
        """A table in tasks of ``rows`` rows: texts that are made of a few bytes a row take more than the file shows."""
        table = self.table(name)
        return table.repartition(max(1, math.ceil(table.count() / rows)))

    @property
    def commits(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"), (F.col("o_orderpriority") == "1-URGENT").alias("is_bug_fix"), (F.col("o_orderstatus") == "F").alias("is_test")
        )

    @property
    def commit_files(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path")).distinct()

    @property
    def feature_paths(self) -> DataFrame:
        return self.table("part").select(F.col("p_brand").alias("feature"), F.col("p_partkey").alias("path"), F.col("p_name").alias("dir"))

    @property
    def members(self) -> DataFrame:
        return self.feature_paths.select(F.col("feature").alias("entity"), "path")

    @property
    def fc(self) -> DataFrame:
        from ..operators.metrics import feature_commits

        # lines as they are: feature_commits makes (commit, feature) distinct, so (commit, file) needn't be
        lines = self.table("lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path"))
        return feature_commits(self.commits, lines, self.feature_paths)

    @property
    def dated_fc(self) -> DataFrame:
        """fc with the time of reference, the newest commit's."""
        return self.fc.crossJoin(F.broadcast(self.commits.agg(F.max("ts").alias("as_of"))))  # one row

    @property
    def touches(self) -> DataFrame:
        from ..operators.history import entity_commits

        return entity_commits(self.commits, self.commit_files, self.members)

    @property
    def line_index(self) -> DataFrame:
        """Files with returned lines as bug fixes; every line counts."""
        return self.table("lineitem").groupBy(F.col("l_partkey").alias("path")).agg(F.count("*").alias("commits"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("bug_fixes"))

    @property
    def spans(self) -> DataFrame:
        start = F.col("l_linenumber").cast("long") * 10
        return self.table("lineitem").select(F.col("l_suppkey").alias("flow"), F.col("l_partkey").alias("path"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"))

    @property
    def flow_paths(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_suppkey").alias("flow"), F.col("l_partkey").alias("path")).distinct()

    @property
    def edges(self) -> DataFrame:
        """Imports: the parts of neighbouring lines of an order."""
        from pyspark.sql.window import Window

        after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
        return self.table("lineitem").select(F.col("l_partkey").alias("importer"), after.alias("target")).where("target is not null and importer <> target").distinct()

    @property
    def snapshots(self) -> DataFrame:
        """Imports of supplier modules into part modules, a snapshot a year of shipping."""
        return self.table("lineitem").select(F.year("l_shipdate").alias("snapshot"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("importer"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target")).distinct()


#: The same views as common table expressions.
SQL = {
    "commits": "SELECT o_orderkey AS sha, o_custkey AS author, o_orderdate AS ts, o_orderpriority = '1-URGENT' AS is_bug_fix, o_orderstatus = 'F' AS is_test FROM orders",
    "cf": "SELECT DISTINCT l_orderkey AS sha, l_partkey AS path FROM lineitem",
    "fp": "SELECT p_brand AS feature, p_partkey AS path, p_name AS dir FROM part",
    "fc": "SELECT DISTINCT feature, commits.* FROM cf JOIN fp USING (path) JOIN commits USING (sha)",
    "aged": "SELECT *, CASE WHEN age < 30 THEN 1460 ELSE greatest(365, 730 - 2 * (age - 30)) END AS units FROM (SELECT *, date_diff('second', ts, (SELECT max(ts) FROM commits)) // 86400 AS age FROM fc)",
    "touches": "SELECT feature AS entity, path, sha, ts, author, is_bug_fix, is_test, strftime(ts, '%G-W%V') AS week, date_diff('day', DATE '0001-01-01', CAST(date_trunc('week', ts) AS DATE)) // 7 AS week_idx FROM cf JOIN fp USING (path) JOIN commits USING (sha)",
    "weekly": "SELECT entity, week, week_idx, count(DISTINCT sha) AS commits, count(DISTINCT sha) FILTER (WHERE is_bug_fix) AS bug_fixes, count(DISTINCT sha) FILTER (WHERE is_test) AS test_commits, count(DISTINCT path) AS files_touched FROM touches GROUP BY ALL",
    "line_index": "SELECT l_partkey AS path, count(*) AS commits, count(*) FILTER (WHERE l_returnflag = 'R') AS bug_fixes FROM lineitem GROUP BY 1",
    "spans": "SELECT l_suppkey AS flow, l_partkey AS path, CAST(l_linenumber AS BIGINT) * 10 AS s, CAST(l_linenumber AS BIGINT) * 10 + CAST(floor(l_quantity) AS INTEGER) AS e FROM lineitem",
    "flow_paths": "SELECT DISTINCT l_suppkey AS flow, l_partkey AS path FROM lineitem",
    "edges": "SELECT DISTINCT importer, target FROM (SELECT l_partkey AS importer, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS target FROM lineitem) WHERE target IS NOT NULL AND importer <> target",
    "snaps": "SELECT DISTINCT year(l_shipdate) AS snapshot, 's' || l_suppkey AS importer, 'p' || l_partkey AS target FROM lineitem",
    "metrics": "SELECT feature, count(*) AS total_commits, count(*) FILTER (WHERE is_bug_fix) AS bug_fixes, count(DISTINCT author) AS n_authors, max(ts) AS last_modified, sum(units) AS all_units, coalesce(sum(units) FILTER (WHERE is_bug_fix), 0) AS bug_units FROM aged GROUP BY feature",
    "scored": "SELECT *, round(base * active + base * (1 - active) * 0.8, 1) AS health_score FROM (SELECT *, 100.0::DOUBLE / (1.0::DOUBLE + exp(8.0::DOUBLE * (bug_units::DOUBLE / all_units::DOUBLE - 0.55::DOUBLE))) AS base, least(1.0::DOUBLE, total_commits / 50.0::DOUBLE) AS active FROM metrics)",
    "points": "SELECT n.snapshot AS week_idx, n.entity, coalesce(r.reach, 0) AS reach, n.members_present FROM (SELECT snapshot, p_brand AS entity, count(DISTINCT target) AS members_present FROM snaps JOIN part ON target = 'p' || p_partkey GROUP BY ALL) n LEFT JOIN (SELECT snapshot, p_brand AS entity, count(DISTINCT importer) AS reach FROM snaps JOIN part ON target = 'p' || p_partkey GROUP BY ALL) r ON n.snapshot = r.snapshot AND n.entity = r.entity",
    "steps": "SELECT entity, week_idx, from_reach, reach, (reach - from_reach)::DOUBLE / greatest(from_reach, 1) AS rel, abs(reach - from_reach) AS size FROM (SELECT *, lag(reach) OVER w AS from_reach, lag(members_present) OVER w AS from_present FROM points WINDOW w AS (PARTITION BY entity ORDER BY week_idx)) WHERE members_present > 0 AND from_present > 0",
}
_NEEDS = {"fc": ("cf", "fp", "commits"), "aged": ("fc",), "touches": ("cf", "fp", "commits"), "weekly": ("touches",), "metrics": ("aged",), "scored": ("metrics",), "points": ("snaps",), "steps": ("points",)}


def with_views(names: str, body: str) -> str:
    """A query over the named views and those that they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in _NEEDS.get(name, ()):
            need(n)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + " " + body
