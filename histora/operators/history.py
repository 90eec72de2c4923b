"""Weekly history of entities: series, events around them, and their confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.weeks import iso_week, week_index

TRAILING_WEEKS = 13


def entity_commits(commits: DataFrame, commit_files: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (entity, sha, path, ts, ...) of a member file changed by a commit; an entity may share files."""
    return commit_files.join(members, "path").join(commits, "sha")


def weekly_history(touches: DataFrame) -> DataFrame:
    """Sparse weekly points of each entity; a commit counts once, a file once a week."""
    week = [F.col("entity"), iso_week("ts").alias("week"), week_index("ts").alias("week_idx")]
    commits = touches.select(*week, "sha", "is_bug_fix", "is_test").distinct().groupBy("entity", "week", "week_idx").agg(
        F.count("*").alias("commits"), F.sum(F.col("is_bug_fix").cast("long")).alias("bug_fixes"), F.sum(F.col("is_test").cast("long")).alias("test_commits")
    )
    files = touches.select(*week, "path").distinct().groupBy("entity", "week_idx").agg(F.count("*").alias("files_touched"))
    return commits.join(files, ["entity", "week_idx"]).withColumn("bugfix_share", F.col("bug_fixes") / F.col("commits"))


def trailing(weekly: DataFrame, weeks: int = TRAILING_WEEKS) -> DataFrame:
    """Commits and bug fixes over the last weeks by week number, not by rows, as weeks are sparse."""
    w = Window.partitionBy("entity").orderBy("week_idx").rangeBetween(-(weeks - 1), 0)
    out = weekly.select("entity", "week", "week_idx", F.sum("commits").over(w).alias("trailing_commits"), F.sum("bug_fixes").over(w).alias("trailing_bugs"))
    share = F.col("trailing_bugs") / F.col("trailing_commits")
    return out.withColumn("health_lite", F.round(F.lit(100.0) * (F.lit(1.0) - share), 1))


def activity_gate(weekly: DataFrame) -> DataFrame:
    """Entities under the median of all entities' commits."""
    totals = weekly.groupBy("entity").agg(F.sum("commits").alias("total"))
    median = totals.agg(F.expr("percentile(total, 0.5)").alias("median"))
    return totals.crossJoin(F.broadcast(median)).select("entity", "total", "median", (F.col("total") < F.col("median")).alias("gated"))  # one row


def share_shift(before_bugs, before_n, after_bugs, after_n):
    """down, up or no_change: a move of the share over the pooled two-proportion standard error."""
    pooled = (before_bugs + after_bugs) / (before_n + after_n)
    se = F.sqrt(F.greatest(pooled * (F.lit(1.0) - pooled), F.lit(1e-12)) * (F.lit(1.0) / before_n + F.lit(1.0) / after_n))
    delta = before_bugs / before_n - after_bugs / after_n
    return F.when(delta > se, "down").when(-delta > se, "up").otherwise("no_change")


def test_efficacy(weekly: DataFrame, gates: DataFrame | None = None) -> DataFrame:
    """Bug share before and from the first test week on, with a verdict; the pivot week is after.

    Without gates, entities under the median of all commits are gated, by the sums that are made here anyway.
    """
    joined = weekly.withColumn("pivot", F.min(F.when(F.col("test_commits") > 0, F.col("week_idx"))).over(Window.partitionBy("entity")))
    before = F.col("week_idx") < F.col("pivot")

    def total(c: str, side):
        return F.coalesce(F.sum(F.when(side, F.col(c))), F.lit(0))

    sums = joined.groupBy("entity").agg(
        F.max("pivot").alias("pivot"), F.sum("commits").alias("total"), total("commits", before).alias("n_before"), total("bug_fixes", before).alias("b_before"), total("commits", ~before).alias("n_after"), total("bug_fixes", ~before).alias("b_after")
    )
    if gates is None:
        sums = sums.checkpoint()  # a row an entity
        median = sums.agg(F.expr("percentile(total, 0.5)").alias("median"))
        gates = sums.select("entity", "total").crossJoin(F.broadcast(median)).select("entity", (F.col("total") < F.col("median")).alias("gated"))  # one row
    shift = share_shift(F.col("b_before"), F.col("n_before"), F.col("b_after"), F.col("n_after"))
    verdict = (
        F.when(F.col("gated") | F.col("pivot").isNull() | (F.col("n_before") == 0) | (F.col("n_after") == 0), "insufficient_data")
        .when(shift == "down", "improved").when(shift == "up", "worsened").otherwise("no_change")
    )
    return sums.join(gates.select("entity", "gated"), "entity").select("entity", F.col("pivot").alias("pivot_week_idx"), F.col("n_before").alias("commits_before"), F.col("n_after").alias("commits_after"), verdict.alias("verdict"))


def test_waves(weekly: DataFrame, q: float = 0.75) -> DataFrame:
    """Starts of runs of weeks whose test commits are over the entity's own 75th percentile of nonzero weeks."""
    mark = weekly.where("test_commits > 0").groupBy("entity").agg(F.expr(f"percentile(test_commits, {q})").alias("mark"))
    w = Window.partitionBy("entity").orderBy("week_idx")
    waves = weekly.join(mark, "entity").withColumn("wave", F.col("test_commits") > F.col("mark"))
    placed = waves.withColumn("prior", F.lag("wave").over(w)).withColumn("prior_idx", F.lag("week_idx").over(w))
    goes_on = F.coalesce(F.col("prior") & (F.col("prior_idx") + 1 == F.col("week_idx")), F.lit(False))
    return placed.where(F.col("wave") & ~goes_on).select("entity", "week", "week_idx", "test_commits", "mark")


def hotspot_emergence(touches: DataFrame, least_commits: int = 5, least_percent: int = 40) -> DataFrame:
    """First week in which a file of the entity has enough commits and bug share so far; the week counts whole."""
    by_week = touches.groupBy("entity", "path", week_index("ts").alias("week_idx")).agg(F.count("*").alias("n"), F.sum(F.col("is_bug_fix").cast("long")).alias("b"))
    so_far = Window.partitionBy("entity", "path").orderBy("week_idx").rowsBetween(Window.unboundedPreceding, 0)
    run = by_week.select("entity", "path", "week_idx", F.sum("n").over(so_far).alias("n"), F.sum("b").over(so_far).alias("b"))
    hot = run.where((F.col("n") >= least_commits) & (F.col("b") * 100 >= F.col("n") * least_percent))
    first = hot.groupBy("entity").agg(F.min(F.struct("week_idx", "path")).alias("x"))
    return first.select("entity", F.col("x.week_idx").alias("week_idx"), F.col("x.path").alias("path"))


def history_confidence(touches: DataFrame, members: DataFrame) -> DataFrame:
    """Share of member files first touched by birth plus a quarter of the active span; untouched files count as older."""
    touched = touches.groupBy("entity", "path").agg(F.min(week_index("ts")).alias("first"), F.max(week_index("ts")).alias("last"))
    span = touched.groupBy("entity").agg(F.min("first").alias("birth"), F.max("last").alias("end"))
    cutoff = F.col("birth") + F.ceil((F.col("end") - F.col("birth")) * 0.25)
    each = members.select("entity", "path").distinct().join(span, "entity").join(touched.select("entity", "path", "first"), ["entity", "path"], "left")
    existing = F.coalesce(F.col("first"), F.col("birth")) <= cutoff
    return each.groupBy("entity").agg(F.count("*").alias("n_files"), F.sum(existing.cast("long")).alias("n_existing")).withColumn("confidence", F.col("n_existing") / F.col("n_files"))


def cross_cuts(touches: DataFrame, members: DataFrame, flows: DataFrame, top: int = 5) -> DataFrame:
    """Foreign flows that share files with an entity: when the last of the shared files was first touched.

    flows: flow, path, owner (an entity). The five with the most shared files a entity.
    """
    first = touches.groupBy("entity", "path").agg(F.min(week_index("ts")).alias("first"))
    shared = members.select("entity", "path").distinct().join(flows.select("flow", "path", "owner").distinct(), "path").where("owner <> entity")
    met = shared.join(first, ["entity", "path"], "left").groupBy("entity", "flow").agg(F.count("*").alias("n_shared"), F.max("first").alias("week_idx"))
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("n_shared"), "flow"))
    return met.withColumn("rank", rank).where(F.col("rank") <= top)


def impact_steps(points: DataFrame) -> DataFrame:
    """Steps between neighbouring snapshots in which the entity exists. points: entity, week_idx, reach, members_present."""
    w = Window.partitionBy("entity").orderBy("week_idx")
    both = points.withColumn("from_reach", F.lag("reach").over(w)).withColumn("from_present", F.lag("members_present").over(w))
    step = F.col("reach") - F.col("from_reach")
    return both.where("members_present > 0 and from_present > 0").select("entity", "week_idx", "from_reach", "reach", (step / F.greatest("from_reach", F.lit(1))).alias("rel"), F.abs(step).alias("size"))


def impact_events(points: DataFrame, least_points: int = 3) -> DataFrame:
    """Steps over the 90th percentile of all relative steps and the median of all absolute ones."""
    steps = impact_steps(points)
    pooled = steps.where("size > 0").agg(F.expr("percentile(abs(rel), 0.9)").alias("rel_mark"), F.expr("percentile(size, 0.5)").alias("size_mark"))
    long = points.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") >= least_points).select("entity")
    return (
        steps.join(long, "entity", "left_semi").crossJoin(F.broadcast(pooled))  # one row
        .where((F.abs("rel") > F.col("rel_mark")) & (F.col("size") > F.col("size_mark")))
        .select("entity", "week_idx", F.when(F.col("rel") > 0, "coupling_spike").otherwise("decoupled").alias("kind"), "from_reach", "reach")
    )


def impact_trend(points: DataFrame) -> DataFrame:
    """growing, shrinking or stable: first against last snapshot, beyond the median of all relative steps."""
    band = impact_steps(points).where("size > 0").agg(F.coalesce(F.expr("percentile(abs(rel), 0.5)"), F.lit(0.0)).alias("band"))
    alive = points.where("members_present > 0").groupBy("entity").agg(F.count("*").alias("n"), F.min_by("reach", "week_idx").alias("first"), F.max_by("reach", "week_idx").alias("last"))
    rel = (F.col("last") - F.col("first")) / F.greatest("first", F.lit(1))
    return alive.where("n >= 2").crossJoin(F.broadcast(band)).select("entity", "first", "last", F.when(rel > F.col("band"), "growing").when(-rel > F.col("band"), "shrinking").otherwise("stable").alias("trend"))


def evenly_spaced(commits: DataFrame, n: int = 8) -> DataFrame:
    """At most n commits spaced evenly by position, then the last of each ISO week. commits: sha, ts.

    Positions come from a count per day and a running total over the days, so the
    numbering of commits is not one task's work: a window per day numbers them.
    """
    days = commits.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    before = days.select("day", (F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.lit(0).alias("k"))
    total = commits.agg(F.count("*").alias("m"))
    nth = F.row_number().over(Window.partitionBy(F.to_date("ts")).orderBy("ts", "sha")) - 1
    placed = commits.select("sha", "ts", F.to_date("ts").alias("day"), nth.alias("nth")).join(before, "day").withColumn("i", F.col("before") + F.col("nth")).crossJoin(F.broadcast(total))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.bround(k * (F.col("m") - 1) / F.lit(max(n - 1, 1))).cast("long"))
    picked = placed.where(F.array_contains(wanted, F.col("i").cast("long")))
    return picked.groupBy(iso_week("ts").alias("week")).agg(F.max_by("sha", F.struct("ts", "sha")).alias("sha"), F.max("ts").alias("ts"))
