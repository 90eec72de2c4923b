"""Commit metrics of features and flows: counts, health, hotspots, owners, trends.

Inputs are normalised tables: ``commits(sha, author, ts, is_bug_fix, ...)``,
``commit_files(sha, path)`` and ``feature_paths(feature, path)``. Joins are left to
the optimizer, which broadcasts a side only where its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.weeks import age_days, age_weight_units, iso_week, week_index


def feature_commits(commits: DataFrame, commit_files: DataFrame, feature_paths: DataFrame) -> DataFrame:
    """Each commit once for each feature that it touches."""
    touched = commit_files.join(feature_paths, "path").select("sha", "feature").distinct()
    return touched.join(commits, "sha")


def path_commit_index(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """path, commits, bug_fixes: a row of commit_files counts each."""
    return commit_files.join(commits.select("sha", "is_bug_fix"), "sha").groupBy("path").agg(F.count("*").alias("commits"), F.sum(F.col("is_bug_fix").cast("long")).alias("bug_fixes"))


def health(share: Column, commits: Column) -> Column:
    """Logistic around a share of 0.55, damped below 50 commits, one decimal; 100 without commits."""
    base = F.lit(100.0) / (F.lit(1.0) + F.exp(F.lit(8.0) * (share - F.lit(0.55))))
    active = F.least(F.lit(1.0), commits / F.lit(50.0))
    return F.when(commits == 0, F.lit(100.0)).otherwise(F.round(base * active + base * (F.lit(1.0) - active) * F.lit(0.8), 1))


def linear_health(share: Column, mass: Column) -> Column:
    """The other health: linear in the share, damped by the symbol-weighted mass."""
    base = F.greatest(F.lit(0.0), F.lit(100.0) - share * F.lit(200.0))
    active = F.least(F.lit(1.0), mass / F.lit(50.0))
    return F.round(base * active + base * (F.lit(1.0) - active) * F.lit(0.8), 1)


def feature_metrics(fc: DataFrame, features: DataFrame, as_of: Column) -> DataFrame:
    """Counts, share, authors, last change, health and confidence of every feature, those without commits too.

    ``fc`` comes from feature_commits, ``features`` has the column feature.
    """
    units = age_weight_units(age_days(as_of, F.col("ts")))
    counted = fc.groupBy("feature").agg(
        F.count("*").alias("total_commits"),
        F.sum(F.col("is_bug_fix").cast("long")).alias("bug_fixes"),
        F.countDistinct("author").alias("n_authors"),
        F.max("ts").alias("last_modified"),
        F.sum(units).alias("_all"),
        F.sum(F.when(F.col("is_bug_fix"), units).otherwise(F.lit(0))).alias("_bugs"),
    )
    full = features.select("feature").distinct().join(counted, "feature", "left")
    total = F.coalesce("total_commits", F.lit(0))
    floor = full.where("total_commits > 0").agg(F.expr("percentile_disc(0.25) within group (order by total_commits)").cast("long").alias("_floor"))
    out = full.crossJoin(F.broadcast(floor)).select(  # one row
        "feature",
        total.alias("total_commits"),
        F.coalesce("bug_fixes", F.lit(0)).alias("bug_fixes"),
        F.when(total > 0, F.col("bug_fixes") / F.col("total_commits")).otherwise(0.0).alias("bug_fix_ratio"),
        F.coalesce("n_authors", F.lit(0)).alias("n_authors"),
        F.coalesce(F.col("last_modified").cast("timestamp"), F.timestamp_seconds(F.lit(0))).alias("last_modified"),
        health(F.coalesce(F.col("_bugs") / F.col("_all"), F.lit(0.0)), total).alias("health_score"),
        F.when(total == 0, "insufficient").when(total < F.col("_floor"), "low").otherwise("high").alias("health_confidence"),
    )
    return out


def confidence_floor(counts: DataFrame) -> DataFrame:
    """Nearest-rank 25th percentile of the nonzero counts, 1 if there is none. counts: total_commits."""
    return counts.where("total_commits > 0").agg(F.coalesce(F.expr("percentile_disc(0.25) within group (order by total_commits)").cast("long"), F.lit(1)).alias("floor"))


def weighted_health(fc: DataFrame, as_of: Column) -> DataFrame:
    """Health by symbol shares. fc also has weight, in whole hundredths."""
    units = age_weight_units(age_days(as_of, F.col("ts"))) * F.col("weight")
    sums = fc.groupBy("feature").agg(F.sum(units).alias("a"), F.sum(F.when(F.col("is_bug_fix"), units).otherwise(0)).alias("b"), F.sum("weight").alias("m"))
    return sums.select("feature", F.when(F.col("a") == 0, 100.0).otherwise(linear_health(F.col("b") / F.col("a"), F.col("m") / 100.0)).alias("health_score"))


def hotspots(index: DataFrame, least_commits: int = 5, least_percent: int = 40) -> DataFrame:
    """Files with enough commits and a bug share at or over the mark. index: path, commits, bug_fixes."""
    return index.where((F.col("commits") >= least_commits) & (F.col("bug_fixes") * 100 >= F.col("commits") * least_percent)).select("path", "commits", "bug_fixes", (F.col("bug_fixes") / F.col("commits")).alias("bug_fix_ratio"))


def ranked_hotspots(index: DataFrame, feature_paths: DataFrame, least_commits: int = 3, over_percent: int = 40, top: int = 5) -> DataFrame:
    """The older rule: a share strictly over the mark, the worst files of each feature."""
    hot = index.where((F.col("commits") >= least_commits) & (F.col("bug_fixes") * 100 > F.col("commits") * over_percent))
    ratio = F.col("bug_fixes") / F.col("commits")
    ranked = hot.join(feature_paths, "path").withColumn("rank", F.row_number().over(Window.partitionBy("feature").orderBy(ratio.desc(), F.desc("commits"), "path")))
    return ranked.where(F.col("rank") <= top).select("feature", "rank", "path", "commits", "bug_fixes")


def bus_factor(fc: DataFrame) -> DataFrame:
    """Authors with at least a fifth of a feature's commits, one at least."""
    by_author = fc.groupBy("feature", "author").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("feature"))
    return by_author.withColumn("total", total).groupBy("feature").agg(F.greatest(F.lit(1), F.count_if((F.col("n") * 5 >= F.col("total")) & (F.col("n") >= 1))).alias("bus_factor"), F.max("total").alias("total_commits"))


def weekly_timeline(fc: DataFrame) -> DataFrame:
    """Commits, bug fixes and test commits by ISO week; weeks without commits are absent."""
    return fc.groupBy("feature", iso_week("ts").alias("week"), week_index("ts").alias("week_idx")).agg(
        F.count("*").alias("total_commits"), F.sum(F.col("is_bug_fix").cast("long")).alias("bug_fix_commits"), F.sum(F.col("is_test").cast("long")).alias("test_commits")
    )


def health_trend(timeline: DataFrame, least_points: int = 4) -> DataFrame:
    """Bug share of the first half of the weeks minus that of the second; null under four weeks."""
    by = Window.partitionBy("feature")
    placed = timeline.withColumn("i", F.row_number().over(by.orderBy("week_idx")) - 1).withColumn("n", F.count("*").over(by))
    first = F.col("i") < F.floor(F.col("n") / 2)

    def share(half: Column) -> Column:
        return F.sum(F.when(half, F.col("bug_fix_commits"))) / F.sum(F.when(half, F.col("total_commits")))

    return placed.groupBy("feature").agg(F.max("n").alias("n_weeks"), F.when(F.max("n") >= least_points, share(first) - share(~first)).alias("health_trend"))


def pull_requests(fc: DataFrame) -> DataFrame:
    """The newest bug-fix commit of each pull request of a feature. fc also has pr_number."""
    order = Window.partitionBy("feature", "pr_number").orderBy(F.desc("ts"), F.desc("sha"))
    return fc.where("is_bug_fix and pr_number is not null").withColumn("nth", F.row_number().over(order)).where("nth = 1").select("feature", "pr_number", "sha", "author", "ts")


def coverage_mean(feature_paths: DataFrame, coverage: DataFrame) -> DataFrame:
    """Mean percentage of the coverage rows whose path ends with a member's, by file name blocks.

    The join is by equality on the last path segment, then checked by suffix, so it
    isn't a product of both sides.
    """
    last = lambda c: F.element_at(F.split(F.col(c), "/"), -1)
    a = feature_paths.select("feature", "path", last("path").alias("leaf"))
    b = coverage.select(F.regexp_replace("cov_path", "^/+", "").alias("cov_path"), "pct", last("cov_path").alias("leaf"))
    hit = a.join(b, "leaf").where(F.endswith("cov_path", "path") | F.endswith("path", "cov_path"))
    first = hit.groupBy("feature", "path").agg(F.min_by("pct", "cov_path").alias("pct"))
    return first.groupBy("feature").agg(F.count("*").alias("n_files"), F.avg("pct").alias("coverage_pct"))


def digest(commits: DataFrame, commit_files: DataFrame, day: str) -> DataFrame:
    """What one day's commits touched: per author and top directory. commit_files.path is split at '/'."""
    today = commits.where(F.to_date("ts") == F.lit(day).cast("date"))
    return today.join(commit_files, "sha").groupBy("author", F.element_at(F.split("path", "/"), 1).alias("top_dir")).agg(F.countDistinct("sha").alias("commits"), F.count("*").alias("files"))


def cost_rollup(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost by stage and model. calls: stage, model, tokens_in, tokens_out; prices: model, usd_in, usd_out per million."""
    return (
        calls.join(prices, "model", "left")
        .groupBy("stage", "model")
        .agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), (F.sum(F.col("tokens_in") * F.col("usd_in") + F.col("tokens_out") * F.col("usd_out")) / 1e6).alias("usd"))
    )


def repo_summary(features: DataFrame) -> DataFrame:
    """One row of totals. features: bug_fixes, total_commits, health_score, coverage_pct (nullable)."""
    return features.agg(
        F.count("*").alias("total_features"),
        F.sum("bug_fixes").alias("total_bug_fixes"),
        F.avg("health_score").alias("avg_health_score"),
        F.count_if(F.coalesce("health_score", F.lit(100.0)) < 50).alias("features_at_risk"),
        F.avg("coverage_pct").alias("avg_coverage_pct"),
    )
