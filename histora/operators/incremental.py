"""What changes from one snapshot to the next, and what can be carried over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import health


def touched(feature_paths: DataFrame, changed: DataFrame) -> DataFrame:
    """Features with a changed path, and their number. feature_paths: feature, path; changed: path."""
    hit = feature_paths.join(changed.select("path").distinct(), "path").groupBy("feature").agg(F.countDistinct("path").alias("changed_paths"))
    return feature_paths.select("feature").distinct().join(hit, "feature", "left").select("feature", F.col("changed_paths").isNotNull().alias("touched"), F.coalesce("changed_paths", F.lit(0)).alias("changed_paths"))


def rehydrate(partition: DataFrame, base: DataFrame, fresh: DataFrame) -> DataFrame:
    """Untouched features from the base by name, touched ones from the fresh scan. Both: feature and the same columns."""
    kept = base.join(partition.where("not touched").select("feature"), "feature", "left_semi").withColumn("origin", F.lit("base"))
    return kept.unionByName(fresh.join(partition.where("touched").select("feature"), "feature", "left_semi").withColumn("origin", F.lit("scan")))


def carry_forward(new: DataFrame, base: DataFrame, touched_ids: DataFrame, metrics: list[str]) -> DataFrame:
    """Base metrics on the rows that nothing touched; new ones elsewhere or where the base has none."""
    b = base.select("uuid", *(F.col(m).alias(f"_b_{m}") for m in metrics))
    t = touched_ids.select("uuid", F.lit(True).alias("_touched"))
    joined = new.join(b, "uuid", "left").join(t, "uuid", "left")
    fresh = F.coalesce("_touched", F.lit(False))
    return joined.select(*(c for c in new.columns if c not in metrics), *(F.when(fresh, F.col(m)).otherwise(F.coalesce(f"_b_{m}", m)).alias(m) for m in metrics))


def orphans(files: DataFrame, feature_paths: DataFrame) -> DataFrame:
    return files.select("path").distinct().join(feature_paths.select("path"), "path", "left_anti")


def discover(orphan_files: DataFrame, feature_dirs: DataFrame, least: int = 3) -> DataFrame:
    """Orphans go to the only feature of their directory; the rest make new features from three files a directory on.

    orphan_files: path, dir; feature_dirs: dir, feature.
    """
    only = feature_dirs.groupBy("dir").agg(F.min("feature").alias("feature"), F.countDistinct("feature").alias("n")).where("n = 1").drop("n")
    homed = orphan_files.join(only, "dir", "left")
    sized = homed.groupBy("dir").agg(F.count("*").alias("files"), F.max("feature").alias("feature"))
    kind = F.when(F.col("feature").isNotNull(), "joins").when(F.col("files") >= least, "new").otherwise("left")
    return sized.select("dir", "files", "feature", kind.alias("kind"))


def incremental_update(base: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored counts plus those of new commits. Health comes from the new commits alone where there are any: that
    is the behaviour of the update, not of a full scan (see feature_metrics for that).

    base: feature, total_commits, bug_fixes, health_score; fresh: feature, new_commits, new_bugs.
    """
    joined = base.join(fresh, "feature", "left")
    n, b = F.coalesce("new_commits", F.lit(0)), F.coalesce("new_bugs", F.lit(0))
    return joined.select(
        "feature",
        (F.col("total_commits") + n).alias("total_commits"),
        (F.col("bug_fixes") + b).alias("bug_fixes"),
        F.when(n > 0, health(b / n, n)).otherwise(F.col("health_score")).alias("health_score"),
    )


def freshness(commits: DataFrame, since, as_of, changed: DataFrame, known: DataFrame) -> DataFrame:
    """One row: commits and days since the last snapshot, changed files, files not known before."""
    behind = commits.agg(F.count_if(F.col("ts") > since).alias("commits_behind"))
    files = changed.select("path").distinct().join(known.select("path", F.lit(True).alias("_known")).distinct(), "path", "left").agg(F.count("*").alias("changed_files"), F.count_if(F.col("_known").isNull()).alias("new_files"))
    return behind.crossJoin(files).select("commits_behind", "changed_files", "new_files", F.datediff(as_of, since).alias("days"), ((F.col("commits_behind") > 0) | (F.col("changed_files") > 0)).alias("stale"))  # one row each


def quiet_periods(events: DataFrame, gap: str = "30 seconds") -> DataFrame:
    """Bursts of file events, each ended by a time of silence; works on streams with a watermark too. events: repo, ts, path."""
    return events.groupBy("repo", F.session_window("ts", gap).alias("burst")).agg(F.count("*").alias("events"), F.size(F.collect_set("path")).cast("long").alias("paths")).select("repo", F.col("burst.start").alias("started"), F.col("burst.end").alias("fired"), "events", "paths")
