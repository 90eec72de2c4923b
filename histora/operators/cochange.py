"""Files that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BULK_FILES = 30


def cochange(commit_files: DataFrame, least_commits: int = 2, least_score: float = 0.25, bulk: int = BULK_FILES, top: int | None = 40) -> DataFrame:
    """Pairs of files by the Jaccard of their commits.

    Commits of more than ``bulk`` files count nowhere; that bounds the pairs of a commit at
    bulk * (bulk - 1) / 2, so the self-join by commit stays linear in the commits.
    """
    small = commit_files.select("sha", "path").distinct().withColumn("files", F.count("*").over(Window.partitionBy("sha"))).where(F.col("files") <= bulk).select("sha", "path")
    each = small.groupBy("path").agg(F.count("*").alias("n"))
    pairs = small.alias("a").join(small.alias("b"), (F.col("a.sha") == F.col("b.sha")) & (F.col("a.path") < F.col("b.path"))).groupBy(F.col("a.path").alias("file_a"), F.col("b.path").alias("file_b")).agg(F.count("*").alias("together"))
    strong = pairs.where(F.col("together") >= least_commits)
    scored = (
        strong.join(each.select(F.col("path").alias("file_a"), F.col("n").alias("n_a")), "file_a")
        .join(each.select(F.col("path").alias("file_b"), F.col("n").alias("n_b")), "file_b")
        .withColumn("score", F.col("together") / (F.col("n_a") + F.col("n_b") - F.col("together")))
        .where(F.col("score") >= least_score)
        .select("file_a", "file_b", "together", "n_a", "n_b", "score")
    )
    return scored if top is None else scored.orderBy(F.desc("score"), "file_a", "file_b").limit(top)


def cocommit_claims(commit_files: DataFrame, feature_paths: DataFrame, least: int = 2, majority: float = 0.5, size_share: float = 0.95) -> DataFrame:
    """Owners for files of no feature: the feature that most of their commits touch.

    Commits over the 95th percentile of commit size are ignored; a claim needs at
    least max(2, the 75th percentile of the co-counts) commits and half of the file's; a
    tie between the two best abstains.
    """
    cf = commit_files.select("sha", "path").distinct()
    sizes = cf.groupBy("sha").agg(F.count("*").alias("size"))
    most = sizes.agg(F.greatest(F.lit(1), F.expr(f"percentile_disc({size_share}) within group (order by size)").cast("long")).alias("most"))
    usable = sizes.crossJoin(F.broadcast(most)).where("size <= most").select("sha")  # one row
    cf = cf.join(usable, "sha", "left_semi").checkpoint()  # read four times below
    orphans = cf.join(feature_paths.select("path").distinct(), "path", "left_anti")
    touched = cf.join(feature_paths.select("path", "feature"), "path").select("sha", "feature").distinct()
    totals = orphans.groupBy("path").agg(F.count("*").alias("total"))
    co = orphans.join(touched, "sha").groupBy("path", "feature").agg(F.count("*").alias("n")).checkpoint()
    floor = co.agg(F.greatest(F.lit(least), F.expr("percentile_disc(0.75) within group (order by n)").cast("long")).alias("floor"))
    passing = co.join(totals, "path").crossJoin(F.broadcast(floor)).where((F.col("n") >= F.col("floor")) & (F.col("n") >= majority * F.col("total")))
    by = Window.partitionBy("path").orderBy(F.desc("n"))
    ranked = passing.withColumn("rank", F.rank().over(by)).where("rank = 1").withColumn("ties", F.count("*").over(Window.partitionBy("path")))
    return ranked.where("ties = 1").select("path", "feature", "n", "total", (F.col("n") / F.col("total")).alias("share"))
