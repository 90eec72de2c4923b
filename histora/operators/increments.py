"""A feature map brought up to date by new commits: new files find their features, counts, authors and health follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ancestors
from ..functions.weeks import age_days, age_weight_units
from .metrics import health

#: FIXED VALUES: what a stem ends or begins with that says nothing of its subject, in the order in which they are tried.
STEM_ENDS = ("page", "router", "controller", "handler", "view", "service", "executor", "worker", "model", "schema", "serializer", "blueprint", "container", "dialog")
STEM_HEADS = ("v1_", "v2_", "api_")
LEAST_STEM = 3


def normal_stem(raw: Column) -> Column:
    low = F.lower(raw)
    cut = F.when(F.lit(False), low)
    for end in STEM_ENDS:
        cut = cut.when(F.endswith(low, F.lit(end)) & (F.length(low) > len(end)), F.substring(low, F.lit(1), F.length(low) - len(end)))
    bare = cut.otherwise(low)
    out = F.when(F.lit(False), bare)
    for head in STEM_HEADS:
        out = out.when(F.startswith(bare, F.lit(head)), F.substring(bare, F.lit(len(head) + 1), F.length(bare)))
    return F.regexp_replace(out.otherwise(bare), r"^[_\- ]+|[_\- ]+$", "")


def feature_stems(features: DataFrame) -> DataFrame:
    """stem, feature and place: the stems that features' names give. features: feature, pos.

    A stem means the last feature that gives it, and stands where the first one did.
    """
    name = F.col("feature")
    other = F.when(F.endswith(name, F.lit("s")), F.substring(name, F.lit(1), F.length(name) - 1)).otherwise(F.concat(name, F.lit("s")))
    each = features.select("feature", "pos", F.posexplode(F.concat(F.array(name), F.split(name, "-"), F.array(other))).alias("nth", "stem")).where(F.length("stem") >= LEAST_STEM)
    at = F.struct("pos", "nth")
    return each.groupBy("stem").agg(F.max_by("feature", at).alias("feature"), F.min(at).alias("place"))


def match_stems(asked: DataFrame, stems: DataFrame) -> DataFrame:
    """asked and feature: an equal stem, else the longest that the asked one begins with, that begins with it, or that is a part of it.

    asked: asked, each once. All by equi-joins on heads and parts.
    """
    asked = asked.where("asked <> ''")
    heads = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(c, F.lit(1), n))
    long = F.filter(heads(F.col("asked")), lambda h: F.length(h) >= LEAST_STEM)
    own = F.array_distinct(F.concat(long, F.filter(F.split("asked", "[_-]"), lambda p: F.length(p) >= LEAST_STEM)))
    down = asked.select("asked", F.explode(own).alias("stem")).join(stems, "stem")
    up = stems.select("stem", "feature", "place", F.explode(heads(F.col("stem"))).alias("asked")).join(asked, "asked").select("stem", "asked", "feature", "place")
    met = down.select("stem", "asked", "feature", "place").unionByName(up)
    order = F.struct((F.col("stem") != F.col("asked")).alias("inexact"), (-F.length("stem")).alias("less"), "place")
    return met.groupBy("asked").agg(F.min_by("feature", order).alias("feature"))


PATH, DIR, STEM, FOLDER = "path", "dir", "stem", "folder"


def assign_files(features: DataFrame, paths: DataFrame, files: DataFrame) -> DataFrame:
    """path, feature and by (path, dir, stem, folder; null if nothing fits) of each file.

    features: feature, pos; paths: feature, path, pos (its place in the feature); files: path. A file is its own feature's;
    else that of the nearest directory above it that a feature has a file in, the first such feature; else that whose
    name its stem fits, or that of a directory above it, the nearest first.
    """
    files = files.select("path").where("path is not null").distinct()
    placed = paths.join(features.select("feature", F.col("pos").alias("_f")), "feature")
    # a path of several features is the last one's, a directory the first one's
    exact = placed.groupBy("path").agg(F.max_by("feature", F.struct("_f", "pos")).alias("feature"))
    home = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    dirs = placed.where(home != "").groupBy(home.alias("dir")).agg(F.min_by("feature", F.struct("_f", "pos")).alias("owner"))
    known = files.join(exact, "path", "left")
    new = known.where("feature is null").select("path").checkpoint()
    near = new.select("path", F.posexplode(ancestors("path")).alias("nth", "dir")).join(dirs, "dir").groupBy("path").agg(F.min_by("owner", "nth").alias("feature"))
    by_dir = near.select("path", "feature", F.lit(DIR).alias("by"))
    rest = new.join(near.select("path"), "path", "left_anti")
    parts = F.split("path", "/")
    leaf = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    names = F.concat(F.array(leaf), F.reverse(F.slice(parts, F.lit(1), F.size(parts) - 1)))
    tried = rest.select("path", F.posexplode(F.transform(names, normal_stem)).alias("nth", "asked")).checkpoint()
    fits = match_stems(tried.select("asked").distinct(), feature_stems(features))
    by_name = tried.join(fits, "asked").groupBy("path").agg(F.min(F.struct("nth", "feature")).alias("x"))
    named = by_name.select("path", F.col("x.feature").alias("feature"), F.when(F.col("x.nth") == 0, STEM).otherwise(FOLDER).alias("by"))
    homed = by_dir.unionByName(named)
    return known.where("feature is not null").withColumn("by", F.lit(PATH)).unionByName(new.join(homed, "path", "left").select("path", "feature", "by"))


def update_map(features: DataFrame, paths: DataFrame, commits: DataFrame, commit_files: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The map's features, its paths and its pull requests after new commits.

    features: feature, pos, total_commits, bug_fixes, bug_fix_ratio, authors, last_modified, health_score; paths as of assign_files;
    commits: sha, author, ts, is_bug_fix, pr_number; commit_files: sha, path. A feature that no commit touches stays as it is. Health
    is by the share of bug fixes among the new commits, weighed by their age, and by the number of all of its commits.
    """
    assigned = assign_files(features, paths, commit_files.select("path")).where("feature is not null").checkpoint()
    touched = commit_files.select("sha", "path").distinct().join(assigned, "path").select("feature", "sha").distinct().join(commits, "sha").checkpoint()
    units = age_weight_units(age_days(as_of, F.col("ts")))
    fresh = touched.groupBy("feature").agg(
        F.count("*").alias("_n"), F.count_if("is_bug_fix").alias("_bugs"), F.collect_set("author").alias("_authors"), F.max("ts").alias("_ts"), F.sum(units).alias("_all"), F.sum(F.when(F.col("is_bug_fix"), units).otherwise(0)).alias("_weighed")
    )
    met = features.join(fresh, "feature", "left")
    n = F.coalesce("_n", F.lit(0))
    total, bugs = F.col("total_commits") + n, F.col("bug_fixes") + F.coalesce("_bugs", F.lit(0))
    changed = F.col("_n").isNotNull()
    out = met.select(
        "feature", "pos", total.alias("total_commits"), bugs.alias("bug_fixes"), F.when(changed, F.round(bugs / total, 3)).otherwise(F.col("bug_fix_ratio")).alias("bug_fix_ratio"),
        F.when(changed, F.array_sort(F.array_union(F.coalesce("authors", F.array().cast("array<string>")), "_authors"))).otherwise(F.col("authors")).alias("authors"),
        F.greatest("last_modified", "_ts").alias("last_modified"), F.when(changed, health(F.col("_weighed") / F.col("_all"), total)).otherwise(F.col("health_score")).alias("health_score"),
    )
    last = paths.groupBy("feature").agg(F.max("pos").alias("_last"))
    added = assigned.where(F.col("by") != PATH).join(last, "feature", "left").select("feature", "path", (F.coalesce("_last", F.lit(-1)) + 1).alias("pos"))
    prs = touched.where("is_bug_fix and pr_number is not null").groupBy("feature", F.col("pr_number").alias("number")).agg(F.max("ts").alias("ts"))
    return out, paths.select("feature", "path", "pos").unionByName(added), prs
