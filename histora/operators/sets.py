"""Diffs, dedup, merges and splits of feature and flow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import directory, extension


def hash_diff(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """added, removed and modified rows by content hash. old, new: keys, hash."""
    keys = keys or ["path"]
    both = old.select(*keys, F.col("hash").alias("old_hash")).join(new.select(*keys, F.col("hash").alias("new_hash")), keys, "full_outer")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return both.select(*keys, change.alias("change")).where("change is not null")


def identical_flows(flows: DataFrame) -> DataFrame:
    """One row for flows of one feature with the same name, entry file and line; the first in order. flows has pos."""
    by = Window.partitionBy("feature", "name", "entry_file", "entry_line").orderBy("pos")
    return flows.withColumn("_nth", F.row_number().over(by)).where("_nth = 1").drop("_nth")


def collapse_flows(flows: DataFrame) -> DataFrame:
    """Flows of the same name and entry over features: the first is primary, the others' features its secondaries."""
    by = Window.partitionBy("name", "entry_file", "entry_line").orderBy("pos", "feature")
    ranked = flows.withColumn("_nth", F.row_number().over(by))
    out = ranked.groupBy("name", "entry_file", "entry_line").agg(F.min_by("feature", "_nth").alias("feature"), F.array_sort(F.collect_set("feature")).alias("_all"))
    return out.select("name", "entry_file", "entry_line", "feature", F.array_remove("_all", F.col("feature")).alias("secondary"))


def entry_dedup(flow_paths: DataFrame, owners: DataFrame) -> DataFrame:
    """One flow an entry: that whose feature owns the entry file, then most own paths, then names; the winner takes all paths.

    flow_paths: flow, feature, entry, path; owners: path, owner.
    """
    own = flow_paths.join(owners.withColumnRenamed("owner", "_owner"), "path", "left")
    entry_owner = owners.select(F.col("path").alias("entry"), F.col("owner").alias("_entry_owner"))
    sized = own.groupBy("entry", "flow", "feature").agg(F.count_if(F.col("_owner") == F.col("feature")).alias("_own")).join(entry_owner, "entry", "left")
    order = Window.partitionBy("entry").orderBy(F.coalesce((F.col("_entry_owner") == F.col("feature")).cast("int"), F.lit(0)).desc(), F.desc("_own"), "feature", "flow")
    winner = sized.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select("entry", "flow", "feature")
    paths = flow_paths.groupBy("entry").agg(F.countDistinct("path").alias("n_paths"), F.array_sort(F.collect_set("path")).alias("paths"))
    return winner.join(paths, "entry")


def collapse_siblings(features: DataFrame, least: int = 3) -> DataFrame:
    """Route-shaped features under one parent directory become one if there are at least three. features: name, parent, path."""
    groups = features.groupBy("parent").agg(F.countDistinct("name").alias("siblings"))
    joined = features.join(groups, "parent")
    name = F.when(F.col("siblings") >= least, F.col("parent")).otherwise(F.col("name"))
    return joined.groupBy(name.alias("name")).agg(F.countDistinct("path").alias("paths"), F.max(F.col("siblings") >= least).alias("collapsed"))


def merge_small(sizes: DataFrame, least: int = 3) -> DataFrame:
    """Features under three files go to the largest one of their top directory. sizes: feature, top, files."""
    best = sizes.where(F.col("files") >= least).groupBy("top").agg(F.max_by("feature", F.struct("files", "feature")).alias("into"))
    small = sizes.where(F.col("files") < least).join(best, "top", "left")
    kept = sizes.where(F.col("files") >= least).select("feature", F.col("feature").alias("becomes"))
    return kept.unionAll(small.select("feature", F.coalesce("into", "feature").alias("becomes")))


def split_large(paths: DataFrame, most: int = 100, rounds: int = 8) -> DataFrame:
    """Splits features over ``most`` files by the next path level, at most ``rounds`` levels deep. paths: feature, path."""
    out = paths.select("feature", "path", F.col("feature").alias("part"), F.lit(0).alias("level"))
    for k in range(1, rounds + 1):
        n = F.count("*").over(Window.partitionBy("part"))
        segment = F.try_element_at(F.split("path", "/"), F.lit(k))
        deeper = (F.col("_n") > most) & (F.size(F.split("path", "/")) > k)
        out = out.withColumn("_n", n).withColumn("part", F.when(deeper, F.concat_ws("/", "part", segment)).otherwise(F.col("part"))).withColumn("level", F.when(deeper, k).otherwise(F.col("level"))).drop("_n")
    return out


#: FIXED VALUES: directories that split nothing off, and files that are no part of their own.
SPLIT_FROM = 40
TECHNICAL_DIRS = ("tests", "test", "__tests__", "migrations", "templates", "static")
SUPPORT_DIRS = ("tests", "test", "__tests__", "migrations", "templates", "static", "management", "templatetags", "locale")
SUPPORT_STEMS = ("__init__", "apps", "urls", "admin", "conftest", "setup", "config")


def split_features(paths: DataFrame, most: int = SPLIT_FROM) -> DataFrame:
    """Features of more files than ``most`` by the directory after their common one, else by the files' stems: feature, path, part.

    paths: feature, path. Directories split a feature if they make three parts or more, each under 0.7 of it; technical ones
    stay with the rest. Else stems of two files or more do, if they make three parts besides the rest, under the same share. What
    splits neither way stays whole. Everything is a count by (feature, part), joined back; no feature is gathered.
    """
    p = paths.select("feature", "path").distinct().withColumn("parts", F.split("path", "/"))
    # the common prefix of all is that of the first and the last in order, within the shortest
    whole = p.groupBy("feature").agg(F.count("*").alias("n"), F.min("parts").alias("low"), F.max("parts").alias("high"), F.min(F.size("parts")).alias("short"))
    agrees = F.zip_with("low", "high", lambda a, b: F.coalesce(a == b, F.lit(False)))
    same = F.array_position(F.concat(agrees, F.array(F.lit(False))), False).cast("int") - 1
    big = whole.where(F.col("n") > most).select("feature", "n", F.least(same, F.col("short")).alias("prefix"))
    seen = p.join(big, "feature")

    leaf = F.element_at("parts", -1)
    stem = F.lower(F.regexp_replace(leaf, r"(?<=.)\.[^.]*$", ""))
    holder = F.lower(F.coalesce(F.try_element_at("parts", F.lit(-2)), F.lit("")))
    below = F.lower(F.try_element_at("parts", F.col("prefix") + 1))
    deeper = (F.col("prefix") < F.size("parts") - 1) & ~below.isin(*TECHNICAL_DIRS)
    support = holder.isin(*SUPPORT_DIRS) | stem.isin(*SUPPORT_STEMS) | stem.rlike("^tests?_")
    seen = seen.select("feature", "path", "n", F.when(deeper, F.concat_ws("-", "feature", below)).otherwise(F.col("feature")).alias("by_dir"), F.when(~support, F.concat_ws("-", "feature", stem)).alias("by_stem"))

    dirs = seen.groupBy("feature", "n", "by_dir").agg(F.count("*").alias("k")).groupBy("feature", "n").agg(F.count("*").alias("groups"), F.max("k").alias("largest"))
    first = dirs.where((F.col("groups") > 2) & (F.col("largest") < F.col("n") * 0.7)).select("feature", F.lit("dir").alias("way"))
    stems = seen.groupBy("feature", "n", "by_stem").agg(F.count("*").alias("k"))
    own = F.col("by_stem").isNotNull() & (F.col("k") > 1)
    kept = stems.where(own).select("feature", "by_stem", F.lit(True).alias("own"))
    rest = F.sum(F.when(~own, F.col("k")).otherwise(0))
    second = stems.groupBy("feature", "n").agg((F.count_if(own) + 1).alias("groups"), F.greatest(F.max(F.when(own, F.col("k")).otherwise(0)), rest).alias("largest"))
    second = second.where((F.col("groups") > 3) & (F.col("largest") < F.col("n") * 0.7)).join(first, "feature", "left_anti").select("feature", F.lit("stem").alias("way"))

    placed = seen.join(first.unionByName(second), "feature", "left").join(kept, ["feature", "by_stem"], "left")
    part = F.when(F.col("way") == "dir", F.col("by_dir")).when((F.col("way") == "stem") & F.col("own"), F.col("by_stem")).otherwise(F.col("feature"))
    small = p.join(big.select("feature"), "feature", "left_anti").select("feature", "path", F.col("feature").alias("part"))
    return placed.select("feature", "path", part.alias("part")).unionByName(small)


def residual_clusters(paths: DataFrame) -> DataFrame:
    """Unowned paths by top directory, extension and depth (1, 2, 3 or more); single ones go to their top directory's rest."""
    parts = F.split("path", "/")
    keyed = paths.select("path", F.when(F.size(parts) > 1, parts[0]).otherwise("").alias("top"), extension("path").alias("ext"), F.least(F.size(parts), F.lit(3)).alias("depth"))
    sized = keyed.withColumn("_n", F.count("*").over(Window.partitionBy("top", "ext", "depth")))
    ext, depth = F.when(F.col("_n") > 1, F.col("ext")).otherwise("*"), F.when(F.col("_n") > 1, F.col("depth")).otherwise(0)
    return sized.groupBy("top", ext.alias("ext"), depth.alias("depth")).agg(F.count("*").alias("paths"), F.min("path").alias("first_path"))


def desink(claims: DataFrame) -> DataFrame:
    """Workspace anchors lose the paths that a specific feature claims. claims: feature, path, is_workspace."""
    specific = claims.where("not is_workspace").select("path").distinct()
    return claims.where("not is_workspace").unionByName(claims.where("is_workspace").join(specific, "path", "left_anti").select(*claims.columns))


def strip_paths(features: DataFrame, drop) -> DataFrame:
    """features without the paths for which ``drop`` holds, with what went. features: feature, path."""
    return features.groupBy("feature").agg(F.count_if(~drop).alias("kept"), F.count_if(drop).alias("stripped"))


def tiny_and_cold(features: DataFrame, files: int = 4, commits: int = 30) -> DataFrame:
    """Features with few files, few commits and no flow fold into a shared bucket. features: feature, files, commits, flows."""
    cold = (F.col("files") < files) & (F.col("commits") < commits) & (F.col("flows") == 0)
    return features.select("feature", F.when(cold, "shared").otherwise(F.col("feature").cast("string")).alias("becomes"))


def all_non_source(paths: DataFrame, non_source) -> DataFrame:
    """Features all of whose paths are documents, settings or assets."""
    return paths.groupBy("feature").agg(F.bool_and(non_source).alias("_all")).where("_all").select("feature")


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of child whose id the parent lacks; a null id points nowhere and is fine."""
    ids = parent.select(F.col(parent_key).alias("_id")).distinct()
    return child.where(F.col(key).isNotNull()).join(ids, F.col(key) == F.col("_id"), "left_anti")


def merge_workspaces(features: DataFrame) -> DataFrame:
    """Features of the same normalised name over workspaces as one. features: workspace, name, path."""
    key = F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-")
    return features.groupBy(key.alias("name")).agg(F.countDistinct("workspace").alias("workspaces"), F.countDistinct("path").alias("paths"))


def candidates(files: DataFrame) -> DataFrame:
    """First candidates for features: files by directory, root files by their stem. files: path."""
    stem = F.regexp_replace("path", r"\.[^.]*$", "")
    return files.select("path", F.when(directory("path") != "", directory("path")).otherwise(stem).alias("feature"))
