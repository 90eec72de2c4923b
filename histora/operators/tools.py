"""The thirteen query tools over a feature map, each a function from tables to one table.

Tables: ``features`` (feature, display_name, description, aliases, labels, health_score,
bug_fix_ratio, bug_fixes, total_commits, coverage_pct, authors, paths), ``flows`` (feature,
flow, health_score, bus_factor, hotspot_files, paths), ``symbols`` (feature, flow, file, symbol,
ranges) and run-time rows (path, count, ...). A missing table may be None where said.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import deeplinks, token_coverage, tokens


def _named(features: DataFrame, name: str) -> DataFrame:
    """Features called so in any case: display name, name, alias or label."""
    low = name.lower()
    lists = [F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(x) == low) for c in ("aliases", "labels")]
    return features.where((F.lower("display_name") == low) | (F.lower("feature") == low) | lists[0] | lists[1])


def list_features(features: DataFrame) -> DataFrame:
    """All features, worst health first."""
    return features.select("feature", "description", F.bround("health_score").alias("health"), F.bround(F.col("bug_fix_ratio") * 100, 1).alias("bug_fix_percent"), "total_commits", F.size("paths").alias("file_count"), "coverage_pct").orderBy(F.coalesce("health_score", F.lit(100.0)), "feature")


def find_feature(features: DataFrame, query: str, top: int = 3) -> DataFrame:
    """The best candidates for a query: thrice the cover by names, twice by aliases, once by description."""
    q = tokens(F.lit(query))
    alias = F.flatten(F.transform(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("labels", F.array().cast("array<string>"))), tokens))
    score = 3 * token_coverage(q, F.concat(tokens("display_name"), tokens("feature"))) + 2 * token_coverage(q, alias) + token_coverage(q, tokens("description"))
    return features.select(F.coalesce("display_name", "feature").alias("name"), F.round(score, 3).alias("score"), "description", F.size("paths").alias("file_count")).where("score > 0").orderBy(F.desc("score"), "name").limit(top)


def feature_files(features: DataFrame, flows: DataFrame, name: str) -> DataFrame:
    """Files of a feature and the first five hotspots of its flows."""
    hot = flows.groupBy("feature").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("flow", "hotspot_files"))), lambda x: x["hotspot_files"])).alias("_hot"))
    return _named(features, name).join(hot, "feature", "left").select("feature", "paths", F.slice(F.coalesce("_hot", F.array().cast("array<string>")), 1, 5).alias("hotspots"))


def flow_files(flows: DataFrame, feature: str, flow: str) -> DataFrame:
    """Files of a flow; both names must be exact."""
    return flows.where((F.col("feature") == feature) & (F.col("flow") == flow)).select("feature", "flow", "paths", "health_score")


def hotspots(features: DataFrame, flows: DataFrame, limit: int = 5) -> DataFrame:
    """The worst features with three hotspot files and three owners."""
    hot = flows.groupBy("feature").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("flow", "hotspot_files"))), lambda x: x["hotspot_files"])).alias("_hot"))
    worst = features.orderBy(F.coalesce("health_score", F.lit(100.0)), "feature").limit(limit)
    return worst.join(hot, "feature", "left").select("feature", "health_score", "bug_fixes", "total_commits", "coverage_pct", F.slice(F.coalesce("_hot", F.array().cast("array<string>")), 1, 3).alias("hotspot_files"), F.slice("authors", 1, 3).alias("owners"))


def feature_owners(features: DataFrame, flows: DataFrame, name: str) -> DataFrame:
    """Authors and bus factor: the least of the flows', else the number of authors, else one."""
    least = flows.groupBy("feature").agg(F.min("bus_factor").alias("_least"))
    bus = F.coalesce("_least", F.nullif(F.size("authors"), F.lit(0)), F.lit(1))
    return _named(features, name).join(least, "feature", "left").select("feature", "authors", F.size("authors").alias("contributors"), bus.alias("bus_factor"), (bus == 1).alias("at_risk"))


def overlap_with(feature_paths: DataFrame, changed: DataFrame) -> DataFrame:
    """How many changed files each feature has. feature_paths: feature, path; changed: path."""
    return feature_paths.select("feature", "path").distinct().join(changed.select("path").distinct(), "path").groupBy("feature").agg(F.count("*").alias("files_touched"))


def risk_of(total: Column, most: Column) -> Column:
    return F.when((total >= 8) | (most >= 0.5), "critical").when((total >= 4) | (most >= 0.3), "high").when((total >= 1.5) | (most >= 0.15), "medium").otherwise("low")


def change_impact(features: DataFrame, feature_paths: DataFrame, changed: DataFrame) -> DataFrame:
    """Impact on each feature that the change touches, with the risk of the whole change. Missing coverage counts as none."""
    met = overlap_with(feature_paths, changed).join(features.select("feature", "bug_fix_ratio", "coverage_pct"), "feature")
    cover = F.coalesce("coverage_pct", F.lit(0.0)) / F.lit(100.0)
    impact = met.withColumn("impact", F.col("files_touched") * (F.lit(1.0) + F.col("bug_fix_ratio")) * (F.lit(1.0) - F.lit(0.5) * cover))
    whole = impact.agg(F.sum("impact").alias("_total"), F.max("bug_fix_ratio").alias("_most")).select(risk_of(F.col("_total"), F.col("_most")).alias("risk"))
    return impact.crossJoin(F.broadcast(whole)).select("feature", "files_touched", "bug_fix_ratio", "impact", "risk")  # one row


def regression_risk(features: DataFrame, feature_paths: DataFrame, changed: DataFrame) -> DataFrame:
    """One row: the mean bug share of the touched features, weighted by touched files, and its band."""
    met = overlap_with(feature_paths, changed).join(features.select("feature", "bug_fix_ratio"), "feature")
    p = F.coalesce(F.sum(F.col("bug_fix_ratio") * F.col("files_touched")) / F.sum("files_touched"), F.lit(0.0))
    one = met.agg(F.count("*").alias("features"), F.round(p, 2).alias("regression_probability"))
    r = F.col("regression_probability")
    return one.select("features", "regression_probability", F.when(r >= 0.6, "critical").when(r >= 0.4, "high").when(r >= 0.2, "medium").otherwise("low").alias("risk"))


def flow_symbols(symbols: DataFrame, flows: DataFrame, feature: str, flow: str, remote: str = "") -> DataFrame:
    """Symbols of a flow with links; its files where no symbol is known."""
    own = symbols.where((F.col("feature") == feature) & (F.col("flow") == flow))
    known = own.select("file", "symbol", "ranges", deeplinks(F.lit(remote), F.col("file"), F.col("ranges")).alias("links"))
    files = flow_files(flows, feature, flow).select(F.explode("paths").alias("file")).join(known.select("file").distinct(), "file", "left_anti")
    none = [F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("symbol", "ranges", "links")]
    return known.unionByName(files.select("file", *none))


def feature_symbols(symbols: DataFrame, feature: str) -> DataFrame:
    """Shared symbols of a feature by file."""
    return symbols.where(F.col("feature") == feature).select("file", "symbol", "ranges").distinct()


def _runtime(features: DataFrame, runtime: DataFrame, name: str, missing: int) -> DataFrame:
    """Rows of the run-time table that touch a file of the feature, each once, and the sum of their counts.

    Equal rows are one with their number, so that rows of several paths meet the feature's by single paths and still count once.
    """
    paths = _named(features, name).select("feature", F.explode("paths").alias("path")).distinct()
    touched = F.coalesce(F.col("paths"), F.array("path")) if "paths" in runtime.columns else F.array("path")
    rows = runtime.select(F.coalesce(F.col("count").cast("long"), F.lit(missing)).alias("_count"), touched.alias("_paths")).groupBy("_count", "_paths").agg(F.count("*").alias("_n"))
    hit = rows.withColumn("path", F.explode(F.array_distinct("_paths"))).join(paths, "path").select("feature", "_count", "_paths", "_n").distinct()
    return hit.groupBy("feature").agg(F.sum("_n").alias("rows"), F.sum(F.col("_count") * F.col("_n")).alias("total"))


def feature_errors(features: DataFrame, errors: DataFrame, name: str) -> DataFrame:
    """Errors in a feature's files; a row without a count counts once."""
    return _runtime(features, errors, name, 1)


def feature_pageviews(features: DataFrame, views: DataFrame, name: str) -> DataFrame:
    """Views of a feature's files; a row without a count counts nothing."""
    return _runtime(features, views, name, 0)


def repo_summary(features: DataFrame, flows: DataFrame) -> DataFrame:
    from .metrics import repo_summary as summed

    return summed(features).crossJoin(flows.agg(F.count("*").alias("total_flows")))  # one row each


def worst_first(rows: DataFrame, k: int) -> DataFrame:
    """The k rows with the highest bug share."""
    return rows.orderBy(F.desc("bug_fix_ratio"), "feature").limit(k)


def top_per(rows: DataFrame, by: str, order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each group: a cap that is the feature."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_nth") <= cap).drop("_nth")


#: Name of each tool and its function.
TOOLS: dict[str, Callable[..., DataFrame]] = {
    "list_features": list_features,
    "find_feature": find_feature,
    "get_feature_files": feature_files,
    "get_flow_files": flow_files,
    "get_repo_summary": repo_summary,
    "get_hotspots": hotspots,
    "get_feature_owners": feature_owners,
    "analyze_change_impact": change_impact,
    "get_regression_risk": regression_risk,
    "find_symbols_in_flow": flow_symbols,
    "find_symbols_for_feature": feature_symbols,
    "get_feature_errors": feature_errors,
    "get_feature_pageviews": feature_pageviews,
}


def call(name: str, *args, **kwargs) -> DataFrame:
    if name not in TOOLS:
        raise KeyError(f"no tool {name}; there are {', '.join(TOOLS)}")
    return TOOLS[name](*args, **kwargs)
