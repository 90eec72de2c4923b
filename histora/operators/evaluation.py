"""How well a feature map meets hand-written truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_tokens, names_match


def _hits(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Matching pairs of names. Candidates share a token or are equal, so this is an equi-join, not a product."""

    def keyed(df: DataFrame, name: str) -> DataFrame:
        low = F.lower(F.trim(F.col(name)))
        keys = F.array_distinct(F.concat(name_tokens(name), F.array(low), F.array(F.element_at(F.split(low, "/"), 1))))
        return df.select(F.col(name), F.explode(keys).alias("_key"))

    pairs = keyed(expected, "expected").join(keyed(found, "found"), "_key").select("expected", "found").distinct()
    return pairs.where(names_match("expected", "found"))


def recall(expected: DataFrame, aliases: DataFrame, found: DataFrame) -> DataFrame:
    """One row: expected features met by name or alias. expected: expected; aliases: expected, alias; found: found."""
    names = expected.select("expected", F.col("expected").alias("name")).unionAll(aliases.select("expected", F.col("alias").alias("name")))
    met = _hits(names.select(F.col("name").alias("expected")).distinct(), found).select(F.col("expected").alias("name")).distinct()
    hit = names.join(met, "name", "left_semi").select("expected").distinct().withColumn("hit", F.lit(1))
    return expected.select("expected").distinct().join(hit, "expected", "left").agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def precision(expected: DataFrame, aliases: DataFrame, found: DataFrame) -> DataFrame:
    """One row: found features that an expected name or alias matches."""
    names = expected.select("expected").unionAll(aliases.select(F.col("alias").alias("expected"))).distinct()
    hit = _hits(names, found).select("found").distinct().withColumn("hit", F.lit(1))
    return found.select("found").distinct().join(hit, "found", "left").agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.avg(F.coalesce("hit", F.lit(0))).alias("precision"))


def attribution(samples: DataFrame, owners: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row: samples whose path belongs to the expected feature, aliases taken to their canonical name."""
    canon = aliases.select(F.lower("alias").alias("_alias"), F.lower("expected").alias("_canon"))

    def canonical(df: DataFrame, c: str) -> DataFrame:
        return df.join(canon, F.lower(F.col(c)) == F.col("_alias"), "left").withColumn(c, F.coalesce("_canon", F.lower(F.col(c)))).drop("_alias", "_canon")

    want = canonical(samples.select("path", "expected"), "expected")
    have = canonical(owners.select("path", "feature"), "feature").distinct()
    hit = want.join(have.withColumnRenamed("feature", "expected"), ["path", "expected"], "left_semi").select("path", "expected").distinct().withColumn("hit", F.lit(1))
    return want.join(hit, ["path", "expected"], "left").agg(F.count("*").alias("n"), F.avg(F.coalesce("hit", F.lit(0))).alias("accuracy"))


#: Names that say nothing about a product. FIXED VALUES.
GENERIC = ("app", "common", "components", "core", "helpers", "lib", "main", "misc", "shared", "src", "utils")


def generic_rate(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("n"), F.avg(F.lower("found").isin(*GENERIC).cast("int")).alias("generic_rate"))


def line_completeness(files: DataFrame, spans: DataFrame) -> DataFrame:
    """One row: lines under any span, over all, and the spread of the share a file. files: path, loc."""
    from .intervals import union_length

    each = files.join(union_length(spans, ["path"]), "path", "left").select("loc", F.least(F.coalesce("lines", F.lit(0)), F.col("loc")).alias("lines"))
    share = F.when(F.col("loc") > 0, F.col("lines") / F.col("loc")).otherwise(0.0)
    return each.withColumn("share", share).agg(
        F.sum("loc").alias("total_loc"), F.sum("lines").alias("attributed_loc"), F.expr("percentile(share, 0.1)").alias("p10"), F.expr("percentile(share, 0.5)").alias("p50"), F.expr("percentile(share, 0.9)").alias("p90")
    )
