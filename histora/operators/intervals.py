"""Algebra of inclusive line ranges. Ranges that touch (10-12 and 13-15) merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LINE_BUCKET = 64


def merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Union of the ranges of each key: keys, start, end. spans: keys, start, end."""
    by = Window.partitionBy(*keys).orderBy("start", "end")
    reached = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") > reached + 1).cast("int"), F.lit(1))
    island = spans.where("start <= end").withColumn("_new", new).withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def union_length(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Lines under the union of each key's ranges."""
    return merged(spans, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start") + 1).alias("lines"))


def shared_mask(spans: DataFrame, least: int = 2) -> DataFrame:
    """Stretches of each path under at least ``least`` different flows. spans: flow, path, start, end.

    A sweep per path: each merged range opens at its start and closes after its end.
    """
    own = merged(spans, ["flow", "path"])
    steps = own.select("path", F.col("start").alias("line"), F.lit(1).alias("d")).unionAll(own.select("path", (F.col("end") + 1).alias("line"), F.lit(-1).alias("d")))
    by = Window.partitionBy("path").orderBy("line")
    depth = steps.groupBy("path", "line").agg(F.sum("d").alias("d"))
    run = depth.withColumn("depth", F.sum("d").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("line").over(by))
    deep = run.where(F.col("depth") >= least).select("path", F.col("line").alias("start"), (F.col("next") - 1).alias("end"))
    return merged(deep, ["path"])


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of ranges of one path that meet. a: path, start, end, ...; b: path, b_start, b_end.

    Ranges are dealt into buckets of lines, so the join is by equality of (path, bucket); a
    pair is taken in the first bucket that both reach.
    """

    def buckets(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(lo) / LINE_BUCKET), F.floor(F.col(hi) / LINE_BUCKET))))

    met = buckets(a, "start", "end").join(buckets(b, "b_start", "b_end"), ["path", "_bucket"])
    first = F.floor(F.greatest("start", "b_start") / LINE_BUCKET)
    return met.where((F.col("start") <= F.col("b_end")) & (F.col("b_start") <= F.col("end")) & (F.col("_bucket") == first)).drop("_bucket")


def owned_shared(spans: DataFrame) -> DataFrame:
    """Lines of each flow: all, under two flows or more, and its own."""
    own = merged(spans, ["flow", "path"])
    total = own.groupBy("flow").agg(F.sum(F.col("end") - F.col("start") + 1).alias("lines"))
    mask = shared_mask(spans).select("path", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    both = overlaps(own, mask).groupBy("flow").agg(F.sum(F.least("end", "b_end") - F.greatest("start", "b_start") + 1).alias("loc_shared"))
    shared = F.coalesce("loc_shared", F.lit(0))
    return total.join(both, "flow", "left").select("flow", "lines", shared.alias("loc_shared"), (F.col("lines") - shared).alias("loc"))


def line_lookup(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Flows whose range holds each (path, line). points: path, line."""
    ranges = spans.select("path", F.col("flow"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    at = points.select("path", "line", F.col("line").alias("start"), F.col("line").alias("end")).distinct()
    return overlaps(at, ranges).select("path", "line", "flow").distinct()


def on_flow_accounting(spans: DataFrame, owners: DataFrame) -> DataFrame:
    """Lines of each owner's files that flows walk, up to the file's length; the rest is shared. owners: path, owner, loc."""
    walked = union_length(spans, ["path"])
    on = F.least(F.coalesce("lines", F.lit(0)), F.col("loc"))
    return owners.join(walked, "path", "left").groupBy("owner").agg(F.sum("loc").alias("loc"), F.sum(on).alias("loc_on_flow"), F.sum(F.col("loc") - on).alias("loc_off_flow"))
