"""Continuous refresh: file events debounced by silence, commits added to stored metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import quiet_periods

EVENT_SCHEMA = "repo string, path string, ts timestamp"
IGNORED = r"(?:^|/)(?:\.git|node_modules|dist|build|\.next)/|\.(?:lock|log|tmp|swp)$"


def file_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of file events out of JSON files, without those in ignored places."""
    return spark.readStream.schema(EVENT_SCHEMA).json(folder).where(~F.col("path").rlike(IGNORED))


def bursts(events: DataFrame, gap: str = "30 seconds", lateness: str = "1 minute") -> DataFrame:
    """A row for each burst of events that ended in silence; late events beyond the watermark are dropped."""
    return quiet_periods(events.withWatermark("ts", lateness), gap)


def running_metrics(commit_features: DataFrame) -> DataFrame:
    """Counts of each feature over a stream of (feature, sha, is_bug_fix), for update mode."""
    return commit_features.groupBy("feature").agg(F.count("*").alias("total_commits"), F.sum(F.col("is_bug_fix").cast("long")).alias("bug_fixes"))


#: Parts of the state, by a hash of the feature; a batch rewrites only the parts that it touches.
BUCKETS = 64
_STATE = "feature string, sha string, is_bug_fix boolean"


def _versions(spark: SparkSession, path: str, before: int) -> dict[int, list[int]]:
    """Versions of each part that are older than a batch, oldest first."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    if not fs.exists(at):
        return found
    for folder in fs.listStatus(at):
        name = folder.getPath().getName()
        if name.isdigit() and int(name) < before and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder.getPath(), "_SUCCESS")):
            for part in fs.listStatus(folder.getPath()):
                inner = part.getPath().getName()
                if inner.startswith("bucket="):
                    found.setdefault(int(inner[7:]), []).append(int(name))
    return {b: sorted(v) for b, v in found.items()}


def _part(path: str, version: int, bucket: int) -> str:
    return f"{path}/{version:08d}/bucket={bucket}"


def merge_into(path: str, buckets: int = BUCKETS):
    """A foreachBatch function that adds a batch's commits to the state.

    The state is the set of (feature, sha), in parts by feature, so a commit that comes again, in
    this batch or a later one, counts once. A batch writes a version of the parts that it
    touches and leaves the others; a version that two newer ones follow is removed. A batch that
    is run again after a failure reads what was before it and writes the same: the merge is idempotent.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("feature"), F.lit(buckets)).cast("int")
        fresh = batch.select(F.col("feature").cast("string").alias("feature"), F.col("sha").cast("string").alias("sha"), F.col("is_bug_fix").cast("boolean").alias("is_bug_fix")).withColumn("bucket", bucket)
        touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())  # at most as many as there are parts
        known = _versions(spark, path, number)
        old = [_part(path, known[b][-1], b) for b in touched if b in known]
        whole = fresh
        if old:
            whole = whole.unionByName(spark.read.schema(_STATE).parquet(*old).withColumn("bucket", bucket))
        merged = whole.groupBy("bucket", "feature", "sha").agg(F.bool_or("is_bug_fix").alias("is_bug_fix"))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{number:08d}")
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for b in touched:
            for version in known.get(b, [])[:-1]:
                fs.delete(fs_path(_part(path, version, b)), True)

    return merge


def snapshot(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """Counts of each feature after a batch: feature, total_commits, bug_fixes; None if there is no state."""
    known = _versions(spark, path, number + 1)
    if not known:
        return None
    state = spark.read.schema(_STATE).parquet(*[_part(path, v[-1], b) for b, v in sorted(known.items())])
    return state.groupBy("feature").agg(F.count("*").alias("total_commits"), F.sum(F.col("is_bug_fix").cast("long")).alias("bug_fixes"))


def start_refresh(commit_features: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keeps snapshots below path up to date; without a period it takes what there is and stops."""
    writer = commit_features.writeStream.foreachBatch(merge_into(path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def status(query: StreamingQuery) -> dict:
    return {"active": query.isActive, "status": query.status, "progress": query.lastProgress}


def stop(query: StreamingQuery, seconds: int = 30) -> bool:
    """Stops a query and says whether it has ended."""
    query.stop()
    query.awaitTermination(seconds)
    return not query.isActive
