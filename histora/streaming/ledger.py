"""Metrics of features over a stream of commits that come, come again, and are taken back.

The state is three tables: what each commit last was, how many commits each author and each file of a feature has, and the
features' totals. A commit that comes again counts once; one that a rewritten history takes back leaves the counts, the
authors and the files; what is taken back before it comes never counts, until it is added once more after that. Each batch
gives the new metrics of the features that it changed.

A batch is folded by commit and joined to the commits known; what that moves is summed by author and file, and what those
move by feature. So the work goes by commits, not by features, of which there may be a handful.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import refresh

ADD, DROP = "add", "drop"
#: seq orders what happens to one commit; of equal ones a drop comes last.
EVENTS = "feature string, seq long, kind string, sha string, author string, is_bug_fix boolean, files array<string>"
METRICS = "feature string, total_commits long, bug_fixes long, authors long, files long"

_COMMITS = "feature string, sha string, seq long, live boolean, own struct<author:string,is_bug_fix:boolean,files:array<string>>"
_COUNTS = "feature string, what string, name string, n long"
#: A table's parts, by a hash of its keys; a batch rewrites only the parts that it touches.
BUCKETS = 16


def _bucket(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _held(spark: SparkSession, path: str, number: int, schema: str, touched: list[int], *keys: str) -> DataFrame:
    """The touched parts of a table as they were before a batch."""
    known = refresh._versions(spark, path, number)
    old = [refresh._part(path, known[b][-1], b) for b in touched if b in known]
    rows = spark.read.schema(schema).parquet(*old) if old else spark.createDataFrame([], schema)
    return rows.withColumn("bucket", _bucket(*keys))


def _hold(rows: DataFrame, path: str, number: int, touched: list[int]) -> None:
    """Writes a batch's version of the touched parts. A version that two newer ones follow is removed."""
    spark = rows.sparkSession
    known = refresh._versions(spark, path, number)
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{number:08d}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for b in touched:
        for version in known.get(b, [])[:-1]:
            fs.delete(at(refresh._part(path, version, b)), True)


def _touched(rows: DataFrame) -> list[int]:
    return sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # at most BUCKETS


def folded(events: DataFrame, known: DataFrame) -> DataFrame:
    """What a batch makes of each of its commits: feature, sha, seq, live, own, and what it ``lost``, the commit as it no longer counts, and ``won``.

    events: as EVENTS; known: feature, sha, seq, live, own, of the commits before. Repeats of an event fall together before a commit's events meet.
    """
    own = F.struct("author", F.coalesce("is_bug_fix", F.lit(False)).alias("is_bug_fix"), F.array_distinct(F.coalesce("files", F.array().cast("array<string>"))).alias("files"))
    event, was = F.struct("seq", "kind", "own"), F.struct("seq", "live", "own")
    each = events.groupBy("feature", "sha", "seq", "kind").agg(F.min(own).alias("own")).select("feature", "sha", event.alias("e"))
    # known commits meet the batch's in one grouping: either side may be of any size, and neither is broadcast
    both = each.unionByName(known.select("feature", "sha", was.alias("was")), allowMissingColumns=True)
    met = both.groupBy("feature", "sha").agg(F.collect_list("e").alias("es"), F.max("was").alias("was")).where(F.size("es") > 0)
    met = met.select("feature", "sha", "es", F.col("was.seq").alias("_seq"), F.coalesce("was.live", F.lit(False)).alias("_live"), F.col("was.own").alias("_own"))
    # something later may be known of it
    met = met.withColumn("es", F.filter("es", lambda e: F.col("_seq").isNull() | (e["seq"] >= F.col("_seq"))))
    met = met.withColumn("_drop", F.array_max(F.transform(F.filter("es", lambda e: e["kind"] == DROP), lambda e: e["seq"])))
    met = met.withColumn("_add", F.array_min(F.filter("es", lambda e: (e["kind"] == ADD) & (F.col("_drop").isNull() | (e["seq"] > F.col("_drop"))))))
    stays = F.col("_live") & F.col("_drop").isNull()
    live = stays | F.col("_add").isNotNull()
    now = F.when(stays, F.col("_own")).otherwise(F.col("_add.own"))
    seq = F.greatest("_seq", F.array_max(F.transform("es", lambda e: e["seq"])))
    return met.select("feature", "sha", seq.alias("seq"), live.alias("live"), now.alias("own"), F.when(F.col("_live") & ~stays, F.col("_own")).alias("lost"), F.when(live & ~stays, now).alias("won"))


def merge_into(at: str, state: str):
    """A foreachBatch function that merges a batch into the state and writes the metrics it changes. A batch that runs again reads what was before it and writes the same."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        key = ["feature", "sha"]
        # which parts a batch touches is told from what it folds to, so all are read here
        known = _held(spark, f"{state}/commits", number, _COMMITS, list(range(BUCKETS)), *key)
        folded(batch, known).withColumn("bucket", _bucket(*key)).write.mode("overwrite").parquet(f"{state}/moved")
        moved = spark.read.parquet(f"{state}/moved")
        touched = _touched(moved)
        entry = F.struct("seq", "live", "own").alias("x")
        whole = moved.select("bucket", *key, F.lit(1).alias("_new"), entry).unionByName(_held(spark, f"{state}/commits", number, _COMMITS, touched, *key).select("bucket", *key, F.lit(0).alias("_new"), entry))
        _hold(whole.groupBy("bucket", *key).agg(F.max_by("x", "_new").alias("x")).select("bucket", *key, "x.*"), f"{state}/commits", number, touched)

        signed = moved.where("lost is not null").select("feature", F.lit(-1).cast("long").alias("by"), "lost.*").unionByName(moved.where("won is not null").select("feature", F.lit(1).cast("long").alias("by"), "won.*"))
        names = signed.where("author is not null").select("feature", F.lit("author").alias("what"), F.col("author").alias("name"), "by").unionByName(signed.select("feature", F.lit("file").alias("what"), F.explode("files").alias("name"), "by"))
        key = ["feature", "what", "name"]
        names.groupBy(*key).agg(F.sum("by").alias("by")).where("by <> 0").withColumn("bucket", _bucket(*key)).write.mode("overwrite").parquet(f"{state}/named")
        fresh = spark.read.parquet(f"{state}/named")
        touched = _touched(fresh)
        held = _held(spark, f"{state}/counts", number, _COUNTS, touched, *key)
        both = held.withColumn("by", F.lit(0).cast("long")).unionByName(fresh.withColumn("n", F.lit(0).cast("long")))
        summed = both.groupBy("bucket", *key).agg(F.sum("n").alias("was"), (F.sum("n") + F.sum("by")).alias("n"))
        summed.write.mode("overwrite").parquet(f"{state}/counted")
        summed = spark.read.parquet(f"{state}/counted")
        _hold(summed.where("n <> 0").drop("was"), f"{state}/counts", number, touched)

        step = (F.col("n") > 0).cast("long") - (F.col("was") > 0).cast("long")
        kinds = summed.select("feature", F.lit(0).cast("long").alias("total_commits"), F.lit(0).cast("long").alias("bug_fixes"), F.when(F.col("what") == "author", step).otherwise(0).alias("authors"), F.when(F.col("what") == "file", step).otherwise(0).alias("files"))
        none = [F.lit(0).cast("long").alias(c) for c in ("authors", "files")]
        commits = signed.select("feature", F.col("by").alias("total_commits"), F.when(F.col("is_bug_fix"), F.col("by")).otherwise(0).alias("bug_fixes"), *none)
        # a feature that a batch names comes out of it, though nothing of it moves
        named = moved.select("feature", *(F.lit(0).cast("long").alias(c) for c in ("total_commits", "bug_fixes")), *none)
        fresh = named.unionByName(commits).unionByName(kinds).withColumn("bucket", _bucket("feature"))
        totals = [c.split()[0] for c in METRICS.split(", ")][1:]
        fresh = fresh.groupBy("bucket", "feature").agg(*(F.sum(c).alias(c) for c in totals), F.lit(True).alias("named"))
        fresh.write.mode("overwrite").parquet(f"{state}/changed")
        fresh = spark.read.parquet(f"{state}/changed")
        touched = _touched(fresh)
        held = _held(spark, f"{state}/totals", number, METRICS, touched, "feature").withColumn("named", F.lit(False))
        whole = held.unionByName(fresh).groupBy("bucket", "feature").agg(*(F.sum(c).alias(c) for c in totals), F.bool_or("named").alias("named"))
        whole.where("named").select("feature", *totals, F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{at}/batch-{number:08d}")
        _hold(whole.drop("named"), f"{state}/totals", number, touched)

    return merge


def start_ledger(events: DataFrame, at: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's metrics below a folder, with the batch's number; takes what there is and stops. The state stands beside the checkpoint."""
    return events.writeStream.foreachBatch(merge_into(at, f"{checkpoint.rstrip('/')}-state")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(changes: DataFrame) -> DataFrame:
    """The last metrics of each feature. changes: METRICS and batch."""
    names = [c.split()[0] for c in METRICS.split(", ")]
    return changes.groupBy("feature").agg(F.max_by(F.struct(*names[1:]), "batch").alias("x")).select("feature", "x.*")
