"""Readers of exported history and source trees, and writers of results.

Nothing here runs version control: history comes as logs in text or JSON lines, trees as files.
Schemas are declared, never inferred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import directory, extension, is_bug_fix, pr_number

COMMIT = T.StructType(
    [
        T.StructField("sha", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("message", T.StringType()),
        T.StructField("files", T.ArrayType(T.StringType())),
    ]
)

#: Directories and endings that are no source. FIXED VALUES.
SKIP_DIRS = (".git", "node_modules", "dist", "build", ".next", "vendor", "__pycache__", ".venv", "target", "coverage")
SKIP_ENDINGS = ("png", "jpg", "jpeg", "gif", "ico", "pdf", "zip", "woff", "woff2", "ttf", "mp4", "lock", "map")


def read_commits(spark: SparkSession, path: str, since: str | None = None, subtree: str | None = None) -> DataFrame:
    """Commits from JSON lines, with bug-fix flag and pull request; ``since`` prunes, ``subtree`` scopes the files."""
    out = spark.read.schema(COMMIT).json(path)
    return prepare_commits(out, since, subtree)


#: A commit in a log as text: whole id, time in seconds, author and message between unit separators, a record separator after the message, then its files; a null byte after each file.
_FIELD, _BODY_END, _END = "\x1f", "\x1e", "\x00"
_HEADER = rf"(?s)^\s*([0-9a-fA-F]{{40}}){_FIELD}(-?\d+){_FIELD}([^{_FIELD}]*){_FIELD}(.*){_BODY_END}\n?(.*)$"


def read_log(spark: SparkSession, path: str, since: str | None = None, subtree: str | None = None) -> DataFrame:
    """Commits from logs as text, as ``git log -z --name-only`` writes them with that format; any number of files of any size.

    Spark deals a file by ranges of bytes and cuts it at its null bytes, so a row is a header or one more file of the commit
    before it. In each range files follow its last header; what a range begins with belongs to the last header of the ranges
    before it, of which there is a row a range.
    """
    raw = spark.read.option("lineSep", _END).text(path)
    rows = raw.select("value", F.col("_metadata.file_path").alias("log"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("at"))
    part = lambda k: F.regexp_extract("value", _HEADER, k)
    marked = rows.withColumn("own", F.nullif(part(1), F.lit(""))).checkpoint()
    last = marked.groupBy("log", "range").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("at"))).alias("last"))
    earlier = Window.partitionBy("log").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("log", "range", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    here = Window.partitionBy("log", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = marked.withColumn("sha", F.last("own", ignorenulls=True).over(here)).join(carried, ["log", "range"]).withColumn("sha", F.coalesce("sha", "carried"))
    files = named.select("sha", F.when(F.col("own").isNotNull(), part(5)).otherwise(F.col("value")).alias("path")).where("sha is not null and trim(path) <> ''")
    heads = marked.where("own is not null").select(F.col("own").alias("sha"), part(3).alias("author"), F.timestamp_seconds(part(2).cast("long")).alias("ts"), F.trim(part(4)).alias("message")).dropDuplicates(["sha"])
    if since:
        heads = heads.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    of = files.groupBy("sha").agg(F.array_sort(F.collect_set(F.regexp_replace("path", "^\n+", ""))).alias("files"))
    whole = heads.join(of, "sha", "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))
    return prepare_commits(whole.select("sha", "author", "ts", "message", "files"), None, subtree)


def pack_commits(commits: DataFrame, at: str) -> None:
    """Commits as a table by month, for reading again; those of a month lie together in the order of time."""
    month = F.date_format("ts", "yyyy-MM")
    commits.withColumn("month", month).repartition("month").sortWithinPartitions("ts").write.mode("append").partitionBy("month").parquet(at)


def read_packed(spark: SparkSession, at: str, since: str | None = None) -> DataFrame:
    """Commits of a packed table. With ``since``, months before it are no part of the scan, and the time is pushed into the rest."""
    out = spark.read.option("basePath", at).parquet(at)
    if since:
        out = out.where((F.col("month") >= since[:7]) & (F.col("ts") >= F.lit(since).cast("timestamp")))
    return out.drop("month")


def prepare_commits(raw: DataFrame, since: str | None = None, subtree: str | None = None) -> DataFrame:
    out = raw.where(F.col("ts") >= F.lit(since).cast("timestamp")) if since else raw
    if subtree:
        out = out.withColumn("files", scoped(F.col("files"), subtree)).where(F.size("files") > 0)
    # whole ids, as those of many commits share their first characters; the short one is for display
    return out.select("sha", F.substring("sha", 1, 8).alias("short_sha"), "author", "ts", "message", "files", is_bug_fix("message").alias("is_bug_fix"), pr_number("message").alias("pr_number"))


def scoped(files, subtree: str):
    """Paths below a subtree, relative to it; a like-named sibling isn't below."""
    prefix = subtree.strip("/") + "/"
    return F.transform(F.filter(files, lambda f: F.startswith(f, F.lit(prefix))), lambda f: F.substring(f, F.lit(len(prefix) + 1), F.length(f)))


def newest(commits: DataFrame, most: int = 7000) -> DataFrame:
    """The most recent commits: the cap on history is a feature of the scan."""
    return commits.orderBy(F.desc("ts"), "sha").limit(most)


def commit_files(commits: DataFrame) -> DataFrame:
    return commits.select("sha", F.explode("files").alias("path")).distinct()


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files below a root with their text: path (relative), dir, ext, text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    relative = F.element_at(F.split(F.col("path"), base), -1)
    return describe_files(raw.select(relative.alias("path"), F.decode("content", "UTF-8").alias("text")))


def describe_files(files: DataFrame) -> DataFrame:
    """files (path, text) without skipped ones, with dir, ext and content hash."""
    skipped = F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(d) for d in SKIP_DIRS])) | extension("path").isin(*SKIP_ENDINGS)
    return files.where(~skipped).select("path", directory("path").alias("dir"), extension("path").alias("ext"), "text", F.sha2("text", 256).alias("hash"))


def blame(hunks: DataFrame) -> DataFrame:
    """Authors, last change and number of hunks of each file. hunks: path, author, ts."""
    return hunks.groupBy("path").agg(F.array_sort(F.collect_set("author")).alias("authors"), F.max("ts").alias("last_modified"), F.count("*").alias("hunks"))


def workspaces(manifests: DataFrame) -> DataFrame:
    """Packages and their dependencies from manifests (path, text): dir, name, dependency."""
    schema = "name string, dependencies map<string,string>, devDependencies map<string,string>"
    parsed = manifests.select(directory("path").alias("dir"), F.from_json("text", schema).alias("m"))
    deps = F.map_concat(F.coalesce("m.dependencies", F.create_map().cast("map<string,string>")), F.coalesce("m.devDependencies", F.create_map().cast("map<string,string>")))
    both = F.array_distinct(F.concat(F.map_keys(F.coalesce("m.dependencies", F.create_map().cast("map<string,string>"))), F.map_keys(F.coalesce("m.devDependencies", F.create_map().cast("map<string,string>")))))
    del deps
    return parsed.select("dir", F.col("m.name").alias("name"), F.explode_outer(both).alias("dependency"))


def dependency_edges(packages: DataFrame) -> DataFrame:
    """Edges between workspaces: one depends on the name of another."""
    names = packages.select(F.col("name").alias("dependency"), F.col("dir").alias("to_dir")).distinct()
    return packages.select(F.col("dir").alias("from_dir"), "dependency").distinct().join(names, "dependency").where("from_dir <> to_dir").select("from_dir", "to_dir", "dependency")


# -- sinks -------------------------------------------------------------------------


def write_feature_map(features: DataFrame, flows: DataFrame, path: str) -> None:
    """One JSON document a feature, its flows nested, for readers outside Spark."""
    nested = flows.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct(*[c for c in flows.columns if c != "feature"]))).alias("flows"))
    features.join(nested, "feature", "left").write.mode("overwrite").json(path)


def write_stage(df: DataFrame, run: str, stage: str) -> DataFrame:
    """A stage's result as a table that a replay can start from."""
    at = f"{run.rstrip('/')}/{stage}"
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.parquet(at)


def replay_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two runs of a stage has."""
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionAll(b.exceptAll(a).withColumn("only_in", F.lit("second")))


def append_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


class TableCache:
    """Content-addressed results: kind and key to a JSON value, in Parquet under one folder by kind."""

    SCHEMA = "key string, value string, written timestamp"

    def __init__(self, spark: SparkSession, root: str, ttl_days: int | None = None) -> None:
        self.spark, self.root, self.ttl = spark, root.rstrip("/"), ttl_days

    def read(self, kind: str, as_of: str | None = None) -> DataFrame:
        """Live entries; the newest of a key."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/{kind}")
        if self.ttl and as_of:
            rows = rows.where(F.col("written") >= F.date_sub(F.lit(as_of).cast("date"), self.ttl))
        return rows.groupBy("key").agg(F.max_by("value", "written").alias("value"), F.max("written").alias("written"))

    def write(self, kind: str, entries: DataFrame) -> None:
        entries.select("key", "value", "written").write.mode("append").parquet(f"{self.root}/{kind}")

    def misses(self, kind: str, keys: DataFrame, as_of: str | None = None) -> DataFrame:
        return keys.join(self.read(kind, as_of).select("key"), "key", "left_anti")
