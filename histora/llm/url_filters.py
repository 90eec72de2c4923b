"""URL filtering against dated lists: validity intervals and an as-of join.

A list has dated entries: from that time on, a host is listed or not. The entries
of a host become validity intervals, from each entry up to the next, and every
capture is judged by the interval active when it was fetched. An entry for a host
covers its subdomains: a capture is looked up under each suffix of its host.

The join is by equality of (list host, time bucket): intervals that last over
several buckets are carried into a bucket only if captures fall there, by the last
state before the bucket. So a host with a third of all captures is split by time,
neither side is broadcast, and no capture meets an interval that can't cover it.

Defined cases: several entries of a host at one time act in the order of entry_id,
the last one holds; a capture at the very time of an entry sees it; a null url or
fetch time matches no entry and is allowed; a url without a host likewise;
repeated captures are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

BUCKET_SECONDS = 86_400


def host_of(url: str | Column) -> Column:
    """Host of a url in lower case, without user, port and a final dot; null if it has none."""
    url = F.col(url) if isinstance(url, str) else url
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and each parent domain of at least two labels."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _bucket(c: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(c) / F.lit(seconds * 1_000_000)).cast("long")


def intervals(entries: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Validity of each entry: host, bucket, listed, valid_from, valid_to (null: still valid). entries: entry_id, host, ts, listed.

    The next entry is looked up within the bucket, and for the last of a bucket it is the
    first of the host's next bucket; so the longest window is over a host's buckets, not its entries.
    """
    one = entries.select(F.lower("host").alias("host"), F.col("ts").cast("timestamp").alias("ts"), "listed", "entry_id").where("host is not null and ts is not null and listed is not null")
    last = one.groupBy("host", "ts").agg(F.max_by("listed", "entry_id").alias("listed")).withColumn("bucket", _bucket("ts", bucket_seconds))
    heads = last.groupBy("host", "bucket").agg(F.min("ts").alias("head"))
    after = heads.select("host", "bucket", F.lead("head").over(Window.partitionBy("host").orderBy("bucket")).alias("after"))
    inside = last.withColumn("next", F.lead("ts").over(Window.partitionBy("host", "bucket").orderBy("ts")))
    return inside.join(after, ["host", "bucket"]).select("host", "bucket", "listed", F.col("ts").alias("valid_from"), F.coalesce("next", "after").alias("valid_to"))


def judge_captures(captures: DataFrame, entries: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """capture_id, host, rule (the longest suffix listed when fetched, or null) and blocked.

    captures: capture_id, url, fetched.
    """

    seen = captures.select("capture_id", F.col("url").alias("url"), F.col("fetched").cast("timestamp").alias("fetched"))
    looked = seen.withColumn("host", host_of("url"))
    # the verdict depends on host and time alone
    keys = looked.where("host is not null and fetched is not null").select(F.col("host").alias("of"), "fetched").distinct().select("*", F.explode(suffixes(F.col("of"))).alias("key")).withColumn("bucket", _bucket("fetched", bucket_seconds))
    begun = intervals(entries, bucket_seconds)
    # an interval is met in the buckets that it begins in, and, carried, in those of captures after it
    asked = keys.select(F.col("key").alias("host"), "bucket").distinct()
    by_bucket = begun.groupBy("host", "bucket").agg(F.max_by(F.struct("listed", "valid_from", "valid_to"), "valid_from").alias("state"))
    steps = by_bucket.select("host", "bucket", "state", F.lit(False).alias("ask")).unionByName(asked.select("host", "bucket", F.lit(None).cast(by_bucket.schema["state"].dataType).alias("state"), F.lit(True).alias("ask")))
    before = Window.partitionBy("host").orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("state", F.last("state", ignorenulls=True).over(before)).where("ask and state is not null").select("host", "bucket", "state.*")
    active = begun.select("host", "bucket", "listed", "valid_from", "valid_to").unionByName(carried.select("host", "bucket", "listed", "valid_from", "valid_to"))
    hits = (
        keys.join(active.withColumnRenamed("host", "key"), ["key", "bucket"])
        .where("listed and valid_from <= fetched and (valid_to is null or fetched < valid_to)")
        .groupBy(F.col("of").alias("host"), "fetched")
        .agg(F.max_by("key", F.length("key")).alias("rule"))
    )
    return looked.join(hits, ["host", "fetched"], "left").select("capture_id", "host", "rule", F.col("rule").isNotNull().alias("blocked"))


#: Times of the captures and of the list, as the tables hold neither: page n is fetched n * 7919 minutes after this, within 31 days, and events are the list's entries.
EPOCH = "2024-01-01 00:00:00"


def _captures(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").alias("capture_id"), "url", F.timestamp_micros(F.unix_micros(F.lit(EPOCH).cast("timestamp")) + F.pmod(F.col("page_id") * 7919, F.lit(44_640)) * 60_000_000).alias("fetched"))


def _entries(events: DataFrame, pages: DataFrame) -> DataFrame:
    """Dated entries out of the events: an error lists a host, any other kind of event clears it.

    The host of an event is that of the page whose number is the user's.
    """
    hosts = pages.select(F.col("page_id").alias("user_id"), host_of("url").alias("host"))
    return events.select("event_id", "user_id", "ts", "event_type").join(hosts, "user_id").select(F.col("event_id").alias("entry_id"), "host", "ts", (F.col("event_type") == "error").alias("listed"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_captures(_captures(pages), _entries(table(spark, sf_dir, "events"), pages))


OP3_SQL = f"""
WITH p AS (
  SELECT page_id AS capture_id,
         nullif(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\\.$', ''), '') AS host,
         TIMESTAMP '{EPOCH}' + INTERVAL 1 MINUTE * ((((page_id * 7919) % 44640) + 44640) % 44640)::INTEGER AS fetched
  FROM pages
),
e AS (SELECT event_id, p.host, ts, event_type = 'error' AS listed FROM events JOIN p ON p.capture_id = user_id WHERE p.host IS NOT NULL),
o AS (SELECT host, ts, max_by(listed, event_id) AS listed FROM e GROUP BY host, ts),
v AS (SELECT host, listed, ts AS valid_from, lead(ts) OVER (PARTITION BY host ORDER BY ts) AS valid_to FROM o),
k AS (
  SELECT capture_id, host, fetched, string_split(host, '.') AS parts, unnest(range(1, greatest(2, len(string_split(host, '.'))))) AS i FROM p WHERE host IS NOT NULL
),
s AS (SELECT capture_id, fetched, array_to_string(parts[i:], '.') AS key FROM k),
h AS (
  SELECT capture_id, max_by(key, length(key)) AS rule FROM s JOIN v ON v.host = s.key
  WHERE listed AND valid_from <= fetched AND (valid_to IS NULL OR fetched < valid_to) GROUP BY capture_id
)
SELECT p.capture_id, p.host, h.rule, h.rule IS NOT NULL AS blocked FROM p LEFT JOIN h USING (capture_id)
"""
