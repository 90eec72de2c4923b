"""Site-relative line dedup: a line on too many pages of its host is boilerplate.

For each host, the pages that contain a line are divided by the host's pages; a
line over ``RATIO`` is dropped wherever it stands on that host. Lines are the
pieces between newlines, compared unchanged; lines of white space alone neither
count nor go. The rule is the same for hosts of every size: a line on two pages or
more, over the ratio, goes. Two exceptions can be asked for, and are off: hosts under
``least_pages`` pages are left alone; with ``keep_bare``, a page of which nothing but
blank lines would be left, a copy rather than chrome, stays whole.

Only 128-bit line hashes move, counted per host with partial sums, so neither a
hot host nor a line on every page gathers in one task. A host has at most (its
mean number of lines a page) / RATIO boilerplate lines. Their table is broadcast
below ``BROADCAST_ROWS`` rows, a checked bound; beyond it the documents are joined
by host and salt.

Defined cases: a null text counts as an empty one and comes back as it was (null);
a null host is a host of its own; each row is a page, so repeated rows count
again; a page counts once for a line that it repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

RATIO_PERCENT = 8
BROADCAST_ROWS = 200_000
SALTS = 64


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def _blank(line: Column) -> Column:
    return F.length(F.trim(F.regexp_replace(line, r"[\t\r\f\u000b]", " "))) == 0


def boilerplate(pages: DataFrame, ratio_percent: int = RATIO_PERCENT, least_pages: int = 0) -> DataFrame:
    """host and key of each line over the ratio. pages: host, text."""
    lines = pages.select("host", F.explode(F.array_distinct(F.transform(F.filter(_lines(), lambda x: ~_blank(x)), _key))).alias("line"))
    seen = lines.groupBy("host", "line.a", "line.b").agg(F.count("*").alias("n")).where("n >= 2")
    totals = pages.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    return seen.join(totals, seen["host"].eqNullSafe(totals["host"])).where(F.col("n") * 100 > F.col("pages") * ratio_percent).select(seen["host"], F.struct("a", "b").alias("line"))


def dedup_lines(docs: DataFrame, host: str | Column = "source", ratio_percent: int = RATIO_PERCENT, least_pages: int = 0, keep_bare: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with three more columns: kept_text, n_lines and n_dropped; columns of docs that are named so are replaced."""
    host = F.col(host) if isinstance(host, str) else host
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    pages = docs.select(host.alias("host"), "text")
    found = stored(boilerplate(pages, ratio_percent, least_pages), "boilerplate")
    lists = found.groupBy(F.col("host").alias("__line_dedup_host")).agg(F.collect_list("line").alias("__line_dedup_drop"))
    if found.count() <= broadcast_rows:
        joined = docs.join(F.broadcast(lists), host.eqNullSafe(F.col("__line_dedup_host")), "left")
    else:
        salted = lists.withColumn("__line_dedup_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        text_salt = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(SALTS)).cast("int")
        joined = docs.join(salted, host.eqNullSafe(F.col("__line_dedup_host")) & (text_salt == F.col("__line_dedup_salt")), "left").drop("__line_dedup_salt")
    lines = _lines()
    kept = F.filter(lines, lambda x: _blank(x) | ~F.array_contains("__line_dedup_drop", _key(x)))
    joined = joined.withColumn("__line_dedup_kept", F.when(F.col("__line_dedup_drop").isNull(), lines).otherwise(kept))
    if keep_bare:
        bare = ~F.exists("__line_dedup_kept", lambda x: ~_blank(x))
        joined = joined.withColumn("__line_dedup_kept", F.when(bare, lines).otherwise(F.col("__line_dedup_kept")))
    return joined.withColumns(
        {
            "kept_text": F.when(F.col("text").isNotNull(), F.array_join("__line_dedup_kept", "\n")),
            "n_lines": F.size(lines).cast("long"),
            "n_dropped": (F.size(lines) - F.size("__line_dedup_kept")).cast("long"),
        }
    ).drop("__line_dedup_host", "__line_dedup_drop", "__line_dedup_kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d
),
b AS (SELECT *, NOT regexp_matches(line, '[^ \\t\\r\\f\\x0B]') AS blank FROM l),
pages AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
bad AS (
  SELECT b.source, line FROM b JOIN pages p ON b.source IS NOT DISTINCT FROM p.source WHERE NOT blank
  GROUP BY b.source, line, pages HAVING count(DISTINCT rid) >= 2 AND count(DISTINCT rid) * 100 > pages * {RATIO_PERCENT}
),
m AS (
  SELECT b.*, bad.line IS NOT NULL AS gone FROM b LEFT JOIN bad ON b.source IS NOT DISTINCT FROM bad.source AND b.line = bad.line
)
SELECT doc_id, count(*) AS n_lines, coalesce(sum(CASE WHEN gone THEN 1 ELSE 0 END), 0)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
