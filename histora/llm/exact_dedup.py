"""Exact dedup with a log-structured merge index of digests, in SQL operations only.

Flush: each partition of a batch of documents is a memtable; its entries are sorted
by digest and written as a run of level 0, with Parquet's Bloom filters and min-max
statistics on the digest. Nothing is shuffled.
Compaction: when a level has ``FANOUT`` runs, they merge by digest into one run of
the next level. Readers merge what is left: (digest, smallest id, largest id, rows).
Partial aggregation leaves one entry a digest and memtable before the shuffle, so a
group that holds a third of all rows is no hot spot.
Lookup: digests with more than one row are marked in a filter of ``FILTER_BITS``
bits, the same size for any corpus. Rows whose digest isn't marked are unique and
never move; only marked ones meet the index, and only their texts are read again.
Hits: each row of a group is verified byte by byte against the text that stays.
Should two texts share a digest, that digest's groups are made anew from the texts.

A later batch is flushed into the same index, and its rows meet the ids of all
batches before it; see :class:`DigestIndex`.

Texts are equal when identical after lower-casing A-Z only.

Defined cases: null text counts as empty text; all empty texts are one group; of rows
that repeat both doc_id and text one stays, the first in place, and each counts in
group_size; a null doc_id counts as the largest and comes back null. A row that
repeats the one that stays in an earlier batch goes.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_text, scratch_dir, stored, table

#: Rows of a group that are compared with one copy of the text that stays.
VERIFIED = 500
FANOUT = 4
FILTER_BITS = 1 << 26
SEGMENT_BITS = 1 << 15  # of one bitmap


def ascii_lower(c: str | Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII alone take the quick way."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def _entries(docs: DataFrame) -> DataFrame:
    norm = ascii_lower("text")
    return keyed_text(docs).select("doc_id", norm.alias("norm")).select(F.unhex(F.sha2("norm", 256)).alias("digest"), "doc_id", "norm")


def _merged(entries: DataFrame) -> DataFrame:
    return entries.groupBy("digest").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("none").alias("none"), F.sum("n").alias("n"))


def _stays(largest: bool) -> Column:
    """The id that stays; rows without one come after all others."""
    return F.when(F.col("none") == 0, F.col("most")) if largest else F.col("least")


class DigestIndex:
    """Runs of digests in a folder, by level. A run is a folder L<level>-<id>; it counts once Spark has marked it as whole.

    A run that compaction made names the runs that it replaces, so a reader never
    counts both, even if the driver is lost before the old ones are removed.
    """

    SCHEMA = "digest binary, least long, most long, none long, n long"

    def __init__(self, spark: SparkSession, at: str | None = None, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.at = at or f"{scratch_dir(spark)}/digest-index-{uuid.uuid4().hex}"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if at is None:  # only this run of the program knows it
            self._fs.deleteOnExit(self._path(self.at))

    def _run(self, level: int, replaces: list[str] = ()) -> str:
        return f"L{level}-{uuid.uuid4().hex}" + "".join("~" + r.split("~")[0] for r in replaces)

    def runs(self) -> list[str]:
        """Names of the live runs."""
        home = self._path(self.at)
        if not self._fs.exists(home):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(home)]
        whole = [n for n in names if self._fs.exists(self._path(f"{self.at}/{n}/_SUCCESS"))]
        gone = {r for n in whole for r in n.split("~")[1:]}
        return sorted(n for n in whole if n.split("~")[0] not in gone)

    def _write(self, entries: DataFrame, name: str) -> None:
        runs = entries.sortWithinPartitions("digest").write
        runs.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.max.bytes", str(256 << 10)).option("compression", "zstd").parquet(f"{self.at}/{name}")

    def flush(self, entries: DataFrame) -> None:
        """Adds a batch of (digest, doc_id) as a run of level 0, a memtable a partition."""
        own = entries.select("digest", F.col("doc_id").alias("least"), F.col("doc_id").alias("most"), F.col("doc_id").isNull().cast("long").alias("none"), F.lit(1).cast("long").alias("n"))
        self._write(own, self._run(0))
        self.compact()

    def compact(self) -> None:
        """Merges each level that is full into one run of the next."""
        while True:
            levels: dict[int, list[str]] = {}
            for name in self.runs():
                levels.setdefault(int(name[1:].split("-")[0]), []).append(name)
            full = [k for k, names in levels.items() if len(names) >= self.fanout]
            if not full:
                return
            old = levels[min(full)]
            self._write(_merged(self._read(old)), self._run(min(full) + 1, old))
            for name in old:
                self._fs.delete(self._path(f"{self.at}/{name}"), True)

    def _read(self, runs: list[str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.at}/{r}" for r in runs])

    def merged(self) -> DataFrame:
        """digest, least, most, none (rows without an id) and n over all runs."""
        return _merged(self._read(self.runs()))


def _bit(digest: str) -> tuple[Column, Column]:
    """Segment of a digest in the filter, and its bit there."""
    at = F.pmod(F.xxhash64(digest), F.lit(FILTER_BITS))
    return F.floor(at / SEGMENT_BITS).cast("int"), (at % SEGMENT_BITS).cast("int")


def _marked(df: DataFrame, digests: DataFrame) -> DataFrame:
    """df with ``marked``: whether its digest may be one of those. The filter is FILTER_BITS bits, so it is broadcast."""
    segment, bit = _bit("digest")
    bits = digests.select(segment.alias("__segment"), bit.cast("long").alias("bit")).groupBy("__segment").agg(F.bitmap_construct_agg("bit").alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, bit % 8) == 1
    return df.withColumn("__segment", segment).join(F.broadcast(bits), "__segment", "left").withColumn("marked", F.coalesce(is_set, F.lit(False))).drop("__segment", "__bits")


def exact_dedup(docs: DataFrame, largest: bool = False, index: DigestIndex | None = None, before: DataFrame | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256, a row a document of docs.

    With an index that earlier batches were flushed into, docs are a further batch:
    they are added to it, and keep_id and group_size are over all batches. ``before``
    is then the documents of the earlier ones, for the texts that hits are verified against.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark)
    older = stored(index.merged().select("digest", _stays(largest).alias("older_id")), "older-digests") if index.runs() else None
    rows = stored(_entries(docs).select("digest", "doc_id").withColumn("row", F.monotonically_increasing_id()), "digests")
    index.flush(rows)
    groups = index.merged().where("n > 1").select("digest", _stays(largest).alias("keep_id"), F.col("n").alias("group_size"))
    held = F.lit(False)  # whether the row that stays is one of an earlier batch
    if older is not None:
        groups = groups.join(older.withColumn("known", F.lit(True)), "digest", "left")
        held = F.coalesce("known", F.lit(False)) & F.col("older_id").eqNullSafe(F.col("keep_id"))
    groups = stored(groups.select("digest", "keep_id", "group_size", held.alias("held")), "digest-groups")

    marked = _marked(rows, groups)
    alone = F.lit(1).cast("long").alias("group_size"), F.lit(False).alias("held")
    unique = marked.where("not marked").select("row", "doc_id", "digest", F.col("doc_id").alias("keep_id"), *alone)
    met = marked.where("marked").select("row", "doc_id", "digest").join(groups, "digest", "left")
    of_group = F.col("group_size").isNotNull()
    met = met.select("row", "doc_id", "digest", F.when(of_group, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.coalesce("held", F.lit(False)).alias("held"))
    members = stored(unique.unionByName(met).withColumn("of_text", F.lit(0).cast("long")), "exact-members")  # of_text: tells texts of one digest apart

    # texts of groups alone; a group meets its text that stays in parts of about VERIFIED rows, each with a copy of that text
    own = _entries(docs)
    copies = stored(_marked(own, groups).where("marked").drop("marked"), "exact-copies")
    known = copies if before is None else copies.unionByName(_marked(_entries(before), groups).where("marked").drop("marked"))
    parts = F.ceil(F.col("group_size") / VERIFIED).cast("int")
    of = groups.select(F.col("digest").alias("of_digest"), "keep_id", parts.alias("parts"))
    head = known.join(of, (F.col("digest") == F.col("of_digest")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("norm").alias("kept_text"), F.first("parts").alias("parts"))
    head = head.select("digest", "kept_text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    placed = copies.withColumn("place", F.monotonically_increasing_id())
    dealt = placed.join(groups.select("digest", parts.alias("parts")), "digest").withColumn("part", F.pmod(F.xxhash64("place"), F.col("parts")).cast("int"))
    torn = stored(dealt.join(head, ["digest", "part"]).where("norm <> kept_text").select("digest").distinct(), "torn-digests")
    if not torn.isEmpty():  # two texts with one digest: group these by text
        none = F.count_if(F.col("doc_id").isNull())
        agreed = lambda df: df.join(torn, "digest").groupBy("digest", "norm").agg(F.when(none == 0, F.max("doc_id")).alias("keep_id") if largest else F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        by_text = agreed(own if before is None else own.unionByName(_entries(before))).withColumn("held", F.lit(False))
        if before is not None:
            was = agreed(_entries(before)).select("digest", "norm", F.col("keep_id").alias("older_id"), F.lit(True).alias("known"))
            by_text = by_text.join(was, ["digest", "norm"], "left").withColumn("held", held).drop("older_id", "known")
        again = own.withColumn("row", F.monotonically_increasing_id()).join(by_text, ["digest", "norm"]).select("row", "doc_id", "digest", "keep_id", "group_size", "held", F.xxhash64("norm").alias("of_text"))
        members = stored(members.join(torn, "digest", "left_anti").unionByName(again), "exact-members")
    # of the rows with the id that stays, the first in place
    first = members.where("group_size > 1 and not held and doc_id <=> keep_id").groupBy("digest", "of_text").agg(F.min("row").alias("row")).select("digest", "row", F.lit(True).alias("first"))
    several = members.where("group_size > 1").join(first, ["digest", "row"], "left").withColumn("kept", F.coalesce("first", F.lit(False))).drop("first")
    verdict = members.where("group_size = 1").withColumn("kept", F.lit(True)).unionByName(several)
    return verdict.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), largest=True)


OP7_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, first_value(doc_id) OVER o AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER o = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm), o AS (PARTITION BY norm ORDER BY doc_id DESC NULLS FIRST)
"""
