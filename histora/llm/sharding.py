"""Contiguous sharding of atomic groups with the least largest shard, in SQL operations only.

Rows of equal text are one group, whose size is the sum of its rows'. Groups are
ordered by their smallest doc_id, then by the hash of their text, and cut into
contiguous shards so that the largest shard is as small as possible. The least
feasible capacity is found by binary search with a greedy check.

The check needs prefix sums over all groups, which no single task or the driver
may hold. So the key range is cut into cells and only sums of cells come to the
driver. Treating cells as indivisible gives a capacity that is surely feasible;
treating them as divisible anywhere one that is surely needed. Between the two,
the k-th cut can only fall into a known run of cells; those alone are split
further, by one aggregation a round, until they hold one group each. Rounds are
logarithmic in the key range; a round brings at most a few ten thousand sums.

Slots are numbered per shard and salt, with offsets from the counts of the salts
before, so a hot shard is not numbered by one task.

Defined cases: null text counts as empty text, of size 16; repeated rows belong
to one group and each gets its own slot; groups that share their smallest doc_id
(repeated ids with other texts) are ordered by the hash of their text; any 64-bit
id is legal, and groups without one come last.
An empty table gives no rows; fewer groups than shards leave shards empty.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

SHARDS = 40
ROW_BYTES = 16
FIRST_CELLS, SPLIT_BITS = 4096, 5
SLOT_ROWS = 20_000


@dataclass
class Cells:
    """Cells of the key range in order: start key, bytes, and whether it can't be split."""

    keys: list[int]
    sizes: list[int]
    whole: list[bool]

    def __post_init__(self) -> None:
        self.before = [0]
        for s in self.sizes:
            self.before.append(self.before[-1] + s)

    def cuts(self, capacity: int, shards: int, fluid: bool) -> list[int] | None:
        """Positions in bytes where greedy shards of that capacity end; None if they don't suffice."""
        total, at, out = self.before[-1], 0, []
        while at < total:
            if len(out) == shards:
                return None
            end = at + capacity
            if end < total:
                k = bisect_right(self.before, end) - 1  # the cell that the end falls into
                if not fluid or self.whole[k]:
                    end = self.before[k]
                if end <= at:
                    return None
            at = min(end, total)
            out.append(at)
        return out

    def least(self, low: int, high: int, shards: int, fluid: bool) -> int:
        """Least capacity from low to high that suffices; high is taken to."""
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, fluid) is None:
                low = middle + 1
            else:
                high = middle
        return low

    def open(self, low: int, high: int, shards: int) -> list[int]:
        """Divisible cells into which a cut of a capacity from low to high can fall."""
        total = self.before[-1]
        first, last = [], []
        at = 0
        for _ in range(shards - 1):  # the earliest each cut can be: lowest capacity, cells indivisible
            k = bisect_right(self.before, min(at + low, total)) - 1
            at = max(at, self.before[min(k, len(self.sizes))])
            first.append(at)
        at = 0
        for _ in range(shards - 1):  # the latest
            at = min(at + high, total)
            last.append(at)
        found: set[int] = set()
        for a, b in zip(first, last, strict=True):
            i = max(0, bisect_right(self.before, a) - 1)
            while i < len(self.sizes) and self.before[i] <= b:
                if not self.whole[i]:
                    found.add(i)
                i += 1
        return sorted(found)


#: A place in the order is (id << TIE_BITS) + tie; groups without an id have NO_ID.
TIE_BITS = 63
NO_ID = 1 << 63


def _place(key: int | None, tie: int) -> int:
    return ((NO_ID if key is None else key) << TIE_BITS) + tie


def _cell(bits: int) -> list[Column]:
    """The cell of 2**bits places that a group is in: of its id, null without one, and of its tie."""
    return [F.shiftright("key", max(0, bits - TIE_BITS)).alias("cell"), (F.shiftright("tie", bits) if bits < TIE_BITS else F.lit(0).cast("long")).alias("part")]


def _start(cell: int | None, part: int, bits: int) -> int:
    return _place(None if cell is None else cell << max(0, bits - TIE_BITS), part << bits if bits < TIE_BITS else 0)


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """Places at which the shards but the first start, and the least capacity. groups: key long or null, tie long (0 or more), bytes long."""
    head = groups.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.sum("bytes").alias("total"), F.max("bytes").alias("most")).first()
    if head.total is None:
        return [], 0
    span = 1 if head.low is None else head.high - head.low + 1
    bits = max(0, (-(-(span << TIE_BITS) // FIRST_CELLS) - 1).bit_length())  # cells are 2**bits places wide, so finer ones lie within

    def summed(df: DataFrame, b: int) -> dict[int, tuple[int, bool, tuple]]:
        found = df.groupBy(*_cell(b)).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect()
        return {_start(r.cell, r.part, b): (r.bytes, r.n == 1 or not b, (r.cell, r.part)) for r in found}

    cells = summed(groups, bits)
    low = max(head.most, -(-head.total // shards))
    while True:
        keys = sorted(cells)
        now = Cells(keys, [cells[k][0] for k in keys], [cells[k][1] for k in keys])
        high = now.least(max(low, max(now.sizes)), head.total, shards, fluid=False)
        low = now.least(low, high, shards, fluid=True)
        opened = [keys[i] for i in now.open(low, high, shards)]
        if not opened or now.cuts(low, shards, fluid=False) is not None:
            break
        # as many as cells lie between the earliest and the latest place of a cut: the optimizer broadcasts them if they are few
        ids = groups.sparkSession.createDataFrame([cells[k][2] for k in opened], "at long, at_part long")
        named = groups.select("*", *_cell(bits))
        inside = named.join(ids, named["cell"].eqNullSafe(ids["at"]) & (named["part"] == ids["at_part"]), "left_semi").drop("cell", "part")
        bits = max(0, bits - SPLIT_BITS)
        for k in opened:
            del cells[k]
        cells |= summed(inside, bits)
    best = now.least(low, high, shards, fluid=False)
    ends = now.cuts(best, shards, fluid=False)
    starts = [keys[bisect_right(now.before, e) - 1] for e in ends[:-1]]
    return starts, best


def _ordered(key: Column, tie: Column) -> Column:
    """The place of a group as a value that sorts as places do."""
    return F.struct(key.isNull().alias("none"), F.coalesce(key, F.lit(0)).cast("long").alias("key"), tie.cast("long").alias("tie"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row."""
    rows = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", (F.octet_length("text") + ROW_BYTES).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.unhex(F.sha2("text", 256)).alias("digest")),
        "sharding-rows",
    )
    tie = F.shiftrightunsigned(F.xxhash64("digest"), 1)
    groups = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("key"), F.sum("size").alias("bytes")).withColumn("tie", tie), "sharding-groups")
    starts, _ = minimax_cuts(groups, shards)
    split = [divmod(s, 1 << TIE_BITS) for s in starts]
    cuts = [_ordered(F.lit(None).cast("long") if key == NO_ID else F.lit(key), F.lit(t)) for key, t in split]
    at = _ordered(F.col("key"), F.col("tie"))
    of = groups.select("digest", F.size(F.filter(F.array(*cuts), lambda c: c <= at)).alias("shard") if cuts else F.lit(0).alias("shard"))
    salts = max(1, -(-rows.count() // SLOT_ROWS))
    placed = stored(rows.join(of, "digest").select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(salts)).alias("salt")), "sharding-placed")
    counted = placed.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = placed.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "salt").orderBy(F.asc_nulls_last("doc_id"), "text_crc32", "size")))
    return numbered.join(offsets, ["shard", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op6_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
