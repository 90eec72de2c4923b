"""Joins of sets by what they share, where one member may be in a third of all sets.

A self-join on a member costs the square of its sets. So members are split by how many sets
have them: those under ``HEAVY`` are joined as they are, the others never are.

* :func:`similar` finds pairs over a bound. Members are ordered from rare to frequent; a pair over the
  bound shares one of the first few of either set (prefix filter), so heavy members, which come last, seldom
  count. A pair that shares heavy members alone consists of sets that are heavy for the most part; these are
  compared by the set of their heavy members, each such set once, whatever the number of sets that have it.
* :func:`meetings` counts, for each set, the others that it meets. Sets with the same heavy members meet the same
  sets through them: their union is a bitmap, joined by ``bitmap_or_agg``; pairs that light members make are
  listed and left out if a heavy one makes them, too.

Equal sets are one: a set is told by its size and 128 bits of its members.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .keep import kept

HEAVY = 1000
PAIRS_AT_ONCE = 200_000_000  # pairs through light members, with repeats, that are shuffled at once
MOST_LISTED = 20_000_000  # shared members of pairs, up to which they are simply joined and counted


def _signature(member: str) -> list[Column]:
    return [F.count("*").alias("n"), F.bit_xor(F.xxhash64(member)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), member)).alias("y")]


def members_of(sets: DataFrame, key: str) -> DataFrame:
    """(key, member), each pair once, written down, as it is read several times."""
    return kept(sets.select(key, "member").where(F.col("member").isNotNull()).distinct())


def set_classes(sets: DataFrame, key: str) -> DataFrame:
    """key, rep (the least key with the same members) and n (members). sets: key, member, each pair once."""
    signed = sets.groupBy(key).agg(*_signature("member"))
    reps = signed.groupBy("n", "x", "y").agg(F.min(key).alias("rep"))
    return signed.join(reps, ["n", "x", "y"]).select(key, "rep", "n")


def _bucket(df: Column) -> Column:
    """Frequencies by powers of two. What comes first within one doesn't matter: a prefix takes all of its last bucket."""
    return F.floor(F.log2(df)).cast("int")


def _prefix(rows: DataFrame, sizes: DataFrame, needed: Column) -> DataFrame:
    """The rows of each set that hold its n - needed + 1 rarest shared members at least. rows: id, member, bucket; sizes: id, n.

    Members that the other side lacks are in no row; they are the rarest, so they are counted first.
    """
    by = Window.partitionBy("id").orderBy("bucket")
    counts = rows.groupBy("id", "bucket").agg(F.count("*").alias("c"))
    known = counts.withColumn("upto", F.sum("c").over(by)).withColumn("all", F.sum("c").over(Window.partitionBy("id")))
    want = F.col("n") - needed + 1 - (F.col("n") - F.col("all"))
    last = known.join(sizes, "id").where(F.col("upto") >= want).groupBy("id").agg(F.min("bucket").alias("last"), F.min(want).alias("want")).where("want > 0")
    return rows.join(last.select("id", "last"), "id").where("bucket <= last").select("id", "member", "bucket")


def similar(a: DataFrame, b: DataFrame, least: float, share: bool = False, heavy: int = HEAVY, listed: int = MOST_LISTED) -> DataFrame:
    """a_id, b_id, shared, n_a, n_b and jaccard of the pairs of distinct sets over a bound: Jaccard, or with ``share`` the shared part of a's.

    a: a_id, member; b: b_id, member. Of equal sets of one side only the least id stands in the result; see
    :func:`set_classes`. The cost is linear in the rows for the light members, times ``heavy`` at most. Where the shared members
    of all pairs, which are summed first, are ``listed`` at most, they are joined as they are; the result is the same.
    """
    if not 0 < least <= 1:
        raise ValueError("the bound must be over 0 and at most 1")
    a, b = members_of(a, "a_id"), members_of(b, "b_id")
    return similar_of(a, set_classes(a, "a_id"), b, set_classes(b, "b_id"), least, share, heavy, listed)


def similar_of(a: DataFrame, a_class: DataFrame, b: DataFrame, b_class: DataFrame, least: float, share: bool = False, heavy: int = HEAVY, listed: int = MOST_LISTED) -> DataFrame:
    """As ``similar``, of pairs that are there once and their classes."""
    na, nb = (c.where(F.col(k) == F.col("rep")).select(F.col("rep").alias("id"), "n") for c, k in ((a_class, "a_id"), (b_class, "b_id")))
    a, b = (x.withColumnRenamed(k, "id").join(n.select("id"), "id", "left_semi") for x, k, n in ((a, "a_id", na), (b, "b_id", nb)))
    df = a.groupBy("member").agg(F.count("*").alias("da")).join(b.groupBy("member").agg(F.count("*").alias("db")), "member")
    if (df.agg(F.sum(F.col("da") * F.col("db")).alias("n")).first()["n"] or 0) <= listed:
        met = a.select(F.col("id").alias("a_id"), "member").join(b.select(F.col("id").alias("b_id"), "member"), "member")
    else:
        met = _met(a, na, b, nb, df.select("member", _bucket(F.col("da") + F.col("db")).alias("bucket")), least, share, heavy)
    counted = met.groupBy("a_id", "b_id").agg(F.count("*").alias("shared"))
    out = counted.join(na.select(F.col("id").alias("a_id"), F.col("n").alias("n_a")), "a_id").join(nb.select(F.col("id").alias("b_id"), F.col("n").alias("n_b")), "b_id")
    out = out.select("a_id", "b_id", "shared", "n_a", "n_b", (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("jaccard"))
    return out.where(F.col("shared") / F.col("n_a") >= least if share else F.col("jaccard") >= least)


def _met(a: DataFrame, na: DataFrame, b: DataFrame, nb: DataFrame, df: DataFrame, least: float, share: bool, heavy: int) -> DataFrame:
    """a_id, b_id and member: what the pairs share that may be over the bound. df: member, bucket of the members that both sides have."""
    a, b = (kept(x.join(df, "member").select("id", "member", "bucket")) for x in (a, b))
    light = F.col("bucket") < math.ceil(math.log2(heavy))
    needed = F.ceil(F.lit(least) * F.col("n") - 1e-9)  # shared members that a set of n needs at least

    first_a = _prefix(a, na, needed)
    first_b = b if share else _prefix(b, nb, needed)
    sized = lambda x, n, k: x.where(light).join(n, "id").select(F.col("id").alias(f"{k}_id"), F.col("n").alias(f"n_{k}"), "member")
    near = sized(first_a, na, "a").join(sized(first_b, nb, "b"), "member")
    fits = F.lit(True) if share else (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(least) - 1e-9)
    by_light = near.where(fits).select("a_id", "b_id").distinct()

    # pairs of heavy members alone: sets that are heavy as far as the bound needs it, by the set of these
    def dominated(x: DataFrame, n: DataFrame, bound: Column) -> tuple[DataFrame, DataFrame]:
        own = x.where(~light)
        signed = own.groupBy("id").agg(F.count("*").alias("h"), *_signature("member")[1:]).join(n, "id").where(F.col("h") >= bound)
        kinds = signed.groupBy("h", "x", "y", "n").agg(F.min("id").alias("kind"))
        members = signed.join(kinds, ["h", "x", "y", "n"]).select("id", "kind")
        return members, kinds.select("kind", "n").join(own.withColumnRenamed("id", "kind"), "kind").select("kind", "n", "member")

    of_a, kinds_a = dominated(a, na, needed)
    of_b, kinds_b = dominated(b, nb, F.lit(1) if share else needed)
    left, right = kinds_a.select(F.col("kind").alias("ka"), F.col("n").alias("n_a"), "member"), kinds_b.select(F.col("kind").alias("kb"), F.col("n").alias("n_b"), "member")
    common = left.join(right, "member").groupBy("ka", "kb", "n_a", "n_b").agg(F.count("*").alias("k"))
    whole = F.col("n_a") if share else F.col("n_a") + F.col("n_b") - F.col("k")
    over = common.where(F.col("k") >= F.lit(least) * whole - 1e-9).select("ka", "kb")
    by_heavy = over.join(of_a.select(F.col("id").alias("a_id"), F.col("kind").alias("ka")), "ka").join(of_b.select(F.col("id").alias("b_id"), F.col("kind").alias("kb")), "kb").select("a_id", "b_id")

    asked = kept(by_light.unionByName(by_heavy).distinct())
    return asked.join(a.select(F.col("id").alias("a_id"), "member"), "a_id").join(b.select(F.col("id").alias("b_id"), "member"), ["b_id", "member"])


def meetings(sets: DataFrame, heavy: int = HEAVY, at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """id and others, how many other sets share a member with it. sets: id, member.

    The cost is heavy times the rows for light members, and for heavy ones a bitmap of all sets for each distinct set of
    heavy members. Pairs beyond ``at_once`` are made in slices of the ids, one after another: a slice is counted and written down,
    and its shuffles go, before the next, so that disk doesn't grow with all pairs.
    """
    sets = kept(sets.select("id", "member").where("id is not null and member is not null").distinct())
    degree = sets.groupBy("member").agg(F.count("*").alias("df"))
    ids = sets.select("id").distinct()
    frequent = degree.where(F.col("df") > heavy).select("member").checkpoint()
    shared = degree.where((F.col("df") > 1) & (F.col("df") <= heavy))
    light = sets.join(shared.select("member"), "member", "left_semi")
    slices = math.ceil((shared.agg(F.sum(F.col("df") * F.col("df")).alias("n")).first()["n"] or 0) / at_once)
    if slices > 1:
        light = kept(light)

    def each_slice(count: Callable[[DataFrame], DataFrame]) -> DataFrame:
        out = None
        for n in range(max(1, slices)):
            mine = light.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == n) if slices > 1 else light
            counted = count(mine.join(light.withColumnRenamed("id", "other"), "member").where("id <> other").select("id", "other").distinct())
            counted = kept(counted) if slices > 1 else counted
            out = counted if out is None else out.unionByName(counted)
        return out

    if frequent.isEmpty():
        counted = each_slice(lambda pairs: pairs.groupBy("id").agg(F.count("*").alias("others")))
        return ids.join(counted, "id", "left").select("id", F.coalesce("others", F.lit(0)).alias("others"))

    own = sets.join(frequent, "member", "left_semi")
    # numbers for the bits: dense per bucket of the hash, so that bitmaps are full
    numbered = _numbered(own.select("id").distinct()).checkpoint()
    signed = own.groupBy("id").agg(*_signature("member"))
    kinds = signed.groupBy("n", "x", "y").agg(F.min("id").alias("kind"))
    kind_of = signed.join(kinds, ["n", "x", "y"]).select("id", "kind").checkpoint()
    bits = own.join(numbered, "id").groupBy("member", F.bitmap_bucket_number("nth").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("nth")).alias("bits")).checkpoint()
    of_kind = own.join(kinds.select(F.col("kind").alias("id")), "id", "left_semi").withColumnRenamed("id", "kind")
    united = of_kind.join(bits, "member").groupBy("kind", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    through = united.groupBy("kind").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    by_heavy = kind_of.join(through, "kind").select("id", (F.col("n") - 1).alias("met"))

    def unmet(pairs: DataFrame) -> DataFrame:
        # of the pairs by light members those that no heavy one makes: their kinds share none
        named = pairs.join(kind_of.withColumnRenamed("kind", "k1"), "id", "left").join(kind_of.select(F.col("id").alias("other"), F.col("kind").alias("k2")), "other", "left")
        named = named if slices > 1 else named.checkpoint()  # a slice isn't written down, as it would stay
        asked = named.select("k1", "k2").distinct()
        sharing = asked.join(of_kind.withColumnRenamed("kind", "k1"), "k1").join(of_kind.withColumnRenamed("kind", "k2"), ["k2", "member"]).select("k1", "k2").distinct()
        return named.join(sharing, ["k1", "k2"], "left_anti").groupBy("id").agg(F.count("*").alias("fresh"))

    fresh = each_slice(unmet)
    return ids.join(by_heavy, "id", "left").join(fresh, "id", "left").select("id", (F.coalesce("met", F.lit(0)) + F.coalesce("fresh", F.lit(0))).alias("others"))


def _numbered(ids: DataFrame) -> DataFrame:
    """id and nth from 1, in any order: numbers within a part, from where the part before ends."""
    dealt = ids.withColumn("at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("at", 33)
    counts = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    return dealt.withColumn("part", part).join(F.broadcast(starts.select("part", "start")), "part").select("id", (F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("nth"))
