"""Running sums in an order, where one group may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, stored


def running(df: DataFrame, by: list[str], order: list[Column], label: str, **sums: str) -> DataFrame:
    """df with, for each name of sums, the sum of that column over the rows of its ``by`` up to and with this one.

    Rows are dealt by ranges of (by, order), so a group of any size lies in as many
    partitions as it fills; each adds its own rows up, and is told what the parts
    of its group before it hold. Rows that are alike in ``order`` are taken in any order.
    """
    dealt = df.repartitionByRange(max(8, partitions(df)), *[F.col(c) for c in by], *order).withColumn("__part", F.spark_partition_id())
    dealt = stored(dealt, label)
    here = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    names = list(sums)
    totals = dealt.groupBy("__part", *by).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = totals.select(F.col("__part").alias("__of"), *[F.col(c).alias(f"__by_{c}") for c in by], *[F.sum(n).over(earlier).alias(f"__before_{n}") for n in names]).where(F.col(f"__before_{names[0]}").isNotNull())
    rows = dealt.select("*", *[F.sum(c).over(here).alias(n) for n, c in sums.items()])
    same = F.col("__part") == F.col("__of")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return rows.join(before, same, "left").select(*df.columns, *[(F.col(n) + F.coalesce(F.col(f"__before_{n}"), F.lit(0))).alias(n) for n in names])
