"""Places in a global order, without a task that sees more than one range of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import written


def ranked(rows: DataFrame, within: list[str], order: list[Column], place: str = "place", size: str = "size") -> DataFrame:
    """rows with their place (from 0) among those of equal `within` in the given order, and how many those are.

    Rows are dealt by ranges of (within, order), so that a group that holds most rows is split as any other; rows equal
    in all of these are split as well, in no particular order. Each range numbers its own rows and adds the counts of
    the ranges before it: a window over one row for each range and group. Nulls are one group and come first."""
    spread = [F.asc_nulls_first(w) for w in within]
    tie = F.monotonically_increasing_id()
    dealt = rows.withColumn("__tie", tie).repartitionByRange(*spread, *order, F.col("__tie")).drop("__tie")
    dealt = written(dealt.withColumn("__range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*within, "__range").agg(F.count("*").alias("__n"))
    group = Window.partitionBy(*(within or [F.lit(0)]))
    before = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *(F.col(w).alias(f"__{w}") for w in within), F.col("__range").alias("__at"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(group).alias(size),
    )
    own = F.row_number().over(Window.partitionBy(*within, "__range").orderBy(*order)) - 1
    same = reduce(lambda a, b: a & b, (F.col(w).eqNullSafe(F.col(f"__{w}")) for w in within), F.col("__range") == F.col("__at"))
    numbered = dealt.withColumn("__own", own).join(counts, same)
    return numbered.select(*rows.columns, (F.col("__before") + F.col("__own")).alias(place), size)
