"""Dense numbers in a given order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lattica.plans.storage import Scratch, stored

#: monotonically_increasing_id() has the row's place within its partition in so many low bits.
_LOW = (1 << 33) - 1


def numbered(df: DataFrame, order: list[Column], column: str, first: int = 1, keep: Scratch | None = None) -> DataFrame:
    """``df`` with ``column``: first, first + 1, ... in that order, which must be total for the numbers to be sure.

    Rows are sorted into ranges and written with their range and their place
    in it; how many rows the ranges before have (one short row a range) completes the number.  ``keep`` deletes that table in the end.
    """
    names = iter(f"_number{i}" for i in range(10**6) if f"_number{i}" not in df.columns)
    part, at, before = next(names), next(names), next(names)
    placed = df.orderBy(*order).withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW))})
    placed = (keep.stored if keep else stored)(placed, "numbered")
    upto = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(part).agg(F.count("*").alias("n"))
    starts = counts.select(part, F.coalesce(F.sum("n").over(upto), F.lit(0)).alias(before))
    return placed.join(F.broadcast(starts), part).select(*df.columns, (F.col(before) + F.col(at) + first).cast("long").alias(column))
