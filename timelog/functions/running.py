"""Running counts and sums that no single task has to see whole.

A window over one log partition sorts all its rows in one task. Here rows are
first cut into blocks of the order column; block totals, which are few, give
each block's start, and the window runs inside blocks.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order column in a block.
BLOCK = 1 << 16


def _blocks(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("__block", F.floor(F.col(order) / block))


def with_running(df: DataFrame, keys: list[str], order: str, ties: list[str], sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Adds, for each name, the sum of its column over the rows of the same keys up to this row, by (order, *ties), itself included."""
    df = _blocks(df.withColumns({f"__v_{n}": c for n, c in sums.items()}), order, block)
    totals = df.groupBy(*keys, "__block").agg(*(F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "__block", *(F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in sums))
    inside = Window.partitionBy(*keys, "__block").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(starts, [*keys, "__block"])
    out = out.withColumns({n: F.col(f"__s_{n}") + F.sum(f"__v_{n}").over(inside) for n in sums})
    return out.drop("__block", *(f"__{p}_{n}" for p in "vs" for n in sums))


def with_rank(df: DataFrame, keys: list[str], order: str, name: str, ties: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Adds the 0-based position of each row among the rows of its keys."""
    return with_running(df, keys, order, ties or [], {name: F.lit(1).cast("long")}, block).withColumn(name, F.col(name) - 1)


def with_highest_before(df: DataFrame, keys: list[str], order: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """Adds the greatest value of the rows of the same keys before this one; null for the first."""
    df = _blocks(df, order, block)
    totals = df.groupBy(*keys, "__block").agg(F.max(value).alias("__t"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "__block", F.max("__t").over(before).alias("__s"))
    inside = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(starts, [*keys, "__block"])
    return out.withColumn(name, F.greatest("__s", F.max(value).over(inside))).drop("__block", "__s")


def stretches(ranges: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """(keys, first, last) of the ranges with those that follow each other or overlap as one; both ends belong to a range."""
    order = Window.partitionBy(*keys).orderBy(first)
    new = F.coalesce(F.col(first) > F.max(last).over(order.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    runs = ranges.withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(order))
    return runs.groupBy(*keys, "__run").agg(F.min(first).alias(first), F.max(last).alias(last)).drop("__run")


def within(rows: DataFrame, order: str, ranges: DataFrame, keys: list[str], first: str, last: str, block: int = 1 << 12) -> DataFrame:
    """The rows whose `order` lies in a range of the same keys. Rows meet the stretches of their block only, not all of their keys."""
    found = stretches(ranges, keys, first, last).withColumn("__block", F.explode(F.sequence(F.floor(F.col(first) / block), F.floor(F.col(last) / block))))
    found = found.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col(first).alias("__first"), F.col(last).alias("__last"), "__block")
    same = [F.col(k) == F.col(f"__k_{k}") for k in keys]
    inside = reduce(and_, same, (F.floor(F.col(order) / block) == F.col("__block")) & F.col(order).between(F.col("__first"), F.col("__last")))
    return rows.join(found, inside, "left_semi")
