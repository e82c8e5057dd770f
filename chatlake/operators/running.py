"""Places and running sums within keys of any size.

A window by key puts a key into one task. Where a key has more rows than RANGE, its rows are dealt to ranges at the quantiles of its
order; windows run inside ranges, and what comes before a range is added from a table with a row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written

RANGE = 1_000_000


def in_ranges(rows: DataFrame, keys: list[str], order: Column, size: int | None = None) -> DataFrame | None:
    """rows with the number of their range, `_part`, written once; None if no key is larger than a range. Equal orders share one."""
    size = size or RANGE
    most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    parts = -(-most // size)
    if parts <= 1:
        return None
    at = rows.withColumn("_at", order.cast("double"))
    cuts = at.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.percentile_approx("_at", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10 * parts)).alias("_cuts"))
    met = at.join(cuts, same_keys(keys), "left")
    return written(met.select(*rows.columns, F.size(F.filter("_cuts", lambda c: c < F.col("_at"))).alias("_part")), "ranges")


def same_keys(keys: list[str]) -> Column:
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return on


def before_ranges(dealt: DataFrame, keys: list[str], total: Column, name: str, combine=F.sum) -> DataFrame:
    """(*keys, _part, name): the combined totals of a key's earlier ranges, null for the first."""
    parts = dealt.groupBy(*keys, "_part").agg(total.alias("_total"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), combine("_total").over(earlier).alias(name))


def with_before(dealt: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    return dealt.join(before, same_keys(keys) & (F.col("_part") == F.col("_p"))).drop("_p", *[f"_k{i}" for i in range(len(keys))])


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, size: int | None = None, by: Column | None = None) -> DataFrame:
    """rows with the sum of value up to each row, in its key and order. by: the first order as a number, where it isn't one."""
    dealt = in_ranges(rows, keys, F.col(order[0]) if by is None else by, size)
    upto = lambda *part: W.partitionBy(*keys, *part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    if dealt is None:
        return rows.withColumn(name, F.sum(value).over(upto()))
    both = with_before(dealt, before_ranges(dealt, keys, F.sum(value), "_before"), keys)
    return both.withColumn(name, F.sum(value).over(upto("_part")) + F.coalesce("_before", F.lit(0))).drop("_part", "_before")


def place(rows: DataFrame, keys: list[str], order: list[str], name: str, size: int | None = None, by: Column | None = None) -> DataFrame:
    """rows with their 1-based place in their key and order."""
    return running_sum(rows.withColumn("_one", F.lit(1).cast("long")), keys, order, "_one", name, size, by).drop("_one")
