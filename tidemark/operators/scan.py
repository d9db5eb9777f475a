"""Ranks and running sums over range partitions: no task ever holds a whole group or a whole order.

Rows are range-partitioned by group and order once and settled with the number of their
partition. Running sums are taken within each group's segment of a partition, and the sums of
the group's earlier segments, which are one row for each group and partition it touches, added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.records import settle


def earlier(column: str, window) -> Column:
    """The sum over the rows before this one; 0 for the first."""
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def in_segments(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` range-partitioned by group and order, with _segment, the number of a row's partition. A settled table."""
    return settle(df.repartitionByRange(*by, *order).withColumn("_segment", F.spark_partition_id()))


def prefix_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds ``<column>_before``: the sum over the group's rows with a lower order; rows of a group that are equal in order are walked in any order."""
    rows = in_segments(df, by, order)
    totals = rows.groupBy(*by, "_segment").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    above = Window.partitionBy(*by).orderBy("_segment")
    totals = totals.select(*by, "_segment", *[earlier(f"_{c}", above).alias(f"_{c}") for c in columns])
    within = Window.partitionBy(*by, "_segment").orderBy(*order)
    rows = rows.select("*", *[earlier(c, within).alias(f"{c}_before") for c in columns])
    same = rows["_segment"] == totals["_segment"]
    for c in by:
        same &= rows[c].eqNullSafe(totals[c])
    return rows.join(totals, same).select(*[rows[c] for c in df.columns], *[(rows[f"{c}_before"] + totals[f"_{c}"]).alias(f"{c}_before") for c in columns])


def percentiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), out: str = "cuts") -> DataFrame:
    """by and ``out``: the exact interpolated percentiles of each group, null where it has no value.

    Rows are counted by value; a value's place in its group is a running sum over range partitions, so that neither a large
    group nor a value that very many rows share meets in one task. Nulls do not count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = prefix_sums(counts, by, ["_v"], ["_n"])
    # a group's size is where its last value ends; only the values around the wanted places go on
    sizes = placed.groupBy(*[F.col(c).alias(f"_{k}") for k, c in enumerate(by)]).agg(F.max(F.col("_n_before") + F.col("_n")).alias("_total"))
    if by:
        rows = placed.join(sizes, [F.col(c).eqNullSafe(F.col(f"_{k}")) for k, c in enumerate(by)])
    else:
        rows = placed.crossJoin(F.broadcast(sizes))  # one row
    places = [F.lit(float(p)) * (F.col("_total") - 1) for p in shares]
    at = lambda k: F.max(F.when((F.col("_n_before") <= k) & (k < F.col("_n_before") + F.col("_n")), F.col("_v")))
    ends = [x.alias(f"_{k}{j}") for j, p in enumerate(places) for k, x in (("lo", at(F.floor(p))), ("hi", at(F.ceil(p))))]
    found = rows.groupBy(*by).agg(*ends, F.max("_total").alias("_total"))
    cut = lambda j, p: F.col(f"_lo{j}") + (F.col(f"_hi{j}") - F.col(f"_lo{j}")) * (p - F.floor(p))
    return found.select(*by, F.array(*[cut(j, p) for j, p in enumerate(places)]).alias(out))
