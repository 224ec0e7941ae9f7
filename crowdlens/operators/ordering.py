"""Distributed dense positions ("first-seen index") without a global window.

An un-partitioned ``row_number()`` window moves every row into one task.
Here the rows are range-partitioned on the order key instead (a distributed
sort) and sorted inside their partition, where a running id numbers them as they
are written: partition and place in it.  Each partition is counted (one row per
partition), the offsets are a running sum over that tiny table, and every row gets
``offset + place``.  So the rows cross the network once, and the second pass only
reads them.  The offsets table has one row per partition, so broadcasting it is
size-bounded by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdlens.session import cut


def dense_positions(df: DataFrame, order: list[str | Column], out: str,
                    num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of each row under ``order`` (unique keys)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    # the running id is only meaningful for this one materialisation, so it is
    # pinned before it is read twice (counts and rows)
    ranged = cut(df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
                 .withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)  # the id holds the partition above 33 bits of place
    counts = ranged.groupBy(part.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
                Window.unboundedPreceding, -1)),
            F.lit(0)).alias("_off"))
    place = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (ranged.join(F.broadcast(offsets), part == F.col("_pid"))
            .withColumn(out, (F.col("_off") + place).cast("bigint"))
            .drop("_place", "_pid", "_off"))


def running_sums(df: DataFrame, order: list[str], measures: list[str]) -> DataFrame:
    """Adds ``before_<m>``: the sum of each measure over the rows before, in
    ``order`` (unique keys).

    Ranges are totalled, the totals (one row per range) are summed up in order and
    added to a running sum inside each range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # pinned: another run of the plan could draw other range bounds
    ranged = cut(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()), "ranged")
    zero = F.lit(0)
    upto = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("_pid").agg(*[F.sum(m).alias(f"_{m}") for m in measures]).select(
        "_pid", *[F.coalesce(F.sum(f"_{m}").over(upto), zero).alias(f"_base_{m}") for m in measures])
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.withColumns({f"_own_{m}": F.coalesce(F.sum(m).over(inside), zero) for m in measures})
            .join(F.broadcast(bases), "_pid")
            .select(*df.columns, *[(F.col(f"_own_{m}") + F.col(f"_base_{m}")).alias(f"before_{m}") for m in measures]))


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """Combine one-row aggregates into one row without a join.

    Each input holds exactly one row with its own columns; they are unioned
    (missing columns NULL) and folded with ``first(ignorenulls)`` -- a
    single-partition aggregate over as many rows as there are inputs.
    """
    cols: list[str] = []
    for df in one_row:
        cols += [c for c in df.columns if c not in cols]
    u = one_row[0]
    for df in one_row[1:]:
        u = u.unionByName(df, allowMissingColumns=True)
    return u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])
