"""Joins with a table of unique keys: broadcast behind a measured size, split
hot keys beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from crowdlens.session import cut

BROADCAST_BYTES = 128 << 20  # largest measured table shipped to every task
SPLIT_ROWS = 1_000_000       # rows of one key that may meet in one task


def measured_bytes(df: DataFrame) -> int:
    """Size of a written table's rows: 8 bytes a value, strings by length."""
    sizes = [F.coalesce(F.octet_length(f.name), F.lit(0)) + 16
             if isinstance(f.dataType, (StringType, BinaryType)) else F.lit(8)
             for f in df.schema.fields]
    return int(df.agg(F.sum(sum(sizes, F.lit(8)).cast("bigint"))).first()[0] or 0)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its measured size allows."""
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def hot_keys(rows: DataFrame, key: str, split_rows: int = SPLIT_ROWS) -> DataFrame | None:
    """``(key, n)`` of the keys with over ``split_rows`` rows (so at most rows /
    split_rows keys), as a written table; None if there are none."""
    found = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
                .where(F.col("n") > F.lit(split_rows)), "hot")
    return None if found.isEmpty() else found


def split_join(many: DataFrame, one: DataFrame, on: list[str], hot: DataFrame | None) -> DataFrame:
    """Inner join where the keys of ``hot`` (few by construction) take their rows
    of ``one`` by broadcast and only the other keys are shuffled."""
    if hot is None:
        return many.join(one, on)
    key = [c for c in on if c in hot.columns]
    names = small(hot.select(*key))
    top = F.broadcast(one.join(names, key, "left_semi"))
    return many.join(top, on).unionByName(
        many.join(names, key, "left_anti").join(one, on))


def keyed_join(many: DataFrame, one: DataFrame, key: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Inner join of ``many`` (cheap to read twice) with a written table of
    unique keys, whatever its size and however the keys are spread."""
    if measured_bytes(one) <= limit:
        return many.join(F.broadcast(one), key)
    return split_join(many, one, [key], hot_keys(many, key))
