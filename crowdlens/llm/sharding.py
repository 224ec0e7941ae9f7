"""Balanced contiguous shards from global prefix sums of byte sizes [native].

Rows are ordered (by ``order``; nulls first, ties by size, checksum and row),
each range partition is totalled, and the totals give every row the number of
bytes before it; equal targets cut that line into ``n_shards`` pieces.  Shards
are contiguous and differ by less than the largest row's size from the target.
No row set is gathered: a source or text that holds a third of the rows is just
a stretch of the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdlens.llm.common import ranked

NEW = ("shard", "slot")


def assign_shards(df: DataFrame, n_shards: int, size: Column, order: list[str]) -> DataFrame:
    """All columns of ``df`` plus ``size`` (long), ``shard`` (0..n_shards-1) and
    ``slot`` (0-based, gapless position inside the shard); input columns of
    these names, or starting with an underscore, are replaced.

    ``size`` must be positive; null sizes count as 1.  An empty table gives an
    empty result; repeated rows are all kept and get their own slots.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    kept = [c for c in df.columns if c not in (*NEW, "size") and not c.startswith("_")]
    rows = ranked(df.withColumn("_size", F.coalesce(size, F.lit(1)).cast("long"))
                  .select(*kept, F.col("_size").alias("size")),
                  order, {"bytes": F.col("size")})
    total = df.agg(F.sum(F.coalesce(size, F.lit(1)))).first()[0] or 1
    # a row belongs to the target that holds its first byte: `div` is exact, a decimal quotient would be rounded
    cutoff = F.expr(f"cast(_before_bytes as decimal(38, 0)) * {n_shards} div cast({total} as decimal(38, 0))")
    rows = rows.withColumn("shard", F.least(cutoff, F.lit(n_shards - 1)).cast("int"))
    first = rows.groupBy("shard").agg(F.min("_rank").alias("_first"))  # n_shards rows
    return (rows.join(F.broadcast(first), "shard")
            .select(*kept, "size", "shard", (F.col("_rank") - F.col("_first")).alias("slot")))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """Contract rows for ``documents``: 8 shards, law ``bytes``."""
    from crowdlens.llm.common import table

    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("n_bytes"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    out = assign_shards(docs, 8, F.col("n_bytes"), ["doc_id", "n_bytes", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
