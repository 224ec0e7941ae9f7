"""Shared plan pieces: hot-key joins, distributed ranks, components, streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crowdlens.operators.ordering import dense_positions
from crowdlens.session import cut, release

HOT_KEYS = 1000  # a key is hot when it holds over 1/HOT_KEYS of the rows


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also when the
    body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hot_join(left: DataFrame, right: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of many ``left`` rows to ``right`` (one row per key, ``n`` =
    the key's row count in ``left``), without a skewed exchange.

    At most HOT_KEYS keys can hold more than 1/HOT_KEYS of the rows, so the
    hot part of ``right`` has a fixed size bound and is broadcast; the other
    keys are joined by a shuffle in which no key is large.  Both inputs are
    read twice: pass tables that are cheap to scan (see ``cut``).
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) * HOT_KEYS > F.lit(total)
    hot, cold = right.where(is_hot), right.where(~is_hot)
    return (left.join(F.broadcast(hot), key)
            .unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)))


def may_match(left: DataFrame, right: DataFrame, key: str, bits: int = 24) -> DataFrame:
    """``left`` with ``_may``: false only if ``key`` is not in ``right``.

    Keeps wide rows out of a shuffle that has no partner for them.  ``right`` is
    reduced to a bitmap of hashed keys; whatever its size, that is at most
    2**(bits - 15) rows of 4 KB (2 MB), which is what is broadcast.  A full bitmap
    lets more rows through and loses none.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(1 << bits)) + 1
    maps = (right.select(slot.alias("_slot")).groupBy(F.bitmap_bucket_number("_slot").alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits")))
    rows = left.withColumn("_slot", slot)
    rows = rows.join(F.broadcast(maps), F.bitmap_bucket_number("_slot") == F.col("_bucket"), "left")
    spot = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(spot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte.cast("long"), (spot % 8).cast("int")) == 1
    return rows.select(*[left[c] for c in left.columns], F.coalesce(hit, F.lit(False)).alias("_may"))


def ranked(df: DataFrame, order: list[str], measures: dict[str, Column],
           group: str | None = None) -> DataFrame:
    """Adds ``_rank`` (0-based, in ``order`` with nulls first) and for each
    measure ``_before_<name>``, its sum over the rows before; with ``group``
    (few distinct values) both restart in every group.

    Rows are dealt by range, each range is totalled, the totals (ranges x
    groups rows) are summed up in order and added to a running sum inside each
    range.  Ties are broken by a row id, so equal keys are split between ranges
    however many there are.  The ranged rows are written once: sampling would
    choose other bounds in a second run of the same plan.  A rank alone is read
    off the sorted ranges without another exchange.
    """
    if not measures and not group:
        return dense_positions(df.withColumn("_rid", F.monotonically_increasing_id()),
                               [*order, "_rid"], "_rank").drop("_rid")
    keys = [group] if group else []
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.withColumn("_rid", F.monotonically_increasing_id())
                 .repartitionByRange(parts, *order, "_rid")
                 .withColumn("_pid", F.spark_partition_id()), "ranged")
    sums = {"_rank": F.lit(1), **{f"_before_{k}": v for k, v in measures.items()}}
    totals = ranged.groupBy("_pid", *keys).agg(*[F.sum(v).alias(f"{k}_t") for k, v in sums.items()])
    upto = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_pid", *keys, *[
        F.coalesce(F.sum(f"{k}_t").over(upto), F.lit(0)).alias(f"{k}_b") for k in sums])
    inside = (Window.partitionBy("_pid", *keys).orderBy(*order, "_rid")
              .rowsBetween(Window.unboundedPreceding, -1))
    run = ranged.withColumns({f"{k}_r": F.coalesce(F.sum(v).over(inside), F.lit(0))
                              for k, v in sums.items()})
    join = [run["_pid"] == bases["_pid"], *[run[k].eqNullSafe(bases[k]) for k in keys]]
    out = run.join(F.broadcast(bases), join)
    return out.select(*[run[c] for c in df.columns],
                      *[(F.col(f"{k}_r") + F.col(f"{k}_b")).cast("long").alias(k) for k in sums])


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of ``edges`` (a, b long): rows (id, comp), comp the
    least id of the component; only ids that have an edge appear.

    Least-label propagation with pointer jumping; each round is written to the
    shared folder, and rounds grow with the logarithm of a component's
    diameter.  Labels are never collected.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
               .where("a <> b").distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
                 .select("id", F.least("id", "m").alias("comp")), "labels")
    for _ in range(max_rounds):
        near = (both.join(labels.select(F.col("id").alias("b"), "comp"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near")))
        step = labels.join(near, "id").select("id", F.col("comp").alias("old"),
                                              F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        up = F.least("comp", F.coalesce("up", "comp"))
        new = cut(step.join(jump, "comp", "left").select("id", up.alias("comp"), (up < F.col("old")).alias("moved")),
                  "labels")
        release(labels)
        labels = new
        if new.where("moved").isEmpty():
            release(both)
            return labels.select("id", "comp")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def byte_slices(batches: Iterator[pa.RecordBatch], column: str,
                max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of each slice have about ``max_bytes``
    (one longer text stays whole): bounds what array code holds at once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """One table for each run of equal ``key`` in a sorted stream of batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pc.run_end_encode(batch.column(key)).run_ends.to_pylist()
        for at, end in zip([0, *ends], ends):
            piece = batch.slice(at, end - at)
            if held and held[-1].column(key)[0] != piece.column(key)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held)


def aliased(df: DataFrame, prefix: str = "in_") -> tuple[DataFrame, list[str]]:
    """``df`` with its columns renamed by position, so that added columns cannot
    clash, and the new names; ``restored`` undoes it."""
    names = [f"{prefix}{i}" for i in range(len(df.columns))]
    return df.toDF(*names), names


def restored(df: DataFrame, columns: list[str], prefix: str = "in_") -> DataFrame:
    return df.select(*[F.col(f"{prefix}{i}").alias(c) for i, c in enumerate(columns)])


def no_clash(keep: list[str], added: str) -> None:
    """Refuses kept columns that are named like an added or internal one (names
    separated by spaces) or twice; ``aliased`` avoids both."""
    if clash := sorted({c for c in keep if c in added.split() or keep.count(c) > 1}):
        raise ValueError(f"kept columns have names that are taken: {', '.join(clash)}")


def arrow_fields(df: DataFrame, names: list[str]) -> str:
    """Schema text of some columns of ``df``, each followed by a comma."""
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in names)
