"""Dataset profile as a state that is built in one pass and merges between loads.

The state has one row for every task, worker and label: its number of rows and of
rows with gold, and sums that a caller adds.  It is one grouped sum over one scan
(combined on the map side, so workers and labels are a handful of rows per task),
and two states merge by the same sum: a new load is profiled alone and added to
the state that is kept.  Exact distinct counts, the label spread and tasks with a
single annotation are read off it.

``distinct_sketches`` is the form for data whose task ids are too many to keep:
fixed-size sketches, mergeable as well, with an error of about 0.8 %.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdlens.functions import text as T

KINDS = ("task_id", "worker_id", "worker_label")
SKETCH_BITS = 14  # a sketch has 2**14 registers: standard error 1.04 / 128


def state(ann: DataFrame, sums: dict[str, Column] | None = None) -> DataFrame:
    """``kind, key, n, n_gold`` and the ``sums``, which ride with the labels (each
    row has exactly one label row, null labels included)."""
    sums = sums or {}
    none = F.lit(0).cast("long")
    is_gold = F.col("gold_label").isNotNull().cast("long") if "gold_label" in ann.columns else none
    rows = F.array(*[F.struct(
        F.lit(kind).alias("kind"), F.col(kind).cast("string").alias("key"), is_gold.alias("n_gold"),
        *[(c.cast("long") if kind == "worker_label" else none).alias(name) for name, c in sums.items()])
        for kind in KINDS])
    return merged(ann.select(F.explode(rows).alias("r")).select(
        "r.kind", "r.key", F.lit(1).cast("long").alias("n"), "r.n_gold", *[f"r.{s}" for s in sums]))


def merged(*states: DataFrame) -> DataFrame:
    """One state of several, with the columns of the first."""
    first, *others = states
    for other in others:
        first = first.unionByName(other)
    measures = [c for c in first.columns if c not in ("kind", "key")]
    return first.groupBy("kind", "key").agg(*[F.sum(m).alias(m) for m in measures])


def _of(kind: str, value: Column) -> Column:
    return F.when(F.col("kind") == kind, value)


def profile(held: DataFrame) -> DataFrame:
    """A1: one row of exact distinct counts and the label range."""
    label = _of("worker_label", F.col("key").cast("int"))
    known = F.col("key").isNotNull().cast("long")
    return held.agg(
        F.coalesce(F.sum(_of("worker_label", F.col("n"))), F.lit(0)).alias("n_rows"),
        F.count_if((F.col("kind") == "worker_id") & (known == 1)).alias("n_workers"),
        F.count_if((F.col("kind") == "task_id") & (known == 1)).alias("n_tasks"),
        F.coalesce(F.sum(_of("worker_label", F.col("n_gold"))), F.lit(0)).alias("n_gold_rows"),
        F.min(label).alias("label_min"), F.max(label).alias("label_max"))


def aggregates(held: DataFrame, sums: list[str] = ()) -> DataFrame:
    """The row that the dataset rules look at: distinct valid workers and tasks,
    single-annotation tasks, label spread, and the totals of ``sums``."""
    named = ~T.is_blank(F.col("key"))
    is_label = F.col("kind") == "worker_label"
    label = F.col("key").cast("int")
    return held.agg(
        F.coalesce(F.sum(F.when(is_label, F.col("n"))), F.lit(0)).alias("n_rows"),
        F.count_if(is_label).alias("n_labels"), F.max(F.when(is_label, F.col("n"))).alias("top"),
        F.min_by(label, F.when(is_label, F.struct(-F.col("n"), label))).alias("top_label"),
        F.count_if((F.col("kind") == "task_id") & named).alias("n_tasks"),
        F.count_if((F.col("kind") == "task_id") & named & (F.col("n") == 1)).alias("single_tasks"),
        F.count_if((F.col("kind") == "worker_id") & named).alias("n_workers"),
        *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in sums])


def distinct_sketches(ann: DataFrame, part: Column) -> DataFrame:
    """``part, n_rows, workers, tasks``: a row with two sketches for each part of
    the data (a load, a day), to be kept as a table."""
    return ann.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.hll_sketch_agg("worker_id", F.lit(SKETCH_BITS)).alias("workers"),
        F.hll_sketch_agg("task_id", F.lit(SKETCH_BITS)).alias("tasks"))


def sketched(parts: DataFrame) -> DataFrame:
    """One row: rows and estimated distinct workers and tasks of all ``parts``."""
    return parts.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("workers")), F.lit(0)).alias("n_workers"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("tasks")), F.lit(0)).alias("n_tasks"))
