"""Data mapping: label domain, indexes, gold, votes, re-labelling.

Every operator takes an annotations DataFrame with the canonical schema
``row_id, worker_id, task_id, worker_label, body_text, gold_label`` and
returns a DataFrame.  "First seen" always means smallest ``row_id``.
Grouped operators aggregate (partial + final hash aggregation), so a task
or worker holding a large share of the rows is pre-combined map-side before
its shuffle; nothing is collected per group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdlens.operators import profile as P
from crowdlens.operators.ordering import dense_positions
from crowdlens.session import cut, observing


MAX_CLASSES = 1000  # the model holds one probability column per class


@dataclass(frozen=True)
class LabelDomain:
    """Label range observed on worker labels (or given by the caller)."""

    label_min: int
    label_max: int

    def __post_init__(self) -> None:
        if self.count > MAX_CLASSES:
            raise ValueError(f"labels {self.label_min} to {self.label_max} are more than {MAX_CLASSES} classes")

    @property
    def count(self) -> int:
        return self.label_max - self.label_min + 1


def label_range_df(ann: DataFrame) -> DataFrame:
    """One row ``label_min, label_max, label_count`` from worker labels."""
    return ann.agg(
        F.min("worker_label").alias("label_min"),
        F.max("worker_label").alias("label_max"),
    ).withColumn("label_count", F.col("label_max") - F.col("label_min") + 1)


def label_domain(ann: DataFrame, label_min: int | None = None,
                 label_max: int | None = None) -> LabelDomain:
    """The class count decides the number of probability columns, so it is a
    driver-side scalar (one aggregated row)."""
    if label_min is not None and label_max is not None and label_min <= label_max:
        return LabelDomain(label_min, label_max)
    row = label_range_df(ann).first()
    if row is None or row["label_min"] is None:
        raise ValueError("no annotations: the label domain is undefined")
    return LabelDomain(int(row["label_min"]), int(row["label_max"]))


def dataset_profile(ann: DataFrame) -> DataFrame:
    """A1: one row of exact distinct counts and the label range, in one pass."""
    return P.profile(P.state(ann))


def gold_rows(ann: DataFrame) -> DataFrame:
    """PF1: annotations that carry a gold label."""
    return ann.where(F.col("gold_label").isNotNull())


def zero_based(ann: DataFrame, domain: LabelDomain) -> DataFrame:
    """PF2: ``label = worker_label - label_min`` (0..C-1)."""
    return ann.withColumn("label", (F.col("worker_label") - F.lit(domain.label_min)).cast("int"))


def annotations_per_task(ann: DataFrame) -> DataFrame:
    """A2."""
    return ann.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_annotations"))


def label_distribution(ann: DataFrame) -> DataFrame:
    """A4 with the share of each label; ordered by label at output."""
    counts = ann.groupBy("worker_label").agg(F.count(F.lit(1)).alias("n"))
    # one row per label value: the total is a window over C rows
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("worker_label", "n",
                         F.try_divide(F.col("n").cast("double"), total).alias("share"))


def gold_per_task(ann: DataFrame, domain: LabelDomain | None = None) -> DataFrame:
    """Tasks with gold; one distinct gold value -> zero-based gold, several -> NULL.

    Without a ``domain`` the least worker label is observed while the tasks are
    grouped (one pass over the annotations, and a written table of the tasks)."""
    distinct = F.size(F.collect_set("gold_label")).cast("bigint")  # at most one entry a class
    if domain is None:
        seen, least = observing(ann.select("task_id", "gold_label", "worker_label"),
                                {"least": F.min("worker_label")})
        g = cut(seen.groupBy("task_id").agg(distinct.alias("n_gold_values"), F.min("gold_label").alias("_g")),
                "gold").where("n_gold_values > 0")
        shift = least.get["least"]
    else:
        g = gold_rows(ann).groupBy("task_id").agg(distinct.alias("n_gold_values"), F.min("gold_label").alias("_g"))
        shift = domain.label_min
    return g.select(
        "task_id",
        F.when(F.col("n_gold_values") == 1, F.col("_g") - F.lit(shift))
        .cast("int").alias("gold"),
        "n_gold_values")


VOTE_COLUMNS = 32  # classes counted in columns of their own


def majority_vote(ann: DataFrame, domain: LabelDomain | None = None,
                  given: DataFrame | None = None, zero_based: bool = False) -> DataFrame:
    """Most frequent label per task; a tie goes to the tied label
    whose first annotation comes first.

    With a ``domain`` of few classes the votes of a task are columns of one hash
    aggregate, and labels outside the domain (or null) have no vote; else they
    are counts per (task, label), then ``max_by``.  ``given``: rows whose tasks
    alone get a vote (A9); every annotation of such a task counts.  ``zero_based``
    without a domain: the least label is observed while the votes are counted (a
    minimum, so a task that runs again does not change it) instead of in a pass of
    its own.
    """
    shift = domain.label_min if domain is not None else 0
    least = None
    if zero_based and domain is None:
        ann, least = observing(ann.select("task_id", "worker_label", "row_id"), {"least": F.min("worker_label")})
    if given is not None:
        ann = ann.join(given.select("task_id").distinct(), "task_id", "left_semi")
    if domain is not None and domain.count <= VOTE_COLUMNS:
        labels = range(domain.label_min, domain.label_max + 1)
        votes = ann.where(F.col("worker_label").between(domain.label_min, domain.label_max)) \
            .groupBy("task_id").agg(
                *[F.count_if(F.col("worker_label") == x).alias(f"n_{i}") for i, x in enumerate(labels)],
                *[F.min(F.when(F.col("worker_label") == x, F.col("row_id"))).alias(f"f_{i}")
                  for i, x in enumerate(labels)])
        best = F.array_max(F.array(*[
            F.struct(F.col(f"n_{i}").alias("n"), (-F.col(f"f_{i}")).alias("neg_first"), F.lit(x).alias("worker_label"))
            for i, x in enumerate(labels)]))
        best = votes.select("task_id", best.alias("_best"))
    else:
        per_label = ann.groupBy("task_id", "worker_label").agg(
            F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))
        key = F.struct(F.col("n"), (-F.col("first_row")).alias("neg_first"))
        best = per_label.groupBy("task_id").agg(
            F.max_by(F.struct("worker_label", "n"), key).alias("_best"))
    if least is not None:
        best = cut(best, "votes")
        shift = least.get["least"]
    return best.select(
        "task_id",
        (F.col("_best.worker_label") - F.lit(shift)).cast("int").alias("majority_label"),
        F.col("_best.n").alias("majority_count"))


def true_labels(ann: DataFrame, given: DataFrame, domain: LabelDomain, seed: int = 42) -> DataFrame:
    """M8: ``task_id, label, voted`` (zero-based) for every task of ``ann``: the
    vote of the tasks in ``given``, a seeded pick from the domain for the others."""
    pick = F.pmod(F.conv(F.substring(seeded_hash("task_id", seed), 1, 8), 16, 10).cast("bigint"),
                  F.lit(domain.count)).cast("int")
    votes = majority_vote(ann, domain, given).select("task_id", "majority_label")
    return ann.select("task_id").distinct().join(votes, "task_id", "left").select(
        "task_id", F.coalesce("majority_label", pick).alias("label"),
        F.col("majority_label").isNotNull().alias("voted"))


def first_seen_index(ann: DataFrame, key: str, out: str) -> DataFrame:
    """Dense 0-based index of ``key`` values by first appearance."""
    firsts = ann.groupBy(key).agg(F.min("row_id").alias("first_row"))
    return dense_positions(firsts, ["first_row", key], out).select(key, out, "first_row")


def worker_index(ann: DataFrame) -> DataFrame:
    return first_seen_index(ann, "worker_id", "worker_idx")


def task_index(ann: DataFrame) -> DataFrame:
    return first_seen_index(ann, "task_id", "task_idx")


def first_rows(ann: DataFrame, key: str) -> DataFrame:
    """The first row of each ``key`` (``row_id`` is unique and never null).
    The firsts are a hash aggregate of ids; texts are only joined, not sorted
    and merged on the way."""
    firsts = ann.groupBy(key).agg(F.min("row_id").alias("row_id"))
    return ann.join(firsts, [key, "row_id"], "left_semi")


def task_text(ann: DataFrame) -> DataFrame:
    """The text of the first annotation of each task."""
    return first_rows(ann, "task_id").select("task_id", "body_text")


def worker_tasks(ann: DataFrame, domain: LabelDomain) -> DataFrame:
    """A12 in long form: ``(worker_idx, task_idx, label, row_id)``.

    The reference's ragged per-worker arrays are these rows ordered by
    ``row_id`` within a worker; keeping them long avoids collecting a heavy
    worker's annotations into a single array.
    """
    widx = worker_index(ann).select("worker_id", "worker_idx")
    tidx = task_index(ann).select("task_id", "task_idx")
    return (zero_based(ann, domain)
            .join(widx, "worker_id")
            .join(tidx, "task_id")
            .select("worker_id", "worker_idx", "task_id", "task_idx", "label", "row_id"))


def seeded_hash(row_id: str = "row_id", seed: int = 42):
    """A10: a mixing hash of seed and row that Spark and SQL share, so another
    seed gives another order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))


def random_label(ann: DataFrame, seed: int = 42) -> DataFrame:
    """A10: one annotation per task chosen by a seeded hash (uniform over all
    annotations of the task)."""
    keyed = ann.withColumn("_h", seeded_hash("row_id", seed))
    return keyed.groupBy("task_id").agg(
        F.min_by("worker_label", F.struct("_h", "row_id")).alias("assigned_label"))


def relabel(ann: DataFrame, assigned: DataFrame, label_col: str) -> DataFrame:
    """One annotation per task from assigned labels.

    worker = the first worker of the data, label = gold = assigned label,
    text = first text of the task, row_id = first row of the task.
    """
    first_worker = ann.agg(F.min_by("worker_id", "row_id")).first()[0]
    texts = first_rows(ann, "task_id").select("task_id", "body_text", "row_id")
    return (assigned.join(texts, "task_id")
            .select("row_id",
                    F.lit(first_worker).cast("string").alias("worker_id"),
                    "task_id",
                    F.col(label_col).cast("int").alias("worker_label"),
                    "body_text",
                    F.col(label_col).cast("int").alias("gold_label")))
