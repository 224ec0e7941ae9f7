"""Evaluation against gold.

Per-task work is column arithmetic and grouped counts.  The ROC curve is a
fixed grid of 1,001 cut-offs: scores are bucketed to the highest cut-off they
reach (one pass over the tasks), counted per bucket, and cumulated with a
window over at most 1,001 rows -- instead of one scan per cut-off.  ``rank_auc``
needs no grid: it ranks the distinct scores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdlens.operators.model import CrowdModel, predicted_class
from crowdlens.operators.ordering import running_sums, side_by_side

NLPD_CAP = -math.log(0.001)  # fixed value: capped negative log probability
ROC_STEPS = 1000             # fixed value: cut-off grid step 0.001


def predictions(model: CrowdModel, gold: DataFrame) -> DataFrame:
    """Gold tasks with the posterior (uniform when the task has none),
    the arg-max class (ties to the lowest class) and P(gold).

    ``gold``: ``task_id, gold`` (zero-based, NULL for inconsistent gold);
    gold outside the class range is excluded (reported by the quality rules).
    """
    c = model.classes
    g = gold.where(F.col("gold").isNotNull() & (F.col("gold") >= 0) & (F.col("gold") < c))
    j = g.select("task_id", "gold").join(model.q, "task_id", "left")
    probs = [F.coalesce(F.col(f"p_{t}"), F.lit(1.0 / c)).alias(f"p_{t}") for t in range(c)]
    j = j.select("task_id", "gold", *probs)
    p_gold = F.element_at(F.array(*[F.col(f"p_{t}") for t in range(c)]), F.col("gold") + 1)
    return j.select("task_id", F.col("gold").cast("int").alias("gold"),
                    predicted_class(c).alias("predicted"), p_gold.alias("p_gold"),
                    *[F.col(f"p_{t}") for t in range(c)])


def _grid(spark, c: int) -> DataFrame:
    r = spark.range(c).select(F.col("id").cast("int").alias("gold"))
    return r.withColumn("predicted", F.explode(F.sequence(F.lit(0), F.lit(c - 1))))


def model_confusion(pred: DataFrame, c: int) -> DataFrame:
    """Gold x predicted counts on the full C x C grid (zeros kept)."""
    counts = pred.groupBy("gold", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return (_grid(pred.sparkSession, c).join(counts, ["gold", "predicted"], "left")
            .select("gold", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def class_recall(pred: DataFrame, c: int) -> DataFrame:
    """Per gold class: support, correct and recall (NULL without support)."""
    per = pred.groupBy("gold").agg(
        F.count(F.lit(1)).alias("n_gold"),
        F.count_if(F.col("predicted") == F.col("gold")).alias("n_correct"))
    classes = pred.sparkSession.range(c).select(F.col("id").cast("int").alias("gold"))
    return (classes.join(per, "gold", "left").select(
        F.col("gold").alias("class"),
        F.coalesce("n_gold", F.lit(0)).cast("bigint").alias("n_gold"),
        F.coalesce("n_correct", F.lit(0)).cast("bigint").alias("n_correct"),
        F.try_divide(F.col("n_correct").cast("double"), F.col("n_gold")).alias("recall")))


def metrics(pred: DataFrame, ann: DataFrame, c: int) -> DataFrame:
    """A21-A24 in one row: accuracy, capped NLPD, average recall (NULL if a
    class has no gold), average over present classes, worker-label accuracy."""
    nlp = F.least(F.coalesce(-F.log(F.col("p_gold")), F.lit(NLPD_CAP)), F.lit(NLPD_CAP))
    m = pred.agg(
        F.count(F.lit(1)).alias("n_gold_tasks"),
        F.avg((F.col("predicted") == F.col("gold")).cast("double")).alias("accuracy"),
        F.avg(nlp).alias("nlpd"))
    rec = class_recall(pred, c).agg(
        F.when(F.count_if(F.col("recall").isNull()) == 0, F.avg("recall")).alias("avg_recall"),
        F.avg("recall").alias("avg_recall_present"))
    wla = worker_label_accuracy(ann)
    return side_by_side(m, rec, wla)


def worker_label_accuracy(ann: DataFrame) -> DataFrame:
    """Share of gold-bearing annotations whose raw label equals gold."""
    g = ann.where(F.col("gold_label").isNotNull())
    return g.agg(F.avg((F.col("worker_label") == F.col("gold_label")).cast("double"))
                 .alias("worker_label_accuracy"))


def binary_confusion(conf: DataFrame) -> DataFrame:
    """A25 from the model confusion matrix (class 1 positive)."""
    def cell(g: int, p: int) -> Column:
        return F.sum(F.when((F.col("gold") == g) & (F.col("predicted") == p), F.col("n"))
                     .otherwise(0))
    b = conf.agg(cell(1, 1).alias("tp"), cell(0, 0).alias("tn"),
                 cell(0, 1).alias("fp"), cell(1, 0).alias("fn"))
    return _ratios(b)


def _ratios(df: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn"))
    return df.select(
        F.col("tp").cast("bigint").alias("tp"), F.col("tn").cast("bigint").alias("tn"),
        F.col("fp").cast("bigint").alias("fp"), F.col("fn").cast("bigint").alias("fn"),
        F.try_divide(tp, tp + fn).alias("sensitivity"),
        F.try_divide(tn, tn + fp).alias("specificity"),
        F.try_divide(fp, fp + tn).alias("false_positive_rate"))


def _bucket(score: Column, steps: int) -> Column:
    """Largest i in [0, steps] with i/steps <= score (exact double comparison)."""
    s = F.lit(float(steps))
    b = F.floor(score * s).cast("int")
    b = F.when((b + 1).cast("double") / s <= score, b + 1) \
        .when(b.cast("double") / s > score, b - 1).otherwise(b)
    return F.least(b, F.lit(steps))


def roc_points(pred: DataFrame, score: str = "p1", steps: int = ROC_STEPS,
               grid: str = "full") -> DataFrame:
    """Confusion counts and rates at cut-offs i/steps, i = 0..steps.

    Positive = the largest gold value present; ``score`` = ``p1`` (P(class 1),
    standard) or ``gold`` (P(gold class), as the reference code does).
    ``grid="reference"`` keeps i = 0..steps-1 only (the original loop never
    reaches the last cut-off); use it with ``roc_auc(anchor=False)``.
    """
    sc = F.col("p_1") if score == "p1" else F.col("p_gold")
    pos_value = pred.agg(F.max("gold")).first()[0]
    scored = pred.select((F.col("gold") == F.lit(pos_value)).alias("pos"),
                         _bucket(sc, steps).alias("b"))
    per = scored.groupBy("b").agg(F.count_if("pos").alias("np"),
                                  F.count_if(~F.col("pos")).alias("nn"))
    cutoffs = pred.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("b"))
    # the grid has steps+1 rows, so this un-partitioned window is size-bounded
    w = Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, 0)
    allw = Window.partitionBy()
    g = cutoffs.join(per, "b", "left").select(
        "b", F.coalesce("np", F.lit(0)).alias("np"), F.coalesce("nn", F.lit(0)).alias("nn"))
    g = g.select(
        F.col("b").alias("cutoff_idx"),
        (F.col("b").cast("double") / F.lit(float(steps))).alias("cutoff"),
        F.sum("np").over(w).alias("tp"), F.sum("nn").over(w).alias("fp"),
        F.sum("np").over(allw).alias("n_pos"), F.sum("nn").over(allw).alias("n_neg"))
    g = g.select("cutoff_idx", "cutoff", "tp", "fp",
                 (F.col("n_neg") - F.col("fp")).alias("tn"),
                 (F.col("n_pos") - F.col("tp")).alias("fn"))
    if grid == "reference":
        g = g.where(F.col("cutoff_idx") < F.lit(steps))
    elif grid != "full":
        raise ValueError(f"unknown grid {grid!r}")
    return _with_ratios(g)


def _with_ratios(g: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn"))
    return g.select(
        "cutoff_idx", "cutoff",
        F.col("tp").cast("bigint").alias("tp"), F.col("tn").cast("bigint").alias("tn"),
        F.col("fp").cast("bigint").alias("fp"), F.col("fn").cast("bigint").alias("fn"),
        F.try_divide(tp, tp + fn).alias("sensitivity"),
        F.try_divide(tn, tn + fp).alias("specificity"),
        F.try_divide(fp, fp + tn).alias("false_positive_rate"))


def roc_auc(points: DataFrame, anchor: bool = True) -> DataFrame:
    """Trapezoid area over points in specificity order (= cut-off
    order) with the (0, 0) end point, and the Hanley-McNeil standard error."""
    p = points.select("cutoff_idx", "sensitivity", "false_positive_rate", "tp", "fn", "tn", "fp")
    if anchor:
        end = points.agg(
            (F.max("cutoff_idx") + 1).alias("cutoff_idx"),
            F.lit(0.0).alias("sensitivity"), F.lit(0.0).alias("false_positive_rate"),
            F.lit(0).cast("bigint").alias("tp"), F.max(F.col("tp") + F.col("fn")).alias("fn"),
            F.max(F.col("tn") + F.col("fp")).alias("tn"), F.lit(0).cast("bigint").alias("fp"))
        p = p.unionByName(end)
    w = Window.orderBy("cutoff_idx")  # <= steps + 2 rows
    seg = p.select(
        ((F.col("sensitivity") + F.lead("sensitivity").over(w))
         * (F.col("false_positive_rate") - F.lead("false_positive_rate").over(w)) / 2.0)
        .alias("area"),
        (F.col("tp") + F.col("fn")).alias("n_pos"), (F.col("tn") + F.col("fp")).alias("n_neg"))
    a = seg.agg(F.sum("area").alias("auc"), F.max("n_pos").alias("n_pos"),
                F.max("n_neg").alias("n_neg"))
    A = F.col("auc")
    q1 = A / (F.lit(2.0) - A)
    q2 = F.lit(2.0) * A * A / (F.lit(1.0) + A)
    var = F.try_divide(A * (F.lit(1.0) - A) + (F.col("n_pos") - 1.0) * (q1 - A * A)
                       + (F.col("n_neg") - 1.0) * (q2 - A * A),
                       (F.col("n_pos") * F.col("n_neg")).cast("double"))
    return a.select("auc", F.sqrt(var).alias("auc_se"),
                    F.col("n_pos").cast("bigint").alias("n_pos"),
                    F.col("n_neg").cast("bigint").alias("n_neg"))


def rank_auc(pred: DataFrame, score: str = "p1", digits: int = 9) -> DataFrame:
    """A28/A29 without a grid: the area from rank sums (ties count half) and its
    standard error from the variance of the placement values (DeLong et al.).

    Rows are first counted by distinct score (rounded to ``digits``), so tied
    posteriors, however many, are one row; two running sums over the scores give
    each positive the share of negatives below it and each negative the share of
    positives.  Positive = the largest gold value, as in ``roc_points``.  The area
    is null without positives or negatives, the error below two of either.
    """
    sc = F.round(F.col("p_1") if score == "p1" else F.col("p_gold"), digits)
    pos_value = pred.agg(F.max("gold")).first()[0]
    pos = F.col("gold") == F.lit(pos_value)
    tied = pred.where(F.col("gold").isNotNull() & sc.isNotNull()).groupBy(sc.alias("s")).agg(
        F.count_if(pos).alias("np"), F.count_if(~pos).alias("nn"))
    r = running_sums(tied, ["s"], ["np", "nn"])
    half = lambda below, own: (F.col(below) + F.col(own) / 2).cast("double")
    v, w = half("before_nn", "nn"), half("before_np", "np")  # negatives under a positive, positives under a negative
    a = r.agg(F.sum("np").alias("n_pos"), F.sum("nn").alias("n_neg"),
              F.sum(F.col("np") * v).alias("v1"), F.sum(F.col("np") * v * v).alias("v2"),
              F.sum(F.col("nn") * w).alias("w1"), F.sum(F.col("nn") * w * w).alias("w2"))
    p, n = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    spread = lambda two, one, own, other: F.try_divide(  # sample variance of the placements
        F.try_divide(F.col(two), other * other) - F.try_divide(F.pow(F.try_divide(F.col(one), other), 2), own), own - 1)
    var = F.try_divide(spread("v2", "v1", p, n), p) + F.try_divide(spread("w2", "w1", n, p), n)
    return a.select(F.try_divide(F.col("v1"), p * n).alias("auc"), F.when(var.isNotNull(), F.sqrt(F.greatest(var, F.lit(0.0)))).alias("auc_se"),
                    F.coalesce("n_pos", F.lit(0)).cast("bigint").alias("n_pos"),
                    F.coalesce("n_neg", F.lit(0)).cast("bigint").alias("n_neg"))
