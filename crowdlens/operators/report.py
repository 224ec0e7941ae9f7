"""Published rankings and matrices (IO10-IO12, T1, T2, T5, J7, J10, A30, M17).

Reports are DataFrames; ``write`` sorts (a distributed range sort) and
writes them with any Spark sink, ``publish`` makes several of them visible at
once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crowdlens import manifest
from crowdlens.operators.model import CrowdModel

# Class names the reference prints for 2-class and 5-class data.
SPAM_NAMES = {0: "ham", 1: "spam"}
SENTIMENT_NAMES = {0: "negative", 1: "positive", 2: "neutral", 3: "not related", 4: "unknown"}


def task_report(model: CrowdModel, ann: DataFrame) -> DataFrame:
    """IO10/T1/J7/A30: P(class 1) per task with counts of raw labels 1 and 0.
    Order for display: ``p_1`` descending (``write(..., order=...)``)."""
    score = "p_1" if model.classes > 1 else "p_0"
    votes = ann.groupBy("task_id").agg(
        F.count_if(F.col("worker_label") == 1).alias("num_pos"),
        F.count_if(F.col("worker_label") == 0).alias("num_neg"))
    return (model.q.select("task_id", F.col(score).alias("p_1"))
            .join(votes, "task_id", "left")
            .select("task_id", "p_1",
                    F.coalesce("num_pos", F.lit(0)).cast("bigint").alias("num_pos"),
                    F.coalesce("num_neg", F.lit(0)).cast("bigint").alias("num_neg")))


def worker_matrix_report(model: CrowdModel, ann: DataFrame, first_workers: int = 5,
                         digits: int = 4) -> DataFrame:
    """IO11/T5: mean confusion matrices of the first workers (by first
    annotation), one row per (worker, true class), one column per label."""
    c = model.classes
    first = (ann.groupBy("worker_id").agg(F.min("row_id").alias("first_row"))
             .orderBy("first_row", "worker_id").limit(first_workers))  # bounded top-k
    cm = model.worker_confusion().join(F.broadcast(first.select("worker_id")), "worker_id")
    wide = cm.groupBy("worker_id", "true_class").pivot("label", list(range(c))).agg(
        F.first("mean"))
    return wide.select("worker_id", "true_class", *[
        F.round(F.col(str(l)), digits).alias(f"label_{l}") for l in range(c)])


def _class_name(names: dict[int, str] | None) -> F.Column:
    fallback = F.col("true_class").cast("string")
    if not names:
        return fallback
    m = F.create_map(*[x for k, v in sorted(names.items()) for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, F.col("true_class")), fallback)


def word_report(model: CrowdModel, vocab: DataFrame, top_words: int = 30,
                names: dict[int, str] | None = None, digits: int = 9,
                spread: int = 64) -> DataFrame:
    """IO12/T2/J10: per class the top words by ln mean probability (ties:
    lower word index first).  Log probabilities are ranked after rounding to
    ``digits`` so sums taken in a different order cannot swap ties.

    Two-stage top-k: each class is first cut to ``top_words`` per slice of
    ``spread`` word slices (in parallel), then the survivors (at most
    ``spread * top_words`` per class) are ranked, so no task sorts a whole
    vocabulary."""
    lp = model.word_log_prob(vocab).withColumn("_r", F.round("log_prob", digits))
    order = [F.col("_r").desc(), F.col("word_idx")]
    sliced = Window.partitionBy("true_class", F.pmod(F.col("word_idx"), F.lit(spread))) \
        .orderBy(*order)
    pre = lp.withColumn("_k", F.row_number().over(sliced)).where(F.col("_k") <= top_words)
    w = Window.partitionBy("true_class").orderBy(*order)
    return (pre.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= top_words)
            .select("true_class", _class_name(names).alias("class_name"),
                    F.col("rank").cast("int").alias("rank"), "word_idx", "term", "log_prob"))


def discriminative_words(model: CrowdModel, vocab: DataFrame) -> DataFrame:
    """p(w|c) / sum over classes of p(w|c), per word and class."""
    lp = model.word_log_prob(vocab).withColumn("p", F.exp("log_prob"))
    total = F.sum("p").over(Window.partitionBy("word_idx"))  # C rows per word
    return lp.select("true_class", "word_idx", "term", (F.col("p") / total).alias("score"))


def formatted(df: DataFrame, decimals: dict[str, int]) -> DataFrame:
    """F16: fixed-decimal text for display columns (e.g. 4 for matrix cells,
    3 for word log probabilities)."""
    return df.select(*[
        F.format_string(f"%.{decimals[c]}f", F.col(c)).alias(c) if c in decimals else F.col(c)
        for c in df.columns])


def write(df: DataFrame, path: str, fmt: str = "parquet", order: list | None = None,
          mode: str = "overwrite") -> None:
    """IO10-IO13 sinks: optional global order, then any Spark writer."""
    out = df.orderBy(*order) if order else df
    writer = out.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)


VERSIONS = 2  # published versions that are kept


def publish(reports: dict[str, DataFrame], folder: str, fmt: str = "parquet",
            orders: dict[str, list[str]] | None = None, versions: int = VERSIONS) -> int:
    """IO10-IO13 as one version of a folder: all ``reports`` become visible
    together, or none does.

    Every report is written under a name of its own, then a manifest with all of
    them; ``read_published`` takes the newest manifest.  A failure in between leaves
    the version before in force, and readers of that one keep their files until
    ``versions`` newer ones are there.  ``orders``: columns by which a report is
    sorted (``-name``: descending), also when it is read.  Returns the version.
    """
    spark = next(iter(reports.values())).sparkSession
    folder = folder.rstrip("/")
    orders = orders or {}
    held = manifest.numbers(spark, folder)
    version = held[-1] + 1 if held else 1
    content = {}
    for name, df in reports.items():
        path = f"{folder}/{name}-{version:09d}-{uuid.uuid4().hex[:8]}"
        write(df, path, fmt, _order(orders.get(name, [])), mode="error")
        content[name] = {"path": path, "format": fmt, "order": orders.get(name, []), "schema": df.schema.json()}
    manifest.write(spark, folder, version, content)
    for old in [n for n in held if n <= version - versions]:
        for entry in manifest.read(spark, folder, old).values():
            manifest.delete(spark, entry["path"])
        manifest.forget(spark, folder, old)
    return version


def read_published(spark, folder: str, name: str) -> DataFrame:
    """The report ``name`` of the newest version of ``folder``, in its order."""
    entry = (manifest.read(spark, folder.rstrip("/")) or {}).get(name)
    if entry is None:
        raise FileNotFoundError(f"no report {name} is published in {folder}")
    reader = spark.read.schema(StructType.fromJson(json.loads(entry["schema"])))
    if entry["format"] == "csv":
        reader = reader.option("header", "true")
    df = reader.format(entry["format"]).load(entry["path"])
    return df.orderBy(*_order(entry["order"])) if entry["order"] else df


def _order(names: list[str]) -> list:
    return [F.col(n[1:]).desc() if n.startswith("-") else F.col(n) for n in names]
