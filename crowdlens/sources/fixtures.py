"""Annotation tables derived from the driver's test tables.

Two fixtures turn the generic tables into crowd-annotation tables with the
canonical schema ``row_id, worker_id, task_id, worker_label, body_text,
gold_label``:

* ``text_annotations`` (fixture A): labelled documents, 12 simulated workers
  of falling skill, 4 per document, sparse and sometimes conflicting gold.
* ``order_annotations`` (fixture B): one annotation per line item; the
  supplier is the worker, the order the task, three classes.

Both are plain DataFrame plans over parquet scans, so filters and column
pruning reach the scan; the per-worker fan-out of fixture A is a generator
over the workers that a document is dealt to rather than a cross join, after
the label table (which Spark may broadcast) is joined as it is, one row a
document.  The same definitions are written as SQL in ``crowdlens.plans.sql`` for the DuckDB check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORKERS_A = 12  # fixed value of fixture A: simulated workers per document pool


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one row of the canonical schema, for the text queries."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("bigint").alias("row_id"), F.lit("w0").alias("worker_id"),
        F.col("doc_id").cast("string").alias("task_id"), F.lit(0).alias("worker_label"),
        F.col("text").alias("body_text"), F.lit(None).cast("int").alias("gold_label"))


def faulty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an annotation, with faults by its number, so that each
    row rule of the quality checks has something to find."""
    d = F.col("row_id")

    def every(n: int, fault, sound):
        return F.when(d % n == 0, fault).otherwise(sound)

    return document_rows(spark, sf_dir).select(
        "row_id",
        every(11, F.lit("  "), F.concat(F.lit("w"), (d % 7).cast("string"))).alias("worker_id"),
        every(13, F.lit(None).cast("string"), (F.floor(d / 3)).cast("string")).alias("task_id"),
        every(17, F.lit(7), (d % 2).cast("int")).cast("int").alias("worker_label"),
        every(19, F.lit(" \t "), every(23, F.lit("12 34"), every(29, F.lit("a1 b"), F.col("body_text"))))
        .alias("body_text"),
        every(31, F.lit(9), F.lit(None).cast("int")).cast("int").alias("gold_label"))


def text_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    d = F.col("doc_id")
    q = F.col("quality")
    # Only the 4 workers of 12 that a document is dealt to are exploded, so each
    # text is copied once per kept annotation; the label table stays narrow.
    workers = F.filter(F.sequence(F.lit(0), F.lit(WORKERS_A - 1)), lambda w: ((d * 7 + w * 13) % 12) < 4)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    assigned = docs.join(labels, "doc_id").withColumn("k", F.explode(workers))
    flipped = ((d * 31 + k * 17) % 100) < (5 + 3 * k)
    gold = (F.when(d % 3 != 0, F.lit(None))
            .when(((d % 17) == 0) & ((k % 2) == 0), 1 - q)
            .otherwise(q))
    return assigned.select(
        (d * 100 + k).cast("bigint").alias("row_id"),
        F.concat(F.lit("w"), k.cast("string")).alias("worker_id"),
        d.cast("string").alias("task_id"),
        F.when(flipped, 1 - q).otherwise(q).cast("int").alias("worker_label"),
        F.col("text").alias("body_text"),
        gold.cast("int").alias("gold_label"),
    )


def order_annotations(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey", "l_returnflag",
        "l_partkey")
    status = F.col("o_orderstatus")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"),
        F.when(status == "F", 0).when(status == "O", 1).otherwise(2).alias("gold"))
    ok = F.col("l_orderkey")
    flag = F.col("l_returnflag")
    joined = li.join(orders, ok == F.col("o_orderkey"))
    cols = [
        ((ok * 8 + F.col("l_linenumber")) * 100000000
         + F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("row_id"),
        F.col("l_suppkey").cast("string").alias("worker_id"),
        ok.cast("string").alias("task_id"),
        F.when(((ok * 31 + F.col("l_suppkey") * 17) % 10) < 6, F.col("gold"))
        .otherwise(F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2))
        .cast("int").alias("worker_label"),
    ]
    gold = F.when(ok % 4 == 0, F.col("gold")).cast("int").alias("gold_label")
    if with_text:
        part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
        joined = joined.join(part, F.col("l_partkey") == F.col("p_partkey"))
        return joined.select(*cols, F.col("p_name").alias("body_text"), gold)
    return joined.select(*cols, F.lit(None).cast("string").alias("body_text"), gold)
