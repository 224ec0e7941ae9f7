"""The training-data pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdlens.llm import decontam, langid, ngram_join, packing, secrets
from crowdlens.llm.common import aliased, restored, table
from crowdlens.session import scratch_path

MIN_LANGUAGE_SCORE = 0.4  # least share of a text's letters in its main language


def _recount(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letter, or no main language."""
    model = langid.train(docs, "text", "lang", "doc_id")
    inner, names = aliased(docs)
    judged = langid.predict(inner, names[docs.columns.index("text")], names, model)
    kept = judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return restored(kept, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the least doc_id."""
    return ngram_join.keep_one(docs, "text", "doc_id")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out; drops what is mostly benchmark."""
    return _recount(decontam.clean(docs, table(spark, sf_dir, "benchmark")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces live-looking credentials; copied examples and documents stay."""
    inner, names = aliased(docs)
    text, owner, repo = (names[docs.columns.index(c)] for c in ("text", "source", "doc_id"))
    found = secrets.scan(inner, text, owner, repo, names)
    return _recount(restored(found.withColumn(text, secrets.redact(F.col(text), F.col("_spans"))), docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of whole texts in optimal length buckets and token-budget batches."""
    return packing.pack(docs, "text", "doc_id")


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontaminate),
          ("secret_scan", redact_secrets), ("packing", pack)]

# Viterbi labels and the dynamic programme are beyond SQL: tests compare each
# stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
