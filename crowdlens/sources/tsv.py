"""Headerless TSV annotation source (IO1-IO7) and writer.

Line format: ``worker <TAB> task <TAB> label <TAB> text [<TAB> gold [...]]``;
no quoting, extra fields ignored, blank lines skipped.  Spark's CSV reader
is not used because its quote handling differs.

File order matters (first-seen rules), and Spark has no row order, so each
line gets an explicit number.  The file is read twice and copied nowhere: a
counting pass gives every file split its number of lines and of lines that are not
valid; a running sum over the splits in (file, offset) order -- one row per split,
so the window is size-bounded -- gives it the number of lines before it; the
parsing pass adds the place inside the split.  Both passes must cut the files in
the same way, so they share one relation of a session whose split settings are
pinned, and every line is checked against its split's count.
"""

from __future__ import annotations

import warnings

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crowdlens.functions.text import is_blank
from crowdlens.operators.joins import small
from crowdlens.session import cut

SPLIT = ["_file", "_block"]


def _pinned(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` in which the cuts of a file do not
    depend on the executors at hand: a scan cuts its files by the settings of the
    session it was made in, and by default by the number of task slots."""
    reader = spark.newSession()
    held = spark.conf.getAll
    for key, value in (held() if callable(held) else held).items():
        if key.startswith("spark.sql."):
            try:
                reader.conf.set(key, value)
            except PySparkException:  # a static setting: the same in every session
                pass
    if reader.conf.get("spark.sql.files.minPartitionNum", None) is None:
        reader.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return reader


def _lines(spark: SparkSession, path) -> DataFrame:
    """``value`` of every line, its split and a running id (the partition above 33
    bits of place in it)."""
    return _pinned(spark).read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"))


def split_offsets(spark: SparkSession, lines: DataFrame, bad=None) -> DataFrame:
    """The counting pass: one row per split with its first id, number of lines,
    lines before it and lines for which ``bad`` holds, as a written table."""
    counts = cut(lines.groupBy(*SPLIT).agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"),
        F.count_if(F.lit(False) if bad is None else bad).alias("_bad")), "splits")
    order = Window.orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    counts = spark.read.parquet(counts.written_to)  # from here on in the caller's session
    return cut(counts.select(*SPLIT, "_first", "_n", "_bad",
                             F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_off")), "offsets")


def _numbered(lines: DataFrame, offsets: DataFrame) -> DataFrame:
    """The parsing pass: ``line_no`` (1-based) in place of the split."""
    place = F.col("_mid") - F.col("_first")
    number = F.when((place >= 0) & (place < F.col("_n")), F.col("_off") + place + 1).otherwise(
        F.raise_error(F.lit("the files were cut in another way than when they were counted")).cast("bigint"))
    kept = [c for c in lines.columns if c not in (*SPLIT, "_mid")]
    # the offsets are broadcast while their measured size allows; lines without a split are an error, too
    return small(offsets.drop("_bad")).join(lines, SPLIT, "right").select(number.alias("line_no"), *kept)


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """``line_no`` (1-based, across files in name order), ``value``."""
    lines = _lines(spark, path)
    return _numbered(lines, split_offsets(spark, lines))


def _parse(lines: DataFrame) -> DataFrame:
    f = F.split(F.col("value"), "\t", -1)
    n = F.size(f)
    label = F.expr("try_cast(trim(element_at(split(value, '\\t', -1), 3)) AS INT)")
    gold_raw = F.when(n >= 5, F.element_at(f, 5))
    gold = F.expr("try_cast(trim(element_at(split(value, '\\t', -1), 5)) AS INT)")
    reason = (F.when(n < 4, F.lit("fields"))
              .when(label.isNull(), F.lit("label"))
              .when(gold_raw.isNotNull() & ~is_blank(gold_raw) & gold.isNull(), F.lit("gold")))
    return lines.where(~is_blank(F.col("value"))).select(
        *[c for c in lines.columns if c != "value"], "value", reason.alias("reason"),
        F.element_at(f, 1).alias("worker_id"),
        F.element_at(f, 2).alias("task_id"),
        label.alias("worker_label"),
        F.when(n >= 4, F.element_at(f, 4)).alias("body_text"),
        F.when(gold_raw.isNotNull() & ~is_blank(gold_raw), gold).alias("gold_label"))


def _parsed(spark: SparkSession, path) -> tuple[DataFrame, int]:
    """The parsed lines and the number of those that are not valid, which the
    counting pass finds: blank lines are counted as lines, not as invalid."""
    lines = _lines(spark, path)
    f = F.split(F.col("value"), "\t", -1)
    checked = lines.select("value", *SPLIT, "_mid", f.alias("_f"))
    label = F.expr("try_cast(trim(get(_f, 2)) AS INT)")
    gold = F.get("_f", F.lit(4))
    bad = ~is_blank(F.col("value")) & (
        (F.size("_f") < 4) | label.isNull()
        | (gold.isNotNull() & ~is_blank(gold) & F.expr("try_cast(trim(get(_f, 4)) AS INT)").isNull()))
    offsets = split_offsets(spark, checked, bad)
    n_bad = offsets.agg(F.sum("_bad")).first()[0] or 0
    return _parse(_numbered(lines, offsets)), int(n_bad)


def read_annotations(spark: SparkSession, path, mode: str = "report",
                     max_rows: int | None = None) -> DataFrame:
    """IO1-IO7: parsed annotations with ``row_id = line_no - 1``.

    ``mode="failfast"`` raises on the first bad line (the reference's
    behaviour); ``mode="report"`` drops bad lines with a warning that counts
    them (see ``read_rejects``).
    ``max_rows`` keeps the first records in file order (IO6; no cap by
    default).
    """
    p, n_bad = _parsed(spark, path)
    if n_bad and mode == "failfast":
        r = p.where(F.col("reason").isNotNull()).orderBy("line_no").limit(1).first()
        raise ValueError(f"Line {r['line_no']}: invalid record ({r['reason']}): {r['value']!r}")
    if n_bad:
        warnings.warn(f"{n_bad} lines are not valid annotations and were left out", stacklevel=2)
    ok = p.where(F.col("reason").isNull()).select(
        (F.col("line_no") - 1).cast("bigint").alias("row_id"),
        "worker_id", "task_id", F.col("worker_label").cast("int").alias("worker_label"),
        "body_text", F.col("gold_label").cast("int").alias("gold_label"))
    if max_rows is not None:
        from crowdlens.operators.vocab import limited_rows
        ok = limited_rows(ok, max_rows)
    return ok


def read_rejects(spark: SparkSession, path) -> DataFrame:
    """IO3-IO5 in report mode: ``line_no, reason, line`` of lines that fail."""
    p, _ = _parsed(spark, path)
    return p.where(F.col("reason").isNotNull()).select(
        F.col("line_no").cast("bigint").alias("line_no"), "reason", F.col("value").alias("line"))


def tsv_line(ann: DataFrame) -> DataFrame:
    """One TSV line per annotation; tab, CR and LF inside the text become spaces."""
    text = F.regexp_replace(F.col("body_text"), "[\t\r\n]", " ")
    gold = F.coalesce(F.col("gold_label").cast("string"), F.lit(""))
    return ann.select("row_id", F.concat_ws(
        "\t", "worker_id", "task_id", F.col("worker_label").cast("string"), text, gold)
        .alias("value"))


def write_annotations(ann: DataFrame, path: str) -> None:
    """Write annotations as headerless TSV in ``row_id`` order (part files
    are range partitions, so file-name order is row order)."""
    tsv_line(ann).orderBy("row_id").select("value").write.mode("error").text(path)
