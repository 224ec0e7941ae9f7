"""Data-quality rules (V1-V17) in two passes: row rules and dataset rules.

Row rules are evaluated as one projection: every rule is a conditional
struct, the non-NULL ones are exploded into ``(row_id, severity, rule,
message)`` rows.  Dataset rules are read off a profile state (one pass over the
rows, mergeable between loads).  Nothing is collected per row; reports take the first rows by ``row_id`` (a bounded top-k).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdlens.functions import text as T
from crowdlens.operators import profile as P
from crowdlens.operators.mapping import MAX_CLASSES

DEFAULT_LABELS = (0, 1)       # fixed value: default label domain
SINGLE_LABEL_SHARE = 0.95     # fixed value: severe imbalance threshold


def _issue(cond: Column, severity: str, rule: str, message: Column) -> Column:
    return F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"),
                                 message.alias("message")))


def _rule_array(labels: tuple[int, ...] | None, min_text_length: int) -> Column:
    """All row rules of one record as an array of issue structs (no NULLs)."""
    allowed = sorted(set(labels)) if labels is not None else None
    expected = ", ".join(str(x) for x in allowed) if allowed is not None else ""
    wl, gl, body = F.col("worker_label"), F.col("gold_label"), F.col("body_text")
    blank_text = T.is_blank(body)
    clean_len = T.letters_only_length(body)
    rules = [
        _issue(T.is_blank(F.col("worker_id")), "error", "V2",
               F.lit("worker id is blank")),
        _issue(T.is_blank(F.col("task_id")), "error", "V3",
               F.lit("task id is blank")),
    ]
    if allowed is not None:
        rules += [
            _issue(~wl.isin(allowed), "error", "V4",
                   F.format_string("worker label %d is outside {%s}",
                                   wl, F.lit(expected))),
            _issue(gl.isNotNull() & ~gl.isin(allowed), "error", "V5",
                   F.format_string("gold label %d is outside {%s}",
                                   gl, F.lit(expected))),
        ]
    rules += [
        _issue(blank_text, "error", "V6", F.lit("text is blank")),
        _issue(~blank_text & ~T.has_letters(body), "warning", "V7",
               F.lit("text has no letters")),
        _issue(~blank_text & T.has_letters(body) & (clean_len < F.lit(min_text_length)),
               "warning", "V8",
               F.format_string("text has only %d letters and spaces",
                               clean_len)),
        _issue(~blank_text & (F.length(body) > F.lit(T.LONG_TEXT)), "warning", "V9",
               F.format_string("text has %d characters", F.length(body))),
    ]
    return F.array_compact(F.array(*rules))


def observed_labels(ann: DataFrame) -> tuple[int, ...]:
    """The distinct worker labels as the domain (at most ``MAX_CLASSES``)."""
    found = ann.select("worker_label").where("worker_label is not null").distinct().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} distinct labels")
    return tuple(sorted(r[0] for r in found))


def row_issues(ann: DataFrame, labels: tuple[int, ...] | None = DEFAULT_LABELS,
               min_text_length: int = 1) -> DataFrame:
    """V2-V9: ``row_id, severity, rule, message`` for every broken rule.
    ``labels=None`` takes the observed worker labels as the domain."""
    if labels is None:
        labels = observed_labels(ann)
    exploded = ann.select("row_id",
                          F.explode(_rule_array(labels, min_text_length)).alias("i"))
    return exploded.select("row_id", "i.severity", "i.rule", "i.message")


def _dataset_rules() -> list[tuple[Column, str, str, Column, Column]]:
    """(condition, severity, rule, value, message) over the aggregate row."""
    share = F.try_divide(F.col("top").cast("double"), F.col("n_rows"))
    return [
        (F.col("n_rows") == 0, "error", "V1", F.lit(0.0), F.lit("the dataset has no rows")),
        ((F.col("n_rows") > 0) & (F.col("n_workers") == 0), "error", "V11",
         F.lit(0.0), F.lit("no row names a worker")),
        (F.col("n_workers") == 1, "warning", "V11", F.lit(1.0),
         F.lit("all rows come from one worker")),
        ((F.col("n_rows") > 0) & (F.col("n_tasks") == 0), "error", "V12",
         F.lit(0.0), F.lit("no row names a task")),
        (F.col("n_tasks") == 1, "warning", "V12", F.lit(1.0),
         F.lit("all rows belong to one task")),
        (F.col("single_tasks") > 0, "warning", "V13",
         F.col("single_tasks").cast("double"),
         F.format_string("%d tasks were labelled once", F.col("single_tasks"))),
        (F.col("n_labels") == 1, "warning", "V14", F.col("top_label").cast("double"),
         F.format_string("every row has label %d",
                         F.col("top_label"))),
        ((F.col("n_labels") > 1) & (share > F.lit(SINGLE_LABEL_SHARE)), "warning",
         "V15", share,
         F.format_string("label %d holds nearly all rows",
                         F.col("top_label"))),
    ]


def _dataset_checks(s: DataFrame) -> DataFrame:
    checks = [_dataset(*r) for r in _dataset_rules()]
    ex = s.select(F.explode(F.array_compact(F.array(*checks))).alias("i"))
    return ex.select("i.severity", "i.rule", "i.value", "i.message")


def dataset_issues(ann: DataFrame) -> DataFrame:
    """V1, V11-V15 (and A3, A5): ``severity, rule, value, message`` rows."""
    return _dataset_checks(P.aggregates(P.state(ann)))


def dataset_issues_of(state: DataFrame) -> DataFrame:
    """The same from a profile state, such as one merged over several loads."""
    return _dataset_checks(P.aggregates(state))


def _dataset(cond: Column, severity: str, rule: str, value: Column, message: Column) -> Column:
    return F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"),
                                 value.cast("double").alias("value"),
                                 message.alias("message")))


def summary(ann: DataFrame, labels: tuple[int, ...] | None = DEFAULT_LABELS,
            min_text_length: int = 1) -> DataFrame:
    """Totals, valid records (rows without an error) and the verdict."""
    if labels is None:
        labels = observed_labels(ann)
    rules = _rule_array(labels, min_text_length)
    e = F.size(F.filter(rules, lambda i: i["severity"] == "error"))
    w = F.size(F.filter(rules, lambda i: i["severity"] == "warning"))
    # the row rules are counted in the one pass that builds the profile state
    counted = ann.select("*", F.struct(e.alias("e"), w.alias("w")).alias("_hits"))
    sums = {"row_errors": F.col("_hits.e"), "row_warnings": F.col("_hits.w"),
            "error_rows": (F.col("_hits.e") > 0).cast("int")}
    agg = P.aggregates(P.state(counted, sums), list(sums))
    rules = _dataset_rules()

    def hits(severity: str) -> Column:
        return sum((F.when(cond, 1).otherwise(0) for cond, sev, *_ in rules
                    if sev == severity), F.lit(0))

    # the dataset rules are plain columns of the combined one-row result
    s = agg.select("n_rows", "row_errors", "row_warnings", "error_rows",
                   hits("error").alias("ds_errors"), hits("warning").alias("ds_warnings"))
    n_err = (F.col("row_errors") + F.col("ds_errors")).cast("bigint")
    return s.select(
        F.col("n_rows").cast("bigint").alias("total_records"),
        (F.col("n_rows") - F.col("error_rows")).cast("bigint").alias("valid_records"),
        n_err.alias("n_errors"),
        (F.col("row_warnings") + F.col("ds_warnings")).cast("bigint").alias("n_warnings"),
        (n_err == 0).alias("is_valid"))


def text_checks(ann: DataFrame, min_text_length: int = 1) -> DataFrame:
    """F11-F13 per row."""
    body = F.col("body_text")
    return ann.select(
        "row_id",
        T.is_blank(body).alias("is_blank"),
        T.has_letters(body).alias("has_letters"),
        T.letters_only_length(body).cast("int").alias("clean_length"),
        F.length(body).cast("int").alias("text_length"),
        (F.length(body) > F.lit(T.LONG_TEXT)).alias("is_long"))


def report(ann: DataFrame, labels: tuple[int, ...] | None = DEFAULT_LABELS,
           min_text_length: int = 1, max_errors: int = 20, max_warnings: int = 10) -> DataFrame:
    """IO13/T6: the first errors and warnings by row (display truncation)."""
    issues = row_issues(ann, labels, min_text_length)
    errs = issues.where(F.col("severity") == "error").orderBy("row_id", "rule").limit(max_errors)
    warns = (issues.where(F.col("severity") == "warning").orderBy("row_id", "rule")
             .limit(max_warnings))
    return errs.unionByName(warns)
