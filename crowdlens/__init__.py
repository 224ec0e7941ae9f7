"""crowdlens: crowd-annotation analytics as Spark DataFrame plans.

Public API (every function takes and returns DataFrames; see README)::

    read_annotations(spark, path, mode="report", max_rows=None)
    validate(df, labels=(0, 1), min_text_length=1) -> Validation
    tokenize(df, key="task_id", stem="porter2")
    build_vocabulary(df, selection="first_seen", min_count=1, threshold=0.8,
                     max_terms=None, sample_rows=None, stem="porter2")
    majority_vote(df), random_label(df, seed), relabel(df, assigned, label_col)
    fit(df, vocab=None, iterations=35, tol=None, use_words=True,
        worker_prior="biased", clamp=None) -> CrowdModel
    score_text(model, vocab, docs, key, text_col), worker_prediction(model, pairs)
    evaluate(model, df, score="p1", grid="full") -> Evaluation
    word_ranking(model, vocab, k=30, discriminative=False)
    worker_matrices(model, df, first_workers=5), task_report(model, df)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlens.operators import evaluate as _E
from crowdlens.operators import mapping as _MP
from crowdlens.operators import model as _M
from crowdlens.operators import quality as _Q
from crowdlens.operators import report as _R
from crowdlens.operators import vocab as _V
from crowdlens.operators.model import CrowdModel
from crowdlens.sources.tsv import read_annotations, read_rejects, write_annotations
from crowdlens.streaming.scoring import score_stream
from crowdlens.streaming.scoring import score_texts as score_text

majority_vote = _MP.majority_vote
random_label = _MP.random_label
relabel = _MP.relabel
worker_prediction = _M.worker_prediction
task_report = _R.task_report


@dataclass
class Validation:
    issues: DataFrame    # row_id, severity, rule, message
    dataset: DataFrame   # severity, rule, value, message
    summary: DataFrame   # one row: totals and is_valid


def validate(df: DataFrame, labels: tuple[int, ...] | None = _Q.DEFAULT_LABELS,
             min_text_length: int = 1) -> Validation:
    return Validation(_Q.row_issues(df, labels, min_text_length), _Q.dataset_issues(df),
                      _Q.summary(df, labels, min_text_length))


def tokenize(df: DataFrame, key: str = "task_id", stem: str = "porter2",
             text_col: str = "body_text") -> DataFrame:
    """Vocabulary-path terms ``(key, pos, term)`` of each row's text."""
    return _V.vocab_terms(df, key, stem, text_col=text_col)


build_vocabulary = _V.vocabulary


def fit(df: DataFrame, vocab: DataFrame | None = None, iterations: int = _M.ITERATIONS,
        tol: float | None = None, use_words: bool = True, worker_prior: str = "biased",
        clamp: DataFrame | None = None, stem: str = "porter2", **options) -> CrowdModel:
    """Fit the label model; with ``use_words`` the words of each task's first
    text join the model, over ``vocab`` or a vocabulary built from ``df``."""
    words = None
    size = None
    if use_words and vocab is None:
        vocab = build_vocabulary(df, stem=stem)
    if use_words:
        words = _V.task_words(df, vocab, stem=stem)
        size = vocab.count()
    model = _M.fit(df, words, vocab_size=size, iterations=iterations, tol=tol,
                   worker_prior=worker_prior, clamp=clamp, **options)
    model.stem, model.vocab = stem, vocab
    return model


@dataclass
class Evaluation:
    predictions: DataFrame
    confusion: DataFrame
    recall: DataFrame
    metrics: DataFrame
    binary: DataFrame
    roc: DataFrame
    auc: DataFrame


def evaluate(model: CrowdModel, df: DataFrame, score: str = "p1",
             grid: str = "full") -> Evaluation:
    pred = _E.predictions(model, _MP.gold_per_task(df, model.domain))
    c = model.classes
    conf = _E.model_confusion(pred, c)
    # the curve is defined for two classes only: else its rates and area are null
    scored = pred if c == 2 else pred.limit(0).withColumn("p_1", F.lit(None).cast("double"))
    roc = _E.roc_points(scored, score=score, grid=grid)
    return Evaluation(pred, conf, _E.class_recall(pred, c), _E.metrics(pred, df, c),
                      _E.binary_confusion(conf), roc, _E.roc_auc(roc, anchor=grid == "full"))


def word_ranking(model: CrowdModel, vocab: DataFrame, k: int = 30,
                 discriminative: bool = False, names: dict[int, str] | None = None):
    if discriminative:
        return _R.discriminative_words(model, vocab)
    return _R.word_report(model, vocab, k, names)


def worker_matrices(model: CrowdModel, df: DataFrame, first_workers: int | None = 5):
    if first_workers is None:
        return model.worker_confusion()
    return _R.worker_matrix_report(model, df, first_workers)


__all__ = [
    "CrowdModel", "Evaluation", "Validation", "build_vocabulary", "evaluate", "fit",
    "majority_vote", "random_label", "read_annotations", "read_rejects", "relabel",
    "score_stream", "score_text", "task_report", "tokenize", "validate", "word_ranking",
    "worker_matrices", "worker_prediction", "write_annotations",
]
