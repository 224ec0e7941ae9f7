import math

import pytest
from pyspark.sql import functions as F

from crowdlens.operators import evaluate as E
from crowdlens.operators import mapping as MP
from crowdlens.operators import quality as Q
from tests.conftest import make_ann


def test_each_row_rule_once(spark):
    ann = make_ann(spark, [
        (" ", "t1", 0, "ok text", None),      # V2
        ("w1", "", 1, "ok text", None),       # V3
        ("w1", "t2", 7, "ok text", None),     # V4
        ("w1", "t2", 1, "ok text", 9),        # V5
        ("w1", "t3", 0, " \t", None),         # V6
        ("w1", "t3", 0, "12 34", None),       # V7
        ("w2", "t4", 1, "y" * 10001, 1),      # V9
    ])
    rules = {(r.row_id, r.rule) for r in Q.row_issues(ann).collect()}
    assert rules == {(0, "V2"), (1, "V3"), (2, "V4"), (3, "V5"), (4, "V6"), (5, "V7"), (6, "V9")}
    s = Q.summary(ann).first()
    assert s.valid_records == 2 and s.n_errors == 5 and not s.is_valid


def test_dataset_rules(spark):
    one_label = make_ann(spark, [("w1", "t1", 1, "a", None), ("w1", "t1", 1, "b", None)])
    rules = {r.rule for r in Q.dataset_issues(one_label).collect()}
    assert rules == {"V11", "V12", "V14"}
    rows = [("w%d" % (i % 3), "t%d" % (i // 2), 1 if i else 0, "txt", None) for i in range(40)]
    skewed = make_ann(spark, rows)
    rules = {r.rule for r in Q.dataset_issues(skewed).collect()}
    assert "V15" in rules


def _pred(spark, rows):
    return spark.createDataFrame(rows, "task_id string, gold int, p_0 double, p_1 double") \
        .withColumn("predicted", (F.col("p_1") > F.col("p_0")).cast("int")) \
        .withColumn("p_gold", F.when(F.col("gold") == 1, F.col("p_1")).otherwise(F.col("p_0")))


@pytest.mark.parametrize("scores,auc", [
    ([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], 1.0),     # perfect
    ([(1, 0.1), (1, 0.2), (0, 0.8), (0, 0.9)], 0.0),     # inverted
    ([(0, 0.5), (1, 0.5), (0, 0.5), (1, 0.5)], 0.5),     # constant
    ([(0, 0.0), (1, 1.0)], 1.0),                         # score exactly 1.0
])
def test_roc_auc(spark, scores, auc):
    rows = [(str(i), g, 1 - s, s) for i, (g, s) in enumerate(scores)]
    pts = E.roc_points(_pred(spark, rows))
    assert pts.count() == 1001
    out = E.roc_auc(pts).first()
    assert out.auc == pytest.approx(auc, abs=1e-9)


def test_roc_one_class_only(spark):
    rows = [("a", 1, 0.3, 0.7), ("b", 1, 0.6, 0.4)]
    out = E.roc_auc(E.roc_points(_pred(spark, rows))).first()
    assert out.n_neg == 0 and out.auc_se is None


def test_bucket_is_exact(spark):
    vals = [0.3, 0.7, 0.001, 0.999, 1.0, 0.0, 0.1 + 0.2]
    df = spark.createDataFrame([(v,) for v in vals], "s double")
    got = [r.b for r in df.select(E._bucket(F.col("s"), 1000).alias("b")).collect()]
    want = [max(i for i in range(1001) if i / 1000.0 <= v) for v in vals]
    assert got == want


def test_metrics_and_confusion(spark):
    rows = [("a", 0, 0.9, 0.1), ("b", 1, 0.2, 0.8), ("c", 1, 0.6, 0.4), ("d", 0, 0.0, 1.0)]
    p = _pred(spark, rows)
    conf = {(r.gold, r.predicted): r.n for r in E.model_confusion(p, 2).collect()}
    assert conf == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    ann = make_ann(spark, [("w", "a", 0, "x", 0), ("w", "b", 0, "x", 1)])
    m = E.metrics(p, ann, 2).first()
    assert m.accuracy == 0.5 and m.avg_recall == 0.5 and m.worker_label_accuracy == 0.5
    cap = -math.log(0.001)
    want = (-math.log(0.9) - math.log(0.8) - math.log(0.4) + cap) / 4
    assert m.nlpd == pytest.approx(want)
    b = E.binary_confusion(E.model_confusion(p, 2)).first()
    assert (b.tp, b.tn, b.fp, b.fn) == (1, 1, 1, 1)


def test_gold_consistency_and_ties(spark):
    ann = make_ann(spark, [("w1", "t", 2, "x", 1), ("w2", "t", 1, "x", 2),
                           ("w1", "u", 1, "x", None), ("w2", "u", 2, "x", 2)])
    dom = MP.label_domain(ann)
    gold = {r.task_id: r.gold for r in MP.gold_per_task(ann, dom).collect()}
    assert gold == {"t": None, "u": 1}  # conflicting -> NULL; zero-based
    mv = {r.task_id: r.majority_label for r in MP.majority_vote(ann, dom).collect()}
    assert mv == {"t": 1, "u": 0}  # tie -> label seen first


def test_observed_label_domain(spark):
    ann = make_ann(spark, [("w1", "t", 1, "x", 3), ("w2", "t", 2, "x", 2)])
    rules = {(r.row_id, r.rule) for r in Q.row_issues(ann, labels=None).collect()}
    assert rules == {(0, "V5")}  # gold 3 is outside the observed labels {1, 2}


def test_reference_roc_grid(spark):
    rows = [("a", 0, 0.9, 0.1), ("b", 1, 0.2, 0.8)]
    pts = E.roc_points(_pred(spark, rows), grid="reference")
    assert pts.count() == 1000 and pts.agg(F.max("cutoff_idx")).first()[0] == 999
    assert E.roc_auc(pts, anchor=False).first().auc == pytest.approx(1.0)
