from pyspark.sql import functions as F

from crowdlens.operators import model as M
from crowdlens.operators import report as R
from crowdlens.session import scratch_path


def test_reports_and_sinks(spark, sample):
    m = M.fit(sample, None, iterations=3, trace=False)
    tasks = R.task_report(m, sample)
    rows = {r.task_id: (r.num_pos, r.num_neg) for r in tasks.collect()}
    assert rows["10"] == (3, 0)  # raw labels 1,1,2,1,2: three 1s, no 0s
    mat = R.worker_matrix_report(m, sample)
    assert mat.count() == 5 * 2 and set(mat.columns) == {
        "worker_id", "true_class", "label_0", "label_1"}
    text = R.formatted(mat, {"label_0": 4, "label_1": 4})
    assert all(len(r.label_0.split(".")[1]) == 4 for r in text.collect())
    csv_path, pq_path = scratch_path(spark, "rep-csv"), scratch_path(spark, "rep-pq")
    R.write(text, csv_path, fmt="csv", order=["worker_id", "true_class"])
    R.write(tasks, pq_path, order=[F.col("p_1").desc(), "task_id"])
    assert spark.read.option("header", "true").csv(csv_path).count() == 10
    back = spark.read.parquet(pq_path)
    assert back.count() == 4 and set(back.columns) == set(tasks.columns)
