import pytest

from crowdlens.session import scratch_path
from crowdlens.sources import tsv as TSV

LINES = [
    "w1\tt1\t1\tfirst text\t1",
    "",
    "w2\tt1\t0\tsecond text",
    "   ",
    "w3\tt2\t 1 \tspaced label\t ",
    "w4\tt2\tx\tbad label",
    "w5\tt3\t1",
    "w6\tt3\t1\tbad gold\t1.5",
    "w7\tt4\t-1\tsix\t0\textra",
]


@pytest.fixture(scope="module")
def path(spark):
    p = scratch_path(spark, "tsv-test")
    spark.createDataFrame([(x,) for x in LINES], "value string").coalesce(1).write.text(p)
    return p


def test_read_valid_rows(spark, path):
    rows = TSV.read_annotations(spark, path).orderBy("row_id").collect()
    got = [(r.row_id, r.worker_id, r.task_id, r.worker_label, r.body_text, r.gold_label)
           for r in rows]
    assert got == [
        (0, "w1", "t1", 1, "first text", 1),
        (2, "w2", "t1", 0, "second text", None),
        (4, "w3", "t2", 1, "spaced label", None),
        (8, "w7", "t4", -1, "six", 0),
    ]


def test_rejects(spark, path):
    rej = {(r.line_no, r.reason) for r in TSV.read_rejects(spark, path).collect()}
    assert rej == {(6, "label"), (7, "fields"), (8, "gold")}


def test_failfast(spark, path):
    with pytest.raises(ValueError, match="Line 6"):
        TSV.read_annotations(spark, path, mode="failfast")


def test_row_cap(spark, path):
    rows = TSV.read_annotations(spark, path, max_rows=2).collect()
    assert sorted(r.row_id for r in rows) == [0, 2]


def test_round_trip_keeps_order(spark):
    from crowdlens.sources.fixtures import text_annotations
    a = text_annotations(spark, "/root/testdata/sf0.001")
    p = scratch_path(spark, "tsv-rt")
    TSV.write_annotations(a, p)
    back = TSV.read_annotations(spark, p)
    want = [r.row_id for r in a.orderBy("row_id").collect()]
    got = back.orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(len(want)))
