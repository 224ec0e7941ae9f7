import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("PYTHONPATH", ROOT)

# The 20-row sample (worker, task, label, text), 5 workers x 4
# tasks, labels {1, 2}, no gold, in file order.
SAMPLE_ROWS = """
1 10 1 this if fine
1 20 2 not fine
1 30 1 this is good
1 40 2 not good
2 10 1 this is fine
2 20 1 not fine
2 30 1 this is good
2 40 1 not good
3 10 2 this is fine
3 20 2 not fine
3 30 2 this is good
3 40 2 not good
4 10 1 this is fine
4 20 1 not fine
4 30 1 this is good
4 40 2 not good
5 10 2 this is fine
5 20 2 not fine
5 30 1 this is good
5 40 2 not good
"""


@pytest.fixture(scope="session")
def spark():
    from crowdlens.session import local_session
    s = local_session("*", shuffle_partitions=8, app="crowdlens-tests")
    yield s


ANN_SCHEMA = ("row_id long, worker_id string, task_id string, worker_label int, "
              "body_text string, gold_label int")


@pytest.fixture(scope="session")
def sample(spark):
    """The 20-row sample shipped with the reference (5 workers x 4 tasks)."""
    rows = [l.split(" ", 3) for l in SAMPLE_ROWS.strip().splitlines()]
    data = [(i, r[0], r[1], int(r[2]), r[3], None) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ANN_SCHEMA)


def make_ann(spark, rows):
    """rows: (worker, task, label, text, gold) in file order."""
    data = [(i,) + tuple(r) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ANN_SCHEMA)
