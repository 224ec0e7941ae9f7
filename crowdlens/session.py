"""Session helpers: a local session for tests and the lineage-cut helper.

Nothing here changes a session the caller already configured; the folder for
intermediate tables is taken from the session (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import os
import re
import tempfile
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# set while an intermediate table is written
JOB_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
            "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
_LOCAL: dict[str, str] = {}  # scratch folder of each local application


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "crowdlens") -> SparkSession:
    """A local session with AQE on and the web UI off (for tests and bench)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CROWDLENS_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables, read from the session.

    Order: ``spark.checkpoint.dir`` of the session or its context, then the
    context's checkpoint folder.  Only a local master may go on without one
    (a scratch folder per application, as in tests); on a cluster a missing
    folder is an error, because executors do not share local disks.  The
    caller's session is not changed.
    """
    sc = spark.sparkContext
    wanted = (spark.conf.get("spark.checkpoint.dir", None)
              or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir())
    if wanted:
        return wanted
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="crowdlens-ckpt-")
    return _LOCAL[sc.applicationId]


@contextmanager
def setting(spark: SparkSession, wanted: dict[str, str]):
    """The session with these settings, restored at the end."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def cut(df: DataFrame, name: str = "cut", metrics: dict[str, Column] | None = None,
        path: str | None = None, hidden: list[str] = ()) -> DataFrame:
    """Write ``df`` as a parquet table in the shared checkpoint folder (or at
    ``path``) and read it back, cutting its lineage.

    One job (the write), and the data lives in the shared folder rather
    than in executor block stores, so losing an executor later costs
    nothing.  (An eager reliable ``checkpoint()`` of an uncached plan runs
    the plan twice: once to count, once to write.)  The shuffle files of the
    job are released as it ends: nothing reads them after the table is there.
    Batches that go to Python are bounded in bytes, not only in rows.
    ``metrics`` (aggregates over the rows of ``df``) are observed while they are
    written, in the writing tasks, and kept in ``observed``: no second scan.  Columns
    in ``hidden`` are for the metrics only and not written.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df, seen = observing(df, metrics)
    with setting(spark, JOB_CONF):
        df.drop(*hidden).write.mode("error").option("compression", "zstd").parquet(path)
    table = spark.read.parquet(path)
    table.written_to = path  # for release()
    table.observed = seen.get if seen else {}
    return table


def observing(df: DataFrame, metrics: dict[str, Column] | None) -> tuple[DataFrame, Observation | None]:
    """``df`` with aggregates that the next action over it fills in."""
    if not metrics:
        return df, None
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in metrics.items()]), seen


def release(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``cut`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    import uuid

    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
