"""Tables bucketed by a key under the shared checkpoint folder: what is grouped or
joined on the key reads them without an exchange."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame

from crowdlens.session import cut, observing, release, scratch_path


def bucketed(df: DataFrame, keys: list[str], buckets: int, name: str, metrics: dict[str, Column] | None = None,
             hidden: list[str] = (), path: str | None = None, ordered: bool = False) -> DataFrame:
    """Write ``df`` as an external table bucketed by ``keys`` under the shared
    checkpoint folder (or at ``path``) and read it back.  Two tables bucketed the
    same way join and group on their keys without any exchange.  ``metrics`` and
    ``hidden`` as in ``cut``.  ``ordered``: sorted by the keys, too."""
    spark = df.sparkSession
    name = f"crowdlens_{name}_{uuid.uuid4().hex[:12]}"
    path = path or scratch_path(spark, name)
    rows, seen = observing(df.repartition(buckets, *keys), metrics)
    writer = rows.drop(*hidden).write.bucketBy(buckets, *keys)
    (writer.sortBy(*keys) if ordered else writer).option("path", path).saveAsTable(name)
    table = spark.table(name)
    table.written_to, table.catalog_name = path, name
    table.observed = seen.get if seen else {}
    return table


def placed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` (cheap to plan twice) bucketed by ``key``, one bucket per shuffle
    partition; a plain written table where the session has no writable catalog."""
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    try:
        return bucketed(df, [key], buckets, name)
    except AnalysisException:  # found before anything is written
        return cut(df, name)


def forget(table: DataFrame | None, files: bool = True) -> None:
    """Drop a written table that nothing reads any more, by default with its files."""
    if table is None:
        return
    if hasattr(table, "catalog_name"):
        table.sparkSession.sql(f"DROP TABLE IF EXISTS {table.catalog_name}")
    if files:
        release(table)
