"""Packing into optimal length buckets.

A text is cut into chunks of at most ``max_tokens`` tokens that together are the
whole text.  The global histogram of chunk lengths (max_tokens + 1 entries, a
fixed bound) goes to the driver, where dynamic programming chooses the bucket
lengths with the least padding in total; inside each bucket, batches of a fixed
token budget are filled in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlens.llm.common import arrow_fields, byte_slices, no_clash, ranked, table
from crowdlens.llm.words import joined_bytes
from crowdlens.session import cut

MAX_TOKENS, BUCKETS, BUDGET = 4096, 8, 65_536
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def optimal_buckets(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Upper lengths of at most ``n_buckets`` buckets that minimise the padding.

    ``lengths`` ascending and distinct.  best[j]: least padding of the first j
    lengths; a bucket over lengths i..j-1 pads each to the largest of them.
    O(buckets x lengths**2) on arrays; of equal cuts the first is taken.
    """
    n = len(lengths)
    if not n:
        return []
    rows = np.concatenate(([0], np.cumsum(counts, dtype=np.float64)))
    tokens = np.concatenate(([0], np.cumsum(counts * lengths, dtype=np.float64)))
    best = np.full(n + 1, np.inf)
    best[0] = 0
    cuts = []
    for _ in range(min(n_buckets, n)):
        new, at = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            at[j] = cost.argmin()
            new[j] = cost[at[j]]
        best = new
        cuts.append(at)
    out, j = [], n
    for at in reversed(cuts):
        if j:
            out.append(int(lengths[j - 1]))
            j = int(at[j])
    return out[::-1]


def chunks(df: DataFrame, text: str, keep: list[str], max_tokens: int = MAX_TOKENS,
           with_text: bool = True) -> DataFrame:
    """``keep`` columns, ``chunk`` (0-based), ``n_tokens`` (runs of non-blank
    characters), ``start`` and ``end`` (UTF-8 bytes) and, if wanted, the chunk's
    ``chunk_text``.  The chunks of a text joined are the text; a text without
    tokens (or null) is one chunk of none."""
    no_clash(keep, "chunk n_tokens start end chunk_text _text")
    base = df.select(*keep, F.col(text).alias("_text"))

    def run(batches):
        for batch in byte_slices(batches, "_text"):
            data, offsets = joined_bytes(batch.column("_text"))
            inside = ~BLANK[data]
            edge = np.zeros(len(data), dtype=bool)
            edge[offsets[:-1][offsets[:-1] < len(data)]] = True
            first = inside & (edge | ~np.concatenate(([False], inside[:-1])))[:len(data)] if len(data) else inside
            token = np.flatnonzero(first)
            at = np.searchsorted(token, offsets)
            n = np.diff(at)
            parts = np.maximum(-(-n // max_tokens), 1)
            row = np.repeat(np.arange(batch.num_rows), parts)
            chunk = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            begin = offsets[:-1][row].copy()
            later = chunk > 0
            begin[later] = token[at[:-1][row[later]] + chunk[later] * max_tokens]
            end = np.concatenate((begin[1:], offsets[-1:])) if len(begin) else begin
            size = np.minimum(n[row] - chunk * max_tokens, max_tokens)
            kept = batch.select(keep).take(pa.array(row))
            columns = [*kept.columns, pa.array(chunk.astype(np.int32)), pa.array(size.astype(np.int32)),
                       pa.array(begin - offsets[:-1][row]), pa.array(end - offsets[:-1][row])]
            names = [*keep, "chunk", "n_tokens", "start", "end"]
            if with_text:
                marks = pa.array(np.concatenate((begin, offsets[-1:])), pa.int64())
                columns.append(pa.LargeStringArray.from_buffers(
                    len(begin), marks.buffers()[1], pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string()))
                names.append("chunk_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return base.mapInArrow(run, arrow_fields(base, keep) + "chunk int, n_tokens int, start long, end long"
                           + ", chunk_text string" * with_text)


def pack(df: DataFrame, text: str, id_col: str, max_tokens: int = MAX_TOKENS, n_buckets: int = BUCKETS,
         budget: int = BUDGET, with_text: bool = True) -> DataFrame:
    """``id_col`` and the chunk's columns with ``bucket`` (0-based), ``bucket_len``
    (its padded length), ``batch`` (0-based inside the bucket) and ``slot``.

    A batch holds budget // bucket_len chunks (at least one), in the order of
    id (nulls first), chunk and row; only a bucket's last batch may be short.
    Rows that repeat are packed each.  An empty table gives an empty result.
    """
    inner = df.select(F.col(id_col).alias("_doc"), F.monotonically_increasing_id().alias("_row"),
                      F.col(text).alias("_body"))
    rows = cut(chunks(inner, "_body", ["_doc", "_row"], max_tokens, with_text), "chunks")
    histogram = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").toPandas()
    tops = optimal_buckets(histogram["n_tokens"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64), n_buckets)
    bucket, top = F.lit(len(tops) - 1), F.lit(max([1, *tops]))
    for i, length in reversed(list(enumerate(tops))):
        bucket = F.when(F.col("n_tokens") <= length, i).otherwise(bucket)
        top = F.when(F.col("n_tokens") <= length, max(length, 1)).otherwise(top)
    keys = rows.select("_doc", "_row", "chunk", "n_tokens", "start", "end", bucket.alias("bucket"),
                       top.alias("bucket_len"))
    placed = ranked(keys.withColumnsRenamed({"_row": "row"}), ["_doc", "chunk", "row"], {}, "bucket")
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len")))
    placed = (placed.withColumn("batch", F.floor(F.col("_rank") / fit).cast("long"))
              .withColumn("slot", (F.col("_rank") % fit).cast("int")).drop("_rank"))
    if with_text:
        texts = rows.select(F.col("_row").alias("row"), "chunk", "chunk_text")
        placed = placed.join(texts, ["row", "chunk"])
    return placed.withColumnRenamed("_doc", id_col).select(
        id_col, "chunk", "n_tokens", "start", "end", "bucket", "bucket_len", "batch", "slot",
        *["chunk_text"] * with_text)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in 8 buckets, batches of 65,536 tokens."""
    return pack(table(spark, sf_dir, "documents"), "text", "doc_id", with_text=False)
