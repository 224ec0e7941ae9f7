"""Rounds of a fit with words on numbers: tasks lie in blocks, parameters in slices.

A task belongs to one block, a worker or a word to one slice.  The annotations and task
words of a block are written once as numbers (``task``, ``key``): ``key`` numbers the
(worker, label) pairs and words of the block by slice, so what a block and a slice have
in common is one stretch of the block's keys and one list of places in the slice
(``places``, written once, too).  In a round a block sums the scores of its tasks, takes
the posteriors and sends one row of sums to every slice it shares keys with; a slice adds
them up and sends one row of expectations to every block.  So a round sends blocks x
slices rows of numbers, no table passes through the driver, and no task leaves its block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdlens.operators.layout import bucketed, forget
from crowdlens.session import cut

PACKED_ROWS = 1 << 20      # rows of numbers in one written row
CHUNK = 1 << 21            # rows looked at together: bounds what a block needs beside its rows
BLOCK_ROWS = 12_000_000    # rows of a block, about
SLICE_KEYS = 1_000_000     # workers and words of a slice, about
SENT = "block int, slice int, n int, first int, body binary"


def digamma(x: np.ndarray) -> np.ndarray:
    """For x > 0."""
    low = sum(1.0 / (x + i) for i in range(8))
    x = x + 8.0
    inv2 = 1.0 / (x * x)
    return np.log(x) - 0.5 / x - low - inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (
        1 / 252 - inv2 * (1 / 240 - inv2 * (1 / 132)))))


def lgamma(x: np.ndarray) -> np.ndarray:
    """For x > 0."""
    low = np.log(math.prod(x + i for i in range(8)))
    x = x + 8.0
    inv2 = 1.0 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) - low + (
        1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 * (1 / 1680 - inv2 / 1188)))) / x


def _numbers(value: pa.Scalar, kind=np.float64) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _sent(rows: list[dict], schema: pa.Schema) -> pa.Table:
    """One batch a row: a row may be large."""
    return pa.Table.from_batches([pa.RecordBatch.from_pylist([r], schema) for r in rows], schema)


# ----------------------------------------------------------------------
# Written once
# ----------------------------------------------------------------------

class Packed:
    """The numbered inputs: ``rows`` (block, task, key: packed), bucketed by block;
    ``places`` (what blocks and slices share), bucketed by slice; ``tasks`` (block, task, task_id)."""

    def __init__(self, ann: DataFrame, words: DataFrame, c: int, blocks: int, slices: list[int], dealt, hash_rows: int):
        self.c, self.blocks, self.slices = c, blocks, len(slices)
        self.worker_type = ann.schema["worker_id"].dataType
        count = {"rows": F.count(F.lit(1))}

        def hashed(table: DataFrame, rows: int) -> DataFrame:
            return table.hint("shuffle_hash") if rows <= hash_rows * blocks else table

        self.tasks = bucketed(ann.select("block", "task_id").distinct().withColumn(
            "task", F.row_number().over(Window.partitionBy("block").orderBy("task_id")) - 1),
            ["block"], blocks, "tasks", count)
        pairs = ann.select("block", "worker_id", "label").distinct().select(
            "block", dealt(["worker_id"], slices).alias("slice"), "worker_id", "label",
            F.lit(None).cast("bigint").alias("word_idx"))
        terms = words.select("block", "word_idx").distinct().select(
            "block", dealt(["word_idx"], slices).alias("slice"),
            F.lit(None).cast(self.worker_type).alias("worker_id"), F.lit(None).cast("int").alias("label"), "word_idx")
        order = [F.col("slice"), F.col("word_idx").asc_nulls_first(), F.col("worker_id"), F.col("label")]
        keys = bucketed(pairs.unionByName(terms).withColumn(
            "key", F.row_number().over(Window.partitionBy("block").orderBy(*order)) - 1), ["block"], blocks, "keys", count)
        tasks = hashed(self.tasks, self.tasks.observed["rows"])

        def numbered(rows: DataFrame, key: list[str]) -> DataFrame:
            own = hashed(keys.where(F.col(key[0]).isNotNull()).select("block", *key, "key"), keys.observed["rows"])
            return rows.join(tasks, ["block", "task_id"]).join(own, ["block", *key]).select("block", "task", "key")

        rows = numbered(ann, ["worker_id", "label"]).unionByName(numbered(words, ["word_idx"]))
        self.rows = bucketed(rows.mapInArrow(_packing, "block int, n int, task binary, key binary"),
                             ["block"], blocks, "packed", ordered=True)
        kind = self.worker_type.simpleString()
        self.places = bucketed(keys.groupBy("slice").applyInArrow(
            _placing(c), f"slice int, block int, pairs int, at binary, workers array<{kind}>, words binary"),
            ["slice"], self.slices, "places", ordered=True)
        forget(keys)

    def forget(self) -> None:
        for table in (self.rows, self.places, self.tasks):
            forget(table)


def _packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, task, key) as rows of up to about PACKED_ROWS numbers of one block."""
    held: dict[int, list] = {}
    total = 0

    def flush(block: int) -> pa.RecordBatch:
        task, key = (np.concatenate(x).astype(np.int32) for x in zip(*held.pop(block)))
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([len(task)], pa.int32()),
             pa.array([task.tobytes()], pa.binary()), pa.array([key.tobytes()], pa.binary())],
            ["block", "n", "task", "key"])

    for batch in batches:
        block, task, key = (batch.column(x).to_numpy() for x in ("block", "task", "key"))
        for b in np.unique(block).tolist():
            own = block == b
            held.setdefault(b, []).append((task[own], key[own]))
        total += batch.num_rows
        if total >= PACKED_ROWS:
            for b in list(held):
                yield flush(b)
            total = 0
    for b in list(held):
        yield flush(b)


def _placing(c: int):
    """The keys of a slice: its workers and words, and where each block's share of
    them lies in [workers x labels..., words...]."""
    def run(keys: pa.Table) -> pa.Table:
        keys = keys.sort_by([("block", "ascending"), ("key", "ascending")])
        slice_, block = keys["slice"][0].as_py(), keys["block"].to_numpy()
        pair = keys["word_idx"].is_null().to_numpy()
        named = keys.filter(pa.array(pair))
        workers = named["worker_id"].combine_chunks().dictionary_encode()
        words, which = np.unique(keys["word_idx"].filter(pa.array(~pair)).to_numpy().astype(np.int64), return_inverse=True)
        at = np.empty(len(block), np.int32)
        at[pair] = workers.indices.to_numpy() * c + named["label"].to_numpy()
        at[~pair] = len(workers.dictionary) * c + which
        starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        schema = pa.schema([("slice", pa.int32()), ("block", pa.int32()), ("pairs", pa.int32()), ("at", pa.binary()),
                            ("workers", pa.list_(workers.dictionary.type)), ("words", pa.binary())])
        rows = [{"slice": slice_, "workers": workers.dictionary.to_pylist(), "words": words.tobytes()}]
        for a, b in zip(starts, [*starts[1:], len(block)]):
            rows.append({"slice": slice_, "block": int(block[a]), "pairs": int(pair[a:b].sum()), "at": at[a:b].tobytes()})
        return _sent(rows, schema)

    return run


# ----------------------------------------------------------------------
# A round
# ----------------------------------------------------------------------

SENT_SCHEMA = pa.schema([("block", pa.int32()), ("slice", pa.int32()), ("n", pa.int32()), ("first", pa.int32()),
                         ("body", pa.binary())])
STATS = ("entropy", "delta")


def _in_block(c: int, log_kappa: list[float], log_totals: list[float], give_q: bool):
    """(rows of a block, what the slices sent it) -> sums for the slices: E- and M-step.

    A row of the slices holds the expectations of ``n`` keys, pairs first, words from ``first``
    on; rows without slice are the posteriors of the round before from task ``first`` on.
    ``give_q``: the posteriors of this round are sent on in the same way."""
    names = [*[f"k_{t}" for t in range(c)], *STATS]
    schema = pa.schema([*SENT_SCHEMA, *[(x, pa.float64()) for x in names]])

    def run(rows: pa.Table, sent: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        block = rows["block"][0].as_py()
        sent = sent.sort_by([("slice", "ascending"), ("first", "ascending")])
        shares, e, old = [], [], {}
        for i in range(sent.num_rows):
            body, first = _numbers(sent["body"][i]).reshape(-1, c), sent["first"][i].as_py()
            if sent["slice"][i].as_py() is None:
                old[first] = body
                continue
            shares.append((sent["slice"][i].as_py(), len(body)))
            own = body.copy()
            own[first:] -= log_totals
            e.append(own)
        e = np.concatenate(e)

        def chunks():
            held, total = [], 0
            for i in range(rows.num_rows):
                held.append([_numbers(rows[x][i], np.int32) for x in ("task", "key")])
                total += len(held[-1][0])
                if total >= step or i == rows.num_rows - 1:
                    yield [np.concatenate(x) for x in zip(*held)]
                    held, total = [], 0

        size = 1 + max(int(_numbers(x, np.int32).max()) for x in rows["task"])
        step = max(CHUNK, size, len(e))
        q = np.zeros((c, size))
        for task, key in chunks():
            own = e[key]
            for t in range(c):
                q[t] += np.bincount(task, own[:, t], size)
        q += np.array(log_kappa)[:, None]
        q -= q.max(axis=0)
        np.exp(q, out=q)
        q /= q.sum(axis=0)
        positive = q[q > 0]
        stats = {**{f"k_{t}": q[t].sum() for t in range(c)}, "entropy": -(positive * np.log(positive)).sum(), "delta": 0.0}
        del positive
        for first, before in old.items():
            stats["delta"] = max(stats["delta"], float(np.abs(q[:, first:first + len(before)].T - before).max()))
        sums = np.zeros((len(e), c))
        for task, key in chunks():
            for t in range(c):
                sums[:, t] += np.bincount(key, q[t][task], len(e))
        out, at = [], 0
        for s, n in shares:
            out.append({"block": block, "slice": s, "n": n, "body": sums[at:at + n].tobytes()})
            at += n
        if give_q:
            for first in range(0, size, PACKED_ROWS):
                own = np.ascontiguousarray(q[:, first:first + PACKED_ROWS].T)
                out.append({"block": block, "slice": shares[0][0], "n": len(own), "first": first, "body": own.tobytes()})
        out[0] |= {k: float(v) for k, v in stats.items()}
        return _sent(out, schema)

    return run


def _in_slice(c: int, prior: list[list[float]], word_prior: float, whole: bool):
    """(places of a slice, sums of the blocks) -> expectations for the blocks.  ``whole``: the
    parameters themselves, too, as a row without block.  The blocks' totals go with the first row."""
    totals = [f"k_{t}" for t in range(c)]
    names = [*totals, *STATS, *[f"w_{t}" for t in range(c)], "cells", "bound"]
    schema = pa.schema([*SENT_SCHEMA, *[(x, pa.float64()) for x in names]])
    base = np.array(prior).T  # label, class

    def run(places: pa.Table, sent: pa.Table) -> pa.Table:
        of_block = [b is not None for b in places["block"].to_pylist()]
        own = places.filter(pa.array([not x for x in of_block]))
        workers, words = len(own["workers"][0]), len(_numbers(own["words"][0], np.int64))
        at = {b: (_numbers(x, np.int32), n) for b, x, n in zip(
            places["block"].to_pylist(), places["at"], places["pairs"].to_pylist()) if b is not None}
        alpha = np.zeros((workers * c + words, c))
        out = []
        for i in np.argsort(sent["block"].to_numpy(), kind="stable").tolist() if sent.num_rows else ():
            block, body = sent["block"][i].as_py(), sent["body"][i]
            if sent["first"][i].is_valid:  # posteriors, on their way to their block
                out.append({"block": block, "n": sent["n"][i].as_py(), "first": sent["first"][i].as_py(),
                            "body": body.as_py()})
            else:
                alpha[at[block][0]] += _numbers(body).reshape(-1, c)
        slice_ = places["slice"][0].as_py()
        pairs, word = alpha[:workers * c].reshape(workers, c, c), alpha[workers * c:]
        gain = word.sum(axis=0)
        pairs += base
        word += word_prior
        rows = pairs.sum(axis=1, keepdims=True)
        e = digamma(alpha)
        e[:workers * c].reshape(workers, c, c)[:] -= digamma(rows)
        stats = {f"w_{t}": gain[t] for t in range(c)} | {
            "cells": (lgamma(word) - math.lgamma(word_prior)).sum(),
            "bound": (lgamma(pairs) - lgamma(base)).sum() - (lgamma(rows) - lgamma(base.sum(axis=0))).sum()}
        for name in (*totals, "entropy"):
            stats[name] = np.nansum(sent[name].to_numpy()) if sent.num_rows else 0.0
        stats["delta"] = max([x for x in sent["delta"].to_pylist() if x is not None], default=0.0)
        for block, (mine, n) in at.items():
            out.append({"block": block, "slice": slice_, "n": len(mine), "first": n, "body": e[mine].tobytes()})
        if whole:
            out.append({"slice": slice_, "n": len(alpha), "body": alpha.tobytes()})
        out[0] |= {k: float(v) for k, v in stats.items()}
        return _sent(out, schema)

    return run


def _doubles(names) -> str:
    return "".join(f", {x} double" for x in names)


def run_round(packed: Packed, before: DataFrame | None, logs: tuple[list[float], list[float]] | None,
              prior: list[list[float]], word_prior: float, give_q: bool, whole: bool) -> DataFrame:
    """What the slices send to the blocks after a round that starts from ``before`` (None: the
    priors), written; the totals of the round are in ``observed``."""
    c, spark = packed.c, packed.rows.sparkSession
    totals = [*[f"k_{t}" for t in range(c)], *STATS]
    if before is None:
        sums = spark.createDataFrame([], SENT + _doubles(totals))
    else:
        sums = packed.rows.groupBy("block").cogroup(
            before.where("block is not null").repartition(packed.blocks, "block").groupBy("block")).applyInArrow(
            _in_block(c, *logs, give_q), SENT + _doubles(totals))
    names = [*totals, *[f"w_{t}" for t in range(c)], "cells", "bound"]
    out = packed.places.groupBy("slice").cogroup(
        sums.repartition(packed.slices, "slice").groupBy("slice")).applyInArrow(
        _in_slice(c, prior, word_prior, whole), SENT + _doubles(names))
    return cut(out, "sent", {x: (F.max if x == "delta" else F.sum)(x) for x in names}, hidden=names)


def posteriors(packed: Packed, sent: DataFrame) -> DataFrame:
    """``task_id, p_*`` of a round that gave its posteriors."""
    c = packed.c

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q, first = _numbers(batch["body"][i]).reshape(-1, c), batch["first"][i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(q), batch["block"][i].as_py(), np.int32)),
                     pa.array(np.arange(first, first + len(q), dtype=np.int32)), *[pa.array(q[:, t]) for t in range(c)]],
                    ["block", "task", *[f"p_{t}" for t in range(c)]])

    rows = sent.where("slice is null").mapInArrow(run, "block int, task int" + _doubles(f"p_{t}" for t in range(c)))
    return cut(rows.join(packed.tasks, ["block", "task"]).select("task_id", *[f"p_{t}" for t in range(c)]), "q")


def parameters(packed: Packed, sent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The (worker, label) table and the word table of a round that gave them."""
    c = packed.c
    names = [*[f"a_{t}" for t in range(c)], *[f"s_{t}" for t in range(c)]]
    kind = packed.worker_type.simpleString()

    def run(places: pa.Table, rows: pa.Table) -> pa.Table:
        own = places.filter(pa.array([b is None for b in places["block"].to_pylist()]))
        workers, words = own["workers"][0].values, _numbers(own["words"][0], np.int64)
        seen = np.zeros(len(workers) * c, bool)
        for x in places["at"]:
            if x.is_valid:
                at = _numbers(x, np.int32)
                seen[at[at < len(seen)]] = True
        pick = np.flatnonzero(seen)
        alpha = _numbers(rows["body"][0]).reshape(-1, c)
        sums = alpha[:len(seen)].reshape(-1, c, c).sum(axis=1)
        pairs = pa.table([workers.take(pa.array(pick // c)), pa.array((pick % c).astype(np.int32)),
                          pa.nulls(len(pick), pa.int64()), *[pa.array(alpha[pick, t]) for t in range(c)],
                          *[pa.array(sums[pick // c, t]) for t in range(c)]], ["worker_id", "label", "word_idx", *names])
        word = alpha[len(seen):]
        return pa.concat_tables([pairs, pa.table(
            [pa.nulls(len(words), workers.type), pa.nulls(len(words), pa.int32()), pa.array(words),
             *[pa.array(np.ascontiguousarray(word[:, t])) for t in range(c)],
             *[pa.nulls(len(words), pa.float64())] * c], pairs.column_names)])

    both = cut(packed.places.groupBy("slice").cogroup(
        sent.where("block is null").repartition(packed.slices, "slice").groupBy("slice")).applyInArrow(
        run, f"worker_id {kind}, label int, word_idx bigint" + _doubles(names)), "params")
    return (both.where("word_idx is null").drop("word_idx"),
            both.where("word_idx is not null").select("word_idx", *names[:c]))

