"""The arithmetic of one round of the fit inside one block of tasks.

Spark deals the annotations and task words to blocks once, deals the parameters of a
block's keys to it every round and adds up what the blocks give.  A block is a grouped
map over two tables: rows of numbers (``task``, ``key``) and the parameters of its
keys.  ``key`` numbers the (worker, label) pairs of the block from 0 in their order and
its words from -1 downwards in theirs, so that it is an index of [pairs..., reversed words...].
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 21  # rows looked at together: bounds what a block needs beside its rows


def block_round(c: int, now: tuple[list[float], list[float]], before: tuple[list[float], list[float]] | None,
                calm: float):
    """A function (rows, parameters) -> sums of the posteriors by key: E- and M-step of a block.

    ``now``: E ln kappa and the digamma of the word totals.  ``before``: those of the
    round before, whose parameters (``old``) then tell how far each posterior moved.
    The first row carries the block's totals ``k_*``, entropy, largest move, tasks that
    moved less than ``calm``, and tasks."""
    def run(rows: pa.Table, params: pa.Table) -> pa.Table:
        size = 1 + (pc.max(rows["task"]).as_py() if rows.num_rows else -1)
        step = max(CHUNK, size, params.num_rows)

        def chunks(*names):
            for at in range(0, rows.num_rows, step):
                yield [rows[x].slice(at, step).to_numpy().astype(np.int64) for x in names]

        def parameters(old: bool) -> tuple[pa.Table, pa.Table]:
            own = params.filter(pc.equal(params["old"], old))
            word = pc.is_valid(own["word_idx"])
            return (own.filter(pc.invert(word)).sort_by([("worker_id", "ascending"), ("label", "ascending")]),
                    own.filter(word).sort_by("word_idx"))

        there, fixed = np.zeros(size, bool), None
        for (task,) in chunks("task"):
            there[task] = True
        if "fixed" in rows.column_names:  # class of the task, c: none of them, -1: to be estimated
            fixed = np.full(size, -1)
            for task, given in chunks("task", "fixed"):
                fixed[task] = given

        def posterior(pairs: pa.Table, words: pa.Table, logs: tuple[list[float], list[float]]) -> np.ndarray:
            q = np.zeros((c, size))
            e = [np.concatenate([pairs[f"e_{t}"].to_numpy(), (words[f"e_{t}"].to_numpy() - logs[1][t])[::-1]])
                 for t in range(c)]
            for task, key in chunks("task", "key"):
                for t in range(c):
                    q[t] += np.bincount(task, e[t][key], size)
            q += np.array(logs[0])[:, None]
            q -= q.max(axis=0)
            np.exp(q, out=q)
            q /= q.sum(axis=0)
            if fixed is not None:
                q[:, fixed >= 0] = 0.0
                for t in range(c):
                    q[t, fixed == t] = 1.0
            q[:, ~there] = 0.0
            return q

        pairs, words = parameters(False)
        n = pairs.num_rows + words.num_rows
        q = posterior(pairs, words, now)
        positive = q[q > 0]
        stats = {**{f"k_{t}": q[t].sum() for t in range(c)}, "entropy": -(positive * np.log(positive)).sum(),
                 "delta": 0.0, "calm": 0.0, "tasks": there.sum()}
        del positive
        if before is not None and size:
            moved = np.abs(q - posterior(*parameters(True), before)).max(axis=0)
            stats |= {"delta": moved.max(), "calm": (there & (moved < calm)).sum()}
        sums = np.zeros((c, n))
        for task, key in chunks("task", "key"):
            key[key < 0] += n
            for t in range(c):
                sums[t] += np.bincount(key, q[t][task], n)
        names = ["worker_id", "label", "word_idx", "block"]
        out = pa.concat_tables([pairs.select(names), words.select(names)])
        first = np.arange(n) == 0
        for t in range(c):
            own = sums[t]
            out = out.append_column(f"p_{t}", pa.array(np.concatenate([own[:pairs.num_rows], own[pairs.num_rows:][::-1]])))
        for name, value in stats.items():
            out = out.append_column(name, pa.array(np.where(first, float(value), 0.0)))
        return out

    return run
