"""Hard negatives from a multiway hyperplane tree with exact leaves.

A tree over a bounded sample deals all vectors to leaves: at every node a vector
goes to the nearest of a few split points (the cells are bounded by hyperplanes).
Of every leaf the distance ranges to the split points on its path are kept, so a
node knows, for each pair of siblings, how near and far the one's vectors are to
the other's split point.  A window of inner products is an annulus around the
anchor: a subtree is left out when the triangle inequality with one of these
ranges puts all of it outside.  What remains is compared exactly.

Inner products are turned into distances by one more coordinate that gives all
vectors the length M of the longest: for an anchor a without it,
``d(a, x)**2 = |a|**2 + M**2 - 2 a.x``.  The sample decides only how much is left
out; every vector is indexed and the results are exact.

Leaves are stored as blocks of about ``BLOCK`` vectors and anchors as packs of
``PACK``; a task compares packs with blocks, so equal vectors, however many, are
just more blocks of one leaf.  To the driver come the sample and a row for each
leaf and split point on its path, both bounded by ``SAMPLE``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crowdlens.llm.common import table
from crowdlens.session import cut

SCALE = 256  # fixed value of the contract: components are compared as floor(256 x)
LIMIT = 1 << 25  # scaled components are cut to this size, so that scores fit 64 bits
SAMPLE = 8192  # vectors that the tree is built from, about (twice as many at most)
WAYS = 8  # split points of a node
BLOCK, PACK = 2048, 256  # vectors of a block, anchors of a pack
GRID_BLOCKS, GRID_PACKS = 16, 64  # blocks and packs that meet under one join key
FREE = 1 << 62  # bound of an open window


# ------------------------------------------------------------------ the tree


@dataclass
class Node:
    points: np.ndarray | None = None  # split points, lifted; None in a leaf
    children: list["Node"] = field(default_factory=list)
    leaf: int = -1
    low: np.ndarray | None = None  # [child, split point]: least distance in the child
    high: np.ndarray | None = None


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None] - 2 * (x @ points.T)
    return np.sqrt(np.maximum(square, 0))


def lift(vectors: np.ndarray, longest: float) -> np.ndarray:
    """``vectors`` with the coordinate that makes all of them as long as the
    longest (``longest``: its squared length)."""
    rest = np.sqrt(np.maximum(longest - (vectors * vectors).sum(axis=1), 0))
    return np.concatenate((vectors, rest[:, None]), axis=1)


def spread(x: np.ndarray, ways: int) -> np.ndarray:
    """Split points far from one another: each the farthest from those before."""
    chosen = [int(distances(x, x.mean(axis=0, keepdims=True))[:, 0].argmax())]
    near = distances(x, x[chosen])[:, 0]
    while len(chosen) < ways and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def build(sample: np.ndarray, rows_each: float, block: int = BLOCK, ways: int = WAYS) -> tuple[Node, int]:
    """A tree over lifted ``sample`` vectors that stand for ``rows_each`` rows
    each, and its number of leaves.  A node is split while it stands for over
    ``block`` rows, has sample vectors enough and not all of them are equal."""
    leaves = 0

    def grow(x: np.ndarray) -> Node:
        nonlocal leaves
        if len(x) * rows_each > block and len(x) >= 2 * ways:
            points = spread(x, ways)
            if len(points) > 1:
                nearest = distances(x, points).argmin(axis=1)
                return Node(points, [grow(x[nearest == i]) for i in range(len(points))])
        leaves += 1
        return Node(leaf=leaves - 1)

    return grow(sample), leaves


def route(tree: Node, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The leaf of each lifted vector and its distances to the split points on
    the path there, level by level."""
    leaf = np.zeros(len(x), dtype=np.int32)
    path: list[np.ndarray] = [np.zeros(0)] * len(x)

    def descend(node: Node, rows: np.ndarray, before: np.ndarray) -> None:
        if node.points is None:
            leaf[rows] = node.leaf
            for at, row in enumerate(rows.tolist()):
                path[row] = before[at]
            return
        d = distances(x[rows], node.points)
        nearest = d.argmin(axis=1)
        held = np.concatenate((before, d), axis=1)
        for i, child in enumerate(node.children):
            inside = nearest == i
            if inside.any():
                descend(child, rows[inside], held[inside])

    descend(tree, np.arange(len(x)), np.zeros((len(x), 0)))
    return leaf, path


def attach(tree: Node, ranges: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
    """Puts the ranges of the leaves (arrays along the path) into the nodes; a
    leaf without rows has an empty range and is never visited."""
    def trimmed(node: Node, depth: int) -> tuple[np.ndarray, np.ndarray]:  # ranges to the points above the node
        if node.points is None:
            low, high = ranges.get(node.leaf, (np.full(depth, np.inf), np.full(depth, -np.inf)))
            return low[:depth], high[:depth]
        wide = depth + len(node.points)
        found = [trimmed(child, wide) for child in node.children]
        low, high = np.array([f[0] for f in found]), np.array([f[1] for f in found])
        node.low, node.high = low[:, depth:], high[:, depth:]
        return low[:, :depth].min(axis=0), high[:, :depth].max(axis=0)

    trimmed(tree, 0)


def survivors(tree: Node, anchors: np.ndarray, near: np.ndarray, far: np.ndarray,
              slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, leaf) pairs that some annulus of the anchor can reach.
    ``anchors``: vectors with a zero for the lifted coordinate; ``near``, ``far``:
    radii, one column for each window (near > far: no window)."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def descend(node: Node, rows: np.ndarray) -> None:
        if node.points is None:
            found.append((rows, np.full(len(rows), node.leaf, dtype=np.int32)))
            return
        d = distances(anchors[rows], node.points)
        for i, child in enumerate(node.children):
            low, high = node.low[i][None], node.high[i][None]
            if not np.isfinite(low).all():  # no rows below
                continue
            least = np.maximum(d - high, low - d).max(axis=1)[:, None] - slack
            most = (d + high).min(axis=1)[:, None] + slack
            a, b = near[rows], far[rows]
            alive = ((a <= b) & (least <= b) & (most >= a)).any(axis=1)
            if alive.any():
                descend(child, rows[alive])

    descend(tree, np.arange(len(anchors)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


# -------------------------------------------------------------- exact leaves


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` highest allowed scores of each row, columns
    counting as ties' order."""
    held = np.where(allowed, scores, -np.inf if scores.dtype.kind == "f" else np.iinfo(np.int64).min)
    if held.shape[1] > k:
        least = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k][:, None]
        allowed = allowed & (held >= least)
    row, column = np.nonzero(allowed)
    order = np.lexsort((column, -held[row, column], row))
    row, column = row[order], column[order]
    starts = np.searchsorted(row, np.arange(len(scores)))
    keep = np.arange(len(row)) - starts[row] < k
    return row[keep], column[keep]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as int64, short ones filled up with zeros."""
    column = column.cast(pa.large_list(pa.int64()))
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    out = np.zeros((len(column), width), dtype=np.int64)
    if len(column):
        spot = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], size)
        out[np.repeat(np.arange(len(column)), size), spot] = values[offsets[0]:offsets[-1]]
    return out


def _unpacked(raw: bytes, store: str, width: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=store).reshape(-1, width) if width else np.zeros((0, 0), store)


# ------------------------------------------------------------------ on Spark


@dataclass
class Index:
    points: DataFrame  # _uid, _id, _label, _vector
    blocks: DataFrame  # _leaf, _block, uids, ids, labels, vectors
    tree: Node
    width: int
    longest: int  # largest squared length
    store: str  # numpy type of stored components
    exact: str  # numpy type in which all scores are exact
    leaf_rows: dict[int, int]


POINTS = "_uid long, _id long, _label long, _vector array<int>"


def valid_points(df: DataFrame, id_col: str, vector: str, label: Column) -> DataFrame:
    """The rows that take part: label and vector there, all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    scaled = F.transform(vector, lambda x: F.least(F.lit(LIMIT), F.greatest(F.lit(-LIMIT), F.floor(
        F.lit(float(SCALE)) * x.cast("double")))).cast("int"))
    return (df.select(F.col(id_col).alias("_id"), label.cast("long").alias("_label"), F.col(vector).alias(vector))
            .where(F.col("_label").isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False)))
            .select(F.monotonically_increasing_id().alias("_uid"), F.col("_id").cast("long").alias("_id"),
                    "_label", scaled.alias("_vector")))


def index(points: DataFrame, sample: int = SAMPLE, block: int = BLOCK, ways: int = WAYS) -> Index | None:
    """All ``points`` (a written table) in the leaves of a tree; None without rows."""
    size = F.aggregate("_vector", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    n, width, longest = points.agg(F.count(F.lit(1)), F.max(F.size("_vector")), F.max(size)).first()
    if not n:
        return None
    part = points.select("_vector") if n <= sample else points.where(
        F.rand(7) < F.lit(sample / n)).select("_vector").limit(2 * sample)
    chosen = matrix(part.toArrow().column(0).combine_chunks(), width)
    tree, leaves = build(lift(chosen.astype(np.float64), longest), n / max(len(chosen), 1), block, ways)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf, path = route(tree, lift(matrix(batch.column("_vector"), width).astype(np.float64), longest))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(leaf, pa.int32()), pa.array(path, pa.list_(pa.float64()))],
                    [*batch.schema.names, "_leaf", "_path"])

    dealt = cut(points.mapInArrow(deal, f"{POINTS}, _leaf int, _path array<double>"), "dealt")
    # at most a row for each leaf and split point on its path: bounded by the sample
    stats = dealt.select("_leaf", F.posexplode("_path").alias("at", "d")).groupBy("_leaf", "at").agg(
        F.min("d").alias("low"), F.max("d").alias("high")).collect()
    sizes = {r["_leaf"]: r["n"] for r in dealt.groupBy("_leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranges = {}
    for leaf in sizes:
        own = sorted((r["at"], r["low"], r["high"]) for r in stats if r["_leaf"] == leaf)
        ranges[leaf] = np.array([r[1] for r in own]), np.array([r[2] for r in own])
    attach(tree, ranges)

    store = "int16" if longest < 1 << 30 else "int32"

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_id", "ascending")])
        vectors = matrix(rows.column("_vector").combine_chunks(), width)
        return pa.table({"_leaf": rows.column("_leaf")[:1], "_block": rows.column("_block")[:1],
                         **{name: pa.array([rows.column(c).to_pylist()], pa.list_(pa.int64()))
                            for name, c in (("uids", "_uid"), ("ids", "_id"), ("labels", "_label"))},
                         "vectors": pa.array([vectors.astype(store).tobytes()], pa.binary())})

    per_leaf = _lookup({leaf: -(-rows // block) for leaf, rows in sizes.items()})
    blocks = (dealt.withColumn("_block", F.pmod(F.xxhash64("_uid"), per_leaf).cast("int"))
              .drop("_path").groupBy("_leaf", "_block")  # about `block` rows a group, whatever the leaf holds
              .applyInArrow(pack, "_leaf int, _block int, uids array<long>, ids array<long>, "
                                  "labels array<long>, vectors binary"))
    # by Cauchy and Schwarz no score is larger than the longest square
    return Index(points, cut(blocks, "blocks"), tree, width, longest, store,
                 "float64" if longest < 1 << 52 else "int64", sizes)


def _lookup(values: dict[int, int]) -> Column:
    """The value of ``_leaf`` in a table of leaves, 1 at least."""
    return F.element_at(F.array(*[F.lit(max(values.get(i, 1), 1)) for i in range(max(values) + 1)]),
                        F.col("_leaf") + 1)


HIT = "_uid long, _window int, _score long, _hit_id long, _hit_uid long"


def search(idx: Index, anchors: DataFrame, k: int, same_label: bool, home: bool = False) -> DataFrame:
    """The ``k`` best hits of every window of ``anchors``, with ``_rank`` from 1.

    ``anchors`` have the columns of points, ``_lows`` and ``_highs`` (bounds of the
    windows, inclusive).  ``home`` looks only at one block of the leaf that the
    anchor lies in: a cheap bound for the whole search.
    """
    tree, width, longest, store, exact = idx.tree, idx.width, idx.longest, idx.store, idx.exact
    slack = 1e-6 * (longest ** 0.5) + 1e-3

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column("_vector"), width).astype(np.float64)
            if home:
                leaf, _ = route(tree, lift(vectors, longest))
                row = np.arange(batch.num_rows)
            else:
                windows = max(len(w) for w in batch.column("_lows").to_pylist())
                low, high = (matrix(batch.column(c), windows).astype(np.float64) for c in ("_lows", "_highs"))
                none = np.arange(windows)[None] >= np.array([len(w) for w in batch.column("_lows").to_pylist()])[:, None]
                square = (vectors * vectors).sum(axis=1)[:, None] + longest
                near = np.where(none, np.inf, np.sqrt(np.maximum(square - 2 * high, 0)))
                far = np.where(none, -np.inf, np.sqrt(np.maximum(square - 2 * low, -1).clip(min=0)))
                row, leaf = survivors(tree, np.concatenate((vectors, np.zeros((len(vectors), 1))), axis=1),
                                      near, far, slack)
            picked = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(leaf, pa.int32())],
                                             [*picked.schema.names, "_leaf"])

    fields = f"{POINTS}, _lows array<long>, _highs array<long>"
    names = ["_uid", "_id", "_label", "_vector", "_lows", "_highs"]
    visit = cut(anchors.select(*names).mapInArrow(visits, f"{fields}, _leaf int"), "visits")
    counts = {r["_leaf"]: r["n"] for r in visit.groupBy("_leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return idx.blocks.sparkSession.createDataFrame([], HIT + ", _rank int")
    packs_of = {leaf: -(-n // PACK) for leaf, n in counts.items()}
    blocks_of = {leaf: -(-idx.leaf_rows.get(leaf, 0) // BLOCK) for leaf in counts}

    def pack(rows: pa.Table) -> pa.Table:
        return pa.table({"_leaf": rows.column("_leaf")[:1], "_pack": rows.column("_pack")[:1],
                         "vectors": pa.array([matrix(rows.column("_vector").combine_chunks(), width)
                                              .astype(store).tobytes()], pa.binary()),
                         **{c: pa.array([rows.column(c).to_pylist()]) for c in ("_uid", "_label")},
                         **{c: pa.array([rows.column(c).to_pylist()], pa.list_(pa.list_(pa.int64())))
                            for c in ("_lows", "_highs")}})

    packs = (visit.withColumn("_pack", F.pmod(F.xxhash64("_uid"), _lookup(packs_of)).cast("int"))
             .groupBy("_leaf", "_pack")
             .applyInArrow(pack, "_leaf int, _pack int, vectors binary, _uid array<long>, _label array<long>, "
                                 "_lows array<array<long>>, _highs array<array<long>>"))
    # blocks and packs of a leaf meet in cells of a grid, so that no join key is large
    cells = lambda of, per: F.explode(F.sequence(
        F.lit(0), F.floor((_lookup(of) - 1) / per).cast("int")))
    left = packs.withColumn("_down", F.floor(F.col("_pack") / GRID_PACKS).cast("int")).withColumn(
        "_across", F.lit(0) if home else cells(blocks_of, GRID_BLOCKS))
    right = idx.blocks.where(F.col("_leaf").isin(list(counts)))
    right = (right.where("_block = 0") if home else right).withColumn(
        "_across", F.floor(F.col("_block") / GRID_BLOCKS).cast("int")).withColumn("_down", cells(packs_of, GRID_PACKS))
    pairs = left.select("_leaf", "_across", "_down", F.col("vectors").alias("_vectors"), "_uid", "_label", "_lows",
                        "_highs").join(right, ["_leaf", "_across", "_down"]).select(
        "_vectors", "_uid", "_label", "_lows", "_highs", "uids", "ids", "labels", "vectors")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _compare(batch.slice(i, 1), width, store, exact, k, same_label)

    hits = pairs.mapInArrow(compare, HIT)
    order = Window.partitionBy("_uid", "_window").orderBy(F.desc("_score"), F.asc_nulls_last("_hit_id"), "_hit_uid")
    return cut(hits.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k), "hits")


def _compare(row: pa.RecordBatch, width: int, store: str, exact: str, k: int, same_label: bool) -> Iterator[pa.RecordBatch]:
    """Hits of one pack of anchors in one block."""
    value = lambda c: row.column(c)[0]
    own, theirs = (_unpacked(value(c).as_py(), store, width).astype(exact) for c in ("_vectors", "vectors"))
    uid, label, uids, labels = (np.array(value(c).as_py(), dtype=np.int64) for c in (
        "_uid", "_label", "uids", "labels"))
    if not width:  # vectors without components: all products are zero
        own, theirs = np.zeros((len(uid), 1), exact), np.zeros((len(uids), 1), exact)
    ids = value("ids").values
    scores = own @ theirs.T
    fits = (label[:, None] == labels[None]) if same_label else (label[:, None] != labels[None])
    fits &= uid[:, None] != uids[None]
    lows, highs = value("_lows").as_py(), value("_highs").as_py()
    for window in range(max(map(len, lows))):
        bound = lambda held, none: np.array(
            [w[window] if len(w) > window else none for w in held], dtype=np.int64)[:, None]
        allowed = fits & (scores >= bound(lows, FREE)) & (scores <= bound(highs, -FREE))
        if allowed.any():
            at, hit = best(scores, allowed, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid[at]), pa.array(np.full(len(at), window, np.int32)),
                 pa.array(scores[at, hit].astype(np.int64)), ids.take(pa.array(hit)), pa.array(uids[hit])],
                [f.split()[0] for f in HIT.split(", ")])


def narrowed(idx: Index, anchors: DataFrame, k: int, same_label: bool) -> DataFrame:
    """``anchors`` with the lower bounds of their windows raised to the ``k``-th best
    score found near them: what lies below cannot be among the ``k`` best."""
    found = search(idx, anchors, k, same_label, home=True).where(F.col("_rank") == k).select(
        "_uid", F.struct("_window", "_score").alias("w")).groupBy("_uid").agg(
        F.map_from_entries(F.collect_list("w")).alias("_found"))  # a window's length
    raised = F.when(F.col("_found").isNull(), F.col("_lows")).otherwise(
        F.transform("_lows", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("_found", i), x))))
    return anchors.join(found, "_uid", "left").withColumn("_lows", raised).drop("_found")


def hard_negatives(idx: Index, anchors: DataFrame, n_positives: int, n_negatives: int,
                   window: tuple[int, int]) -> DataFrame:
    """Negatives of every anchor (rows of ``idx.points``) and positive.

    Positives are the best other rows of the anchor's label, negatives the best
    rows of other labels whose score lies between the two percentages of the
    positive's (inclusive).  Ties go to the smaller id, null ids last.  Rows with
    equal ids are rows of their own; a row is not its own positive.
    """
    low, high = window
    open_window = anchors.withColumns({"_lows": F.array(F.lit(-FREE)), "_highs": F.array(F.lit(FREE))})
    start = cut(narrowed(idx, open_window, n_positives, True), "anchors")
    positives = cut(search(idx, start, n_positives, True), "positives")
    least = F.expr(f"({low} * _score) div 100 + if({low} * _score > 0 and {low} * _score % 100 <> 0, 1, 0)")  # ceil
    most = F.expr(f"({high} * _score) div 100 - if({high} * _score < 0 and {high} * _score % 100 <> 0, 1, 0)")  # floor
    listed = positives.groupBy("_uid").agg(F.array_sort(F.collect_list(F.struct(
        F.col("_rank").alias("at"), least.alias("low"), most.alias("high")))).alias("w"))  # at most n_positives
    aimed = anchors.join(listed, "_uid").withColumns(
        {"_lows": F.transform("w", lambda x: x["low"]), "_highs": F.transform("w", lambda x: x["high"])}).drop("w")
    aimed = cut(aimed, "aimed")
    found = search(idx, cut(narrowed(idx, aimed, n_negatives, False), "aimed"), n_negatives, False)
    named = positives.join(anchors.select("_uid", F.col("_id").alias("_anchor")), "_uid").select(
        "_uid", (F.col("_rank") - 1).alias("_window"), "_anchor", F.col("_hit_id").alias("_positive"),
        F.col("_score").alias("_positive_score"))
    return found.join(named, ["_uid", "_window"]).select(
        F.col("_anchor").alias("anchor_id"), F.col("_positive").alias("positive_id"), F.col("_rank").alias("rank"),
        F.col("_hit_id").alias("negative_id"), F.col("_positive_score").alias("positive_score"),
        F.col("_score").alias("negative_score"))


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(df: DataFrame, sample: int = SAMPLE, block: int = BLOCK, ways: int = WAYS) -> DataFrame:
    """Contract rows for a table with ``vec_id``, ``embedding`` and ``label``; other
    columns are not looked at.  Rows without label or vector or with a component
    that is null or not finite take no part; short vectors are filled up with
    zeros; an empty table gives no rows."""
    given = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (given + 1) % 10).otherwise(given)
    points = cut(valid_points(df, "vec_id", "embedding", label), "points")
    idx = index(points, sample, block, ways)
    if idx is None:
        return df.sparkSession.createDataFrame([], RESULT)
    anchors = cut(points.where(F.col("_id") % 100 == 0), "anchors")
    return hard_negatives(idx, anchors, 5, 10, (30, 90))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Contract rows for all of ``embeddings``."""
    return mine(table(spark, sf_dir, "embeddings"))


ORACLE_OP12 = r"""
WITH p AS (SELECT row_number() OVER () AS uid, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.uid, a.vec_id AS anchor_id, a.label AS own, x.uid AS hit, x.vec_id, x.label,
    list_dot_product(a.v, x.v)::BIGINT AS score FROM p a, p x WHERE a.vec_id % 100 = 0 AND x.uid <> a.uid),
g AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id, hit) AS r FROM s WHERE label = own),
n AS (SELECT s.anchor_id, g.vec_id AS positive_id, row_number() OVER (
      PARTITION BY g.uid, g.r ORDER BY s.score DESC, s.vec_id, s.hit)::INT AS rank,
    s.vec_id AS negative_id, g.score AS positive_score, s.score AS negative_score
  FROM g JOIN s ON s.uid = g.uid AND s.label <> s.own AND 30 * g.score <= 100 * s.score AND 100 * s.score <= 90 * g.score
  WHERE g.r <= 5)
SELECT * FROM n WHERE rank <= 10
"""
