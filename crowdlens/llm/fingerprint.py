"""Quartile bucket digests of documents and their bounded difference.

A digest counts the byte triplets of a sliding window in hashed buckets and
keeps, of every bucket, only the quartile of the counts it falls in (two bits),
together with the length on a logarithmic scale, the ratios of the quartiles and
a checksum.  Two digests differ by the sum of their bucket and header distances;
the difference is cut off at ``BOUND``, what unrelated bucket patterns differ by
on average, and the likeness is its complement.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crowdlens.llm.common import arrow_fields, byte_slices, no_clash, table
from crowdlens.llm.words import mix
from crowdlens.session import cut

BUCKETS = 256
WINDOW = 5  # bytes; each triplet has the window's last byte and two of the others
PAIRS = [(i, j) for i in range(WINDOW - 1) for j in range(i + 1, WINDOW - 1)]
HEAD = 3  # bytes before the body: length, quartile ratios, checksum
COST = (0, 1, 2, 6)  # of bucket codes 0 to 3 apart: far codes count more
MAX_LENGTH_STEPS = 16
BOUND = BUCKETS * 26 // 16  # mean cost of two independent codes is 26/16
CHUNK = 1 << 20  # bytes whose triplets are held at once

# byte -> random byte, for each place in the window; the XOR of three of them is
# a tabulation hash of a triplet and its places
TABLES = (mix(np.arange(1, WINDOW * 256 + 1, dtype=np.uint64)) >> np.uint64(40)).astype(
    np.uint8).reshape(WINDOW, 256)
NIBBLE_COST = np.array([[COST[abs(a % 4 - b % 4)] + COST[abs(a // 4 - b // 4)] for b in range(16)]
                        for a in range(16)], dtype=np.int64)


def counts(data: np.ndarray) -> np.ndarray:
    """Triplets of ``data`` (bytes) in each bucket.  One to four bytes are padded
    with zero bytes to one window; no bytes have no triplet.  Long texts are
    counted piece by piece."""
    found = np.zeros(BUCKETS, dtype=np.int64)
    if 0 < len(data) < WINDOW:
        data = np.concatenate((data, np.zeros(WINDOW - len(data), np.uint8)))
    for at in range(0, max(len(data) - WINDOW + 1, 0), CHUNK):
        piece = data[at:at + CHUNK + WINDOW - 1]
        n = len(piece) - WINDOW + 1
        slots = np.empty((len(PAIRS), n), dtype=np.uint8)
        index = piece.astype(np.intp)
        value = [TABLES[i].take(index[i:i + n]) for i in range(WINDOW)]
        for k, (i, j) in enumerate(PAIRS):
            np.bitwise_xor(value[i], value[j], out=slots[k])
        slots ^= value[WINDOW - 1]
        found += np.bincount(slots.ravel(), minlength=BUCKETS)
    return found


def digest(text: str | bytes) -> bytes:
    """The digest of a text's UTF-8 bytes; equal texts have equal digests."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    n = counts(np.frombuffer(raw, dtype=np.uint8))
    q1, q2, q3 = np.sort(n)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]].tolist()
    code = (n > q1).astype(np.uint8) + (n > q2) + (n > q3)
    body = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    length = min(255, round(math.log(len(raw) + 1) / math.log(1.1)))
    ratios = 16 * (15 * q1 // q3) + 15 * q2 // q3 if q3 else 0
    checksum = int((n * (2 * np.arange(BUCKETS) + 1)).sum() % 251)
    return bytes((length, ratios, checksum)) + body.astype(np.uint8).tobytes()


def differences(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bounded differences (0 to ``BOUND``) of the rows of two arrays of digests."""
    a, b = left.astype(np.int64), right.astype(np.int64)
    body = NIBBLE_COST[a[:, HEAD:] & 15, b[:, HEAD:] & 15] + NIBBLE_COST[a[:, HEAD:] >> 4, b[:, HEAD:] >> 4]
    gap = np.abs(a[:, :HEAD] - b[:, :HEAD])
    ratios = np.abs((a[:, 1] & 15) - (b[:, 1] & 15)) + np.abs((a[:, 1] >> 4) - (b[:, 1] >> 4))
    return np.minimum(body.sum(axis=1) + np.minimum(gap[:, 0], MAX_LENGTH_STEPS) + ratios + (gap[:, 2] > 0), BOUND)


def likeness(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """1 for equal digests, 0 for a difference of ``BOUND`` or more."""
    rows = lambda d: np.frombuffer(b"".join(d), dtype=np.uint8).reshape(len(d), -1)
    return 1.0 - differences(rows(left), rows(right)) / BOUND if left else np.zeros(0)


def fingerprints(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``fingerprint`` (hex) of every row's whole text; null
    texts count as empty, repeated rows all stay.  ``keep`` must not hold
    ``fingerprint``.  No exchange."""
    no_clash(keep, "fingerprint _text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "_text"):
            found = [digest(t or "").hex() for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(found, pa.string())], [*keep, "fingerprint"])

    rows = df.select(*keep, F.col(text).alias("_text"))
    return rows.mapInArrow(run, arrow_fields(rows, keep) + "fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of ``text`` (code points, rounded down) replaced by as many
    first ones of ``following``, or all of it."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


@dataclass
class _Doc:
    id: int | None
    text: str
    digest: bytes


def _read(batch: pa.RecordBatch) -> list[_Doc]:
    return [_Doc(i, t or "", digest(t or "")) for i, t in zip(
        batch.column("_id").to_pylist(), batch.column("_text").to_pylist())]


CONTRACT = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double")


def _compared(pairs: list[tuple[_Doc, _Doc]]) -> list[pa.Array]:
    """The contract's columns for documents and the ones that follow them."""
    new = [edited(d.text, n.text).encode("utf-8", "surrogatepass") for d, n in pairs]
    changed = [digest(b) for b in new]
    own = [d.digest for d, _ in pairs]
    return [pa.array([d.id for d, _ in pairs], pa.int64()), pa.array([len(d.text) for d, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(b).hexdigest() for b in new], pa.string()),
            pa.array([b.hex() for b in own], pa.string()), pa.array([b.hex() for b in changed], pa.string()),
            pa.array(likeness(own, changed), pa.float64()),
            pa.array(likeness(own, [n.digest for _, n in pairs]), pa.float64())]


def neighbours(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Each document compared with its edited text and the next document.

    Rows follow one another by ``id_col`` (long; nulls first), rows of one id by a
    hash of their text, then by place in the input; after the last row comes the
    first, so the only row of a table follows itself.  Null texts are empty, an
    empty table gives no rows, other columns are not looked at.

    Texts are dealt by range and sorted once; a task compares the rows of its
    range as they stream by and holds one text besides a slice.  Only the first
    and last row of every range go through a second, small pass that joins each
    last row to the first row of the next range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["_id", "_hash", "_rid"]
    rows = df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"),
                     F.monotonically_increasing_id().alias("_rid"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("_id", "_text")
    names = ["_id", *[c.split()[0] for c in CONTRACT.split(", ")], "_edge", "_range", "_text"]

    def out(columns: list[pa.Array], edge: str | None = None, text: str | None = None) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array([edge] * n, pa.string()),
             pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array([text] * n, pa.string())], names)

    def edge(doc: _Doc, kind: str) -> pa.RecordBatch:
        return out([pa.array([doc.id], pa.int64()),
                    *[pa.nulls(1, t) for t in (pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64())]],
                   kind, doc.text)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in byte_slices(batches, "_text"):
            docs = _read(batch)
            if last is None:
                yield edge(docs[0], "first")
            else:
                docs.insert(0, last)
            if len(docs) > 1:
                yield out(_compared(list(zip(docs, docs[1:]))))
            last = docs[-1]
        if last is not None:
            yield edge(last, "last")

    inner = cut(dealt.mapInArrow(stream, f"_id long, {CONTRACT}, _edge string, _range int, _text string"), "compared")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, next_id, before, after = (c[0].as_py() for c in batch.slice(i, 1).columns)
                yield pa.RecordBatch.from_arrays(
                    _compared([(_Doc(at, before, digest(before)), _Doc(next_id, after, digest(after)))]), names[:-3])

    edges = inner.where("_edge is not null")
    ranges = edges.where("_edge = 'first'").select("_range")  # numbers only, one row a range
    upto = Window.orderBy("_range")
    following = ranges.select("_range", F.coalesce(
        F.lead("_range").over(upto), F.min("_range").over(Window.partitionBy())).alias("_next"))
    firsts = edges.where("_edge = 'first'").select(
        F.col("_range").alias("_next"), F.col("_id").alias("_next_id"), F.col("_text").alias("_after"))
    closed = (edges.where("_edge = 'last'").select("_id", "_range", F.col("_text").alias("_before"))
              .join(following, "_range").join(firsts, "_next")
              .select("_id", "_next_id", "_before", "_after").mapInArrow(close, f"_id long, {CONTRACT}"))
    return (inner.where("_edge is null").select(*names[:-3]).unionByName(closed)
            .withColumnRenamed("_id", id_col))


def op11_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Contract rows for ``documents``."""
    return neighbours(table(spark, sf_dir, "documents"), "doc_id", "text")
