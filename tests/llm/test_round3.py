"""Fingerprints, hard negatives and the filter audit against brute force."""

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdlens.llm import filter_audit, fingerprint, hard_negatives

LONG = "déjà vu #1 " * 30_000


# ------------------------------------------------------------ 11 fingerprints


def plain_digest(text):
    """Triplet by triplet."""
    raw = text.encode()
    raw += bytes(5 - len(raw)) if 0 < len(raw) < 5 else b""
    n = [0] * fingerprint.BUCKETS
    for at in range(len(raw) - 4):
        for i in range(4):
            for j in range(i + 1, 4):
                t = fingerprint.TABLES
                n[t[i][raw[at + i]] ^ t[j][raw[at + j]] ^ t[4][raw[at + 4]]] += 1
    ordered = sorted(n)
    q1, q2, q3 = ordered[63], ordered[127], ordered[191]
    codes = [(c > q1) + (c > q2) + (c > q3) for c in n]
    head = [min(255, round(math.log(len(text.encode()) + 1) / math.log(1.1))),
            16 * (15 * q1 // q3) + 15 * q2 // q3 if q3 else 0, sum(c * (2 * b + 1) for b, c in enumerate(n)) % 251]
    return head, codes


def plain_likeness(a, b):
    (ha, ca), (hb, cb) = plain_digest(a), plain_digest(b)
    diff = sum((0, 1, 2, 6)[abs(x - y)] for x, y in zip(ca, cb)) + min(abs(ha[0] - hb[0]), 16) + (ha[2] != hb[2])
    diff += abs(ha[1] // 16 - hb[1] // 16) + abs(ha[1] % 16 - hb[1] % 16)
    return 1 - min(diff, 416) / 416


def hexed(text):
    head, codes = plain_digest(text)
    body = [codes[i] + 4 * codes[i + 1] + 16 * codes[i + 2] + 64 * codes[i + 3] for i in range(0, 256, 4)]
    return bytes(head + body).hex()


def test_neighbours_equal_brute_force(spark):
    rnd = random.Random(1)
    texts = ["", None, "a", "ab", "ééé", "x" * 40, "same text here", "same text here", "line\none\r\n\x00 two"]
    texts += [" ".join(rnd.choice(("alpha", "bêta", "γάμμα", "delta")) for _ in range(rnd.randrange(60))) for _ in range(50)]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, _range int").repartition(5)
    got = {r.doc_id: r for r in fingerprint.neighbours(df, "doc_id", "text").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, n, r = t or "", texts[(i + 1) % len(texts)] or "", got[i]
        half = len(t) // 2
        e = t[:len(t) - half] + n[:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (hexed(t), hexed(e))
        assert r.near_edited == pytest.approx(plain_likeness(t, e)) and r.near_next == pytest.approx(plain_likeness(t, n))


def test_neighbours_with_repeated_and_null_ids_one_row_and_none(spark):
    schema = "doc_id long, text string"
    one = fingerprint.neighbours(spark.createDataFrame([(7, "only text")], schema), "doc_id", "text").collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(7, 1.0)]
    assert fingerprint.neighbours(spark.createDataFrame([], schema), "doc_id", "text").collect() == []
    rows = [(3, "hot text")] * 40 + [(None, "first"), (9, "last")]
    got = fingerprint.neighbours(spark.createDataFrame(rows, schema).repartition(6), "doc_id", "text").collect()
    by = lambda i: [r for r in got if r.doc_id == i]
    assert (len(by(3)), len(by(None)), len(by(9))) == (40, 1, 1)
    assert sum(r.near_next == 1.0 for r in by(3)) == 39  # each follows an equal row but the last
    assert by(None)[0].edited_sha256 == hashlib.sha256(b"firho").hexdigest()
    assert by(9)[0].edited_sha256 == hashlib.sha256(b"lafi").hexdigest()  # wraps round to the first


def test_fingerprints_of_very_long_texts_and_chunks(spark):
    assert fingerprint.digest(LONG).hex() == hexed(LONG)
    data = np.frombuffer(LONG.encode(), np.uint8)
    whole = fingerprint.counts(data)
    fingerprint.CHUNK, held = 1000, fingerprint.CHUNK
    try:
        assert (fingerprint.counts(data) == whole).all()
    finally:
        fingerprint.CHUNK = held
    df = spark.createDataFrame([(1, LONG, "k"), (2, None, "k")], "doc_id long, text string, _id string")
    got = {r.doc_id: r for r in fingerprint.fingerprints(df, "text", ["doc_id", "_id"]).collect()}
    assert got[1].fingerprint == hexed(LONG) and got[2].fingerprint == hexed("")


def test_likeness_is_bounded_and_orders_edits():
    rnd = random.Random(2)
    words = [rnd.choice("abcdefgh") * 3 + str(rnd.randrange(50)) for _ in range(300)]
    a, b = " ".join(words[:150]), " ".join(reversed(words[150:]))
    like = lambda x, y: float(fingerprint.likeness([fingerprint.digest(x)], [fingerprint.digest(y)])[0])
    assert like(a, a) == 1 and 0 <= like(a, b) < like(a, fingerprint.edited(a, b)) < 1
    assert like("", a) >= 0


# --------------------------------------------------------- 12 hard negatives


def plain_negatives(rows):
    points = []
    for i, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        points.append((i, [math.floor(256 * x) for x in vector], label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for n, (i, v, label) in enumerate(points):
        if i is None or i % 100:
            continue
        scored = [(dot(v, w), j, other) for m, (j, w, other) in enumerate(points) if m != n]
        for score, j, _ in sorted((s for s in scored if s[2] == label), key=key)[:5]:
            fits = [s for s in scored if s[2] != label and 30 * score <= 100 * s[0] <= 90 * score]
            out += [(i, j, r + 1, s[1], score, s[0]) for r, s in enumerate(sorted(fits, key=key)[:10])]
    return sorted(out, key=str)


VECTORS = "vec_id long, embedding array<float>, label int, _uid string, _leaf int"


@pytest.mark.parametrize("block, ways", [(20, 3), (64, 4), (4096, 8)])
def test_negatives_equal_brute_force(spark, block, ways):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(8, 6))
    rows = []
    for i in range(420):
        v = (centres[i % 8] + rnd.normal(size=6) * 0.4) / 4
        if i % 3 == 0:
            v = centres[0] / 4  # a third of all rows are equal: ties
        rows.append((i if i % 50 else i * 2, [float(np.float32(x)) for x in v], i % 5))
    rows += [(100, rows[100][1], 1), (None, rows[3][1], 2), (901, None, 1), (902, rows[5][1], None),
             (903, [float("nan")] * 6, 1), (904, [None] + [0.1] * 5, 1), (905, [float("inf")] + [0.1] * 5, 2),
             (1000, rows[1][1][:4], 3), (906, [], 1), (1100, [0.0] * 6, 0)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], VECTORS).repartition(3)
    got = [tuple(r) for r in hard_negatives.mine(df, sample=200, block=block, ways=ways).collect()]
    assert sorted(got, key=str) == plain_negatives(rows)
    assert len(got) > 100


def test_negatives_of_an_empty_table_and_of_one_row(spark):
    for rows in ([], [(0, [0.5, 0.5], 1, "k", 1)]):
        df = hard_negatives.mine(spark.createDataFrame(rows, VECTORS))
        assert df.collect() == [] and df.columns == [f.split()[0] for f in hard_negatives.RESULT.split(", ")]


def test_large_components_stay_exact(spark):
    rows = [(i, [float(i % 13) * 3000, float(i % 7) * -9000, 1e12 if i == 5 else 4.0], i % 3) for i in range(210)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], VECTORS)
    got = [tuple(r) for r in hard_negatives.mine(df, block=32, ways=3).collect()]
    capped = [(i, [min(x, hard_negatives.LIMIT / 256) for x in v], label) for i, v, label in rows]
    assert sorted(got, key=str) == plain_negatives(capped)


def test_pruning_loses_nothing_and_leaves_out_subtrees():
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(12, 4)) * 50
    x = np.floor(centres[rnd.integers(0, 12, 3000)] + rnd.normal(size=(3000, 4)))
    longest = float((x * x).sum(axis=1).max())
    lifted = hard_negatives.lift(x, longest)
    tree, leaves = hard_negatives.build(lifted[:500], 6, 100, 4)
    leaf, path = hard_negatives.route(tree, lifted)
    hard_negatives.attach(tree, {n: (np.min([path[i] for i in np.flatnonzero(leaf == n)], axis=0),
                                     np.max([path[i] for i in np.flatnonzero(leaf == n)], axis=0))
                                 for n in range(leaves) if (leaf == n).any()})
    anchors = x[:40]
    scores = anchors @ x.T
    high = scores.max(axis=1)
    low = 0.95 * high
    square = (anchors * anchors).sum(axis=1) + longest
    radii = [np.sqrt(np.maximum(square - 2 * s, 0))[:, None] for s in (high, low)]
    row, kept = hard_negatives.survivors(tree, np.concatenate((anchors, np.zeros((40, 1))), axis=1), *radii, 1e-3)
    found = set(zip(row.tolist(), kept.tolist()))
    needed = {(a, int(leaf[b])) for a, b in zip(*np.nonzero((scores <= high[:, None]) & (scores >= low[:, None])))}
    assert needed <= found and len(found) < 0.5 * 40 * leaves


# ----------------------------------------------------------- 13 filter audit


def plain_audit(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    rows = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": i is not None and least[t] < i}
        own = [x for x in labels if x[0] is not None and x[0] == i]
        rows.append((s or "", {f for f in fails if fails[f]}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in alive if f in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(alive) - len(gone), len(gone), sum(f in r[1] for r in mine) - len(gone),
                    sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                alive = [r for r in alive if f not in r[1]]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def audited(spark, docs, labels):
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, source string, _uid int, _mask string")
    lab = spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int, _good int")
    got = filter_audit.audit(df.repartition(3), filter_audit.word_filters(), lab, "doc_id", "text", "source", "E")
    return {(r.part, r.filter_order, r.step): list(r)[3:] for r in got.collect()}


def test_audit_equals_brute_force(spark):
    rnd = random.Random(4)
    texts = [None, "", " \t\n", "A B C", "x # y", LONG, " ".join(["nbsp"] * 60), "ÀÉ" * 40]
    for n in (10, 49, 50, 51, 80):
        texts += [" ".join(f"w{rnd.randrange(m)}" for _ in range(n)) + tail for m in (20, 500) for tail in ("", " &", " ABCDEFGHIJKLMNOP" * 4)]
    docs = [(rnd.choice([None, *range(60)]), rnd.choice(texts), rnd.choice(["s1", "s2", "", None])) for _ in range(150)]
    docs += [(7, texts[8], "s1")] * 80  # one id and text hold a third of all rows
    labels = [(rnd.choice([None, *range(70)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(60)]
    labels += [(7, 1, 0), (7, 0, 1), (7, 1, 0)]
    got = audited(spark, docs, labels)
    assert got == plain_audit(docs, labels)
    assert len(got) == 3 * 600


def test_audit_of_empty_tables_and_clean_documents(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    clean = " ".join(f"word{i}" for i in range(60))
    got = audited(spark, [(1, clean, "s")], [])
    assert len(got) == 600 and set(map(tuple, got.values())) == {(1, 0, 0, 0, 0, 0, 0)}


def test_audit_rejects_clashing_filter_names(spark):
    df = spark.createDataFrame([(1, "t", "s")], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        filter_audit.audit(df, {"A": F.lit(True)}, df, "doc_id", "text", "source", duplicate="A")
