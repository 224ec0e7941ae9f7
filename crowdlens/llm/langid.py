"""Language identification: script ranges, then Viterbi over per-word scores.

A model holds, for each learned language, log probabilities of hashed byte
4-grams (word edges included) and the share of each script.  A word's script
narrows the candidate languages; each candidate gets the word's summed log
probability; a Viterbi path with a penalty for each switch labels the words, so
mixed texts split into spans.  The document's language is the one with the most
letters on the path.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdlens.llm.common import arrow_fields, byte_slices, no_clash, table
from crowdlens.llm.words import U, joined_bytes, mix
from crowdlens.session import cut

UNKNOWN = "und"
BITS = 15  # hashed n-gram features
TRAIN_DOCS = 20_000  # bound of the training sample (documents, by language and hash of the id)
MAX_LANGUAGES = 256  # most languages of a model: 256 x 2**15 numbers go to every task
SWITCH = 12.0  # penalty of a change of language, in log probability
SMOOTH = 0.5
MIN_SHARE = 0.005  # a script is a candidate for a language from this share of its words
# First code point of a range and its script.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "other"),
)
NAMES = sorted({s for _, s in SCRIPTS})
BOUNDS = np.array([b for b, _ in SCRIPTS])
SCRIPT_OF = np.array([NAMES.index(s) for _, s in SCRIPTS])
WORD = r"[A-Za-z]|[^\x00-\x7F]"  # a text with a word
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


@dataclass
class Batch:
    text_of: np.ndarray  # text of each word
    first: np.ndarray  # first word of each text, n + 1
    size: np.ndarray  # code points of each word
    script: np.ndarray
    gram: np.ndarray  # hashed feature of each byte of the lower-cased text
    start: np.ndarray  # byte range of each word in ``gram``
    end: np.ndarray


def words_of(column: pa.Array) -> Batch:
    """Words (runs of ASCII letters and non-ASCII characters) of a batch of texts."""
    low = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    data, offsets = joined_bytes(low)
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    inside = LETTER[data]
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    # 4 bytes that end at each byte; what lies before the word reads as a space
    code, spot = data.astype(np.uint32), np.arange(n)
    opened = np.zeros(n, np.int64)
    opened[start] = start
    depth = spot - np.maximum.accumulate(opened) if n else spot
    gram = code.copy()
    for back in (1, 2, 3):
        gram |= np.where(depth >= back, code[np.maximum(spot - back, 0)], np.uint32(32)) << np.uint32(8 * back)
    feature = (mix(gram.astype(U)) >> U(64 - BITS)).astype(np.int32)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    lead = data[start].astype(np.int64) if n else np.zeros(0, np.int64)
    pad = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int64) & 0x3F
    point = np.where(lead < 0x80, lead, np.where(
        lead < 0xE0, (lead & 0x1F) << 6 | pad[start + 1], np.where(
            lead < 0xF0, (lead & 0x0F) << 12 | pad[start + 1] << 6 | pad[start + 2], 0x20000)))
    script = SCRIPT_OF[np.searchsorted(BOUNDS, point, "right") - 1]
    first = np.searchsorted(start, offsets)
    return Batch(np.repeat(np.arange(len(column)), np.diff(first)), first, chars[end] - chars[start],
                 script, feature, start, end)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # (features, languages) log probabilities
    scripts: np.ndarray  # (scripts, languages) candidates

    def words(self, b: Batch) -> np.ndarray:
        """(words, languages) scores; -inf where the script rules a language out
        (a script of no language rules none out)."""
        out = np.empty((len(b.start), len(self.languages)), dtype=np.float64)
        inside = np.zeros(len(b.gram) + 1, dtype=np.float64)
        for k in range(len(self.languages)):
            np.cumsum(self.scores[:, k][b.gram], out=inside[1:], dtype=np.float64)
            out[:, k] = inside[b.end] - inside[b.start]
        allowed = self.scripts[b.script]
        out[~allowed & allowed.any(axis=1)[:, None]] = -np.inf
        return out

    def path(self, b: Batch, penalty: float = SWITCH) -> np.ndarray:
        """Best language of each word; all texts of the batch take a step at once."""
        scores, n, k = self.words(b), len(b.start), len(self.languages)
        back = np.empty((n, k), dtype=np.int16)
        count = np.diff(b.first)
        order = np.argsort(-count, kind="stable")  # longest first: active texts are a prefix
        active = np.searchsorted(-count[order], -np.arange(count.max() if len(count) else 0), "left")
        first = b.first[:-1][order]
        value = np.zeros((len(order), k))
        for t, m in enumerate(active.tolist()):
            v = value[:m]
            best = v.argmax(axis=1)
            top = v[np.arange(m), best] - penalty
            stay = v >= top[:, None]
            at = first[:m] + t
            back[at] = np.where(stay, np.arange(k), best[:, None])
            value[:m] = np.where(stay, v, top[:, None]) + scores[at]
            value[:m] -= value[:m].max(axis=1)[:, None]
        out = np.empty(n, dtype=np.int16)
        state = value.argmax(axis=1)
        for t in range(len(active) - 1, -1, -1):
            m = int(active[t])
            at = first[:m] + t
            out[at] = state[:m]
            state[:m] = back[at, state[:m]]
        return out


def quota(sizes: list[int], bound: int) -> float:
    """The q for which the sum of min(size, q) is ``bound``; the largest size if
    all fit."""
    left = float(bound)
    for i, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - i) > left:
            return left / (len(sizes) - i)
        left -= n
    return float(max(sizes, default=0))


def train(docs: DataFrame, text: str, lang: str, id_col: str, max_docs: int = TRAIN_DOCS) -> Model:
    """Learns from the rows of ``docs`` with a language and a text that has a word.

    At most about ``max_docs`` rows are read: all rows of the languages that
    have few, and of the others an equal number each (``quota``), chosen by a
    hash of the id (of the text if it is null).  The row with the least hash is
    always read, so every such language is learned, whatever the size.  The
    feature counts are summed by Spark, and the driver gets one row for each
    language and feature (languages x 2**15 at most).  A column with more than
    ``MAX_LANGUAGES`` values is no list of languages and refused.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(WORD)).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("_text"),
        F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.col(text))).alias("_hash"))
    sizes = cut(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("_hash").alias("least")), "languages")
    found = sizes.select("n").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"{lang} has more than {MAX_LANGUAGES} distinct values")
    own = quota([r.n for r in found], max_docs)
    keep = F.pmod("_hash", F.lit(1 << 30)) < F.least(F.lit(1.0), F.lit(own) / F.col("n")) * (1 << 30)
    rows = (rows.join(F.broadcast(sizes), "lang")  # one row a language
            .where(keep | (F.col("_hash") == F.col("least"))).select("lang", "_text"))

    def run(batches):
        tally: dict[str, np.ndarray] = {}
        for batch in byte_slices(batches, "_text"):
            b = words_of(batch.column("_text"))
            text_of = np.repeat(b.text_of, b.end - b.start)
            spot = np.repeat(b.start - np.concatenate(([0], np.cumsum(b.end - b.start)[:-1])), b.end - b.start)
            gram = b.gram[spot + np.arange(len(spot))]
            names = np.array(batch.column("lang").to_pylist(), dtype=object)
            for name in set(names.tolist()):
                own = names == name
                held = tally.setdefault(name, np.zeros((1 << BITS) + len(NAMES), np.int64))
                held[:1 << BITS] += np.bincount(gram[own[text_of]], minlength=1 << BITS)
                held[1 << BITS:] += np.bincount(b.script[own[b.text_of]], minlength=len(NAMES))
        for name, held in tally.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(held[at])],
                ["lang", "feature", "n"])

    counts = rows.mapInArrow(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(
        F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table_ = np.zeros(((1 << BITS) + len(NAMES), len(languages)))
    if languages:
        table_[counts["feature"], [languages.index(x) for x in counts["lang"]]] = counts["n"]
    grams, scripts = table_[:1 << BITS] + SMOOTH, table_[1 << BITS:]
    return Model(languages, np.log(grams / grams.sum(axis=0)),
                 scripts >= MIN_SHARE * np.maximum(scripts.sum(axis=0), 1))


def has_letter(column: pa.Array, b: Batch) -> np.ndarray:
    """Texts with at least one letter (Unicode)."""
    out = np.zeros(len(column), dtype=bool)
    for i in np.flatnonzero(np.diff(b.first)).tolist():
        out[i] = True
    low = pc.match_substring_regex(column, "[A-Za-z]").fill_null(False).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(out & ~low).tolist():  # non-ASCII only: rare
        out[i] = any(ch.isalpha() for ch in column[i].as_py())
    return out


def predict(docs: DataFrame, text: str, keep: list[str], model: Model, penalty: float = SWITCH) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` (share of letters on the path
    that have that language) and ``spans`` (runs of one language as language and
    number of words).  ``und`` with score 0 for a text that is null or has no
    letter, and for every text if nothing was learned; ties go to the language
    that sorts first."""
    no_clash(keep, "lang_pred score spans _text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_LANGUAGES x 2**15 numbers at most
    fields = arrow_fields(docs, keep)
    span = pa.struct([("lang", pa.string()), ("n_words", pa.int64())])

    def run(batches):
        m = shared.value
        for batch in byte_slices(batches, "_text", 2 << 20):
            column = batch.column("_text")
            b = words_of(column)
            n = batch.num_rows
            lang, score, spans = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
            if m.languages:
                path = m.path(b, penalty)
                share = np.zeros((n, len(m.languages)))
                np.add.at(share, (b.text_of, path), b.size)
                change = np.ones(len(path) + 1, dtype=bool)
                change[1:-1] = (path[1:] != path[:-1]) | (b.text_of[1:] != b.text_of[:-1])
                turns = np.flatnonzero(change)
                letters = has_letter(column, b)
                best, total = share.argmax(axis=1), share.sum(axis=1)
                for i in np.flatnonzero(letters).tolist():
                    lang[i], score[i] = m.languages[best[i]], share[i, best[i]] / total[i]
                for s, e in zip(turns[:-1].tolist(), turns[1:].tolist()):
                    i = int(b.text_of[s])
                    if letters[i]:
                        spans[i].append({"lang": m.languages[path[s]], "n_words": e - s})
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(lang), pa.array(score), pa.array(spans, pa.list_(span))],
                [*keep, "lang_pred", "score", "spans"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(
        run, fields + "lang_pred string, score double, spans array<struct<lang:string,n_words:long>>")


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5, is 0 (a null id reads as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract rows for ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out("doc_id")), "text", "lang", "doc_id")
    return predict(docs, "text", ["doc_id"], model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
