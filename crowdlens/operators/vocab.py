"""Corpus, tokens, TF-IDF and vocabularies (A13-A19, A31, PF3-PF9, J3-J4, U1-U4, W7, T3-T4).

Everything is kept in sparse long form: one row per (document, position) for
tokens and one row per (document, term) for weights, so the cost is linear in
the number of tokens (the reference builds a dense documents x vocabulary
matrix).  Documents are keyed by ``doc_order`` = the first ``row_id`` of the
distinct text, which is also their first-seen order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdlens.functions import text as T
from crowdlens.functions.stem import stem_words
from crowdlens.operators.joins import (
    BROADCAST_BYTES, SPLIT_ROWS, hot_keys, keyed_join, measured_bytes, small, split_join)
from crowdlens.operators.layout import forget, placed
from crowdlens.operators.mapping import task_text
from crowdlens.operators.ordering import dense_positions
from crowdlens.session import cut, setting
from crowdlens.sources.stopwords import STOP_WORDS

StopWords = tuple[str, ...] | DataFrame  # a DataFrame has its words in its first column
VOCAB_BYTES = 8 << 20  # largest measured vocabulary that goes through the driver


def limited_rows(ann: DataFrame, max_rows: int | None) -> DataFrame:
    """PF4/IO6: keep the first ``max_rows`` rows by ``row_id``.

    The cut-off row id is a bounded top-k (``max_rows`` ids), then a filter,
    so the rows themselves never pass through one task.
    """
    if max_rows is None:
        return ann
    edge = (ann.select("row_id").orderBy("row_id").limit(max_rows)
            .agg(F.max("row_id").alias("edge")).first()["edge"])
    if edge is None:
        return ann.limit(0)
    return ann.where(F.col("row_id") <= F.lit(edge))


def corpus(ann: DataFrame) -> DataFrame:
    """U1/PF3: distinct texts with their first-seen order and row count."""
    return (ann.where(F.col("body_text").isNotNull())
            .groupBy("body_text")
            .agg(F.min("row_id").alias("doc_order"), F.count(F.lit(1)).alias("n_rows")))


def tokens(docs: DataFrame, key: str, text_col: str = "body_text",
           keep_empty: bool = False) -> DataFrame:
    """``(key, pos, token)``; ``pos`` indexes the split parts."""
    parts = docs.select(key, F.posexplode(T.token_parts(T.clean(F.col(text_col))))
                        .alias("pos", "token"))
    out = parts.select(key, F.col("pos").cast("int").alias("pos"), "token")
    return out if keep_empty else out.where(F.length("token") > 0)


def without_stop_words(toks: DataFrame, stop_words: StopWords) -> DataFrame:
    """PF8/J4: drops the tokens on the list."""
    if isinstance(stop_words, DataFrame):
        listed = cut(stop_words.select(F.col(stop_words.columns[0]).alias("token")).distinct(), "stop-words")
        return toks.join(small(listed), "token", "left_anti")
    return toks.where(~F.col("token").isin(list(stop_words)))


def stemmed(toks: DataFrame, stem: str) -> DataFrame:
    """PF9/F10: ``token`` of each row replaced by its ``term``; empty terms go.
    Every distinct token is stemmed once, so ``toks`` is read twice (a written
    table, unless ``stem`` is ``none``)."""
    if stem == "none":
        return toks.withColumnRenamed("token", "term").where(F.length("term") > 0)
    stems = cut(stem_words(toks.select("token").distinct(), stem), "stems").where(F.length("term") > 0)
    return keyed_join(toks, stems, "token").drop("token")


def vocab_terms(docs: DataFrame, key: str, stem: str = "porter2",
                stop_words: StopWords = STOP_WORDS,
                text_col: str = "body_text") -> DataFrame:
    """Vocabulary path: tokens minus stop words (PF8/J4, before stemming),
    stemmed (F10), empty stems dropped (PF9).  ``(key, pos, term)``."""
    kept = without_stop_words(tokens(docs, key, text_col), stop_words)
    if stem != "none":
        kept = cut(kept, "tokens")
    return stemmed(kept, stem).select(key, "pos", "term")


@dataclass
class TermStats:
    """Per-corpus statistics shared by the vocabulary modes."""

    doc_terms: DataFrame  # doc_order, term, tf, first_pos   (one row per document x term)
    counts: DataFrame     # term, n, df, first_doc, first_pos
    source: DataFrame     # the annotations

    @cached_property
    def n_docs(self) -> int:
        """Distinct texts, counted on their digests (the texts stay where they are)."""
        texts = self.source.where(F.col("body_text").isNotNull())
        return texts.select(F.sha2("body_text", 256).alias("d"), F.length("body_text")).distinct().count()


def term_stats(ann: DataFrame, stem: str = "porter2",
               stop_words: StopWords = STOP_WORDS) -> TermStats:
    """A13/A14/A16 over the distinct texts of ``ann``.

    Tokens are aggregated once per (document, token) -- frequency and first
    position -- before they are stemmed, and every corpus statistic derives
    from that much smaller table, so the texts are tokenised once.  The texts are
    dealt by document before they are tokenised (a text is much smaller than its
    tokens as rows), and the tables stay bucketed so: the sums by document
    (terms after stemming, norms of the weights) need no further exchange.
    """
    docs = corpus(ann).select("doc_order", "body_text").repartition("doc_order")
    toks = without_stop_words(tokens(docs, "doc_order"), stop_words)
    doc_terms = placed(toks.groupBy("doc_order", "token").agg(
        F.count(F.lit(1)).alias("tf"), F.min("pos").alias("first_pos")), "doc_order", "doc_tokens")
    if stem == "none":
        doc_terms = stemmed(doc_terms, stem).select("doc_order", "term", "tf", "first_pos")
    else:
        doc_tokens = doc_terms
        doc_terms = placed(stemmed(doc_tokens, stem).groupBy("doc_order", "term").agg(
            F.sum("tf").alias("tf"), F.min("first_pos").alias("first_pos")), "doc_order", "doc_terms")
        forget(doc_tokens)
    # (document, position) as one number, so that its minimum is a hash aggregate
    place = F.col("doc_order").cast("decimal(20,0)") * F.lit(1 << 31) + F.col("first_pos")
    counts = doc_terms.groupBy("term").agg(
        F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df"), F.min(place).alias("_first"))
    counts = counts.withColumn("_pos", F.pmod(F.col("_first"), F.lit(1 << 31).cast("decimal(11,0)"))).select(
        "term", "n", "df",
        F.expr(f"CAST((_first - _pos) DIV {1 << 31} AS BIGINT)").alias("first_doc"),
        F.col("_pos").cast("int").alias("first_pos"))
    return TermStats(doc_terms, counts, ann)


def idf(stats: TermStats) -> DataFrame:
    """ln(N / (1 + df)) -- can be negative when a term is everywhere."""
    return stats.counts.select(
        "term", "df",
        F.log(F.lit(float(stats.n_docs)) / (F.lit(1.0) + F.col("df"))).alias("idf"))


def tfidf(stats: TermStats) -> DataFrame:
    """Sparse ``(doc_order, term, tf, tfidf)``.  A term's document
    frequency is its number of rows here, so the hot terms are known."""
    tf = stats.doc_terms.select("doc_order", "term", "tf")
    weights = cut(idf(stats), "idf")
    if measured_bytes(weights) <= BROADCAST_BYTES:
        joined = tf.join(F.broadcast(weights.select("term", "idf")), "term")
    else:
        hot = weights.where(F.col("df") > F.lit(SPLIT_ROWS)).select("term")
        joined = split_join(tf, weights.select("term", "idf"), ["term"], hot)
    return joined.select("doc_order", "term", "tf", (F.col("tf") * F.col("idf")).alias("tfidf"))


def tfidf_l2(stats: TermStats) -> DataFrame:
    """X / sqrt(sum x^2) per document; a zero vector gives NULL (not NaN)."""
    t = tfidf(stats)
    norm = F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf")).over(Window.partitionBy("doc_order")))
    return t.withColumn("weight", F.try_divide(F.col("tfidf"), norm))


def vocabulary(ann: DataFrame, selection: str = "first_seen", min_count: int = 1,
               threshold: float = 0.8, max_terms: int | None = None,
               sample_rows: int | None = None, stem: str = "porter2",
               stop_words: StopWords = STOP_WORDS) -> DataFrame:
    """Build ``(word_idx, term)``.

    * ``first_seen`` (what the reference code returns): every term with at
      least ``min_count`` occurrences, in order of first occurrence (W7).
    * ``tfidf`` (what its documentation describes): terms whose normalised
      weight exceeds ``threshold`` in some document, in order of selection
      (document order, weight descending, first-seen order).
    ``sample_rows`` keeps the first rows only (PF4), ``max_terms`` caps (T4).
    The result is checkpointed: it is small and read many times.
    """
    src = limited_rows(ann, sample_rows)
    stats = term_stats(src, stem, stop_words)
    counts = stats.counts.where(F.col("n") >= F.lit(min_count))
    if selection == "first_seen":
        keyed = counts.select("term", F.struct("first_doc", "first_pos").alias("_k"))
    elif selection == "tfidf":
        seen = dense_positions(counts.select("term", "first_doc", "first_pos"),
                               ["first_doc", "first_pos"], "_seen")
        w = tfidf_l2(stats).where(F.col("weight") > F.lit(threshold))
        w = keyed_join(cut(w, "selected"), cut(seen.select("term", "_seen"), "seen"), "term")
        keyed = w.groupBy("term").agg(
            F.min(F.struct("doc_order", (-F.col("weight")).alias("neg_w"), "_seen")).alias("_k"))
    else:
        raise ValueError(f"unknown vocabulary selection {selection!r}")
    ranked = dense_positions(keyed, ["_k"], "word_idx").select("word_idx", "term")
    if max_terms is not None:
        ranked = ranked.where(F.col("word_idx") < F.lit(max_terms))
    return cut(ranked)


def task_words(ann: DataFrame, vocab: DataFrame, stem: str = "porter2",
               apply_stop_in_index: bool = False,
               stop_words: StopWords = STOP_WORDS) -> DataFrame:
    """Distinct ``(task_id, word_idx)`` of the first text of each task.

    Indexing path: by default no stop-word filter (as the reference), stems
    matched against the vocabulary; ``apply_stop_in_index`` drops stop
    words here too.
    """
    toks = tokens(task_text(ann), "task_id")
    if apply_stop_in_index:
        toks = without_stop_words(toks, stop_words)
    return words_of(toks, "task_id", vocab, stem)


def words_of(toks: DataFrame, key: str, vocab: DataFrame, stem: str) -> DataFrame:
    """Distinct ``(key, word_idx)`` of ``(key, token)`` rows against a written
    vocabulary, which is broadcast if its measured size allows.  By its file size
    Spark would broadcast larger ones, too: they are dealt by term, hashed (terms are
    unique, so they spread evenly)."""
    toks = toks.select(key, "token").distinct()
    terms = stemmed(toks if stem == "none" else cut(toks, "tokens"), stem)
    if measured_bytes(vocab) <= VOCAB_BYTES:
        found = terms.join(F.broadcast(vocab), "term")
    else:
        # read twice to find the hot terms; texts dealt by key alone give distinct tokens where they lie
        with setting(vocab.sparkSession, {"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
            terms = cut(terms, "terms")
        found = split_join(terms, vocab.hint("shuffle_hash"), ["term"], hot_keys(terms, "term"))
    found = found.select(key, "word_idx")
    return found if stem == "none" else found.distinct()


def task_word_counts(ann: DataFrame, words: DataFrame) -> DataFrame:
    """Number of distinct vocabulary words per task, 0 kept."""
    tasks = ann.select("task_id").distinct()
    n = words.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_words"))
    return (tasks.join(n, "task_id", "left")
            .select("task_id", F.coalesce("n_words", F.lit(0)).cast("bigint").alias("n_words")))


def processed_text_quality(ann: DataFrame, stem: str = "porter2",
                           stop_words: StopWords = STOP_WORDS) -> DataFrame:
    """Terms left per task after stop words and stemming."""
    texts = task_text(ann)
    terms = vocab_terms(texts, "task_id", stem, stop_words)
    n = terms.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_terms"))
    out = texts.select("task_id").join(n, "task_id", "left").select(
        "task_id", F.coalesce("n_terms", F.lit(0)).cast("bigint").alias("n_terms"))
    return out.withColumn(
        "status",
        F.when(F.col("n_terms") == 0, "empty").when(F.col("n_terms") == 1, "one_term")
        .otherwise("ok"))
