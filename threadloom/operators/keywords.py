"""Keywords of fragments: BM25 against the whole index, cut by score mass; phrases and centroids that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.scores import keyword_bm25
from threadloom.functions.text import STOP_WORDS, normalize_phrase, normalize_words, valid_keyword
from threadloom.functions.vectors import mean_vectors
from threadloom.operators.lexical import corpus_stats, postings, term_stats

MOST_KEYWORDS = 15
LEAST_OF_MAX = 0.35
MASS = 0.60


def keyword_scores(docs: DataFrame, key: str, text: str, stop_words=STOP_WORDS, min_df: int = 2) -> DataFrame:
    """(key, term, score) of the valid terms that occur in at least `min_df` documents of the whole index."""
    posts = postings(docs, key, text)
    rare_out = term_stats(posts).filter(F.col("df") >= min_df).filter(valid_keyword("term", stop_words))
    scored = posts.join(rare_out.select("term", "df"), "term").crossJoin(F.broadcast(corpus_stats(docs, text)))
    return scored.select(key, "term", keyword_bm25(F.col("n_docs"), F.col("df"), F.col("tf"), F.col("dl"), F.col("avgdl")).alias("score"))


def select_keywords(scores: DataFrame, key: str) -> DataFrame:
    """The head of each document's terms by score, ties in term order: at most 15, each at least 0.35 of the best, until 0.60 of the total is reached."""
    order = Window.partitionBy(key).orderBy(F.round(F.col("score"), 12).desc(), "term")
    every = Window.partitionBy(key)
    ranked = scores.select(
        key, "term", "score", F.row_number().over(order).alias("rn"), F.max("score").over(every).alias("best"), F.sum("score").over(every).alias("total"),
        F.coalesce(F.sum("score").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"),
    )
    kept = (F.col("best") > 0) & (F.col("rn") <= MOST_KEYWORDS) & (F.try_divide(F.col("score"), F.col("best")) >= LEAST_OF_MAX) & ((F.col("rn") == 1) | (F.col("before") < MASS * F.col("total")))
    return ranked.filter(kept).select(key, "term", "score", "rn")


def normalized_keywords(selected: DataFrame, key: str, stop_words=STOP_WORDS) -> DataFrame:
    """(key, keyword): the selected terms normalised, without blanks and stop words, distinct."""
    word = selected.select(key, normalize_words("term").alias("keyword"))
    return word.filter((F.col("keyword") != "") & ~F.col("keyword").isin(*sorted(stop_words))).distinct()


def phrases_with_keywords(fragments: DataFrame, keywords: DataFrame, key: str, user: str, phrases: str = "noun_phrases") -> DataFrame:
    """(key, user, phrase, keyword): each fragment's phrases with those of its keywords that are words of the phrase.

    Phrases are normalised and distinct per fragment. A fragment without keywords, or a phrase without any, has no rows.
    """
    own = fragments.select(key, user, F.explode(phrases).alias("raw")).select(key, user, normalize_phrase("raw").alias("phrase")).filter("phrase != ''").distinct()
    words = own.select(key, user, "phrase", F.explode(F.array_distinct(F.split("phrase", " "))).alias("keyword"))
    return words.join(keywords.select(key, "keyword"), [key, "keyword"]).select(key, user, "phrase", "keyword")


def phrase_occurrences(found: DataFrame, key: str, user: str) -> DataFrame:
    """(user, phrase, n) of fragments that hold the phrase."""
    return found.select(key, user, "phrase").distinct().groupBy(user, "phrase").agg(F.count(F.lit(1)).alias("n"))


def phrase_keywords(found: DataFrame, user: str) -> DataFrame:
    """(user, phrase, keywords): the union of a phrase's keywords, sorted."""
    return found.groupBy(user, "phrase").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))


def keyword_phrases(found: DataFrame, user: str) -> DataFrame:
    """(user, keyword, phrases), sorted."""
    return found.groupBy(user, "keyword").agg(F.array_sort(F.collect_set("phrase")).alias("phrases"))


def keyword_centroids(fragments: DataFrame, keywords: DataFrame, key: str, user: str, embedding: str = "embedding") -> DataFrame:
    """(user, keyword, centroid, n): the mean vector of the fragments that selected the keyword. Fragments without a vector take no part."""
    return mean_vectors(keywords.select(key, "keyword").join(fragments.select(key, user, embedding), key), [user, "keyword"], embedding)


def phrase_centroids(found: DataFrame, centroids: DataFrame, user: str) -> DataFrame:
    """(user, phrase, centroid, n): the mean of the centroids of a phrase's keywords; keywords without one are passed over."""
    pairs = found.select(user, "phrase", "keyword").distinct()
    return mean_vectors(pairs.join(centroids.select(user, "keyword", "centroid"), [user, "keyword"]), [user, "phrase"], "centroid")
