"""Inverted index as tables, and exact and fuzzy BM25 search over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.scores import search_bm25
from threadloom.functions.text import counted, query_tokens, tokens

FUZZY_EXPANSIONS = 50
EXACT_BOOST = 3.0
BOOST = "1 - edits / least(length(token), length(term))"


def postings(docs: DataFrame, key: str, text: str, keep: list[str] | None = None) -> DataFrame:
    """(key, keep..., term, tf, dl): one row per document and term; documents without tokens have none. Terms are counted inside the row, without a shuffle."""
    keep = keep or []
    words = docs.select(key, *keep, tokens(text).alias("__t")).filter(F.size("__t") > 0)
    return words.select(key, *keep, F.size("__t").alias("dl"), F.explode(counted("__t")).alias("__c")).select(key, *keep, F.col("__c.term").alias("term"), "dl", F.col("__c.tf").alias("tf"))


def document_lengths(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dl) of documents with at least one token; no shuffle."""
    return docs.select(key, F.size(tokens(text)).alias("dl")).filter("dl > 0")


def term_stats(posts: DataFrame) -> DataFrame:
    """(term, df, cf) over the whole index."""
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row (n_docs, avgdl): all documents count for n_docs, those with tokens for avgdl, which is 1 where there are none."""
    dl = F.size(tokens(F.coalesce(text, F.lit("")) if isinstance(text, str) else text))
    return docs.select(dl.alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.try_divide(F.sum("dl"), F.count_if(F.col("dl") > 0)), F.lit(1.0)).alias("avgdl"))


def within(a: str, b: str, most: str) -> str:
    """SQL of the edit distance of two columns with adjacent transpositions as one edit, for distances up to 2; above `most` it is null.

    Levenshtein counts a transposition as two edits, so only where it is above the limit, or 2, can a swap lower it: one swap of
    neighbouring letters of `a` followed by at most one further edit.
    """
    swap = f"concat(substring({a}, 1, i - 1), substring({a}, i + 1, 1), substring({a}, i, 1), substring({a}, i + 2, length({a})))"
    swapped = f"array_min(transform(sequence(1, greatest(length({a}) - 1, 1)), i -> levenshtein({swap}, {b}) + 1))"
    best = f"CASE WHEN levenshtein({a}, {b}) BETWEEN 2 AND 3 AND length({a}) >= 2 THEN least(levenshtein({a}, {b}), {swapped}) ELSE levenshtein({a}, {b}) END"
    return f"CASE WHEN {best} <= {most} THEN {best} END"


def fuzzy_terms(terms: DataFrame, vocabulary: DataFrame, expansions: int = FUZZY_EXPANSIONS) -> DataFrame:
    """(token, term, df, edits, boost) of each query token's expansions, the exact term among them.

    `terms` has one column `token`, a query of at most 500 characters (so at most 250 rows, safely broadcast); `vocabulary` is term_stats.
    Tokens of one or two characters have no expansions, from seven characters on two edits are allowed, else one; at most
    `expansions` by (boost desc, term).
    """
    length = F.length("token")
    allowed = F.when(length <= 2, 0).when(length >= 7, 2).otherwise(1)
    asked = terms.select("token", allowed.alias("most")).filter("most > 0")
    near = vocabulary.join(F.broadcast(asked), F.abs(F.length("term") - F.length("token")) <= F.col("most"))
    scored = near.withColumn("edits", F.expr(within("token", "term", "most"))).filter("edits is not null")
    boosted = scored.withColumn("boost", F.expr(BOOST))
    ranked = boosted.withColumn("rn", F.row_number().over(Window.partitionBy("token").orderBy(F.col("boost").desc(), "term")))
    return ranked.filter(F.col("rn") <= expansions).select("token", "term", "df", "edits", "boost")


def check_query(query: str, user_id: int | None = None, limit: int = 50) -> None:
    """Raises ValueError for what a search does not accept."""
    if user_id is not None and user_id <= 0:
        raise ValueError("user id must be positive")
    if not query or not query.strip() or len(query) > 500:
        raise ValueError("a query has 1 to 500 characters")
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")


@dataclass
class Index:
    """An inverted index as tables: postings (key, user column if any, term, tf, dl), term statistics, and one row of corpus statistics."""

    key: str
    posts: DataFrame
    vocabulary: DataFrame
    stats: DataFrame
    user: str | None = None

    def persist(self) -> Index:
        """The same index kept by the executors, for serving many searches; a lost part is made again from its lineage."""
        # by document, so that a search's sums per document need no shuffle
        posts = self.posts.repartition(self.key).persist()
        return Index(self.key, posts, term_stats(posts).persist(), self.stats.persist(), self.user)


def build_index(docs: DataFrame, key: str, text: str, user: str | None = None) -> Index:
    posts = postings(docs, key, text, [user] if user else [])
    return Index(key, posts, term_stats(posts), corpus_stats(docs, text), user)


def _scored(index: Index, hits: DataFrame, query: str, fuzzy: bool, keep: list[str]) -> DataFrame:
    """(keep..., key, score): for each distinct query token the better of 3 * exact BM25 and the fuzzy score, summed."""
    key, vocabulary = index.key, index.vocabulary
    asked = hits.sparkSession.range(1).select(F.explode(query_tokens(F.lit(query))).alias("token"))
    # one row per token, so at most 250, broadcast
    exact = vocabulary.select("term", "df").join(F.broadcast(asked), F.col("token") == F.col("term")).select("token", "term", "df", F.lit(EXACT_BOOST).alias("boost"))
    clauses = exact
    if fuzzy:
        expanded = fuzzy_terms(asked, vocabulary)
        blended = expanded.withColumn("df", F.max("df").over(Window.partitionBy("token"))).select("token", "term", "df", "boost")
        clauses = exact.unionByName(blended)
    # at most 250 tokens with 51 clauses each
    hits = hits.join(F.broadcast(clauses), "term").crossJoin(F.broadcast(index.stats))
    part = F.col("boost") * search_bm25(F.col("n_docs"), F.col("df"), F.col("tf"), F.col("dl"), F.col("avgdl"))
    # a token's fuzzy clause sums its terms, the better clause counts: one aggregation per document, since a document's clauses are few
    exact_part, fuzzy_part = F.when(F.col("boost") == EXACT_BOOST, part), F.when(F.col("boost") != EXACT_BOOST, part)
    clause = hits.groupBy(*keep, key, "token").agg(F.sum(exact_part).alias("a"), F.sum(fuzzy_part).alias("b"))
    best = F.greatest(F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0)))
    return clause.groupBy(*keep, key).agg(F.sum(best).alias("score"))


def search_index(index: Index, query: str, user_id: int | None = None, limit: int = 50, fuzzy: bool = True) -> DataFrame:
    """(key, score) of the `limit` best documents, of one user or of all.

    A fuzzy match counts with the largest df of its token's expansions and its boost. Ties go to the smaller key. No token, no rows.
    """
    check_query(query, user_id, limit)
    hits = index.posts if user_id is None else index.posts.filter(F.col(index.user) == user_id)
    return _scored(index, hits, query, fuzzy, []).orderBy(F.col("score").desc(), index.key).limit(limit)


def search_users(index: Index, query: str, limit: int = 50, fuzzy: bool = True) -> DataFrame:
    """(user, key, score) of the `limit` best documents of every user. The limit is applied before the shuffle by user, so a large user costs no large task."""
    check_query(query, None, limit)
    scored = _scored(index, index.posts.filter(F.col(index.user).isNotNull()), query, fuzzy, [index.user])
    rn = F.row_number().over(Window.partitionBy(index.user).orderBy(F.round("score", 12).desc(), index.key))
    return scored.withColumn("__rn", rn).filter(F.col("__rn") <= limit).drop("__rn")


def search(docs: DataFrame, key: str, text: str, query: str, user: tuple[str, int] | None = None, limit: int = 50, fuzzy: bool = True, stats_scope: str = "index") -> DataFrame:
    """`search_index` over an index of `docs` made on the way. Statistics span all documents, or the user's with stats_scope="user"; `user` is a column and its value."""
    check_query(query, user[1] if user else None, limit)
    if user and stats_scope == "user":
        docs = docs.filter(F.col(user[0]) == user[1])
    return search_index(build_index(docs, key, text, user[0] if user else None), query, user[1] if user else None, limit, fuzzy)
