"""The pN_ queries of the problems tagged llm: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import conversations, cooccurrence, distinctive, mixing, neighbours, personal, rankwalk, tokens
from threadloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuild(table(spark, d, "chat_message"))


def p1_sessions(spark: SparkSession, d: str) -> DataFrame:
    return conversations.account_sessions(table(spark, d, "chat_message")).withColumnRenamed("channel", "account_uuid")


def _associated(spark: SparkSession, d: str) -> DataFrame:
    baskets = cooccurrence.node_baskets(table(spark, d, "semantic_fragment_node"), table(spark, d, "semantic_fragments"), table(spark, d, "semantic_node"))
    return cooccurrence.cooccurrence(baskets)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _associated(spark, d).select("node_lo", "node_hi")


def p2_associations(spark: SparkSession, d: str) -> DataFrame:
    return _associated(spark, d).withColumn("npmi", F.round("npmi", 6)).select("user_id", "node_lo", "node_hi", "n_common", "n_lo", "n_hi", "n_total", "npmi")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "fragment_probe").filter(F.col("purpose") == "keyword").select(F.col("fragment_id").alias("record"))
    scores = distinctive.distinctiveness(table(spark, d, "semantic_fragments"), "fragment_id", "text", only=asked)
    return distinctive.leaders(scores).select(F.col("record").alias("fragment_id"), "term")


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    scores = distinctive.distinctiveness(table(spark, d, "semantic_fragments"), "fragment_id", "text", mu=50.0)
    return scores.select(F.col("record").alias("fragment_id"), "term", "tf", "df", F.round("score", 6).alias("score"))


def _ranking(spark: SparkSession, d: str) -> DataFrame:
    return rankwalk.combine(table(spark, d, "lexical_hit"), table(spark, d, "graph_hit"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rankwalk.head(_ranking(spark, d), 3).select("search_id", "fragment_id")


def p4_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(spark, d).withColumn("weight", F.round("weight", 9))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "fragment_probe").filter(F.col("purpose") == "neighbour").select("fragment_id")
    near = neighbours.nearest(table(spark, d, "semantic_fragments"), "fragment_id", "embedding", asked)
    return near.select(F.least("query_id", "other_id").alias("fragment_lo"), F.greatest("query_id", "other_id").alias("fragment_hi")).distinct()


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    fragments = table(spark, d, "semantic_fragments")
    asked = fragments.filter(F.col("fragment_id") % 100 == 0).select("fragment_id")
    near = neighbours.nearest(fragments, "fragment_id", "embedding", asked)
    return near.select("query_id", "place", "other_id", F.round("cosine", 5).alias("cosine"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    back = tokens.decode(p8_ids(spark, d), "doc_id")
    return back.select("doc_id", F.sha2("text", 256).alias("text_sha256"))


def _sources(spark: SparkSession, d: str):
    """(token counts of the documents, targets, tokens of each source)."""
    sizes, targets = mixing.sized(table(spark, d, "documents")), mixing.targets_of(table(spark, d, "mix_target"))
    return sizes, targets, mixing.source_tokens(sizes, targets)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets, tokens = _sources(spark, d)
    return mixing.mix(sizes, targets, tokens=tokens)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets, tokens = _sources(spark, d)
    return mixing.report(mixing.mix(sizes, targets, tokens=tokens), targets, tokens)


def p9_temperature_mix(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets, tokens = _sources(spark, d)
    return mixing.tempered_mix(sizes, targets, tokens)


def p9_temperature(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets, tokens = _sources(spark, d)
    return mixing.temperature_report(mixing.tempered_mix(sizes, targets, tokens), tokens, targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.found_rows(personal.find(table(spark, d, "documents"), table(spark, d, "given_name")))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return personal.redact(documents, personal.find(documents, table(spark, d, "given_name")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_sessions, p2_found, p2_associations, p3_found, p3_scores, p4_found, p4_ranking, p7_found, p7_neighbours,
        p8_ids, p8_round_trip, p9_mix, p9_shares, p9_temperature, p9_temperature_mix, p10_found, p10_redacted,
    )
}
