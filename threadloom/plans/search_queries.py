"""Queries of the index, keywords, the concept graph and retrieval, over whole tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import vectors
from threadloom.operators import graph, keywords, lexical, retrieve
from threadloom.plans.stored import serving_of
from threadloom.session import cut, table

#: The query text, user and query vector (a fragment) of the searches in this catalogue.
QUERY = "weekly schedle of the Kafka topic"
USER = 1000
ASKED = 1


def _frag(s, d):
    return table(s, d, "semantic_fragments")


def _mapping(s, d):
    return graph.known_mapping(table(s, d, "semantic_fragment_node"), _frag(s, d), table(s, d, "semantic_node"))


def node_pairs(s, d):
    return graph.counted_edges(_mapping(s, d), table(s, d, "semantic_node")).select("user_id", "source_node_id", "target_node_id", "cooccurrence_count")


def npmi_edges(s, d):
    totals = _frag(s, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return graph.npmi_edges(graph.counted_edges(_mapping(s, d), table(s, d, "semantic_node")), totals, strict=False)


def adjacency_top3(s, d):
    return graph.adjacency(npmi_edges(s, d)).select("user_id", "node", "neighbor", F.round("npmi", 6).alias("npmi"), "edge_rank")


def _seeds(s, d):
    """The seeds of the query's lexical hits, as a table."""
    hits = serving_of(s, d).lexical(USER, QUERY)
    return s.createDataFrame([(0, f, x) for f, _, x in hits], "q int, fragment_id bigint, score double")


def _reached(s, d):
    seeds = retrieve.select_seeds(_seeds(s, d), "fragment_id", "score", ["q"]).select("fragment_id", "score")
    roots = graph.seed_nodes(seeds, _mapping(s, d), table(s, d, "semantic_node"), USER)
    return graph.traverse(roots, serving_of(s, d).table("near", USER))


def graph_traverse_3hop(s, d):
    return _reached(s, d).select("node", F.round("score", 6).alias("score"))


def graph_fragment_hits(s, d):
    hits = graph.fragment_hits(_reached(s, d), _mapping(s, d))
    return hits.select("fragment_id", "mapping_id", F.round("score", 6).alias("score"))


def _found(s, d):
    kw = keywords.normalized_keywords(keywords.select_keywords(keywords.keyword_scores(_frag(s, d), "fragment_id", "text"), "fragment_id"), "fragment_id")
    return keywords.phrases_with_keywords(_frag(s, d), kw, "fragment_id", "user_id")


def _usable(s, d):
    return _frag(s, d).filter(vectors.usable("embedding", 128))


def _keyword_centroids(s, d):
    kw = keywords.normalized_keywords(keywords.select_keywords(keywords.keyword_scores(_frag(s, d), "fragment_id", "text"), "fragment_id"), "fragment_id")
    return keywords.keyword_centroids(_usable(s, d), kw, "fragment_id", "user_id")


def keyword_centroid(s, d):
    return _keyword_centroids(s, d).select("user_id", "keyword", "n", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 4) + 0.0)


def phrase_centroid(s, d):
    c = keywords.phrase_centroids(_found(s, d), _keyword_centroids(s, d), "user_id")
    return c.select("user_id", "phrase", "n", (F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 4) + 0.0).alias("total"))


def indirect_edges_jaccard(s, d):
    return graph.keyword_edges(_found(s, d), "user_id").withColumn("overlap", F.round("overlap", 6))


def graph_edges(s, d):
    """Nodes, direct and indirect edges built from fragments, merged into one table by label."""
    found = cut(_found(s, d))
    labels = found.select("user_id", F.col("phrase").alias("label"), "fragment_id").distinct()
    nodes = cut(graph.resolve_nodes(labels, table(s, d, "semantic_node").select("node_id", "user_id", "label")))
    direct = graph.direct_edges(graph.phrase_pairs(labels, "fragment_id", "user_id"), nodes)
    indirect = graph.indirect_edges(graph.keyword_edges(found, "user_id"), nodes)
    merged = graph.merge_edges(direct, indirect).drop("npmi", "fused_weight", "weights_epoch")
    # new nodes' ids come from a hash, so the edges are shown by label
    for side in ("source", "target"):
        merged = merged.join(nodes.select(F.col("node_id").alias(f"{side}_node_id"), F.col("label").alias(side)), f"{side}_node_id")
    return merged.select("user_id", F.least("source", "target").alias("label_a"), F.greatest("source", "target").alias("label_b"), "cooccurrence_count", "shared_keyword_count", F.round("overlap_score", 6).alias("overlap_score"))


def _query_vector(s, d):
    return [float(x) for x in _frag(s, d).filter(F.col("fragment_id") == ASKED).select("embedding").first().embedding]


def semantic_search(s, d):
    out = retrieve.semantic_search(_frag(s, d), _query_vector(s, d), USER)
    return out.select("message_id", F.round("distance", 6).alias("distance"))


def message_min_distance(s, d):
    return retrieve.message_distances(_frag(s, d), _query_vector(s, d)).select("message_id", F.round("distance", 6).alias("distance"))


def _lists(s, d):
    links = _frag(s, d).select("fragment_id", "message_id")
    return [retrieve.message_order(table(s, d, t), links, ["search_id"]) for t in ("lexical_hit", "graph_hit")]


def rrf_fuse(s, d):
    out = retrieve.reciprocal_rank_fusion(_lists(s, d), ["search_id"], "message_id")
    return out.select("search_id", "message_id", F.round("score", 9).alias("score"), "place")


def fast_search(s, d, user: int = USER, query: str = QUERY):
    """Lexical hits, seeds, traversal and fusion over the stored search tables: (message_id, score, place)."""
    search = serving_of(s, d)
    ranked = search.fused(user, search.lexical(user, query))
    return s.createDataFrame([(m, round(x, 9), i) for i, (m, x) in enumerate(ranked, 1)], "message_id bigint, score double, place int")


def node_attributes(s, d):
    found = cut(_found(s, d))
    labels = found.select("fragment_id", "user_id", F.col("phrase").alias("label")).distinct()
    nodes = cut(graph.resolve_nodes(labels, table(s, d, "semantic_node").select("node_id", "user_id", "label")))
    made = graph.node_attributes(nodes, graph.map_fragments(labels, nodes), keywords.phrase_centroids(found, _keyword_centroids(s, d), "user_id"))
    total = F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x.cast("double")), 3) + 0.0
    return made.select("user_id", "label", "fragment_count", "avg_similarity", "is_stable", total.alias("total"))


def map_fragments(s, d):
    """The mapping of fragments and nodes by label."""
    labels = graph.fragment_phrases(_frag(s, d), "fragment_id", "user_id")
    nodes = cut(graph.resolve_nodes(labels, table(s, d, "semantic_node").select("node_id", "user_id", "label")))
    mapping = graph.map_fragments(labels, nodes)
    return mapping.join(nodes, "node_id").select("fragment_id", "user_id", "label", "weight")


def lexical_by_user(s, d):
    """The query's best fragments of every user."""
    found = lexical.search_users(lexical.build_index(_frag(s, d), "fragment_id", "text", "user_id"), QUERY)
    return found.select("user_id", "fragment_id", F.round("score", 6).alias("score"))


def _asked(s, d):
    """The stated set of queries: every fragment whose id is divisible by 100."""
    return _frag(s, d).filter("fragment_id % 100 = 0").select(F.col("fragment_id").alias("query_id"), "user_id", "embedding")


def semantic_search_all(s, d):
    """The nearest messages of its user for every stated query."""
    return retrieve.semantic_search_all(_frag(s, d), _asked(s, d)).select("query_id", "message_id", F.round("distance", 5).alias("distance"), "place")


def semantic_search_content(s, d):
    """The vector search's answers with the messages' content: their fragments' texts in order."""
    parts = _frag(s, d).filter("message_id is not null").groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("fragment_order", "fragment_id", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    messages = parts.select("message_id", F.array_join(F.transform("p", lambda x: x.text), "\n").alias("content"))
    return retrieve.with_content(semantic_search(s, d), messages)


def mrr_at_3(s, d):
    """Relevant is every message that holds a hit of both lists; ranked is the fusion."""
    ranked = retrieve.reciprocal_rank_fusion(_lists(s, d), ["search_id"], "message_id").select("search_id", "message_id", F.col("place").alias("rank"))
    a, b = _lists(s, d)
    both = a.select("search_id", "message_id").join(b.select("search_id", "message_id"), ["search_id", "message_id"], "left_semi")
    return retrieve.reciprocal_rank(ranked, both, "search_id", "message_id").select(F.round("mrr", 6).alias("mrr"), "n_queries")


def seed_select(s, d):
    hits = table(s, d, "lexical_hit").filter("score is not null and not isnan(score)").groupBy("search_id", "fragment_id").agg(F.max(F.col("score").cast("double")).alias("score"))
    return retrieve.select_seeds(hits, "fragment_id", "score", ["search_id"]).select("search_id", "fragment_id", "drawn")


def sample_wor(s, d):
    hits = table(s, d, "graph_hit").filter("score is not null and not isnan(score)").groupBy("search_id", "fragment_id").agg(F.max("score").alias("score"))
    return retrieve.sample_without_replacement(hits, "fragment_id", "score", 5, ["search_id"]).select("search_id", "fragment_id")


def _lexical(fuzzy):
    return lambda s, d: lexical.search(_frag(s, d), "fragment_id", "text", QUERY, ("user_id", USER), fuzzy=fuzzy).select("fragment_id", F.round("score", 6).alias("score"))


QUERIES = {
    "postings_tf": lambda s, d: lexical.postings(_frag(s, d), "fragment_id", "text"),
    "term_df": lambda s, d: lexical.term_stats(lexical.postings(_frag(s, d), "fragment_id", "text")),
    "corpus_stats": lambda s, d: lexical.corpus_stats(_frag(s, d), "text").select("n_docs", F.round("avgdl", 6).alias("avgdl")),
    "keyword_bm25": lambda s, d: keywords.keyword_scores(_frag(s, d), "fragment_id", "text").withColumn("score", F.round("score", 6)),
    "keyword_select": lambda s, d: keywords.select_keywords(keywords.keyword_scores(_frag(s, d), "fragment_id", "text"), "fragment_id").select("fragment_id", "term", F.col("rn").alias("place")),
    "lexical_exact_top50": _lexical(False),
    "lexical_fuzzy_top50": _lexical(True),
    "phrase_occurrence": lambda s, d: keywords.phrase_occurrences(_found(s, d), "fragment_id", "user_id"),
    "phrase_keywords": lambda s, d: keywords.phrase_keywords(_found(s, d), "user_id").select("user_id", "phrase", F.array_join("keywords", ",").alias("keywords")),
    "keyword_phrases": lambda s, d: keywords.keyword_phrases(_found(s, d), "user_id").select("user_id", "keyword", F.array_join("phrases", ",").alias("phrases")),
    "keyword_centroid": keyword_centroid,
    "phrase_centroid": phrase_centroid,
    "phrase_pairs": lambda s, d: graph.phrase_pairs(graph.fragment_phrases(_frag(s, d), "fragment_id", "user_id"), "fragment_id", "user_id"),
    "node_fragment_counts": lambda s, d: graph.node_counts(_mapping(s, d)),
    "direct_edges": node_pairs,
    "npmi_edges": lambda s, d: npmi_edges(s, d).select("user_id", "source_node_id", "target_node_id", F.round("npmi", 6).alias("npmi")),
    "adjacency_top3": adjacency_top3,
    "graph_traverse_3hop": graph_traverse_3hop,
    "graph_fragment_hits": graph_fragment_hits,
    "indirect_edges_jaccard": indirect_edges_jaccard,
    "graph_edges": graph_edges,
    "node_attributes": node_attributes,
    "map_fragments": map_fragments,
    "lexical_by_user": lexical_by_user,
    "semantic_search_all": semantic_search_all,
    "semantic_search_content": semantic_search_content,
    "rrf_fuse": rrf_fuse,
    "fast_search": fast_search,
    "semantic_search": semantic_search,
    "message_min_distance": message_min_distance,
    "cosine_pairs": lambda s, d: _usable(s, d).alias("a").join(_usable(s, d).alias("b"), F.col("b.fragment_id") == F.col("a.fragment_id") + 1).select(F.col("a.fragment_id").alias("fragment_id"), F.round(vectors.cosine_similarity("a.embedding", "b.embedding"), 6).alias("cosine")),
    "user_fragment_counts": lambda s, d: _frag(s, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")),
    "latest_fragments": lambda s, d: _frag(s, d).filter(F.col("user_id") == USER).select("fragment_id", "created_at").orderBy(F.col("created_at").desc_nulls_last(), "fragment_id").limit(10),
    "user_messages": lambda s, d: retrieve.messages_of_user(_frag(s, d).select("message_id", "conversation_id").distinct(), _frag(s, d), USER),
    "seed_select": seed_select,
    "sample_wor": sample_wor,
    "mrr_at_3": mrr_at_3,
}

# ---- DuckDB ----
_POST = """words AS (SELECT fragment_id, user_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM semantic_fragments),
posts AS (SELECT fragment_id, user_id, term, count(*) AS tf FROM words GROUP BY ALL),
lens AS (SELECT fragment_id, sum(tf) AS dl FROM posts GROUP BY ALL),
stats AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM posts GROUP BY term),
corpus AS (SELECT (SELECT count(*) FROM semantic_fragments) AS n, coalesce((SELECT sum(dl) / count(*)::DOUBLE FROM lens), 1.0) AS avgdl)
"""
_STOP = "(" + ", ".join(f"'{w}'" for w in sorted(keywords.STOP_WORDS)) + ")"
_VALID = f"length(term) BETWEEN 3 AND 50 AND term NOT IN {_STOP} AND regexp_matches(term, '\\p{{L}}') AND length(regexp_replace(term, '[\\p{{L}}\\p{{N}}_-]', '', 'g')) <= 2"
_KW = f"""{_POST}, kw AS (SELECT p.fragment_id, p.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS score
 FROM posts p JOIN lens USING (fragment_id) JOIN stats s USING (term), corpus WHERE s.df >= 2 AND {_VALID.replace('term', 'p.term')})
"""
_SEL = f"""{_KW}, ranked AS (SELECT *, row_number() OVER w AS rn, max(score) OVER e AS best, sum(score) OVER e AS total, coalesce(sum(score) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM kw WINDOW w AS (PARTITION BY fragment_id ORDER BY round(score, 12) DESC, term), e AS (PARTITION BY fragment_id)),
sel AS (SELECT fragment_id, term, rn FROM ranked WHERE best > 0 AND rn <= 15 AND score / best >= 0.35 AND (rn = 1 OR before < 0.6 * total))
"""
_NORM = "array_to_string(list_filter(list_transform(regexp_split_to_array(trim(raw), '\\s+'), lambda w : regexp_replace(lower(w), '[^a-z0-9]', '', 'g')), lambda w : w <> ''), ' ')"
_FOUND = f"""{_SEL}, nk AS (SELECT DISTINCT fragment_id, keyword FROM (SELECT fragment_id, regexp_replace(term, '[^a-z0-9]', '', 'g') AS keyword FROM sel) WHERE keyword <> '' AND keyword NOT IN {_STOP}),
ph AS (SELECT DISTINCT fragment_id, user_id, {_NORM} AS phrase FROM (SELECT fragment_id, user_id, unnest(noun_phrases) AS raw FROM semantic_fragments)),
found AS (SELECT DISTINCT fragment_id, user_id, phrase, keyword FROM (SELECT *, unnest(string_split(phrase, ' ')) AS keyword FROM ph WHERE phrase <> '') JOIN nk USING (fragment_id, keyword))
"""
_MAP = """map AS (SELECT m.* FROM semantic_fragment_node m SEMI JOIN semantic_fragments f ON f.fragment_id = m.fragment_id SEMI JOIN semantic_node s ON s.node_id = m.node_id),
links AS (SELECT DISTINCT m.fragment_id, m.node_id, s.user_id FROM map m JOIN semantic_node s USING (node_id)),
cnt AS (SELECT node_id, count(*) AS c FROM links GROUP BY ALL),
pairs AS (SELECT a.user_id, a.node_id AS source_node_id, b.node_id AS target_node_id, count(*) AS n FROM links a JOIN links b ON a.fragment_id = b.fragment_id AND a.user_id = b.user_id AND a.node_id < b.node_id GROUP BY ALL),
tot AS (SELECT user_id, count(*) AS n FROM semantic_fragments GROUP BY user_id),
edges AS (SELECT p.user_id, source_node_id, target_node_id, greatest(-1, least(1, ln(p.n * t.n::DOUBLE / (ca.c * cb.c)) / -ln(p.n / t.n::DOUBLE))) AS npmi
  FROM pairs p JOIN cnt ca ON ca.node_id = source_node_id JOIN cnt cb ON cb.node_id = target_node_id JOIN tot t USING (user_id)
  WHERE p.n < t.n AND ca.c <= t.n AND cb.c <= t.n AND p.n >= ca.c + cb.c - t.n),
pos AS (SELECT * FROM edges WHERE npmi > 0),
sym AS (SELECT user_id, source_node_id AS node, target_node_id AS neighbor, npmi, source_node_id AS e1, target_node_id AS e2 FROM pos UNION ALL SELECT user_id, target_node_id, source_node_id, npmi, source_node_id, target_node_id FROM pos),
adj AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(npmi, 12) DESC, e1, e2) AS edge_rank FROM sym QUALIFY edge_rank <= 3)
"""
_HOPS = f"""h0 AS (SELECT l.node_id AS node, max(score) AS score FROM links l JOIN seeds USING (fragment_id) WHERE l.user_id = {USER} GROUP BY ALL),
h1 AS (SELECT neighbor AS node, max(score * npmi) AS score FROM h0 JOIN adj USING (node) GROUP BY ALL),
h2 AS (SELECT neighbor AS node, max(score * npmi) AS score FROM h1 JOIN adj USING (node) GROUP BY ALL),
h3 AS (SELECT neighbor AS node, max(score * npmi) AS score FROM h2 JOIN adj USING (node) GROUP BY ALL),
best AS (SELECT node, max(score) AS score FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY node)
"""
def _search_ctes(fuzzy: bool) -> str:
    clauses = "SELECT token, term, df, 3.0::DOUBLE AS boost FROM toks JOIN stats ON term = token"
    if fuzzy:
        clauses += " UNION ALL SELECT token, term, max(df) OVER (PARTITION BY token), boost FROM fz"
    return f"""{_POST}, toks AS (SELECT DISTINCT unnest(regexp_extract_all(lower('{QUERY}'), '[\\p{{L}}\\p{{N}}_]+')) AS token),
fz AS (SELECT token, term, df, 1 - e / least(length(token), length(term))::DOUBLE AS boost FROM (
   SELECT token, term, df, damerau_levenshtein(token, term) AS e FROM toks JOIN stats ON abs(length(term) - length(token)) <= 2 WHERE length(token) > 2)
   WHERE e <= CASE WHEN length(token) >= 7 THEN 2 ELSE 1 END QUALIFY row_number() OVER (PARTITION BY token ORDER BY boost DESC, term) <= 50),
cl AS ({clauses}),
parts AS (SELECT p.fragment_id, token, boost = 3.0 AS exact, sum(boost * ln(1 + (n - c.df + 0.5) / (c.df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s
   FROM posts p JOIN cl c USING (term) JOIN lens USING (fragment_id), corpus WHERE user_id = {USER} GROUP BY ALL),
tk AS (SELECT fragment_id, token, max(s) AS s FROM parts GROUP BY ALL),
lex AS (SELECT fragment_id, sum(s) AS score FROM tk GROUP BY fragment_id ORDER BY score DESC, fragment_id LIMIT 50)"""


def _search_sql(fuzzy: bool) -> str:
    return f"WITH {_search_ctes(fuzzy)} SELECT fragment_id, round(score, 6) AS score FROM lex"


_VEC = "list_filter(embedding, lambda x : x IS NOT NULL AND isfinite(x::DOUBLE))"
_FINE = f"embedding IS NOT NULL AND len(embedding) = 128 AND len({_VEC}) = 128 AND list_sum(list_transform(embedding, lambda x : abs(x))) > 0"
_DIST = f"""q AS (SELECT embedding::DOUBLE[] AS v FROM semantic_fragments WHERE fragment_id = {ASKED}),
dist AS (SELECT message_id, user_id, list_cosine_distance(embedding::DOUBLE[], v) AS x FROM semantic_fragments, q WHERE {_FINE} AND message_id IS NOT NULL)"""
_RANKS = """lk AS (SELECT fragment_id, message_id FROM semantic_fragments WHERE message_id IS NOT NULL),
hits AS (SELECT 'l' AS list, search_id, fragment_id, max(score)::DOUBLE AS score FROM lexical_hit WHERE score > 0 AND isfinite(score::DOUBLE) AND fragment_id IS NOT NULL GROUP BY ALL
 UNION ALL SELECT 'g', search_id, fragment_id, max(score) FROM graph_hit WHERE score > 0 AND isfinite(score::DOUBLE) AND fragment_id IS NOT NULL GROUP BY ALL),
ord AS (SELECT list, search_id, fragment_id, message_id, row_number() OVER (PARTITION BY list, search_id ORDER BY score DESC, fragment_id) AS p FROM hits JOIN lk USING (fragment_id)),
firsts AS (SELECT list, search_id, message_id, min(p) AS p FROM ord GROUP BY ALL),
ranks AS (SELECT *, row_number() OVER (PARTITION BY list, search_id ORDER BY p, message_id) AS rank FROM firsts),
fused AS (SELECT search_id, message_id, sum(1.0 / (60 + rank)) AS score FROM ranks GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY round(score, 12) DESC, message_id) AS place FROM fused QUALIFY place <= 20)
"""
_U = "((('0x' || substr(sha256('0:' || fragment_id), 1, 12))::BIGINT)::DOUBLE + 0.5) / pow(16, 12)::DOUBLE"

_SEEDS = f"""r AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY score DESC, fragment_id) AS rn FROM lex),
dd AS (SELECT *, CASE WHEN n > 20 THEN n // 2 ELSE n END AS m, 50 * (CASE WHEN n > 20 THEN n // 2 ELSE n END) // 100 AS d FROM r),
rest AS (SELECT *, min(score) OVER () AS lo, max(score) OVER () AS hi FROM dd WHERE rn > d),
drawn AS (SELECT *, -ln({_U}) / exp((CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END - 1) / 0.4) AS c FROM rest),
seeds AS (SELECT fragment_id, score FROM dd WHERE rn <= d UNION ALL SELECT fragment_id, score FROM drawn QUALIFY row_number() OVER (ORDER BY c, fragment_id) <= m - d)"""
_TRAV = f"{_search_ctes(True)}, {_MAP}, {_SEEDS}, {_HOPS}"
_FAST = f"""WITH {_TRAV},
gh AS (SELECT m.fragment_id, max(b.score) AS score FROM map m JOIN best b ON b.node = m.node_id GROUP BY ALL),
hits AS (SELECT 'l' AS list, * FROM lex UNION ALL SELECT 'g', * FROM gh WHERE score > 0),
ord AS (SELECT list, message_id, row_number() OVER (PARTITION BY list ORDER BY score DESC, fragment_id) AS p FROM hits JOIN semantic_fragments USING (fragment_id) WHERE message_id IS NOT NULL),
firsts AS (SELECT list, message_id, min(p) AS p FROM ord GROUP BY ALL),
ranks AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY p, message_id) AS rank FROM firsts),
fused AS (SELECT message_id, sum(1.0 / (60 + rank)) AS score FROM ranks GROUP BY ALL)
SELECT message_id, round(score, 9) AS score, (row_number() OVER (ORDER BY round(score, 12) DESC, message_id))::INTEGER AS place FROM fused QUALIFY place <= 20"""

_JACCARD = f"""{_FOUND}, pk AS (SELECT DISTINCT user_id, phrase, keyword FROM found), sz AS (SELECT user_id, phrase, count(*) AS k FROM pk GROUP BY ALL),
sh AS (SELECT a.user_id, a.phrase AS phrase_a, b.phrase AS phrase_b, count(*) AS shared FROM pk a JOIN pk b ON a.user_id = b.user_id AND a.keyword = b.keyword AND a.phrase < b.phrase GROUP BY ALL),
jac AS (SELECT sh.*, shared / (x.k + y.k - shared)::DOUBLE AS overlap FROM sh JOIN sz x ON x.user_id = sh.user_id AND x.phrase = phrase_a JOIN sz y ON y.user_id = sh.user_id AND y.phrase = phrase_b)
"""

ORACLE = {
    "graph_edges": f"""WITH {_JACCARD}, fl AS (SELECT DISTINCT fragment_id, user_id, phrase FROM found),
co AS (SELECT a.user_id, a.phrase AS phrase_a, b.phrase AS phrase_b, count(*) AS n FROM fl a JOIN fl b ON a.fragment_id = b.fragment_id AND a.phrase < b.phrase GROUP BY ALL)
SELECT user_id, phrase_a AS label_a, phrase_b AS label_b, coalesce(n, 0) AS cooccurrence_count, coalesce(shared, 0) AS shared_keyword_count, round(coalesce(overlap, 0.0), 6) AS overlap_score FROM co FULL JOIN jac USING (user_id, phrase_a, phrase_b)""",
    "fast_search": _FAST,
    "node_attributes": f"""WITH {_FOUND}, e AS (SELECT nk.keyword, f.user_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM nk JOIN semantic_fragments f USING (fragment_id) WHERE {_FINE}),
kc AS (SELECT user_id, keyword, pos, avg(x) AS x FROM e GROUP BY ALL), pk AS (SELECT DISTINCT user_id, phrase, keyword FROM found),
pc AS (SELECT user_id, phrase, pos, avg(x)::FLOAT AS x FROM pk JOIN kc USING (user_id, keyword) GROUP BY ALL),
tot AS (SELECT user_id, phrase, round(sum(x::DOUBLE), 3) + 0.0 AS total FROM pc GROUP BY ALL)
SELECT user_id, f.phrase AS label, count(DISTINCT fragment_id)::INTEGER AS fragment_count, 0.0::FLOAT AS avg_similarity, true AS is_stable, any_value(total) AS total
FROM found f LEFT JOIN tot USING (user_id, phrase) GROUP BY user_id, f.phrase""",
    "map_fragments": f"""SELECT DISTINCT fragment_id, user_id, label, 1.0::FLOAT AS weight FROM (SELECT fragment_id, user_id, {_NORM} AS label FROM (SELECT fragment_id, user_id, unnest(noun_phrases) AS raw FROM semantic_fragments)) WHERE label <> '' AND user_id IS NOT NULL""",
    "lexical_by_user": f"WITH {_search_ctes(True).replace(f'WHERE user_id = {USER} ', 'WHERE user_id IS NOT NULL ').split('lex AS')[0]} every AS (SELECT fragment_id, sum(s) AS score FROM tk GROUP BY fragment_id) SELECT user_id, fragment_id, round(score, 6) AS score FROM every JOIN semantic_fragments USING (fragment_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 12) DESC, fragment_id) <= 50",
    "semantic_search_all": f"""WITH u AS (SELECT fragment_id, user_id, message_id, embedding::DOUBLE[] AS v FROM semantic_fragments WHERE {_FINE}),
dist AS (SELECT q.fragment_id AS query_id, o.message_id, min(list_cosine_distance(q.v, o.v)) AS x FROM u q JOIN u o USING (user_id) WHERE q.fragment_id % 100 = 0 AND o.message_id IS NOT NULL GROUP BY ALL)
SELECT query_id, message_id, round(x, 5) AS distance, (row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9), message_id))::INTEGER AS place FROM dist QUALIFY place <= 20""",
    "semantic_search_content": f"""WITH {_DIST}, top AS (SELECT message_id, min(x) AS x FROM dist WHERE user_id = {USER} GROUP BY message_id ORDER BY round(min(x), 12), message_id LIMIT 20),
txt AS (SELECT message_id, string_agg(coalesce(text, ''), chr(10) ORDER BY fragment_order NULLS FIRST, fragment_id) AS content FROM semantic_fragments GROUP BY message_id)
SELECT message_id, round(x, 6) AS distance, content FROM top LEFT JOIN txt USING (message_id)""",
    "phrase_centroid": f"""WITH {_FOUND}, e AS (SELECT nk.keyword, f.user_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM nk JOIN semantic_fragments f USING (fragment_id) WHERE {_FINE}),
kc AS (SELECT user_id, keyword, pos, avg(x) AS x FROM e GROUP BY ALL), pk AS (SELECT DISTINCT user_id, phrase, keyword FROM found),
pc AS (SELECT user_id, phrase, pos, avg(x) AS x, count(*) AS n FROM pk JOIN kc USING (user_id, keyword) GROUP BY ALL)
SELECT user_id, phrase, max(n) AS n, round(sum(x), 4) + 0.0 AS total FROM pc GROUP BY ALL""",
    "postings_tf": f"WITH {_POST} SELECT fragment_id, term, tf, dl::INTEGER AS dl FROM posts JOIN lens USING (fragment_id)",
    "term_df": f"WITH {_POST} SELECT term, df, cf FROM stats",
    "corpus_stats": f"WITH {_POST} SELECT n AS n_docs, round(avgdl, 6) AS avgdl FROM corpus",
    "keyword_bm25": f"WITH {_KW} SELECT fragment_id, term, round(score, 6) AS score FROM kw",
    "keyword_select": f"WITH {_SEL} SELECT fragment_id, term, rn::INTEGER AS place FROM sel",
    "lexical_exact_top50": _search_sql(False),
    "lexical_fuzzy_top50": _search_sql(True),
    "phrase_occurrence": f"WITH {_FOUND} SELECT user_id, phrase, count(DISTINCT fragment_id) AS n FROM found GROUP BY ALL",
    "phrase_keywords": f"WITH {_FOUND} SELECT user_id, phrase, string_agg(DISTINCT keyword, ',' ORDER BY keyword) AS keywords FROM found GROUP BY ALL",
    "keyword_phrases": f"WITH {_FOUND} SELECT user_id, keyword, string_agg(DISTINCT phrase, ',' ORDER BY phrase) AS phrases FROM found GROUP BY ALL",
    "keyword_centroid": f"""WITH {_FOUND}, e AS (SELECT nk.keyword, f.user_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM nk JOIN semantic_fragments f USING (fragment_id) WHERE {_FINE})
SELECT user_id, keyword, count(*) AS n, pos::INTEGER AS pos, round(avg(x), 4) + 0.0 AS x FROM e GROUP BY user_id, keyword, pos""",
    "phrase_pairs": f"""WITH ph AS (SELECT DISTINCT fragment_id, user_id, {_NORM} AS label FROM (SELECT fragment_id, user_id, unnest(noun_phrases) AS raw FROM semantic_fragments)), ok AS (SELECT * FROM ph WHERE label <> '')
SELECT a.user_id, a.label AS label_a, b.label AS label_b, count(*) AS n FROM ok a JOIN ok b ON a.fragment_id = b.fragment_id AND a.label < b.label GROUP BY ALL""",
    "node_fragment_counts": f"WITH {_MAP} SELECT node_id, c AS fragment_count FROM cnt",
    "direct_edges": f"WITH {_MAP} SELECT user_id, source_node_id, target_node_id, n AS cooccurrence_count FROM pairs",
    "npmi_edges": f"WITH {_MAP} SELECT user_id, source_node_id, target_node_id, round(npmi, 6) AS npmi FROM pos",
    "adjacency_top3": f"WITH {_MAP} SELECT user_id, node, neighbor, round(npmi, 6) AS npmi, edge_rank::INTEGER AS edge_rank FROM adj",
    "graph_traverse_3hop": f"WITH {_TRAV} SELECT node, round(score, 6) AS score FROM best",
    "graph_fragment_hits": f"""WITH {_TRAV} SELECT fragment_id, mapping_id, round(score, 6) AS score FROM (SELECT m.fragment_id, m.mapping_id, b.score FROM map m JOIN best b ON b.node = m.node_id
QUALIFY row_number() OVER (PARTITION BY m.fragment_id ORDER BY b.score DESC, m.mapping_id) = 1)""",
    "indirect_edges_jaccard": f"WITH {_JACCARD} SELECT user_id, phrase_a, phrase_b, shared, round(overlap, 6) AS overlap FROM jac",
    "rrf_fuse": f"WITH {_RANKS} SELECT search_id, message_id, round(score, 9) AS score, place::INTEGER AS place FROM top",
    "mrr_at_3": f"""WITH {_RANKS}, rel AS (SELECT search_id, message_id FROM firsts GROUP BY ALL HAVING count(*) = 2), f AS (SELECT search_id, min(place) AS r FROM top SEMI JOIN rel USING (search_id, message_id) GROUP BY ALL)
SELECT round(avg(CASE WHEN r <= 3 THEN 1.0 / r ELSE 0 END), 6) AS mrr, count(*) AS n_queries FROM (SELECT DISTINCT search_id FROM rel) LEFT JOIN f USING (search_id)""",
    "semantic_search": f"WITH {_DIST} SELECT message_id, round(min(x), 6) AS distance FROM dist WHERE user_id = {USER} GROUP BY message_id ORDER BY round(min(x), 12), message_id LIMIT 20",
    "message_min_distance": f"WITH {_DIST} SELECT message_id, round(min(x), 6) AS distance FROM dist GROUP BY message_id",
    "cosine_pairs": f"WITH u AS (SELECT fragment_id, embedding::DOUBLE[] AS v FROM semantic_fragments WHERE {_FINE}) SELECT a.fragment_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM u a JOIN u b ON b.fragment_id = a.fragment_id + 1",
    "user_fragment_counts": "SELECT user_id, count(*) AS n FROM semantic_fragments GROUP BY user_id",
    "latest_fragments": f"SELECT fragment_id, created_at FROM semantic_fragments WHERE user_id = {USER} ORDER BY created_at DESC NULLS LAST, fragment_id LIMIT 10",
    "user_messages": f"SELECT DISTINCT message_id, conversation_id FROM semantic_fragments WHERE message_id IN (SELECT message_id FROM semantic_fragments WHERE user_id = {USER})",
    "sample_wor": f"""WITH h AS (SELECT search_id, fragment_id, max(score) AS score FROM graph_hit WHERE score IS NOT NULL AND score::VARCHAR <> 'nan' GROUP BY ALL),
w AS (SELECT *, min(score) OVER p AS lo, max(score) OVER p AS hi FROM h WINDOW p AS (PARTITION BY search_id)),
c AS (SELECT *, -ln({_U}) / exp((CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END - 1) / 0.4) AS c FROM w)
SELECT search_id, fragment_id FROM c QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY c, fragment_id) <= 5""",
    "seed_select": f"""WITH h AS (SELECT search_id, fragment_id, max(score)::DOUBLE AS score FROM lexical_hit WHERE score IS NOT NULL AND score::VARCHAR <> 'nan' GROUP BY ALL),
r AS (SELECT *, count(*) OVER (PARTITION BY search_id) AS n, row_number() OVER (PARTITION BY search_id ORDER BY score DESC, fragment_id) AS rn FROM h),
m AS (SELECT *, CASE WHEN n > 20 THEN n // 2 ELSE n END AS m FROM r), dd AS (SELECT *, 50 * m // 100 AS d FROM m),
rest AS (SELECT *, min(score) OVER p AS lo, max(score) OVER p AS hi FROM dd WHERE rn > d WINDOW p AS (PARTITION BY search_id)),
c AS (SELECT *, -ln({_U}) / exp((CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END - 1) / 0.4) AS c FROM rest)
SELECT search_id, fragment_id, false AS drawn FROM dd WHERE rn <= d
UNION ALL SELECT search_id, fragment_id, true FROM c QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY c, fragment_id) <= m - d""",
}
