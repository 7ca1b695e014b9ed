"""Queries of text functions, hashes, ingestion and deduplication, over whole tables, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.functions import hashing, text, vectors
from threadloom.functions.identity import message_hash
from threadloom.operators import fragments as frag
from threadloom.operators import phrases
from threadloom.session import shared_folder, table
from threadloom.sources import exports
from threadloom.sources.store import Store
from threadloom.streaming import ingest

_TRIM = r"'^[\x00-\x20]+|[\x00-\x20]+$'"


def _phr(s, d):
    return table(s, d, "semantic_fragments").select("fragment_id", F.posexplode("noun_phrases").alias("pos", "phrase"))


def _lines(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def _role_rows(s, d):
    return table(s, d, "chat_message").select("delivery_id", F.coalesce("sender", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", hashing.role_hash("role", "text"))


def dedupe_messages(s, d):
    return exports.dedupe_by_hash(_role_rows(s, d), ["delivery_id"]).select("delivery_id", "hash")


def dedupe_by_conversation(s, d):
    rows = table(s, d, "chat_message").select("delivery_id", "conversation_uuid", "hash").filter("hash is not null")
    return exports.dedupe_by_hash(rows, ["delivery_id"], scope=["conversation_uuid"]).select("delivery_id")


def sequence_numbers(s, d):
    rows = table(s, d, "chat_message").select("delivery_id", "conversation_uuid", "hash").filter("hash is not null and conversation_uuid is not null")
    kept = exports.dedupe_by_hash(rows, ["delivery_id"])
    return exports.sequence(kept, "conversation_uuid", "delivery_id").select("delivery_id", "conversation_uuid", "sequence_number")


def _hashed(s, d):
    """Every message with its stored hash, computed where that is null."""
    return table(s, d, "chat_message").select("delivery_id", "conversation_uuid", F.coalesce("hash", message_hash("sender", "text")).alias("hash"))


def dedupe_by_conversation_whole(s, d):
    """dedupe_by_conversation over all messages, also those without a stored hash."""
    return exports.dedupe_by_hash(_hashed(s, d), ["delivery_id"], scope=["conversation_uuid"]).select("delivery_id")


def sequence_numbers_whole(s, d):
    """sequence_numbers over all messages of a conversation, also those without a stored hash."""
    kept = exports.dedupe_by_hash(_hashed(s, d).filter("conversation_uuid is not null"), ["delivery_id"])
    return exports.sequence(kept, "conversation_uuid", "delivery_id").select("delivery_id", "conversation_uuid", "sequence_number")


def noun_phrases(s, d):
    return phrases.noun_phrases(table(s, d, "semantic_fragments"), "fragment_id", "text").select("fragment_id", F.explode("phrases").alias("phrase"))


def chunk_faithful(s, d):
    out = frag.fragment_messages(table(s, d, "documents"), "doc_id", "text", "faithful")
    return out.select("doc_id", "fragment_order", "text", "confidence", "hash")


def chunk_paragraph(s, d):
    out = frag.fragment_messages(table(s, d, "documents"), "doc_id", "text", "paragraph")
    return out.select("doc_id", "fragment_order", "text", F.round("confidence", 6).alias("confidence"), "hash")


def ingest_fragments(s, d):
    """The fragments of every text unit of the delivered records; code gives none."""
    units = exports.unit_rows(table(s, d, "conversation_export")).filter("type = 'TEXT'")
    keyed = units.select(F.concat_ws("/", "delivery_id", "msg_pos").alias("message"), "unit_pos", "text")
    out = frag.fragment_units(keyed, "message")
    at = F.split("message", "/")
    return out.select(at[0].cast("bigint").alias("delivery_id"), at[1].cast("int").alias("msg_pos"), "unit_pos", "fragment_order", "text", "confidence", "hash")


def chunk_vectors(s, d):
    """Each message's fragments, in their order, folded by centroid and drift of their stored vectors."""
    rows = table(s, d, "semantic_fragments").filter(F.col("message_id").isNotNull() & vectors.usable("embedding", 128))
    pos = F.row_number().over(Window.partitionBy("message_id").orderBy(F.col("fragment_order").asc_nulls_first(), "fragment_id"))
    parts = rows.select("message_id", pos.alias("pos"), F.coalesce("text", F.lit("")).alias("paragraph"), "embedding")
    out = frag.chunk(parts, "message_id", threshold=0.1, drift=0.9)
    return out.select("message_id", "fragment_order", "n_parts", (F.round("confidence", 5) + 0.0).alias("confidence"))


QUERIES = {
    "norm_words": lambda s, d: _phr(s, d).select("fragment_id", "pos", text.normalize_words("phrase").alias("norm")),
    "norm_phrase": lambda s, d: _phr(s, d).select("fragment_id", "pos", text.normalize_phrase("phrase").alias("norm")),
    "norm_content": lambda s, d: table(s, d, "chat_message").select("delivery_id", text.normalize_content("text").alias("norm")),
    "query_tokens": lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(text.query_tokens("text"), " ").alias("tokens")),
    "code_line_score": lambda s, d: _lines(s, d).select("doc_id", "pos", text.code_line_score("line").alias("score")),
    "code_strip": lambda s, d: table(s, d, "documents").select("doc_id", text.strip_code("text").alias("text")),
    "markdown_norm": lambda s, d: table(s, d, "documents").select("doc_id", text.normalize_markdown("text").alias("text")),
    "semantic_noise": lambda s, d: table(s, d, "chat_message").select("delivery_id", text.semantic_noise("text").alias("noise")),
    "identifier_tokens": lambda s, d: table(s, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", r"[^\w.]+"))).alias("token")).filter(text.is_identifier("token")),
    "phrase_trim": lambda s, d: _phr(s, d).select("fragment_id", "pos", text.trim_phrase("phrase").alias("phrase")),
    "message_hash": lambda s, d: _role_rows(s, d).select("delivery_id", "hash"),
    "fragment_hash": lambda s, d: table(s, d, "semantic_fragments").select("fragment_id", hashing.fragment_hash("message_id", "fragment_order", "text").alias("hash")),
    "phrase_hash": lambda s, d: _phr(s, d).select("fragment_id", "pos", hashing.phrase_hash("phrase").alias("hash")),
    "conversation_hash": lambda s, d: exports.conversations(table(s, d, "conversation_export")),
    "conversation_url": lambda s, d: exports.conversations(table(s, d, "conversation_export")).select("delivery_id", "title", "url"),
    "account_email": lambda s, d: table(s, d, "conversation_export").select("delivery_id", text.canonical_email("account.email").alias("email")),
    "first_account": lambda s, d: exports.first_account(table(s, d, "conversation_export")),
    "extract_units": lambda s, d: exports.unit_rows(table(s, d, "conversation_export")),
    "unit_messages": lambda s, d: exports.messages(table(s, d, "conversation_export")),
    "dedupe_messages": dedupe_messages,
    "dedupe_by_conversation": dedupe_by_conversation,
    "sequence_numbers": sequence_numbers,
    "dedupe_by_conversation_whole": dedupe_by_conversation_whole,
    "sequence_numbers_whole": sequence_numbers_whole,
    "paragraph_split": lambda s, d: frag.paragraphs(table(s, d, "documents"), ["doc_id"], "text"),
    "pair_parse": lambda s, d: table(s, d, "search_edge_stats").select("edge_id", text.parse_pair(text.pair_key("source_node_id", "target_node_id")).alias("p")).select("edge_id", "p.a", "p.b"),
    "noun_phrases": noun_phrases,
    "chunk_faithful": chunk_faithful,
    "chunk_paragraph": chunk_paragraph,
    "chunk_vectors": chunk_vectors,
    "ingest_fragments": ingest_fragments,
}

_PHR = "(SELECT fragment_id, (generate_subscripts(noun_phrases, 1) - 1)::INTEGER AS pos, unnest(noun_phrases) AS phrase FROM semantic_fragments)"
_W = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_NORM = "array_to_string(list_filter(list_transform(regexp_split_to_array(trim(phrase), '\\s+'), lambda w : regexp_replace(lower(w), '[^a-z0-9]', '', 'g')), lambda w : w <> ''), ' ')"
_CONTENT = "coalesce(regexp_replace(regexp_replace({}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), '[\\s\\x0b]+', ' ', 'g'), '')"
_LINES = "(SELECT doc_id, (generate_subscripts(l, 1) - 1)::INTEGER AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"
_CODE_WORDS = text.CODE_WORDS.replace("'", "''")
_SCORE = f"""CASE WHEN t = '' THEN 0.0 ELSE
 CASE WHEN regexp_matches(t, '{_CODE_WORDS}') THEN 2.0::DOUBLE ELSE 0 END
 + CASE WHEN regexp_matches(t, '[;{{}}]$') THEN 1.5 ELSE 0 END
 + CASE WHEN (length(t) - length(regexp_replace(t, '[{{}}();<>\\[\\]=&|%$#@]', '', 'g'))) / length(t)::DOUBLE >= 0.18 THEN 1.5 ELSE 0 END
 + CASE WHEN length(line) - length(regexp_replace(line, '^[\\s\\x0b]+', '')) >= 4 OR starts_with(line, chr(9)) THEN 1.0 ELSE 0 END
 + CASE WHEN regexp_matches(t, '^.*"[A-Za-z0-9_]+"\\s*:\\s*.*$') THEN 1.5 ELSE 0 END
 + CASE WHEN len(list_filter(regexp_split_to_array(t, '[\\s\\x0b]+'), lambda x : regexp_matches(x, '^([a-z]+[A-Z][a-zA-Z0-9]*|[a-z0-9_]+_[a-z0-9_]+)$'))) >= 2 THEN 1.0 ELSE 0 END END"""
_SCORED = f"(SELECT doc_id, pos, line, {_SCORE} AS score FROM (SELECT *, regexp_replace(line, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS t FROM @ROWS))"
_UNITS = """m AS (SELECT delivery_id, (generate_subscripts(chat_messages, 1) - 1)::INTEGER AS msg_pos, unnest(chat_messages) AS m FROM conversation_export),
b AS (SELECT delivery_id, msg_pos, m.sender AS role, generate_subscripts(m.content, 1) AS p, unnest(m.content) AS e FROM m),
k AS (SELECT delivery_id, msg_pos, role, p, CASE WHEN e.type = 'text' THEN 'TEXT' ELSE 'CODE' END AS type,
        CASE WHEN e.type = 'text' THEN e.text ELSE coalesce(e.input.content, 'null') END AS text, CASE WHEN e.type = 'text' THEN NULL ELSE coalesce(e.input.language, 'null') END AS language
      FROM b WHERE (e.type = 'text' AND e.text IS NOT NULL) OR (e.type = 'tool_use' AND e.input IS NOT NULL))"""

_STRIPPED = f"""l AS (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INTEGER AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '`[^`]*`', ' code ', 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
j AS (SELECT doc_id, string_agg(CASE WHEN score >= 2.0 THEN chr(64976) ELSE line || chr(10) END, '' ORDER BY pos) AS t FROM {_SCORED.replace("@ROWS", "l")} GROUP BY doc_id),
stripped AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, chr(64976) || '+', ' ', 'g'), '[ \\t]{{2,}}', ' ', 'g'), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS text FROM documents LEFT JOIN j USING (doc_id))"""
_MARKED = """p AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\*+', '', 'g'), '(?m)^#+\\s*', '', 'g'), '(?m)^\\s*[-*+]\\s*', '', 'g'), '(?m)^\\s*\\d+\\.\\s*', '', 'g') AS t FROM @ROWS),
ll AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x : regexp_replace(x, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')), lambda x : x <> '') AS l FROM p),
jj AS (SELECT doc_id, CASE WHEN l IS NULL THEN NULL WHEN len(l) = 0 THEN '' ELSE list_reduce(l, lambda acc, x : CASE WHEN regexp_matches(acc, '[.!?:]$') THEN acc || ' ' || x ELSE acc || '. ' || x END) END AS t FROM ll),
marked AS (SELECT doc_id, trim(regexp_replace(t, '[\\s\\x0b]+', ' ', 'g'), ' ') AS text FROM jj)"""

ORACLE = {
    "chunk_faithful": f"""WITH {_STRIPPED}, {_MARKED.replace("@ROWS", "stripped")}
SELECT doc_id, 1 AS fragment_order, text, 0.0::DOUBLE AS confidence, sha256(concat_ws('::', doc_id, 1, {_CONTENT.format("text")})) AS hash FROM marked WHERE length(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')) >= 3""",
    "norm_words": f"SELECT fragment_id, pos, {_W.format('phrase')} AS norm FROM {_PHR}",
    "norm_phrase": f"SELECT fragment_id, pos, {_NORM} AS norm FROM {_PHR}",
    "norm_content": f"SELECT delivery_id, {_CONTENT.format('text')} AS norm FROM chat_message",
    "query_tokens": """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS l FROM documents)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i : list_position(l, x) = i), ' ') AS tokens FROM t""",
    "code_line_score": f"SELECT doc_id, pos, score FROM {_SCORED.replace("@ROWS", _LINES)}",
    "code_strip": f"WITH {_STRIPPED} SELECT doc_id, text FROM stripped",
    "markdown_norm": f"WITH {_MARKED.replace('@ROWS', 'documents')} SELECT doc_id, text FROM marked",
    "identifier_tokens": """WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '[^\\w.]+')) AS token FROM documents)
SELECT doc_id, token FROM t WHERE length(token) >= 3 AND lower(token) NOT IN ('e.g', 'i.e', 'etc', 'vs', 'a.k.a') AND regexp_matches(token, '[A-Za-z]')
AND regexp_matches(token, '^(?:[a-z]+(?:[A-Z][A-Za-z0-9]*)+|[A-Z][a-z0-9]*(?:[A-Z][A-Za-z0-9]*)+|\\w+(?:_\\w+)+|\\w+(?:\\.\\w+)+|[A-Za-z]+\\d+[A-Za-z0-9]*)$')""",
    "phrase_trim": f"""WITH w AS (SELECT fragment_id, pos, regexp_split_to_array(trim(phrase, ' '), '\\s+') AS w FROM {_PHR}),
i AS (SELECT *, list_filter(range(1, len(w) + 1), lambda k : lower(w[k]) NOT IN ({", ".join(f"'{x}'" for x in text.EDGE_WORDS)}) AND regexp_matches(w[k], '[\\p{{L}}\\p{{N}}]')) AS solid FROM w),
k AS (SELECT *, CASE WHEN len(solid) > 0 THEN w[list_min(solid):list_max(solid)] END AS kept FROM i)
SELECT fragment_id, pos, CASE WHEN len(kept) <= 6 AND length(array_to_string(kept, ' ')) >= 2 THEN array_to_string(kept, ' ') END AS phrase FROM k""",
    "semantic_noise": "SELECT delivery_id, coalesce(length(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')) < 3, true) AS noise FROM chat_message",
    "message_hash": f"SELECT delivery_id, sha256(coalesce(sender, '') || '::' || {_CONTENT.format('text')}) AS hash FROM chat_message",
    "fragment_hash": f"SELECT fragment_id, sha256(concat_ws('::', message_id, fragment_order, {_CONTENT.format('text')})) AS hash FROM semantic_fragments",
    "phrase_hash": f"SELECT fragment_id, pos, sha256({_NORM}) AS hash FROM {_PHR}",
    "conversation_url": "SELECT delivery_id, name AS title, 'https://claude.ai/chat/' || uuid AS url FROM conversation_export",
    "account_email": "SELECT delivery_id, lower(trim(account.email)) AS email FROM conversation_export",
    "first_account": "SELECT arg_min(account.uuid, delivery_id) FILTER (account.uuid IS NOT NULL) AS account_uuid FROM conversation_export",
    "extract_units": f"WITH {_UNITS} SELECT delivery_id, msg_pos, (row_number() OVER (PARTITION BY delivery_id, msg_pos ORDER BY p) - 1)::INTEGER AS unit_pos, type, text, language FROM k",
    "unit_messages": f"""WITH {_UNITS}, j AS (SELECT delivery_id, msg_pos, role, {_CONTENT.format("string_agg(text, chr(10) || chr(10) ORDER BY p)")} AS text, count(*)::INTEGER AS n_units FROM k GROUP BY ALL)
SELECT *, sha256(concat_ws('::', role, text)) AS hash FROM j""",
    "dedupe_messages": f"SELECT min(delivery_id) AS delivery_id, sha256(coalesce(sender, '') || '::' || {_CONTENT.format('text')}) AS hash FROM chat_message GROUP BY 2",
    "dedupe_by_conversation": "SELECT min(delivery_id) AS delivery_id FROM chat_message WHERE hash IS NOT NULL GROUP BY conversation_uuid, hash",
    "sequence_numbers": """WITH k AS (SELECT min(delivery_id) AS delivery_id FROM chat_message WHERE hash IS NOT NULL AND conversation_uuid IS NOT NULL GROUP BY hash)
SELECT delivery_id, conversation_uuid, (row_number() OVER (PARTITION BY conversation_uuid ORDER BY delivery_id) - 1)::INTEGER AS sequence_number FROM chat_message SEMI JOIN k USING (delivery_id)""",
    "paragraph_split": """WITH p AS (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INTEGER AS pos, unnest(l) AS raw FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n\\r?\\n') AS l FROM documents WHERE text IS NOT NULL))
SELECT doc_id, pos, regexp_replace(raw, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS paragraph FROM p WHERE length(regexp_replace(raw, '[^a-zA-Z0-9]', '', 'g')) >= 3""",
    "pair_parse": "SELECT edge_id, least(source_node_id, target_node_id) AS a, greatest(source_node_id, target_node_id) AS b FROM search_edge_stats",
}


_KEY = "lower(replace(replace(replace(trim(uuid), '-', ''), '{', ''), '}', ''))"


def streaming_ingest(s, d):
    """The delivered export records through file streams into a store: what it then holds.

    The records of the first half of the batches arrive in one file, the others in a second, each a micro-batch; then a stream with a new
    checkpoint reads both again, which adds nothing.
    """
    source = table(s, d, "conversation_export").select("delivery_id", "batch_no", "uuid", "name")
    base = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    store = Store(s, f"{base}/store")
    half = source.agg(F.floor(F.max("batch_no") / 2).alias("b")).first().b
    for part, checkpoint in ((source.filter(F.col("batch_no") <= half), "check"), (source.filter(F.col("batch_no") > half), "check"), (source.limit(0), "other")):
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        records = ingest.read_stream(s, f"{base}/in", 1, "parquet", source.schema)
        ingest.ingest_stream(records, store, f"{base}/{checkpoint}", arrival="delivery_id").awaitTermination()
    return store.read("records").select("message_key", "delivery_id")


QUERIES["streaming_ingest"] = streaming_ingest
ORACLE["streaming_ingest"] = f"""WITH k AS (SELECT {_KEY} AS message_key, delivery_id, batch_no <= (SELECT max(batch_no) // 2 FROM conversation_export) AS early FROM conversation_export WHERE {_KEY} <> '')
SELECT message_key, coalesce(max(delivery_id) FILTER (early), max(delivery_id)) AS delivery_id FROM k GROUP BY message_key"""
ORACLE["ingest_fragments"] = f"""WITH {_UNITS}, kk AS (SELECT *, row_number() OVER (PARTITION BY delivery_id, msg_pos ORDER BY p) - 1 AS unit_pos FROM k),
u AS (SELECT delivery_id || '/' || msg_pos || '/' || unit_pos AS doc_id, text FROM kk WHERE type = 'TEXT'),
{_STRIPPED.replace("documents", "u")}, {_MARKED.replace("@ROWS", "stripped")}
SELECT split_part(doc_id, '/', 1)::BIGINT AS delivery_id, split_part(doc_id, '/', 2)::INTEGER AS msg_pos, split_part(doc_id, '/', 3)::INTEGER AS unit_pos, 1 AS fragment_order, text, 0.0::DOUBLE AS confidence,
 sha256(split_part(doc_id, '/', 1) || '/' || split_part(doc_id, '/', 2) || '::1::' || {_CONTENT.format("text")}) AS hash
FROM marked WHERE length(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')) >= 3"""
_FITS = f"""(NOT regexp_matches(t, '^[^\\p{{L}}\\p{{N}}]*$') AND lower(t) NOT IN ({", ".join(f"'{w}'" for w in sorted(text.STOP_WORDS))}))
 OR (length(t) >= 3 AND lower(t) NOT IN ({", ".join(f"'{w}'" for w in text.NOT_IDENTIFIERS)}) AND regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '{text.IDENTIFIER.replace("(?=\\S*[A-Za-z])", "")}'))"""
#: Sentences, words, runs of words that fit, their edges trimmed; of phrases equal but for case the first counts.
ORACLE["noun_phrases"] = f"""WITH s AS (SELECT fragment_id, generate_subscripts(l, 1) AS sn, unnest(l) AS sentence FROM (SELECT fragment_id, regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+') AS l FROM semantic_fragments WHERE text <> '')),
t AS (SELECT fragment_id, sn, generate_subscripts(w, 1) AS tn, unnest(w) AS t FROM (SELECT *, regexp_extract_all(sentence, '[\\p{{L}}\\p{{N}}_]+(?:[._''-][\\p{{L}}\\p{{N}}_]+)*|[^\\p{{L}}\\p{{N}}_\\s]') AS w FROM s)),
f AS (SELECT *, {_FITS} AS fits FROM t),
g AS (SELECT *, sum((NOT fits)::INT) OVER (PARTITION BY fragment_id, sn ORDER BY tn) AS run FROM f),
r AS (SELECT fragment_id, sn, min(tn) AS tn, list(t ORDER BY tn) AS w FROM g WHERE fits GROUP BY fragment_id, sn, run),
i AS (SELECT *, list_filter(range(1, len(w) + 1), lambda k : lower(w[k]) NOT IN ({", ".join(f"'{x}'" for x in text.EDGE_WORDS)}) AND regexp_matches(w[k], '[\\p{{L}}\\p{{N}}]')) AS solid FROM r),
p AS (SELECT fragment_id, sn, tn, w[list_min(solid):list_max(solid)] AS w FROM i WHERE len(solid) > 0),
q AS (SELECT fragment_id, sn, tn, array_to_string(w, ' ') AS phrase FROM p WHERE len(w) <= 6 AND length(array_to_string(w, ' ')) >= 2)
SELECT fragment_id, arg_min(phrase, sn * 1000000 + tn) AS phrase FROM q GROUP BY fragment_id, lower(phrase)"""
ORACLE["chunk_vectors"] = """WITH RECURSIVE e AS (SELECT message_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY message_id ORDER BY fragment_order NULLS FIRST, fragment_id) AS pos FROM semantic_fragments
 WHERE message_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 128 AND len(list_filter(embedding, lambda x : x IS NOT NULL AND isfinite(x::DOUBLE))) = 128 AND list_sum(list_transform(embedding, lambda x : abs(x))) > 0),
-- the state after each part: chunk number, its size, mean and first vector, the last similarity, and what the chunk before ended with
f AS (SELECT message_id, pos, 1 AS chunk, 1 AS n, v AS mean, v AS first, 1.0::DOUBLE AS sim, NULL::DOUBLE AS ended, 0 AS closed FROM e WHERE pos = 1
 UNION ALL
 SELECT message_id, pos, CASE WHEN joins THEN chunk ELSE chunk + 1 END, CASE WHEN joins THEN n + 1 ELSE 1 END, CASE WHEN joins THEN list_transform(list_zip(mean, v), lambda z : (z[1] * n + z[2]) / (n + 1)) ELSE v END,
        CASE WHEN joins THEN first ELSE v END, s, CASE WHEN joins THEN NULL ELSE 1 - s END, CASE WHEN joins THEN 0 ELSE n END
 FROM (SELECT f.message_id, e.pos, f.chunk, f.n, f.mean, f.first, e.v, list_cosine_similarity(f.mean, e.v) AS s, list_cosine_similarity(f.mean, e.v) > 0.1 AND 1 - list_cosine_similarity(f.first, e.v) < 0.9 AS joins
       FROM f JOIN e ON e.message_id = f.message_id AND e.pos = f.pos + 1)),
ends AS (SELECT message_id, chunk - 1 AS fragment_order, closed AS n_parts, ended AS confidence FROM f WHERE closed > 0
 UNION ALL SELECT message_id, chunk, n, 1 - sim FROM f QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY pos DESC) = 1)
SELECT message_id, fragment_order::INTEGER AS fragment_order, n_parts::INTEGER AS n_parts, round(confidence, 5) + 0.0 AS confidence FROM ends"""
