"""The pN_ queries of the general problems (5 and 6), with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import dedupe, nested
from threadloom.session import cut, table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.occurrences(table(spark, d, "conversation_export")).select("delivery_id", "msg_pos", "block_pos", "kind", "item_pos")


def p5_objects(spark: SparkSession, d: str) -> DataFrame:
    return nested.objects(nested.rooted(table(spark, d, "conversation_export")))


def p5_bridge(spark: SparkSession, d: str) -> DataFrame:
    return nested.rooted(table(spark, d, "conversation_export")).drop("body")


def p5_conversations(spark: SparkSession, d: str) -> DataFrame:
    return nested.conversations(table(spark, d, "conversation_export"))


def _typed(kind: str):
    return lambda spark, d: nested.typed(table(spark, d, "conversation_export"), kind)


def _identities(spark: SparkSession, d: str, keep: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    exports = table(spark, d, "conversation_export")
    chat = dedupe.chat_identity(table(spark, d, "chat_message"), keep)
    return {"chat_message": cut(chat), "conversation_export": dedupe.export_identity(exports, keep)}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [dedupe.superseded(ids).select(F.lit(name).alias("source_table"), "delivery_id") for name, ids in _identities(spark, d).items()]
    return parts[0].unionAll(parts[1])


def p6_last_batch(spark: SparkSession, d: str) -> DataFrame:
    """What the last arrival batch of each table changes in the store of all batches before it: new messages, and the stored arrivals that newer ones replace."""
    parts = []
    for name, ids in _identities(spark, d, ("batch_no",)).items():
        last = table(spark, d, name).agg(F.max("batch_no").alias("b")).first().b
        changed = dedupe.merge_arrivals(ids.filter(F.col("batch_no") == last), ids.filter(F.col("batch_no") < last))
        parts.append(changed.select(F.lit(name).alias("source_table"), "delivery_id", "replaces"))
    return parts[0].unionAll(parts[1])


QUERIES = {
    "p5_found": p5_found,
    "p5_objects": p5_objects,
    "p5_bridge": p5_bridge,
    "p5_conversations": p5_conversations,
    "p5_messages": _typed("message"),
    "p5_contents": _typed("content"),
    "p5_inputs": _typed("input"),
    "p5_attachments": _typed("attachment"),
    "p5_files": _typed("file"),
    "p5_citations": _typed("citation"),
    "p5_nested": _typed("nested"),
    "p6_found": p6_found,
    "p6_last_batch": p6_last_batch,
}

SAME_MESSAGE = """
msgs AS (SELECT delivery_id, coalesce(conversation_uuid, '') AS conv,
                nullif(lower(replace(replace(replace(trim(uuid), '-', ''), '{', ''), '}', '')), '') AS k,
                coalesce(hash, sha256(coalesce(CASE WHEN lower(regexp_replace(sender, '^\\s+|\\s+$', '', 'g')) IN ('human', 'user') THEN 'human'
                    WHEN lower(regexp_replace(sender, '^\\s+|\\s+$', '', 'g')) IN ('assistant', 'model') THEN 'assistant' END, trim(sender), '') || '::' ||
                    coalesce(trim(regexp_replace(text, '[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{3000}]+', ' ', 'g')), ''))) AS digest
         FROM chat_message),
owners AS (SELECT conv, digest, min(k) AS k0, max(k) AS k1 FROM msgs WHERE k IS NOT NULL GROUP BY ALL),
ids AS (SELECT delivery_id, k AS mk FROM msgs WHERE k IS NOT NULL
        UNION ALL SELECT m.delivery_id, CASE WHEN k0 IS NULL THEN 'hash:' || m.conv || ':' || m.digest WHEN k0 = k1 THEN k0 ELSE 'alone:' || m.delivery_id END
        FROM msgs m LEFT JOIN owners o USING (conv, digest) WHERE m.k IS NULL),
kept AS (SELECT mk, max(delivery_id) AS delivery_id FROM ids GROUP BY mk)
"""
_MESSAGES = """
m AS (SELECT delivery_id, generate_subscripts(chat_messages, 1) - 1 AS msg_pos, unnest(chat_messages) AS m FROM conversation_export),
b AS (SELECT delivery_id, msg_pos, generate_subscripts(m.content, 1) - 1 AS pos, unnest(m.content) AS e FROM m WHERE m IS NOT NULL)
"""
_EXPORT_KEYS = """
ids AS (SELECT delivery_id, batch_no, coalesce(nullif(lower(replace(replace(replace(trim(uuid), '-', ''), '{', ''), '}', '')), ''), 'alone:' || delivery_id) AS mk FROM conversation_export)
"""

def _told(values: list[str]) -> str:
    return " || '|' || ".join(f"coalesce(length({v}) || ':' || {v}, '~')" for v in values)


def _canonical(v: str) -> str:
    """JSON text with sorted keys; the test data's objects have one level of keys."""
    keys = f"list_sort(json_keys({v}))"
    pairs = f"list_transform({keys}, lambda k : to_json(k)::VARCHAR || ':' || json_extract({v}, '$.\"' || k || '\"')::VARCHAR)"
    return f"CASE WHEN NOT json_valid({v}) THEN {v} WHEN json_type({v}) = 'OBJECT' THEN '{{' || array_to_string({pairs}, ',') || '}}' ELSE json({v})::VARCHAR END"


def _body(fields: list[str], values: list[str]) -> str:
    return "json_merge_patch('{}', to_json(struct_pack(" + ", ".join(f'"{f}" := {v}' for f, v in zip(fields, values)) + ")))::VARCHAR"


def _object(kind: str, alias: str) -> tuple[str, str]:
    """(the values of the identity, the body) of an object in SQL."""
    names = {"account_uuid": "account.uuid", "account_email": "account.email"}
    values = [f"{alias}{names.get(f, f)}::VARCHAR" for f in nested.SCALARS[kind]]
    if kind == "content":
        values[-1] = f"({_canonical(alias + 'display_content')})"
    return f"'{kind}|' || {_told(values)}", _body(nested.SCALARS[kind], values)


def _array(table: str, values: str, key: str) -> str:
    """The children of each parent: null, empty and null elements told apart."""
    return f"coalesce('[' || (SELECT string_agg(coalesce(h, '-'), ',' ORDER BY pos) FROM {table} WHERE {key}) || ']', CASE WHEN {values} IS NULL THEN '~' ELSE '[]' END)"


def _merkle() -> str:
    """CTEs of the bridge: leaves, blocks, messages and conversations with their identities, in `bridge`."""
    def leaf(name: str, kind: str, rows: str, values: str, body: str) -> str:
        return f"{name} AS (SELECT *, CASE WHEN e IS NOT NULL THEN sha256({values}) END AS h, {body} AS body FROM ({rows}))"

    def text(name: str, field: str, kind: str) -> str:
        rows = f"SELECT delivery_id, msg_pos, pos AS block, generate_subscripts(e.{field}, 1) - 1 AS pos, unnest(e.{field}) AS e FROM b WHERE e IS NOT NULL"
        return leaf(name, kind, rows, f"'{kind}|' || {_told(['(' + _canonical('e') + ')'])}", _canonical("e"))

    def struct(name: str, field: str, kind: str) -> str:
        rows = f"SELECT delivery_id, msg_pos, generate_subscripts(m.{field}, 1) - 1 AS pos, unnest(m.{field}) AS e FROM m WHERE m IS NOT NULL"
        return leaf(name, kind, rows, *_object(kind, "e."))

    at_block, at_msg = "{t}.delivery_id = b.delivery_id AND {t}.msg_pos = b.msg_pos AND {t}.block = b.pos", "{t}.delivery_id = m.delivery_id AND {t}.msg_pos = m.msg_pos"
    block = f"({_object('content', 'e.')[0]}) || '|' || {_array('c', 'e.citations', at_block.format(t='c'))} || '|' || {_array('n', 'e.content', at_block.format(t='n'))} || '|' || '[' || coalesce((SELECT any_value(h) FROM i WHERE {at_block.format(t='i')}), '-') || ']'"
    message = f"({_object('message', 'm.')[0]}) || '|' || {_array('k', 'm.content', at_msg.format(t='k'))} || '|' || {_array('a', 'm.attachments', at_msg.format(t='a'))} || '|' || {_array('f', 'm.files', at_msg.format(t='f'))}"
    root = f"({_object('conversation', '')[0]}) || '|' || {_array('s', 'chat_messages', 's.delivery_id = x.delivery_id')}"
    return f"""{_MESSAGES},
{text('c', 'citations', 'citation')}, {text('n', 'content', 'nested')}, {struct('a', 'attachments', 'attachment')}, {struct('f', 'files', 'file')},
{leaf('i', 'input', "SELECT delivery_id, msg_pos, pos AS block, 0 AS pos, e.input AS e FROM b WHERE e IS NOT NULL", *_object('input', 'e.'))},
k AS (SELECT *, CASE WHEN e IS NOT NULL THEN sha256({block}) END AS h, {_object('content', 'e.')[1]} AS body FROM b),
s AS (SELECT delivery_id, msg_pos AS pos, m, CASE WHEN m IS NOT NULL THEN sha256({message}) END AS h, {_object('message', 'm.')[1]} AS body FROM m),
r AS (SELECT delivery_id, sha256({root}) AS h, {_object('conversation', '')[1]} AS body FROM conversation_export x),
bridge AS (SELECT delivery_id, 'conversation' AS kind, -1 AS msg_pos, -1 AS block_pos, -1 AS item_pos, h AS node_hash, NULL AS parent_hash, body FROM r
UNION ALL SELECT delivery_id, 'message', s.pos, -1, s.pos, s.h, r.h, s.body FROM s JOIN r USING (delivery_id) WHERE s.m IS NOT NULL
UNION ALL SELECT k.delivery_id, 'content', k.msg_pos, -1, k.pos, k.h, s.h, k.body FROM k JOIN s ON s.delivery_id = k.delivery_id AND s.pos = k.msg_pos WHERE k.e IS NOT NULL
UNION ALL SELECT a.delivery_id, 'attachment', a.msg_pos, -1, a.pos, a.h, s.h, a.body FROM a JOIN s ON s.delivery_id = a.delivery_id AND s.pos = a.msg_pos WHERE a.e IS NOT NULL
UNION ALL SELECT f.delivery_id, 'file', f.msg_pos, -1, f.pos, f.h, s.h, f.body FROM f JOIN s ON s.delivery_id = f.delivery_id AND s.pos = f.msg_pos WHERE f.e IS NOT NULL
UNION ALL SELECT c.delivery_id, 'citation', c.msg_pos, c.block, c.pos, c.h, k.h, c.body FROM c JOIN k ON k.delivery_id = c.delivery_id AND k.msg_pos = c.msg_pos AND k.pos = c.block WHERE c.e IS NOT NULL
UNION ALL SELECT n.delivery_id, 'nested', n.msg_pos, n.block, n.pos, n.h, k.h, n.body FROM n JOIN k ON k.delivery_id = n.delivery_id AND k.msg_pos = n.msg_pos AND k.pos = n.block WHERE n.e IS NOT NULL
UNION ALL SELECT i.delivery_id, 'input', i.msg_pos, i.block, 0, i.h, k.h, i.body FROM i JOIN k ON k.delivery_id = i.delivery_id AND k.msg_pos = i.msg_pos AND k.pos = i.block WHERE i.e IS NOT NULL)"""


def _flat(expr: str, source: str, where: str) -> str:
    return f"WITH {_MESSAGES} SELECT {expr} FROM {source} WHERE {where}"


def oracle() -> dict[str, str]:
    return {
        "p5_found": f"""WITH {_MESSAGES},
a AS (SELECT delivery_id, msg_pos, generate_subscripts(m.attachments, 1) - 1 AS pos, unnest(m.attachments) AS e FROM m WHERE m IS NOT NULL),
f AS (SELECT delivery_id, msg_pos, generate_subscripts(m.files, 1) - 1 AS pos, unnest(m.files) AS e FROM m WHERE m IS NOT NULL),
c AS (SELECT delivery_id, msg_pos, pos AS block, generate_subscripts(e.citations, 1) - 1 AS pos, unnest(e.citations) AS x FROM b WHERE e IS NOT NULL),
n AS (SELECT delivery_id, msg_pos, pos AS block, generate_subscripts(e.content, 1) - 1 AS pos, unnest(e.content) AS x FROM b WHERE e IS NOT NULL)
SELECT delivery_id, msg_pos::INTEGER AS msg_pos, -1 AS block_pos, 'message' AS kind, msg_pos::INTEGER AS item_pos FROM m WHERE m IS NOT NULL
UNION ALL SELECT delivery_id, msg_pos, -1, 'content', pos FROM b WHERE e IS NOT NULL
UNION ALL SELECT delivery_id, msg_pos, -1, 'attachment', pos FROM a WHERE e IS NOT NULL
UNION ALL SELECT delivery_id, msg_pos, -1, 'file', pos FROM f WHERE e IS NOT NULL
UNION ALL SELECT delivery_id, msg_pos, block, 'citation', pos FROM c WHERE x IS NOT NULL
UNION ALL SELECT delivery_id, msg_pos, block, 'nested', pos FROM n WHERE x IS NOT NULL
UNION ALL SELECT delivery_id, msg_pos, pos, 'input', 0 FROM b WHERE e IS NOT NULL AND e.input IS NOT NULL""",
        "p5_bridge": f"WITH {_merkle()} SELECT delivery_id, kind, msg_pos::INTEGER AS msg_pos, block_pos::INTEGER AS block_pos, item_pos::INTEGER AS item_pos, node_hash, parent_hash FROM bridge",
        "p5_objects": f"WITH {_merkle()} SELECT node_hash, kind, min(body) AS body, count(*) AS n_occurrences FROM bridge GROUP BY node_hash, kind",
        "p5_citations": _flat("delivery_id, msg_pos::INTEGER AS msg_pos, block::INTEGER AS block_pos, pos::INTEGER AS item_pos, e AS value", "(SELECT delivery_id, msg_pos, pos AS block, generate_subscripts(e.citations, 1) - 1 AS pos, unnest(e.citations) AS e FROM b WHERE e IS NOT NULL)", "e IS NOT NULL"),
        "p5_nested": _flat("delivery_id, msg_pos::INTEGER AS msg_pos, block::INTEGER AS block_pos, pos::INTEGER AS item_pos, e AS value", "(SELECT delivery_id, msg_pos, pos AS block, generate_subscripts(e.content, 1) - 1 AS pos, unnest(e.content) AS e FROM b WHERE e IS NOT NULL)", "e IS NOT NULL"),
        "p5_messages": _flat("delivery_id, msg_pos::INTEGER AS msg_pos, m.uuid AS uuid, m.parent_message_uuid AS parent_message_uuid, m.index AS index, m.text AS text, m.sender AS sender, m.created_at AS created_at, m.updated_at AS updated_at", "m", "m IS NOT NULL"),
        "p5_contents": _flat("delivery_id, msg_pos::INTEGER AS msg_pos, pos::INTEGER AS block_pos, e.type AS type, e.text AS text, e.thinking AS thinking, e.message AS message, e.name AS name, e.display_content AS display_content", "b", "e IS NOT NULL"),
        "p5_inputs": _flat("delivery_id, msg_pos::INTEGER AS msg_pos, pos::INTEGER AS block_pos, e.input.id AS id, e.input.type AS type, e.input.title AS title, e.input.command AS command, e.input.content AS content, e.input.language AS language, e.input.version_uuid AS version_uuid", "b", "e IS NOT NULL AND e.input IS NOT NULL"),
        "p5_attachments": _flat("delivery_id, msg_pos::INTEGER AS msg_pos, pos::INTEGER AS item_pos, e.id AS id, e.file_name AS file_name, e.file_size AS file_size, e.file_type AS file_type, e.extracted_content AS extracted_content", "(SELECT delivery_id, msg_pos, generate_subscripts(m.attachments, 1) - 1 AS pos, unnest(m.attachments) AS e FROM m WHERE m IS NOT NULL)", "e IS NOT NULL"),
        "p5_files": _flat("delivery_id, msg_pos::INTEGER AS msg_pos, pos::INTEGER AS item_pos, e.file_uuid AS file_uuid, e.file_name AS file_name, e.file_type AS file_type, e.file_size AS file_size, e.created_at AS created_at", "(SELECT delivery_id, msg_pos, generate_subscripts(m.files, 1) - 1 AS pos, unnest(m.files) AS e FROM m WHERE m IS NOT NULL)", "e IS NOT NULL"),
        "p5_conversations": "SELECT delivery_id, batch_no, uuid, name, summary, created_at, updated_at, account.uuid AS account_uuid, account.email AS account_email, coalesce(len(list_filter(chat_messages, lambda m : m IS NOT NULL)), 0)::INTEGER AS n_messages FROM conversation_export",
        "p6_found": f"""WITH {SAME_MESSAGE}, {_EXPORT_KEYS.replace('ids AS', 'xids AS')}
SELECT 'chat_message' AS source_table, delivery_id FROM ids ANTI JOIN kept USING (delivery_id)
UNION ALL SELECT 'conversation_export', delivery_id FROM xids WHERE delivery_id NOT IN (SELECT max(delivery_id) FROM xids GROUP BY mk)""",
        "p6_last_batch": f"""WITH {SAME_MESSAGE}, {_EXPORT_KEYS.replace('ids AS', 'xids AS')},
every AS (SELECT 'chat_message' AS source_table, i.delivery_id, i.mk, c.batch_no FROM ids i JOIN chat_message c USING (delivery_id) UNION ALL SELECT 'conversation_export', delivery_id, mk, batch_no FROM xids),
lb AS (SELECT source_table, max(batch_no) AS b FROM every GROUP BY ALL),
fresh AS (SELECT source_table, mk, max(delivery_id) AS delivery_id FROM every JOIN lb USING (source_table) WHERE batch_no = b GROUP BY ALL),
old AS (SELECT source_table, mk, max(delivery_id) AS replaces FROM every JOIN lb USING (source_table) WHERE batch_no < b GROUP BY ALL)
SELECT source_table, delivery_id, replaces FROM fresh LEFT JOIN old USING (source_table, mk) WHERE replaces IS NULL OR delivery_id > replaces""",
    }
