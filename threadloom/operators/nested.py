"""Nested export records as related flat tables (problem 5).

Every object gets a Merkle identity: the SHA-256 of its canonical scalar fields and of the identities of its children,
computed bottom-up; a null, a missing element and an empty array or text are told apart. `occurrences` holds one row for each occurrence with its parent's identity and its ordinal (the bridge);
`objects` holds each distinct object once. Identities are built inside the record with higher-order functions, so one
explode and no shuffle produce the bridge below the records; `rooted` adds the records themselves by a join on delivery_id, and
`objects` shuffles on the identity itself, with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scalar fields of each kind in canonical order (fixed values: the export format).
SCALARS = {
    "conversation": ["uuid", "name", "summary", "created_at", "updated_at", "account_uuid", "account_email"],
    "message": ["uuid", "parent_message_uuid", "index", "text", "sender", "created_at", "updated_at"],
    "content": ["type", "text", "thinking", "message", "name", "display_content"],
    "input": ["id", "type", "title", "command", "content", "language", "version_uuid"],
    "attachment": ["id", "file_name", "file_size", "file_type", "extracted_content"],
    "file": ["file_uuid", "file_name", "file_type", "file_size", "created_at"],
}


def canonical_json(c: Column) -> Column:
    """JSON text with sorted keys and no blanks; text that is not JSON as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)


def _fields(x: Column, kind: str) -> list[Column]:
    fields = [x.getField(f).cast("string") for f in SCALARS[kind]]
    if kind == "content":
        fields[-1] = canonical_json(fields[-1])
    return fields


def _scalars(x: Column, kind: str) -> Column:
    """The scalar fields as readable JSON; null ones are left out."""
    return F.to_json(F.struct(*[f.alias(n) for f, n in zip(_fields(x, kind), SCALARS[kind])]))


def _row(kind: str, msg: Column, block: Column, item: Column, node: Column, parent: Column, body: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), msg.cast("int").alias("msg_pos"), block.cast("int").alias("block_pos"), item.cast("int").alias("item_pos"),
        node.alias("node_hash"), parent.alias("parent_hash"), body.alias("body"),
    )


def _told(c: Column) -> Column:
    """A value with its length before it, so that no two lists of values read alike; ~ for null."""
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("~"))


def _children(c: Column) -> Column:
    """The identities of an array's elements, - for a null one; a null array is ~, an empty one []."""
    return F.coalesce(F.concat(F.lit("["), F.array_join(c, ",", "-"), F.lit("]")), F.lit("~"))


def _digest(kind: str, values: list[Column], *children: Column) -> Column:
    """The identity of an object: of its kind, its canonical values and its children's identities. What differs in null and empty differs."""
    return F.sha2(F.concat_ws("|", F.lit(kind), *map(_told, values), *map(_children, children)), 256)


def _leaves(values: Column, kind: str, fields, body) -> Column:
    """array<struct<pos, body, hash>> of the elements; null where the element is null."""
    return F.transform(values, lambda x, i: F.when(x.isNotNull(), F.struct(i.alias("pos"), body(x).alias("body"), _digest(kind, fields(x)).alias("hash"))))


def _structs(values: Column, kind: str) -> Column:
    return _leaves(values, kind, lambda x: _fields(x, kind), lambda x: _scalars(x, kind))


def _texts(values: Column, kind: str) -> Column:
    return _leaves(values, kind, lambda x: [canonical_json(x)], canonical_json)


def _block(b: Column, j: Column) -> Column:
    cit, nest = _texts(b.getField("citations"), "citation"), _texts(b.getField("content"), "nested")
    inp = _structs(F.array(b.getField("input")), "input")
    own = F.array(*_fields(b, "content"))
    return F.when(b.isNotNull(), F.struct(j.alias("pos"), _scalars(b, "content").alias("body"), own.alias("own"), cit.alias("cit"), nest.alias("nest"), inp.alias("inp")))


def _each(own: Column, kind: str) -> list[Column]:
    return [F.get(own, F.lit(i)) for i in range(len(SCALARS[kind]))]


def _hashes(leaves: Column) -> Column:
    return F.transform(leaves, lambda x: x.getField("hash"))


def _block_hashed(b: Column) -> Column:
    node = _digest("content", _each(b.getField("own"), "content"), _hashes(b.getField("cit")), _hashes(b.getField("nest")), _hashes(b.getField("inp")))
    return F.when(b.isNotNull(), F.struct(b.getField("pos").alias("pos"), b.getField("body").alias("body"), node.alias("hash"), b.getField("cit").alias("cit"), b.getField("nest").alias("nest"), b.getField("inp").alias("inp")))


def _message(m: Column, i: Column) -> Column:
    blocks = F.transform(F.transform(m.getField("content"), _block), _block_hashed)
    atts, files = _structs(m.getField("attachments"), "attachment"), _structs(m.getField("files"), "file")
    own = F.array(*_fields(m, "message"))
    return F.when(m.isNotNull(), F.struct(i.alias("pos"), _scalars(m, "message").alias("body"), own.alias("own"), blocks.alias("blocks"), atts.alias("atts"), files.alias("files")))


def _present(values: Column) -> Column:
    return F.filter(F.coalesce(values, F.array()), lambda x: x.isNotNull())


def _message_hash(m: Column) -> Column:
    return _digest("message", _each(m.getField("own"), "message"), _hashes(m.getField("blocks")), _hashes(m.getField("atts")), _hashes(m.getField("files")))


def _message_rows(m: Column, node: Column) -> Column:
    """All bridge rows at and below one message with the identity `node`."""
    pos, none = m.getField("pos"), F.lit(-1)

    def below(values: Column, kind: str, block: Column, parent: Column) -> Column:
        return F.transform(_present(values), lambda x: _row(kind, pos, block, x.getField("pos"), x.getField("hash"), parent, x.getField("body")))

    def block_rows(b: Column) -> Column:
        me = b.getField("hash")
        inputs = F.transform(_present(b.getField("inp")), lambda x: _row("input", pos, b.getField("pos"), F.lit(0), x.getField("hash"), me, x.getField("body")))
        return F.concat(
            F.array(_row("content", pos, none, b.getField("pos"), me, F.lit(None).cast("string"), b.getField("body"))),
            below(b.getField("cit"), "citation", b.getField("pos"), me), below(b.getField("nest"), "nested", b.getField("pos"), me), inputs,
        )

    blocks = F.flatten(F.transform(_present(m.getField("blocks")), block_rows))
    rows = F.concat(blocks, below(m.getField("atts"), "attachment", none, F.lit(None).cast("string")), below(m.getField("files"), "file", none, F.lit(None).cast("string")))
    return F.concat(
        F.array(_row("message", pos, none, pos, node, F.lit(None).cast("string"), m.getField("body"))),
        F.transform(rows, lambda r: r.withField("parent_hash", F.coalesce(r.getField("parent_hash"), node))),
    )


def _messages_hashed(exports: DataFrame) -> DataFrame:
    """(delivery_id, t, node) of each non-null message."""
    messages = exports.select("delivery_id", F.posexplode("chat_messages").alias("i", "m")).filter(F.col("m").isNotNull())
    staged = messages.select("delivery_id", _message(F.col("m"), F.col("i")).alias("t"))
    return staged.withColumn("node", _message_hash(F.col("t")))


def roots(exports: DataFrame) -> DataFrame:
    """The conversations as objects, one row per delivered record in the columns of the bridge; positions are -1 and there is no parent.

    The identity is that of the record's own fields, without delivery_id and batch_no, and of its messages in order (a null message counts
    as in the arrays below), so a record delivered again unchanged is the same object. The hashes of a record's messages shuffle, not its content.
    """
    hashes = _messages_hashed(exports).groupBy("delivery_id").agg(F.sort_array(F.collect_list(F.struct(F.col("t.pos").alias("pos"), F.col("node").alias("hash")))).alias("found"))
    flat = exports.withColumns({"account_uuid": F.col("account.uuid"), "account_email": F.col("account.email")})
    whole = F.struct(*SCALARS["conversation"])
    rows = flat.select("delivery_id", _scalars(whole, "conversation").alias("body"), F.array(*_fields(whole, "conversation")).alias("own"), F.when(F.col("chat_messages").isNotNull(), F.size("chat_messages")).alias("n"))
    rows = rows.join(hashes, "delivery_id", "left")
    at = F.map_from_entries(F.coalesce("found", F.array().cast("array<struct<pos:int,hash:string>>")))
    places = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).when(F.col("n") == 0, F.array().cast("array<int>"))
    children = F.transform(places, lambda i: F.try_element_at(F.col("at"), i))
    none, null = F.lit(-1), F.lit(None).cast("string")
    keyed = rows.withColumn("at", at).withColumn("node", _digest("conversation", _each(F.col("own"), "conversation"), children))
    return keyed.select("delivery_id", _row("conversation", none, none, none, F.col("node"), null, F.col("body")).alias("r")).select("delivery_id", "r.*")


def rooted(exports: DataFrame) -> DataFrame:
    """The bridge with its roots: `occurrences` with the conversation as each message's parent, and `roots`."""
    top = roots(exports)
    below = occurrences(exports).join(top.select("delivery_id", F.col("node_hash").alias("root")), "delivery_id")
    below = below.withColumn("parent_hash", F.when(F.col("kind") == "message", F.col("root")).otherwise(F.col("parent_hash"))).drop("root")
    return below.unionByName(top)


def occurrences(exports: DataFrame) -> DataFrame:
    """The bridge: (delivery_id, kind, msg_pos, block_pos, item_pos, node_hash, parent_hash, body), one row per non-null element.

    Positions count from 0 and include null elements, which give no row themselves. Null and empty arrays give nothing. block_pos is
    -1 for kinds that hang on a message. A struct without any field set is an element. A message's parent_hash is null:
    its parent is the record `delivery_id`. Repeated elements keep one row each and share a node_hash. An empty table gives no rows.

    One explode yields messages (the only unbounded array of a record), a second the rows below each message.
    """
    hashed = _messages_hashed(exports)
    rows = hashed.select("delivery_id", F.explode(_message_rows(F.col("t"), F.col("node"))).alias("r"))
    out = rows.select("delivery_id", "r.*")
    return out.withColumn("parent_hash", F.when(F.col("kind") != "message", F.col("parent_hash")))


def objects(bridge: DataFrame) -> DataFrame:
    """Each distinct object once: (node_hash, kind, body, n_occurrences). Equal subtrees have equal hashes."""
    return bridge.groupBy("node_hash", "kind").agg(F.min("body").alias("body"), F.count(F.lit(1)).alias("n_occurrences"))


def conversations(exports: DataFrame) -> DataFrame:
    """The root table: one row per delivered record with the account's fields beside it; nulls stay null."""
    return exports.select(
        "delivery_id", "batch_no", "uuid", "name", "summary", "created_at", "updated_at",
        F.col("account.uuid").alias("account_uuid"), F.col("account.email").alias("account_email"),
        F.coalesce(F.size(F.filter("chat_messages", lambda m: m.isNotNull())), F.lit(0)).alias("n_messages"),
    )


def typed(exports: DataFrame, kind: str) -> DataFrame:
    """The flat table of one kind with its own columns, its position and its parent's position: message, content, input, attachment, file, citation or nested.

    Citations and nested items are JSON texts, given as delivered.
    """
    m = exports.select("delivery_id", F.posexplode("chat_messages").alias("msg_pos", "m")).filter(F.col("m").isNotNull())
    if kind == "message":
        return m.select("delivery_id", "msg_pos", *[F.col(f"m.`{c}`").alias(c) for c in SCALARS[kind]])
    if kind in ("attachment", "file"):
        e = m.select("delivery_id", "msg_pos", F.posexplode(f"m.{kind}s").alias("item_pos", "e"))
        return e.filter(F.col("e").isNotNull()).select("delivery_id", "msg_pos", "item_pos", *[F.col(f"e.`{c}`").alias(c) for c in SCALARS[kind]])
    b = m.select("delivery_id", "msg_pos", F.posexplode("m.content").alias("block_pos", "b")).filter(F.col("b").isNotNull())
    if kind == "content":
        return b.select("delivery_id", "msg_pos", "block_pos", *[F.col(f"b.`{c}`").alias(c) for c in SCALARS[kind]])
    if kind == "input":
        return b.filter(F.col("b.input").isNotNull()).select("delivery_id", "msg_pos", "block_pos", *[F.col(f"b.input.`{c}`").alias(c) for c in SCALARS[kind]])
    if kind in ("citation", "nested"):
        e = b.select("delivery_id", "msg_pos", "block_pos", F.posexplode("b.citations" if kind == "citation" else "b.content").alias("item_pos", "value"))
        return e.filter(F.col("value").isNotNull())
    raise ValueError(f"no such kind: {kind}")
