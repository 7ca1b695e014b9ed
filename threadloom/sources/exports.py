"""Reading chat exports: schemas, provider registry, content units, accounts and hash-based deduplication."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.errors import EngineError, ingestion_failed
from threadloom.functions.hashing import conversation_hash, role_hash
from threadloom.functions.text import canonical_email, conversation_url, normalize_content

#: Schema of an export record (fixed values: the export format).
INPUT = "struct<id:string,type:string,title:string,command:string,content:string,language:string,version_uuid:string>"
CONTENT = f"struct<type:string,text:string,thinking:string,message:string,name:string,citations:array<string>,content:array<string>,display_content:string,input:{INPUT}>"
ATTACHMENT = "struct<id:string,file_name:string,file_size:bigint,file_type:string,extracted_content:string>"
FILE = "struct<file_uuid:string,file_name:string,file_type:string,file_size:bigint,created_at:timestamp>"
MESSAGE = f"struct<uuid:string,parent_message_uuid:string,index:int,text:string,sender:string,created_at:timestamp,updated_at:timestamp,content:array<{CONTENT}>,attachments:array<{ATTACHMENT}>,files:array<{FILE}>>"
EXPORT_SCHEMA = f"uuid string, name string, summary string, created_at timestamp, updated_at timestamp, account struct<uuid:string,email:string>, chat_messages array<{MESSAGE}>"
USER_SCHEMA = "uuid string, full_name string, email_address string, verified_phone_number string"


def read_claude(spark: SparkSession, path: str, array_file: bool = True) -> DataFrame:
    """Records of a conversation export: one JSON array per file, or one record per line (which splits, so it suits large files). Unknown fields are passed over."""
    return spark.read.schema(EXPORT_SCHEMA).option("multiLine", array_file).json(path)


def _unsupported(name: str) -> Callable[..., DataFrame]:
    def read(*_args, **_kw) -> DataFrame:
        raise EngineError(f"no reader for exports of {name}", "UNSUPPORTED_PROVIDER", 400)

    return read


READERS: dict[str, Callable[..., DataFrame]] = {"CLAUDE": read_claude, "CHAT_GPT": _unsupported("CHAT_GPT"), "GEMINI": _unsupported("GEMINI")}


def read_export(spark: SparkSession, provider: str, path: str, **options) -> DataFrame:
    """Records of an export by its provider; providers without a reader are an explicit error, failures carry INGESTION_FAILED."""
    reader = READERS.get(provider.upper(), _unsupported(provider))
    try:
        return reader(spark, path, **options)
    except EngineError:
        raise
    except Exception as e:
        raise ingestion_failed(e) from e


def read_user(spark: SparkSession, path: str) -> DataFrame:
    """(uuid, full_name, email) of the first record of a user export; an export without one is an error."""
    rows = spark.read.schema(USER_SCHEMA).option("multiLine", True).json(path).limit(1)
    if rows.isEmpty():
        raise EngineError("the user export has no record", "INGESTION_FAILED", 400)
    return rows.select("uuid", "full_name", canonical_email("email_address").alias("email"))


def resolve_account(records: DataFrame, accounts: DataFrame) -> DataFrame:
    """Records with affiliated_email_id and llm_id of their account. `accounts` has (uuid, email_id, llm_id), each uuid once counted.

    A record that names no account belongs to the batch's first one; a batch that names none at all gives no records. An account that is
    not in `accounts` gets nulls.
    """
    known = accounts.select(F.col("uuid").alias("__u"), F.col("email_id").alias("affiliated_email_id"), "llm_id").dropDuplicates(["__u"])
    named = records.agg(F.min_by(F.col("account.uuid"), F.when(F.col("account.uuid").isNotNull(), F.struct(F.col("created_at"), F.col("uuid")))).alias("__batch"))
    whole = records.drop("affiliated_email_id", "llm_id").crossJoin(F.broadcast(named)).filter("__batch is not null")  # one row
    return whole.withColumn("__u", F.coalesce("account.uuid", "__batch")).join(known, "__u", "left").drop("__u", "__batch")


def users_by_email(users: DataFrame, email: str) -> DataFrame:
    """The users (user_id, email) of an email address, however spelled."""
    return users.filter(canonical_email("email") == canonical_email(F.lit(email)))


def llms_of_email(llms: DataFrame, emails: DataFrame, email_id: int) -> DataFrame:
    """The llms (llm_id, ...) that own an affiliated email (email_id, llm_id): a semi-join."""
    return llms.join(emails.filter(F.col("email_id") == email_id).select("llm_id"), "llm_id", "left_semi")


def latest_of(rows: DataFrame, owner: str, value: int, n: int = 1, created: str = "created_at", tie: str | None = None) -> DataFrame:
    """The `n` last created rows of an owner; rows without a time come last."""
    return rows.filter(F.col(owner) == value).orderBy(F.col(created).desc_nulls_last(), *([tie] if tie else [])).limit(n)


def first_account(records: DataFrame) -> DataFrame:
    """One row (account_uuid): the first account of a batch in order of delivery, null where none has one."""
    return records.agg(F.min_by(F.col("account.uuid"), F.when(F.col("account.uuid").isNotNull(), F.col("delivery_id"))).alias("account_uuid"))


def units(content: Column) -> Column:
    """array<struct<type, text, raw, language, artifact_type>> of a message's content: text blocks with a text, and tool inputs as code; other blocks drop out.

    A tool input without code or language carries the word null, as stored data has it.
    """
    text = lambda b: F.struct(F.lit("TEXT").alias("type"), b.text.alias("text"), normalize_content(b.text).alias("raw"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("artifact_type"))
    word = lambda c: F.coalesce(c, F.lit("null"))
    code = lambda b: F.struct(F.lit("CODE").alias("type"), word(b.input.content).alias("text"), word(b.input.content).alias("raw"), word(b.input.language).alias("language"), word(b.input.type).alias("artifact_type"))
    is_text = lambda b: (b.type == "text") & b.text.isNotNull()
    kept = F.filter(content, lambda b: F.coalesce(is_text(b) | ((b.type == "tool_use") & b.input.isNotNull()), F.lit(False)))
    return F.transform(kept, lambda b: F.when(b.type == "text", text(b)).otherwise(code(b)))


def unit_rows(exports: DataFrame) -> DataFrame:
    """(delivery_id, msg_pos, unit_pos, type, text, language) of every unit."""
    m = exports.select("delivery_id", F.posexplode("chat_messages").alias("msg_pos", "m"))
    return m.select("delivery_id", "msg_pos", F.posexplode(units(F.col("m.content"))).alias("unit_pos", "u")).select("delivery_id", "msg_pos", "unit_pos", "u.type", "u.text", "u.language")


def messages(exports: DataFrame) -> DataFrame:
    """(delivery_id, msg_pos, role, text, hash, n_units) of the messages with at least one unit; text is their units joined by blank lines, normalised."""
    m = exports.select("delivery_id", F.posexplode("chat_messages").alias("msg_pos", "m")).select("delivery_id", "msg_pos", F.col("m.sender").alias("role"), units(F.col("m.content")).alias("u")).filter(F.size("u") > 0)
    text = normalize_content(F.array_join(F.transform("u", lambda x: x.text), "\n\n"))
    return m.select("delivery_id", "msg_pos", "role", text.alias("text"), F.size("u").alias("n_units")).withColumn("hash", role_hash("role", "text"))


def conversations(exports: DataFrame) -> DataFrame:
    """(delivery_id, title, url, hash) of the records."""
    return exports.select("delivery_id", F.col("name").alias("title"), conversation_url("uuid").alias("url"), conversation_hash("uuid", "name", "summary", "chat_messages").alias("hash"))


def dedupe_by_hash(rows: DataFrame, order: list[str], hash_column: str = "hash", stored: DataFrame | None = None, scope: list[str] | None = None) -> DataFrame:
    """The first row of each hash by `order`, without hashes that are stored already. Scope is everything, or the given columns. Of rows
    equal in hash, scope and order one stays.

    The first is a minimum per hash, combined before the shuffle, so a hash that a third of all rows share does not make a large task. Null
    hashes and scopes are values like others.
    """
    keys = [*(scope or []), hash_column]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__first")).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(f"__first.{o}").alias(f"__o{i}") for i, o in enumerate(order)])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col(o).eqNullSafe(F.col(f"__o{i}")) for i, o in enumerate(order)])
    kept = rows.join(first, same, "left_semi").dropDuplicates([*keys, *order])
    return kept.join(stored.select(hash_column).distinct(), hash_column, "left_anti") if stored is not None else kept


def sequence(kept: DataFrame, conversation: str, order: str) -> DataFrame:
    """`kept` with sequence_number from 0 within each conversation."""
    return kept.withColumn("sequence_number", F.row_number().over(Window.partitionBy(conversation).orderBy(order)) - 1)


def number_of(digest: Column) -> Column:
    """A positive BIGINT from the first 60 bits of a hex digest: an id that depends on the content alone, so a second load gives the same."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def identified(records: DataFrame) -> DataFrame:
    """Records with their content hash and conversation_id from it, equal records once. Records without uuid are told apart by their content."""
    hashed = records.withColumn("hash", conversation_hash(*[c for c in ("uuid", "name", "summary", "created_at", "updated_at", "account", "chat_messages") if c in records.columns]))
    return hashed.dropDuplicates(["hash"]).withColumn("conversation_id", number_of(F.col("hash")))


def message_rows(records: DataFrame) -> DataFrame:
    """(message_id, conversation_id, msg_pos, role, content, text, hash) of the messages with at least one unit, of `identified` records.

    content is the array of units, text their joined text as in `messages`; message_id follows from the record's hash and the position.
    """
    m = records.select("conversation_id", F.col("hash").alias("__h"), F.posexplode("chat_messages").alias("msg_pos", "m"))
    m = m.select("conversation_id", "__h", "msg_pos", F.col("m.sender").alias("role"), units(F.col("m.content")).alias("content")).filter(F.size("content") > 0)
    text = normalize_content(F.array_join(F.transform("content", lambda x: x.text), "\n\n"))
    rows = m.select("conversation_id", "msg_pos", "role", "content", text.alias("text"), number_of(F.sha2(F.concat_ws(":", "__h", "msg_pos"), 256)).alias("message_id"))
    return rows.withColumn("hash", role_hash("role", "text"))


def text_units(messages: DataFrame, key: str) -> DataFrame:
    """(key, unit_pos, text) of the TEXT units of messages with a `content` array; code units give none."""
    return messages.select(key, F.posexplode("content").alias("unit_pos", "u")).filter(F.col("u.type") == "TEXT").select(key, "unit_pos", F.col("u.text").alias("text"))
