"""Exactly one copy of each message that was delivered at least once (problem 6).

Rows are partitioned by message identifier and ranked by arrival; the latest arrival stays. Arrival numbers are unique,
so "rank 1" is the maximum per identifier, which Spark combines before the shuffle: a message whose copies make up a third
of the table costs one partial row per task. The copies to drop are then all arrivals anti-joined with the kept ones on the
unique arrival number, a join that cannot be skewed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.identity import message_hash, uuid_key
from threadloom.operators.skew import keyed_join
from threadloom.session import cut


def chat_identity(chat: DataFrame, keep: Sequence[str | Column] = ()) -> DataFrame:
    """(delivery_id, message_key, keep...) of each row of a chat_message table, as a table in the shared folder.

    The key is the normalised uuid. A row without uuid takes the key of the one message of its conversation that has a row of
    equal hash; without such a message it shares a key with the other uuid-less rows of equal hash of the conversation, and
    where several messages have the hash it stays alone. A null hash is computed; null sender or text count as ''.
    Empty input gives an empty result; other columns of `chat` are ignored.

    The texts are read once, for a compact table of conversation, key and hash. Only hashes that a row without uuid has are looked up,
    and such rows, of which any number may share conversation and hash, meet their owner through `keyed_join`.
    """
    kept = chat.select(*keep).columns
    rows = cut(chat.select(
        "delivery_id",
        F.coalesce("conversation_uuid", F.lit("")).alias("__conv"),
        uuid_key("uuid").alias("__key"),
        F.coalesce(F.col("hash"), message_hash("sender", "text")).alias("__digest"),
        *keep,
    ))
    bare = rows.filter(F.col("__key").isNull())
    named = rows.filter(F.col("__key").isNotNull())
    wanted = bare.select("__conv", "__digest").distinct()
    owners = named.select("__conv", "__digest", "__key").join(wanted, ["__conv", "__digest"], "left_semi")
    owners = owners.groupBy("__conv", "__digest").agg(F.min("__key").alias("first_key"), F.max("__key").alias("last_key"))
    key = (
        F.when(F.col("first_key").isNull(), F.concat_ws(":", F.lit("hash"), "__conv", "__digest"))
        .when(F.col("first_key") == F.col("last_key"), F.col("first_key"))
        .otherwise(F.concat(F.lit("alone:"), F.col("delivery_id").cast("string")))
    )
    adopted = keyed_join(bare, owners, ["__conv", "__digest"], "left").select("delivery_id", key.alias("message_key"), *kept)
    return named.select("delivery_id", F.col("__key").alias("message_key"), *kept).unionAll(adopted)


def export_identity(exports: DataFrame, keep: Sequence[str | Column] = ()) -> DataFrame:
    """(delivery_id, message_key, keep...) of each export record: its normalised uuid; a record without uuid stays alone."""
    key = F.coalesce(uuid_key("uuid"), F.concat(F.lit("alone:"), F.col("delivery_id").cast("string")))
    return exports.select("delivery_id", key.alias("message_key"), *keep)


def kept_arrivals(identity: DataFrame, arrival: str = "delivery_id", key: str = "message_key") -> DataFrame:
    """(key, arrival) of the copy that stays: the highest arrival number of each key."""
    return identity.groupBy(key).agg(F.max(arrival).alias(arrival))


def superseded(identity: DataFrame, arrival: str = "delivery_id", key: str = "message_key") -> DataFrame:
    """The arrivals to remove: all but the kept one of each key. Every key keeps exactly one row."""
    kept = kept_arrivals(identity, arrival, key).select(arrival)
    return identity.select(arrival).join(kept, arrival, "left_anti")


def merge_arrivals(batch: DataFrame, stored: DataFrame, arrival: str = "delivery_id", key: str = "message_key") -> DataFrame:
    """(key, arrival, replaces) of what a batch changes in the store: the latest copy of each identifier, with the stored arrival it takes the place of.

    `replaces` is null for identifiers the store does not hold; those are `new_arrivals`. A copy that arrived before the stored one changes
    nothing and has no row. Both sides are one row per identifier before they meet, so no identifier is a hot key.
    """
    old = kept_arrivals(stored, arrival, key).withColumnRenamed(arrival, "replaces")
    return kept_arrivals(batch, arrival, key).join(old, key, "left").filter(F.col("replaces").isNull() | (F.col(arrival) > F.col("replaces")))


def new_arrivals(batch: DataFrame, stored: DataFrame, arrival: str = "delivery_id", key: str = "message_key") -> DataFrame:
    """(key, arrival): the latest copy of each identifier of `batch` that is not stored yet, what an append-only load writes."""
    return kept_arrivals(batch, arrival, key).join(stored.select(key).distinct(), key, "left_anti")
