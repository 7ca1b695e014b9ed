"""Incremental ingest: a file stream of export records, deduplicated against the store in every micro-batch."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.functions.identity import uuid_key
from threadloom.operators.dedupe import kept_arrivals
from threadloom.sources.exports import EXPORT_SCHEMA
from threadloom.sources.store import Store


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 20, fmt: str = "json", schema: str = EXPORT_SCHEMA) -> DataFrame:
    """Export records as they arrive in a folder, a bounded number of files per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(folder)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark gave to the stream of a checkpoint folder; a new folder, also at the place of an old one, is a new stream."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]


def append_new(batch: DataFrame, part: str, store: Store, name: str = "records", key: str = "uuid", arrival: str | None = None) -> None:
    """Append to the table `name` of the store the records of a batch that it does not hold yet, one copy of each.

    Of copies within the batch the one with the highest `arrival` stays; without such a column, or where it ties, the content decides, so a
    second run gives the same. `part` names the batch among all streams: one that is stored whole is passed over, so every record is
    stored exactly once. Records without key are passed over.
    """
    if store.holds(name, part):
        return
    rows = batch.withColumn("message_key", uuid_key(key)).filter("message_key is not null")
    content = F.xxhash64(F.to_json(F.struct(*batch.columns)))
    rows = rows.withColumn("__at", F.struct(*([F.col(arrival)] if arrival else []), content)).persist()
    kept = kept_arrivals(rows.select("message_key", "__at"), "__at")
    fresh = rows.join(kept, ["message_key", "__at"], "left_semi").dropDuplicates(["message_key"]).drop("__at")
    stored = store.read(name)
    if stored is not None:
        fresh = fresh.join(stored.select("message_key"), "message_key", "left_anti")
    store.append(fresh, name, part)
    rows.unpersist()


def ingest_stream(records: DataFrame, store: Store, checkpoint: str, name: str = "records", key: str = "uuid", arrival: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Start the stream into a table of the store; with `available_now` it ends once all present files are in. Several streams may feed one table, one at a time."""

    def one(batch: DataFrame, number: int) -> None:
        append_new(batch, f"{stream_id(batch.sparkSession, checkpoint)}-{number}", store, name, key, arrival)

    writer = records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def label_counts_stream(links: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Running (user_id, label, n) of a stream of (fragment_id, user_id, label, at): each fragment and label counts once within the watermark."""
    once = links.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["fragment_id", "label"])
    return once.groupBy("user_id", "label").agg(F.count(F.lit(1)).alias("n"))


def pair_counts_stream(fragments: DataFrame, key: str = "fragment_id", labels: str = "noun_phrases", watermark: str = "1 hour") -> DataFrame:
    """Running (user_id, label_a, label_b, n) of a stream of whole fragments (key, user_id, labels, at): in how many two labels meet, each fragment once within the watermark."""
    once = fragments.withWatermark("at", watermark).dropDuplicatesWithinWatermark([key])
    sorted_labels = F.array_sort(F.array_distinct(F.filter(labels, lambda x: x.isNotNull())))
    pairs = F.flatten(F.transform(sorted_labels, lambda a: F.transform(F.filter(sorted_labels, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return once.select("user_id", F.explode(pairs).alias("p")).groupBy("user_id", F.col("p.a").alias("label_a"), F.col("p.b").alias("label_b")).agg(F.count(F.lit(1)).alias("n"))
