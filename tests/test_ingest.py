import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from threadloom.errors import EngineError
from threadloom.operators import dedupe, nested, skew
from threadloom.sources import exports
from threadloom.sources.store import Store
from threadloom.streaming import ingest

RECORD = {
    "uuid": "u1", "name": "n", "created_at": "2025-01-01T00:00:00Z", "account": {"uuid": "a1", "email": "x"}, "odd": 1,
    "chat_messages": [
        {"uuid": "m1", "sender": "human", "content": [{"type": "text", "text": " hi "}, {"type": "thinking", "thinking": "t"}, {"type": "tool_use", "input": {"content": "x=1", "language": "python"}}]},
        {"uuid": "m2", "sender": "assistant", "content": []},
        {"uuid": "m3", "sender": "assistant", "content": [{"type": "text", "text": "yes", "citations": ["{\"b\":1, \"a\":2}", None, "bad{"]}], "attachments": [{"file_name": "f"}]},
    ],
}


@pytest.fixture
def export(spark, tmp_path):
    path = tmp_path / "export.json"
    path.write_text(json.dumps([RECORD]))
    return str(path)


def test_read_and_units(spark, export):
    from pyspark.sql import functions as F

    df = exports.read_export(spark, "claude", export).withColumn("delivery_id", F.lit(1))
    got = [(r.msg_pos, r.unit_pos, r.type, r.text, r.language) for r in exports.unit_rows(df).orderBy("msg_pos", "unit_pos").collect()]
    assert got == [(0, 0, "TEXT", " hi ", None), (0, 1, "CODE", "x=1", "python"), (2, 0, "TEXT", "yes", None)]
    kept = exports.sequence(exports.messages(df), "delivery_id", "msg_pos").orderBy("msg_pos").collect()
    assert [(r.text, r.sequence_number) for r in kept] == [("hi x=1", 0), ("yes", 1)]
    with pytest.raises(EngineError) as e:
        exports.read_export(spark, "CHAT_GPT", export)
    assert e.value.code == "UNSUPPORTED_PROVIDER"


def test_user_export(spark, tmp_path):
    path = tmp_path / "user.json"
    path.write_text(json.dumps([{"uuid": "u", "full_name": "F", "email_address": " A@B.C "}]))
    assert exports.read_user(spark, str(path)).first().email == "a@b.c"


def test_nested_tables(spark, export):
    from pyspark.sql import functions as F

    df = exports.read_claude(spark, export).withColumn("delivery_id", F.lit(7)).withColumn("kind", F.lit("clash"))
    rows = nested.occurrences(df).collect()
    kinds = sorted((r.kind, r.msg_pos, r.block_pos, r.item_pos) for r in rows)
    assert kinds == sorted([
        ("message", 0, -1, 0), ("message", 1, -1, 1), ("message", 2, -1, 2), ("content", 0, -1, 0), ("content", 0, -1, 1), ("content", 0, -1, 2), ("content", 2, -1, 0),
        ("input", 0, 2, 0), ("citation", 2, 0, 0), ("citation", 2, 0, 2), ("attachment", 2, -1, 0),
    ])
    by = {r.node_hash: r for r in rows}
    assert all(r.parent_hash in by for r in rows if r.kind != "message")
    assert nested.occurrences(df.limit(0)).count() == 0
    twice = nested.objects(nested.occurrences(df.unionAll(df)))
    assert twice.agg(F.min("n_occurrences")).first()[0] == 2


def test_canonical_json(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([('{"b":1, "a": [1,2]}',), ("no json{",), (None,)], "x string")
    assert [r.y for r in df.select(nested.canonical_json(F.col("x")).alias("y")).collect()] == ['{"a":[1,2],"b":1}', "no json{", None]


def _chat(spark, rows):
    return spark.createDataFrame([(i, c, u, s, t, h, "extra") for i, c, u, s, t, h in rows], "delivery_id long, conversation_uuid string, uuid string, sender string, text string, hash string, message_key string")


def test_superseded(spark):
    rows = [
        (1, "c", "AAAA-1", "human", "hi", None), (2, "c", "{aaaa1}", "human", "hi there", None), (3, "c", None, "User", " hi ", None),
        (4, "c", "b", "model", "yo", None), (5, "c", None, "assistant", "other", None), (6, "c", "", "assistant", "other", None),
        (7, "c", "d", "human", "same", None), (8, "c", "e", "human", "same", None), (9, "c", None, "human", "same", None), (10, None, None, None, None, None),
    ]
    ids = dedupe.chat_identity(_chat(spark, rows))
    assert sorted(r.delivery_id for r in dedupe.superseded(ids).collect()) == [1, 2, 5]
    assert dedupe.superseded(ids.limit(0)).count() == 0


def test_new_and_merged_arrivals(spark):
    ids = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (9, "c"), (5, "c")], "delivery_id long, message_key string")
    batch, stored = ids.filter("delivery_id in (2, 3, 5)"), ids.filter("delivery_id in (1, 9)")
    assert sorted((r.message_key, r.delivery_id) for r in dedupe.new_arrivals(batch, stored).collect()) == [("b", 3)]
    assert sorted((r.message_key, r.delivery_id, r.replaces) for r in dedupe.merge_arrivals(batch, stored).collect()) == [("a", 2, 1), ("b", 3, None)]
    assert dedupe.merge_arrivals(batch.limit(0), stored).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_keyed_join(spark, how):
    left = spark.createDataFrame([("a", i) for i in range(60)] + [("b", 1), ("c", 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("a", 10), ("b", 20), ("d", 30)], "k string, w int")
    want = sorted(map(str, left.join(right, ["k"], how).collect()))
    assert sorted(map(str, skew.keyed_join(left, right, ["k"], how, rows=50).collect())) == want
    assert sorted(map(str, skew.keyed_join(left, right, ["k"], how).collect())) == want
    assert [r.k for r in skew.hot_keys(left.groupBy("k").count(), ["k"], "count", rows=50).collect()] == ["a"]


def test_hot_rows_stay_where_they_are(spark):
    """A key with a third of the rows is not gathered in one task."""
    from pyspark.sql import functions as F

    left = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    right = left.distinct().withColumn("w", F.lit(1))
    joined = skew.keyed_join(left, right, ["k"])
    most = joined.filter("k = 'hot'").groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    assert most[1] == 13_334 and most[0] < 2_500


def test_dedupe_by_hash(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "i int, hash string")
    stored = spark.createDataFrame([("y",)], "hash string")
    assert [r.i for r in exports.dedupe_by_hash(rows, ["i"], stored=stored).collect()] == [1]


def test_dedupe_by_hash_of_rows_with_one_order(spark):
    rows = spark.createDataFrame([(1, 0, "h1"), (1, 0, "h1"), (1, 0, "h2"), (2, 0, None), (3, 0, None)], "i int, p int, hash string")
    assert sorted((r.i, r.hash or "") for r in exports.dedupe_by_hash(rows, ["i", "p"]).collect()) == [(1, "h1"), (1, "h2"), (2, "")]


def test_stream_into_store(spark, tmp_path):
    folder, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    os.makedirs(folder)
    for k in range(3):
        (folder / f"{k}.json").write_text("\n".join(json.dumps({"uuid": u, "name": str(k)}) for u in ("A-1", "a1", f"b{k}")))
    run = lambda check: ingest.ingest_stream(ingest.read_stream(spark, str(folder), 1), store, str(tmp_path / check)).awaitTermination()
    keys = lambda: sorted(r.message_key for r in store.read("records").collect())
    run("check")
    assert keys() == ["a1", "b0", "b1", "b2"]
    (folder / "9.json").write_text(json.dumps({"uuid": "{A1}"}) + "\n" + json.dumps({"uuid": "z"}))
    run("check")
    assert keys() == ["a1", "b0", "b1", "b2", "z"]
    # another stream begins at batch 0 again: it neither loses nor repeats what is stored
    (folder / "10.json").write_text(json.dumps({"uuid": "new"}))
    run("other")
    assert keys() == ["a1", "b0", "b1", "b2", "new", "z"]
    # a checkpoint that was removed and made again is a new stream at the old place
    shutil.rmtree(tmp_path / "other")
    (folder / "11.json").write_text(json.dumps({"uuid": "newer"}))
    run("other")
    assert keys() == ["a1", "b0", "b1", "b2", "new", "newer", "z"]


def test_store_reads_what_is_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("t") is None
    df = spark.createDataFrame([(1,)], "i int")
    store.append(df, "t", "a")
    store.append(df, "t", "a")
    os.makedirs(tmp_path / "t" / "part-broken")
    assert store.read("t").count() == 1 and not store.holds("t", "broken")
    for k in range(4):
        store.replace(df.withColumn("i", F.lit(k)), "v")
    assert store.read("v").first().i == 3 and len(os.listdir(tmp_path / "v")) == 2


def test_pair_counts_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(1, 7, ["a", "b", "a", None], "2025-01-01 00:00:00"), (1, 7, ["a", "b"], "2025-01-01 00:00:01"), (2, 7, ["b", "a", "c"], "2025-01-01 00:00:02"), (3, 7, None, "2025-01-01 00:00:03")]
    df = spark.createDataFrame(rows, "fragment_id long, user_id long, noun_phrases array<string>, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(folder)
    counts = ingest.pair_counts_stream(spark.readStream.schema(df.schema).parquet(folder))
    counts.writeStream.outputMode("complete").format("memory").queryName("pairs").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.table("pairs").collect()) == [(7, "a", "b", 2), (7, "a", "c", 1), (7, "b", "c", 1)]
    labels = df.select("fragment_id", "user_id", F.explode("noun_phrases").alias("label"), "at").filter("label is not null")
    labels.write.parquet(str(tmp_path / "l"))
    counts = ingest.label_counts_stream(spark.readStream.schema(labels.schema).parquet(str(tmp_path / "l")))
    counts.writeStream.outputMode("complete").format("memory").queryName("labels").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.table("labels").collect()) == [(7, "a", 2), (7, "b", 2), (7, "c", 1)]


def test_engine_ingest(spark, tmp_path):
    """Units are fragmented by themselves, code gives nothing, messages of records without uuid stay apart, and a second load adds nothing."""
    from threadloom.api import Engine

    text = lambda t: {"type": "text", "text": t}
    said = lambda *c: {"sender": "human", "content": list(c)}
    code = {"type": "tool_use", "input": {"content": "def leak(): return 1", "language": "python"}}
    records = [
        {"name": "a", "chat_messages": [said(text("First thing about kafka.\n\nSecond thing about caches."), code, text("Another unit of text"))]},
        {"name": "b", "chat_messages": [said(text("A different first message"))], "account": {"uuid": "acc"}},
        {"uuid": "c", "name": "c", "chat_messages": [said(code), said(text("A different first message"))]},
        {"name": "a", "chat_messages": [said(text("First thing about kafka.\n\nSecond thing about caches."), code, text("Another unit of text"))]},
    ]
    path = tmp_path / "export.json"
    path.write_text(json.dumps(records))
    accounts = spark.createDataFrame([("acc", 5, 6)], "uuid string, email_id long, llm_id long")
    engine = Engine.open(spark, str(tmp_path / "store"))
    counts = engine.ingest("CLAUDE", str(path), 3, accounts=accounts)
    assert counts == {"semantic_fragments": 3, "message": 3, "conversation": 3}
    rows = engine.table("semantic_fragments").collect()
    assert len({r.fragment_id for r in rows}) == 3 and len({r.message_id for r in rows}) == 2
    assert all(r.fragment_order == 1 and "leak" not in r.text and r.user_id == 3 and r.llm_id == 6 and r.affiliated_email_id == 5 and r.created_at and r.embedding and r.noun_phrases for r in rows)
    messages = engine.table("message").collect()
    assert len({r.message_id for r in messages}) == 3 and {u.type for r in messages for u in r.content} == {"TEXT", "CODE"}
    assert engine.ingest("CLAUDE", str(path), 3, accounts=accounts) == {"semantic_fragments": 0, "message": 0, "conversation": 0}
    records.append({"name": "d", "chat_messages": [said(text("One more message here")), said(text("A different first message"))]})
    path.write_text(json.dumps(records))
    assert engine.ingest("CLAUDE", str(path), 3, accounts=accounts) == {"semantic_fragments": 1, "message": 1, "conversation": 1}
    assert engine.counts() == {"conversation": 4, "message": 4, "semantic_fragments": 4}
    parts = Engine.open(spark, str(tmp_path / "parts"))
    assert parts.ingest("CLAUDE", str(path), 3, mode="paragraph")["semantic_fragments"] >= 4
    engine.jobs.close(), parts.jobs.close()


def test_accounts_and_owners(spark):
    records = spark.createDataFrame([("r1", None, ("a", "x")), ("r2", None, None), ("r3", None, ("zz", "x"))], "uuid string, created_at timestamp, account struct<uuid:string,email:string>")
    accounts = spark.createDataFrame([("a", 1, 2), ("a", 1, 2)], "uuid string, email_id long, llm_id long")
    assert sorted((r.uuid, r.affiliated_email_id, r.llm_id) for r in exports.resolve_account(records, accounts).collect()) == [("r1", 1, 2), ("r2", 1, 2), ("r3", None, None)]
    assert exports.resolve_account(records.filter("uuid = 'r2'"), accounts).count() == 0
    users = spark.createDataFrame([(1, "A@b.c"), (2, None)], "user_id long, email string")
    assert [r.user_id for r in exports.users_by_email(users, " a@B.c ").collect()] == [1]
    llms = spark.createDataFrame([(2, 1), (3, 1)], "llm_id long, user_id long")
    assert [r.llm_id for r in exports.llms_of_email(llms, spark.createDataFrame([(1, 2)], "email_id long, llm_id long"), 1).collect()] == [2]
    dated = spark.createDataFrame([(1, 1, "2025-01-01"), (2, 1, None), (3, 1, "2025-02-01")], "i int, user_id long, created_at string")
    assert [r.i for r in exports.latest_of(dated, "user_id", 1, 2, tie="i").collect()] == [3, 1]


def test_json_of_arrays(spark):
    from threadloom.functions import vectors

    df = spark.createDataFrame([(["a", 'q"'],), ([],), (None,)], "w array<string>")
    back = df.select(vectors.words_from_json(vectors.to_json("w")).alias("w")).collect()
    assert [r.w for r in back] == [["a", 'q"'], [], None]
    with pytest.raises(Exception, match="not a JSON array"):
        spark.createDataFrame([('{"a": 1}',)], "j string").select(vectors.words_from_json("j")).collect()
    assert spark.createDataFrame([("[0.5, 1]",)], "j string").select(vectors.from_json("j").alias("v")).first().v == [0.5, 1.0]


def test_conversation_hash_by_brute_force(spark, export):
    import hashlib

    df = exports.read_claude(spark, export)
    r = df.select("uuid", "name", "summary").first()
    want = json.dumps({k: v for k, v in r.asDict().items() if v is not None}, separators=(",", ":"), ensure_ascii=False)
    got = df.select(exports.conversation_hash("uuid", "name", "summary").alias("h")).first().h
    assert got == hashlib.sha256(want.encode()).hexdigest()
