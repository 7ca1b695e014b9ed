"""Rebuilding conversations from message rows (problem 1).

`rebuild`: the channel is the conversation_uuid; rows are sessionised by it, put in order, given roles, and sessions without reciprocal
replies are dropped. Order comes from parent links where there are any, else from msg_index, else from timestamps, as the
data defines it; inactivity gaps cannot give that result. `sessionize` splits at calibrated gaps, for rows whose channel is their participants.

Ordinary conversations are gathered per conversation and walked in one pass over Arrow batches. Conversations of more than
`local_rows` rows are never gathered: their order comes from pointer doubling over parent links, or from a range-partitioned rank.
Both ways give the same rows; which one runs depends only on the size of the conversation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.identity import speaker, uuid_key, uuid_text
from threadloom.operators.dedupe import chat_identity
from threadloom.operators.skew import hot_keys, keyed_join
from threadloom.session import cut

#: How a missing parent is written (fixed value: the export format), without hyphens.
NO_PARENT = "00000000000040008000000000000000"
LOCAL_ROWS = 20_000
TURNS = "conversation_uuid string, turn_no int, message_key string"


def visible(text: Column | str) -> Column:
    """Whether a text has a character besides white space, no-break space, U+200B and U+FEFF. Null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.rlike("(?U)[^\\s\\x1c-\\x1f\\u00a0\\u200b\\ufeff]"), F.lit(False))


def _compact() -> list[Column]:
    """What is kept of a row: normalised ids, role and visibility instead of the text."""
    parent = uuid_key("parent_message_uuid")
    return [
        F.col("conversation_uuid"),
        F.when(parent != NO_PARENT, parent).alias("parent"),
        F.col("msg_index").cast("int").alias("idx"),
        F.when(speaker("sender") == "human", 0).when(speaker("sender") == "assistant", 1).otherwise(-1).cast("tinyint").alias("role"),
        visible("text").alias("shown"),
        F.unix_micros(F.col("created_at").cast("timestamp")).alias("made"),
    ]


def distinct_messages(chat: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One compact row per message, with the columns `keep` beside it: its latest delivery, a maximum that combines before the shuffle."""
    rows = chat_identity(chat, [*_compact(), *keep])
    names = [c for c in rows.columns if c not in ("delivery_id", "message_key")]
    latest = rows.groupBy("message_key").agg(F.max(F.struct("delivery_id", *names)).alias("m"))
    return latest.select(F.col("message_key").alias("key"), "m.*")


def _walk(keys: list, parents: list, idx: list, roles: list, shown: list, made: list, arrival: list) -> list[int] | None:
    """The positions of the turns of one conversation in order, or None where it is broken, empty or lacks a reply."""
    n = len(keys)
    if n < 2:
        return None
    if any(p is not None for p in parents):
        at = dict(zip(keys, range(n)))
        best: dict[int, int] = {}
        ups = [-1] * n
        root = -1
        rank = lambda i: (made[i] is not None, made[i] or 0, arrival[i])
        for i, p in enumerate(parents):
            if p is None:
                if root >= 0:
                    return None
                root = i
                continue
            up = at.get(p)
            if up is None or up == i:
                return None
            ups[i] = up
            old = best.get(up)
            if old is None or rank(i) > rank(old):
                best[up] = i
        if root < 0:
            return None
        seen = bytearray(n)
        seen[root] = 1
        for i in range(n):
            path, j = [], i
            while not seen[j]:
                seen[j] = 2
                path.append(j)
                j = ups[j]
            if seen[j] == 2:
                return None  # a circle: it never reaches the root
            for k in path:
                seen[k] = 1
        order, j = [], root
        while j is not None:
            order.append(j)
            j = best.get(j)
    elif all(x is not None for x in idx) and len(set(idx)) == n:
        order = sorted(range(n), key=idx.__getitem__)
        if [idx[i] for i in order] != list(range(n)):
            return None
    else:
        if any(x is None for x in made) or len(set(made)) < n:
            return None
        order = sorted(range(n), key=made.__getitem__)
    if len(order) % 2 or not all(shown[i] and roles[i] == t % 2 for t, i in enumerate(order)):
        return None
    return order


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("key", "parent", "idx", "role", "shown", "made", "delivery_id")
    for batch in batches:
        convs, lists = batch.column(0).to_pylist(), batch.column(1)
        offsets = lists.offsets.to_pylist()
        cols = [lists.values.field(k).to_pylist() for k in names]
        out_c, out_t, out_k = [], [], []
        for c, a, b in zip(convs, offsets, offsets[1:]):
            part = [x[a:b] for x in cols]
            order = _walk(*part)
            if order:
                out_c += [c] * len(order)
                out_t += range(len(order))
                out_k += [part[0][i] for i in order]
        yield pa.RecordBatch.from_arrays([pa.array(out_c, pa.string()), pa.array(out_t, pa.int32()), pa.array(out_k, pa.string())], ["conversation_uuid", "turn_no", "message_key"])


def _ordinary(messages: DataFrame) -> DataFrame:
    fields = F.struct("key", "parent", "idx", "role", "shown", "made", "delivery_id")
    groups = messages.groupBy("conversation_uuid").agg(F.collect_list(fields).alias("m"))
    return groups.mapInArrow(_gathered, TURNS)


def _ranked(rows: DataFrame, by: str) -> DataFrame:
    """`place` from 0 of each row within its conversation in the order of `by`, which has no ties: ranges are ranked apart, then offset."""
    parts = max(2, rows.sparkSession.sparkContext.defaultParallelism)
    spread = cut(rows.repartitionByRange(parts, "conversation_uuid", by).withColumn("__part", F.spark_partition_id()))
    sizes = spread.groupBy("conversation_uuid", "__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("conversation_uuid").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inner = F.row_number().over(Window.partitionBy("conversation_uuid", "__part").orderBy(by)) - 1
    return spread.withColumn("inner", inner).join(before, ["conversation_uuid", "__part"]).withColumn("place", (F.col("inner") + F.col("before")).cast("int")).drop("inner", "before", "__part")


def _huge(messages: DataFrame, local_rows: int) -> DataFrame:
    """The same turns for conversations too large to gather: every step shuffles on (conversation, message).

    A conversation, or a message that most others reply to, is a hot key: joins on them are `keyed_join`s.
    """
    cid = ["conversation_uuid"]
    conv = messages.groupBy(*cid).agg(
        F.count(F.lit(1)).alias("n"), F.count("parent").alias("linked"), F.count("idx").alias("n_idx"), F.count("made").alias("n_made"),
        F.min("idx").alias("lo"), F.max("idx").alias("hi"),
    )
    distinct = lambda c: messages.select("conversation_uuid", c).filter(F.col(c).isNotNull()).distinct().groupBy(*cid).agg(F.count(F.lit(1)).alias(f"d_{c}"))
    conv = conv.join(distinct("idx"), "conversation_uuid", "left").join(distinct("made"), "conversation_uuid", "left").fillna(0, ["d_idx", "d_made"])
    by_index = (F.col("n_idx") == F.col("n")) & (F.col("d_idx") == F.col("n"))
    mode = (
        F.when(F.col("linked") > 0, F.when(F.col("linked") == F.col("n") - 1, "links"))
        .when(by_index, F.when((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1), "index"))
        .when((F.col("n_made") == F.col("n")) & (F.col("d_made") == F.col("n")), "time")
    )
    sound = cut(conv.select("conversation_uuid", "n", mode.alias("mode")).filter("mode is not null"))
    hot = hot_keys(sound, cid, rows=local_rows)
    of = lambda m: keyed_join(messages, sound.filter(F.col("mode") == m).select("conversation_uuid", "n"), cid, hot=hot)
    columns = ["conversation_uuid", "place", "key", "role", "shown"]
    placed = of("index").withColumn("place", F.col("idx")).select(columns)
    placed = placed.unionByName(_ranked(of("time").select("conversation_uuid", "key", "role", "shown", "made"), "made").select(columns))

    nodes = cut(of("links"))
    rank = F.struct(F.col("made").isNotNull().alias("a"), F.coalesce("made", F.lit(0)).alias("b"), F.col("delivery_id").alias("c"))
    heirs = cut(nodes.filter("parent is not null").groupBy("conversation_uuid", "parent").agg(F.max(rank).getField("c").alias("heir"), F.count(F.lit(1)).alias("replies")))
    marked = keyed_join(nodes, heirs.drop("replies"), ["conversation_uuid", "parent"], "left", hot=hot_keys(heirs, ["conversation_uuid", "parent"], "replies"))
    # up: the ancestor reached so far; depth: links to it; main: whether every link on the way is to the child that goes on.
    state = cut(marked.select(
        "conversation_uuid", "key", "n", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"),
        (F.col("parent").isNull() | (F.col("heir") == F.col("delivery_id"))).alias("main"),
    ))
    for _ in range(64):
        open_rows = state.filter("up is not null")
        if open_rows.isEmpty():
            break
        jump = state.select("conversation_uuid", F.col("key").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("main").alias("m2"))
        # A link to nowhere drops its row here and so breaks its conversation below; a circle stays open and grows beyond n.
        moved = keyed_join(open_rows, jump, ["conversation_uuid", "up"])
        moved = moved.select("conversation_uuid", "key", "n", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("main") & F.col("m2")).alias("main"))
        state = cut(state.filter("up is null").unionByName(moved.filter(F.col("depth") < F.col("n"))))
    whole = state.groupBy(*cid).agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n")).filter("m = n").select(*cid)
    line = keyed_join(state.filter("main"), whole, cid, "left_semi", hot=hot).select("conversation_uuid", "key", F.col("depth").alias("place"))
    placed = placed.unionByName(line.join(nodes.select("conversation_uuid", "key", "role", "shown"), ["conversation_uuid", "key"]).select(columns))
    placed = cut(placed)
    good = (F.col("role") == F.col("place") % 2) & F.col("shown")
    kept = placed.groupBy(*cid).agg(F.min(good).alias("good"), F.count(F.lit(1)).alias("k")).filter("good and k % 2 = 0").select(*cid)
    return keyed_join(placed, kept, cid, "left_semi", hot=hot).select("conversation_uuid", F.col("place").alias("turn_no"), F.col("key").alias("message_key"))


def rebuild(chat: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(conversation_uuid, turn_no, message_uuid) of every turn of every kept conversation of a chat_message table.

    A message is counted once (its latest delivery). With parent links there must be one message without parent on which every
    other hangs; among messages with one parent the one created last goes on (null counts as earliest, a tie goes to the later
    arrival). Without links msg_index must run 0, 1, 2, … or, where it has nulls or repeats, created_at decides and must have
    neither. Kept are conversations whose turns alternate human, assistant, …, end with assistant, and are all visible.
    A message without any uuid gets a null message_uuid. Rows without conversation_uuid belong to no conversation here (`sessionize` serves
    them). An empty table gives no rows; extra columns are ignored.
    """
    messages = cut(distinct_messages(chat).filter(F.col("conversation_uuid").isNotNull()))
    huge = cut(messages.groupBy("conversation_uuid").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > local_rows))
    if huge.isEmpty():
        turns = _ordinary(messages)
    else:
        hot, huge = hot_keys(huge, ["conversation_uuid"], "rows", rows=local_rows), huge.select("conversation_uuid")
        split = lambda how: keyed_join(messages, huge, ["conversation_uuid"], how, hot=hot)
        turns = _ordinary(split("left_anti")).unionByName(_huge(cut(split("left_semi")), local_rows))
    own = F.when(~F.col("message_key").rlike("^(hash|alone):"), F.col("message_key"))
    return turns.select("conversation_uuid", "turn_no", uuid_text(own).alias("message_uuid"))


#: Pauses fall into so many classes for each doubling.
CLASSES = 8


def calibrated_gap(pauses: DataFrame, pause: str = "pause") -> DataFrame:
    """One row (gap): the inactivity gap in microseconds that divides pauses within sessions from those between them.

    Pauses form two heaps on a logarithmic scale; the gap is the bound of the class at which the variance between the two sides is
    greatest (the first of equal ones). All pauses count but those of no length (rows of one time say nothing about gaps), in at most some 500
    classes, so only a small table of counts is ordered.
    Without two classes of pauses there is no gap (null), and nothing is split.
    """
    at = F.floor(F.log2(F.col(pause).cast("double")) * CLASSES + 1e-9)
    counts = pauses.filter(F.col(pause) > 0).groupBy(at.alias("c")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    upto, every = Window.orderBy("c"), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # over the classes only
    sides = counts.select("c", F.sum("w").over(upto).alias("w0"), F.sum(F.col("w") * F.col("c")).over(upto).alias("s0"), F.sum("w").over(every).alias("w1"), F.sum(F.col("w") * F.col("c")).over(every).alias("s1"))
    between = F.col("w0") * (F.col("w1") - F.col("w0")) * F.pow(F.col("s0") / F.col("w0") - (F.col("s1") - F.col("s0")) / (F.col("w1") - F.col("w0")), 2)
    best = sides.filter("w1 > w0").agg(F.max_by("c", F.struct(F.round(between / F.pow("w1", F.lit(2)), 9), -F.col("c"))).alias("c"))
    return best.select(F.pow(F.lit(2.0), (F.col("c") + 1) / CLASSES).alias("gap"))


def sessionize(messages: DataFrame, channel: str, ts: str, tie: str, role: str, keep: list[str]) -> DataFrame:
    """(channel, session_no, turn_no, keep..., role) of the turns of all sessions with a reciprocal exchange.

    For rows that carry no conversation id, `channel` being the participants. Rows are ordered by `ts` (microseconds) and `tie` (unique)
    and split at the calibrated gap; numbers run from 0. A session needs at least one human (role 0) and one assistant turn (role 1), else
    it is dropped. Null channels and timestamps take no part. A repeated message should be removed before.

    Rows are spread by ranges of (channel, time), numbered within each range and offset by the ranges before, so that one channel, or one
    session, may hold a third of all rows.
    """
    base = messages.filter(F.col(channel).isNotNull() & F.col(ts).isNotNull()).select(F.col(channel).alias("channel"), F.col(ts).alias("t"), F.col(tie).alias("tie"), F.col(role).alias("role"), *[F.col(c).alias(f"k_{c}") for c in keep])
    parts = max(2, messages.sparkSession.sparkContext.defaultParallelism)
    spread = cut(base.repartitionByRange(parts, "channel", "t", "tie").withColumn("part", F.spark_partition_id()))
    here, over = Window.partitionBy("channel", "part").orderBy("t", "tie"), Window.partitionBy("channel").orderBy("part")
    ahead = over.rowsBetween(Window.unboundedPreceding, -1)
    # (channel, range): at most one row for each channel and one more for each range
    ranges = spread.groupBy("channel", "part").agg(F.max("t").alias("last"), F.count(F.lit(1)).alias("n"))
    ranges = ranges.select("channel", "part", F.lag("last").over(over).alias("carry"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("rows_before"))
    linked = spread.withColumn("prev", F.lag("t").over(here)).withColumn("inner", F.row_number().over(here)).join(ranges, ["channel", "part"])
    paused = cut(linked.withColumn("pause", F.col("t") - F.coalesce("prev", "carry")).withColumn("pos", F.col("inner") + F.col("rows_before")).drop("prev", "carry", "inner", "rows_before"))
    cutting = F.col("pause").isNull() | (F.col("pause") > F.coalesce("gap", F.lit(float("inf"))))
    numbered = paused.crossJoin(F.broadcast(calibrated_gap(paused))).withColumn("starts", cutting.cast("int"))  # one row
    before = numbered.groupBy("channel", "part").agg(F.sum("starts").alias("s"))
    before = before.select("channel", "part", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("sessions_before"))
    numbered = cut(numbered.withColumn("inner", F.sum("starts").over(here)).join(before, ["channel", "part"]).withColumn("session_no", F.col("inner") + F.col("sessions_before") - 1))
    keys = ["channel", "session_no"]
    sessions = numbered.groupBy(*keys).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"), F.max((F.col("role") == 0).cast("int")).alias("asks"), F.max((F.col("role") == 1).cast("int")).alias("answers"))
    sessions = cut(sessions.filter("asks = 1 and answers = 1"))
    turns = keyed_join(numbered, sessions.select(*keys, "first"), keys, hot=hot_keys(sessions, keys))
    return turns.select("channel", "session_no", (F.col("pos") - F.col("first")).alias("turn_no"), *[F.col(f"k_{c}").alias(c) for c in keep], "role")


def account_sessions(chat: DataFrame) -> DataFrame:
    """(channel, session_no, turn_no, delivery_id, role) of a chat_message table sessionised by account, each message once (its latest delivery)."""
    return sessionize(distinct_messages(chat, ["account_uuid"]), "account_uuid", "made", "delivery_id", "role", ["delivery_id"])
