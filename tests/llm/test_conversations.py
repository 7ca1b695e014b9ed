import datetime as dt
import random

from threadloom.llm import conversations as c
from threadloom.operators import skew

SCHEMA = "delivery_id long, conversation_uuid string, uuid string, parent_message_uuid string, msg_index int, sender string, text string, created_at timestamp, hash string, turn_no string"
T0 = dt.datetime(2025, 1, 1)
ROOT = "00000000-0000-4000-8000-000000000000"


def chat(spark, rows):
    return spark.createDataFrame([(i, cv, u, p, x, s, t, None if m is None else T0 + dt.timedelta(seconds=m), None, "clash") for i, (cv, u, p, x, s, t, m) in enumerate(rows, 1)], SCHEMA)


def kept(df, **k):
    out = {}
    for r in c.rebuild(df, **k).orderBy("conversation_uuid", "turn_no").collect():
        out.setdefault(r.conversation_uuid, []).append(r.message_uuid)
    return out


CASES = [
    # links, with a regenerated reply: the later one goes on
    ("links", "a1", None, None, "human", "q", 1), ("links", "a2", "A1", None, "model", "old", 2), ("links", "a3", "a1", None, "assistant", "new", 3),
    ("links", "a4", "a2", None, "user", "left out", 9),
    ("twice", "b1", ROOT, None, "human", "q", 1), ("twice", "b2", "b1", None, "assistant", "r", 2), ("twice", "B-1", ROOT, None, "human", "later copy", 5),
    ("gone", "c1", "", None, "human", "q", 1), ("gone", "c2", "zz", None, "assistant", "r", 2),
    ("roots", "d1", "", None, "human", "q", 1), ("roots", "d2", "", None, "assistant", "r", 2), ("roots", "d3", "d2", None, "human", "r", 2), ("roots", "d4", "d3", None, "assistant", "r", 2),
    ("circle", "e1", "", None, "human", "q", 1), ("circle", "e2", "e1", None, "assistant", "r", 2), ("circle", "e3", "e4", None, "human", "r", 2), ("circle", "e4", "e3", None, "human", "r", 2),
    ("index", "f2", None, 1, "assistant", "r", 1), ("index", "f1", None, 0, "human", "q", 2),
    ("gap", "g1", None, 0, "human", "q", 1), ("gap", "g2", None, 2, "assistant", "r", 2),
    ("time", "h2", None, 0, "assistant", "r", 2), ("time", "h1", None, 0, "human", "q", 1),
    ("tie", "i1", None, 0, "human", "q", 1), ("tie", "i2", None, 0, "assistant", "r", 1),
    ("blank", "j1", None, 0, "human", " ​", 1), ("blank", "j2", None, 1, "assistant", "r", 2),
    ("noreply", "k1", None, 0, "human", "q", 1),
    ("tool", "l1", None, 0, "human", "q", 1), ("tool", "l2", None, 1, "tool", "r", 2),
    ("null", "m1", None, 0, "human", None, 1), ("null", "m2", None, 1, "assistant", "r", 2),
    (None, "n1", None, 0, "human", "q", 1),
]
WANT = {"links": ["a1", "a3"], "twice": ["b1", "b2"], "index": ["f1", "f2"], "time": ["h1", "h2"]}


def test_cases_both_ways(spark):
    df = chat(spark, CASES)
    assert kept(df) == WANT
    assert kept(df, local_rows=1) == WANT
    assert kept(df.limit(0)) == {}


def test_long_chain_is_the_same_without_gathering(spark):
    rng = random.Random(1)
    rows = [("big", f"m{i}", f"m{i - 1}" if i else None, None, "human" if i % 2 == 0 else "assistant", "x", i) for i in range(150)]
    rows += [("big", f"s{i}", f"m{rng.randrange(140)}", None, "human", "side", -1000 - i) for i in range(20)]
    rng.shuffle(rows)
    df = chat(spark, rows)
    want = {"big": [f"m{i}" for i in range(150)]}
    assert kept(df) == want and kept(df, local_rows=10) == want


def test_a_copy_without_uuid_counts_with_its_message(spark):
    rows = [("c", "a1", None, 0, "human", "q", 1), ("c", None, None, 0, "Human ", " q ", 7), ("c", "a2", None, 1, "assistant", "r", 2)]
    assert kept(chat(spark, rows)) == {"c": ["a1", "a2"]}


def test_a_star_is_the_same_without_gathering(spark, monkeypatch):
    """Most messages reply to one; with low bounds every join takes its way for hot keys."""
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    rows = [("star", "root", None, None, "human", "q", 0)] + [("star", f"r{i}", "root", None, "model", "a", i + 1) for i in range(60)]
    assert kept(chat(spark, rows), local_rows=10) == {"star": ["root", "r59"]}


def test_sessions(spark):
    rows = [("x", str(i), None, None, s, "t", m) for i, (s, m) in enumerate([("human", 0), ("assistant", 5), ("human", 10), ("assistant", 90_000), ("human", 90_004), ("human", 200_000)])]
    rows += [("x", "5", None, None, "human", "again", 200_000), (None, "y", None, None, "human", "t", 3), ("x", "z", None, None, "human", "t", None)]
    df = c.distinct_messages(chat(spark, rows))
    run = lambda df: [(r.session_no, r.turn_no, r.delivery_id, r.role) for r in c.sessionize(df, "conversation_uuid", "made", "delivery_id", "role", ["delivery_id"]).orderBy("session_no", "turn_no").collect()]
    assert run(df) == [(0, 0, 1, 0), (0, 1, 2, 1), (0, 2, 3, 0), (1, 0, 4, 1), (1, 1, 5, 0)]
    assert run(df.limit(0)) == []


def test_calibrated_gap(spark):
    pauses = spark.createDataFrame([(10**6 * (1 + i % 5),) for i in range(200)] + [(10**10 * (1 + i % 3),) for i in range(20)] + [(0,)] * 500 + [(None,)], "pause long")
    assert 5e6 < c.calibrated_gap(pauses).first().gap < 1e10
    assert c.calibrated_gap(pauses.limit(0)).first().gap is None
