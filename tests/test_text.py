import hashlib
import math

from pyspark.sql import functions as F

from threadloom.functions import hashing, scores, text, vectors


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_normalisation(spark):
    assert one(spark, "Éa-B_c1", text.normalize_words) == "abc1"
    assert one(spark, "WebSocket - handler", text.normalize_phrase) == "websocket handler"
    assert one(spark, " a \n b ", text.normalize_content) == "a b"
    assert one(spark, None, text.normalize_content) == ""
    assert one(spark, "", text.normalize_phrase) == ""


def test_code_lines(spark):
    for line, score in (("return foo;", 3.5), ("return to the office", 2.0), ("see the plan", 0.0), ("", 0.0)):
        assert one(spark, line, text.code_line_score) == score
    assert one(spark, "Use `for` loops", text.strip_code).split() == ["Use", "code", "loops"]
    assert one(spark, "a plan\nreturn foo;\nreturn bar;\nb plan", text.strip_code) == "a plan\n b plan"
    assert one(spark, "x ```\ncode\n``` y", text.strip_code) == "x y"
    assert one(spark, None, text.strip_code) is None


def test_markdown(spark):
    assert one(spark, "# Head\n\n- one\n- **two**.\n1. three", text.normalize_markdown) == "Head. one. two. three"
    assert one(spark, "", text.normalize_markdown) == ""


def test_noise_tokens_phrases(spark):
    assert [one(spark, x, text.semantic_noise) for x in ("---", "ok", "abc", None)] == [True, True, False, True]
    assert one(spark, "B a b A_1 é", text.query_tokens) == ["b", "a", "a_1", "é"]
    assert one(spark, "the index out of bounds !", text.trim_phrase) == "index out of bounds"
    assert one(spark, "the a", text.trim_phrase) is None
    assert [one(spark, x, text.is_identifier) for x in ("camelCase", "snake_case", "e.g", "bm25", "2024", "plain")] == [True, True, False, True, False, False]
    assert [one(spark, x, text.valid_keyword) for x in ("graph", "the", "12", "ab", "x" * 51)] == [True, False, False, False, False]
    p = one(spark, "7|3", text.parse_pair)
    assert (p.a, p.b) == (7, 3) and one(spark, "x|3", text.parse_pair).a is None


def test_hashes(spark):
    row = spark.createDataFrame([("human", " a  b ", 7, 1)], "role string, t string, m int, o int").select(hashing.role_hash("role", "t").alias("h"), hashing.fragment_hash("m", "o", "t").alias("f")).first()
    assert row.h == hashlib.sha256(b"human::a b").hexdigest()
    assert row.f == hashlib.sha256(b"7::1::a b").hexdigest()


def test_scores(spark):
    rows = [(10, 4, 5, 3, 0.336773), (10, 2, 2, 2, 1.0), (10, 5, 4, 2, 0.0), (10, 5, 5, 1, -0.39794), (10, 5, 5, 0, None), (10, 10, 10, 10, None), (0, 1, 1, 1, None)]
    df = spark.createDataFrame(rows, "n int, a int, b int, ab int, want double").select("want", scores.npmi(F.col("n"), F.col("a"), F.col("b"), F.col("ab")).alias("got"))
    for r in df.collect():
        assert r.got is None if r.want is None else math.isclose(r.got, r.want, abs_tol=1e-6)
    wrong = spark.createDataFrame([(10, 2, 3, 3)], "n int, a int, b int, ab int")
    assert wrong.select(scores.npmi(F.col("n"), F.col("a"), F.col("b"), F.col("ab"), strict=False).alias("x")).first().x is None
    try:
        wrong.select(scores.npmi(F.col("n"), F.col("a"), F.col("b"), F.col("ab")).alias("x")).collect()
        raise AssertionError("inconsistent counts must raise")
    except Exception as e:  # noqa: BLE001
        assert "inconsistent" in str(e)
    lit = lambda *x: [F.lit(float(v)) for v in x]
    got = spark.range(1).select(scores.keyword_bm25(*lit(10, 2, 3, 20, 25)).alias("a"), scores.keyword_bm25(*lit(10, 5, 1, 20, 25)).alias("b"), scores.search_bm25(*lit(10, 2, 3, 20, 25)).alias("c")).first()
    assert [round(x, 6) for x in got] == [2.599306, 0.7617, 1.105675]
    w = [spark.range(1).select(scores.sampling_weight(F.lit(s), F.lit(0.0), F.lit(1.0)).alias("w")).first().w for s in (1.0, 0.5, 0.0)]
    assert [round(x, 6) for x in w] == [1.0, 0.286505, 0.082085]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 1.0]), (2, [0.0, 0.0], [1.0, 1.0]), (3, [1.0], [1.0, 1.0]), (4, None, [1.0, 1.0])], "i int, a array<double>, b array<double>")
    got = {r.i: r.c for r in df.select("i", vectors.cosine_similarity("a", "b").alias("c")).collect()}
    assert math.isclose(got[1], 2**-0.5) and got[2] == 0.0 and got[3] is None and got[4] is None
    assert [r.u for r in df.select(vectors.usable("a", 2).alias("u")).collect()] == [True, False, False, False]
    mean = vectors.mean_vectors(spark.createDataFrame([("x", [1.0, 3.0]), ("x", [3.0, 5.0]), ("x", None)], "k string, v array<double>"), ["k"], "v").first()
    assert mean.centroid == [2.0, 4.0] and mean.n == 2
