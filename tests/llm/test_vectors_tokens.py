import os
import random

import numpy as np
import pytest

from threadloom.llm import mixing, neighbours, tokens

needs_files = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZERS), reason="no tokenizer files")


def vectors(n=900, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return (centres[rng.integers(0, 12, n)] + 0.6 * rng.normal(size=(n, dim))) * rng.uniform(0.1, 4, (n, 1))


def test_neighbours_against_brute_force(spark):
    x = vectors()
    nan = float("nan")
    rows = [(i, [float(v) for v in e], "clash") for i, e in enumerate(x)]
    rows += [(9001, None, ""), (9002, [0.0] * 16, ""), (9003, [1.0] * 3, ""), (9004, [nan] * 16, ""), (9005, [float("inf")] * 16, ""), (9006, rows[0][1], ""), (None, rows[0][1], "")]
    df = spark.createDataFrame(rows, "fragment_id long, embedding array<float>, cosine string")
    ask = df.filter("fragment_id % 20 = 0 or fragment_id > 9000").select("fragment_id")
    u = np.vstack([x, x[:1]])
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    ids = [*range(len(x)), 9006]
    for block in (50, 8192):
        got = {}
        for r in neighbours.nearest(df, "fragment_id", "embedding", ask, k=5, dim=16, lists=30, probes=15, block=block).collect():
            got.setdefault(r.query_id, []).append((r.place, r.other_id))
        assert set(got) == {i for i in range(0, len(x), 20)} | {9006}
        hits = total = 0
        for q, found in got.items():
            s = u @ u[ids.index(q)]
            s[ids.index(q)] = -9
            best = {ids[j] for j in np.argsort(-s)[:5]}
            hits += len(best & {o for _, o in found})
            total += 5
            assert len(found) == 5 and q not in {o for _, o in found}
        assert hits / total >= 0.9
        assert (1, 9006) in got[0]


def test_neighbours_of_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.9, 0.1, 0.0])], "fragment_id long, embedding array<float>")
    got = neighbours.nearest(df, "fragment_id", "embedding", k=10, dim=3).collect()
    assert sorted((r.query_id, r.other_id) for r in got) == [(1, 2), (2, 1)]
    assert neighbours.nearest(df.limit(0), "fragment_id", "embedding", dim=3).count() == 0


def test_one_list_in_many_blocks_loses_nothing(spark):
    rng = np.random.default_rng(3)
    same = rng.normal(size=8)
    rows = [(i, [float(v) for v in (same if i % 2 else rng.normal(size=8))]) for i in range(400)]
    df = spark.createDataFrame(rows, "fragment_id long, embedding array<float>")
    ask = df.filter("fragment_id in (1, 2)").select("fragment_id")
    near = neighbours.nearest(df, "fragment_id", "embedding", ask, k=5, dim=8, lists=4, probes=4, block=20).collect()
    assert [r.other_id for r in sorted((r for r in near if r.query_id == 1), key=lambda r: r.place)] == [3, 5, 7, 9, 11]


@needs_files
def test_tokens_against_the_library():
    library = pytest.importorskip("tokenizers")
    t = library.Tokenizer.from_file(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    bpe = tokens.byte_bpe()
    rng = random.Random(8)
    pool = [*"abcdefgh \n\t.,'0123456789éßñ中文🧭", "the ", " graph", "<|endoftext|>", "'s", " ", "​", "\r\n"]
    texts = ["", " ", "a" * 5000, "ab" * 3000, "<|endoftext|>", *("".join(rng.choice(pool) for _ in range(rng.choice([3, 40, 900]))) for _ in range(200))]
    for s in texts:
        ids = t.encode(s, add_special_tokens=False).ids
        assert bpe.encode(s) == ids
        assert "".join(bpe.decode([[i] for i in ids])) == s
        for block in (1, 13):
            streamed = [i for p in bpe.find(s) for i in bpe.transduce((p.encode()[k : k + 7] for k in range(0, len(p.encode()), 7)), block)]
            assert streamed == ids


@needs_files
def test_token_columns(spark):
    df = spark.createDataFrame([(1, "hello world", 1), (2, "", 1), (3, None, 1), (3, None, 1)], "doc_id long, text string, ids int")
    got = tokens.encode(df, "doc_id", "text")
    assert sorted((r.doc_id, len(r.ids)) for r in got.collect()) == [(1, 2), (2, 0), (3, 0), (3, 0)]
    assert {r.doc_id: r.text for r in tokens.decode(got, "doc_id").collect()} == {1: "hello world", 2: "", 3: ""}
    assert {(r.doc_id, r.n_tokens) for r in tokens.count_tokens(df, ["doc_id"], "text").collect()} == {(1, 2), (2, 0), (3, 0)}
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


def test_budgets():
    tokens_of = {"a": 1000, "b": 100, "c": 0}
    targets = {"a": (0.5, 1), "b": (0.4, 3), "c": (0.1, 5)}
    b, exponent = mixing.budgets(tokens_of, targets)
    assert exponent == 1.0 and abs(b["b"] - 300) < 1e-9 and abs(b["a"] / b["b"] - 1.25) < 1e-9 and "c" not in b
    more, exponent = mixing.budgets(tokens_of, targets, 1000)
    assert exponent < 1 and abs(sum(more.values()) - 1000) < 1e-3 and more["b"] <= 300 + 1e-6
    assert mixing.budgets({}, targets) == ({}, 1.0)
    sizes = [100.0, 10.0, 1.0]
    for want in (0.5, 0.9):
        assert abs(mixing.entropy(mixing.temperature_shares(sizes, mixing.exponent_for_entropy(sizes, want))) - want) < 1e-6


def test_mixture(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["big", "mid", "tiny" if i % 9 == 0 else "big"]), rng.randint(1, 40)) for i in range(3000)] + [(9999, "other", 5)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = {"big": (0.5, 1), "mid": (0.3, 2), "tiny": (0.2, 4), "none": (0.1, 4)}
    mixture = mixing.mix(sizes, targets).cache()
    report = {r.source: r for r in mixing.report(mixture, targets, mixing.source_tokens(sizes, targets)).collect()}
    live = 1.0
    for s in ("big", "mid", "tiny"):
        assert abs(report[s].actual_share - targets[s][0] / live) < 0.005
    assert report["none"].actual_share == 0
    got = mixture.collect()
    for s, (_, most) in targets.items():
        copies = {}
        for r in got:
            if r.source == s:
                copies.setdefault(r.doc_id, []).append(r.copy_no)
        assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= most for c in copies.values())
        if copies:
            assert max(map(len, copies.values())) - min(len(copies.get(i, [])) for i, x, _ in rows if x == s) <= 1
    front = [r for r in got if r.mix_position < 0.5]
    total = sum(r.n_tokens for r in front)
    assert abs(sum(r.n_tokens for r in front if r.source == "mid") / total - 0.3 / live) < 0.02
    assert mixing.mix(sizes.limit(0), targets).count() == 0


def test_source_names(spark):
    df = spark.createDataFrame([(" Chat-Export ",), ("CHAT_EXPORT",), ("chat export",), (None,), (" ",)], "s string")
    assert [r.k for r in df.select(mixing.source_key("s").alias("k")).collect()] == ["chat_export"] * 3 + [None, None]


def test_copies_of_a_vector_take_one_place(spark):
    x = vectors(n=300)
    # 200 copies of row 0, whose ids are spread over the blocks; a query near them and one of them.
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)] + [(1000 + (i * 77) % 200, [float(v) for v in x[0]]) for i in range(200)]
    df = spark.createDataFrame(rows, "fragment_id long, embedding array<float>").repartition(3)
    for block in (40, 8192):
        near = neighbours.nearest(df, "fragment_id", "embedding", df.filter("fragment_id in (0, 1150)").select("fragment_id"), k=5, dim=16, lists=2, probes=2, depth=8, block=block)
        got = {}
        for r in near.orderBy("query_id", "place").collect():
            got.setdefault(r.query_id, []).append(r.other_id)
        assert got == {0: [1000, 1001, 1002, 1003, 1004], 1150: [0, 1000, 1001, 1002, 1003]}


def test_copies_do_not_displace_nearer_vectors():
    # 40 copies that the codes overrate: the two vectors nearer to the query are still among the reranked.
    class Index:
        dim, bytes = 2, 1

        def scan(self, lst, q, codes):
            return np.repeat(codes[:, 0].astype(float)[None], len(q), 0)

    copy, near = np.array([0.6, 0.8], np.float32), [np.array(v, np.float32) for v in ([1, 0], [0.8, 0.6])]
    vectors, codes = np.array([*[copy] * 40, *near]), np.array([9] * 40 + [1, 1], np.uint8)[:, None]
    cell = neighbours._Cell(Index(), 0, np.array([*range(100, 140), 1, 2]), codes, vectors, 3, 4)
    assert cell.best(np.array([7]), np.array([[1, 0]], np.float32))[1].tolist() == [1, 2, 100]


def test_exact_and_indexed_for_every_vector(spark):
    """With every row as a query: the exact way equals brute force, and the index at a few probes of two-level lists loses little."""
    x = vectors(n=1500, dim=8, seed=5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "fragment_id long, embedding array<float>")
    cosine = u @ u.T
    np.fill_diagonal(cosine, -9)
    want = np.sort(cosine, 1)[:, ::-1][:, :4]
    got = np.zeros((1500, 4))
    for r in neighbours.nearest(df, "fragment_id", "embedding", k=4, dim=8, lists=20, block=100, exact=True).collect():
        got[r.query_id, r.place - 1] = r.cosine
    assert np.allclose(got, want, atol=1e-6)
    near = neighbours.nearest(df, "fragment_id", "embedding", k=4, dim=8, lists=40, probes=10).collect()
    assert len(near) == 6000
    assert np.mean([r.cosine >= want[r.query_id, 3] - 1e-6 for r in near]) >= 0.9


def test_many_lists_are_found_in_two_levels():
    x = vectors(n=3000, dim=8, seed=6)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    c = neighbours._means(u, 700, 3, np.random.default_rng(0))
    assert 600 <= len(c) <= 800 and np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-4)


def test_tempered_mixture(spark):
    rows = [(i, s, 10) for s, n in (("a", 400), ("b", 60), ("c", 20)) for i in range(n)]
    sizes = spark.createDataFrame([(i, s, t) for i, (_, s, t) in enumerate(rows)], "doc_id long, source string, n_tokens long")
    targets, tokens = {"a": (0.5, 2), "b": (0.3, 2), "c": (0.2, 2), "none": (0.1, 2)}, {"a": 4000, "b": 600, "c": 200}
    plan, a = mixing.tempered(tokens, targets)
    assert 0 < a < 1 and abs(mixing.entropy([w for w, _ in plan.values()]) - mixing.entropy([0.5, 0.3, 0.2])) < 1e-6
    report = {r.source: r for r in mixing.temperature_report(mixing.tempered_mix(sizes, targets, tokens), tokens, targets).collect()}
    # 4800 tokens are wanted, of which c can give 400 at most: the limits bisect the exponent
    assert 0 < report["a"].limit_exponent < 1 and report["c"].tokens_taken >= 390
    assert abs(sum(r.tokens_taken for r in report.values()) - 4800) <= 30
    assert all(abs(r.actual_share - r.weight) < 0.01 and r.max_copies <= 2 for r in report.values())
