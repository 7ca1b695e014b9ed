import itertools
import math
import random
from collections import Counter

import numpy as np

from threadloom.llm import cooccurrence as co
from threadloom.llm import distinctive, rankwalk


def brute_pairs(rows, totals, least_common, least_npmi):
    baskets, count = {}, Counter()
    for b, i, _ in rows:
        baskets.setdefault(b, set()).add(i)
        count[i] += 1
    user = {i: u for _, i, u in rows}
    pairs = Counter(p for items in baskets.values() for p in itertools.combinations(sorted(items), 2) if user[p[0]] == user[p[1]])
    out = {}
    for (a, b), n in pairs.items():
        total = totals[user[a]]
        if least_common <= n < total:
            v = math.log(n * total / (count[a] * count[b])) / -math.log(n / total)
            if v >= least_npmi:
                out[a, b] = (n, round(v, 9))
    return out


def test_pairs_against_brute_force(spark):
    rng = random.Random(4)
    totals = {1: 60, 2: 60}
    rows = []
    for b in range(60):
        u = 1 + b % 2
        items = set(rng.sample(range(100 * u, 100 * u + 40), rng.choice([0, 1, 5, 30])))
        if b % 3 == 0:
            items |= {100 * u + 1, 100 * u + 2}
        rows += [(b, i, u) for i in items | {100 * u}]
    df = spark.createDataFrame([(b, i, u, totals[u]) for b, i, u in rows], "basket long, item long, user_id long, n_total long")
    for chunk in (4, 64):
        for common, least in ((4, 0.3), (1, -1.0)):
            got = {(r.node_lo, r.node_hi): (r.n_common, round(r.npmi, 9)) for r in co.cooccurrence(df, common, least, chunk).collect()}
            assert got == brute_pairs(rows, totals, common, least)
    assert co.cooccurrence(df.limit(0)).count() == 0


def test_baskets_pass_over_what_does_not_exist(spark):
    m = spark.createDataFrame([(1, 1), (1, 1), (1, None), (None, 1), (9, 1), (1, 9)], "fragment_id long, node_id long")
    f = spark.createDataFrame([(1, 5), (2, 5)], "fragment_id long, user_id long")
    n = spark.createDataFrame([(1, 5, "x")], "node_id long, user_id long, item string")
    assert [tuple(r) for r in co.node_baskets(m, f, n).collect()] == [(1, 1, 5, 2)]


def test_distinctive_terms(spark):
    rows = [(1, "Rare rare rare the graph"), (2, "the graph rare"), (3, "the graph the"), (4, ""), (5, None), (6, "only_here only_here the")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "fragment_id long, text string, term string")
    got = {(r.record, r.term): r.score for r in distinctive.distinctiveness(df, "fragment_id", "text", mu=2.0).collect()}
    assert all(t != "only_here" for _, t in got) and {r for r, _ in got} == {1, 2, 3, 6}
    total, cf = 14, Counter("rare rare rare the graph the graph rare the graph the only_here only_here the".split())
    p = (3 + 2.0 * cf["rare"] / total) / (5 + 2.0)
    assert math.isclose(got[1, "rare"], p * math.log(p / (cf["rare"] / total)), rel_tol=1e-9)
    lead = {r.record: r.term for r in distinctive.leaders(distinctive.distinctiveness(df, "fragment_id", "text")).collect()}
    assert lead[1] == "rare"
    only = spark.createDataFrame([(2,)], "record long")
    assert {r.record for r in distinctive.distinctiveness(df, "fragment_id", "text", only=only).collect()} == {2}
    assert distinctive.distinctiveness(df.limit(0), "fragment_id", "text").count() == 0


def naive_walk(scores, damping, steps):
    n = len(scores[0])
    p = np.zeros((n, n))
    for s in scores:
        there = ~np.isnan(s)
        for i in range(n):
            to = there & (s >= s[i]) if there[i] else there
            if there[i] and not (there & (s > s[i])).any() or not to.any():
                to = np.ones(n, bool)
            p[i] += to / to.sum() / len(scores)
    x = np.full(n, 1 / n)
    for _ in range(steps):
        x = (1 - damping) / n + damping * x @ p
    return x


def test_walk_against_its_matrix():
    rng = np.random.default_rng(2)
    groups, parts = [], [[], [], []]
    for g in range(12):
        n = int(rng.integers(1, 15))
        groups += [g] * n
        for k in range(3):
            s = rng.integers(0, 5, n).astype(float)
            s[rng.random(n) < 0.3] = np.nan
            parts[k].append(s)
    group, scores = np.array(groups), [np.concatenate(p) for p in parts]
    got = rankwalk.walk(group, scores)
    for g in range(12):
        own = group == g
        assert np.allclose(got[own], naive_walk([s[own] for s in scores], rankwalk.DAMPING, rankwalk.STEPS))
        assert math.isclose(got[own].sum(), 1, rel_tol=1e-9)
    assert len(rankwalk.walk(np.array([], int), [np.array([])] * 3)) == 0


def test_combine_both_ways(spark):
    rng = random.Random(5)
    nan = float("nan")
    pick = lambda: rng.choice([None, nan, float("inf"), 1.0, 2.0, rng.random() * 1e6])
    lex = [(s, f, pick()) for s in ("a", "b", None) for f in (*range(12), None, 3)]
    gr = [(s, f, pick(), pick()) for s in ("a", "c") for f in (*range(5, 20), 7)]
    lexical = spark.createDataFrame([(*r, 1.0) for r in lex], "search_id string, fragment_id long, score float, weight double")
    graph = spark.createDataFrame(gr, "search_id string, fragment_id long, score double, npmi double")
    run = lambda **k: {(r.search_id, r.fragment_id): r.weight for r in rankwalk.combine(lexical, graph, steps=4, **k).collect()}
    one, two = run(), run(local_items=15)
    assert one.keys() == two.keys() and all(math.isclose(one[k], two[k], rel_tol=1e-9) for k in one)
    assert {s for s, _ in one} == {"a", "b", "c"}
    assert rankwalk.head(rankwalk.combine(lexical, graph), 3).count() == 9
    assert rankwalk.combine(lexical.limit(0), graph.limit(0)).count() == 0


def test_no_score_dominates(spark):
    lexical = spark.createDataFrame([("s", 1, 1e9), ("s", 2, 5.0), ("s", 3, 4.0), ("s", 4, 3.0), ("s", 5, 2.0), ("s", 6, 1.0)], "search_id string, fragment_id long, score float")
    graph = spark.createDataFrame([("s", 7, 9.0, 0.9), ("s", 2, 5.0, 0.8), ("s", 3, 4.0, 0.7), ("s", 4, 3.0, 0.6), ("s", 5, 0.1, 0.1), ("s", 6, 0.0, 0.0), ("s", 1, 0.0, -0.5)], "search_id string, fragment_id long, score double, npmi double")
    first = [r.fragment_id for r in rankwalk.head(rankwalk.combine(lexical, graph), 2).orderBy("place").collect()]
    assert first[0] == 2 and 1 not in first
