import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from threadloom.operators import fragments, graph, keywords, lexical, phrases, retrieve


def test_postings_and_stats(spark):
    docs = spark.createDataFrame([(1, "a b a", 9), (2, "", 9), (3, None, 9), (4, "b ü_1", 9)], "i int, t string, term int")
    got = {(r.i, r.term): (r.tf, r.dl) for r in lexical.postings(docs, "i", "t").collect()}
    assert got == {(1, "a"): (2, 3), (1, "b"): (1, 3), (4, "b"): (1, 2), (4, "ü_1"): (1, 2)}
    s = lexical.corpus_stats(docs, "t").first()
    assert s.n_docs == 4 and s.avgdl == 2.5
    assert lexical.corpus_stats(docs.limit(0), "t").first().avgdl == 1.0


def test_fuzzy_terms(spark):
    vocabulary = spark.createDataFrame([("graph", 3), ("grpah", 1), ("graphs", 2), ("grips", 1), ("no", 4), ("parser", 1), ("praser", 1)], "term string, df long")
    asked = spark.createDataFrame([("graph",), ("no",), ("parsers",)], "token string")
    got = {(r.token, r.term): r.edits for r in lexical.fuzzy_terms(asked, vocabulary).collect()}
    assert got == {("graph", "graph"): 0, ("graph", "grpah"): 1, ("graph", "graphs"): 1, ("parsers", "parser"): 1, ("parsers", "praser"): 2}
    assert lexical.fuzzy_terms(asked, vocabulary, 1).filter("token = 'graph'").first().term == "graph"


def test_search(spark):
    docs = spark.createDataFrame([(1, 1, "kafka topic"), (2, 1, "kafka kafka"), (3, 2, "kafka"), (4, 1, "topic")], "i int, u int, t string")
    got = [r.i for r in lexical.search(docs, "i", "t", "Kafka", ("u", 1)).collect()]
    assert got == [2, 1]
    assert lexical.search(docs, "i", "t", "!!", ("u", 1)).count() == 0
    for bad in ("", " ", "x" * 501):
        with pytest.raises(ValueError):
            lexical.search(docs, "i", "t", bad)
    with pytest.raises(ValueError):
        lexical.search(docs, "i", "t", "x", ("u", 0))


def test_keyword_selection(spark):
    rows = spark.createDataFrame([(1, t, s) for t, s in zip("abcdef", (5.0, 4.0, 3.0, 2.0, 1.7, 1.0))] + [(2, "z", 0.0)], "i int, term string, score double")
    assert sorted(r.term for r in keywords.select_keywords(rows, "i").collect()) == ["a", "b", "c"]


def test_pairs_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(f, 1, w) for f in range(40) for w in rng.sample([f"w{i}" for i in range(30)], rng.randint(0, 25))]
    df = spark.createDataFrame(rows, "f int, u int, label string")
    want = {}
    for f in range(40):
        for a, b in itertools.combinations(sorted(w for g, _, w in rows if g == f), 2):
            want[a, b] = want.get((a, b), 0) + 1
    for chunk in (3, 256):
        assert {(r.label_a, r.label_b): r.n for r in graph.phrase_pairs(df, "f", "u", chunk).collect()} == want
    assert graph.phrase_pairs(df.limit(0), "f", "u").count() == 0


def test_keyword_edges(spark):
    rows = [(1, "p", k) for k in "abc"] + [(1, "q", k) for k in "bcde"] + [(1, "r", "z")]
    got = graph.keyword_edges(spark.createDataFrame(rows, "u int, phrase string, keyword string"), "u").collect()
    assert [(r.phrase_a, r.phrase_b, r.shared, r.overlap) for r in got] == [("p", "q", 2, 0.4)]


def test_traversal(spark):
    edges = [(1, 2, 0.5), (1, 3, 0.4), (2, 4, 0.8), (3, 4, 0.9), (4, 5, 0.2)]
    near = spark.createDataFrame(edges + [(b, a, w) for a, b, w in edges], "node long, neighbor long, npmi double")
    roots = spark.createDataFrame([(1, 2.0), (9, float("nan")), (8, -1.0)], "node long, score double")
    got = {r.node: round(r.score, 6) for r in graph.traverse(roots, near).collect()}
    assert got == {1: 2.0, 2: 1.0, 3: 0.8, 4: 0.8, 5: 0.16}
    assert graph.traverse(roots, near, most=2).count() == 2


def test_nodes_and_edges(spark):
    labels = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (1, "")], "user_id long, label string")
    existing = spark.createDataFrame([(5, 1, "a")], "node_id long, user_id long, label string")
    nodes = graph.resolve_nodes(labels, existing)
    first = {r.label: r.node_id for r in nodes.collect()}
    assert first["a"] == 5 and len(first) == 2 and first == {r.label: r.node_id for r in graph.resolve_nodes(labels, nodes.select("node_id", "user_id", "label")).collect()}
    pairs = spark.createDataFrame([(1, "a", "b", 3)], "user_id long, label_a string, label_b string, n long")
    e = graph.direct_edges(pairs, nodes).first()
    assert e.source_node_id < e.target_node_id and e.cooccurrence_count == 3


def test_rank_fusion(spark):
    mk = lambda ids: spark.createDataFrame([(0, m, i + 1) for i, m in enumerate(ids)], "q int, m int, rank int")
    got = {r.m: round(r.score, 6) for r in retrieve.reciprocal_rank_fusion([mk([7, 3, 9]), mk([3, 5])], ["q"], "m").collect()}
    assert got == {3: 0.032522, 7: 0.016393, 5: 0.016129, 9: 0.015873}


def test_seed_counts(spark):
    hits = spark.createDataFrame([(n, i, float(100 - i)) for n in (50, 20, 21) for i in range(n)], "q int, i int, s double")
    got = {(r.q, r.drawn): r["count"] for r in retrieve.select_seeds(hits, "i", "s", ["q"]).groupBy("q", "drawn").count().collect()}
    assert got == {(50, False): 12, (50, True): 13, (20, False): 10, (20, True): 10, (21, False): 5, (21, True): 5}


def test_reciprocal_rank(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (2, "a", 3), (3, "a", 4)], "q int, i string, rank int")
    relevant = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a")], "q int, i string")
    r = retrieve.reciprocal_rank(ranked, relevant, "q", "i").first()
    assert round(r.mrr, 6) == 0.333333 and r.n_queries == 4


def test_chunker():
    import numpy as np

    got = fragments.fold([np.array(v) for v in ([1, 0], [0.9, 0.1], [0.8, 0.5], [0, 1], [0.1, 1])], 0.75)
    assert [m for m, _, _ in got] == [[0, 1, 2], [3, 4]]
    assert [round(c, 6) for _, c, _ in got] == [0.78307, 0.004963]
    assert np.allclose(got[0][2], [0.9, 0.2]) and np.allclose(got[1][2], [0.05, 1])
    assert fragments.fold([]) == []


def test_faithful_mode(spark):
    rows = spark.createDataFrame([(1, "One thing here\n\nAnother thing\n\nA third"), (2, None), (3, "--")], "i long, t string")
    got = fragments.fragment_messages(rows, "i", "t").collect()
    assert [(r.i, r.fragment_order, r.confidence) for r in got] == [(1, 1, 0.0)]
    assert fragments.fragment_messages(rows, "i", "t", "paragraph").filter("i = 1").count() >= 2


def test_phrases(spark):
    assert phrases.rule_chunker("The index out of bounds was seen in camelCase code.") == ["index", "bounds", "seen", "camelCase code"]
    assert phrases.rule_chunker("the very kafka", stop_words={"the", "very", "kafka"}, dictionary=frozenset({"kafka"})) == ["kafka"]
    df = spark.createDataFrame([(1, None), (2, ""), (3, "the big graph of nodes")], "i int, t string")
    assert {r.i: r.phrases for r in phrases.noun_phrases(df, "i", "t").collect()} == {1: [], 2: [], 3: ["big graph", "nodes"]}


def test_phrases_of_long_texts():
    """Nothing is cut off: the last words of a long text and of a long sentence count, and a run goes on from one window to the next."""
    text = "of " * 60_000 + "last phrase"
    assert phrases.rule_chunker(text) == ["last phrase"]
    words = ["of"] * (phrases.WINDOW - 1) + ["alpha", "beta"]
    assert phrases.rule_chunker(" ".join(words)) == ["alpha beta"]


def test_a_sentence_that_fails_costs_itself_only():
    def tagger(words):
        if "bad" in words:
            raise ValueError
        return phrases.rule_tagger(words)

    told = []
    assert phrases.rule_chunker("good one. bad one. good two", tagger=tagger, failed=told.append) == ["good one", "good two"]
    assert told == ["bad one."]


def test_jobs_sweep():
    from threadloom.jobs import FAILED, SearchJobs

    jobs = SearchJobs(workers=1, queue=5, budget=0.4, retention=0.3, sweep=0.1)
    jobs.start(1, [], lambda c: time.sleep(1.5) or [])
    waiting = jobs.start(1, ["w"], lambda c: ["x"])
    time.sleep(0.7)
    # the worker is still busy, yet the one that waits is over its budget
    assert waiting.search_id not in jobs._jobs or jobs._jobs[waiting.search_id].ticket.status == FAILED
    time.sleep(0.6)
    assert not jobs._jobs  # dropped without anyone asking
    jobs.close()


def test_jobs():
    from threadloom.errors import EngineError
    from threadloom.jobs import COMPLETED, FAILED, RUNNING, SearchJobs

    jobs = SearchJobs(workers=1, queue=1, budget=0.5, most=3)
    t = jobs.start(1, ["first"], lambda c: ["better"])
    time.sleep(0.2)
    assert jobs.poll(1, t.search_id).status == COMPLETED and jobs.poll(1, t.search_id).results == ["better"]
    with pytest.raises(EngineError):
        jobs.poll(2, t.search_id)
    slow = jobs.start(1, ["first"], lambda c: time.sleep(1) or ["late"])
    waiting = jobs.start(1, ["w"], lambda c: ["x"])
    refused = jobs.start(1, ["kept"], lambda c: ["x"])
    assert slow.status == RUNNING and waiting.status == RUNNING
    assert jobs.poll(1, refused.search_id).status == FAILED and jobs.poll(1, refused.search_id).results == ["kept"]
    time.sleep(1.2)
    assert jobs.poll(1, slow.search_id).status == FAILED and jobs.poll(1, slow.search_id).results == ["first"]
    assert jobs.start(1, [], None).status == COMPLETED
    jobs.close()


def test_engine(spark, tmp_path):
    from threadloom.api import Engine

    frags = [(i, 100 + i // 2, 1, t, ["kafka topic", "slow cache"], [1.0, float(i)]) for i, t in enumerate(["kafka topic is slow", "kafka cache", "slow cache here", "other words", "kafka topic again"])]
    tables = {
        "semantic_fragments": spark.createDataFrame(frags, "fragment_id long, message_id long, user_id long, text string, noun_phrases array<string>, embedding array<float>"),
        "semantic_node": spark.createDataFrame([(1, 1, "kafka topic"), (2, 1, "slow cache")], "node_id long, user_id long, label string"),
        "semantic_fragment_node": spark.createDataFrame([(1, 0, 1), (2, 0, 2), (3, 4, 1), (4, 2, 2), (5, 4, 2), (6, None, 2)], "mapping_id long, fragment_id long, node_id long"),
        "message": spark.createDataFrame([(100, [("TEXT", "hello")]), (102, None)], "message_id long, content array<struct<type:string,text:string>>"),
    }
    engine = Engine.open(spark, str(tmp_path), tables)
    ticket = engine.fast_search(1, "kafka")
    assert [r["message_id"] for r in ticket.results] == [100, 102] and ticket.status == "RUNNING"
    assert [r["content"] for r in ticket.results] == [[{"type": "TEXT", "text": "hello"}], None]
    for _ in range(150):
        done = engine.refinement(1, ticket.search_id)
        if done.status != "RUNNING":
            break
        time.sleep(0.2)
    assert done.status == "COMPLETED" and {r["message_id"] for r in done.results} == {100, 101, 102} and done.results[0]["content"]
    near = engine.semantic_search(1, [1.0, 4.0], 2)
    assert [r["message_id"] for r in near] == [102, 101] and near[0]["distance"] < 1e-6
    engine.build_graph()
    nodes = {r.label: r for r in engine.table("semantic_node").collect()}
    assert nodes["kafka topic"].node_id == 1 and nodes["kafka topic"].fragment_count > 0 and len(nodes["kafka topic"].centroid) == 2 and nodes["slow cache"].is_stable
    assert engine.table("semantic_edge").columns[-3:] == ["npmi", "fused_weight", "weights_epoch"]
    engine.build_index()
    assert engine.fast_search(1, "kafka").results and engine.counts()["semantic_node"] == len(nodes)
    with pytest.raises(ValueError):
        engine.semantic_search(0, [1.0])
    engine.jobs.close()


def test_serving_is_the_search_it_stores(spark, tmp_path):
    """The stored search gives what the searches over DataFrames give, also for swaps, long tokens and tokens without a match."""
    import random

    from threadloom.operators import serving
    from threadloom.sources.store import Store

    rng = random.Random(4)
    words = ["graph", "grpah", "graphs", "parser", "praser", "kafka", "kafak", "x" * 30, "x" * 29 + "y", "ab", "abc", "session", "sesison", "café", "naïve"]
    frags = [(i, i // 3, 1 + i % 2, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for i in range(150)] + [(900, 7, None, "graph parser"), (901, None, 1, "graph graph")]
    df = spark.createDataFrame(frags, "fragment_id long, message_id long, user_id long, text string")
    nodes = spark.createDataFrame([(n, 1 + n % 2, str(n)) for n in range(12)], "node_id long, user_id long, label string")
    mapping = spark.createDataFrame([(k, rng.randrange(150), rng.randrange(12)) for k in range(500)], "mapping_id long, fragment_id long, node_id long")
    store = Store(spark, str(tmp_path))
    serving.build(store, df, nodes, mapping, buckets=2)
    search = serving.Serving(store)
    index = lexical.build_index(df, "fragment_id", "text", "user_id")
    for query in ("grahp parsers", "KAFKA session ab", "x" * 30, "nothing", "!!", "café " + "y" * 40):
        want = [(r.fragment_id, round(r.score, 9)) for r in lexical.search_index(index, query, 1).collect()]
        assert [(f, round(x, 9)) for f, _, x in search.lexical(1, query)] == want
    hits = search.lexical(1, "graph kafka")
    near = graph.stored_adjacency(graph.known_mapping(mapping, df, nodes), df, nodes).filter("user_id = 1")
    table = spark.createDataFrame([(0, f, x) for f, _, x in hits], "q int, fragment_id long, score double")
    seeds = retrieve.select_seeds(table, "fragment_id", "score", ["q"]).select("fragment_id", "score")
    assert sorted((r.fragment_id, r.score) for r in seeds.collect()) == sorted(retrieve.seeds_few([(f, x) for f, _, x in hits]))
    reached = graph.traverse(graph.seed_nodes(seeds, mapping, nodes, 1), near)
    assert {r.node: round(r.score, 9) for r in reached.collect()} == {n: round(x, 9) for n, x in search.reached(1, retrieve.seeds_few([(f, x) for f, _, x in hits])).items()}
    links = df.select("fragment_id", "message_id")
    lists = [retrieve.message_order(x, links, ["q"]) for x in (table, graph.fragment_hits(reached, mapping.join(nodes.filter("user_id = 1"), "node_id", "left_semi")).withColumn("q", F.lit(0)))]
    for limit in (20, 3):
        fused = retrieve.reciprocal_rank_fusion(lists, ["q"], "message_id", limit=limit).orderBy("place")
        assert [(r.message_id, round(r.score, 9)) for r in fused.collect()] == [(m, round(x, 9)) for m, x in search.fused(1, hits, limit=limit)]
    # a new version is seen after refresh
    serving.build(store, df.filter("fragment_id = 0"), nodes, mapping, buckets=2)
    search.refresh()
    assert {f for f, _, _ in search.lexical(1, "graph parser kafka session")} <= {0}


def test_keyword_edges_in_blocks(spark):
    rows = [(1, f"p{i}", "all") for i in range(40)] + [(1, f"p{i}", f"k{i % 7}") for i in range(40)]
    df = spark.createDataFrame(rows, "u int, phrase string, keyword string")
    one, many = ({tuple(r) for r in graph.keyword_edges(df, "u", block=b).collect()} for b in (4096, 6))
    assert one == many and len(one) == 40 * 39 // 2


def test_extra_columns_do_not_clash(spark):
    hits = spark.createDataFrame([(1, 5, 2.0, "x", 1)], "q int, fragment_id long, score double, s string, f int")
    links = spark.createDataFrame([(5, 50, "y")], "fragment_id long, message_id long, score string")
    assert retrieve.message_order(hits, links, ["q"]).first().message_id == 50
    mapping = spark.createDataFrame([(1, 5, 2, 9.0, 9.0, "z")], "mapping_id long, fragment_id long, node_id long, fragment_count double, score double, node string")
    assert graph.node_counts(mapping).first().fragment_count == 1
    nodes = spark.createDataFrame([(2, 1, "a", 3.0)], "node_id long, user_id long, label string, score double")
    roots = graph.seed_nodes(hits, mapping, nodes, 1)
    assert [tuple(r) for r in roots.collect()] == [(2, 2.0)]
    assert [tuple(r) for r in graph.fragment_hits(roots, mapping).collect()] == [(5, 1, 2.0)]
    edges = spark.createDataFrame([(1, 1, 2, 3, 3, 4, 5, 0.0, 7)], "edge_id long, user_id long, source_node_id long, target_node_id long, cooccurrence_count long, source_fragment_count long, target_fragment_count long, npmi double, n long")
    totals = spark.createDataFrame([(1, 10, 0.5)], "user_id long, n long, npmi double")
    assert round(graph.npmi_edges(edges, totals).first().npmi, 6) == 0.336773
    from threadloom.operators.embed import embed_text

    assert embed_text(spark.createDataFrame([("a", 1), (None, 2)], "t string, embedding int"), "t").columns == ["t", "embedding"]


def test_nested_values_and_roots(spark):
    from threadloom.operators import nested
    from threadloom.plans import problems

    block = "struct<type:string,text:string,thinking:string,message:string,name:string,citations:array<string>,content:array<string>,display_content:string,input:struct<id:string,type:string,title:string,command:string,content:string,language:string,version_uuid:string>>"
    message = f"struct<uuid:string,parent_message_uuid:string,index:int,text:string,sender:string,created_at:timestamp,updated_at:timestamp,content:array<{block}>,attachments:array<struct<id:string,file_name:string,file_size:bigint,file_type:string,extracted_content:string>>,files:array<struct<file_uuid:string,file_name:string,file_type:string,file_size:bigint,created_at:timestamp>>>"
    schema = f"delivery_id long, batch_no int, uuid string, name string, summary string, created_at timestamp, updated_at timestamp, account struct<uuid:string,email:string>, chat_messages array<{message}>"
    b = ("text", "t", None, None, None, ['{"b": 1,  "a": 2}', None, "no json"], ["[1,  2]"], None, None)

    def said(text):
        return ("m", None, 0, text, "human", None, None, [None, b], None, None)

    def record(delivery, messages):
        return (delivery, delivery, "u", "n", None, None, None, ("a", "e"), messages)

    rows = [record(1, [said("x"), None]), record(2, [said("x"), None]), record(3, [said("y"), None]), record(4, [said("x")]), record(5, None), record(6, [])]
    df = spark.createDataFrame(rows, schema)
    one = df.filter("delivery_id = 1")
    assert [tuple(r) for r in nested.typed(one, "citation").orderBy("item_pos").collect()] == [(1, 0, 1, 0, '{"b": 1,  "a": 2}'), (1, 0, 1, 2, "no json")]
    assert [tuple(r) for r in nested.typed(one, "nested").collect()] == [(1, 0, 1, 0, "[1,  2]")]
    bridge = nested.rooted(df).collect()
    top = {r.delivery_id: r.node_hash for r in bridge if r.kind == "conversation"}
    assert top[1] == top[2] and top[5] != top[6] and len(set(top.values())) == 5
    assert all(r.parent_hash == top[r.delivery_id] for r in bridge if r.kind == "message")
    stored = {r.node_hash: r.n_occurrences for r in nested.objects(nested.rooted(df)).filter("kind = 'conversation'").collect()}
    assert stored[top[1]] == 2 and len(stored) == 5
    assert {"p5_citations", "p5_nested"} <= set(problems.QUERIES)


def test_messages_without_stored_hash_are_numbered(spark, tmp_path):
    from pyspark.sql import functions as F

    from threadloom.functions.identity import message_hash
    from threadloom.plans import text_queries

    rows = [(1, "c", "human", "a", None), (2, "c", "assistant", "b", "h"), (3, "c", "human", " a ", None), (4, "c", "human", "d", None), (5, "d", "user", "e", None)]
    df = spark.createDataFrame(rows, "delivery_id long, conversation_uuid string, sender string, text string, hash string")
    # delivery 3 repeats 1, whose hash is stored in one and computed in the other
    df.withColumn("hash", F.when(F.col("delivery_id") == 3, message_hash("sender", "text")).otherwise(F.col("hash"))).write.parquet(f"{tmp_path}/chat_message.parquet")
    assert sorted(r.delivery_id for r in text_queries.QUERIES["dedupe_by_conversation_whole"](spark, str(tmp_path)).collect()) == [1, 2, 4, 5]
    got = sorted(tuple(r) for r in text_queries.QUERIES["sequence_numbers_whole"](spark, str(tmp_path)).collect())
    assert got == [(1, "c", 0), (2, "c", 1), (4, "c", 2), (5, "d", 0)]
