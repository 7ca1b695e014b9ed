"""The concept graph: nodes, mappings, co-occurrence and keyword edges, NPMI adjacency and bounded traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.scores import npmi
from threadloom.functions.text import normalize_phrase
from threadloom.operators.skew import hot_keys, keyed_join
from threadloom.session import held

TOP_EDGES = 3
HOPS = 3
MOST_NODES = 1000


def fragment_phrases(fragments: DataFrame, key: str, user: str, phrases: str = "noun_phrases") -> DataFrame:
    """(key, user, label): normalised phrases of each fragment, distinct, without blanks."""
    rows = fragments.select(key, user, F.explode(phrases).alias("raw")).select(key, user, normalize_phrase("raw").alias("label"))
    return rows.filter("label != ''").distinct()


def phrase_pairs(found: DataFrame, key: str, user: str, chunk: int = 256) -> DataFrame:
    """(user, label_a, label_b, n) with label_a < label_b: in how many fragments two labels meet.

    Each fragment is one sorted array whose pairs are made in place. A fragment of more than `chunk` labels is cut into blocks of labels, and
    every pair of blocks is a row of its own, so no task holds a huge fragment's pairs alone.
    """
    sizes = found.groupBy(key).agg(F.count(F.lit(1)).alias("__m")).filter("__m > 1")
    sized = found.join(sizes, key)
    blocks = F.ceil(F.col("__m") / chunk).cast("int")
    placed = sized.withColumn("__b", F.pmod(F.xxhash64("label"), blocks).cast("int")).withColumn("__n", blocks)
    packed = placed.groupBy(key, user, "__n", "__b").agg(F.array_sort(F.collect_list("label")).alias("__l"))
    sent = packed.select(key, user, "__b", "__l", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__j"))
    lo, hi = F.least("__b", "__j"), F.greatest("__b", "__j")
    met = sent.groupBy(key, user, lo.alias("__lo"), hi.alias("__hi")).agg(F.max(F.when(F.col("__b") == lo, F.col("__l"))).alias("x"), F.max(F.when(F.col("__b") == hi, F.col("__l"))).alias("y"))
    inner = F.transform("x", lambda a: F.transform(F.filter("y", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    cross = F.transform("x", lambda a: F.transform("y", lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))))
    pairs = met.filter("x is not null and y is not null").select(user, F.explode(F.flatten(F.when(F.col("__lo") == F.col("__hi"), inner).otherwise(cross))).alias("p"))
    return pairs.groupBy(user, F.col("p.a").alias("label_a"), F.col("p.b").alias("label_b")).agg(F.count(F.lit(1)).alias("n"))


def resolve_nodes(labels: DataFrame, existing: DataFrame) -> DataFrame:
    """(node_id, user_id, label) of all distinct labels: known nodes keep their id, new ones get a number from a hash of user and label.

    Ids of new nodes depend only on user and label, so a second run finds the same ones and needs no ordering of all labels.
    """
    wanted = labels.select("user_id", "label").filter("label is not null and label != ''").distinct()
    known = existing.groupBy("user_id", "label").agg(F.min("node_id").alias("node_id"))
    joined = wanted.join(known, ["user_id", "label"], "left")
    # 62 bits of SHA-256 above all ids given by hand; two labels with one number are told apart by a second draw
    draw = lambda salt: F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(salt), F.col("user_id").cast("string"), "label"), 256), 1, 15), 16, 10).cast("bigint") + F.lit(1 << 62)
    numbered = joined.withColumn("__id", F.coalesce("node_id", draw("1")))
    twice = numbered.filter("node_id is null").groupBy("__id").agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct("user_id", "label")).alias("__first")).filter("__n > 1")
    apart = numbered.join(F.broadcast(twice), "__id", "left")  # collisions of 60 bits: none below some hundred million labels, few beyond
    again = F.col("node_id").isNull() & F.col("__n").isNotNull() & (F.struct("user_id", "label") != F.col("__first"))
    return apart.select(F.when(again, draw("2")).otherwise(F.col("__id")).alias("node_id"), "user_id", "label")


def map_fragments(found: DataFrame, nodes: DataFrame, key: str = "fragment_id") -> DataFrame:
    """(key, node_id, weight): each fragment and node once, weight 1."""
    joined = found.select(key, "user_id", "label").join(nodes.select("user_id", "label", "node_id"), ["user_id", "label"])
    return joined.select(key, "node_id").distinct().withColumn("weight", F.lit(1.0).cast("float"))


def node_attributes(nodes: DataFrame, mapping: DataFrame, centroids: DataFrame) -> DataFrame:
    """(node_id, user_id, label, centroid, fragment_count, avg_similarity, is_stable) of resolved nodes.

    centroid is the phrase's (`keywords.phrase_centroids`: user_id, phrase, centroid), null where it has none; fragment_count counts the
    distinct fragments of `mapping`; a node starts with an average similarity of 0 and as stable.
    """
    counted = nodes.join(node_counts(mapping), "node_id", "left")
    placed = counted.join(centroids.select("user_id", F.col("phrase").alias("label"), F.col("centroid").cast("array<float>").alias("centroid")), ["user_id", "label"], "left")
    return placed.select("node_id", "user_id", "label", "centroid", F.coalesce("fragment_count", F.lit(0)).cast("int").alias("fragment_count"), F.lit(0.0).cast("float").alias("avg_similarity"), F.lit(True).alias("is_stable"))


def node_counts(mapping: DataFrame, key: str = "fragment_id") -> DataFrame:
    """(node_id, fragment_count): distinct fragments per node; rows with a null id do not count."""
    return mapping.filter(F.col(key).isNotNull() & F.col("node_id").isNotNull()).select(key, "node_id").distinct().groupBy("node_id").agg(F.count(F.lit(1)).alias("fragment_count"))


def direct_edges(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(user_id, source_node_id, target_node_id, cooccurrence_count) with source < target; self pairs and counts of 0 are left out."""
    a = nodes.select("user_id", F.col("label").alias("label_a"), F.col("node_id").alias("a"))
    b = nodes.select("user_id", F.col("label").alias("label_b"), F.col("node_id").alias("b"))
    joined = pairs.join(a, ["user_id", "label_a"]).join(b, ["user_id", "label_b"]).filter((F.col("a") != F.col("b")) & (F.col("n") > 0))
    return joined.groupBy("user_id", F.least("a", "b").alias("source_node_id"), F.greatest("a", "b").alias("target_node_id")).agg(F.sum("n").alias("cooccurrence_count"))


def keyword_edges(phrase_keyword: DataFrame, user: str, phrase: str = "phrase", keyword: str = "keyword", block: int = 4096) -> DataFrame:
    """(user, phrase_a, phrase_b, shared, overlap) of phrases that share a keyword, each unordered pair once; overlap is Jaccard.

    Candidates come from the keyword, never from all pairs. A keyword's phrases are cut into blocks of about `block`; each pair of blocks is a key
    of its own, so the pairs of a keyword that most phrases share are made by as many tasks as they need, and a keyword of one block meets
    itself without a copy. Counts combine before their shuffle.
    """
    rows = phrase_keyword.select(user, phrase, keyword).distinct()
    sizes = rows.groupBy(user, phrase).agg(F.count(F.lit(1)).alias("k"))
    blocks = rows.groupBy(user, keyword).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__n"))
    many = hot_keys(blocks, [user, keyword], "__n", rows=2)
    placed = keyed_join(rows, blocks, [user, keyword], hot=many).withColumn("__b", F.pmod(F.xxhash64(phrase), "__n").cast("int"))
    left = placed.select(user, keyword, F.col(phrase).alias("phrase_a"), "__b", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__c"))
    right = placed.select(user, keyword, F.col(phrase).alias("phrase_b"), F.col("__b").alias("__c"), F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__b"))
    shared = left.join(right, [user, keyword, "__b", "__c"]).filter("phrase_a < phrase_b").groupBy(user, "phrase_a", "phrase_b").agg(F.count(F.lit(1)).alias("shared"))
    sized = shared.join(sizes.select(user, F.col(phrase).alias("phrase_a"), F.col("k").alias("ka")), [user, "phrase_a"]).join(sizes.select(user, F.col(phrase).alias("phrase_b"), F.col("k").alias("kb")), [user, "phrase_b"])
    return sized.select(user, "phrase_a", "phrase_b", "shared", (F.col("shared") / (F.col("ka") + F.col("kb") - F.col("shared"))).alias("overlap"))


def merge_edges(direct: DataFrame, indirect: DataFrame) -> DataFrame:
    """One row per edge with both signals; what a side lacks is 0, learned confirmations and IDF start at 0.

    npmi, fused_weight and weights_epoch are null: a new count makes any former weight void, and searches take NPMI from `stored_adjacency`.
    """
    key = ["user_id", "source_node_id", "target_node_id"]
    joined = direct.join(indirect, key, "full_outer")
    return joined.select(
        *key, F.coalesce("cooccurrence_count", F.lit(0)).alias("cooccurrence_count"), F.coalesce("shared_keyword_count", F.lit(0)).alias("shared_keyword_count"),
        F.coalesce("overlap_score", F.lit(0.0)).alias("overlap_score"), F.lit(0.0).alias("shared_keyword_idf"), F.lit(0).alias("learned_confirmations"),
        F.lit(None).cast("double").alias("npmi"), F.lit(None).cast("double").alias("fused_weight"), F.lit(None).cast("bigint").alias("weights_epoch"),
    )


def indirect_edges(overlaps: DataFrame, nodes: DataFrame, user: str = "user_id") -> DataFrame:
    """Keyword overlaps of phrases as edges of their nodes; a phrase without a node is passed over."""
    a = nodes.select("user_id", F.col("label").alias("phrase_a"), F.col("node_id").alias("a"))
    b = nodes.select("user_id", F.col("label").alias("phrase_b"), F.col("node_id").alias("b"))
    joined = overlaps.join(a, ["user_id", "phrase_a"]).join(b, ["user_id", "phrase_b"]).filter("a != b")
    return joined.select("user_id", F.least("a", "b").alias("source_node_id"), F.greatest("a", "b").alias("target_node_id"), F.col("shared").alias("shared_keyword_count"), F.col("overlap").alias("overlap_score"))


def npmi_edges(edges: DataFrame, totals: DataFrame, strict: bool = True) -> DataFrame:
    """Edges with `npmi` from N (fragments of the user), the two fragment counts and the pair count; only positive ones with a positive pair count.

    `edges` has edge_id, user_id, source_node_id, target_node_id, cooccurrence_count, source_fragment_count and target_fragment_count; `totals`
    has user_id and n. Null counts give no NPMI and so no row.
    """
    fields = ["edge_id", "user_id", "source_node_id", "target_node_id", "cooccurrence_count", "source_fragment_count", "target_fragment_count"]
    known = edges.filter("cooccurrence_count > 0 and source_fragment_count is not null and target_fragment_count is not null").select(fields)
    scored = known.join(totals.select("user_id", "n"), "user_id")
    value = npmi(F.col("n"), F.col("source_fragment_count"), F.col("target_fragment_count"), F.col("cooccurrence_count"), strict)
    return scored.withColumn("npmi", value).filter("npmi > 0")


def adjacency(scored: DataFrame, top: int = TOP_EDGES) -> DataFrame:
    """(user_id, node, neighbor, npmi, edge_id): each node's `top` edges in either direction by NPMI, ties by edge id. Does not depend on a query, so it is stored once."""
    fields = ["user_id", "npmi", "edge_id"]
    both = scored.select(F.col("source_node_id").alias("node"), F.col("target_node_id").alias("neighbor"), *fields).unionByName(scored.select(F.col("target_node_id").alias("node"), F.col("source_node_id").alias("neighbor"), *fields))
    rn = F.row_number().over(Window.partitionBy("node").orderBy(F.round("npmi", 12).desc(), "edge_id"))
    return both.withColumn("edge_rank", rn).filter(F.col("edge_rank") <= top)


def known_mapping(mapping: DataFrame, fragments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mapping rows whose fragment and node exist; mapping_id is made where the table has none."""
    known = mapping.filter("fragment_id is not null and node_id is not null")
    known = known.join(fragments.select("fragment_id"), "fragment_id", "left_semi").join(nodes.select("node_id"), "node_id", "left_semi")
    return known if "mapping_id" in known.columns else known.withColumn("mapping_id", F.xxhash64("fragment_id", "node_id"))


def counted_edges(known: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with their pair count and fragment counts, from `known_mapping`; edge_id is the pair of its nodes."""
    links = known.select("fragment_id", "node_id").distinct().join(nodes.select("node_id", "user_id"), "node_id")
    pairs = phrase_pairs(links.select("fragment_id", "user_id", F.col("node_id").alias("label")), "fragment_id", "user_id")
    counts = node_counts(known)
    side = lambda c: counts.select(F.col("node_id").alias(f"{c}_node_id"), F.col("fragment_count").alias(f"{c}_fragment_count"))
    edges = pairs.select("user_id", F.col("label_a").alias("source_node_id"), F.col("label_b").alias("target_node_id"), F.col("n").alias("cooccurrence_count"))
    return edges.join(side("source"), "source_node_id").join(side("target"), "target_node_id").withColumn("edge_id", F.struct("source_node_id", "target_node_id"))


def stored_adjacency(known: DataFrame, fragments: DataFrame, nodes: DataFrame) -> DataFrame:
    """The top edges of every node by NPMI, made from the mapping once and then stored."""
    totals = fragments.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return adjacency(npmi_edges(counted_edges(known, nodes), totals, strict=False))


def traverse(roots: DataFrame, near: DataFrame, hops: int = HOPS, most: int = MOST_NODES) -> DataFrame:
    """(node, score): the best product of root score and NPMIs over at most `hops` steps, roots included.

    `roots` has (node, score), `near` is the adjacency of the same user. Scores that are not positive and finite are dropped. Of
    more than `most` nodes the first discovered remain: roots by (score desc, id), then hop by hop by (score desc, id). With at
    most 3 edges a node, hop h has at most `most` * 3**h rows, so each frontier passes through the driver as a small local table and is broadcast:
    one short job a hop, and no hop repeats the work of those before it.
    """
    fine = lambda df: df.filter((F.col("score") > 0) & ~F.isnan("score") & (F.col("score") < float("inf")))
    frontier = held(fine(roots.groupBy("node").agg(F.max("score").alias("score"))).orderBy(F.col("score").desc(), "node").limit(most), most)
    every = frontier.withColumn("hop", F.lit(0))
    for h in range(1, hops + 1):
        step = near.join(F.broadcast(frontier.select("node", F.col("score").alias("s"))), "node").select(F.col("neighbor").alias("node"), (F.col("s") * F.col("npmi")).alias("score"))
        frontier = held(fine(step.groupBy("node").agg(F.max("score").alias("score"))), most * TOP_EDGES**h)
        every = every.unionByName(frontier.withColumn("hop", F.lit(h)))
    found = every.groupBy("node").agg(F.min(F.struct("hop", -F.col("score"))).alias("m"), F.max("score").alias("best"))
    capped = found.select("node", F.col("m.hop").alias("hop"), F.col("best").alias("score")).orderBy("hop", F.col("score").desc(), "node").limit(most)
    return capped.select("node", "score")


def seed_nodes(seeds: DataFrame, mapping: DataFrame, nodes: DataFrame, user_id: int) -> DataFrame:
    """(node, score): the best score of the seed fragments that hold a node of the user."""
    own = nodes.filter(F.col("user_id") == user_id).select("node_id")
    linked = mapping.select("fragment_id", "node_id").join(F.broadcast(seeds.select("fragment_id", "score")), "fragment_id").join(own, "node_id", "left_semi")
    return linked.groupBy(F.col("node_id").alias("node")).agg(F.max("score").alias("score"))


def fragment_hits(best: DataFrame, mapping: DataFrame) -> DataFrame:
    """(fragment_id, mapping_id, score): each fragment's best node; at equal scores the smaller mapping id. At most 1,000 nodes are broadcast."""
    links = mapping.filter("fragment_id is not null").select("fragment_id", "mapping_id", F.col("node_id").alias("node"))
    joined = links.join(F.broadcast(best.select("node", "score")), "node").select("fragment_id", "mapping_id", "score")
    pick = F.min_by(F.struct("mapping_id", "score"), F.struct(-F.col("score"), F.col("mapping_id")))
    return joined.groupBy("fragment_id").agg(pick.alias("p")).select("fragment_id", "p.mapping_id", "p.score")
