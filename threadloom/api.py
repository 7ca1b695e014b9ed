"""The service surface: ingest exports, build the graph and the search tables, search fast with refinement, search by meaning."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.errors import keyword_error
from threadloom.jobs import SearchJobs, Ticket
from threadloom.operators import embed, fragments, graph, keywords, phrases, retrieve, serving
from threadloom.session import cut, ship
from threadloom.sources import exports
from threadloom.sources.store import Store

log = logging.getLogger("threadloom")


def timed(f: Callable) -> Callable:
    """Logs how long a call took."""

    @wraps(f)
    def run(*a, **k):
        began = time.perf_counter()
        try:
            return f(*a, **k)
        finally:
            log.info("%s took %.0f ms", f.__name__, 1000 * (time.perf_counter() - began))

    return run


class Engine:
    """One archive: its tables in a `Store` and the operations on them.

    Tables: conversation, message, semantic_fragments, semantic_node, semantic_fragment_node, semantic_edge, and those of `serving`. `model` turns
    a list of texts into vectors (the default hashes features), `chunker` a text into phrases. Readers see a table as it is at their call.
    """

    def __init__(self, store: Store, model=None, chunker=phrases.rule_chunker, jobs: SearchJobs | None = None) -> None:
        ship(store.spark)
        self.spark, self.store, self.model, self.chunker = store.spark, store, model, chunker
        self.jobs = jobs or SearchJobs(store.spark)
        self._serving: serving.Serving | None = None

    @classmethod
    def open(cls, spark: SparkSession, root: str, tables: dict[str, DataFrame] | None = None, **options) -> Engine:
        """The engine of a folder; `tables` that the folder does not hold yet are taken in."""
        store = Store(spark, root)
        for name, df in (tables or {}).items():
            if not store.holds(name):
                store.replace(df, name)
        return cls(store, **options)

    def table(self, name: str) -> DataFrame:
        found = self.store.read(name)
        if found is None:
            raise ValueError(f"the archive has no table {name}")
        return found

    # ---- write path ----
    @timed
    def ingest(self, provider: str, path: str, user_id: int, mode: str = "faithful", accounts: DataFrame | None = None, **options) -> dict[str, int]:
        """Add an export to the archive; rows added by table. What is stored already, by the hash of conversation or message, is not added again.

        Conversations keep their account's ids (`accounts`: see exports.resolve_account), messages their units as content and a sequence number,
        and each text unit its fragments with vector, phrases, hash and time. Code gives no fragments. Ids follow from the content.
        """
        records = exports.identified(exports.read_export(self.spark, provider, path, **options))
        if accounts is not None:
            records = exports.resolve_account(records, accounts)
        else:
            records = records.withColumns({c: F.lit(None).cast("bigint") for c in ("affiliated_email_id", "llm_id")})
        known = self.store.read("conversation")
        if known is not None:
            records = records.join(known.select("hash"), "hash", "left_anti")
        records = cut(records)
        batch = records.agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_set(F.substring("hash", 1, 2))), F.sum(F.xxhash64("hash").cast("decimal(38,0)")).cast("string"), F.count(F.lit(1)).cast("string")), 256).alias("h")).first().h
        part = batch[:24]

        stored = self.store.read("message")
        kept = exports.dedupe_by_hash(cut(exports.message_rows(records)), ["conversation_id", "msg_pos"], stored=None if stored is None else stored.select("hash"))
        messages = cut(exports.sequence(kept, "conversation_id", "msg_pos").drop("msg_pos"))
        cut_up = fragments.fragment_units(exports.text_units(messages, "message_id"), "message_id", mode, self.model)
        number = exports.number_of(F.sha2(F.concat_ws(":", "message_id", "unit_pos", "fragment_order"), 256))
        owners = messages.select("message_id", "conversation_id").join(records.select("conversation_id", "affiliated_email_id", "llm_id"), "conversation_id")
        whole = cut(cut_up.withColumn("fragment_id", number).join(owners, "message_id").withColumnRenamed("confidence", "confidence_score").withColumn("user_id", F.lit(user_id).cast("bigint")).withColumn("created_at", F.current_timestamp()))
        named = whole.join(phrases.noun_phrases(whole, "fragment_id", "text", self.chunker).withColumnRenamed("phrases", "noun_phrases"), "fragment_id")

        conversations = records.select("conversation_id", F.col("name").alias("title"), exports.conversation_url("uuid").alias("url"), "hash", "affiliated_email_id", "llm_id", F.lit(user_id).cast("bigint").alias("user_id"), F.current_timestamp().alias("created_at"))
        # messages and fragments first: a load that fails before its conversations are stored runs again as a whole
        counts = {}
        for name, df in (("semantic_fragments", named), ("message", messages), ("conversation", conversations)):
            self.store.append(df, name, part)
            counts[name] = df.count()
        log.info("ingested %s", counts)
        return counts

    def counts(self) -> dict[str, int]:
        """Rows of every table of the archive."""
        names = ("conversation", "message", "semantic_fragments", "semantic_node", "semantic_fragment_node", "semantic_edge")
        return {n: found.count() for n in names if (found := self.store.read(n)) is not None}

    @timed
    def keywords(self) -> DataFrame:
        """(fragment_id, keyword) of every fragment."""
        try:
            scores = keywords.keyword_scores(self.table("semantic_fragments"), "fragment_id", "text")
            return keywords.normalized_keywords(keywords.select_keywords(scores, "fragment_id"), "fragment_id")
        except Exception as e:
            raise keyword_error(e) from e

    @timed
    def build_graph(self) -> None:
        """Nodes with their attributes, mappings and edges from the fragments, and the keyword tables they follow from; a second run gives the same."""
        rows = self.table("semantic_fragments")
        words = cut(self.keywords())
        found = cut(keywords.phrases_with_keywords(rows, words, "fragment_id", "user_id"))
        labels = cut(found.select("fragment_id", "user_id", F.col("phrase").alias("label")).distinct())
        existing = self.store.read("semantic_node")
        if existing is None:
            existing = self.spark.createDataFrame([], "node_id bigint, user_id bigint, label string")
        nodes = cut(graph.resolve_nodes(labels, existing.select("node_id", "user_id", "label")))
        mapping = cut(graph.map_fragments(labels, nodes).withColumn("mapping_id", F.xxhash64("fragment_id", "node_id")))
        centroids = keywords.phrase_centroids(found, keywords.keyword_centroids(rows, words, "fragment_id", "user_id"), "user_id")
        direct = graph.direct_edges(graph.phrase_pairs(labels, "fragment_id", "user_id"), nodes)
        indirect = graph.indirect_edges(graph.keyword_edges(found, "user_id"), nodes)
        self.store.replace(keywords.phrase_keywords(found, "user_id"), "phrase_keywords")
        self.store.replace(keywords.keyword_phrases(found, "user_id"), "keyword_phrases")
        self.store.replace(graph.node_attributes(nodes, mapping, centroids), "semantic_node")
        self.store.replace(mapping, "semantic_fragment_node")
        self.store.replace(graph.merge_edges(direct, indirect), "semantic_edge")

    @timed
    def build_index(self, buckets: int | None = None) -> None:
        """The tables that searches read, from the archive as it is now."""
        serving.build(self.store, self.table("semantic_fragments"), self.table("semantic_node"), self.table("semantic_fragment_node"), buckets)
        self.refresh()

    def refresh(self) -> None:
        """Let searches read the newest tables."""
        if self._serving is None:
            self._serving = serving.Serving(self.store)
        else:
            self._serving.refresh()

    # ---- read path ----
    @property
    def search(self) -> serving.Serving:
        """The stored search tables, built where they are missing."""
        if self._serving is None:
            self.refresh() if self.store.holds("links") else self.build_index()
        return self._serving

    def _answers(self, ranked: list[tuple[int, float]]) -> list[dict]:
        """message_id, score and content of at most some hundred messages, in their order."""
        stored = self.store.read("message") if ranked else None
        content = {} if stored is None else retrieve.contents(stored, [m for m, _ in ranked])
        return [{"message_id": m, "score": s, "content": content.get(m)} for m, s in ranked]

    def search_lexical(self, user_id: int, text: str, limit: int = 50) -> list[tuple[int, float]]:
        """(fragment_id, score) of the user's best fragments, best first."""
        return [(f, s) for f, _, s in self.search.lexical(user_id, text, limit)]

    def extract_messages(self, lexical_hits: DataFrame, graph_hits: DataFrame | None = None) -> list[dict]:
        """Fused messages of two hit lists (fragment_id, score), best first, with score and content. At most 20 rows reach the driver."""
        links = self.table("semantic_fragments").select("fragment_id", "message_id")
        lists = [retrieve.message_order(h.withColumn("q", F.lit(0)), links, ["q"]) for h in (lexical_hits, graph_hits) if h is not None]
        fused = retrieve.reciprocal_rank_fusion(lists, ["q"], "message_id").orderBy("place")
        return self._answers([(r.message_id, r.score) for r in fused.collect()])

    @timed
    def fast_search(self, user_id: int, query: str, seed: str = "0") -> Ticket:
        """Lexical results at once; graph refinement runs behind the ticket."""
        hits = self.search.lexical(user_id, query)
        first = self._answers(retrieve.fuse_ranks([{m: i for i, m in enumerate(retrieve.order_few(hits), 1)}]))
        if not first:
            return self.jobs.start(user_id, [], None)
        told = {a["message_id"]: a["content"] for a in first}

        def refine(cancelled) -> list[dict]:
            if cancelled.is_set():
                return first
            ranked = self.search.fused(user_id, hits, seed)
            more = {a["message_id"]: a["content"] for a in self._answers([x for x in ranked if x[0] not in told])}
            return [{"message_id": m, "score": s, "content": told.get(m, more.get(m))} for m, s in ranked]

        return self.jobs.start(user_id, first, refine)

    def refinement(self, user_id: int, search_id: str) -> Ticket:
        return self.jobs.poll(user_id, search_id)

    @timed
    def semantic_search(self, user_id: int, query: str | list[float], limit: int = 20) -> list[dict]:
        """message_id, distance and content of the nearest messages to a text or a vector, nearest first."""
        if user_id <= 0:
            raise ValueError("user id must be positive")
        if limit < 1:
            raise ValueError("limit must be positive")
        vector = query if isinstance(query, list) else embed.embed_query(query, self.model)
        near = [(r.message_id, r.distance) for r in retrieve.semantic_search(self.table("semantic_fragments"), vector, user_id, limit).collect()]
        return [{"message_id": a["message_id"], "distance": a["score"], "content": a["content"]} for a in self._answers(near)]
