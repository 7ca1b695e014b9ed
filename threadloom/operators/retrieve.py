"""Fusion and retrieval: seeds, sampling, reciprocal ranks, vector search, and fast search with graph refinement."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.scores import chance_order, sampling_weight, uniform
from threadloom.functions.vectors import cosine_similarity, usable
from threadloom.operators.skew import keyed_join

RRF_K = 60
MOST_MESSAGES = 20


def _order(score: str, key: str) -> list[Column]:
    return [F.col(score).desc(), F.col(key)]


def sample_without_replacement(rows: DataFrame, key: str, score: str, k: int | Column, group: list[str] | None = None, temperature: float = 0.4, seed: str = "0") -> DataFrame:
    """`k` rows per group, drawn one after another with chances exp((s - 1) / T) of the scaled score; reproducible by `seed`.

    Weights stay the same over the draws, so the k smallest -ln(u)/w are such a sample. u comes from a hash of seed and key.
    """
    group = group or []
    every = Window.partitionBy(*group)
    weight = sampling_weight(F.col(score), F.min(score).over(every), F.max(score).over(every), temperature)
    drawn = rows.withColumn("__c", chance_order(weight, uniform(seed, F.col(key))))
    rn = F.row_number().over(Window.partitionBy(*group).orderBy("__c", key))
    return drawn.withColumn("__rn", rn).filter(F.col("__rn") <= (k if isinstance(k, Column) else F.lit(k))).drop("__c", "__rn")


def select_seeds(hits: DataFrame, key: str, score: str, group: list[str], seed: str = "0") -> DataFrame:
    """(group, key, score, drawn): up to 20 hits all of them, of more half of them: the best 50 % of that half and a sample of the rest.

    With n hits m = n if n <= 20 else n // 2; the first 50 * m // 100 by score, then m minus that many drawn from the others.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    rn = F.row_number().over(Window.partitionBy(*group).orderBy(*_order(score, key)))
    sized = hits.select(*group, key, score, n.alias("n"), rn.alias("rn"))
    m = F.when(F.col("n") > 20, F.floor(F.col("n") / 2)).otherwise(F.col("n"))
    fixed = sized.withColumn("m", m).withColumn("d", F.floor(F.lit(50) * F.col("m") / 100))
    best = fixed.filter(F.col("rn") <= F.col("d")).select(*group, key, score, F.lit(False).alias("drawn"))
    rest = sample_without_replacement(fixed.filter(F.col("rn") > F.col("d")), key, score, F.col("m") - F.col("d"), group, seed=seed)
    return best.unionByName(rest.select(*group, key, score, F.lit(True).alias("drawn")))


def message_order(hits: DataFrame, links: DataFrame, group: list[str], fragment: str = "fragment_id", message: str = "message_id", score: str = "score") -> DataFrame:
    """(group, message, rank) of a hit list: messages in order of their first fragment by (score desc, fragment), ranks from 1.

    Repeated fragments count once, with their best score. Scores that are null, NaN or not positive drop out, as do fragments without a message.
    """
    fine = hits.filter(F.col(fragment).isNotNull() & (F.col(score) > 0) & ~F.isnan(score) & (F.col(score) < float("inf")))
    once = fine.groupBy(*group, fragment).agg(F.max(score).alias(score))
    linked = once.join(links.select(fragment, message).filter(F.col(message).isNotNull()), fragment)
    first = linked.groupBy(*group, message).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(fragment).alias("f"))).alias("first"))
    return first.select(*group, message, F.row_number().over(Window.partitionBy(*group).orderBy("first.s", "first.f", message)).alias("rank"))


def reciprocal_rank_fusion(lists: list[DataFrame], group: list[str], key: str, k: int = RRF_K, limit: int | None = MOST_MESSAGES) -> DataFrame:
    """(group, key, score, place): the sum of 1 / (k + rank) over the lists, the `limit` best per group, ties by key."""
    every = lists[0].select(*group, key, "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select(*group, key, "rank"))
    fused = every.groupBy(*group, key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.round("score", 12).desc(), key))
    ranked = fused.withColumn("place", place)
    return ranked.filter(F.col("place") <= limit) if limit else ranked


def order_few(hits: list[tuple[int, int | None, float]]) -> list[int]:
    """The messages of at most some hundred (fragment, message, score) on the driver, in the order of `message_order`."""
    best: dict[int, tuple[float, int]] = {}
    for f, m, s in hits:
        if f is not None and m is not None and s is not None and 0 < s < float("inf"):
            best[f] = max((s, m), best.get(f, (0.0, m)))
    return list(dict.fromkeys(m for _, _, m in sorted((-s, f, m) for f, (s, m) in best.items())))


def fuse_ranks(lists: list[dict[int, int]], k: int = RRF_K, limit: int = MOST_MESSAGES) -> list[tuple[int, float]]:
    """(key, score) of lists of ranks of at most some hundred keys, the same as `reciprocal_rank_fusion`."""
    score: dict[int, float] = {}
    for ranks in lists:
        for key, rank in ranks.items():
            score[key] = score.get(key, 0.0) + 1.0 / (k + rank)
    return sorted(score.items(), key=lambda x: (-round(x[1], 12), x[0]))[:limit]


def seeds_few(hits: list[tuple[int, float]], seed: str = "0", temperature: float = 0.4) -> list[tuple[int, float]]:
    """(key, score) of the seeds of at most some hundred hits on the driver, the same as `select_seeds`."""
    ranked = sorted(hits, key=lambda x: (-x[1], x[0]))
    m = len(ranked) // 2 if len(ranked) > 20 else len(ranked)
    best, rest = ranked[: 50 * m // 100], ranked[50 * m // 100 :]
    if not rest:
        return best
    low, high = min(s for _, s in rest), max(s for _, s in rest)

    def chance(f: int, s: float) -> float:
        u = (int(hashlib.sha256(f"{seed}:{f}".encode()).hexdigest()[:12], 16) + 0.5) / 16**12
        return -math.log(u) / math.exp(((s - low) / (high - low) if high > low else 1.0) / temperature - 1 / temperature)

    return best + sorted(rest, key=lambda x: (chance(*x), x[0]))[: m - len(best)]


def message_distances(fragments: DataFrame, query: list[float], embedding: str = "embedding", message: str = "message_id") -> DataFrame:
    """(message, distance): each message's least cosine distance to the query. Vectors that are null, zero, not finite or of another dimension take no part."""
    fine = fragments.filter(F.col(message).isNotNull() & usable(embedding, len(query)))
    vector = F.array(*[F.lit(float(x)) for x in query])
    return fine.groupBy(message).agg(F.min(1 - cosine_similarity(F.col(embedding), vector)).alias("distance"))


def semantic_search(fragments: DataFrame, query: list[float], user_id: int, limit: int = 20) -> DataFrame:
    """(message_id, distance) of the user's `limit` nearest messages by exact scan, ties by message id."""
    return message_distances(fragments.filter(F.col("user_id") == user_id), query).orderBy(F.round("distance", 12), "message_id").limit(limit)


def semantic_search_all(fragments: DataFrame, queries: DataFrame, limit: int = 20, block: int = 256) -> DataFrame:
    """(query_id, message_id, distance, place): for every query (query_id, user_id, embedding) the `limit` nearest messages of its user by exact scan.

    Both sides are cut into blocks of about `block` by user; each pair of blocks of one user is a group whose distances are one matrix product, and
    only each query's best messages leave it. So a user with a third of all rows is many groups. Null users, and vectors that are unusable or of
    another dimension than the query's, take no part; ties go to the smaller message.
    """
    def blocked(df: DataFrame, id_: str, extra: list[str]) -> DataFrame:
        fine = df.filter(F.col("user_id").isNotNull() & usable("embedding")).select("user_id", F.col(id_).cast("bigint").alias("id"), *extra, F.col("embedding").cast("array<double>").alias("v"))
        sizes = fine.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"))
        return keyed_join(fine, sizes, ["user_id"]).withColumn("b", F.pmod(F.xxhash64("id"), "n").cast("int"))

    right = blocked(fragments.filter("message_id is not null"), "fragment_id", [F.col("message_id").cast("bigint").alias("m")])
    left = blocked(queries, "query_id", [])
    mine, theirs = left.select("user_id", F.col("n").alias("nq")).distinct(), right.select("user_id", F.col("n").alias("nr")).distinct()
    left = keyed_join(left, theirs, ["user_id"]).select("user_id", F.col("b").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("rb"), "id", "v")
    right = keyed_join(right, mine, ["user_id"]).select("user_id", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), F.col("b").alias("rb"), "m", "v")
    names = ["query_id", "message_id", "distance"]

    def near(q: pa.Table, r: pa.Table) -> pa.Table:
        out = [[], [], []]
        ids, messages = q["id"].to_numpy(), r["m"].to_numpy()
        dims = lambda t: np.asarray(t["v"].combine_chunks().value_lengths())
        of_q, of_r = dims(q) if len(ids) else np.zeros(0), dims(r) if len(messages) else np.zeros(0)
        for dim in np.intersect1d(of_q, of_r):
            a, b = (_unit(t["v"].combine_chunks().take(pa.array(np.flatnonzero(d == dim))), int(dim)) for t, d in ((q, of_q), (r, of_r)))
            who, what = ids[of_q == dim], messages[of_r == dim]
            order = np.argsort(what, kind="stable")
            kinds, starts = np.unique(what[order], return_index=True)
            distance = np.minimum.reduceat((1 - a @ b.T)[:, order], starts, axis=1)
            best = np.lexsort((np.broadcast_to(kinds, distance.shape), np.round(distance, 9)), axis=1)[:, :limit]
            out[0].append(np.repeat(who, best.shape[1]))
            out[1].append(kinds[best].ravel())
            out[2].append(np.take_along_axis(distance, best, 1).ravel())
        empty = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([np.concatenate(x) if x else e for x, e in zip(out, empty)], names)

    cell = ["user_id", "qb", "rb"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(near, "query_id bigint, message_id bigint, distance double")
    best = found.groupBy("query_id", "message_id").agg(F.min("distance").alias("distance"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), "message_id"))
    return best.withColumn("place", place).filter(F.col("place") <= limit)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def contents(messages: DataFrame, ids: list[int]) -> dict[int, list[dict]]:
    """The content (array of units) of at most some hundred messages, by id."""
    rows = messages.filter(F.col("message_id").isin(ids)).select("message_id", "content").collect()
    return {r.message_id: None if r.content is None else [u.asDict() for u in r.content] for r in rows}


def with_content(ranked: DataFrame, messages: DataFrame, key: str = "message_id") -> DataFrame:
    """Ranked messages with their content; a message that is not in the table keeps a null. The ranked side is a result of a search, at most some hundred rows a search."""
    return ranked.join(messages.select(key, "content"), key, "left")


def messages_of_user(messages: DataFrame, fragments: DataFrame, user_id: int) -> DataFrame:
    """Messages of which the user holds a fragment (a semi-join)."""
    return messages.join(fragments.filter(F.col("user_id") == user_id).select("message_id"), "message_id", "left_semi")


def reciprocal_rank(ranked: DataFrame, relevant: DataFrame, query: str, item: str, k: int = 3) -> DataFrame:
    """One row (mrr, n_queries): the mean over all queries of 1 / rank of the first relevant item, 0 beyond rank `k` or without one.

    `ranked` has (query, item, rank); `relevant` has (query, item) and names every query.
    """
    first = ranked.join(relevant, [query, item], "left_semi").groupBy(query).agg(F.min("rank").alias("rank"))
    value = F.when(F.col("rank") <= k, 1 / F.col("rank")).otherwise(0.0)
    return relevant.select(query).distinct().join(first, query, "left").agg(F.avg(value).alias("mrr"), F.count(F.lit(1)).alias("n_queries"))
