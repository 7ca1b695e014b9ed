"""Mixing sources to target weights (problem 9).

Weights come from source sizes raised to an exponent that is bisected. Where explicit shares are wanted they are the weights, and the
exponent decides only what the repetition limits leave open: weights are target^a * capacity^(1-a), where capacity is what a source can
give at most (tokens times repetitions); a = 1 is the target itself, a = 0 exhausts every source. a is the greatest exponent at which
the limits allow the wanted total. Without a total the mixture is the largest that has the targets, and a is 1. `tempered` makes the
weights themselves so: natural shares raised to the exponent at which the mixture has a wanted entropy; with a wanted total on top the
repetition limits bisect a second time.

A source's tokens are then realised as a budgeted permutation of blocks: documents fall into pseudo-random blocks of about sqrt(n)
documents, whole passes come first, and the last pass takes blocks in order until the budget ends inside one. Only sums of blocks
are ever ordered together, so a source may hold a third of all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.tokens import count_tokens
from threadloom.session import cut

MOST_SOURCES = 10_000


def source_key(c: Column | str) -> Column:
    """A source's name in lower case, trimmed, with hyphens and blanks as underscores; null where nothing remains."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")
    return F.when(F.length(bare) > 0, bare)


def entropy(shares: list[float]) -> float:
    return -sum(p * math.log(p) for p in shares if p > 0)


def temperature_shares(sizes: list[float], exponent: float) -> list[float]:
    top = max(sizes, default=0)
    raised = [(x / top) ** exponent if x > 0 else 0.0 for x in sizes]
    return [x / sum(raised) for x in raised] if top > 0 else [0.0 for _ in sizes]


def exponent_for_entropy(sizes: list[float], wanted: float) -> float:
    """The exponent in [0, 8] at which the shares have the wanted entropy (entropy falls as the exponent grows); the nearer end beyond."""
    lo, hi = 0.0, 8.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(temperature_shares(sizes, mid)) > wanted else (lo, mid)
    return (lo + hi) / 2


def budgets(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> tuple[dict[str, float], float]:
    """(tokens to take of each source, exponent a). Sources without tokens or target get nothing and the others share in proportion."""
    live = {s: (t, tokens[s] * r) for s, (t, r) in targets.items() if t and t > 0 and r and r > 0 and tokens.get(s, 0) > 0}
    if not live:
        return {}, 1.0

    def weights(a: float) -> dict[str, float]:
        raw = {s: t**a * c ** (1 - a) for s, (t, c) in live.items()}
        return {s: x / sum(raw.values()) for s, x in raw.items()}

    most = lambda w: min(live[s][1] / x for s, x in w.items())
    a = 1.0
    if total is not None and total > most(weights(1.0)):
        lo, hi = 0.0, 1.0
        for _ in range(80):
            a = (lo + hi) / 2
            lo, hi = (a, hi) if most(weights(a)) >= total else (lo, a)
        a = lo
    w = weights(a)
    size = min(most(w), total) if total is not None else most(w)
    return {s: x * size for s, x in w.items()}, a


def sized(documents: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents with a source and at least one token, as a table in the shared folder."""
    rows = documents.select("doc_id", source_key("source").alias("source"), "text").filter("source is not null and text is not null")
    counted = count_tokens(rows, ["doc_id", "source"], "text", **({"folder": folder} if folder else {}))
    return cut(counted.filter("n_tokens > 0"))


def targets_of(mix_target: DataFrame) -> dict[str, tuple[float, int]]:
    """The target table, a configuration of at most MOST_SOURCES rows; more are an error."""
    rows = mix_target.select(source_key("source").alias("s"), "target_share", "max_repeat").filter("s is not null").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError("too many sources in the target table")
    return {r.s: (float(r.target_share or 0), int(r.max_repeat or 0)) for r in rows}


def source_tokens(sizes: DataFrame, targets: dict) -> dict[str, int]:
    known = sizes.filter(F.col("source").isin(list(targets))).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    return {r.source: r.n for r in known}


def mix(sizes: DataFrame, targets: dict[str, tuple[float, int]], total: float | None = None, seed: int = 0, tokens: dict[str, int] | None = None) -> DataFrame:
    """(source, doc_id, copy_no, n_tokens, mix_position) of the mixture; copy_no counts from 1 up to the source's max_repeat.

    Each source gives its share of the total to within half of its last document. mix_position in [0, 1) orders the mixture so
    that every stretch of it has the sources in proportion. Documents of other or null sources and without tokens take no part; a source
    without documents gives nothing. The result depends on the seed and the document ids only, not on the order of rows.
    `tokens` (source_tokens) spares a count.
    """
    spark = sizes.sparkSession
    tokens = source_tokens(sizes, targets) if tokens is None else tokens
    wanted, _ = budgets(tokens, targets, total)
    rows = [(s, float(b), int(tokens[s]), int(targets[s][1])) for s, b in wanted.items()]
    plan = spark.createDataFrame(rows, "source string, budget double, tokens bigint, max_repeat int")
    counts = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    plan = F.broadcast(plan.join(counts, "source").withColumn("n_blocks", F.ceil(F.sqrt("n_docs")).cast("bigint")))  # at most MOST_SOURCES rows
    docs = sizes.join(plan, "source").withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(seed))).withColumn("block", F.pmod("h", F.col("n_blocks")))
    sums = docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("t"))
    ahead = sums.select("source", "block", F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inner = Window.partitionBy("source", "block").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(ahead, ["source", "block"]).withColumn("before", F.col("inner") + F.col("ahead"))
    passes = F.least(F.floor(F.col("budget") / F.col("tokens") + 1e-9), F.col("max_repeat")).cast("int")
    rest = F.col("budget") - passes * F.col("tokens")
    extra = ((F.col("before") + F.col("n_tokens") / 2 <= rest) & (passes < F.col("max_repeat"))).cast("int")
    taken = placed.withColumn("copies", passes + extra).filter("copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    position = ((F.col("copy_no") - 1) * F.col("tokens") + F.col("before")) / F.col("budget")
    return taken.select("source", "doc_id", "copy_no", "n_tokens", F.least(position, F.lit(1 - 1e-12)).alias("mix_position"))


def report(mixture: DataFrame, targets: dict[str, tuple[float, int]], tokens: dict[str, int]) -> DataFrame:
    """(source, target_share, actual_share, tokens_taken, tokens_there, documents, max_copies) of every target source; zeros for absent ones."""
    spark = mixture.sparkSession
    goal = spark.createDataFrame([(s, t, int(tokens.get(s, 0))) for s, (t, _) in targets.items()], "source string, target_share double, tokens_there bigint")
    got = mixture.groupBy("source").agg(F.sum("n_tokens").alias("tokens_taken"), F.count_if(F.col("copy_no") == 1).alias("documents"), F.max("copy_no").alias("max_copies"))
    out = goal.join(got, "source", "left").fillna(0, ["tokens_taken", "documents", "max_copies"])
    total = got.agg(F.sum("tokens_taken").alias("total"))
    share = F.coalesce(F.col("tokens_taken") / F.col("total"), F.lit(0.0))
    return out.crossJoin(F.broadcast(total)).select("source", "target_share", share.alias("actual_share"), "tokens_taken", "tokens_there", "documents", "max_copies")


def tempered(tokens: dict[str, int], targets: dict[str, tuple[float, int]]) -> tuple[dict[str, tuple[float, int]], float]:
    """(targets with tempered shares, exponent): the natural shares of the sources that have tokens, raised to the exponent that gives the targets' entropy."""
    live = sorted(s for s in targets if tokens.get(s, 0) > 0)
    sizes = [float(tokens[s]) for s in live]
    goal = [targets[s][0] for s in live]
    a = exponent_for_entropy(sizes, entropy([g / sum(goal) for g in goal])) if sum(goal) > 0 else 1.0
    return {s: (w, targets[s][1]) for s, w in zip(live, temperature_shares(sizes, a))}, a


def tempered_mix(sizes: DataFrame, targets: dict[str, tuple[float, int]], tokens: dict[str, int], seed: int = 0) -> DataFrame:
    """The rows of `mix` with tempered weights and as many tokens as the sources have together, so far as the repetition limits allow it."""
    plan, _ = tempered(tokens, targets)
    return mix(sizes, plan, float(sum(tokens[s] for s in plan)), seed, tokens)


def temperature_report(mixture: DataFrame, tokens: dict[str, int], targets: dict[str, tuple[float, int]]) -> DataFrame:
    """(source, natural_share, exponent, weight, limit_exponent and the columns of `report`) of the sources with tokens: what was wanted and what the mixture holds.

    exponent is that of the entropy, limit_exponent the one the repetition limits ask for (1 where they ask for nothing).
    """
    spark = mixture.sparkSession
    plan, a = tempered(tokens, targets)
    total = float(sum(tokens[s] for s in plan))
    wanted, limit = budgets(tokens, plan, total)
    rows = [(s, tokens[s] / total, a, wanted.get(s, 0.0) / (sum(wanted.values()) or 1.0), limit) for s in plan]
    goal = spark.createDataFrame(rows, "source string, natural_share double, exponent double, weight double, limit_exponent double")
    return goal.join(report(mixture, plan, tokens).withColumnRenamed("target_share", "tempered_share"), "source")
