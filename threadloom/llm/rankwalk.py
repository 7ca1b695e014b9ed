"""One ranking from several differently-scaled scores (problem 4).

A Markov chain walks over the items of a list group: from an item it picks one of the scores with equal chance and jumps uniformly
to an item that ranks at least as high by it (ties and itself included; from an item without that score to any item that has it).
Where nothing ranks higher it restarts anywhere, so that leading one list alone does not hold the walk. With damping it restarts too.
The order is by stationary probability. Only ranks enter, so no scale dominates.

A step costs three sorted prefix sums. Groups are packed into Arrow batches and walked together in NumPy; a group of more
than `local_items` items is walked as DataFrames, its ranks and prefix sums made from ranges, so no task holds it whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.skew import hot_keys, keyed_join
from threadloom.session import cut

#: At 0.5 a step counts twice as much as the next; with weights near 1 leaders of a single list feed each other.
DAMPING = 0.5
STEPS = 30
LOCAL_ITEMS = 100_000
WEIGHTS = "search_id string, fragment_id bigint, weight double"


def earned(c: Column | str) -> Column:
    """A score as a double, null where it is null or NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c.cast("double"))


def walk(group: np.ndarray, scores: list[np.ndarray], damping: float = DAMPING, steps: int = STEPS) -> np.ndarray:
    """Stationary weights of all items of many groups at once; `group` ascends, NaN is a missing score."""
    n = len(group)
    if n == 0:
        return np.zeros(0)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    plans = []
    for s in scores:
        missing = np.isnan(s)
        order = np.lexsort((np.where(missing, 0, -s), missing, group))
        v, gone = s[order], missing[order]
        head = np.r_[True, (v[1:] != v[:-1]) | gone[1:] | (first[1:] != first[:-1])]
        tie = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # where the run of equal scores begins
        end = np.r_[np.flatnonzero(head)[1:], n][np.cumsum(head) - 1]
        there = np.repeat(np.add.reduceat((~missing).astype(np.int64), starts), sizes)
        reach = np.where(gone, there, np.where(tie == first, 0, end - first))
        plans.append((order, gone, tie, reach, first + size - 1))
    x = 1.0 / size
    for _ in range(steps):
        new, lost = np.zeros(n), np.zeros(n)
        for order, gone, tie, reach, last in plans:
            y = x[order]
            flow = np.where(reach > 0, y / np.maximum(reach, 1), 0)
            lost[order] += np.where(reach > 0, 0, y)
            sums = np.r_[0.0, np.cumsum(flow)]
            got = sums[last + 1] - sums[tie]
            got[gone] = 0
            new[order] += got
        restart = np.repeat(np.add.reduceat(lost, starts), sizes) / size
        x = (1 - damping) / size + damping * (new + restart) / len(plans)
    return x


def _walked(damping: float, steps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            at = np.repeat(np.arange(batch.num_rows), sizes)
            flat = lists.values.slice(lists.offsets[0].as_py(), int(sizes.sum()))
            scores = [flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in ("s0", "s1", "s2")]
            weights = pa.array(walk(at, scores, damping, steps))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), flat.field("fragment_id"), weights], ["search_id", "fragment_id", "weight"])

    return run


def _prefix(values: DataFrame, keys: list[str], order: str, amount: str, out: str) -> DataFrame:
    """Running sum of `amount` in the order of (keys, order), within keys and without the row itself; `__part` says the row's range."""
    inner = Window.partitionBy(*keys, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = values.groupBy(*keys, "__part").agg(F.sum(amount).alias("t"))
    ahead = F.coalesce(F.sum("t").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = sums.select(*keys, "__part", ahead.alias("ahead"))
    return values.join(ahead, [*keys, "__part"]).withColumn(out, F.coalesce(F.sum(amount).over(inner), F.lit(0)) + F.col("ahead")).drop("ahead")


def _huge(items: DataFrame, damping: float, steps: int) -> DataFrame:
    """The same walk for groups too large for a task."""
    spark = items.sparkSession
    items = cut(items)
    sizes = cut(items.groupBy("search_id").agg(F.count(F.lit(1)).alias("size")))
    long = items.select("search_id", "fragment_id", F.posexplode(F.array("s0", "s1", "s2")).alias("s", "v"))
    value = long.filter("v is not null").groupBy("search_id", "s", (-F.col("v")).alias("down")).agg(F.count(F.lit(1)).alias("cnt"))
    ranged = cut(value.repartitionByRange(max(2, spark.sparkContext.defaultParallelism), "search_id", "s", "down").withColumn("__part", F.spark_partition_id()))
    ranked = cut(_prefix(ranged, ["search_id", "s"], "down", "cnt", "above"))
    there = cut(ranked.groupBy("search_id", "s").agg(F.sum("cnt").alias("there")))
    # a search, and one value that most items share, are hot keys
    value_key, hot_sizes = ["search_id", "s", "down"], hot_keys(sizes, ["search_id"], "size")
    hot_values = hot_keys(ranked, value_key, "cnt")
    of = keyed_join(long.withColumn("down", -F.col("v")), ranked.select(*value_key, "above", "cnt"), value_key, "left", hot=hot_values)
    of = keyed_join(of, there, ["search_id", "s"], "left", hot=hot_keys(there, ["search_id", "s"], "there"))
    reach = F.when(F.col("down").isNull(), F.coalesce("there", F.lit(0))).when(F.col("above") == 0, 0).otherwise(F.col("above") + F.col("cnt"))
    place = cut(of.select("search_id", "fragment_id", "s", "down", reach.alias("reach")))
    x = keyed_join(items, sizes, ["search_id"], hot=hot_sizes).select("search_id", "fragment_id", (1.0 / F.col("size")).alias("x"))
    for _ in range(steps):
        at = cut(place.join(x, ["search_id", "fragment_id"]).withColumn("flow", F.when(F.col("reach") > 0, F.col("x") / F.col("reach")).otherwise(0.0)))
        flows = at.filter("down is not null").groupBy("search_id", "s", "down").agg(F.sum("flow").alias("flow"))
        absent = at.filter("down is null").groupBy("search_id", "s").agg(F.sum("flow").alias("absent"))
        lost = at.filter("reach = 0").groupBy("search_id").agg(F.sum("x").alias("lost"))
        total = flows.groupBy("search_id", "s").agg(F.sum("flow").alias("total"))
        run = _prefix(ranked.select("search_id", "s", "down", "__part").join(flows, ["search_id", "s", "down"]), ["search_id", "s"], "down", "flow", "better")
        mass = run.join(total, ["search_id", "s"]).join(absent, ["search_id", "s"], "left")
        mass = mass.select("search_id", "s", "down", (F.col("total") - F.col("better") + F.coalesce("absent", F.lit(0.0))).alias("mass"))
        got = keyed_join(at, mass, value_key, "left", hot=hot_values).groupBy("search_id", "fragment_id").agg(F.sum(F.coalesce("mass", F.lit(0.0))).alias("got"))
        new = keyed_join(keyed_join(got, sizes, ["search_id"], hot=hot_sizes), lost, ["search_id"], "left", hot=hot_sizes)
        moved = (F.col("got") + F.coalesce("lost", F.lit(0.0)) / F.col("size")) / 3
        x = cut(new.select("search_id", "fragment_id", ((1 - damping) / F.col("size") + damping * moved).alias("x")))
    return x.select("search_id", "fragment_id", F.col("x").alias("weight"))


def combine(lexical: DataFrame, graph: DataFrame, damping: float = DAMPING, steps: int = STEPS, local_items: int = LOCAL_ITEMS) -> DataFrame:
    """(search_id, fragment_id, weight): the stationary weight of each fragment of each search over the three scores.

    Of a fragment that is repeated in a list the highest value counts; null, NaN and absence earn nothing; infinities rank as they
    compare. Rows without search or fragment take no part. A search whose scores are all missing or equal gives equal weights. An empty
    table gives no rows; a fragment in only one of the lists is an item like any other.
    """
    hits = lexical.select("search_id", "fragment_id", earned("score").alias("s0"), F.lit(None).cast("double").alias("s1"), F.lit(None).cast("double").alias("s2")).unionByName(
        graph.select("search_id", "fragment_id", F.lit(None).cast("double").alias("s0"), earned("score").alias("s1"), earned("npmi").alias("s2"))
    )
    hits = hits.filter("search_id is not null and fragment_id is not null")
    items = hits.groupBy("search_id", "fragment_id").agg(*[F.max(c).alias(c) for c in ("s0", "s1", "s2")])
    huge = hits.groupBy("search_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > local_items)
    entry = F.struct("fragment_id", "s0", "s1", "s2")
    local = lambda df: df.groupBy("search_id").agg(F.collect_list(entry).alias("items")).mapInArrow(_walked(damping, steps), WEIGHTS)
    if huge.isEmpty():
        return local(items)
    huge, items = cut(huge), cut(items)
    hot = hot_keys(huge, ["search_id"], rows=local_items)
    split = lambda how: keyed_join(items, huge.select("search_id"), ["search_id"], how, hot=hot)
    return local(split("left_anti")).unionByName(_huge(split("left_semi"), damping, steps))


def head(weights: DataFrame, k: int = 3) -> DataFrame:
    """(search_id, fragment_id, weight, place) of the first `k` of each search; ties go to the smaller fragment_id.

    Weights are rounded to 12 places before they are compared, so that equal items tie. A per-key limit runs before the shuffle.
    """
    w = Window.partitionBy("search_id").orderBy(F.round("weight", 12).desc(), "fragment_id")
    return weights.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
