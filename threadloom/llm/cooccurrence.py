"""Items that appear together, and how much more often than chance (problem 2).

A basket is a fragment, an item a node. Ordinary baskets are one sorted array each and give their pairs in place. A basket of
more than `chunk` items is split into item chunks; each pair of chunks becomes a row of its own, so that its product is made by
many tasks. Both kinds of pair rows are counted together with map-side combine.

Pairs that cannot reach the wanted count or NPMI whatever their common count are never made: a node needs `min_common`
fragments, and with counts a <= b the NPMI is at most ln(N/b)/ln(N/a), reached where every fragment of a holds b. Both bounds are
exact, so no result is lost; they remove the products of nodes that are in most fragments of a user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.skew import hot_keys, keyed_join
from threadloom.session import cut

CHUNK = 64


def npmi(n: Column, a: Column, b: Column, ab: Column) -> Column:
    """Normalised pointwise mutual information of counts, within [-1, 1]; null where ab = 0 or ab = n."""
    value = F.log(ab * n / (a * b)) / -F.log(ab / n)
    return F.when((ab > 0) & (ab < n), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def _reachable(x: Column, y: Column, least: float) -> Column:
    """Whether two items could have an NPMI of `least` if they met as often as they can."""
    lo, hi = F.least(x.getField("c"), y.getField("c")), F.greatest(x.getField("c"), y.getField("c"))
    n = x.getField("n").cast("double")
    return F.log(n / hi) >= least * F.log(n / lo) - 1e-9


def _pairs(left: Column, right: Column, least: float) -> Column:
    """array<struct<x, y>> of all pairs with x.id < y.id, of the same user, that can reach the wanted NPMI."""

    def of(x: Column) -> Column:
        mates = F.filter(right, lambda y: (y.getField("id") > x.getField("id")) & (y.getField("u") == x.getField("u")) & _reachable(x, y, least))
        return F.transform(mates, lambda y: F.struct(x.alias("x"), y.alias("y")))

    return F.flatten(F.transform(left, of))


def cooccurrence(baskets: DataFrame, min_common: int = 4, min_npmi: float = 0.51, chunk: int = CHUNK) -> DataFrame:
    """(user_id, node_lo, node_hi, n_common, n_lo, n_hi, n_total, npmi) of the associated pairs.

    `baskets` has (basket, item, user_id, n_total), each basket and item once, without nulls. A pair in all n_total baskets has
    no NPMI and is left out, as is an item in more than n_total baskets with all its pairs: its NPMI cannot be positive. Ties and order
    of rows have no effect; an empty table gives no rows. `baskets` is read twice, so it should be a stored table.

    An item or a basket may hold a third of the rows: both joins are `keyed_join`s.
    """
    counts = cut(baskets.groupBy("item").agg(F.count(F.lit(1)).alias("c"), F.max("user_id").alias("u"), F.max("n_total").alias("n")).filter(F.col("c") >= min_common))
    rows = keyed_join(baskets.select("basket", "item"), counts, ["item"], hot=hot_keys(counts, ["item"], "c"))
    rows = cut(rows.select("basket", F.struct(F.col("item").alias("id"), F.col("u"), F.col("c"), F.col("n")).alias("e")))
    sizes = cut(rows.groupBy("basket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    sized = cut(keyed_join(rows, sizes, ["basket"], hot=hot_keys(sizes, ["basket"], "size")))
    small = sized.filter(F.col("size") <= chunk).groupBy("basket").agg(F.array_sort(F.collect_list("e")).alias("left")).select("left", F.col("left").alias("right"))
    # Large baskets: chunk k meets chunk j in the product row (min, max); each holds about `chunk` items whatever the basket's size.
    chunks = F.ceil(F.col("size") / chunk).cast("int")
    placed = sized.filter(F.col("size") > chunk).withColumn("m", chunks).withColumn("k", F.pmod(F.xxhash64("e.id"), F.col("m")).cast("int"))
    blocks = placed.groupBy("basket", "m", "k").agg(F.collect_list("e").alias("items"))
    sent = blocks.select("basket", "k", "items", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"))
    met = sent.groupBy("basket", F.least("k", "j").alias("lo"), F.greatest("k", "j").alias("hi")).agg(
        F.max(F.when(F.col("k") == F.least("k", "j"), F.col("items"))).alias("a"), F.max(F.when(F.col("k") == F.greatest("k", "j"), F.col("items"))).alias("b")
    )
    # A product of two chunks needs both directions; a chunk with itself needs one. An empty chunk leaves a null side.
    sides = F.when(F.col("lo") == F.col("hi"), F.array(F.struct(F.col("a").alias("left"), F.col("a").alias("right")))).otherwise(
        F.array(F.struct(F.col("a").alias("left"), F.col("b").alias("right")), F.struct(F.col("b").alias("left"), F.col("a").alias("right")))
    )
    large = met.filter("a is not null and b is not null").select(F.explode(sides).alias("s")).select("s.left", "s.right")
    pairs = small.unionByName(large).select(F.explode(_pairs(F.col("left"), F.col("right"), min_npmi)).alias("p"))
    flat = pairs.select(F.col("p.x.id").alias("node_lo"), F.col("p.y.id").alias("node_hi"), F.col("p.x.u").alias("user_id"), F.col("p.x.c").alias("n_lo"), F.col("p.y.c").alias("n_hi"), F.col("p.x.n").alias("n_total"))
    counted = flat.groupBy("user_id", "node_lo", "node_hi", "n_lo", "n_hi", "n_total").agg(F.count(F.lit(1)).alias("n_common")).filter(F.col("n_common") >= min_common)
    d = lambda c: F.col(c).cast("double")
    return counted.withColumn("npmi", npmi(d("n_total"), d("n_lo"), d("n_hi"), d("n_common"))).filter(F.col("npmi") >= min_npmi)


def node_baskets(mapping: DataFrame, fragments: DataFrame, nodes: DataFrame) -> DataFrame:
    """(basket, item, user_id, n_total) from mapping rows: each existing fragment and node once together, however often mapped.

    Rows with null or unknown ids do not count. user_id is the node's; n_total is the number of that user's fragments.
    """
    links = mapping.select("fragment_id", "node_id").filter("fragment_id is not null and node_id is not null").distinct()
    totals = fragments.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_total"))
    known = nodes.filter("node_id is not null").select("node_id", "user_id").join(totals, "user_id")
    existing = keyed_join(cut(keyed_join(cut(links), fragments.select("fragment_id").distinct(), ["fragment_id"], "left_semi")), known, ["node_id"])
    return cut(existing.select(F.col("fragment_id").alias("basket"), F.col("node_id").alias("item"), "user_id", "n_total"))
