"""Vectors as array columns: cosine and means, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; 0 where a norm is 0 or the value is not finite; null where lengths differ or a vector is null."""
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    safe = F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)
    return F.when(F.size(_c(a)) == F.size(_c(b)), safe)


def usable(a: Column | str, dim: int | None = None) -> Column:
    """Whether a vector is not null, finite in all elements, not all zero and, if asked, of `dim` elements."""
    a = _c(a)
    fine = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(a, lambda x: x != 0)
    return F.coalesce(fine & (F.size(a) == dim if dim else F.lit(True)), F.lit(False))


def mean_vectors(df: DataFrame, keys: list[str], vector: str, out: str = "centroid") -> DataFrame:
    """(keys, out, n): the element-wise mean per key and the number of vectors.

    Elements are summed by position before the shuffle, so a key that holds a third of all rows costs one partial row per task.
    Vectors of a key must have one dimension, else an error is raised; null vectors take no part.
    """
    elements = df.filter(F.col(vector).isNotNull()).select(*keys, F.size(vector).alias("__dim"), F.posexplode(vector).alias("__pos", "__x"))
    sums = elements.groupBy(*keys, "__pos").agg(F.avg(F.col("__x").cast("double")).alias("__m"), F.count(F.lit(1)).alias("__n"), F.min("__dim").alias("__lo"), F.max("__dim").alias("__hi"))
    rows = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__pos", "__m"))).alias("__v"), F.max("__n").alias("n"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    mean = F.transform("__v", lambda s: s.getField("__m"))
    return rows.select(*keys, F.when(F.col("__lo") == F.col("__hi"), mean).otherwise(F.raise_error(F.lit("vectors of different dimension")).cast("array<double>")).alias(out), "n")


def to_json(c: Column | str) -> Column:
    """An array of words or numbers as JSON text; null stays null."""
    return F.to_json(_c(c))


def words_from_json(c: Column | str) -> Column:
    """array<string> of a JSON array of words, as stored sets are written; anything else is an error, null stays null."""
    c = _c(c)
    read = F.from_json(c, "array<string>", {"mode": "PERMISSIVE"})
    return F.when(c.isNull(), None).otherwise(F.when(F.trim(c).startswith("[") & read.isNotNull(), read).otherwise(F.raise_error(F.lit("not a JSON array")).cast("array<string>")))


def from_json(c: Column | str) -> Column:
    """array<float> of a JSON array of numbers, as stored centroids are written; null where it is none."""
    return F.from_json(_c(c), "array<float>")
