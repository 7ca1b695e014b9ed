"""Scoring formulas as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def keyword_bm25(n: Column, df: Column, tf: Column, dl: Column, avgdl: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    """BM25 of keyword extraction, with the factor k1 + 1."""
    return idf(n, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def search_bm25(n: Column, df: Column, tf: Column, dl: Column, avgdl: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """BM25 of search, without the factor k1 + 1."""
    return idf(n, df) * tf / (tf + k1 * (1 - b + b * dl / avgdl))


def npmi(n: Column, a: Column, b: Column, ab: Column, strict: bool = True) -> Column:
    """Normalised pointwise mutual information within [-1, 1]; null where n <= 0, ab = 0 or ab = n.

    With `strict`, counts that cannot be true together (a or b outside 1..n, ab above a or b or below a + b - n) raise an error, else they
    give null.
    """
    n, a, b, ab = (x.cast("double") for x in (n, a, b, ab))
    wrong = (a <= 0) | (a > n) | (b <= 0) | (b > n) | (ab < 0) | (ab > F.least(a, b)) | (ab < F.greatest(F.lit(0.0), a + b - n))
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.log(ab * n / (a * b)) / -F.log(ab / n)))
    bad = F.raise_error(F.lit("inconsistent pair counts")).cast("double") if strict else F.lit(None).cast("double")
    return F.when(n <= 0, None).when(wrong, bad).when((ab > 0) & (ab < n), value)


def sampling_weight(score: Column, lo: Column, hi: Column, temperature: float = 0.4) -> Column:
    """exp((s - 1) / T) of the score scaled to [0, 1]; 1 where all scores are equal."""
    if not 0 < temperature < float("inf"):
        raise ValueError("temperature must be positive and finite")
    scaled = F.when(hi > lo, (score - lo) / (hi - lo)).otherwise(1.0)
    return F.exp((scaled - 1) / temperature)


def uniform(seed: Column | str, *parts: Column | str) -> Column:
    """A reproducible number in (0, 1) from a hash of seed and parts, the same on every engine."""
    text = F.concat_ws(":", *[(F.lit(x) if isinstance(x, str) else x.cast("string")) for x in (seed, *parts)])
    return (F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def chance_order(weight: Column, u: Column) -> Column:
    """-ln(u) / w: the smallest k are a weighted sample without replacement."""
    return -F.log(u) / weight
