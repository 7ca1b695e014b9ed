"""How distinctive a term is for its record (problem 3).

Smoothed language-model divergence: with p(t|d) = (tf + mu p(t|C)) / (|d| + mu), the score of a term is its contribution
p(t|d) ln(p(t|d) / p(t|C)) to the relative entropy between the record's Dirichlet-smoothed distribution and the collection's.
Terms below a minimum document frequency get no score.

Corpus statistics come from all records. The join of records' terms with term statistics would be skewed by the terms that are
everywhere; those with at least 1/2048 of all occurrences (there can be no more than 2048 of them) are broadcast, the rest shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import counted
from threadloom.session import cut

#: What a term is (fixed value: the definition of the data).
TERM = r"[\p{L}\p{N}_]+"
HEAVY = 2048
MU = 2000.0


def term_counts(records: DataFrame, record: str, text: str) -> DataFrame:
    """(record, term, tf, dl) of every term of every record; null and empty texts have none. No shuffle: see `text.counted`."""
    lists = records.select(F.col(record).alias("record"), F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)).alias("terms")).filter(F.size("terms") > 0)
    return lists.select("record", F.size("terms").alias("dl"), F.explode(counted("terms")).alias("c")).select("record", "c.term", "dl", "c.tf")


def distinctiveness(records: DataFrame, record: str, text: str, mu: float = MU, min_df: int = 2, only: DataFrame | None = None) -> DataFrame:
    """(record, term, tf, df, score) of every term with a document frequency of at least `min_df`.

    `mu` is the weight of the collection, 2000 as published for Dirichlet smoothing; a small one favours a word that is frequent in its record
    though common everywhere. `only` (a table with the column `record`)
    restricts whose terms are given, not the statistics. Each row is a record of its own, also one of a repeated text. A record whose terms are all rarer than
    `min_df` has no rows. An empty table gives no rows.
    """
    counts = cut(term_counts(records, record, text))
    stats = cut(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")))
    total = stats.agg(F.sum("cf").alias("total")).first().total or 0
    weight = float(mu)
    wanted = counts if only is None else counts.join(only.select("record").distinct(), "record", "left_semi")
    heavy = stats.filter(F.col("cf") * HEAVY >= total)
    light = stats.filter((F.col("cf") * HEAVY < total) & (F.col("df") >= min_df))
    of_heavy = wanted.join(F.broadcast(heavy), "term").filter(F.col("df") >= min_df)
    of_light = wanted.join(F.broadcast(heavy.select("term")), "term", "left_anti").join(light, "term")
    joined = of_heavy.unionByName(of_light)
    background = F.col("cf") / F.lit(float(max(1, total)))
    smoothed = (F.col("tf") + F.lit(weight) * background) / (F.col("dl") + F.lit(weight))
    return joined.select("record", "term", "tf", "df", (smoothed * F.log(smoothed / background)).alias("score"))


def leaders(scores: DataFrame) -> DataFrame:
    """(record, term, score) of the highest score of each record; ties go to the first term in order."""
    best = F.min_by(F.struct("term", "score"), F.struct(-F.col("score"), F.col("term")))
    return scores.groupBy("record").agg(best.alias("b")).select("record", "b.term", "b.score")
