"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import held

#: At most so many keys are broadcast, and a key below so many rows fits any task.
HOT_KEYS = 2048
HOT_ROWS = 10_000


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n", most: int = HOT_KEYS, rows: int | None = None) -> DataFrame:
    """The `most` largest keys of `counts` (keys, n) with at least `rows` (HOT_ROWS) rows, as a local table. What is left out has less than 1 / `most` of all rows each."""
    wanted = counts.filter(F.col(n) >= (HOT_ROWS if rows is None else rows)).orderBy(F.col(n).desc(), *keys).limit(most)
    return held(wanted.select(*keys), most)


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """`left` joined with `right`, which has each key at most once; how is inner, left, left_semi or left_anti.

    Rows of a hot key (hot_keys) meet their one row of `right` by broadcast of at most HOT_KEYS rows, wherever they lie, so none of them moves;
    the rest shuffles. `left` is read once more to count its keys, unless `hot` names them. A null key matches nothing and never shuffles.
    """
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    whole = left.filter(present)
    if hot is None:
        hot = hot_keys(whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, rows=rows)
    if hot.isEmpty():
        out = whole.join(right, keys, how)
    else:
        b = F.broadcast(hot)
        out = whole.join(b, keys, "left_semi").join(F.broadcast(right.join(b, keys, "left_semi")), keys, how)
        out = out.unionByName(whole.join(b, keys, "left_anti").join(right, keys, how))
    if how in ("left", "left_anti"):
        out = out.unionByName(left.filter(~present), allowMissingColumns=True)
    return out
