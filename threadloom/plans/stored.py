"""The search tables of a folder of test tables: built once, where they are missing, in the shared folder, and read by every search after that."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession

from threadloom.operators import serving
from threadloom.session import shared_folder, table
from threadloom.sources.store import Store

TABLES = ("semantic_fragments", "semantic_node", "semantic_fragment_node")
_open: dict[str, serving.Serving] = {}


def _state(spark: SparkSession, path: str) -> str:
    """A path with the size and the time of its files, so that other data at the same place is not taken for it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return ";".join(f"{f.getPath().getName()},{f.getLen()},{f.getModificationTime()}" for f in files.listStatus(folder))


def serving_of(spark: SparkSession, d: str) -> serving.Serving:
    """The searches over the tables of a folder."""
    state = "|".join([d, *(_state(spark, f"{d}/{n}.parquet") for n in TABLES)])
    root = f"{shared_folder(spark)}/search-{hashlib.sha256(state.encode()).hexdigest()[:24]}"
    key = f"{spark.sparkContext.applicationId} {root}"
    if key not in _open:
        store = Store(spark, root)
        if not store.holds(serving.TABLES[-1]):
            serving.build(store, *(table(spark, d, n) for n in TABLES))
        _open[key] = serving.Serving(store)
    return _open[key]
