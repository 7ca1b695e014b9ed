"""Tables of an archive below one folder: appended in parts or replaced in versions, and read only as far as they were written whole."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from threadloom.session import remove


SCHEMA = "_schema.json"


class Store:
    """A folder of Parquet tables.

    An appended table is a folder of parts; a part has a name of the caller's choice, so that writing it again after a failure adds nothing.
    A replaced table is a folder of versions, of which the last whole one counts. The mark of a whole part is its schema, written last, so that a
    table without rows has one too.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _parts(self, name: str) -> list[str]:
        """The names of the whole parts or versions of a table, in order."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        there = [p.getPath().getName() for p in files.listStatus(folder) if p.isDirectory()]
        return sorted(p for p in there if files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{p}/{SCHEMA}")))

    def holds(self, name: str, part: str | None = None) -> bool:
        parts = self._parts(name)
        return bool(parts) if part is None else f"part-{part}" in parts

    def append(self, df: DataFrame, name: str, part: str) -> None:
        """Add a part; one that is whole already stays as it is."""
        if not self.holds(name, part):
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/part-{part}")
            self._seal(df, f"{self.root}/{name}/part-{part}")

    def replace(self, df: DataFrame, name: str, by: list[str] | None = None) -> None:
        """A new version of a table, in folders by the columns `by`. Readers of the one before keep it; older ones are removed."""
        writer = df.write.partitionBy(*by) if by else df.write
        path = f"{self.root}/{name}/version-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        writer.parquet(path)
        self._seal(df, path)
        for old in self._parts(name)[:-2]:
            remove(self.spark, f"{self.root}/{name}/{old}")

    def read(self, name: str) -> DataFrame | None:
        """The table as it is now; None where nothing was written yet."""
        parts = self._parts(name)
        if not parts:
            return None
        paths = [f"{self.root}/{name}/{p}" for p in (parts[-1:] if parts[-1].startswith("version-") else parts)]
        schema = StructType.fromJson(json.loads(self._file(f"{paths[-1]}/{SCHEMA}", None)))
        return self.spark.read.schema(schema).parquet(*paths)

    def _seal(self, df: DataFrame, path: str) -> None:
        self._file(f"{path}/{SCHEMA}", df.schema.json())

    def _file(self, path: str, text: str | None) -> str:
        """A small file's text, after writing it where one is given."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if text is not None:
            out = files.create(at)
            out.write(bytearray(text.encode()))
            out.close()
            return text
        stream = files.open(at)
        found = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return found
