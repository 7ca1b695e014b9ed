"""Session helpers: table access, and cutting lineage through tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give every executor, also one that joins later, this package, so that Python steps run wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="threadloom-code-")) / "threadloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in home.rglob("*.py"):
            z.write(f, f.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(archive))


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table `name` below `root` (a file or a folder of files)."""
    ship(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def local_session(app: str = "threadloom", cores: str = "8", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("THREADLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        # call sites for error messages cost a round trip to the JVM for every expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: spark.checkpoint.dir, or, in a local session only, a folder of our own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Tables written by `cut` in this process and not yet removed.
_cuts: list[str] = []


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def clear(spark: SparkSession | None = None) -> None:
    """Remove every table that `cut` wrote in this process; frames that read them are of no use afterwards. Runs by itself when the process ends."""
    spark = spark or SparkSession.getActiveSession()
    while spark is not None and _cuts:
        try:
            remove(spark, _cuts.pop())
        except Exception:  # noqa: BLE001  the session is gone, and with it the way to the files
            return


atexit.register(clear)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it again.

    The result has no lineage beyond the files, so a lost executor costs nothing but a re-read, and the stages behind
    it run once however often the result is used. `clear` removes the tables.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _cuts.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame, most: int) -> DataFrame:
    """`df`, which has at most `most` rows by construction, through the driver: a local table without lineage, for small steps of a search. More rows are an error."""
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"more than {most} rows where fewer were promised")
    return df.sparkSession.createDataFrame(rows, df.schema) if rows.num_rows else df.sparkSession.createDataFrame([], df.schema)
