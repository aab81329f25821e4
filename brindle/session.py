"""Session settings and cuts of the lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, memory: str = "8g", **more: str) -> SparkSession:
    """A local session for tests and measurements."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(cpus))
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="brindle-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def keep(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write the rows as a table in the shared folder and read that: a cut of the lineage which outlives lost executors.

    ``by`` names a boolean column into whose values the table is split, so that a filter on it reads no other rows.
    The table is marked for deletion at the end of the JVM; ``drop`` deletes it earlier.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/brindle/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    _files(spark, path, lambda files, target: files.deleteOnExit(target))
    kept = spark.read.schema(df.schema).parquet(path)
    kept._brindle_path = path
    return kept


def counted(df: DataFrame, label: str, by: str | None = None, **counts: Column) -> tuple[DataFrame, Row]:
    """``keep``, and aggregates of the rows that are taken while they are written."""
    seen = Observation()
    kept = keep(df.observe(seen, *[c.alias(name) for name, c in counts.items()]), label, by)
    return kept, Row(**seen.get)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``keep`` wrote and nothing will read again."""
    for df in tables:
        _files(df.sparkSession, df._brindle_path, lambda files, target: files.delete(target, True))


def _files(spark: SparkSession, path: str, act: Callable) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    act(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once, so that they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_brindle_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="brindle-")) / "brindle.zip"  # the driver's own copy; Spark distributes it
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(path.relative_to(root.parent)))
    sc.addPyFile(str(archive))
    sc._brindle_shipped = True
