"""Cutting lineage by written tables in the folder that the cluster shares."""
from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    sc = spark.sparkContext
    if at := sc.getCheckpointDir():
        return at.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = tempfile.mkdtemp(prefix="tessella-")
    atexit.register(shutil.rmtree, at, True)
    sc.setCheckpointDir(f"file://{at}")
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write and read again. Unlike a checkpoint this resets the plan's size estimates, which loops would square."""
    path = f"{shared_dir(df.sparkSession)}/tessella-{uuid.uuid4().hex[:12]}-{name}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessella_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table of ``cut`` that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._tessella_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, wherever the driver found it."""
    sc = spark.sparkContext
    if getattr(sc, "_tessella_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="tessella-zip-"))
    atexit.register(shutil.rmtree, at, True)
    with zipfile.ZipFile(at / f"{package.name}.zip", "w") as z:
        for f in package.rglob("*.py"):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(at / f"{package.name}.zip"))
    sc._tessella_shipped = True
