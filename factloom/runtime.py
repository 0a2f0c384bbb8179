"""What operators need of the session: shipping code, cutting lineage, sizing."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors of a cluster once per application.

    Arrow functions are pickled by reference, so workers must be able to import
    the package even where the driver's path is not shared.
    """
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="factloom-code-")
    target = os.path.join(folder, "factloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("factloom") / p.relative_to(root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = os.path.join(tempfile.gettempdir(), f"factloom-{spark.sparkContext.applicationId}")
    spark.conf.set("spark.checkpoint.dir", "file://" + folder)
    import atexit

    atexit.register(shutil.rmtree, folder, True)
    return "file://" + folder


class Cut:
    """Writes intermediate tables into the shared folder and reads them back.

    The files replace the lineage: a lost executor costs a re-read, not a
    recomputation of everything before. ``drop`` removes tables that no later
    step reads; the others go when the application ends, as results are read
    from them until then.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def __call__(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        if self.n == 1:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(p)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._factloom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_factloom_path", None)
        if path:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    """The session's own number of shuffle partitions, which follows the cluster."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """For work heavy per row: rows that arrive in fewer partitions than there are cores are dealt out."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
