"""Session, table and scratch-space helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, tuple[SparkSession, str]] = {}


_SHIPPED: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Sends this package to the Python workers, once per application: executors need no installation and no common path."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.applicationId in _SHIPPED:
        return
    _SHIPPED.add(spark.sparkContext.applicationId)
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="nebulith-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "nebulith_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for at, _, files in os.walk(home):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(at, f), os.path.relpath(os.path.join(at, f), os.path.dirname(home)))
    spark.sparkContext.addPyFile(target)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table (a file or a folder of part files) of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scratch_root(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``, else below the checkpoint folder that was set through the API.

    A temporary folder of this machine is used, and set, only where neither is given and the master is local: on a cluster
    every task would write to a folder of its own machine, so that is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not shared:
            master = spark.sparkContext.master
            if not re.fullmatch(r"local(\[.*\])?", master):
                raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines share; the master is {master}")
            shared = "file://" + tempfile.mkdtemp(prefix="nebulith-scratch-")
            spark.sparkContext.setCheckpointDir(shared)
            atexit.register(shutil.rmtree, shared[len("file://"):], ignore_errors=True)
        root = f"{shared.rstrip('/')}/nebulith-{app}-{os.getpid()}"
        _ROOTS[app] = (spark, root)
        atexit.register(_delete, spark, root)
    return _ROOTS[app][1]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM has gone; the cluster's own clean-up removes the folder
        pass


class Scratch:
    """Tables written to the shared folder to cut lineage, dropped when superseded.

    A written table survives the loss of any executor; it is also compressed and keeps
    statistics for the planner, which a checkpointed RDD does not.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.base = f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex[:8]}"
        self._n = self._dropped = 0

    def write(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return a frame that reads the written table."""
        self._n += 1
        path = f"{self.base}/{self._n:04d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._nebulith_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            path = getattr(df, "_nebulith_path", None)
            if path:
                _delete(self.spark, path)

    def drop_but(self, *frames: DataFrame) -> None:
        """Drops all tables written here but those of ``frames``."""
        keep = {getattr(df, "_nebulith_path", None) for df in frames}
        for n in range(self._dropped + 1, self._n + 1):
            path = f"{self.base}/{n:04d}"
            if path not in keep:
                _delete(self.spark, path)
        kept = [int(p.rsplit("/", 1)[1]) for p in keep if p]
        self._dropped = min(kept, default=self._n + 1) - 1

    def drop_all(self) -> None:
        _delete(self.spark, self.base)


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
