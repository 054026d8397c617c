"""Sessions: sending this package to the workers, and tables between jobs."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_HOME = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the session's Python workers, once for each application, so that a cluster need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_docloom_sent", None) is None:
        path = Path(tempfile.mkdtemp(prefix="docloom-")) / "docloom.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for file in sorted(_HOME.rglob("*.py")):
                z.write(file, f"{_HOME.name}/{file.relative_to(_HOME)}")
        sc.addPyFile(str(path))
        sc._docloom_sent = str(path)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); also set as the checkpoint folder.

    Where none is set, a temporary one serves a local session; on a cluster that is an error, for executors would write to
    their own disks.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if found is None:
        own = sc._jsc.sc().getCheckpointDir()
        if own.isEmpty():
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
            own = sc._jsc.sc().getCheckpointDir()
        found = own.get()
    return found.rstrip("/")


#: Rows of a task that ``spread`` makes.
EACH = 10_000


def spread(df: DataFrame, each: int = EACH) -> DataFrame:
    """``df``'s rows in tasks of about ``each``, so that tasks grow in number with the input and not in length.

    For narrow rows that are dear to work on: a small file, or one row group, is a single task however many rows it has.
    ``df`` is counted, which for a Parquet table reads footers only.
    """
    n = -(-df.count() // each)
    return df.repartition(n) if n > 1 else df


def staged(df: DataFrame, what: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Remove the tables that this application has staged; results that still read from them can't be computed after that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark.sparkContext._docloom_indexes = {}
