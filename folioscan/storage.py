"""Cutting lineage with written tables in the folder that all executors share.

The folder is the one that the cluster names in ``spark.checkpoint.dir``.  Only a
session that runs in one process (``local[...]``: unit tests, a laptop) may leave it
unset; a private folder is made there.  On a cluster a folder of one machine would lose
what it holds with that machine, so an unset one is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI; set on the context where nothing had set it and one process runs all."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioscan-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    The copy survives the loss of any executor, has sizes the optimizer can see,
    and ends the lineage, so that iterative operators keep short plans.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioscan-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow hand whole texts to Python at most ``rows`` at a time.

    Spark's default of 10,000 rows suits narrow rows; with long texts the copies of a
    batch on both sides of the pipe are what an executor's memory has to hold.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its files give fewer splits than there are cores.

    One file of one row group is one task, however many cores wait; tables of many splits
    are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 1 <= df.rdd.getNumPartitions() < cores else df


def cleanup(spark: SparkSession) -> None:
    """Delete the tables this application has materialized."""
    jvm, hadoop = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hadoop).delete(p, True)


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            cleanup(spark)
        except Exception:  # the JVM may be gone already; nothing is lost but space
            pass
