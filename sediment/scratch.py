"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Where none is set, a local master gets a folder of its own, as in tests;
    on a cluster that is an error, since executors would write to their own
    disks and later reads would miss the rows.
    """
    set_ = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='sediment-')}")
        set_ = spark.sparkContext.getCheckpointDir()
    return set_.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder; all of a job's paths share the application's id."""
    return f"{scratch_dir(spark)}/sediment/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    This cuts lineage, so that a lost executor costs no more than its own
    files' share of work, and gives later joins plain exchanges on both sides,
    which adaptive execution can split when a key is hot, with a size that the
    optimiser knows. The folder ``sediment/<application id>`` may be deleted
    once the job's results are written; ``discard`` does so.
    """
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Deletes this application's scratch tables; results that were not written yet can't be made from them any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/sediment/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
