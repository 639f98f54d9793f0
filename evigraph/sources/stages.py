"""Stage tables and lineage cuts: what a run leaves behind, and how a later step picks it up."""

from __future__ import annotations

import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Only a session in one process may do without the setting and gets a folder of its own; on a cluster no executor would
    see that, so there the setting is asked for."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="evigraph-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared checkpoint folder, so that lost executors don't replay what is above."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder from whatever file system it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; rows of a scan with fewer filled partitions than there are cores are dealt out anew.

    A small table may be a single file of one row group, which only one task can read."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    filled = found.select(F.spark_partition_id().alias("p")).distinct().limit(cores).count()
    return found if filled >= cores else found.repartition(cores)


def write_stage(frame: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a stage and read it again, which also cuts its lineage."""
    frame.write.mode("overwrite").parquet(f"{folder}/{name}")
    return frame.sparkSession.read.parquet(f"{folder}/{name}")


def read_stages(spark: SparkSession, folder: str, names: tuple[str, ...]) -> dict[str, DataFrame] | None:
    """All the stages, or None if any is missing or unfinished."""
    found = {}
    for name in names:
        try:
            spark.read.text(f"{folder}/{name}/_SUCCESS").schema  # noqa: B018
            found[name] = spark.read.parquet(f"{folder}/{name}")
        except AnalysisException:
            return None
    return found
