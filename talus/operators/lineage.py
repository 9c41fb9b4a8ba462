"""Cutting the lineage of frames that are read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset and all runs on one machine a temporary one takes its place; on a cluster that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return base or "file://" + tempfile.mkdtemp(prefix="talus-")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into the folder that the cluster names in spark.checkpoint.dir (a temporary one where it is unset)."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()


def staged(df: DataFrame) -> DataFrame:
    """df, computed once as compressed Parquet in the same folder: for frames that are large, and read as often as a plan likes."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_base(spark))
    out = f"{spark.sparkContext.getCheckpointDir()}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(out)
    return spark.read.schema(df.schema).parquet(out)


def dropped(*frames: DataFrame) -> None:
    """The files of staged() frames go: for frames that no frame that is still to be computed reads."""
    for df in frames:
        context = df.sparkSession.sparkContext
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
