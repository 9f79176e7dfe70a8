"""Cutting lineage so that the result outlives the executors that made it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point Spark at the cluster's shared checkpoint folder.

    The folder is the one `spark.checkpoint.dir` names. Only where that is
    unset, as in local tests, a folder of this machine is used.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quirelake-checkpoint-"))


def staged(df: DataFrame) -> DataFrame:
    """`df` computed once and kept as reliable checkpoint files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged_table(df: DataFrame) -> DataFrame:
    """`df` computed once and kept as a table of columns in the checkpoint folder: smaller than `staged` where rows hold long texts."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
