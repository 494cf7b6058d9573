"""Cut lineage by writing an intermediate table to the cluster's shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="loadloom-"))
        atexit.register(shutil.rmtree, _LOCAL_DIR[0], ignore_errors=True)
    return _LOCAL_DIR[0]


def stage(df: DataFrame) -> DataFrame:
    """Write the table once and read it back.

    Later passes start from files instead of recomputing the lineage, survive
    lost executors, and give the planner real sizes for its broadcast decisions.
    Meant for user-grain tables that several passes share, as every phase
    of the batch pipeline hands its result to the next one.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """Broadcast hint for a table whose files are known to be small, else the table as it is.

    Meant for tables read straight from files, where the plan's size is the size
    of the files. Without the hint the join is a shuffle join that AQE may still
    switch or split at run time.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= limit else df
