"""Writers: partitioned columnar tables, incremental overwrite and audit CSV."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: Iterable[str] = (), codec: str = "zstd",
                  mode: str = "overwrite", dynamic: bool = False, level: int = 9,
                  block_bytes: int | None = None, files_per_partition: int | None = None) -> None:
    """Write Parquet. ``dynamic`` replaces only the partitions present in ``df``.

    With ``files_per_partition`` each partition value is spread over that many
    tasks (a salt), so one hot year is never written by a single task.
    """
    keys = list(partition_by)
    if keys and files_per_partition:
        salt = F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.lit(files_per_partition))
        df = df.withColumn("_salt", salt).repartition(*keys, "_salt").drop("_salt")
    w = df.write.mode(mode).option("compression", codec)
    if codec == "zstd":
        w = w.option("parquet.compression.codec.zstd.level", level)
    if block_bytes:
        w = w.option("parquet.block.size", block_bytes)
    if dynamic:
        w = w.option("partitionOverwriteMode", "dynamic")
    if keys:
        w = w.partitionBy(*keys)
    w.parquet(path)


def write_audit(df: DataFrame, path: str) -> None:
    """Small report table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
