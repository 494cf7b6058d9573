"""Readers. Columns and filters reach the scan; nothing is inferred twice."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

READING_SCHEMA = T.StructType([
    T.StructField("index", T.TimestampNTZType()),
    T.StructField("fl", T.IntegerType()),
    T.StructField("kWh", T.DoubleType()),
    T.StructField("imp", T.IntegerType()),
])

USER_FILE = r"([0-9a-f]{64})\.csv"
ONE_FILE_PER_USER = "[0-9a-f]" * 64 + ".csv"


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet table; a given schema saves the footer-reading job."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_readings_csv(spark: SparkSession, path: str, name_regex: str = USER_FILE, null: str = "NA",
                      file_glob: str = ONE_FILE_PER_USER, name_col: str | None = None) -> DataFrame:
    """Reading files named by their user: the id is the 64-character name.

    The schema is explicit, so no inference pass runs. Other files in the folder
    are skipped before they are opened. A user may also be a folder
    ``<id>.csv`` of part files, read with ``file_glob="*.csv"``. Bundles hold the lines of many
    users' files, each with its file's name in the first column, ``name_col``; opening and
    listing then cost what the bytes cost, however many users there are.
    """
    schema = T.StructType([*([T.StructField(name_col, T.StringType())] if name_col else []), *READING_SCHEMA.fields])
    raw = (spark.read.schema(schema).option("header", True).option("nullValue", null)
           .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").option("recursiveFileLookup", True)
           .option("pathGlobFilter", file_glob).csv(path))
    user = F.regexp_extract(F.col(name_col) if name_col else F.col("_metadata.file_path"), name_regex, 1)
    return raw.select(user.alias("user_id"), F.col("index").alias("ts"), F.year("index").alias("year"),
                      F.month("index").alias("month"), F.col("kWh").cast("float").alias("kwh"))


def read_contracts_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Contract metadata: explicit schema when given, else a full inference scan."""
    r = spark.read.option("header", True).option("nullValue", "NA")
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)


def read_readings(spark: SparkSession, root: str, years: Iterable[int] | None = None, start=None, end=None,
                  merge_schema: bool = False, ts: str = "ts") -> DataFrame:
    """Year-partitioned readings. A time range also prunes the year folders."""
    df = spark.read.option("mergeSchema", merge_schema).parquet(root)
    if years is not None:
        df = df.where(F.col("year").isin(*[int(y) for y in years]))
    if start is not None:
        df = df.where((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col("year") >= int(str(start)[:4])))
    if end is not None:
        df = df.where((F.col(ts) < F.lit(end).cast("timestamp_ntz")) & (F.col("year") <= int(str(end)[:4])))
    return df


def union_tables(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Stack tables by column name, filling absent columns with null."""
    out = first
    for d in rest:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                partition_by: Iterable[str] = ()) -> DataFrame:
    """Read the table at ``path`` if a finished one is there, else build, write and read it."""
    from loadloom.sources.writers import write_parquet

    if not path_exists(spark, f"{path}/_SUCCESS"):
        write_parquet(build(), path, partition_by)
    return spark.read.parquet(path)
