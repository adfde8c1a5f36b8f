"""Tables dealt into hash buckets of a key, so that a change reads and writes only the buckets it touches.

A table is a Parquet folder partitioned by ``bucket``. The number of buckets is fixed
when the table begins; the touched ones (at most that many numbers) reach the driver
and become a partition filter, everything else is joins.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the one that the cluster shares (spark.checkpoint.dir); a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(named or tempfile.mkdtemp(prefix='work-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed inside are deleted as soon as it is done; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bucket(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def touched(rows: DataFrame) -> list[int]:
    return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())


def read_buckets(spark: SparkSession, path: str, schema: StructType, numbers: list[int] | None = None) -> DataFrame:
    """The table, or only some of its buckets; empty where the table has not begun."""
    try:
        table = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return table if numbers is None else table.filter(F.col("bucket").isin(numbers))


def write_buckets(rows: DataFrame, path: str, mode: str, *inner: str) -> None:
    """Appends to buckets, or replaces those that the rows fall into (and no others)."""
    rows.repartition("bucket", *inner).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket", *inner).parquet(path)


def append_new(rows: DataFrame, path: str, key: str = "result_key", buckets: int = BUCKETS) -> DataFrame:
    """Appends the rows whose key the table does not have, one per key; gives back the plan of what was appended."""
    rows = rows.dropDuplicates([key]).withColumn("bucket", bucket([key], buckets))
    have = read_buckets(rows.sparkSession, path, rows.schema, touched(rows)).select("bucket", key)
    new = rows.join(have, ["bucket", key], "left_anti")
    write_buckets(new, path, "append")
    return new


def merge(rows: DataFrame, path: str, keys: list[str], combine: Callable[[DataFrame, DataFrame], DataFrame], schema: StructType, buckets: int = BUCKETS) -> DataFrame:
    """Rewrites the touched buckets as ``combine(their rows, new rows)``; gives back the plan. Both have the column ``bucket``, and so must the result, whose columns are those of the schema."""
    rows = rows.withColumn("bucket", bucket(keys, buckets))
    schema = StructType([*schema.fields, rows.schema["bucket"]])
    out = combine(read_buckets(rows.sparkSession, path, schema, touched(rows)), rows).select(*schema.names)
    write_buckets(out, path, "overwrite")
    return out


def replace_scopes(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Deletes all rows of the given scopes and inserts the new ones."""

    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(new.select("bucket", *keys).distinct(), ["bucket", *keys], "left_anti").unionByName(new)

    return merge(rows, path, keys, combine, rows.schema, buckets)
