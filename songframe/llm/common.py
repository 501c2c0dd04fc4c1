"""Helpers that the text operators share: tables, the shared folder, bounds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java and DuckDB pattern.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a broadcast side may have; larger sides are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Groups that with_group() broadcasts, and the share of rows that makes one hot beyond.
GROUP_ROWS, HOT_SHARE = 10_000, 2000
#: Rows of a batch in a Python worker.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. On a single machine,
    as in tests, one of our own will do where the session names none; a cluster must
    name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="songframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in a folder of the application's own, which can be deleted as a whole
    when the application is over and its results are elsewhere."""
    return f"{shared_dir(spark)}/songframe-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """Whole text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side whose rows were counted and are within the bound."""
    return F.broadcast(df) if rows <= bound else df


def with_group(rows: DataFrame, groups: DataFrame, key: str, group_key: str, bound: int = GROUP_ROWS, share: int = HOT_SHARE) -> DataFrame:
    """rows joined with the group of each (null is a group): groups has one row for each
    group_key and the count n of its rows, and is a stored table.

    Up to `bound` groups are broadcast. Of more, those with over 1/share of all rows,
    which are less than `share`, are broadcast, and the others go by a shuffle that has
    no hot key. The columns of groups other than group_key and n are added."""
    known = groups.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows")).first()
    match = F.col(key).eqNullSafe(F.col(group_key))
    if known.groups <= bound:
        return rows.join(F.broadcast(groups.drop("n")), match).drop(group_key)
    hot = F.col("n") > known.rows / share
    first = rows.join(F.broadcast(groups.where(hot).drop("n")), match).drop(group_key)
    rest = rows.join(F.broadcast(groups.where(hot).select(group_key)), match, "left_anti")
    return first.unionByName(rest.join(groups.where(~hot).drop("n"), match).drop(group_key))


def few_rows(spark: SparkSession, name: str, values: Sequence[str]) -> DataFrame:
    """A table of a bounded list of strings, as literals of the plan."""
    cell = F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")
    return spark.range(1).select(F.explode(cell).alias(name))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Bound the rows, and so the memory, of a batch of texts in a Python worker. Spark
    has no such setting for one query, so it is lowered for the session, to the same
    number by all operators; results do not depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "0")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(name, BATCH_ROWS)
