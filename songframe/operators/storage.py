"""Steps written to the folder that driver and executors share, and read back: the
plan starts anew, and a lost executor costs no more than the step at hand."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session names none, a folder of our own on a
    single machine, as in tests, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="songframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below one of the application's own."""
    return f"{shared_folder(spark)}/songframe-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table at a new_place()."""
    spark = df.sparkSession
    path = new_place(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def once(df: DataFrame, path: str) -> DataFrame:
    """df as a table at a path of the caller's, written by the first run that gets to
    its end and read by later ones: a stage that need not be repeated. A run that failed
    leaves no mark of success, and its files are replaced."""
    spark = df.sparkSession
    schema = df.schema
    if not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def input_digest(options: dict, *columns: str) -> Column:
    """SHA-256 of a row's columns and of the options that it is worked on with."""
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(row, F.lit(json.dumps(options, sort_keys=True))), 256)


#: Parts that a stage's table is replaced by: of so many, those with a song that is new.
PARTS = 256


def by_song(songs: DataFrame, key: str, stage: Callable[[DataFrame], DataFrame], path: str, options: dict | None = None, parts: int = PARTS) -> DataFrame:
    """stage(songs), of which only those songs are computed that no earlier run did.

    songs has one row a song, which its key names; stage gives any number of rows with that key
    for each. The table at `path` holds one row a song: a digest of what the song's rows came from
    (its columns and the options) and an array of them, empty where there are none, so that
    a song that fails is not tried again. A song is pending whose digest the table
    does not hold. The parts that pending songs fall into are replaced, when the run is through, by
    their rows and those that still hold; a run that is stopped changes nothing, and other parts
    are not touched. Songs of the table that are not asked for stay in it."""
    spark = songs.sparkSession
    rows = stage(songs.limit(0))
    fields = StructType([f for f in rows.schema if f.name != key])
    layout = StructType([songs.schema[key], StructField("digest", StringType()), StructField("rows", ArrayType(fields))])
    with_part = StructType([*layout.fields, StructType.fromDDL("part int").fields[0]])
    asked = songs.withColumn("digest", input_digest(options or {}, *songs.columns))
    if exists(spark, path):
        held = spark.read.schema(with_part).parquet(path)
    else:
        held = spark.createDataFrame([], with_part)
    mine = asked.select(key, "digest")
    pending = kept(asked.join(held.select(key, "digest"), [key, "digest"], "left_anti").withColumn("part", F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")), "pending")
    touched = [r.part for r in pending.select("part").distinct().collect()]  # `parts` at most
    if touched:
        new = stage(pending.drop("digest", "part"))
        found = new.groupBy(key).agg(F.collect_list(F.struct(*(f.name for f in fields))).alias("rows"))
        done = pending.select(key, "digest", "part").join(found, key, "left").withColumn("rows", F.coalesce("rows", F.array().cast(ArrayType(fields))))
        still = held.where(F.col("part").isin(touched)).join(pending.select(key), key, "left_anti")
        both = done.select(with_part.names).unionByName(still.select(with_part.names))
        both.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
        held = spark.read.schema(with_part).parquet(path)
    return held.join(mine, [key, "digest"], "left_semi").select(key, F.explode("rows").alias("row")).select(key, "row.*")
