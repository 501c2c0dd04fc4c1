"""Samples that reruns repeat: rows are ordered by a hash of their key and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songframe.operators import ranks


def lot(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def uniform(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows (all, if fewer)."""
    return rows.orderBy(lot(key, seed), key).limit(n)


def terciles(rows: DataFrame, value: str) -> tuple[float, float]:
    """The values at ranks n // 3 and 2 n // 3 of the sorted rows (0 if none); nulls do
    not count."""
    n = F.col("n")
    found = ranks.at_ranks(rows, [], value, [F.floor(n / 3), F.floor(2 * n / 3)]).first()
    return tuple(found.at) if found and found.n else (0.0, 0.0)


def allocation(strata: DataFrame, n: int, *keys: str) -> DataFrame:
    """strata (keys and size, its rows) with share, how many rows each gives: in proportion,
    one at least, half to even.

    Where the sum of these is not n, single rows are taken back or added. A stratum's rows are numbered: those it
    gives from 1 up, those it has left from 1 up. Rows with the highest numbers of all strata go first,
    by order of the keys (nulls last) on ties, as many as the sum is off by."""
    order = [F.col(k).asc_nulls_last() for k in keys]
    rows = strata.withColumn("total", F.sum("size").over(Window.partitionBy()))
    rows = rows.withColumn("share", F.greatest(F.lit(1), F.rint(n * F.col("size") / F.col("total")).cast("int")))
    rows = rows.withColumn("off", F.sum("share").over(Window.partitionBy()) - n)
    highest = F.when(F.col("off") > 0, F.col("share")).otherwise(F.col("size") - F.col("share")).cast("int")
    lowest = F.greatest(F.lit(1), highest - F.abs("off").cast("int") + 1)
    units = rows.withColumn("number", F.explode_outer(F.when((F.col("off") != 0) & (highest > 0), F.sequence(lowest, highest))))
    place = F.row_number().over(Window.orderBy(F.col("number").desc_nulls_last(), *order))
    moves = F.col("number").isNotNull() & (place <= F.abs("off"))
    step = F.when(moves, -F.signum("off")).otherwise(0).cast("int")
    out = units.withColumn("step", step).groupBy(*keys, "size", "share").agg(F.sum("step").alias("step"))
    return out.select(*keys, "size", (F.col("share") + F.col("step")).cast("int").alias("share"))


def with_band(rows: DataFrame, value: str) -> DataFrame:
    """band 0, 1 or 2 by terciles of the value."""
    low, high = terciles(rows, value)
    return rows.withColumn("band", F.when(F.col(value) < low, 0).when(F.col(value) < high, 1).otherwise(2))


def stratified(rows: DataFrame, key: str, group: str, value: str, n: int, seed: int = 0) -> DataFrame:
    """n rows over group (null is one) and band in proportion to their rows.

    The lot of the last row that a stratum gives is found by rank; only rows with a lot
    up to it are sorted, which are as many as are asked for, and repeated keys."""
    banded = with_band(rows, value).withColumns({"lot of the row": lot(key, seed), "stratum": F.struct(F.col(group).alias("g"), F.col("band").alias("b"))})
    strata = banded.groupBy(group, "band").agg(F.count(F.lit(1)).alias("size"))
    plan = [(r[group], r["band"], min(r["share"], r["size"])) for r in allocation(strata, n, group, "band").collect()]
    if not plan:
        return banded.drop("lot of the row", "stratum")
    shares = sorted({k for *_, k in plan} | {1})
    plan = rows.sparkSession.createDataFrame(plan, "`plan group` string, `plan band` int, share int")
    found = ranks.at_ranks(banded, [group, "band"], "lot of the row", [F.lit(k - 1) for k in shares])
    last = found.select(F.col(group).cast("string").alias("of group"), F.col("band").alias("of band"), F.map_from_arrays(F.array(*map(F.lit, shares)), F.col("at")).alias("lots"))
    plan = plan.join(last, F.col("plan group").eqNullSafe(F.col("of group")) & (F.col("plan band") == F.col("of band"))).select("plan group", "plan band", "share", F.try_element_at("lots", F.col("share")).alias("last lot"))
    near = banded.join(F.broadcast(plan), F.col(group).cast("string").eqNullSafe(F.col("plan group")) & (F.col("band") == F.col("plan band"))).where(F.col("lot of the row") <= F.col("last lot"))
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy("lot of the row", key))
    return near.withColumn("rank in stratum", rank).where(F.col("rank in stratum") <= F.col("share")).select(*rows.columns, "band")
