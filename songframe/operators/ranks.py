"""Order statistics of groups that no task could hold: exact, by counts and ranges.

Equal values are counted first, then dealt out by ranges of (group, value); what
stands before a range follows from the ranges' sums, so a task runs through its own
range only. Null values do not count; groups without others have no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songframe.operators.storage import kept

#: Ranges, and groups, of which the sums are broadcast.
FEW = 100_000


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def counted(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """A row for each group (g0, g1, ..) and value v: count c, the group's rows n, and
    `before`, how many of them have a smaller value; as a stored table's rows."""
    g = [f"g{i}" for i in range(len(by))]
    slim = rows.where(F.col(value).isNotNull()).select(*(F.col(c).alias(a) for c, a in zip(by, g, strict=True)), F.col(value).alias("v"))
    sums = slim.groupBy(*g, "v").agg(F.count(F.lit(1)).alias("c"))
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = kept(sums.repartitionByRange(ranges, *g, "v").withColumn("part", F.spark_partition_id()), "counts")
    whole = Window.partitionBy(F.lit(0), *g)
    parts = sums.groupBy(*g, "part").agg(F.sum("c").alias("size"))
    parts = parts.withColumns({"n": F.sum("size").over(whole), "earlier": F.coalesce(F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    parts = kept(parts.withColumnsRenamed({**{c: f"of_{c}" for c in g}, "part": "of_part"}).drop("size"), "ranges")
    match = F.col("part") == F.col("of_part")
    for c in g:
        match &= same(F.col(c), F.col(f"of_{c}"))
    joined = sums.join(F.broadcast(parts) if parts.count() <= FEW else parts, match)
    own = Window.partitionBy("part", *g).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(*g, "v", "c", "n", (F.col("earlier") + F.coalesce(F.sum("c").over(own), F.lit(0))).alias("before"))


def at_ranks(rows: DataFrame, by: Sequence[str], value: str, ranks: Sequence[Column]) -> DataFrame:
    """by, n, mean, and `at`, the values at the ranks (from 0; columns of n) of each
    group in ascending order."""
    c = counted(rows, by, value)
    g = [f"g{i}" for i in range(len(by))]
    hit = [F.max(F.when((F.col("before") <= r) & (r < F.col("before") + F.col("c")), F.col("v"))) for r in ranks]
    mean = F.sum(F.col("v").try_cast("double") * F.col("c")) / F.first("n")
    out = c.groupBy(*g).agg(F.first("n").alias("n"), mean.alias("mean"), F.array(*hit).alias("at"))
    return out.withColumnsRenamed(dict(zip(g, by, strict=True)))


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """by, n, mean, and q, the quantiles (linear between neighbours) of each group."""
    places = [(F.col("n") - 1) * F.lit(float(s)) for s in shares]
    ranks = [r for p in places for r in (F.floor(p), F.ceil(p))]
    out = at_ranks(rows, by, value, ranks)
    low, high = (lambda i: F.col("at")[2 * i].cast("double")), (lambda i: F.col("at")[2 * i + 1].cast("double"))
    between = [F.when(low(i) == high(i), low(i)).otherwise((F.ceil(p) - p) * low(i) + (p - F.floor(p)) * high(i)) for i, p in enumerate(places)]
    return out.select(*by, "n", "mean", F.array(*between).alias("q"))
