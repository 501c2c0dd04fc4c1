"""Mixing sources to target weights.

Words are summed by source (map-side first). The targets follow from the sums by
sharing a total by weight, with a ceiling for each source, found from running sums
over the sources in the order in which they reach it. A document is then taken
floor(rate) times, and once more if a hash of its id and the seed, read as a
number in [0, 1), is under the rate's fraction. Reruns agree.

Null text has no words. Null is a source of its own, last in order. Repeated
rows of an id share their fate. Rows without id are drawn by their text in mix();
in op6_mixing, where SQL fixes the draw, they share one. A source without words takes nothing. An empty
table gives an empty result. Sources are joined back by broadcast if their count is
within a bound; of more, the hottest are, and the rest by a shuffle. Other columns are passed on or left out; none can
clash, since rows are worked on under names of our own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from songframe.llm.common import GROUP_ROWS, WORD, partitions, staged, table, text_of, with_group

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_COPIES = 2
SEED = 17


def size_of(text: str) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def chance(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from a hash of the key: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def _numbered(rows: DataFrame, name: str, by: list[Column], *sums: str) -> DataFrame:
    """rows in the order `by`, dealt out by its ranges, as a stored table, with `before`
    (how many rows stand before each) and before_<c> (the sum of c over these): within
    its range by a window, and before it by a window over the ranges, a row each."""
    spark = rows.sparkSession
    rows = staged(rows.repartitionByRange(partitions(spark), *by).withColumn("part", F.spark_partition_id()), name)
    names = ["before", *(f"before_{c}" for c in sums)]
    values = [F.lit(1).cast("long"), *(F.col(c).cast("long") for c in sums)]
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("part").agg(*(F.sum(v).alias(f"s{i}") for i, v in enumerate(values)))
    starts = ranges.select(F.col("part").alias("of"), *(F.coalesce(F.sum(f"s{i}").over(earlier), F.lit(0)).alias(f"s{i}") for i in range(len(names))))
    upto = Window.partitionBy("part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    within = [F.coalesce(F.sum(v).over(upto), F.lit(0)) for v in values]
    joined = rows.join(F.broadcast(starts), F.col("part") == F.col("of"))  # as many rows as there are partitions
    return joined.select(*rows.drop("part").columns, *((w + F.col(f"s{i}")).alias(names[i]) for i, w in enumerate(within)))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """From (source, size): source, n, source_size, target, as a stored table.

    The level is what a weight of one takes. Sources reach their ceiling in the order of
    ceiling over weight; if those before a source are at theirs, the others share what
    is left, and the level is the largest share that no ceiling so far passes."""
    by = [F.col("source").isNull(), F.col("source")]
    sums = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    ranked = _numbered(sums, "sources", by)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("before") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "n", "source_size", weight.alias("weight"), (MOST_COPIES * F.col("source_size")).alias("most"))
    filled = staged(_numbered(ranked, "weights", [F.col("most") / F.col("weight"), *by], "most", "weight"), "levels")
    whole = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    share = (F.lit(TOTAL_SHARE * (whole["size"] or 0)) - F.col("before_most")) / (F.lit(whole["weight"] or 0) - F.col("before_weight"))
    level = filled.select(share.alias("level"), (F.col("most") / F.col("weight")).alias("reach")).where("level <= reach").agg(F.max("level")).first()[0]
    target = F.least(F.col("most").cast("double"), F.lit(float(level or 0.0)) * F.col("weight"))
    return staged(filled.select("source", "n", "source_size", target.alias("target")), "targets")


def with_copies(rows: DataFrame, seed: int = SEED, bound: int = GROUP_ROWS) -> DataFrame:
    """rows (id, source, size) with source_size, target and copies."""
    targets = source_targets(rows.select("source", "size")).withColumnRenamed("source", "own")
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    joined = with_group(rows, targets, "source", "own", bound).withColumn("rate", rate)
    whole = F.floor("rate")
    return joined.withColumn("copies", (whole + (chance(F.col("id"), seed) < F.col("rate") - whole).cast("long")).cast("int"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, bound: int = GROUP_ROWS) -> DataFrame:
    """The mixed documents: each row of docs as often as it is taken."""
    slim = docs.select(F.col(source).alias("source"), size_of(text).alias("size"))
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    targets = staged(source_targets(slim).select(F.col("source").alias("mix own"), "n", rate.alias("mix rate")), "rates")
    whole = F.floor(F.col("mix rate"))
    names = docs.columns
    own = docs.toDF(*(f"c{i}" for i in range(len(names))))
    # rows without id draw by their text, or all of them would draw as one
    draw = F.coalesce(F.col(f"c{names.index(key)}").cast("string"), F.concat(F.lit(":"), text_of(f"c{names.index(text)}")))
    times = (whole + (chance(draw, seed) < F.col("mix rate") - whole).cast("long")).cast("int")
    joined = with_group(own, targets, f"c{names.index(source)}", "mix own", bound)
    return joined.withColumn("mix copy", F.explode(F.array_repeat(F.lit(1), times))).select(*own.columns).toDF(*names)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = staged(docs.select(F.col("doc_id").alias("id"), "source", size_of("text").alias("size")), "sizes")
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return with_copies(rows).select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken)


#: The level is the largest over all counts of sources at their ceiling: sources
#: in the order in which they reach it.
MIX_CTES = r"""
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS most FROM s),
a AS (SELECT *, coalesce(sum(most) OVER o, 0) AS fixed, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS left_weight
      FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((1.5 * (SELECT sum(source_size) FROM s) - fixed) / left_weight) AS level
      FROM a WHERE (1.5 * (SELECT sum(source_size) FROM s) - fixed) / left_weight <= most / weight),
t AS (SELECT source, source_size, least(most::DOUBLE, coalesce(level, 0)::DOUBLE * weight) AS target FROM w, l),
m AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':17'), 1, 13))::BIGINT / 4503599627370496.0 AS chance
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
"""
OP6_SQL = "WITH " + MIX_CTES.format(docs="documents") + r"""
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM m
"""
