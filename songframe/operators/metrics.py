"""Aggregates: distributions, errors, rates, votes, strata.

Groups are by chart or another key; all are plain aggregates, so that Spark adds
up before the shuffle where a function allows it. Exact percentiles hold a chart's
values together; those of a whole library are found by ranks (see ranks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songframe.functions.timing import ratio
from songframe.operators import ranks

PERCENTS = (10, 25, 50, 75, 90, 95, 99)


def distribution(samples: DataFrame, by: str = "metric", value: str = "value") -> DataFrame:
    """n, mean and percentiles (linear between neighbours) of each group, rounded to 3."""
    out = ranks.quantiles(samples, [by], value, [p / 100 for p in PERCENTS])
    return out.select(by, "n", F.round("mean", 3).alias("mean"), *(F.round(F.col("q")[i], 3).alias(f"p{p}") for i, p in enumerate(PERCENTS)))


def summary(rows: DataFrame, *metrics: str) -> DataFrame:
    """(metric, n, median, mean) of the named columns, rounded to 3; nulls do not count."""
    out = ranks.quantiles(pooled(rows, *metrics), ["metric"], "value", [0.5])
    return out.select("metric", "n", F.round(F.col("q")[0], 3).alias("median"), F.round("mean", 3).alias("mean"))


def group_medians(rows: DataFrame, by: str, *metrics: str) -> DataFrame:
    """(by, n, medians rounded to 3) of each group; n counts all rows."""
    names = [f"m{i}" for i in range(len(metrics))]
    sizes = rows.groupBy(F.col(by).alias("group")).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array(*(F.struct(F.lit(a).alias("metric"), F.col(m).cast("double").alias("value")) for a, m in zip(names, metrics, strict=True)))
    long = rows.select(F.col(by).alias("group"), F.explode(pairs).alias("x")).select("group", "x.metric", "x.value")
    found = ranks.quantiles(long, ["group", "metric"], "value", [0.5]).groupBy("group").agg(*(F.max(F.when(F.col("metric") == a, F.round(F.col("q")[0], 3))).alias(a) for a in names))
    found = found.withColumnRenamed("group", "of")
    out = sizes.join(found, F.col("group").eqNullSafe(F.col("of")), "left")
    return out.select(F.col("group").alias(by), "n", *(F.col(a).alias(m) for a, m in zip(names, metrics, strict=True)))


def language_medians(rows: DataFrame, *metrics: str, lang: str = "lang") -> DataFrame:
    """group_medians() by language; no rows where there is but one."""
    out = group_medians(rows, lang, *metrics)
    return out.withColumn("languages", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).where("languages > 1").drop("languages")


def report(rows: DataFrame, *columns: str, width: int = 28) -> DataFrame:
    """(row, line) of lines to read: a column's name, padded, and its value; rows are
    named by the first column, null values are -."""
    pairs = F.array(*(F.struct(F.lit(c).alias("k"), F.coalesce(F.col(c).cast("string"), F.lit("-")).alias("v")) for c in columns[1:]))
    lines = rows.select(F.col(columns[0]).alias("row"), F.explode(pairs).alias("x"))
    return lines.select("row", F.concat(F.rpad("x.k", width, " "), F.lit(" "), "x.v").alias("line"))


def pooled(rows: DataFrame, *metrics: str) -> DataFrame:
    """One row (metric, value) for each number in the named columns."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    return rows.select(F.explode(pairs).alias("x")).select("x.metric", "x.value").where(F.col("value").isNotNull())


def median(x: Column | str) -> Column:
    return F.percentile(x, F.lit(0.5))


def error_stats(errors: DataFrame, by: str, value: str = "error") -> DataFrame:
    """Of signed errors in seconds, in ms: the upper median and the floor-rank p90 of
    their sizes, the mean size, and the signed median."""
    sizes = F.sort_array(F.collect_list(F.abs(value)))
    out = errors.groupBy(by).agg(F.count(F.lit(1)).alias("n"), sizes.alias("a"), F.avg(F.abs(value)).alias("mae"), median(value).alias("bias"))
    at = lambda i: F.round(F.col("a")[i.cast("int")] * 1000, 1)
    return out.select(by, "n", at(F.floor(F.col("n") / 2)).alias("median_ms"), F.round(F.col("mae") * 1000, 1).alias("mae_ms"), at(F.floor(0.9 * (F.col("n") - 1))).alias("p90_ms"), F.round(F.col("bias") * 1000, 1).alias("bias_ms"))


def pitch_agreement(pairs: DataFrame, by: str = "chart_id") -> DataFrame:
    """Of matched pitches (g, r): contour_corr, the correlation (0 for one pair, or
    where a side does not vary), and within_2st, the share of pairs at most two
    semitones apart once each side's median is taken off."""
    own = Window.partitionBy(by)
    rows = pairs.withColumns({"gm": F.col("g") - median("g").over(own), "rm": F.col("r") - median("r").over(own)})
    corr = F.try_divide(F.covar_pop("gm", "rm"), F.stddev_pop("gm") * F.stddev_pop("rm"))
    return rows.groupBy(by).agg(F.round(F.coalesce(corr, F.lit(0.0)), 3).alias("contour_corr"), F.round(F.avg((F.abs(F.col("gm") - F.col("rm")) <= 2).cast("int")), 3).alias("within_2st"))


def majority(rows: DataFrame, by: str | list[str], label: str) -> DataFrame:
    """The most frequent label that is not null, the smallest on ties. Groups without
    any have no row."""
    by = [by] if isinstance(by, str) else by
    counts = rows.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.min_by(label, F.struct(-F.col("n"), label)).alias(label))


def speaker_order(segments: DataFrame, onset: str = "s", speaker: str = "speaker") -> DataFrame:
    """rank of each speaker of a chart by first onset, then label, from 0."""
    first = segments.groupBy("chart_id", speaker).agg(F.min(onset).alias("first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("chart_id").orderBy("first", speaker)) - 1)


def track_shares(lines: DataFrame, least: float = 0.10, most: float = 0.90) -> DataFrame:
    """Of lines with track (0 or 1), by chart: share of track 1, and split: both have
    two lines or more and the share lies within the bounds."""
    out = lines.groupBy("chart_id").agg(F.avg("track").alias("share"), F.count_if(F.col("track") == 1).alias("second"), F.count_if(F.col("track") == 0).alias("lead"))
    return out.withColumn("split", (F.col("second") >= 2) & (F.col("lead") >= 2) & F.col("share").between(least, most))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of value times weight over the sum of weights, or over 1 if that is 0."""
    total = F.sum(weight)
    return F.sum(value * weight) / F.when(total == 0, 1).otherwise(total)


def match_rates(counts: DataFrame) -> DataFrame:
    """counts (gen_notes, ref_notes, matched) with their ratios, 0 without reference."""
    return counts.withColumns({"note_count_ratio": F.round(ratio(F.col("gen_notes"), F.col("ref_notes")), 3), "match_rate_vs_ref": F.round(ratio(F.col("matched"), F.col("ref_notes")), 3)})


def strata_medians(rows: DataFrame, *metrics: str) -> DataFrame:
    """Medians over all rows, by lang, and by band; `stratum` names the set."""
    named = F.array(F.lit("ALL"), F.concat(F.lit("lang="), F.coalesce("lang", F.lit(""))), F.concat(F.lit("band="), F.coalesce(F.col("band").cast("string"), F.lit(""))))
    return group_medians(rows.select(F.explode(named).alias("stratum"), *metrics), "stratum", *metrics)


def with_results(sample: DataFrame, results: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """sample with its result, else its error, else the error "not run"."""
    done = results.withColumn("done", F.lit(True))
    out = sample.join(done, key, "left").join(errors.select(key, F.col("error").alias("failure")), key, "left")
    return out.withColumn("error", F.when(F.col("done").isNull(), F.coalesce("failure", F.lit("not run")))).drop("done", "failure")


def pending(sample: DataFrame, results: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """Rows of the sample that have neither result nor error."""
    return sample.join(results.select(key), key, "left_anti").join(errors.select(key), key, "left_anti")


def romanizable(tokens: DataFrame, key: Column, least: float = 0.8) -> DataFrame:
    """By chart, the share of tokens with letters in their key, and whether it is enough."""
    out = tokens.groupBy("chart_id").agg(F.avg((key != "").cast("int")).alias("share"))
    return out.withColumn("passes", F.col("share") >= least)
