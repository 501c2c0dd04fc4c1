"""Other sources and sinks: song folders, tags, timed lyrics, metric files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe.functions.text import stripped

STAMP = r"\[(\d+):(\d+(?:\.\d+)?)\]"


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """(folder, file) of all files one level down; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.select(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"))


def songs(files: DataFrame) -> DataFrame:
    """Folders of (folder, file) with exactly one .mp3 and a chart that is not marked
    [multi]: mp3, gold (the chart with the shortest name) and multi (or null)."""
    low = F.lower("file")
    chart, many = low.endswith(".txt"), F.contains(low, F.lit("[multi]"))
    gold, multi = F.when(chart & ~many, F.col("file")), F.when(chart & many, F.col("file"))
    out = files.groupBy("folder").agg(
        F.count_if(low.endswith(".mp3")).alias("mp3s"), F.min(F.when(low.endswith(".mp3"), F.col("file"))).alias("mp3"),
        F.min_by(gold, F.when(gold.isNotNull(), F.struct(F.char_length(gold), gold))).alias("gold"), F.min(multi).alias("multi"),
    )
    return out.where("mp3s = 1 AND gold IS NOT NULL").select("folder", "mp3", "gold", "multi")


def tags(lines: DataFrame) -> DataFrame:
    """(key, tag, value) of (key, text) in lines of tag=value; the first = parts them,
    the last of repeated tags counts."""
    rows = lines.select("key", F.posexplode(F.split("text", "\r\n|\n")).alias("at", "line")).where(F.instr("line", "=") > 0)
    tag = F.lower(stripped(F.replace(F.regexp_extract("line", "^([^=]*)=", 1), F.lit("TAG:"), F.lit(""))))
    rows = rows.select("key", "at", tag.alias("tag"), stripped(F.regexp_extract("line", "^[^=]*=(.*)$", 1)).alias("value"))
    return rows.groupBy("key", "tag").agg(F.max_by("value", "at").alias("value"))


def timed_lyrics(texts: DataFrame) -> DataFrame:
    """(key, t, pos, text) of (key, text) in lines with stamps [mm:ss]; every stamp
    gives a row, lines without words none. pos orders rows of the same time."""
    rows = texts.select("key", F.posexplode(F.split("text", "\r\n|\n")).alias("line", "s"))
    words = stripped(F.regexp_replace("s", STAMP, ""))
    minutes, seconds = F.regexp_extract_all("s", F.lit(STAMP), F.lit(1)), F.regexp_extract_all("s", F.lit(STAMP), F.lit(2))
    rows = rows.select("key", "line", words.alias("text"), F.posexplode(F.arrays_zip(minutes.alias("m"), seconds.alias("s"))).alias("nth", "x")).where("text <> ''")
    return rows.select("key", (F.col("x.m").cast("double") * 60 + F.col("x.s").cast("double")).alias("t"), (F.col("line") * 1000 + F.col("nth")).alias("pos"), "text")


def typed_lyrics(text: str, most: int = 20_000):
    """Lines of a typed lyric: at most `most` characters, stripped, without blank ones."""
    lines = F.transform(F.split(F.substring(text, 1, most), "\r\n|\n"), stripped)
    return F.filter(lines, lambda x: x != "")


def seconds(text: str):
    """A duration, 0 if it cannot be read."""
    return F.coalesce(stripped(F.col(text)).try_cast("double"), F.lit(0.0))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Metric records of write_json(), one a line; columns that a record lacks are null."""
    return spark.read.schema(schema).json(path)


def write_csv(rows: DataFrame, path: str, *columns: str) -> None:
    """The named columns, in this order, under a header."""
    rows.select(*columns).write.mode("overwrite").option("header", "true").csv(path)


def flat_metrics(rows: DataFrame) -> DataFrame:
    """Columns of a replay's nested record (stem, n_gold_words, whisper, fa, syll,
    pitch, bpm); missing parts are null."""
    # fixed values: names of the report's columns and of the record's fields
    named = {
        "w_recall": "whisper.recall", "w_onset_med_ms": "whisper.onset.median_ms", "w_onset_mae_ms": "whisper.onset.mae_ms", "w_onset_p90_ms": "whisper.onset.p90_ms", "w_bias_ms": "whisper.onset.bias_ms",
        "fa_ok": "fa.ok", "fa_score": "fa.score", "fa_aligned_frac": "fa.aligned_frac", "fa_recall": "fa.recall", "fa_onset_med_ms": "fa.onset.median_ms", "fa_onset_mae_ms": "fa.onset.mae_ms", "fa_onset_p90_ms": "fa.onset.p90_ms", "fa_bias_ms": "fa.onset.bias_ms",
        "syll_n_words": "syll.n_words", "syll_prop_med_ms": "syll.prop_median_ms", "syll_fa_med_ms": "syll.fa_median_ms", "pitch_coverage": "pitch.coverage", "pitch_within_2st": "pitch.within_2st", "pitch_corr": "pitch.contour_corr",
        "bpm_est": "bpm.est", "bpm_mult": "bpm.mult", "bpm_dev": "bpm.dev",
    }
    return rows.select("stem", "n_gold_words", *(F.col(path).alias(name) for name, path in named.items()))
