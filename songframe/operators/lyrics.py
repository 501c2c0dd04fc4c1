"""Lyrics: tokens of lines, and their alignment with timed words."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songframe.functions import text as T
from songframe.functions.arrow import similarity
from songframe.operators.sequences import carried, in_chart, kept_words
from songframe.operators.storage import kept


def raw_words(lines: DataFrame) -> DataFrame:
    """(chart_id, line_index, word_index, word): blank-separated words of lines."""
    words = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")
    return lines.select("chart_id", "line_index", F.posexplode(words).alias("word_index", "word"))


def bracketed_words(lines: DataFrame, shown: bool = False) -> DataFrame:
    """raw_words() with depth (open brackets after the word, never below zero) and adlib
    (inside brackets, or with one): a fold over the words of the row that hold a
    bracket, which split the others into stretches of one depth. Lines are not shuffled.
    With shown also text, the word as it is displayed."""
    count = lambda w, c: F.char_length(w) - F.char_length(F.translate(w, c, ""))
    rows = lines.select("chart_id", "line_index", F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "").alias("words"), F.col("text").rlike("[()]").alias("some"))
    marks = F.transform("words", lambda w, i: F.struct(i.alias("at"), (count(w, "(") - count(w, ")")).alias("opens"), F.contains(w, F.lit("(")).alias("a"), F.contains(w, F.lit(")")).alias("b")))
    start = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("depth")))
    fold = F.aggregate(F.filter(marks, lambda m: m["a"] | m["b"]), start, lambda done, m: F.concat(done, F.array(F.struct(m["at"].alias("at"), F.greatest(F.lit(0), F.element_at(done, -1)["depth"] + m["opens"]).alias("depth")))))
    rows = rows.select("*", F.when(F.col("some"), fold).otherwise(start).alias("marks"))
    word = lambda at, w, depth, adlib: F.struct(at.alias("word_index"), w.alias("word"), depth.alias("depth"), adlib.alias("adlib"), *([T.word_display(w).alias("text")] if shown else []))

    def stretch(m: Column, i: Column) -> Column:
        end = F.coalesce(F.get("marks", i + 1)["at"], F.size("words"))
        rest = F.transform(F.slice("words", m["at"] + 2, end - m["at"] - 1), lambda w, j: word(m["at"] + 1 + j, w, m["depth"], m["depth"] > 0))
        return F.when(i == 0, rest).otherwise(F.concat(F.array(word(m["at"], F.get("words", m["at"]), m["depth"], F.lit(True))), rest))

    simple = F.transform("words", lambda w, i: word(i, w, F.lit(0), F.lit(False)))
    found = F.when(F.col("some"), F.flatten(F.transform("marks", stretch))).otherwise(simple)
    return rows.select("chart_id", "line_index", F.explode(found).alias("w")).select("chart_id", "line_index", "w.*")


def tokens(lines: DataFrame) -> DataFrame:
    """(chart_id, line_index, word_index, text, key, new_line, adlib): words without
    outer marks; those without letter or digit drop out."""
    rows = bracketed_words(lines, shown=True).withColumn("key", T.word_key(F.col("text")))
    first = (F.col("word_index") == 0) & (F.col("line_index") > 0)
    return rows.where(T.has_key(F.col("text"))).select("chart_id", "line_index", "word_index", "text", "key", first.alias("new_line"), "adlib")


def _pairs(a: list[str], b: list[str], least: float = 0.5) -> list[tuple[int, int]]:
    """Places that line up: equal keys, and replaced ones that resemble each other."""
    out = []
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag in ("equal", "replace"):
            out += [(i, j) for i, j in zip(range(i1, i2), range(j1, j2), strict=False) if tag == "equal" or similarity(a[i], b[j]) >= least]
    return out


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """(chart_id, left_pos, right_pos): words (chart_id, pos, key) of a chart that line
    up, one to one and in order. Matching is quadratic in a chart's words at worst, so
    it runs chart by chart and never across charts."""

    def fold(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"chart_id": [], "left_pos": [], "right_pos": []})
        a, b = a.sort_values("pos"), b.sort_values("right_pos")
        at, bt = a["pos"].tolist(), b["right_pos"].tolist()
        found = [(at[i], bt[j]) for i, j in _pairs(a["key"].tolist(), b["right_key"].tolist())]
        out = pd.DataFrame(found, columns=["left_pos", "right_pos"])
        return out.assign(chart_id=a["chart_id"].iloc[0])[["chart_id", "left_pos", "right_pos"]]

    other = right.select(F.col("chart_id").alias("right_chart"), F.col("pos").alias("right_pos"), F.col("key").alias("right_key"))
    pairs = left.select("chart_id", "pos", "key").groupBy("chart_id").cogroup(other.groupBy("right_chart"))
    return pairs.applyInPandas(fold, "chart_id long, left_pos int, right_pos int")


def matched_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """aligned() without words whose key is empty."""
    return aligned(left.where(F.col("key") != ""), right.where(F.col("key") != ""))


def with_lyrics(lines: DataFrame, words: DataFrame, least: float = 0.3) -> DataFrame:
    """Timed words (chart_id, pos, text, start_s, end_s) with the lyric's text and
    lines: matched words take those of their token; others keep their text and the line
    before them, or go (see kept_words). Charts of which under `least` of the tokens
    match have no rows."""
    own = tokens(lines).withColumn("n", F.struct("line_index", "word_index"))
    own = own.withColumn("pos", F.row_number().over(in_chart("line_index", "word_index")).cast("int") - 1)
    heard = words.withColumn("key", T.word_key(F.col("text")))
    pairs = kept(aligned(own, heard), "aligned")
    enough = pairs.groupBy("chart_id").agg(F.count(F.lit(1)).alias("hits")).join(own.groupBy("chart_id").agg(F.count(F.lit(1)).alias("all")), "chart_id")
    enough = enough.where(F.col("hits") >= least * F.col("all")).select("chart_id")
    vocabulary = own.select("chart_id", "key").distinct().withColumn("known", F.lit(True))
    found = pairs.join(own.select("chart_id", F.col("pos").alias("left_pos"), F.col("text").alias("lyric"), "line_index", "adlib"), ["chart_id", "left_pos"])
    rows = heard.join(enough, "chart_id", "left_semi").join(found.withColumnRenamed("right_pos", "pos").drop("left_pos"), ["chart_id", "pos"], "left")
    rows = rows.join(vocabulary, ["chart_id", "key"], "left").withColumns({"matched": F.col("lyric").isNotNull(), "in_vocabulary": F.coalesce("known", F.lit(False))})
    rows = carried(kept_words(rows), "line_index")
    return rows.select("chart_id", "pos", F.coalesce("lyric", T.stripped(F.col("text"))).alias("text"), "start_s", "end_s", "line_index", F.coalesce("adlib", F.lit(False)).alias("adlib"))


def look_up(songs: DataFrame, lyrics: DataFrame) -> DataFrame:
    """songs (artist, title, duration) with the text of a lyric table (artist, title,
    duration, plain, synced, instrumental): by rounded duration, else by artist and
    title alone (the smallest duration); instrumental ones have none; plain text, else
    the synced one without stamps."""
    body = F.coalesce(F.nullif("plain", F.lit("")), T.stripped(F.regexp_replace("synced", r"\[\d+:\d+(\.\d+)?\]\s*", "")))
    rows = lyrics.select("artist", "title", F.bround("duration").cast("int").alias("seconds"), F.when(~F.coalesce("instrumental", F.lit(False)), F.struct(body.alias("text"))).alias("body"))
    exact = rows.groupBy("artist", "title", "seconds").agg(F.count(F.lit(1)).alias("n"), F.min("body").alias("exact"))
    loose = rows.groupBy("artist", "title").agg(F.min_by("body", F.struct("seconds", "body")).alias("loose"))
    out = songs.withColumn("seconds", F.bround("duration").cast("int")).join(exact, ["artist", "title", "seconds"], "left").join(loose, ["artist", "title"], "left")
    return out.withColumn("text", F.when(F.col("n").isNotNull(), F.col("exact.text")).otherwise(F.col("loose.text"))).drop("seconds", "n", "exact", "loose")
