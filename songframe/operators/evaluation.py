"""A chart against a reference chart: notes, onsets, pitches and lyrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from songframe.functions import timing
from songframe.functions.arrow import similarity_of, syllables_of
from songframe.functions.text import letters_key, lyric_text
from songframe.operators import intervals, metrics, recurrences
from songframe.operators.storage import kept


def flattened(charts: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes of all tracks in order of time: chart_id, pos, track, start_s, end_s, pitch, text, kind."""
    rows = notes.join(charts.select("chart_id", "bpm", "gap_ms"), "chart_id")
    at = lambda b: timing.beat_to_time(b, F.col("bpm"), F.col("gap_ms"))
    rows = rows.withColumns({"start_s": at(F.col("start_beat")), "end_s": at(F.col("start_beat") + F.col("duration"))})
    order = Window.partitionBy("chart_id").orderBy("start_s", "track", "line_no", "note_index")
    return rows.select("chart_id", (F.row_number().over(order).cast("int") - 1).alias("pos"), "track", "start_s", "end_s", "pitch", "text", "kind")


def _side(rows: DataFrame, name: str) -> DataFrame:
    words = F.array_join(F.array_sort(F.collect_list(F.struct("pos", "text")))["text"], "")
    span = F.max_by("end_s", "pos") - F.min_by("start_s", "pos")
    return rows.groupBy("chart_id").agg(F.count(F.lit(1)).alias(f"{name}_notes"), lyric_text(words).alias(f"{name}_text"), F.round(span, 1).alias(f"{name}_span_s"))


def scores(gen: DataFrame, ref: DataFrame, tolerance: float = 0.3) -> DataFrame:
    """The metrics of flattened() notes by chart; charts of either side have a row."""
    pairs = kept(recurrences.greedy_match(gen, ref, tolerance), "matches")
    pairs = pairs.join(gen.select("chart_id", F.col("pos").alias("gen_pos"), F.col("pitch").alias("g")), ["chart_id", "gen_pos"]).join(ref.select("chart_id", F.col("pos").alias("ref_pos"), F.col("pitch").alias("r")), ["chart_id", "ref_pos"])
    size = F.abs("error")
    onsets = pairs.groupBy("chart_id").agg(F.count(F.lit(1)).alias("matched"), F.round(metrics.median(size) * 1000, 1).alias("onset_err_ms_median"), F.round(F.avg(size) * 1000, 1).alias("onset_err_ms_mean"))
    out = _side(gen, "gen").join(_side(ref, "ref"), "chart_id", "full").join(onsets, "chart_id", "left").join(metrics.pitch_agreement(pairs), "chart_id", "left")
    zero = ["gen_notes", "ref_notes", "matched", "gen_span_s", "ref_span_s", "contour_corr", "within_2st"]
    out = metrics.match_rates(out.fillna(0, zero))
    lyric = F.round(similarity_of(F.coalesce("gen_text", F.lit("")), F.coalesce("ref_text", F.lit(""))), 3)
    return out.select("chart_id", "gen_notes", "ref_notes", "note_count_ratio", "matched", "match_rate_vs_ref", "onset_err_ms_median", "onset_err_ms_mean", F.col("contour_corr").alias("pitch_contour_corr"), F.col("within_2st").alias("pitch_within_2st_rate"), lyric.alias("lyric_similarity"), "gen_span_s", "ref_span_s")


def duet_scores(gen: DataFrame, ref: DataFrame, tolerance: float = 0.3) -> DataFrame:
    """For duets on both sides: the pairing of tracks with more matches (direct on
    ties), attributed, accuracy, and p1 and p2, the scores of each reference track."""
    both = gen.where("track = 1").select("chart_id").distinct().join(ref.where("track = 1").select("chart_id").distinct(), "chart_id")
    gen, ref = kept(gen.join(both, "chart_id", "left_semi"), "duet-gen"), kept(ref.join(both, "chart_id", "left_semi"), "duet-ref")
    of = lambda rows, t: rows.where(F.col("track") == t)
    found = None
    for name, (a, b) in {"direct": (0, 1), "swap": (1, 0)}.items():
        one = scores(of(gen, a), of(ref, 0), tolerance).select("chart_id", F.struct("*").alias("p1")).join(scores(of(gen, b), of(ref, 1), tolerance).select("chart_id", F.struct("*").alias("p2")), "chart_id")
        own = [intervals.nearest(of(ref, t), of(gen, g), tolerance) for t, g in ((0, a), (1, b))]
        other = [intervals.nearest(of(ref, t), of(gen, g), tolerance) for t, g in ((0, b), (1, a))]
        right = intervals.singer_accuracy(own[0].unionByName(own[1]), other[0].unionByName(other[1]))
        one = kept(one.join(right, "chart_id", "left").withColumn("pairing", F.lit(name)), name)
        found = one if found is None else found.unionByName(one)
    best = F.row_number().over(Window.partitionBy("chart_id").orderBy(F.desc(F.col("p1.matched") + F.col("p2.matched")), "pairing"))
    return found.withColumn("best", best).where("best = 1").select("chart_id", "pairing", F.coalesce("attributed", F.lit(0)).alias("attributed"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), "p1", "p2")


def timing_scores(gold: DataFrame, heard: DataFrame, pairs: DataFrame) -> DataFrame:
    """By chart, of words (chart_id, pos, start_s, end_s) and their pairs (left_pos in
    gold, right_pos in heard): recall, and the error statistics of onsets and ends.
    Charts without pairs have recall 0 and no statistics."""
    g = gold.select("chart_id", F.col("pos").alias("left_pos"), F.col("start_s").alias("gs"), F.col("end_s").alias("ge"))
    h = heard.select("chart_id", F.col("pos").alias("right_pos"), F.col("start_s").alias("hs"), F.col("end_s").alias("he"))
    both = pairs.join(g, ["chart_id", "left_pos"]).join(h, ["chart_id", "right_pos"])
    out = gold.groupBy("chart_id").agg(F.count(F.lit(1)).alias("words"))
    for name, error in (("onset", F.col("hs") - F.col("gs")), ("end", F.col("he") - F.col("ge"))):
        stats = metrics.error_stats(both.withColumn("error", error), "chart_id")
        out = out.join(stats.select("chart_id", F.struct("n", "median_ms", "mae_ms", "p90_ms", "bias_ms").alias(name)), "chart_id", "left")
    recall = F.round(timing.ratio(F.coalesce("onset.n", F.lit(0)), F.col("words")), 3)
    return out.select("chart_id", recall.alias("recall"), "onset", "end")


def pitch_scores(notes: DataFrame, frames: DataFrame, least: int = 10) -> DataFrame:
    """By chart, of notes (chart_id, pos, start_s, end_s, pitch): n_notes, n_scored (two
    voiced frames or more), coverage, and the agreement of their pitches with the frames'
    medians; null under `least` scored notes."""
    rows = intervals.median_pitch(notes, frames)
    scored = rows.where("n_frames >= 2").select("chart_id", F.col("pitch").cast("double").alias("g"), F.col("midi").alias("r"))
    counts = rows.groupBy("chart_id").agg(F.count(F.lit(1)).alias("n_notes"), F.count_if(F.col("n_frames") >= 2).alias("n_scored"))
    out = counts.join(metrics.pitch_agreement(scored), "chart_id", "left")
    enough = lambda c: F.when(F.col("n_scored") >= least, F.col(c))
    return out.select("chart_id", "n_notes", "n_scored", F.round(timing.ratio(F.col("n_scored"), F.col("n_notes")), 3).alias("coverage"), enough("within_2st").alias("within_2st"), enough("contour_corr").alias("contour_corr"))


def syllable_scores(words: DataFrame, letters: DataFrame) -> DataFrame:
    """By chart, of words (chart_id, pos, text, start_s, end_s, syllables) of which the
    text's own syllables are as many: how far onsets of inner syllables lie from those
    of a spread in proportion, and from the letters' times (chart_id, pos, norm,
    char_spans), in ms. Words of one syllable do not count."""
    rows = words.where(F.size("syllables") >= 2).withColumn("parts", syllables_of("text")).where(F.size("parts") == F.size("syllables"))
    rows = rows.join(letters, ["chart_id", "pos"], "left").withColumn("keys", F.transform("parts", letters_key))
    fits = F.coalesce((F.size("char_spans") > 0) & ~F.exists("keys", lambda k: k == "") & (F.array_join("keys", "") == F.col("norm")), F.lit(False))
    inner = rows.withColumn("fits", fits).select("*", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("i"))
    chars = lambda c, n: F.aggregate(F.slice(c, 1, n), F.lit(0), lambda a, p: a + F.char_length(p))
    whole = chars("parts", F.size("parts"))
    at = F.col("syllables")[F.col("i")]["start_s"]
    even = F.abs(F.col("start_s") + (F.col("end_s") - F.col("start_s")) * chars("parts", F.col("i")) / whole - at)
    cut = F.when(F.col("fits"), F.abs(F.try_element_at("char_spans", chars("keys", F.col("i")) + 1)["s"] - at))
    rows = inner.select("chart_id", "pos", even.alias("even"), cut.alias("cut")).groupBy("chart_id")
    return rows.agg(
        F.count_distinct("pos").alias("n_words"), F.count("even").alias("n_prop"), F.count("cut").alias("n_fa"),
        F.round(metrics.median("even") * 1000, 1).alias("prop_median_ms"), F.round(metrics.median("cut") * 1000, 1).alias("fa_median_ms"),
    )
