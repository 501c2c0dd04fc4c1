"""Joins of points and intervals of a chart.

A condition on times alone would compare all pairs, and one on the chart all
pairs of a chart. Time is therefore cut into bins: an interval goes to every bin
that it touches, a point to its own, and both meet on (chart, bin). The exact
condition follows. Left rows without a partner are joined back where asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songframe.functions import timing


def _bin(t: Column, width: float) -> Column:
    return F.floor(t / width)


def meet(left: DataFrame, right: DataFrame, bounds: tuple[Column, Column], at: Column, width: float) -> DataFrame:
    """Pairs of a left row and the right rows of its chart whose point `at` is in a
    bin that the left row's bounds touch. A left row meets a right row once. Null
    bounds or points meet nothing."""
    lo, hi = bounds
    probe = left.withColumn("bin", F.explode(F.sequence(_bin(lo, width), F.greatest(_bin(lo, width), _bin(hi, width)))))
    return probe.join(right.withColumn("bin", _bin(at, width)), ["chart_id", "bin"]).drop("bin")


def frames_in(spans: DataFrame, frames: DataFrame, width: float = 1.0) -> DataFrame:
    """Pairs of spans [start_s, end_s) and voiced frames (t, f0, conf) in them."""
    voiced = frames.where(timing.voiced(F.col("f0"), F.col("conf"))).select("chart_id", "t", "f0")
    return meet(spans, voiced, (F.col("start_s"), F.col("end_s")), F.col("t"), width).where("start_s <= t AND t < end_s")


def median_pitch(spans: DataFrame, frames: DataFrame, key: str = "pos", width: float = 1.0) -> DataFrame:
    """spans with n_frames and midi, the median of the voiced frames in them (null if none)."""
    got = frames_in(spans.select("chart_id", key, "start_s", "end_s"), frames, width).groupBy("chart_id", key)
    got = got.agg(F.count(F.lit(1)).alias("n_frames"), timing.midi_of(F.percentile("f0", F.lit(0.5))).alias("midi"))
    return spans.join(got, ["chart_id", key], "left").withColumn("n_frames", F.coalesce("n_frames", F.lit(0)))


def snapped(spans: DataFrame, frames: DataFrame, key: str = "pos", width: float = 1.0) -> DataFrame:
    """spans cut to their voiced frames if there are three or more."""
    got = frames_in(spans.select("chart_id", key, "start_s", "end_s"), frames, width).groupBy("chart_id", key)
    got = got.agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).where("n >= 3")
    joined = spans.join(got, ["chart_id", key], "left")
    end = F.when(F.col("n").isNotNull(), F.greatest("hi", F.col("lo") + timing.FEWEST_S)).otherwise(F.col("end_s"))
    return joined.withColumns({"start_s": F.coalesce("lo", "start_s"), "end_s": end}).drop("n", "lo", "hi")


def nearest(left: DataFrame, right: DataFrame, tolerance: float = 0.3) -> DataFrame:
    """left (chart_id, pos, start_s) with distance to the nearest right onset, at most
    the tolerance (inclusive), else null. Right rows may serve many left ones."""
    points = right.select("chart_id", F.col("start_s").alias("other"))
    pairs = meet(left.select("chart_id", "pos", "start_s"), points, (F.col("start_s") - tolerance, F.col("start_s") + tolerance), F.col("other"), tolerance)
    gap = F.abs(F.col("other") - F.col("start_s"))
    best = pairs.where(gap <= tolerance).groupBy("chart_id", "pos").agg(F.min(gap).alias("distance"))
    return left.join(best, ["chart_id", "pos"], "left")


def overlapping(words: DataFrame, segments: DataFrame, width: float = 1.0) -> DataFrame:
    """Pairs of words [start_s, end_s) and segments (seg, s, e, speaker) that share
    time, with their overlap. Both sides are cut into bins; the pair counts in the
    bin where the later of the two begins."""
    a = words.select("chart_id", "pos", "start_s", "end_s")
    a = a.withColumn("bin", F.explode(F.sequence(_bin(F.col("start_s"), width), F.greatest(_bin(F.col("start_s"), width), _bin(F.col("end_s"), width)))))
    b = segments.withColumn("bin", F.explode(F.sequence(_bin(F.col("s"), width), F.greatest(_bin(F.col("s"), width), _bin(F.col("e"), width)))))
    pairs = a.join(b, ["chart_id", "bin"]).where(F.col("bin") == _bin(F.greatest("s", "start_s"), width)).drop("bin")
    return pairs.withColumn("overlap", timing.overlap(F.col("s"), F.col("e"), F.col("start_s"), F.col("end_s"))).where("overlap > 0")


def dominant_speaker(words: DataFrame, segments: DataFrame, width: float = 1.0) -> DataFrame:
    """words with the speaker of the segment that shares most time with them, the
    first such segment on ties; null if none does."""
    best = overlapping(words, segments, width).groupBy("chart_id", "pos").agg(F.max_by("speaker", F.struct("overlap", -F.col("seg"))).alias("speaker"))
    return words.join(best, ["chart_id", "pos"], "left")


def word_speaker(words: DataFrame, segments: DataFrame, width: float = 1.0) -> DataFrame:
    """The same, but a word that meets no segment takes the nearest one's speaker: the
    last that ended before it or the first that starts after it, the earlier segment
    (by seg) on ties. Those two are found by windows over the chart, as all ends and
    onsets in one order, not by comparing all pairs. Null without segments."""
    found = dominant_speaker(words, segments, width)
    lone = found.where(F.col("speaker").isNull()).select("chart_id", "pos", "start_s", "end_s")
    none = F.lit(None)
    ends = segments.select("chart_id", F.col("e").alias("t"), F.lit(0).alias("side"), "seg", "speaker", none.cast("int").alias("pos"))
    asks = lone.select("chart_id", F.col("start_s").alias("t"), F.lit(1).alias("side"), none.cast("int").alias("seg"), none.cast("string").alias("speaker"), "pos")
    # of segments that end together the first (least seg) must come last before a word
    w = Window.partitionBy("chart_id").orderBy("t", "side", F.desc("seg")).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.when(F.col("side") == 0, F.struct("t", "seg", "speaker"))
    before = ends.unionByName(asks).withColumn("hit", F.last(hit, True).over(w)).where("side = 1").select("chart_id", "pos", F.col("hit").alias("before"))
    starts = segments.select("chart_id", F.col("s").alias("t"), F.lit(1).alias("side"), "seg", "speaker", none.cast("int").alias("pos"))
    asks = lone.select("chart_id", F.col("end_s").alias("t"), F.lit(0).alias("side"), none.cast("int").alias("seg"), none.cast("string").alias("speaker"), "pos")
    w = Window.partitionBy("chart_id").orderBy("t", "side", "seg").rowsBetween(0, Window.unboundedFollowing)
    hit = F.when(F.col("side") == 1, F.struct("t", "seg", "speaker"))
    after = starts.unionByName(asks).withColumn("hit", F.first(hit, True).over(w)).where("side = 0").select("chart_id", "pos", F.col("hit").alias("after"))
    near = lone.join(before, ["chart_id", "pos"]).join(after, ["chart_id", "pos"])
    back, ahead = F.col("start_s") - F.col("before.t"), F.col("after.t") - F.col("end_s")
    first = F.when(ahead.isNull() | (back < ahead) | ((back == ahead) & (F.col("before.seg") < F.col("after.seg"))), F.col("before.speaker")).otherwise(F.col("after.speaker"))
    near = near.select("chart_id", "pos", first.alias("near"))
    return found.join(near, ["chart_id", "pos"], "left").withColumn("speaker", F.coalesce("speaker", "near")).drop("near")


def active_fraction(words: DataFrame, segments: DataFrame, width: float = 1.0) -> DataFrame:
    """words with every speaker's share of their span, as rows (speaker, fraction);
    segments that overlap each other count twice; words without any have no row."""
    pairs = overlapping(words, segments, width).groupBy("chart_id", "pos", "start_s", "end_s", "speaker").agg(F.sum("overlap").alias("covered"))
    return pairs.select("chart_id", "pos", "speaker", timing.ratio(F.col("covered"), F.col("end_s") - F.col("start_s")).alias("fraction"))


def singer_accuracy(same: DataFrame, other: DataFrame) -> DataFrame:
    """same and other: reference notes with the distance to the paired and to the
    other track (as nearest() gives it). By chart: attributed, accuracy."""
    both = same.select("chart_id", "pos", F.col("distance").alias("own")).join(other.select("chart_id", "pos", F.col("distance").alias("foreign")), ["chart_id", "pos"])
    both = both.where(F.col("own").isNotNull() | F.col("foreign").isNotNull())
    right = F.coalesce(F.col("own").isNotNull() & (F.col("foreign").isNull() | (F.col("own") <= F.col("foreign"))), F.lit(False))
    return both.groupBy("chart_id").agg(F.count(F.lit(1)).alias("attributed"), F.round(timing.ratio(F.count_if(right), F.count(F.lit(1))), 3).alias("accuracy"))
