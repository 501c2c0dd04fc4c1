"""From timed words, voiced frames and speaker segments to charts.

The steps keep their order: snap, re-anchor, lead, lines, syllables, speakers, cuts,
pitches, holds, fill, offset, jitter, placement, majority, long lines, duet. All charts
go through as one job; every step is dealt out by chart_id. Charts without words
have no rows.

words: chart_id, pos, text, start_s, end_s; optionally line_index, adlib, char_spans
and norm. frames: chart_id, t, f0, conf. songs: chart_id, title, artist, audio,
duration. segments: chart_id, seg, s, e, speaker. speaker_frames: frames with speaker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from songframe.functions import timing
from songframe.functions.arrow import syllables_of
from songframe.functions.text import artists, letters_key, several_artists, stripped
from songframe.operators import intervals, metrics, recurrences, sequences
from songframe.operators.storage import kept as keep


def _defaults(words: DataFrame) -> DataFrame:
    kinds = {"line_index": "int", "adlib": "boolean", "char_spans": "array<struct<s:double,e:double>>", "norm": "string"}
    return words.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in words.columns})


def prepared(words: DataFrame, frames: DataFrame, drop_adlibs: bool = False) -> DataFrame:
    """Words that stay, renumbered, snapped to their voiced frames and re-anchored, with
    by_line (all words of the chart know their line) and timed (some know their
    letters' times)."""
    rows = _defaults(words).where(stripped(F.col("text")) != "")
    if drop_adlibs:
        rows = rows.where(~F.coalesce("adlib", F.lit(False)))
    whole = Window.partitionBy("chart_id")
    rows = rows.withColumns({
        "pos": F.row_number().over(sequences.in_chart("pos")).cast("int") - 1,
        "by_line": F.bool_and(F.col("line_index").isNotNull()).over(whole),
        "timed": F.bool_or(F.col("char_spans").isNotNull()).over(whole),
        "end_s": F.greatest("end_s", F.col("start_s") + timing.FEWEST_S),
    })
    rows = keep(intervals.snapped(rows, frames), "snapped")
    moved = sequences.reanchored(rows.where("by_line AND NOT timed"))
    fresh = intervals.snapped(moved.where("early").drop("early"), frames)
    rest = moved.where("NOT early").drop("early").unionByName(rows.where("NOT (by_line AND NOT timed)"))
    return rest.unionByName(fresh)


def left_empty(words: DataFrame, drop_adlibs: bool = False) -> DataFrame:
    """(chart_id, error) of charts that no word is left of: all are blank, or asides
    that are to be dropped. Such charts have no notes and are reported here."""
    stays = stripped(F.coalesce("text", F.lit(""))) != ""
    if drop_adlibs:
        stays &= ~F.coalesce("adlib", F.lit(False))
    out = words.groupBy("chart_id").agg(F.bool_or(stays).alias("some"))
    return out.where("NOT some").select("chart_id", F.lit("no words left").alias("error"))


def syllable_rows(words: DataFrame) -> DataFrame:
    """A row for each syllable: part_index, part, part_start, part_end and sid, its place
    in the chart; cut at the letters' times if known, else in proportion."""
    rows = words.withColumn("parts", syllables_of("text"))
    rows = recurrences.cut_at_letters(rows.withColumn("keys", F.transform("parts", letters_key))).drop("keys")
    rows = rows.select("*", F.posexplode("parts").alias("part_index", "part"))
    rows = sequences.spread(rows)
    cut = F.try_element_at("cuts", F.col("part_index") + 1)
    rows = rows.withColumns({"part_start": F.coalesce(cut["s"], "part_start"), "part_end": F.coalesce(cut["e"], "part_end")})
    return rows.withColumn("sid", F.row_number().over(sequences.in_chart("pos", "part_index")).cast("int") - 1).drop("parts", "cuts", "char_spans", "norm")


def pitched(sylls: DataFrame, frames: DataFrame, speaker_frames: DataFrame | None = None) -> DataFrame:
    """sylls with midi and n_frames, and in rows of their own the parts of long ones
    that hold several pitches (part from 0; ~ from the second on)."""
    spans = sylls.select("chart_id", "sid", "speaker", F.col("part_start").alias("start_s"), F.col("part_end").alias("end_s"))
    hits = intervals.frames_in(spans, frames).withColumn("own", F.lit(False))
    if speaker_frames is not None:
        voice = speaker_frames.where(timing.voiced(F.col("f0"), F.col("conf"))).select("chart_id", F.col("speaker").alias("voice"), "t", "f0")
        own = intervals.meet(spans, voice, (F.col("start_s"), F.col("end_s")), F.col("t"), 1.0).where("start_s <= t AND t < end_s AND speaker = voice")
        hits = hits.unionByName(own.drop("voice").withColumn("own", F.lit(True)))
        hits = hits.withColumn("any own", F.bool_or("own").over(Window.partitionBy("chart_id", "sid"))).where("own = `any own`").drop("any own")
    got = hits.groupBy("chart_id", "sid").agg(F.count(F.lit(1)).cast("int").alias("n_frames"), timing.midi_of(metrics.median("f0")).alias("midi"))
    rows = sylls.join(got, ["chart_id", "sid"], "left").withColumn("n_frames", F.coalesce("n_frames", F.lit(0)))
    long = hits.where(F.col("end_s") - F.col("start_s") >= timing.HOLD_S)
    parts = recurrences.held_parts(long, "sid").withColumnsRenamed({"part": "hold", "part_start": "hs", "part_end": "he", "midi": "hm"})
    rows = rows.join(parts, ["chart_id", "sid"], "left")
    return rows.withColumns({
        "part_start": F.coalesce("hs", "part_start"), "part_end": F.coalesce("he", "part_end"), "midi": F.coalesce("hm", "midi"), "hold": F.coalesce("hold", F.lit(0)),
    }).drop("hs", "he", "hm")


def note_rows(rows: DataFrame, bpm: float) -> DataFrame:
    """Notes from pitched syllables: pos, start_beat, duration, pitch, text, line_no,
    new_line, speaker."""
    whole = Window.partitionBy("chart_id")
    t0 = timing.gap_of(F.col("first")) / 1000.0
    rows = rows.withColumns({
        "note": F.row_number().over(sequences.in_chart("sid", "hold")).cast("int") - 1,
        "beat": timing.time_to_beat(F.col("part_start"), t0, F.lit(bpm)), "endbeat": timing.time_to_beat(F.col("part_end"), t0, F.lit(bpm)),
        "new_line": F.col("first_word") & (F.col("part_index") == 0) & (F.col("hold") == 0),
    })
    head = (F.col("part_index") == 0) & (F.col("pos") > 0) & ~F.col("first_word")
    text = F.when(F.col("hold") > 0, "~").otherwise(F.when(head, F.concat(F.lit(" "), "part")).otherwise(F.col("part")))
    rows = rows.withColumn("text", text).drop("pos").withColumnRenamed("note", "pos")
    rows = sequences.filled(rows, "midi", 60.0)
    rows = rows.withColumn("offset", F.rint(metrics.median("midi").over(whole)).cast("int") - 12)
    smooth = recurrences.without_jitter(rows)
    beats = recurrences.placed(rows)
    rows = rows.drop("midi").join(smooth, ["chart_id", "pos"]).join(beats, ["chart_id", "pos"])
    return rows.select("chart_id", "pos", "start_beat", "duration", (F.rint("midi").cast("int") - F.col("offset")).alias("pitch"), "text", "line_no", "speaker")


def assembled(
    words: DataFrame, frames: DataFrame, songs: DataFrame, segments: DataFrame | None = None, speaker_frames: DataFrame | None = None, *, grid: float = timing.GRID_S, sentence_gap: float = timing.SENTENCE_GAP_S,
    duet: str = "auto", unison: str = "both", drop_adlibs: bool = False, least_apart: float = 6.0, names: tuple[str | None, str | None] = (None, None),
) -> tuple[DataFrame, DataFrame]:
    """(charts, notes). Steps that later ones read more than once are kept as tables."""
    bpm = round(15.0 / grid, 2)
    spb = 15.0 / bpm
    rows = keep(prepared(words, frames, drop_adlibs), "prepared")
    w, whole = sequences.in_chart("pos"), Window.partitionBy("chart_id")
    silence = F.col("start_s") - F.lag("end_s").over(w)
    change = F.when(F.col("by_line"), F.col("line_index") != F.lag("line_index").over(w)).otherwise(silence > sentence_gap)
    rows = rows.withColumns({"first": F.min_by("start_s", "pos").over(whole), "first_word": F.coalesce(change | (silence > timing.LINE_GAP_S), F.lit(False))})
    rows = sequences.islands(rows, F.col("first_word"), "line_no")
    rows = keep(intervals.word_speaker(rows, segments) if segments is not None else rows.withColumn("speaker", F.lit(None).cast("string")), "speakers")
    sylls = keep(syllable_rows(rows), "syllables")
    notes = keep(note_rows(keep(pitched(sylls, frames, speaker_frames), "pitched"), bpm), "notes")
    speakers = metrics.majority(notes, ["chart_id", "line_no"], "speaker")
    parts = recurrences.short_lines(notes, bpm)
    notes = notes.drop("speaker").join(parts, ["chart_id", "pos"]).join(speakers, ["chart_id", "line_no"], "left")
    notes = keep(notes.withColumn("line_no", F.dense_rank().over(sequences.in_chart("line_no", "part")) - 1).drop("part"), "lines")

    first = rows.groupBy("chart_id").agg(F.round(timing.gap_of(F.min_by("start_s", "pos"))).alias("gap_ms"), (timing.gap_of(F.min_by("start_s", "pos")) / 1000).alias("t0"))
    charts = songs.join(first, "chart_id").withColumns({"bpm": F.lit(bpm), "creator": F.lit("songframe"), "preview_start": timing.preview_start(F.col("duration"), F.col("t0"), F.lit(bpm))})
    lines = notes.groupBy("chart_id", "line_no").agg(F.max("speaker").alias("speaker"), metrics.median("pitch").alias("register"), F.min("start_beat").alias("first_beat"), F.max_by(F.col("start_beat") + F.col("duration"), "pos").alias("end_beat"))
    # which charts may be duets, by performers named and by length
    wanted = F.lit(duet == "yes") | (F.lit(duet == "auto") & several_artists(F.col("artist")))
    long = lines.groupBy("chart_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 6").join(charts.where(wanted).select("chart_id"), "chart_id").select("chart_id")
    lines = keep(lines.join(long.withColumn("long", F.lit(True)), "chart_id", "left"), "line-table")
    asked = lines.where("long")
    none = asked.select("chart_id", "line_no", F.lit(0).alias("track"), F.lit(False).alias("both")).limit(0)
    labels = none
    if segments is not None:
        order = metrics.speaker_order(segments).where("rank < 2").groupBy("chart_id").pivot("rank", [0, 1]).agg(F.first("speaker")).withColumnsRenamed({"0": "lead", "1": "second"}).where("second IS NOT NULL")
        by_voice = asked.join(order, "chart_id").withColumn("track", F.coalesce(F.col("speaker") == F.col("second"), F.lit(False)).cast("int"))
        by_voice = by_voice.join(metrics.track_shares(by_voice).where("split").select("chart_id"), "chart_id", "left_semi")
        spans = by_voice.join(charts.select("chart_id", "t0"), "chart_id").select("chart_id", F.col("line_no").cast("int").alias("pos"), (F.col("t0") + F.col("first_beat") * spb).alias("start_s"), (F.col("t0") + F.col("end_beat") * spb).alias("end_s"), "lead", "second")
        active = intervals.active_fraction(spans, segments).where("fraction >= 0.4").join(spans.select("chart_id", "pos", "lead", "second"), ["chart_id", "pos"]).where("speaker IN (lead, second)")
        shared = active.groupBy("chart_id", F.col("pos").alias("line_no")).agg(F.count_distinct("speaker").alias("k")).where("k = 2")
        by_voice = by_voice.join(shared, ["chart_id", "line_no"], "left")
        labels = keep(by_voice.select("chart_id", "line_no", "track", (F.col("k").isNotNull() & F.lit(unison == "both")).alias("both")), "by-voice")
    by_pitch = recurrences.two_registers(asked.join(labels, "chart_id", "left_anti").withColumn("pos", F.col("line_no").cast("int")), "register")
    by_pitch = by_pitch.withColumn("share", F.avg("label").over(whole))
    by_pitch = by_pitch.where(F.lit(duet == "yes") | ((F.col("high") - F.col("low") >= least_apart) & F.col("share").between(0.15, 0.85)))
    labels = keep(labels.unionByName(by_pitch.select("chart_id", F.col("pos").alias("line_no"), F.col("label").alias("track"), F.lit(False).alias("both"))), "labels")
    duets = labels.select("chart_id").distinct().withColumn("duet", F.lit(True))
    track = F.explode(F.when(F.coalesce("both", F.lit(False)), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.coalesce("track", F.lit(0)))))
    lines = lines.join(labels, ["chart_id", "line_no"], "left").select("chart_id", "line_no", "first_beat", "end_beat", track.alias("track"))
    before = F.lag("end_beat").over(Window.partitionBy("chart_id", "track").orderBy("line_no"))
    lines = lines.withColumns({"break_beat": F.when(before.isNotNull(), F.least(before, F.col("first_beat") - 1)), "n": F.row_number().over(Window.partitionBy("chart_id", "track").orderBy("line_no")) - 1})
    index = F.row_number().over(Window.partitionBy("chart_id", "track", "n").orderBy("pos")) - 1
    notes = notes.join(lines.select("chart_id", "line_no", "track", "break_beat", "n"), ["chart_id", "line_no"]).withColumn("note_index", index)
    text = F.when(F.col("note_index") == 0, F.regexp_replace("text", r"(?U)^\s+", "")).otherwise(F.col("text"))
    notes = notes.select("chart_id", "track", F.col("n").alias("line_no"), "note_index", "break_beat", "start_beat", "duration", "pitch", text.alias("text"), F.lit("normal").alias("kind"))
    named = artists(F.col("artist"))
    singer = lambda i: F.when(F.col("duet"), F.coalesce(F.lit(names[i]), F.when(F.size(named) >= 2, named[i]).otherwise(f"Singer {i + 1}")))
    charts = charts.join(duets, "chart_id", "left").withColumn("duet", F.coalesce("duet", F.lit(False)))
    return charts.withColumns({"p1": singer(0), "p2": singer(1)}).drop("t0"), notes
