"""Chart files: text to notes and headers, and back.

A file is one row (chart_id, text) and is taken apart within its row: up to its end
mark, at the first note, at track and line marks; nothing is shuffled. Malformed
note lines drop out, the last of repeated headers counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe.functions.arrow import decoded
from songframe.functions.text import number_of, number_text, stripped

#: The sign of each kind of note.
KINDS = {":": "normal", "*": "golden", "F": "freestyle", "R": "rap", "G": "rapgolden"}
#: Where a line of a file ends.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: Fixed value: a line that is a note.
NOTE = r"^.\s+(-?\d+)\s+(\d+)\s+(-?\d+)\s?(.*)$"
#: Header tags in the order in which they are written, and their columns.
HEADER_TAGS = (
    ("TITLE", "title"), ("ARTIST", "artist"), ("LANGUAGE", "language"), ("GENRE", "genre"), ("YEAR", "year"), ("CREATOR", "creator"), ("MP3", "audio"), ("AUDIO", "audio"),
    ("COVER", "cover"), ("BACKGROUND", "background"), ("VIDEO", "video"), ("P1", "p1"), ("P2", "p2"), ("BPM", "bpm"), ("GAP", "gap_ms"), ("PREVIEWSTART", "preview_start"),
)
ALWAYS = ("title", "artist", "creator", "audio", "bpm", "gap_ms")
NUMBERS = ("bpm", "gap_ms", "preview_start")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the .txt files below a folder, without licence and readme files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    return files.where(~name.rlike("license|readme")).select("path", decoded("content").alias("text"))


def _split(files: DataFrame) -> DataFrame:
    """(chart_id, head, body): what comes before and from the first note, line or track
    mark, up to the end mark; a line end stands before each line."""
    whole = F.concat(F.lit("\n"), F.regexp_replace("text", LINE_END, "\n"))
    halves = F.split(F.get(F.split(whole, "\nE", 2), F.lit(0)), r"(?=\n[:*FRG\-Pp])", 2)
    rows = files.select("chart_id", halves.alias("halves"))
    return rows.select("chart_id", F.get("halves", F.lit(0)).alias("head"), F.get("halves", F.lit(1)).alias("body"))


def headers(files: DataFrame) -> DataFrame:
    """One row a file: title, artist, bpm, gap_ms, audio and more; bpm is 0 without one,
    unreadable numbers are null."""
    lines = F.filter(F.split("head", "\n"), lambda x: x.rlike("^#[^:]*:"))
    entry = lambda x: F.struct(F.upper(stripped(F.regexp_extract(x, "^#([^:]*):", 1))).alias("tag"), stripped(F.regexp_extract(x, r"^#[^:]*:([\s\S]*)$", 1)).alias("value"))
    rows = _split(files).select("chart_id", F.coalesce(F.transform(lines, entry), F.array().cast("array<struct<tag:string,value:string>>")).alias("entries"))
    of = lambda t: F.try_element_at(F.filter("entries", lambda x: x["tag"] == t), F.lit(-1))["value"]
    full = lambda t: F.nullif(of(t), F.lit(""))
    return rows.select(
        "chart_id",
        F.coalesce(of("TITLE"), F.lit("")).alias("title"), F.coalesce(of("ARTIST"), F.lit("")).alias("artist"),
        F.when(of("BPM").isNull(), 0.0).otherwise(number_of(of("BPM"))).alias("bpm"), number_of(F.coalesce(of("GAP"), F.lit("0"))).alias("gap_ms"),
        F.coalesce(full("AUDIO"), full("MP3"), F.lit("")).alias("audio"), F.coalesce(full("DUETSINGERP1"), full("P1")).alias("p1"), F.coalesce(full("DUETSINGERP2"), full("P2")).alias("p2"),
        of("LANGUAGE").alias("language"), of("GENRE").alias("genre"), F.when(of("YEAR").rlike("^[0-9]+$"), of("YEAR").try_cast("int")).alias("year"), of("COVER").alias("cover"), of("VIDEO").alias("video"),
    )


def notes(files: DataFrame, keep_tracks: bool = False) -> DataFrame:
    """chart_id, track, line_no, note_index, break_beat, start_beat, duration, pitch,
    text, kind. Without keep_tracks duets are one track, and a track's first line
    joins the line before it; with it, notes before the first track of a duet go.

    A track mark starts a piece of the body, a line mark a group of the piece; notes before
    the first line mark, if there are any, are line 0."""
    sung = lambda g: F.filter(F.split(g, "\n"), lambda x: F.substring(x, 1, 1).isin(*KINDS) & x.rlike(NOTE))
    pieces = F.split("body", r"(?=\n[Pp])") if keep_tracks else F.array("body")
    rows = _split(files).where(F.col("body").isNotNull()).select("chart_id", F.posexplode(F.filter(pieces, lambda p: p != "")).alias("piece", "p"), F.col("body").rlike(r"^\n[Pp]").cast("int").alias("marked"), F.size(F.filter(pieces, lambda p: p != "")).alias("pieces"))
    if keep_tracks:
        mark = F.col("piece") + F.col("marked")
        rows = rows.withColumn("mark", mark).where("mark > 0 OR pieces + marked = 1")
    else:
        rows = rows.withColumn("mark", F.lit(0))
    rows = rows.select("chart_id", F.greatest(F.lit(0), F.col("mark") - 1).cast("int").alias("track"), F.filter(F.split("p", r"(?=\n-)"), lambda g: g != "").alias("groups"))
    first = F.get("groups", F.lit(0))
    opens = F.startswith(first, F.lit("\n-"))  # the first group has a mark too
    rows = rows.withColumns({"opens": opens.cast("int"), "early": ~opens & (F.size(sung(first)) > 0)})
    rows = rows.select("chart_id", "track", "early", "opens", F.posexplode("groups").alias("group", "g"))
    breaks = F.col("group") + F.col("opens")
    beat = F.when(breaks > 0, F.regexp_extract("g", r"^\n-\S*\s+(-?\d+)", 1).try_cast("int"))
    rows = rows.select("chart_id", "track", (breaks - F.when(F.col("early"), 0).otherwise(1)).cast("int").alias("line_no"), beat.alias("break_beat"), F.posexplode(sung(F.col("g"))).alias("note_index", "line"))
    part = lambda i: F.regexp_extract("line", NOTE, i)
    kind = F.element_at(F.create_map(*(F.lit(v) for p in KINDS.items() for v in p)), F.substring("line", 1, 1))
    return rows.select("chart_id", "track", "line_no", "note_index", "break_beat", part(1).try_cast("int").alias("start_beat"), part(2).try_cast("int").alias("duration"), part(3).try_cast("int").alias("pitch"), part(4).alias("text"), kind.alias("kind"))


def _header_lines(columns: list[str], duet: Column) -> Column:
    lines = []
    for tag, c in HEADER_TAGS:
        if c in ("p1", "p2"):
            value = F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(c.upper())) if c in columns else F.lit(c.upper())
            lines.append(F.when(duet, F.concat(F.lit(f"#{tag}:"), value)))
        elif c in columns:
            value = number_text(F.col(c).cast("double")) if c in NUMBERS else F.col(c).cast("string")
            line = F.concat(F.lit(f"#{tag}:"), F.coalesce(value, F.lit("")) if c in ALWAYS else value)
            lines.append(line if c in (*ALWAYS, "preview_start") else F.when(F.col(c).cast("string") != "", line))
    return F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n")


def rendered(charts: DataFrame, notes: DataFrame) -> DataFrame:
    """(chart_id, text): headers in fixed order, then tracks, lines and notes, then E.
    A chart with notes of track 1 is a duet; one without notes has its header only."""
    signs = F.create_map(*(F.lit(v) for p in KINDS.items() for v in (p[1], p[0])))
    line = F.concat_ws(" ", F.coalesce(F.try_element_at(signs, F.col("kind")), F.lit(":")), "start_beat", "duration", "pitch", "text")
    parts = notes.groupBy("chart_id", "track", "line_no").agg(F.max("break_beat").alias("break_beat"), F.array_sort(F.collect_list(F.struct("note_index", line.alias("s")))).alias("n"))
    text = F.concat_ws("\n", F.when(F.col("break_beat").isNotNull(), F.concat(F.lit("- "), F.col("break_beat"))), F.array_join("n.s", "\n"))
    tracks = parts.groupBy("chart_id", "track").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", text.alias("s"))))["s"], "\n").alias("s"))
    whole = tracks.groupBy("chart_id").agg(F.array_sort(F.collect_list(F.struct("track", "s"))).alias("tracks"))
    rows = charts.join(whole, "chart_id", "left")
    duet = F.coalesce(F.exists("tracks", lambda t: t["track"] > 0), F.lit(False))
    body = F.array_join(F.transform("tracks", lambda t: F.when(duet, F.concat(F.lit("P"), t["track"] + 1, F.lit("\n"), t["s"])).otherwise(t["s"])), "\n")
    return rows.select("chart_id", F.concat(F.concat_ws("\n", _header_lines(charts.columns, duet), body, F.lit("E")), F.lit("\n")).alias("text"))


def write_charts(files: DataFrame, path: str) -> None:
    """One folder a chart, with CRLF line ends."""
    rows = files.select("chart_id", F.regexp_replace("text", "\n", "\r\n").alias("value"))
    rows.select("chart_id", F.regexp_replace("value", "\r\n$", "").alias("value")).write.partitionBy("chart_id").option("lineSep", "\r\n").text(path)
