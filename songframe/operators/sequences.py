"""Windows over the notes and words of a chart.

All take rows with chart_id and an order column, and share the window
(chart_id, order), so that Spark sorts a chart once for all of them. Charts are
dealt out by chart_id; a chart must fit into a task. An empty table gives an empty
result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from songframe.functions import timing
from songframe.functions.text import is_hold, stripped


def in_chart(*order: str, also: tuple[str, ...] = ()) -> WindowSpec:
    return Window.partitionBy("chart_id", *also).orderBy(*order)


def islands(rows: DataFrame, first: Column, name: str, order: str = "pos") -> DataFrame:
    """A running number that grows by one wherever `first` holds."""
    return rows.withColumn(name, F.sum(F.coalesce(first, F.lit(False)).cast("int")).over(in_chart(order).rowsBetween(Window.unboundedPreceding, 0)))


def with_lines(rows: DataFrame, gap: float = timing.SENTENCE_GAP_S, guard: float = timing.LINE_GAP_S, line: str | None = None) -> DataFrame:
    """line_no: a new line after a silence over `gap`; or, where rows carry the line
    of the lyric, when that changes or after a silence over `guard`. The silence is
    from the end of the word before, not from the latest end so far."""
    w = in_chart("pos")
    silence = F.col("start_s") - F.lag("end_s").over(w)
    first = silence > gap
    if line:
        first = (F.col(line) != F.lag(line).over(w)) | (silence > guard)
    flagged = rows.withColumn("new line", first)
    return islands(flagged, F.col("new line"), "line_no").drop("new line")


def intra_line_gaps(rows: DataFrame) -> DataFrame:
    """gap_ms to the next note of the line, not below zero; null for its last."""
    after = F.lead("start_s").over(in_chart("pos", also=("line_no",)))
    return rows.withColumn("gap_ms", F.greatest(F.lit(0.0), after - F.col("end_s")) * F.when(after.isNotNull(), 1000.0))


def pitch_steps(rows: DataFrame, pitch: str = "pitch") -> DataFrame:
    """step from the note before in the line; null for its first."""
    return rows.withColumn("step", F.abs(F.col(pitch) - F.lag(pitch).over(in_chart("pos", also=("line_no",)))))


def line_table(rows: DataFrame) -> DataFrame:
    """One row a line: n_notes, start_s and end_s of its first and last note, and the
    silence before it, not below zero."""
    out = rows.groupBy("chart_id", "line_no").agg(F.count(F.lit(1)).alias("n_notes"), F.min_by("start_s", "pos").alias("start_s"), F.max_by("end_s", "pos").alias("end_s"))
    before = F.lag("end_s").over(in_chart("line_no"))
    return out.withColumn("silence_s", F.when(before.isNotNull(), F.greatest(F.lit(0.0), F.col("start_s") - before)))


def filled(rows: DataFrame, column: str, default: float) -> DataFrame:
    """Nulls take the last known value before, else the first after, else the default."""
    w = in_chart("pos")
    before = F.last(column, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(column, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn(column, F.coalesce(before, after, F.lit(default)))


def carried(rows: DataFrame, column: str, default: int = 0) -> DataFrame:
    """Nulls take the last known value before, else the default."""
    return rows.withColumn(column, F.coalesce(F.last(column, True).over(in_chart("pos").rowsBetween(Window.unboundedPreceding, 0)), F.lit(default)))


def bracketed(words: DataFrame, word: str = "word") -> DataFrame:
    """adlib: the word is inside ( ) or holds a bracket. Depth never falls below
    zero: the running sum less its own running minimum, if that is negative."""
    w = Window.partitionBy("chart_id", "line_index").orderBy("word_index").rowsBetween(Window.unboundedPreceding, 0)
    opens, closes = (F.char_length(word) - F.char_length(F.translate(word, c, "")) for c in "()")
    rows = words.withColumn("s", F.sum(opens - closes).over(w))
    rows = rows.withColumn("depth", F.col("s") - F.least(F.lit(0), F.min("s").over(w)))
    before = F.lag("depth", 1, 0).over(Window.partitionBy("chart_id", "line_index").orderBy("word_index"))
    return rows.withColumn("adlib", (before > 0) | (opens > 0) | (closes > 0)).drop("s")


def reanchored(words: DataFrame, guard: float = timing.LINE_GAP_S) -> DataFrame:
    """start_s and end_s with early first words of a line pulled to just before the
    second, if that and the third agree on a later time. Only first words move and
    only second and third ones are asked, so all can be settled at once."""
    w = in_chart("pos")
    same = (F.lead("line_index", 1).over(w) == F.col("line_index")) & (F.lead("line_index", 2).over(w) == F.col("line_index"))
    head = ~F.coalesce(F.lag("line_index").over(w) == F.col("line_index"), F.lit(False))
    s1, e1, s2 = F.lead("start_s", 1).over(w), F.lead("end_s", 1).over(w), F.lead("start_s", 2).over(w)
    early = F.coalesce(same & head & (s1 - F.col("end_s") > guard) & (s2 - e1 <= guard), F.lit(False))
    end = s1 - 0.06
    start = F.greatest(F.lit(0.0), end - F.least(F.col("end_s") - F.col("start_s"), F.lit(1.0)))
    return words.withColumns({"early": early, "new_start": F.when(early, start).otherwise(F.col("start_s")), "new_end": F.when(early, end).otherwise(F.col("end_s"))}).drop("start_s", "end_s").withColumnsRenamed({"new_start": "start_s", "new_end": "end_s"})


def with_breaks(line_rows: DataFrame) -> DataFrame:
    """break_beat before each line from first_beat and end_beat; null for the first."""
    before = F.lag("end_beat").over(in_chart("line_no"))
    return line_rows.withColumn("break_beat", F.when(before.isNotNull(), F.least(before, F.col("first_beat") - 1)))


def spread(parts: DataFrame) -> DataFrame:
    """part_start and part_end of the parts of a word (chart_id, pos, part_index,
    part, start_s, end_s), in proportion to their characters, one at least."""
    w = Window.partitionBy("chart_id", "pos")
    weight = F.greatest(F.lit(1), F.char_length("part"))
    upto = F.sum(weight).over(w.orderBy("part_index").rowsBetween(Window.unboundedPreceding, 0))
    rows = parts.withColumns({"upto": upto, "weight": weight, "total": F.sum(weight).over(w)})
    span = F.col("end_s") - F.col("start_s")
    at = lambda n: F.col("start_s") + span * (n / F.col("total"))
    return rows.withColumns({"part_start": at(F.col("upto") - F.col("weight")), "part_end": at(F.col("upto"))}).drop("upto", "weight", "total")


def kept_words(words: DataFrame, most: int = 4) -> DataFrame:
    """words with matched and in_vocabulary (booleans): drops those before the first
    match, and runs of over `most` unmatched words of which less than half are in the
    vocabulary. run numbers the matches so far."""
    rows = islands(words, F.col("matched"), "run")
    runs = Window.partitionBy("chart_id", "run", "matched")
    n, known = F.count(F.lit(1)).over(runs), F.count_if(F.col("in_vocabulary")).over(runs)
    rows = rows.withColumn("keep", F.col("matched") | ((F.col("run") > 0) & ((n <= most) | (known >= 0.5 * n))))
    return rows.where("keep").drop("keep")


def wedged(words: DataFrame) -> DataFrame:
    """start_s and end_s of words without times: the first of a run spans from the
    last known end (or 0) to the next known start, the others follow it without
    length."""
    w = in_chart("pos")
    before = F.coalesce(F.last("end_s", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.first("start_s", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    end = F.greatest(F.coalesce(after, before), before)
    head = F.coalesce(F.lag("start_s").over(w).isNotNull(), F.lit(True)) | (F.row_number().over(w) == 1)
    known = F.col("start_s").isNotNull()
    return words.withColumns({
        "new_start": F.when(known, F.col("start_s")).when(head, before).otherwise(end),
        "new_end": F.when(known, F.col("end_s")).otherwise(end),
    }).drop("start_s", "end_s").withColumnsRenamed({"new_start": "start_s", "new_end": "end_s"})


def song_words(notes: DataFrame) -> DataFrame:
    """word_no of every note (chart_id, line_no, note_index, text): a word starts with
    a line's first syllable, after a trailing space, or on a leading one; ~ and empty
    notes hold the syllable before. syllable_no counts within the word. Holds before
    any word of a line have none."""
    w = Window.partitionBy("chart_id", "line_no").orderBy("note_index")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    hold = is_hold(F.col("text"))
    # an empty note leaves the state as it was
    trail = F.last(F.when(F.col("text") != "", F.col("text").rlike(r"(?U)\s$")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = notes.withColumns({"hold": hold, "trail": F.coalesce(trail, F.lit(False)), "first": F.count_if(~hold).over(upto) == 1})
    starts = ~F.col("hold") & (F.col("first") | F.col("trail") | F.col("text").rlike(r"(?U)^\s"))
    rows = rows.withColumn("in_line", F.sum(starts.cast("int")).over(upto)).where("in_line > 0")
    of_word = Window.partitionBy("chart_id", "line_no", "in_line").orderBy("note_index").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("syllable_no", F.sum((~F.col("hold")).cast("int")).over(of_word))
    return rows.withColumnRenamed("in_line", "word_no").drop("trail", "first")


def word_table(notes: DataFrame) -> DataFrame:
    """One row a word of song_words(): text, start_s, end_s, and its syllables."""
    sylls = notes.groupBy("chart_id", "line_no", "word_no", "syllable_no").agg(
        F.max(F.when(~F.col("hold"), stripped(F.col("text")))).alias("text"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")
    )
    parts = F.array_sort(F.collect_list(F.struct("syllable_no", "text", "start_s", "end_s")))
    return sylls.groupBy("chart_id", "line_no", "word_no").agg(parts.alias("syllables")).select(
        "chart_id", "line_no", "word_no",
        F.array_join(F.col("syllables.text"), "").alias("text"), F.array_min("syllables.start_s").alias("start_s"), F.array_max("syllables.end_s").alias("end_s"), "syllables",
    )
