"""Times, beats, pitches and intervals, as columns.

Beats are quarter steps of the tempo: one lasts 15 / bpm seconds. Null in, null
out, unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the chart style.
GRID_S = 0.0625
LINE_GAP_S, SENTENCE_GAP_S = 1.5, 0.6
MIN_NOTE_BEATS, JITTER_STEP, MAX_LINE_S = 2, 5, 6.0
HOLD_S, HOLD_PART_S = 0.5, 0.25
FEWEST_S = 0.08


def seconds_per_beat(bpm: Column) -> Column:
    return F.lit(15.0) / bpm


def beat_to_time(beat: Column, bpm: Column, gap_ms: Column) -> Column:
    return gap_ms / 1000.0 + beat * seconds_per_beat(bpm)


def time_to_beat(t: Column, t0: Column, bpm: Column) -> Column:
    """Nearest beat, ties to the even one, never below zero."""
    return F.greatest(F.lit(0), F.rint((t - t0) / seconds_per_beat(bpm)).cast("int"))


def gap_of(first_onset: Column) -> Column:
    """Milliseconds before the first onset, less a lead of 200."""
    return F.greatest(F.lit(0.0), first_onset * 1000.0 - 200.0)


def midi_of(hz: Column) -> Column:
    return 69 + 12 * F.log2(hz / 440.0)


def hz_of(midi: Column) -> Column:
    return 440.0 * F.pow(F.lit(2.0), (midi - 69) / 12.0)


def voiced(f0: Column, conf: Column) -> Column:
    return F.coalesce((conf > 0.5) & (f0 > 0), F.lit(False))


def overlap(s: Column, e: Column, t0: Column, t1: Column) -> Column:
    """Shared length of two intervals; negative is the gap between them."""
    return F.least(e, t1) - F.greatest(s, t0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, zero where b is zero or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def tempo_multiple(est: Column, file_bpm: Column) -> Column:
    """Nearest power of two of file_bpm / est; null unless both are above zero."""
    k = F.when((est > 0) & (file_bpm > 0), file_bpm / est)
    return F.pow(F.lit(2.0), F.rint(F.log2(k)))


def tempo_deviation(est: Column, file_bpm: Column, digits: int | None = 4) -> Column:
    dev = F.abs(file_bpm / est / tempo_multiple(est, file_bpm) - 1)
    return dev if digits is None else F.round(dev, digits)


def preview_start(duration: Column, t0: Column, bpm: Column) -> Column:
    """Thirty beats in, or a quarter of the song if that is sooner; null without duration."""
    return F.when(duration > 0, F.bround(F.least(duration * 0.25, F.greatest(F.lit(0.0), t0 + 30 * seconds_per_beat(bpm))), 2))


def few_words(n_words: Column, duration: Column) -> Column:
    """Over a minute long with under 15 words a minute."""
    return F.coalesce((duration > 60) & (n_words / (duration / 60) < 15), F.lit(False))
