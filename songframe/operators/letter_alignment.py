"""Forced alignment: when each letter of the lyric is sung.

Frames carry a score for a pause and for each letter, as log posteriors of an acoustic
model. The letters of a chart's words in a row, with a pause that may stand before,
between and after them, are the states of a trellis. A frame stays in its state, goes on
to the next, or passes over a pause between two letters that differ. One best path runs
over the whole chart: a letter lasts as long as the path stays in it.

Of paths with equal scores the one is taken that, looking back from the end, stays where
it can, else goes back by one state, else by two; it ends in the pause if that is as
good as the last letter.

The trellis is a chart's, so a chart must fit into a task; its memory grows with the
square root of the frames (scores of the states are kept now and then, and the steps
between are computed again on the way back). Charts with fewer frames than the letters
need, without letters or without frames have no rows. Scores that are null or not a
number are those of letters that are not there.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songframe.functions.text import letters_key
from songframe.operators import intervals, metrics
from songframe.operators.sequences import wedged

#: What the scores of a frame are of: a pause, then these.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SPAN = "array<struct<s:double,e:double>>"


class Trellis:
    """States 0, 2, ... are pauses, 1, 3, ... the letters."""

    def __init__(self, scores: np.ndarray, letters: np.ndarray):
        self.scores = scores
        self.symbols = np.zeros(2 * len(letters) + 1, np.int64)
        self.symbols[1::2] = letters
        self.passes = np.zeros(len(self.symbols), bool)
        self.passes[3::2] = letters[1:] != letters[:-1]

    def start(self) -> np.ndarray:
        best = np.full(len(self.symbols), -np.inf)
        best[:2] = self.scores[0][self.symbols[:2]]
        return best

    def step(self, best: np.ndarray, frame: int) -> tuple[np.ndarray, np.ndarray]:
        """Best scores at a frame from those at the frame before, and by how many states
        each came forward."""
        back = np.zeros(len(best), np.int8)
        one = np.concatenate(([-np.inf], best[:-1]))
        back[one > best] = 1
        best = np.maximum(best, one)
        two = np.where(self.passes, np.concatenate(([-np.inf, -np.inf], one[1:-1])), -np.inf)
        back[two > best] = 2
        return np.maximum(best, two) + self.scores[frame][self.symbols], back

    def path(self) -> np.ndarray | None:
        """The state of every frame."""
        n = len(self.scores)
        every = math.isqrt(n) + 1
        best, kept = self.start(), []
        for frame in range(n):
            if frame:
                best = self.step(best, frame)[0]
            if frame % every == 0:
                kept.append(best)
        at = len(best) - (2 if best[-2] > best[-1] else 1)
        if best[at] == -np.inf:
            return None
        states = np.empty(n, np.int64)
        after = n
        for first in range((n - 1) // every * every, -1, -every):
            best, steps = kept[first // every], []
            for frame in range(first + 1, min(after + 1, n)):  # up to the step into the block behind
                best, back = self.step(best, frame)
                steps.append(back)
            if after < n:
                at -= int(steps.pop()[at])
            for frame in range(after - 1, first, -1):
                states[frame] = at
                at -= int(steps[frame - first - 1][at])
            states[first], after = at, first
        return states


def letter_times(scores: np.ndarray, letters: np.ndarray) -> list[tuple[int, int, float]] | None:
    """(first frame, frame after the last, mean posterior) of every letter."""
    if not len(letters) or not len(scores):
        return None
    scores = np.where(np.isnan(scores), -np.inf, scores)
    states = Trellis(scores, letters).path()
    if states is None:
        return None
    numbers = np.arange(len(letters)) * 2 + 1
    first, last = np.searchsorted(states, numbers), np.searchsorted(states, numbers, "right")
    return [(int(a), int(b), float(np.exp(scores[a:b, k]).mean())) for a, b, k in zip(first, last, letters, strict=True)]


def aligned_letters(frames: DataFrame, words: DataFrame, hop_s: float, letters: str = LETTERS) -> DataFrame:
    """(chart_id, pos, start_s, end_s, score, norm, char_spans) of the words (chart_id, pos,
    norm) that have letters. frames: (chart_id, frame, scores), each lasting hop_s; frames
    that are missing take no time of a letter. score: mean posterior over the frames of the letters."""
    number = {c: i + 1 for i, c in enumerate(letters)}

    def fold(f: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(f) and len(w):
            f, w = f.sort_values("frame"), w.sort_values("pos")
            at, scores = f["frame"].to_numpy(), np.array([np.asarray(x, float) for x in f["scores"]])
            found = letter_times(scores, np.array([number[c] for norm in w["norm"] for c in norm], np.int64))
            if found:
                rest = iter(found)
                for pos, norm in zip(w["pos"], w["norm"], strict=True):
                    own = [next(rest) for _ in norm]
                    spans = [{"s": at[a] * hop_s, "e": (at[b - 1] + 1) * hop_s} for a, b, _ in own]
                    score = sum(p * (b - a) for a, b, p in own) / sum(b - a for a, b, _ in own)
                    rows.append((w["of"].iloc[0], pos, spans[0]["s"], spans[-1]["e"], score, norm, spans))
        return pd.DataFrame(rows, columns=["chart_id", "pos", "start_s", "end_s", "score", "norm", "char_spans"])

    sung = words.where("norm <> ''").select(F.col("chart_id").alias("of"), "pos", "norm")
    pairs = frames.where("scores is not null").select("chart_id", "frame", "scores").groupBy("chart_id").cogroup(sung.groupBy("of"))
    return pairs.applyInPandas(fold, f"chart_id long, pos int, start_s double, end_s double, score double, norm string, char_spans {SPAN}")


def aligned_words(frames: DataFrame, words: DataFrame, hop_s: float, letters: str = LETTERS, least: float = 0.8) -> DataFrame:
    """words (chart_id, pos, word and more) with start_s, end_s, score, norm and char_spans,
    of the charts whose lyric can be written with the letters for the most part and was
    aligned. Words without letters are wedged between their neighbours, with score 0."""
    norm = F.regexp_replace(letters_key(F.col("word")), f"[^{letters}]", "")
    words = words.withColumn("norm", norm)
    fit = metrics.romanizable(words, F.col("norm"), least).where("passes").select("chart_id")
    words = words.join(fit, "chart_id", "left_semi")
    found = aligned_letters(frames, words, hop_s, letters)
    charts = found.select("chart_id").distinct()
    rows = words.join(charts, "chart_id", "left_semi").join(found.drop("norm"), ["chart_id", "pos"], "left")
    return wedged(rows).withColumns({"score": F.coalesce("score", F.lit(0.0)), "char_spans": F.coalesce("char_spans", F.array().cast(SPAN))})


def song_scores(words: DataFrame) -> DataFrame:
    """(chart_id, score): mean score of a chart's words that have one."""
    return words.where("score > 0").groupBy("chart_id").agg(F.avg("score").alias("score"))


def trusted(words: DataFrame, frames: DataFrame, least_score: float = 0.15, coverage: float = 0.85, margin: float = 0.05) -> DataFrame:
    """(chart_id, score, n, hit, passes): whether an alignment can be believed: its mean score,
    and how many of its words with a score meet a voiced frame (t, f0, conf)."""
    own = words.where("score > 0").select("chart_id", "pos", (F.col("start_s") - margin).alias("start_s"), (F.col("end_s") + margin).alias("end_s"))
    hits = intervals.frames_in(own, frames).select("chart_id", "pos").distinct().withColumn("hit", F.lit(1))
    counts = own.join(hits, ["chart_id", "pos"], "left").groupBy("chart_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hit"))
    return song_scores(words).join(counts, "chart_id").withColumn("passes", (F.col("score") >= least_score) & (F.col("hit") >= coverage * F.col("n")))
