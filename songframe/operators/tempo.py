"""Tempo: how often a recording's onsets come back, and the path of beats that says it best.

A frame's onset strength is how much its spectrum, on a logarithmic scale, is louder than
that of the frame before, over all frequencies. The strengths of a chart are held against themselves some
frames later; the lag that fits best, weighted towards common tempos, is a first beat.
Then each frame is scored as the last of a row of beats: its own strength, and that of
the best frame about one beat before, less for distances that are not one beat. The
mean distance of the beats on the best row is the tempo.

Samples come in blocks (see sample_blocks) that many tasks work on; only the row of
beats, over one number a frame, takes a chart into one. Samples that are made in place take it
into one from the start, and nothing of them is stored or sent. A chart without onsets has no tempo
(null), as has one that is shorter than two of the slowest beats.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from songframe.operators.sample_blocks import Reader, arrays, by_chart, frames_of, in_order, stretches, with_heads


@dataclass(frozen=True)
class Settings:
    rate: int = 16000
    hop: int = 256
    window: int = 1024
    slow: float = 40.0
    fast: float = 240.0
    common: float = 120.0  #: beats a minute that need no evidence
    spread: float = 1.0  #: octaves from it that halve the weight, about
    tight: float = 100.0  #: cost of a distance by its squared logarithm to one beat

    @property
    def per_minute(self) -> float:
        """Frames."""
        return 60.0 * self.rate / self.hop


def rises(frames: np.ndarray) -> np.ndarray:
    """How much louder each frame but the first is than the one before."""
    loud = np.log1p(np.abs(np.fft.rfft(frames * np.hanning(frames.shape[1]), axis=1)))
    return np.maximum(np.diff(loud, axis=0), 0.0).mean(axis=1)


def strengths(at: int, own: np.ndarray, after: np.ndarray, s: Settings) -> tuple[int, np.ndarray]:
    """The first frame whose onset strength is found in a block, that of the frame before, and
    the strengths from there on."""
    first = -(-at // s.hop)
    far = frames_of(own, after, first * s.hop - at, s.hop, s.window + s.hop)
    last = far[-1:, s.hop :] if len(after) else far[:0, s.hop :]
    return first + 1, rises(np.concatenate((far[:, : s.window], last)))


def onsets(samples: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(chart_id, frame, strength) of all frames that have one before."""
    names = ["chart_id", "frame", "strength"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chart, at, own, after in arrays(batch):
                first, found = strengths(at, own, after, s)
                yield pa.RecordBatch.from_arrays([pa.array([chart] * len(found), pa.int64()), pa.array(first + np.arange(len(found)), pa.int64()), pa.array(found, pa.float64())], names)

    return with_heads(samples, s.window + s.hop).mapInArrow(run, "chart_id long, frame long, strength double")


def first_beat(strength: np.ndarray, s: Settings) -> float | None:
    """Frames of a beat by the strengths' likeness to themselves a beat later."""
    shortest, longest = max(1, math.floor(s.per_minute / s.fast)), math.ceil(s.per_minute / s.slow)
    x = strength - strength.mean() if len(strength) else strength
    if len(x) <= 2 * longest or not np.any(np.abs(x) > 1e-12):
        return None
    size = 1 << (2 * len(x) - 1).bit_length()
    like = np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2, size)[: longest + 2]
    lags = np.arange(shortest, longest + 1)
    weight = np.exp(-0.5 * (np.log2(s.per_minute / lags / s.common) / s.spread) ** 2)
    return float(lags[np.argmax(like[lags] * weight)])


def beats(strength: np.ndarray, beat: float, s: Settings) -> np.ndarray:
    """Frames of the best row of beats. Distances are from half a beat to two; of equal rows, the
    one whose beats are closer together."""
    x = strength / (strength.std() or 1.0)
    gaps = np.arange(max(1, round(beat / 2)), max(2, round(2 * beat)) + 1)
    cost = s.tight * np.log(gaps / beat) ** 2
    # rows that end up to gaps[-1] frames before a frame, the closest last; before the first frame are none
    far = gaps[-1]
    padded, before = np.concatenate((np.full(far, -np.inf), np.zeros(len(x)))), np.full(len(x), -1)
    score = padded[far:]
    ends = np.lib.stride_tricks.sliding_window_view(padded, len(gaps))
    for at in range(0, len(x), gaps[0]):  # so many frames do not see each other
        own = np.arange(at, min(at + gaps[0], len(x)))
        ways = ends[own, ::-1] - cost
        k = ways.argmax(axis=1)
        best = ways[own - at, k]
        before[own] = np.where(best > 0.0, own - gaps[k], -1)
        score[own] = x[own] + np.maximum(best, 0.0)
    row, at = [], int(score.argmax()) if len(x) else -1
    while at >= 0:
        row.append(at)
        at = int(before[at])
    return np.array(row[::-1])


def of_strengths(first: int, strength: np.ndarray, s: Settings) -> tuple[float | None, int, float | None]:
    """(bpm, n_beats, first_s) of a chart whose strengths start at a frame."""
    beat, row = first_beat(strength, s), np.zeros(0)
    if beat:
        row = beats(strength, beat, s)
    if len(row) < 2:
        return None, 0, None
    return s.per_minute * (len(row) - 1) / (row[-1] - row[0]), len(row), (first + row[0]) * s.hop / s.rate


def tempo(samples: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(chart_id, bpm, n_beats, first_s): beats a minute, beats on the row and when it starts."""

    def fold(x: pd.DataFrame) -> pd.DataFrame:
        first = x["frame"].min()
        strength = np.zeros(x["frame"].max() - first + 1)
        strength[x["frame"] - first] = x["strength"]
        bpm, n, start = of_strengths(first, strength, s)
        return pd.DataFrame({"chart_id": x["chart_id"].iloc[:1], "bpm": pd.array([bpm], "Float64"), "n_beats": n, "first_s": pd.array([start], "Float64")})

    return onsets(samples, s).groupBy("chart_id").applyInPandas(fold, "chart_id long, bpm double, n_beats long, first_s double")


def tempo_in_place(rows: DataFrame, read: Reader, s: Settings = Settings()) -> DataFrame:
    """tempo(), and n_samples, of the samples that `read` gives from rows (chart_id, ...)."""
    types = [pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64()]

    def fold(x: pa.Table) -> pa.Table:
        n, parts = 0, []

        def counted():
            nonlocal n
            for at, block in read(in_order(x)):
                n += len(block)
                yield at, block

        for at, own, after in stretches(counted(), s.window + s.hop):
            parts.append(strengths(at, own, after, s))
        parts = [(at, found) for at, found in parts if len(found)]
        rows = []
        if parts:
            first = parts[0][0]
            strength = np.zeros(parts[-1][0] + len(parts[-1][1]) - first)
            for at, found in parts:
                strength[at - first : at - first + len(found)] = found
            rows.append((x["chart_id"][0].as_py(), *of_strengths(first, strength, s), n))
        names = ["chart_id", "bpm", "n_beats", "first_s", "n_samples"]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return by_chart(rows).applyInArrow(fold, "chart_id long, bpm double, n_beats long, first_s double, n_samples long")
