"""Pitch of a voice: the lag at which its samples are most like themselves.

A frame's samples are held against those some lags later: the sum of squared differences
by lag, from Fourier transforms of all frames of a block at once, over its mean at the
shorter lags. Dips of that curve are candidates, with a depth and, by a parabola through three lags, a
frequency. One best path through the candidates of a chart's frames then chooses: a
candidate costs its dip, and more the further it is below the highest of those about as
deep (a lag's multiples are as deep as itself); no pitch costs a constant; so does each
change between pitch and none; leaps cost by their octaves.

Samples come in blocks (see sample_blocks) that many tasks work on; only the path, over
a few numbers a frame, takes a chart into one. Samples that are made in place take it into
one from the start, and nothing of them is stored or sent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from songframe.operators.sample_blocks import Blocks, Reader, arrays, by_chart, frames_of, in_order, stretches, with_heads


@dataclass(frozen=True)
class Settings:
    rate: int = 16000
    hop: int = 256
    window: int = 1024
    low: float = 65.0
    high: float = 1000.0
    most: int = 5  #: candidates of a frame
    shallow: float = 0.6  #: dips above are none
    alike: float = 0.15  #: dips within this of the deepest are about as deep
    below: float = 0.2  #: cost of an octave below the highest of these
    none: float = 0.45  #: cost of no pitch
    turn: float = 0.05  #: cost of a change between pitch and none
    leap: float = 0.1  #: cost of an octave between frames, up to two

    @property
    def shortest(self) -> int:
        return max(2, math.floor(self.rate / self.high))

    @property
    def longest(self) -> int:
        return math.ceil(self.rate / self.low) + 1

    @property
    def reach(self) -> int:
        """Samples that a frame looks at."""
        return self.window + self.longest


def _even(n: int) -> int:
    """The least number from n on that 2, 3 and 5 make, which transforms are fast for."""
    while True:
        rest = n
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1


def differences(frames: np.ndarray, window: int) -> np.ndarray:
    """By frame (a row of window + lags samples) and lag 0..lags: the sum over the window of
    squared differences to the samples a lag later, over the mean of these sums at lags up to it; 1 at
    lag 0 and in silence."""
    lags = frames.shape[1] - window
    size = _even(frames.shape[1])  # a window and its lags end with the frame, so nothing comes round
    head = np.fft.rfft(frames[:, :window], size)
    like = np.fft.irfft(np.fft.rfft(frames, size) * head.conj(), size)[:, : lags + 1]
    power = np.concatenate((np.zeros((len(frames), 1)), np.cumsum(frames**2, axis=1)), axis=1)
    own = power[:, window : window + lags + 1] - power[:, : lags + 1]
    sums = np.maximum(own[:, :1] + own - 2 * like, 0.0)
    sums[:, 0] = 0.0
    so_far = np.cumsum(sums, axis=1)
    silent = so_far <= 1e-9 * np.maximum(own[:, :1], 1e-12) * np.arange(1, lags + 2)
    out = np.where(silent, 1.0, sums * np.arange(lags + 1) / np.where(silent, 1.0, so_far))
    out[:, 0] = 1.0
    return out


def dips(curves: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(frequency, depth) of up to `most` dips of each curve, those first that are deep for
    their octave; nan where there are fewer."""
    mid, left, right = curves[:, s.shortest : s.longest], curves[:, s.shortest - 1 : s.longest - 1], curves[:, s.shortest + 1 : s.longest + 1]
    at = (mid < left) & (mid <= right) & (mid < s.shallow)
    bend = left[at] - 2 * mid[at] + right[at]
    shift, depth = np.zeros(at.shape), np.full(at.shape, np.inf)
    shift[at] = np.where(bend > 0, 0.5 * (left[at] - right[at]) / np.where(bend > 0, bend, 1.0), 0.0)
    depth[at] = np.maximum(mid[at] - 0.25 * (left[at] - right[at]) * shift[at], 0.0)
    lags = np.arange(s.shortest, s.longest)
    first = np.argsort(depth + s.below * np.log2(lags), axis=1, kind="stable")[:, : s.most]
    depth = np.take_along_axis(depth, first, 1)
    f0 = s.rate / (lags[first] + np.take_along_axis(shift, first, 1))
    f0 = np.where(np.isinf(depth), np.nan, f0)
    return f0, np.where(np.isinf(depth), np.nan, depth)


def heard(frames: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """dips() of frames (rows of samples); those that stay at one value have none."""
    f0, depth = (np.full((len(frames), s.most), np.nan) for _ in range(2))
    loud = (frames != frames[:, :1]).any(axis=1)
    if loud.any():
        found = dips(differences(frames[loud], s.window), s)
        for x, own in zip((f0, depth), found, strict=True):
            x[loud, : own.shape[1]] = own
    return f0, depth


def candidates(samples: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(chart_id, frame, f0, depth): frequencies and depths of the dips of every frame."""
    names = ["chart_id", "frame", "f0", "depth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chart, at, own, after in arrays(batch):
                first = -(-at // s.hop)
                f0, depth = heard(frames_of(own, after, first * s.hop - at, s.hop, s.reach), s)
                found = ~np.isnan(f0)
                ends = pa.array(np.concatenate(([0], np.cumsum(found.sum(axis=1)))), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[found], pa.float64())) for x in (f0, depth)]
                yield pa.RecordBatch.from_arrays([pa.array([chart] * len(f0), pa.int64()), pa.array(first + np.arange(len(f0)), pa.int64()), *lists], names)

    return with_heads(samples, s.reach).mapInArrow(run, "chart_id long, frame long, f0 array<double>, depth array<double>")


def best_path(f0: np.ndarray, depth: np.ndarray, s: Settings) -> np.ndarray:
    """The candidate of each frame, or -1; rows of frames, nan where a frame has fewer. Of
    equal paths, the one with the lower numbers from the end on."""
    n, most = f0.shape
    if not n:
        return np.zeros(0, np.int64)
    real = ~np.isnan(f0)
    octaves = np.log2(np.where(real, f0, 1.0))
    near = real & (depth <= np.nanmin(np.where(real, depth, np.inf), axis=1, keepdims=True, initial=np.inf) + s.alike)
    highest = np.where(near, octaves, -np.inf).max(axis=1, keepdims=True, initial=-np.inf)
    own = np.full((n, most + 1), np.inf)
    own[:, 0] = s.none
    own[:, 1:] = np.where(real, np.where(real, depth, 0.0) + s.below * np.maximum(0.0, np.where(real, highest - octaves, 0.0)), np.inf)
    best, back = own[0], np.zeros((n, most + 1), np.intp)
    for at in range(1, n, 4096):  # so that the moves stay small
        to = octaves[at : at + 4096]
        move = np.zeros((len(to), most + 1, most + 1))  # by frame, candidate and the candidate before
        move[:, 0, 1:] = move[:, 1:, 0] = s.turn
        move[:, 1:, 1:] = s.leap * np.minimum(np.abs(to[:, :, None] - octaves[at - 1 : at - 1 + len(to), None, :]), 2.0)
        for i, ways in enumerate(move, at):
            ways += best
            ways.argmin(axis=1, out=back[i])
            best = np.minimum.reduce(ways, axis=1) + own[i]
    out = np.empty(n, np.int64)
    at, steps = int(best.argmin()), back.tolist()
    for i in range(n - 1, -1, -1):
        out[i], at = at - 1, steps[i][at]
    return out


def sung(frames: np.ndarray, f0: np.ndarray, depth: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(t, f0, conf) of a chart's frames in order, by the best path."""
    path = best_path(f0, depth, s)
    rows, known = np.arange(len(frames)), path >= 0
    return frames * (s.hop / s.rate), np.where(known, f0[rows, path], 0.0), np.where(known, 1.0 - depth[rows, path], 0.0)


def tracked(found: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(chart_id, frame, t, f0, conf) from candidates(): f0 and conf are 0 without pitch; conf
    is what the dip leaves of 1."""

    def fold(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("frame")
        f0, depth = (np.full((len(x), s.most), np.nan) for _ in range(2))
        for i, (f, d) in enumerate(zip(x["f0"], x["depth"], strict=True)):
            f0[i, : len(f)], depth[i, : len(d)] = f, d
        t, f0, conf = sung(x["frame"].to_numpy(), f0, depth, s)
        return x[["chart_id", "frame"]].assign(t=t, f0=f0, conf=conf)

    return found.groupBy("chart_id").applyInPandas(fold, "chart_id long, frame long, t double, f0 double, conf double")


def pitch_track(samples: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(chart_id, frame, t, f0, conf) of every hop of (chart_id, at, samples)."""
    return tracked(candidates(samples, s), s)


def chart_frames(blocks: Blocks, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frame, f0, depth) of all frames of a chart's blocks in order, as candidates() has them."""
    parts = [(np.zeros(0, np.int64), np.zeros((0, s.most)), np.zeros((0, s.most)))]
    for at, own, after in stretches(blocks, s.reach):
        first = -(-at // s.hop)
        f0, depth = heard(frames_of(own, after, first * s.hop - at, s.hop, s.reach), s)
        parts.append((first + np.arange(len(f0)), f0, depth))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def pitch_track_in_place(rows: DataFrame, read: Reader, s: Settings = Settings(), keep: str | None = None) -> DataFrame:
    """pitch_track() of the samples that `read` gives from rows (chart_id, ...); rows that are blocks
    have `at`, and each frame the value that `keep` has for the block that it starts in."""

    def fold(x: pa.Table) -> pa.Table:
        x = in_order(x)
        frame, f0, depth = chart_frames(read(x), s)
        t, f0, conf = sung(frame, f0, depth, s)
        out = {"chart_id": pa.array([x["chart_id"][0].as_py()] * len(frame), pa.int64()), "frame": frame, "t": t, "f0": f0, "conf": conf}
        if keep:
            out[keep] = x[keep].take(pa.array(np.searchsorted(x["at"].to_numpy(), frame * s.hop, "right") - 1))
        return pa.table(out)

    also = f", {keep} {rows.schema[keep].dataType.simpleString()}" if keep else ""
    return by_chart(rows).applyInArrow(fold, "chart_id long, frame long, t double, f0 double, conf double" + also)
