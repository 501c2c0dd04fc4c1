"""Sound files: samples and lengths of RIFF recordings, and files of samples.

Files are listed by Spark, without their bytes, and opened where their rows are worked on,
by Arrow's file systems: lengths need the chunks' heads only, samples are read and resampled
a stretch at a time, so that a recording of any length fits. Whole numbers of 8, 16, 24 and
32 bits and floating point of 32 and 64 are read; channels are mixed to their mean.

A file that is no such recording, or ends within its head, has length 0 and no samples; one whose
samples end early has those that are there.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe.operators.sample_blocks import Blocks, Reader, by_chart, in_order, stored
from songframe.sources.packed import put, store_of

#: Codes of the format chunk.
WHOLE, FLOATING, EXTENSIBLE = 1, 3, 0xFFFE
#: Zero crossings of the sinc to either side, at the lower of two rates.
CROSSINGS = 16
#: Samples of a block, at the rate asked for.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Head:
    code: int
    channels: int
    rate: int
    bits: int
    start: int  #: of the samples in the file
    size: int  #: of the samples, in bytes

    @property
    def width(self) -> int:
        """Bytes of a sample of all channels."""
        return self.channels * self.bits // 8

    @property
    def seconds(self) -> float:
        return self.size // self.width / self.rate


def head_of(f: BinaryIO, length: int) -> Head | None:
    """What the chunks before the samples say; None if that makes no recording."""
    if f.read(4) != b"RIFF" or len(f.read(4)) < 4 or f.read(4) != b"WAVE":
        return None
    at, known = 12, None
    while at + 8 <= length:
        f.seek(at)
        name, size = struct.unpack("<4sI", f.read(8))
        if name == b"fmt " and size >= 16:
            body = f.read(min(size, 40))
            if len(body) < 16:
                return None
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if code == EXTENSIBLE and len(body) >= 26:
                code = struct.unpack("<H", body[24:26])[0]
            known = (code, channels, rate, bits)
        if name == b"data":
            if not known or not known[1] or not known[2] or (known[0], known[3]) not in READERS:
                return None
            return Head(*known, at + 8, min(size, length - at - 8))
        at += 8 + size + size % 2
    return None


def _three_bytes(x: bytes) -> np.ndarray:
    parts = np.frombuffer(x, np.uint8).reshape(-1, 3).astype(np.int32)
    return ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8) / 2.0**23


#: Samples from -1 to 1 of bytes, by code and bits.
READERS = {
    (WHOLE, 8): lambda x: (np.frombuffer(x, np.uint8) - 128.0) / 128,
    (WHOLE, 16): lambda x: np.frombuffer(x, "<i2") / 2.0**15,
    (WHOLE, 24): _three_bytes,
    (WHOLE, 32): lambda x: np.frombuffer(x, "<i4") / 2.0**31,
    (FLOATING, 32): lambda x: np.frombuffer(x, "<f4").astype(float),
    (FLOATING, 64): lambda x: np.frombuffer(x, "<f8").astype(float),
}


def mono(f: BinaryIO, head: Head, samples: int = 1 << 18) -> Iterator[np.ndarray]:
    """The mean of the channels, a stretch at a time."""
    f.seek(head.start)
    left = head.size // head.width
    while left > 0:
        got = f.read(min(left, samples) * head.width)
        got = got[: len(got) // head.width * head.width]
        if not got:
            return
        left -= len(got) // head.width
        x = READERS[head.code, head.bits](got)
        yield x.reshape(-1, head.channels).mean(axis=1) if head.channels > 1 else x


@lru_cache(8)
def _weights(up: int, cut: float, half: int) -> np.ndarray:
    """The weights of the old samples around a new one, by the parts of an old one that it is late."""
    away = np.arange(up)[:, None] / up - np.arange(-half, half + 1)
    return cut * np.sinc(cut * away) * np.where(np.abs(away) < half, 0.5 + 0.5 * np.cos(np.pi * away / half), 0.0)


def resampled(stretches: Iterator[np.ndarray], rate: int, wanted: int) -> Iterator[np.ndarray]:
    """The same sound at another rate: each new sample is the sum of the old ones around it,
    weighted by a sinc under a Hann window, at the lower of the two rates. What lies before the start and
    after the end is silence."""
    if rate == wanted:
        yield from stretches
        return
    common = math.gcd(rate, wanted)
    up, down = wanted // common, rate // common
    cut = min(1.0, wanted / rate)
    half = math.ceil(CROSSINGS / cut)
    around, weights = np.arange(-half, half + 1), _weights(up, cut, half)
    done, first, held, total = 0, -half, np.zeros(half), 0  # held[0] is old sample `first`

    def upto(last: int) -> np.ndarray:
        """New samples done.. whose old ones, up to first + len(held), are all there."""
        nonlocal done, first, held
        m = np.arange(done, max(done, last))
        whole, part = np.divmod(m * down, up)
        if 8 * up > len(m):
            out = (held[whole[:, None] + around - first] * weights[part]).sum(axis=1) if len(m) else np.zeros(0)
        else:  # every so many new samples have the same weights, and lie as far apart
            out, near = np.empty(len(m)), np.lib.stride_tricks.sliding_window_view(held, 2 * half + 1)
            for k in range(up):
                out[k::up] = np.einsum("ij,j->i", near[whole[k] - half - first :: down][: len(out[k::up])], weights[part[k]])
        done += len(m)
        keep = max(0, done * down // up - half - first)
        first, held = first + keep, held[keep:]
        return out

    for x in stretches:
        for i in range(0, len(x), 1 << 14):  # so that the weights of a step stay small
            total += len(x[i : i + (1 << 14)])
            held = np.concatenate((held, x[i : i + (1 << 14)]))
            yield upto(-(-(first + len(held) - half) * up // down))
    held = np.concatenate((held, np.zeros(2 * half + 2)))
    yield upto(-(-total * up // down))


def blocks(stretches: Iterator[np.ndarray], size: int) -> Iterator[np.ndarray]:
    held = np.zeros(0)
    for x in stretches:
        held = np.concatenate((held, x))
        while len(held) >= size:
            yield held[:size]
            held = held[size:]
    if len(held):
        yield held


def found(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the .wav files below a folder; Spark lists none that are empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[wW][aA][vV]").load(path)
    return files.select("path", "length")


def _opened(path: str):
    store, name = store_of(path)
    return store.open_input_file(name)


def lengths(files: DataFrame) -> DataFrame:
    """(path, seconds, rate, channels) of files (path, length), from their heads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, length in zip(batch["path"].to_pylist(), batch["length"].to_pylist(), strict=True):
                with _opened(path) as f:
                    head = head_of(f, length)
                rows.append((path, head.seconds, head.rate, head.channels) if head else (path, 0.0, None, None))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            types = (pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "seconds", "rate", "channels"])

    return files.select("path", "length").mapInArrow(run, "path string, seconds double, rate int, channels int")


def _blocks_of(path: str, length: int, rate: int, block: int) -> Blocks:
    """(at, samples) of a file, single precision as in tables."""
    with _opened(path) as f:
        head, at = head_of(f, length), 0
        for x in blocks(resampled(mono(f, head), head.rate, rate), block) if head else ():
            yield at, x.astype(np.float32)
            at += len(x)


def reader(rate: int = 16000, block: int = BLOCK) -> Reader:
    """What samples() gives, where it is worked on: a Reader of a chart's row (path, length)."""

    def read(rows: pa.Table) -> Blocks:
        for path, length in zip(rows["path"].to_pylist(), rows["length"].to_pylist(), strict=True):
            yield from _blocks_of(path, length, rate, block)

    return read


def samples(files: DataFrame, rate: int = 16000, block: int = BLOCK) -> DataFrame:
    """(path, at, samples) of files (path, length): blocks of the mixed sound at a rate, as the
    operators on samples take them; at counts samples from the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(batch["path"].to_pylist(), batch["length"].to_pylist(), strict=True):
                for at, x in _blocks_of(path, length, rate, block):
                    values = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([at], pa.int64()), values], ["path", "at", "samples"])

    return files.select("path", "length").mapInArrow(run, "path string, at long, samples array<float>")


def recording(x: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """A file of one channel of samples from -1 to 1, clipped, of 16 bits, or floating point of 32."""
    if bits == 16:
        body, code = np.clip(np.rint(x * 2.0**15), -(2**15), 2**15 - 1).astype("<i2").tobytes(), WHOLE
    elif bits == 32:
        body, code = x.astype("<f4").tobytes(), FLOATING
    else:
        raise ValueError("16 or 32 bits")
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, code, 1, rate, rate * bits // 8, bits // 8, bits)
    data = struct.pack("<4sI", b"data", len(body)) + body + b"\0" * (len(body) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + len(data), b"WAVE") + head + data


def write_sounds(rows: DataFrame, path: str, rate: int, bits: int = 16, read: Reader = stored) -> None:
    """A file <chart_id>.wav of the blocks (chart_id, at, samples) of each chart, or of those that `read`
    gives from its rows, which must fit into a task; what is missing between blocks is silence. Files
    get their names when they are whole."""
    store, folder = store_of(path)
    store.create_dir(folder, recursive=True)

    def write(x: pa.Table) -> pa.Table:
        parts = list(read(in_order(x)))
        whole = np.zeros(max((at + len(s) for at, s in parts), default=0))
        for at, s in parts:
            whole[at : at + len(s)] = s
        put(path, f"{x['chart_id'][0].as_py()}.wav", recording(whole, rate, bits))
        return pa.table({"n": pa.array([len(whole)], pa.int64())})

    own = rows.withColumn("at", F.col("at").cast("long"))
    charts = own.select("chart_id", "at", "samples").groupBy("chart_id") if read is stored else by_chart(own)
    done = charts.applyInArrow(write, "n long")
    done.agg(F.sum("n")).collect()
