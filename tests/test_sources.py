"""Archives of songs and sound files: what is written is what is read."""

import math
import os
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from songframe.sources import packed, sounds


@pytest.fixture(scope="module")
def songs(spark):
    packed.register(spark)
    rows = [(f"song {i:03}", name, bytes([i % 256]) * (i * 37 % 500)) for i in range(60) for name in ("song.txt", "cover.jpg", "señal/ä.txt")]
    return spark.createDataFrame(rows, "song string, name string, content binary"), rows


def read(spark, path):
    return sorted((r.song, r.name, bytes(r.content)) for r in spark.read.format("songs").load(path).collect())


def test_round_trip(spark, songs, tmp_path):
    frame, rows = songs
    path = str(tmp_path / "out")
    packed.by_song(frame.repartition(7)).write.format("songs").mode("append").save(path)
    assert read(spark, path) == sorted(rows)
    archives = [f for f in os.listdir(path) if f.endswith(".zip")]
    assert len(archives) == 60  # one a song
    with zipfile.ZipFile(f"{path}/{archives[0]}") as z:
        assert z.namelist() == ["cover.jpg", "señal/ä.txt", "song.txt"] and z.testzip() is None
    packed.by_song(frame.where("song = 'song 003'")).write.format("songs").mode("append").save(path)
    assert len(read(spark, path)) == 183
    packed.by_song(frame.where("song < 'song 002'")).write.format("songs").mode("overwrite").save(path)
    assert read(spark, path) == sorted(rows)[:6]


def test_a_failed_task_leaves_nothing(spark, songs, tmp_path):
    frame, rows = songs
    path = str(tmp_path / "out")
    packed.by_song(frame).write.format("songs").mode("append").save(path)
    before = read(spark, path)
    bad = frame.withColumn("content", F.when(F.col("song") == "song 059", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        packed.by_song(bad).write.format("songs").mode("overwrite").save(path)
    assert read(spark, path) == before == sorted(rows)
    assert sum(f.endswith(".zip") for f in os.listdir(path)) == 60
    with pytest.raises(Exception, match="must not be null"):
        frame.withColumn("song", F.lit(None).cast("string")).write.format("songs").mode("append").save(path)
    assert read(spark, path) == before


def test_nothing_written_is_nothing_read(spark, songs, tmp_path):
    path = str(tmp_path / "out")
    songs[0].limit(0).write.format("songs").mode("append").save(path)
    assert read(spark, path) == []


def wav(x, rate, code=1, bits=16, extensible=False, odd=False):
    """A file of samples (rows of channels), laid out by hand."""
    x = np.atleast_2d(np.asarray(x, float).T).T
    if (code, bits) == (1, 8):
        body = np.rint(x * 127 + 128).astype(np.uint8).tobytes()
    elif (code, bits) == (1, 24):
        body = b"".join(int(v).to_bytes(3, "little", signed=True) for v in np.rint(x * (2**23 - 1)).ravel())
    else:
        body = (np.rint(x * (2 ** (bits - 1) - 1)).astype(f"<i{bits // 8}") if code == 1 else x.astype(f"<f{bits // 8}")).tobytes()
    fmt = struct.pack("<HHIIHH", 0xFFFE if extensible else code, x.shape[1], rate, 0, x.shape[1] * bits // 8, bits)
    if extensible:
        fmt += struct.pack("<HHI", 22, bits, 0) + struct.pack("<H", code) + b"\0" * 14
    chunks = [(b"fmt ", fmt)] + [(b"LIST", b"odd")] * odd + [(b"data", body), (b"tail", b"xx")]
    out = b"".join(n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for n, b in chunks)
    return b"RIFF" + struct.pack("<I", 4 + len(out)) + b"WAVE" + out


def test_sounds_of_all_kinds(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.uniform(-0.9, 0.9, (1000, 2))
    kinds = {"a": (1, 8), "b": (1, 16), "c": (1, 24), "d": (1, 32), "e": (3, 32), "f": (3, 64)}
    for name, (code, bits) in kinds.items():
        (tmp_path / f"{name}.wav").write_bytes(wav(x, 8000, code, bits, extensible=name in "ce", odd=name in "bc"))
    whole = wav(x, 8000)
    broken = {"short": whole[:30], "text": b"hello" * 20, "nodata": whole[:36], "codec": wav(x, 8000)[:20] + b"\x11\0" + whole[22:], "norate": whole[:24] + b"\0" * 4 + whole[28:], "early": whole[:-1000]}
    for name, content in broken.items():
        (tmp_path / f"{name}.WAV").write_bytes(content)
    files = sounds.found(spark, f"file://{tmp_path}")
    of = lambda p: os.path.basename(p).split(".")[0]
    length = {of(r.path): r for r in sounds.lengths(files).collect()}
    assert all(length[k].seconds == 0.125 and length[k].rate == 8000 and length[k].channels == 2 for k in kinds)
    assert all(length[k].seconds == 0.0 for k in broken if k != "early") and 0.09 < length["early"].seconds < 0.125
    got = {}
    for r in sounds.samples(files, rate=8000, block=300).collect():
        got.setdefault(of(r.path), []).append((r.at, r.samples))
    assert set(got) == {*kinds, "early"}
    for name in kinds:
        parts = sorted(got[name])
        assert [at for at, _ in parts] == [0, 300, 600, 900]
        assert np.concatenate([s for _, s in parts]) == pytest.approx(x.mean(axis=1), abs=0.01 if name == "a" else 1e-4)
    assert sounds.lengths(files.limit(0)).count() == sounds.samples(files.limit(0)).count() == 0


@pytest.mark.parametrize("rate, wanted", [(44100, 16000), (8000, 16000), (22050, 44100), (16000, 8000), (48000, 16000)])
def test_resampled_tones(rate, wanted):
    """A tone below both rates is the same tone; one above the lower rate is gone. Stretches do not matter."""
    t = np.arange(rate) / rate
    low, high = np.sin(2 * np.pi * 440 * t), np.sin(2 * np.pi * (min(rate, wanted) / 2 * 1.3) * t)
    got = np.concatenate(list(sounds.resampled(iter([low]), rate, wanted)))
    assert len(got) == wanted
    want = np.sin(2 * np.pi * 440 * np.arange(wanted) / wanted)
    assert np.abs(got - want)[200:-200].max() < 0.01
    if wanted < rate:
        assert np.abs(np.concatenate(list(sounds.resampled(iter([high]), rate, wanted))))[200:-200].max() < 0.02
    pieces = np.split(low, [1, 7, 500, 501, 20000])
    assert np.concatenate(list(sounds.resampled(iter(pieces), rate, wanted))) == pytest.approx(got, abs=1e-9)
    for n in (0, 1, 2, 31):
        assert len(np.concatenate([np.zeros(0), *sounds.resampled(iter([low[:n]]), rate, wanted)])) == -(-n * wanted // rate)


@pytest.mark.parametrize("bits", [16, 32])
def test_files_of_samples(spark, tmp_path, bits):
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, 2500).astype(np.float32)
    rows = [(7, at, x[at : at + 1000].tolist()) for at in (2000, 0, 1000)] + [(8, 10, [0.5]), (9, 0, [])]
    sounds.write_sounds(spark.createDataFrame(rows, "chart_id long, at long, samples array<float>"), f"file://{tmp_path}/out", 8000, bits)
    got = {os.path.basename(r.path): r.samples for r in sounds.samples(sounds.found(spark, f"file://{tmp_path}/out"), 8000).collect()}
    assert set(got) == {"7.wav", "8.wav"} and sorted(os.listdir(tmp_path / "out")) == ["7.wav", "8.wav", "9.wav"]
    assert got["7.wav"] == pytest.approx(x.tolist(), abs=1e-4) and got["8.wav"] == pytest.approx([0.0] * 10 + [0.5], abs=1e-4)


@pytest.mark.parametrize("rate, wanted", [(2000, 3000), (8000, 8001), (3000, 2000)])
def test_resampled_equals_sums(rate, wanted):
    """Each new sample against the sum that it is, where weights repeat often and where they do not."""
    rng, cut = np.random.default_rng(3), min(1.0, wanted / rate)
    x, half = rng.normal(size=400), math.ceil(sounds.CROSSINGS / cut)
    want = []
    for k in range(-(-len(x) * wanted // rate)):
        away = k * rate / wanted - np.arange(len(x))
        want.append((x * cut * np.sinc(cut * away) * np.where(np.abs(away) < half, 0.5 + 0.5 * np.cos(np.pi * away / half), 0.0)).sum())
    for parts in ([x], np.split(x, [1, 150, 151])):
        assert np.concatenate(list(sounds.resampled(iter(parts), rate, wanted))) == pytest.approx(np.array(want), abs=1e-9)


def test_sounds_made_in_place(spark, sf_dir, tmp_path, monkeypatch):
    """The same files as of stored blocks, read in place as samples() has them; the query stores no samples."""
    from songframe.operators import storage, tempo
    from songframe.plans import registry, signals

    clicks = signals.event_clicks(spark, sf_dir)
    sounds.write_sounds(clicks, f"file://{tmp_path}/a", 2000, read=signals.clicks)
    rows = [(c, at, x.tolist()) for c in [r.chart_id for r in clicks.select("chart_id").distinct().collect()] for at, x in signals.clicks(clicks.where(f"chart_id = {c}").orderBy("at").toArrow())]
    sounds.write_sounds(spark.createDataFrame(rows, "chart_id long, at long, samples array<float>"), f"file://{tmp_path}/b", 2000)
    names = sorted(os.listdir(tmp_path / "a"))
    assert names == sorted(os.listdir(tmp_path / "b")) and all((tmp_path / "a" / n).read_bytes() == (tmp_path / "b" / n).read_bytes() for n in names)
    files, s = sounds.found(spark, f"file://{tmp_path}/a").selectExpr("cast(regexp_extract(path, '([0-9]+).wav$') as long) as chart_id", "path", "length"), tempo.Settings(rate=3000, hop=48, window=192)
    heard = sounds.samples(files, 3000, 8192).join(files.select("chart_id", "path"), "path").select("chart_id", "at", "samples")
    want = {r.chart_id: r for r in tempo.tempo(heard, s).collect()}
    got = tempo.tempo_in_place(files, sounds.reader(3000, 8192), s).collect()
    assert len(got) == len(want) == len(names)
    assert all(r.bpm == pytest.approx(want[r.chart_id].bpm) and r.n_beats == want[r.chart_id].n_beats for r in got)
    monkeypatch.setattr(storage, "kept", None)
    assert registry.QUERIES["sound_files"](spark, sf_dir).count() == len(names)
