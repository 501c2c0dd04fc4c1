"""Letters, pitches, beats and speakers from what models would hear, against enumeration
and against the tones, clicks and groups they were made from."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from songframe.operators import letter_alignment as letters
from songframe.operators import note_events, pitch_track, sample_blocks, speakers, tempo


def every_path(scores, own):
    """The best of all paths; of equals the one that is latest, looking back from the end."""
    states = 2 * len(own) + 1
    symbols = [0] * states
    symbols[1::2] = own
    best = None
    for path in itertools.product(range(states), repeat=len(scores)):
        if path[0] > 1 or path[-1] < states - 2:
            continue
        if all(b - a in (0, 1) or (b - a == 2 and b % 2 and symbols[a] != symbols[b]) for a, b in zip(path, path[1:])):
            found = (sum(scores[i][symbols[s]] for i, s in enumerate(path)), path[::-1])
            best = found if best is None else max(best, found)
    return best and list(best[1][::-1])


def test_path_equals_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores, own = rng.integers(-3, 1, (rng.integers(1, 7), 4)).astype(float), rng.integers(1, 4, rng.integers(1, 4))
        got = letters.Trellis(scores, own).path()
        assert (got if got is None else got.tolist()) == every_path(scores, own)


@pytest.mark.parametrize("frames", [1, 2, 3, 4, 5, 15, 16, 17, 99, 100, 101, 1000])
def test_blocks_of_frames_do_not_change_the_path(frames):
    """Any number of frames, so that blocks end everywhere; against one table of all steps."""
    rng = np.random.default_rng(frames)
    scores, own = rng.integers(-9, 1, (frames, 5)).astype(float), rng.integers(1, 5, max(1, frames // 4))
    trellis = letters.Trellis(scores, own)
    best, steps = trellis.start(), [None]
    for frame in range(1, frames):
        best, back = trellis.step(best, frame)
        steps.append(back)
    at = len(best) - (2 if best[-2] > best[-1] else 1)
    want = []
    for back in reversed(steps):
        want.append(at)
        at -= 0 if back is None else int(back[at])
    assert trellis.path().tolist() == want[::-1]


def rendered(text, seconds_per_letter, rng):
    """Frames that are sure of each letter of a text in turn, with pauses for spaces."""
    rows = []
    for c in text:
        for _ in range(seconds_per_letter):
            p = np.full(27, 0.004)
            p[0 if c == " " else ord(c) - 96] = 0.9
            rows.append(np.log(p / p.sum()).tolist())
    return rows


def test_words_get_their_times_back(spark):
    rng = random.Random(1)
    rows = rendered("hola mi  hello", 5, rng)
    frames = spark.createDataFrame([(1, i, r) for i, r in enumerate(rows)] + [(2, 0, rows[0]), (3, 0, rows[0]), (4, 0, None)], "chart_id long, frame int, scores array<double>")
    words = [(1, 0, "¡Hola!"), (1, 1, "7"), (1, 2, "mí"), (1, 3, "♪"), (1, 4, "♫"), (1, 5, "helo")]
    lyric = spark.createDataFrame(words + [(2, 0, "hola"), (3, 0, "7"), (4, 0, "a"), (5, 0, "a")], "chart_id long, pos int, word string")
    got = {(r.chart_id, r.pos): r for r in letters.aligned_words(frames, lyric, 0.02, least=0.5).collect()}
    assert {c for c, _ in got} == {1}  # too short, no letters, no scores, no frames
    assert (got[1, 0].start_s, got[1, 0].end_s) == pytest.approx((0.0, 0.4)) and got[1, 0].norm == "hola"
    assert [(round(x.s, 2), round(x.e, 2)) for x in got[1, 0].char_spans] == [(0.0, 0.1), (0.1, 0.2), (0.2, 0.3), (0.3, 0.4)]
    assert (got[1, 2].start_s, got[1, 2].end_s) == pytest.approx((0.5, 0.7))
    assert (got[1, 1].start_s, got[1, 1].end_s, got[1, 1].score, got[1, 1].char_spans) == (pytest.approx(0.4), pytest.approx(0.5), 0.0, [])
    assert (got[1, 4].start_s, got[1, 4].end_s) == (pytest.approx(0.9), pytest.approx(0.9))
    assert (got[1, 5].start_s, got[1, 5].end_s) == (pytest.approx(0.9), pytest.approx(1.4))
    assert letters.song_scores(spark.createDataFrame([(1, 0.5), (1, 0.0), (1, 0.9)], "chart_id long, score double")).first().score == pytest.approx(0.7)


def test_lyrics_that_letters_cannot_write_are_left_out(spark):
    frames = spark.createDataFrame([(1, i, r) for i, r in enumerate(rendered("ab", 5, None))], "chart_id long, frame int, scores array<double>")
    words = spark.createDataFrame([(1, 0, "ab"), (1, 1, "さくら"), (1, 2, "12")], "chart_id long, pos int, word string")
    assert letters.aligned_words(frames, words, 0.02).count() == 0
    assert letters.aligned_words(frames, words, 0.02, least=0.3).count() == 3
    assert letters.aligned_words(frames.limit(0), words, 0.02, least=0.3).count() == 0


def test_letters_feed_syllable_cuts(spark):
    from pyspark.sql import functions as F

    from songframe.operators import recurrences

    frames = spark.createDataFrame([(1, i, r) for i, r in enumerate(rendered("manos", 4, None))], "chart_id long, frame int, scores array<double>")
    words = letters.aligned_words(frames, spark.createDataFrame([(1, 0, "manos")], "chart_id long, pos int, word string"), 0.02)
    cuts = recurrences.cut_at_letters(words.withColumn("keys", F.array(F.lit("ma"), F.lit("nos")))).first().cuts
    assert [(round(c.s, 2), round(c.e, 2)) for c in cuts] == [(0.0, 0.16), (0.16, 0.4)]


def test_trust(spark):
    words = spark.createDataFrame([(1, 0, 0.0, 1.0, 0.5), (1, 1, 1.0, 2.0, 0.4), (2, 0, 0.0, 1.0, 0.5), (2, 1, 5.0, 6.0, 0.5), (3, 0, 0.0, 1.0, 0.1), (4, 0, 0.0, 1.0, 0.0)], "chart_id long, pos int, start_s double, end_s double, score double")
    frames = spark.createDataFrame([(c, t, 220.0, 0.9) for c in (1, 2, 3, 4) for t in (0.5, 1.5, 2.5)], "chart_id long, t double, f0 double, conf double")
    got = {r.chart_id: (r.n, r.hit, r.passes) for r in letters.trusted(words, frames).collect()}
    assert got == {1: (2, 2, True), 2: (2, 1, False), 3: (1, 1, False)}
    assert math.isclose(letters.trusted(words, frames).where("chart_id = 1").first().score, 0.45)


PITCH = pitch_track.Settings(rate=8000, hop=256, window=512)


def tone(f, n, rate=8000, overtones=(1, 0.5, 0.25)):
    return sum(a * np.sin(2 * np.pi * f * (k + 1) * np.arange(n) / rate + k) for k, a in enumerate(overtones))


def test_differences_equal_sums():
    rng = np.random.default_rng(3)
    frames = rng.normal(size=(4, 60))
    frames[3] = 0
    got = pitch_track.differences(frames, 40)
    for x, row in zip(frames, got):
        sums = [sum((x[j] - x[j + lag]) ** 2 for j in range(40)) for lag in range(21)]
        want = [1.0] + [sums[lag] / (sum(sums[1 : lag + 1]) / lag) if sum(sums[1 : lag + 1]) else 1.0 for lag in range(1, 21)]
        assert row == pytest.approx(want)


def test_path_of_candidates_equals_enumeration():
    rng, s = np.random.default_rng(4), pitch_track.Settings(most=2)
    for _ in range(60):
        n = rng.integers(1, 6)
        f0, depth = 2.0 ** rng.uniform(6.5, 9.5, (n, 2)), rng.uniform(0, 0.6, (n, 2))
        gone = rng.random((n, 2)) < 0.3
        f0[gone], depth[gone] = np.nan, np.nan

        def cost(path):
            total, before = 0.0, None
            for i, k in enumerate(path):
                if k < 0:
                    total += s.none
                else:
                    deep = [j for j in range(2) if depth[i, j] <= np.nanmin(depth[i]) + s.alike]
                    total += depth[i, k] + s.below * max(0.0, math.log2(max(f0[i, j] for j in deep) / f0[i, k]))
                if i and (k < 0) != (before < 0):
                    total += s.turn
                if i and k >= 0 and before >= 0:
                    total += s.leap * min(2.0, abs(math.log2(f0[i, k] / f0[i - 1, before])))
                before = k
            return total

        every = [p for p in itertools.product((-1, 0, 1), repeat=n) if all(k < 0 or not gone[i, k] for i, k in enumerate(p))]
        assert cost(pitch_track.best_path(f0, depth, s).tolist()) == pytest.approx(min(map(cost, every)))


def blocks(chart, x, sizes):
    at, rows = 0, []
    for size in itertools.cycle(sizes):
        if at >= len(x):
            return rows
        rows.append((chart, at, x[at : at + size].tolist()))
        at += size


def test_tones_and_silence(spark):
    """A melody with rests and noise, in blocks of any size."""
    rng = np.random.default_rng(5)
    melody = [220, 220, 330, 0, 90, 880, 440, 0, 66, 999]
    x = np.concatenate([tone(f, 4096) if f else rng.normal(size=4096) * (i == 3) for i, f in enumerate(melody)])
    rows = blocks(1, x, [4096]) + blocks(2, x, [1000, 1700, 701]) + blocks(3, x[:300], [300]) + [(4, 0, None), (5, 0, [])] + blocks(6, x, [4096])[1:2]
    found = pitch_track.pitch_track(spark.createDataFrame(rows, "chart_id long, at long, samples array<float>"), PITCH).collect()
    by = {c: sorted((r.frame, r.t, r.f0, r.conf) for r in found if r.chart_id == c) for c in range(1, 7)}
    assert len(by[1]) == 160 and len(by[3]) == 2 and not by[4] and not by[5]
    assert [r[0] for r in by[6]] == list(range(16, 32))  # a chart without its first block
    assert [r[:2] for r in by[2]] == [r[:2] for r in by[1]]
    assert np.allclose([r[2:] for r in by[1]], [r[2:] for r in by[2]], atol=1e-6)
    for frame, t, f0, conf in by[1]:
        assert t == pytest.approx(frame * 0.032)
        true = melody[frame // 16]
        if frame % 16 < 13:
            assert (f0 > 0 and conf > 0.5 and abs(12 * math.log2(f0 / true)) < 1) if true else f0 == conf == 0.0, (frame, f0, true)


def test_a_glide_is_followed(spark):
    t = np.arange(16000) / 8000
    x = np.sin(2 * np.pi * (150 * t + 75 * t**2))  # 150 to 450 Hz
    got = sorted((r.t, r.f0) for r in pitch_track.pitch_track(spark.createDataFrame(blocks(1, x, [8000]), "chart_id long, at long, samples array<float>"), PITCH).collect())
    assert all(abs(12 * math.log2(f / (150 + 150 * (s + 0.032)))) < 1 for s, f in got[:-4])


def test_pitch_in_place(spark, sf_dir, capsys):
    """The same frames as of stored blocks, whatever their sizes; and the query stores and sends no samples."""
    from songframe.plans import registry

    rng = np.random.default_rng(10)
    x = np.concatenate([tone(f, 4096) if f else rng.normal(size=4096) * (i == 3) for i, f in enumerate([220, 0, 330, 0, 90, 880])])
    rows = blocks(1, x, [1000, 1700, 701]) + blocks(2, x, [24576]) + blocks(3, x[:300], [300]) + [(4, 0, None), (5, 0, [])] + blocks(6, x, [4096])[1:4] + blocks(6, x, [4096])[5:]
    samples = spark.createDataFrame(rows[::-1], "chart_id long, at long, samples array<float>")
    want = sorted(pitch_track.pitch_track(samples, PITCH).collect())
    got = sorted(pitch_track.pitch_track_in_place(samples.withColumn("own", samples["at"]), sample_blocks.stored, PITCH, keep="own").collect())
    assert [tuple(r)[:2] for r in got] == [tuple(r)[:2] for r in want] and np.allclose([tuple(r)[2:5] for r in got], [tuple(r)[2:] for r in want], atol=1e-6)
    starts = {c: sorted(at for chart, at, y in rows if chart == c and y) for c in range(1, 7)}
    assert all(r.own == max(at for at in starts[r.chart_id] if at <= r.frame * PITCH.hop) for r in got)
    assert pitch_track.pitch_track_in_place(samples.limit(0), sample_blocks.stored, PITCH).count() == 0
    registry.QUERIES["pitch_frames"](spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "Join" not in plan and not re.search("samples|songframe-", plan)


BEATS = tempo.Settings(rate=2000, hop=32, window=128)


def clicks(bpm, seconds, rate=2000, start=0.0):
    after = np.mod(np.arange(int(seconds * rate)) / rate - start, 60.0 / bpm)
    return np.where(np.arange(int(seconds * rate)) / rate >= start, np.exp(-40 * after) * np.sin(2 * np.pi * 400 * after), 0.0)


def test_best_row_of_beats_equals_enumeration():
    rng = np.random.default_rng(6)
    for _ in range(40):
        x, beat = rng.random(rng.integers(1, 12)), float(rng.uniform(2, 4))
        got = tempo.beats(x, beat, BEATS)
        scaled, low, high = x / (x.std() or 1.0), max(1, round(beat / 2)), max(2, round(2 * beat))

        def worth(row):
            return sum(scaled[i] for i in row) - sum(BEATS.tight * math.log((b - a) / beat) ** 2 for a, b in zip(row, row[1:]))

        rows = [r for k in range(1, len(x) + 1) for r in itertools.combinations(range(len(x)), k) if all(low <= b - a <= high for a, b in zip(r, r[1:]))]
        assert worth(tuple(got.tolist())) == pytest.approx(max(map(worth, rows)))


@pytest.mark.parametrize("bpm", [61, 77, 100, 123.4, 150, 180])
def test_tempo_of_clicks(spark, bpm):
    x = clicks(bpm, 25, start=0.7) + np.random.default_rng(1).normal(size=50_000) * 0.01
    rows = blocks(1, x, [2048]) + blocks(2, x, [700, 1100, 333])
    got = {r.chart_id: r for r in tempo.tempo(spark.createDataFrame(rows, "chart_id long, at long, samples array<float>"), BEATS).collect()}
    for r in got.values():
        octave = 2.0 ** round(math.log2(bpm / r.bpm))
        assert abs(r.bpm * octave / bpm - 1) < 0.02
    assert got[1].bpm == pytest.approx(got[2].bpm) and got[1].n_beats == got[2].n_beats


def test_no_onsets_no_tempo(spark):
    rows = blocks(1, np.zeros(40_000), [2048]) + blocks(2, clicks(120, 1), [2048]) + [(3, 0, None)]
    got = {r.chart_id: (r.bpm, r.n_beats, r.first_s) for r in tempo.tempo(spark.createDataFrame(rows, "chart_id long, at long, samples array<float>"), BEATS).collect()}
    assert got == {1: (None, 0, None), 2: (None, 0, None)}


def test_tempo_in_place(spark, sf_dir, capsys):
    """The same as of stored blocks, with what is missing between them; and the query stores and sends no samples."""
    from songframe.plans import registry, signals

    x = clicks(100, 25, start=0.7) + np.random.default_rng(1).normal(size=50_000) * 0.01
    rows = blocks(1, x, [2048]) + blocks(2, x, [700, 1100, 333]) + blocks(3, np.zeros(40_000), [2048]) + blocks(4, clicks(120, 1), [2048]) + [(5, 0, None), (6, 0, [0.1] * 20)]
    rows += [r for i, r in enumerate(blocks(7, x, [2048])) if i not in (0, 9)]
    samples = spark.createDataFrame(rows[::-1], "chart_id long, at long, samples array<float>")
    want = {r.chart_id: r for r in tempo.tempo(samples, BEATS).collect()}
    got = {r.chart_id: r for r in tempo.tempo_in_place(samples, sample_blocks.stored, BEATS).collect()}
    assert set(got) == set(want) == {1, 2, 3, 4, 7}
    for c, r in got.items():
        assert (r.bpm, r.first_s) == (pytest.approx(want[c].bpm), pytest.approx(want[c].first_s)) and r.n_beats == want[c].n_beats
        assert r.n_samples == sum(len(y or []) for chart, _, y in rows if chart == c)
    chart = next(r for r in signals.event_clicks(spark, sf_dir).groupBy("chart_id").count().collect())
    table = signals.event_clicks(spark, sf_dir).where(f"chart_id = {chart.chart_id}").orderBy("at").toArrow()
    parts = list(signals.clicks(table))
    assert [at for at, _ in parts] == [i * 1024 for i in range(chart["count"])]
    after = np.mod(np.arange(1024 * chart["count"]) / 2000, 60 / (70 + chart.chart_id * 37 % 100))
    assert np.concatenate([y for _, y in parts]) == pytest.approx(np.exp(-40 * after) * np.sin(800 * np.pi * after), abs=1e-6)
    registry.QUERIES["tempo_estimates"](spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "Join" not in plan and not re.search("samples|songframe-", plan.replace("n_samples", ""))


def closest_pair_first(apart, limit, number):
    """All pairs of clusters compared before each merge."""
    own = [[i] for i in range(len(apart))]
    while len(own) > (number or 1):
        height, a, b = min((np.mean([apart[i][j] for i in x for j in y]), p, q) for (p, x), (q, y) in itertools.combinations(enumerate(own), 2))
        if not number and height > limit:
            break
        own[a] += own.pop(b)
        own.sort(key=min)
    return [next(k for k, c in enumerate(sorted(own, key=min)) if i in c) for i in range(len(apart))]


def test_chains_equal_closest_pair_first():
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 7, 20, 40):
        for limit, number in ((0.3, None), (0.8, None), (1.1, None), (None, 1), (None, 2), (None, 5)):
            x = rng.normal(size=(n, 4))
            assert speakers.labels(x, limit, number) == closest_pair_first(speakers.distances(x), limit, number)


def test_ties_and_empty_vectors(spark):
    """Voices that are alike are one at any limit; missing, zero and misshapen vectors are alone."""
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [0.0, 2.0]), (1, 2, [2.0, 0.0]), (1, 3, None), (1, 4, [0.0, 0.0]), (1, 5, [1.0]), (1, 6, [0.0, 1.0]), (2, 0, None)]
    windows = spark.createDataFrame(rows, "chart_id long, pos int, vector array<float>")
    got = {(r.chart_id, r.pos): r.speaker for r in speakers.speakers(windows, limit=0.2).collect()}
    assert got == {(1, 0): "A", (1, 1): "B", (1, 2): "A", (1, 3): "C", (1, 4): "D", (1, 5): "E", (1, 6): "B", (2, 0): "A"}
    assert speakers.speakers(windows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        speakers.speakers(windows, limit=None)


def test_many_speakers_have_names():
    assert [speakers.name(k) for k in (0, 25, 26, 27, 701, 702)] == ["A", "Z", "AA", "AB", "ZZ", "AAA"]


def test_segments_of_voices(spark):
    """Two voices in turn: windows become segments, and segments name the words' singers."""
    from songframe.operators import intervals

    rng = np.random.default_rng(8)
    voices = {"A": rng.normal(size=16), "B": rng.normal(size=16)}
    turns = "AAABBAABBB"
    rows = [(1, i, 1.0 * i, i + 1.0, (voices[v] + 0.1 * rng.normal(size=16)).tolist()) for i, v in enumerate(turns)]
    windows = spark.createDataFrame(rows, "chart_id long, pos int, start_s double, end_s double, vector array<float>")
    named = windows.join(speakers.speakers(windows, number=2), ["chart_id", "pos"])
    got = speakers.segments(named)
    assert sorted((r.seg, r.s, r.e, r.speaker) for r in got.collect()) == [(0, 0.0, 3.0, "A"), (1, 3.0, 5.0, "B"), (2, 5.0, 7.0, "A"), (3, 7.0, 10.0, "B")]
    words = spark.createDataFrame([(1, 0, 0.5, 1.5), (1, 1, 2.8, 4.0), (1, 2, 5.2, 6.0)], "chart_id long, pos int, start_s double, end_s double")
    assert {r.pos: r.speaker for r in intervals.dominant_speaker(words, got).collect()} == {0: "A", 1: "B", 2: "A"}


def test_notes_of_a_grid(spark):
    def row(chart, midi, first, loud, onset=()):
        return [(chart, first + i, midi, x, 1.0 if i in onset else 0.0) for i, x in enumerate(loud)]

    rows = row(1, 60, 0, [0.3, 0.6, 0.3, 0.3, 0.3, 0.4])  # fades but goes on
    rows += row(1, 60, 7, [0.9] * 5)  # too short
    rows += row(1, 62, 0, [0.4] * 20)  # never loud
    rows += row(1, 64, 0, [0.6] * 12, onset=(6, 7))  # struck again at 6, once
    rows += row(2, 60, 5, [0.6] * 3 + [0.29] + [0.6] * 6) + [(2, 9, 60, 0.9, 0.0), (2, None, 60, 0.9, 0.0), (2, 30, 60, None, 0.0)]
    grid = spark.createDataFrame(rows, "chart_id long, frame int, midi int, amplitude double, onset double")
    got = sorted((r.chart_id, r.pos, round(r.start_s / note_events.HOP_S), round(r.end_s / note_events.HOP_S), r.midi, round(r.amplitude, 3), r.peak) for r in note_events.note_events(grid).collect())
    assert got == [(1, 0, 0, 6, 60, 0.367, 0.6), (1, 1, 0, 6, 64, 0.6, 0.6), (1, 2, 6, 12, 64, 0.6, 0.6), (2, 0, 9, 15, 60, 0.65, 0.9)]
    assert note_events.note_events(grid.drop("onset")).where("midi = 64").count() == 1
    assert note_events.note_events(grid.limit(0)).count() == 0


def test_frames_are_not_joined(spark, sf_dir, capsys):
    """Spark takes a side of frames for small, by the rows that they come from, and broadcasts it."""
    from songframe.plans import registry

    for name in ("grid_frames", "voice_frames"):
        registry.QUERIES[name](spark, sf_dir).explain()
        assert "Join" not in capsys.readouterr().out


def test_notes_turned_back_into_frames(spark):
    """Events that overlap, resume, last no time, end before they start or lie beyond the end, against a loop."""
    from songframe.operators import recurrences

    rng = random.Random(9)
    events = [(1, i, float(a), float(a + rng.choice((0, 1, 3, 8, -2))), rng.randrange(60, 63), rng.random(), rng.choice("ABC")) for i, a in enumerate(rng.choices(range(40), k=40))]
    events += [(2, 0, 9.0, 3.0, 60, 0.9, "A"), (2, 1, 0.0, 2.0, 61, 0.2, "B"), (2, 2, 0.0, 50.0, 61, 0.2, None), (3, 0, -4.0, -3.0, 60, 0.9, "A"), (4, 0, 1.0, None, 60, 0.9, "A"), (5, 0, 3.0, 5.0, 60, 0.9, "A"), (5, 1, 3.0, 5.0, 72, 0.9, "A")]
    want = {}
    for chart in range(1, 6):
        own = sorted((e for e in events if e[0] == chart and e[6]), key=lambda e: (e[2], e[4], e[1]))
        n = max((int(e[3]) for e in own if e[3] is not None), default=-1) + 1
        want |= {(chart, e[6], frame): (0.0, 0.0) for e in own for frame in range(n)}
        for _, _, a, b, midi, loud, who in own if n > 0 else ():
            a, b = max(0, int(a)), min(n, int(b))
            want |= {(chart, who, frame): (440 * 2 ** ((midi - 69) / 12), max(0.6, loud)) for frame in range(a, min(n, a + 1) if b <= a else b)}
    rows = spark.createDataFrame(events, "chart_id long, pos int, start_s double, end_s double, midi int, amplitude double, speaker string")
    for silence in (True, False):
        got = [((r.chart_id, r.speaker, r.frame), r.t, (r.f0, r.conf)) for r in recurrences.rasterized(rows, 1, 1, silence).collect()]
        assert len(got) == len({k for k, _, _ in got}) and all(t == k[2] for k, t, _ in got)
        assert {k: pytest.approx(v) for k, _, v in got} == {k: v for k, v in want.items() if silence or v[0]}
