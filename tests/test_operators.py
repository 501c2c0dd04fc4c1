"""Operators against loops written here, and on the scenarios of FIXTURES.md."""

import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from songframe.operators import evaluation, intervals, lyrics, manifest, metrics, profiling, ranks, recurrences, sampling, sequences, storage, validation
from songframe.operators.assembly import assembled, left_empty
from songframe.sources import chart_text, library

WORD = "chart_id long, pos int, text string, start_s double, end_s double"


def words(spark, rows, chart=1):
    return spark.createDataFrame([(chart, i, t, float(s), float(e)) for i, (t, s, e) in enumerate(rows)], WORD)


def frames(spark, spans, hz=220.0, chart=1, until=30.0):
    """100 frames a second, voiced in the spans [(from, to, hz)]."""
    rows = []
    for i in range(int(until * 100)):
        t = i / 100
        f = next((x[2] if len(x) > 2 else hz for x in spans if x[0] <= t < x[1]), 0.0)
        rows.append((chart, t, f, 0.9 if f else 0.1))
    return spark.createDataFrame(rows, "chart_id long, t double, f0 double, conf double")


def song(spark, artist="Ana"):
    return spark.createDataFrame([(1, "T", artist, "a.mp3", 30.0)], "chart_id long, title string, artist string, audio string, duration double")


def test_brackets(spark):
    lines = spark.createDataFrame([(1, 0, "Te amo (te amo) cada día (yeah)"), (1, 1, "a) b ((c d) e"), (1, 2, "")], "chart_id long, line_index int, text string")
    got = {(r.line_index, r.word_index): (r.text, r.key, r.adlib) for r in lyrics.tokens(lines).collect()}
    assert [got[0, i][2] for i in range(7)] == [False, False, True, True, False, False, True]
    assert got[0, 6][1] == "yeah"
    assert [got[1, i][2] for i in range(5)] == [True, False, True, True, True]


def test_bracket_depth_is_the_clamped_sum(spark):
    random.seed(4)
    lines = [" ".join("".join(random.choice("(a)") for _ in range(random.randint(1, 4))) for _ in range(12)) for _ in range(60)]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(lines)], "chart_id long, line_index int, text string")
    got = {(r.chart_id, r.word_index): (r.depth, r.adlib) for r in sequences.bracketed(lyrics.raw_words(df)).collect()}
    for i, t in enumerate(lines):
        depth = 0
        for j, w in enumerate(t.split()):
            inside = depth > 0 or "(" in w or ")" in w
            depth = max(0, depth + w.count("(") - w.count(")"))
            assert got[i, j] == (depth, inside)


def test_hallucinations(spark):
    lines = spark.createDataFrame([(1, 0, "hola mundo feliz"), (1, 1, "adios")], "chart_id long, line_index int, text string")
    heard = "dos tres hola mundo feliz x1 x2 x3 x4 x5 x6 adios y1 y2 y3 y4 y5 y6".split()
    got = lyrics.with_lyrics(lines, words(spark, [(w, i, i + 0.5) for i, w in enumerate(heard)])).orderBy("pos").collect()
    assert [r.text for r in got] == ["hola", "mundo", "feliz", "adios"]
    assert [r.line_index for r in got] == [0, 0, 0, 1]
    for kept in ("hola extra mundo feliz", "hola mundo feliz mundo hola feliz mundo hola feliz"):  # a short run; a chorus
        rows = lyrics.with_lyrics(lines, words(spark, [(w, i, i + 0.5) for i, w in enumerate(kept.split())]))
        assert " ".join(r.text for r in rows.orderBy("pos").collect()) == kept


def test_too_little_overlap(spark):
    lines = spark.createDataFrame([(1, 0, "a b c d e f g h i j")], "chart_id long, line_index int, text string")
    assert lyrics.with_lyrics(lines, words(spark, [("a", 0, 1), ("z", 1, 2)])).count() == 0


def test_greedy_match(spark):
    random.seed(2)
    gen = [(c, i, t) for c in range(20) for i, t in enumerate(sorted(random.choice(range(60)) / 10 for _ in range(25)))]
    ref = [(c, i, t) for c in range(1, 21) for i, t in enumerate(sorted(random.choice(range(60)) / 10 for _ in range(25)))]
    schema = "chart_id long, pos int, start_s double"
    got = {(r.chart_id, r.ref_pos): r.gen_pos for r in recurrences.greedy_match(spark.createDataFrame(gen, schema), spark.createDataFrame(ref, schema)).collect()}
    want = {}
    for c in range(20):
        g, used = [x for x in gen if x[0] == c], set()
        for _, pos, t in [x for x in ref if x[0] == c]:
            best, d = None, 0.3
            for _, i, s in g:
                if i not in used and abs(s - t) < d:
                    best, d = i, abs(s - t)
            if best is not None:
                used.add(best)
                want[c, pos] = best
    assert got == want


def test_word_speaker(spark):
    random.seed(6)
    w = [(c, i, *sorted((random.random() * 20, random.random() * 20))) for c in range(8) for i in range(40)]
    w = [(c, i, s, min(e, s + 0.7)) for c, i, s, e in w]
    seg = [(c, i, s, s + random.random() * 2, random.choice("AB")) for c in range(8) for i, s in enumerate(sorted(random.random() * 20 for _ in range(6)))]
    got = {(r.chart_id, r.pos): r.speaker for r in intervals.word_speaker(spark.createDataFrame(w, "chart_id long, pos int, start_s double, end_s double"), spark.createDataFrame(seg, "chart_id long, seg int, s double, e double, speaker string")).collect()}
    for c, i, t0, t1 in w:
        own = [x for x in seg if x[0] == c]
        hits = [(min(e, t1) - max(s, t0), -n, k) for _, n, s, e, k in own if min(e, t1) - max(s, t0) > 0]
        want = max(hits)[2] if hits else min((t0 - e if e < t0 else s - t1 if s > t1 else 0.0, n, k) for _, n, s, e, k in own)[2]
        assert got[c, i] == want


def test_jitter_and_placement(spark):
    random.seed(8)
    rows = [(c, i, float(random.choice((50, 55, 60, 66))), i > 0 and random.random() < 0.1, random.randint(0, 8), b, b + random.randint(0, 4)) for c in range(20) for i, b in enumerate(sorted(random.randint(0, 60) for _ in range(30)))]
    df = spark.createDataFrame(rows, "chart_id long, pos int, midi double, new_line boolean, n_frames int, beat int, endbeat int")
    smooth = {(r.chart_id, r.pos): r.midi for r in recurrences.without_jitter(df).collect()}
    put = {(r.chart_id, r.pos): (r.start_beat, r.duration) for r in recurrences.placed(df).collect()}
    for c in range(20):
        own = [list(x) for x in rows if x[0] == c]
        for i in range(1, len(own) - 1):
            a, b, n = own[i - 1], own[i], own[i + 1]
            if not b[3] and not n[3] and b[4] < 5 and abs(b[2] - a[2]) >= 5 and abs(b[2] - n[2]) >= 5:
                b[2] = (a[2] + n[2]) / 2.0
        end = -1
        for i, x in enumerate(own):
            start, length = max(x[5], end + 1), max(2, x[6] - x[5])
            if i < len(own) - 1:
                length = max(1, min(length, own[i + 1][5] - start))
            end = start + length
            assert put[c, i] == (start, length)
            assert smooth[c, i] == x[2]


def test_long_lines(spark):
    beats = [0, 4, 8, 60, 64, 110, 114, 200]
    rows = [(1, 0, i, b, 2, "la") for i, b in enumerate(beats)]
    got = recurrences.short_lines(spark.createDataFrame(rows, "chart_id long, line_no int, pos int, start_beat int, duration int, text string"), 240.0)
    # the last gap is the largest; what is left spans 7.25 s and is cut at 8..60
    assert [r.part for r in got.orderBy("pos").collect()] == [0, 0, 0, 1, 1, 1, 1, 2]
    held = [(1, 0, i, b, 2, "~" if i else "la") for i, b in enumerate(beats)]
    assert {r.part for r in recurrences.short_lines(spark.createDataFrame(held, "chart_id long, line_no int, pos int, start_beat int, duration int, text string"), 240.0).collect()} == {0}


def test_two_registers(spark):
    rows = [(1, i, v) for i, v in enumerate((50.0, 51.0, 70.0, 52.0, 71.0))] + [(2, 0, 5.0)]
    got = recurrences.two_registers(spark.createDataFrame(rows, "chart_id long, pos int, value double")).orderBy("chart_id", "pos").collect()
    assert [r.label for r in got] == [0, 0, 1, 0, 1, 0]
    assert (got[0].low, got[0].high) == (51.0, 70.5)


def test_metrics_on_edges(spark):
    rows = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 7.0), (2, 2.0, 7.0), (3, 1.0, 1.0), (3, 2.0, 3.0)], "chart_id long, g double, r double")
    got = {r.chart_id: (r.contour_corr, r.within_2st) for r in metrics.pitch_agreement(rows).collect()}
    assert got == {1: (0.0, 1.0), 2: (0.0, 1.0), 3: (1.0, 1.0)}
    errors = spark.createDataFrame([(1, x) for x in (0.1, -0.2, 0.3, 0.4)], "chart_id long, error double")
    r = metrics.error_stats(errors, "chart_id").first()
    assert (r.n, r.median_ms, r.mae_ms, r.p90_ms, r.bias_ms) == (4, 300.0, 250.0, 300.0, 200.0)
    assert metrics.error_stats(errors.limit(0), "chart_id").count() == 0
    votes = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None)], "k long, s string")
    assert [tuple(r) for r in metrics.majority(votes, "k", "s").collect()] == [(1, "a")]


def test_intra_line_gap_is_not_negative(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 2.0), (1, 1, 1.0, 3.0), (1, 2, 3.5, 4.0)], "chart_id long, pos int, start_s double, end_s double")
    got = sequences.intra_line_gaps(sequences.with_lines(rows, gap=1.0)).orderBy("pos").collect()
    assert [r.gap_ms for r in got] == [0.0, 500.0, None]


def allocated(spark, sizes, n):
    rows = sampling.allocation(spark.createDataFrame(list(sizes.items()), "k string, size long"), n, "k").collect()
    return {r.k: r.share for r in rows}


def test_allocation(spark):
    assert allocated(spark, {"a": 50, "b": 30, "c": 20}, 10) == {"a": 5, "b": 3, "c": 2}
    assert allocated(spark, {"a": 2, "b": 1}, 10) == {"a": 7, "b": 3}
    # nine rounded up to one each: the first five by name give theirs back
    assert allocated(spark, {c: 1 for c in "abcdefghi"}, 4) == {c: int(c > "e") for c in "abcdefghi"}
    # 2.5 and 2.5 are even both ways; the stratum with more rows left takes the last one
    assert allocated(spark, {"a": 25, "b": 25}, 5) == {"a": 3, "b": 2}
    # null is a name of its own, the last
    assert allocated(spark, {None: 1, "a": 1, "b": 1}, 2) == {"a": 0, "b": 1, None: 1}
    assert allocated(spark, {}, 5) == {}


def test_allocation_is_near_proportion(spark):
    rng = random.Random(9)
    for _ in range(12):
        sizes = {f"s{i}": rng.randint(1, 60) for i in range(rng.randint(1, 9))}
        n = rng.randint(1, sum(sizes.values()))
        got, total = allocated(spark, sizes, n), sum(sizes.values())
        assert sum(got.values()) == n
        first = {k: max(1, round(n * v / total)) for k, v in sizes.items()}
        off = sum(first.values()) - n
        moved = {k: got[k] - first[k] for k in sizes}
        assert sum(map(abs, moved.values())) == abs(off)
        if off > 0:  # who gave had more, before its last row went, than all others have now
            assert all(got[k] + 1 >= got[j] for k in sizes if moved[k] for j in sizes)
        if off < 0:
            left = {k: sizes[k] - got[k] for k in sizes}
            assert all(left[k] + 1 >= left[j] for k in sizes if moved[k] for j in sizes)


def test_terciles_are_ranks(spark):
    for n in (1, 2, 3, 7, 10):
        values = [float(x * x) for x in range(n)]
        assert sampling.terciles(spark.createDataFrame([(v,) for v in values], "v double"), "v") == pytest.approx((values[n // 3], values[2 * n // 3]))
    assert sampling.terciles(spark.createDataFrame([], "v double"), "v") == (0.0, 0.0)


@pytest.mark.parametrize("n", [1, 2, 278, 380, 584])
def test_terciles_are_the_values_themselves(spark, n):
    values = [float(i) for i in range(n)]
    frame = spark.createDataFrame([(v,) for v in reversed(values)] + [(None,)], "v double")
    assert sampling.terciles(frame, "v") == (values[n // 3], values[2 * n // 3])
    bands = [r.band for r in sampling.with_band(frame.where("v IS NOT NULL"), "v").orderBy("v").collect()]
    assert bands == [0 if i < n // 3 else 1 if i < 2 * n // 3 else 2 for i in range(n)]


def test_quantiles_against_sorted_values(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), float(rng.choice((1, 2, 2, 5, 9.5, rng.random())))) for _ in range(900)] + [("one", 4.0), ("none", None)]
    got = {r.k: r for r in ranks.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [0, 0.1, 0.5, 0.77, 1]).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for k, r in got.items():
        own = sorted(v for a, v in rows if a == k and v is not None)
        assert r.n == len(own) and r.mean == pytest.approx(sum(own) / len(own))
        for share, q in zip((0, 0.1, 0.5, 0.77, 1), r.q, strict=True):
            place = (len(own) - 1) * share
            low, high = own[int(place)], own[min(int(place) + 1, len(own) - 1)]
            assert q == pytest.approx(low + (high - low) * (place - int(place)))


def test_stratified_sample_with_null_groups_and_repeated_keys(spark):
    rows = [(i // 2, ["x", None, "y"][i % 3], float(i % 50)) for i in range(600)]
    got = sampling.stratified(spark.createDataFrame(rows, "id long, g string, v double"), "id", "g", "v", 60).collect()
    assert len(got) == 60 and {r.g for r in got} == {"x", None, "y"} and {r.band for r in got} == {0, 1, 2}
    assert sampling.stratified(spark.createDataFrame([], "id long, g string, v double"), "id", "g", "v", 60).count() == 0
    few = sampling.stratified(spark.createDataFrame(rows[:5], "id long, g string, v double"), "id", "g", "v", 60)
    assert few.count() == 5


def test_bracketed_words_are_the_clamped_sum_too(spark):
    random.seed(9)
    lines = [" ".join("".join(random.choice("(a)bc") for _ in range(random.randint(1, 4))) for _ in range(random.randint(0, 12))) for _ in range(80)] + ["", "  ", "plain words only"]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(lines)] + [(99, 0, None)], "chart_id long, line_index int, text string")
    got = {(r.chart_id, r.word_index): (r.word, r.depth, r.adlib) for r in lyrics.bracketed_words(df).collect()}
    want = {}
    for i, t in enumerate(lines):
        depth = 0
        for j, w in enumerate(t.split()):
            inside = depth > 0 or "(" in w or ")" in w
            depth = max(0, depth + w.count("(") - w.count(")"))
            want[i, j] = (w, depth, inside)
    assert got == want


def test_held_notes_against_a_walk(spark):
    """Runs, short runs, and neighbours of one pitch, walked frame by frame."""
    rng, rows = random.Random(11), []
    for span in range(60):
        t, pitch = 0.0, 60.0
        for _ in range(rng.randint(3, 60)):
            if rng.random() < 0.15:
                pitch = float(rng.choice((59, 60, 60.4, 61, 62, 62.6)))
            rows.append((1, span, 0.0, 9.0, t, 440 * 2 ** ((pitch + rng.random() / 10 - 69) / 12)))
            t += 0.05
    frame = spark.createDataFrame(rows, "chart_id long, pos int, start_s double, end_s double, t double, f0 double")
    got = {}
    for r in recurrences.held_parts(frame).orderBy("pos", "part").collect():
        got.setdefault(r.pos, []).append((round(r.part_start, 6), round(r.part_end, 6), round(r.midi, 6)))
    want = {}
    for span in range(60):
        own = [(t, 69 + 12 * math.log2(f / 440)) for _, p, _, _, t, f in rows if p == span]
        if len(own) < 8:
            continue
        parts = []
        i = 0
        while i < len(own):
            j = i
            while j + 1 < len(own) and round(own[j + 1][1]) == round(own[i][1]):
                j += 1
            if not parts or own[j][0] - own[i][0] >= 0.25:
                parts.append([])
            parts[-1] += own[i : j + 1]
            i = j + 1
        if len(parts) > 1 and parts[0][-1][0] - parts[0][0][0] < 0.25:
            parts[:2] = [parts[0] + parts[1]]
        merged = []
        for p in parts:
            if merged and round(statistics.median(m for _, m in p)) == round(statistics.median(m for _, m in merged[-1])):
                merged[-1] = merged[-1] + p
            else:
                merged.append(p)
        if len(merged) > 1:
            starts = [0.0, *(p[0][0] for p in merged[1:]), 9.0]
            want[span] = [(round(starts[k], 6), round(starts[k + 1], 6), round(statistics.median(m for _, m in p), 6)) for k, p in enumerate(merged)]
    assert got == want and len(want) > 10


def test_manifest_and_empty_charts(spark):
    files = spark.createDataFrame([(1, "#BPM:240\n#LANGUAGE:Español\n"), (2, "#TITLE:x\n#relative : yes\n#BPM:240\n"), (3, "#TITLE:x\n"), (4, "#BPM:9\n"), (5, None)], "chart_id long, text string")
    words_ = spark.createDataFrame([(c, 0, i, 2.0 * i, 2.0 * i + 1) for c in (1, 2, 3, 5) for i in range(31)] + [(4, 0, i, 0.1 * i, 0.1 * i + 0.1) for i in range(31)], "chart_id long, line_no int, word_no int, start_s double, end_s double")
    got = manifest.manifest(files, words_).collect()
    assert [(r.chart_id, r.lang_group, r.n_words, r.span_s) for r in got] == [(1, "es", 31, 61.0)]
    left = spark.createDataFrame([(1, " ", False), (1, "a", True), (2, "a", None), (3, None, None)], "chart_id long, text string, adlib boolean")
    assert sorted(r.chart_id for r in left_empty(left, drop_adlibs=True).collect()) == [1, 3]
    assert sorted(r.chart_id for r in left_empty(left).collect()) == [3]


def test_metric_files_and_stages(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, (7,)), (2, None, None)], "id long, score double, more struct<n:int>")
    library.write_json(rows, str(tmp_path / "json"))
    back = library.read_json(spark, str(tmp_path / "json"), "id long, score double, more struct<n:int>, absent string")
    assert sorted(map(tuple, back.select("id", "score", "more.n", "absent").collect())) == [(1, 0.5, 7, None), (2, None, None, None)]
    library.write_csv(rows, str(tmp_path / "csv"), "score", "id")
    assert sorted(map(tuple, spark.read.option("header", "true").csv(str(tmp_path / "csv")).collect()), key=str) == [("0.5", "1"), (None, "2")]
    stage = str(tmp_path / "stage")
    first = storage.once(rows.select("id"), stage).collect()
    assert sorted(first) == sorted(storage.once(spark.createDataFrame([(9,)], "id long"), stage).collect())  # the second run reuses the first
    shape = profiling.as_json(spark.createDataFrame([("a", 2, 1.5), ("b", 1, 3.0)], "metric string, n long, mean double")).first().value
    assert json.loads(shape) == {"a": {"n": 2, "mean": 1.5}, "b": {"n": 1, "mean": 3.0}}
    one = spark.createDataFrame([("es", 1.0), ("es", 2.0)], "lang string, v double")
    assert metrics.language_medians(one, "v").count() == 0
    assert sorted(map(tuple, metrics.language_medians(one.union(spark.createDataFrame([(None, 5.0)], one.schema)), "v").collect()), key=str) == [("es", 2, 1.5), (None, 1, 5.0)]


CHART = "﻿#TITLE:Old\r\n#TITLE: New \r\n#ARTIST:Ana\r\n#BPM:240,5\r\n#GAP:1000\r\n#MP3:a.mp3\r\n#DUETSINGERP1:A\r\nP 1\r\n: 0 2 5 Ho\r\n: 3 x 5 bad\r\n* 3 2 6 la \r\n- 8\r\n: 9 1 7  hi\r\n#late:1\r\nP 2\r\nF 0 4 0 ~\r\nE\r\n: 99 1 1 no\r\n".lstrip("﻿")


def test_parse(spark):
    files = spark.createDataFrame([(1, CHART), (2, ""), (3, None)], "chart_id long, text string")
    got = chart_text.notes(files, keep_tracks=True).orderBy("track", "line_no", "note_index").collect()
    assert [(r.track, r.line_no, r.note_index, r.break_beat, r.start_beat, r.duration, r.pitch, r.text, r.kind) for r in got] == [
        (0, 0, 0, None, 0, 2, 5, "Ho", "normal"), (0, 0, 1, None, 3, 2, 6, "la ", "golden"), (0, 1, 0, 8, 9, 1, 7, " hi", "normal"), (1, 0, 0, None, 0, 4, 0, "~", "freestyle"),
    ]
    flat = chart_text.notes(files).orderBy("line_no", "note_index").collect()
    assert [(r.track, r.line_no, r.text) for r in flat] == [(0, 0, "Ho"), (0, 0, "la "), (0, 1, " hi"), (0, 1, "~")]
    head = {r.chart_id: r for r in chart_text.headers(files).collect()}
    assert (head[1].title, head[1].bpm, head[1].gap_ms, head[1].audio, head[1].p1) == ("New", 240.5, 1000.0, "a.mp3", "A")
    assert (head[2].title, head[2].bpm, head[2].audio) == ("", 0.0, "")


def test_round_trip_and_files(spark, tmp_path):
    charts = spark.createDataFrame([(1, "T", "Ana", "me", "a.mp3", 240.0, 11068.0)], "chart_id long, title string, artist string, creator string, audio string, bpm double, gap_ms double")
    notes = spark.createDataFrame([(1, 0, 0, 0, None, 0, 4, 5, "Ho", "normal"), (1, 0, 0, 1, None, 4, 2, 7, "la ", "golden"), (1, 0, 1, 0, 8, 10, 3, 0, "~", "rap")], "chart_id long, track int, line_no int, note_index int, break_beat int, start_beat int, duration int, pitch int, text string, kind string")
    files = chart_text.rendered(charts, notes)
    assert files.first().text.endswith("~\nE\n")
    back = chart_text.notes(files)
    assert sorted(map(tuple, back.select(notes.columns).collect()), key=str) == sorted(map(tuple, notes.collect()), key=str)
    assert validation.problems(charts, notes).count() == 0
    chart_text.write_charts(files, str(tmp_path / "out"))
    read = chart_text.read_files(spark, str(tmp_path / "out")).first()
    assert read.text == files.first().text.replace("\n", "\r\n")


def test_validation(spark):
    charts = spark.createDataFrame([(1, " ", None, "a", 0.5), (2, "t", "a", "b", 240.0), (3, "t", "a", "b", 240.0)], "chart_id long, title string, artist string, audio string, bpm double")
    rows = [(2, 0, 0, 0, 5, 1, "normal"), (2, 0, 0, 1, 3, 1, "normal"), (2, 0, 0, 2, 1, 0, "normal"), (2, 0, 1, 0, 4, 1, "normal"), (2, 0, 2, 0, 9, 0, "normal"), (2, 0, 3, 0, 8, 1, "normal"), (3, 0, 0, 0, 0, 1, "freestyle")]
    notes = spark.createDataFrame(rows, "chart_id long, track int, line_no int, note_index int, start_beat int, duration int, kind string")
    got = {tuple(r) for r in validation.problems(charts, notes).collect()}
    assert got == {
        (1, None, None, "title"), (1, None, None, "artist"), (1, None, None, "bpm"), (1, None, None, "no notes"), (3, None, None, "all freestyle"),
        (2, 0, 0, "beat order"), (2, 0, 1, "beat order"), (2, 0, 2, "duration"), (2, 0, 3, "beat order"),
    }


def test_gold_words(spark):
    texts = ["Co", "ra", "zón ", "par", "tío", " ", "~"]
    rows = [(1, 0, i, t, i * 1.0, i + 1.0) for i, t in enumerate(texts)] + [(1, 1, 0, "~", 8.0, 9.0), (1, 1, 1, "ya", 9.0, 10.0)]
    got = sequences.word_table(sequences.song_words(spark.createDataFrame(rows, "chart_id long, line_no int, note_index int, text string, start_s double, end_s double"))).orderBy("line_no", "word_no").collect()
    assert [(r.line_no, r.text, len(r.syllables), r.end_s) for r in got] == [(0, "Corazón", 3, 3.0), (0, "partío", 2, 7.0), (1, "ya", 1, 10.0)]


def test_timed_lyrics_and_tags(spark):
    rows = spark.createDataFrame([(1, "[00:10.5][01:00] hola\n[00:05] \n[00:07]a\nx"), (2, None)], "key long, text string")
    assert [(r.t, r.text) for r in library.timed_lyrics(rows).orderBy("t", "pos").collect()] == [(7.0, "a"), (10.5, "hola"), (60.0, "hola")]
    tags = spark.createDataFrame([(1, "TAG:Title=a=b\nnone\nartist= x ")], "key long, text string")
    assert {(r.tag, r.value) for r in library.tags(tags).collect()} == {("title", "a=b"), ("artist", "x")}


def test_assemble_snaps_and_holds(spark):
    rows = [("hola", 0.1, 3.4), ("no", 5.0, 6.2)]
    voice = frames(spark, [(3.0, 3.4, 220.0), (5.0, 5.6, 220.0), (5.6, 6.2, 220.0 * 2 ** (2 / 12))])
    charts, notes = assembled(words(spark, rows), voice, song(spark))
    assert charts.first().gap_ms > 2500
    got = notes.orderBy("line_no", "note_index").collect()
    assert any(r.text == "~" and r.pitch - got[i - 1].pitch == 2 for i, r in enumerate(got))
    assert all(r.duration >= 1 for r in got)


def test_assemble_lines(spark):
    far = words(spark, [("uno", 1.0, 1.4), ("dos", 20.5, 20.9), ("tres", 21.0, 21.4)]).withColumn("line_index", F.lit(0))
    charts, notes = assembled(far, frames(spark, [(1.0, 1.4), (20.0, 22.0)]), song(spark))
    assert notes.select("line_no").distinct().count() == 1 and charts.first().gap_ms > 18000
    apart = words(spark, [("uno", 1.0, 1.4), ("dos", 21.0, 21.4)]).withColumn("line_index", F.lit(0))
    _, notes = assembled(apart, frames(spark, [(0.0, 30.0)]), song(spark))
    assert notes.select("line_no").distinct().count() == 2


def test_assemble_duet(spark):
    rows = [(f"la{i}", 2.0 * i, 2.0 * i + 0.5) for i in range(12)]
    parts = [(1, i, 2.0 * i, 2.0 * i + 0.5, "AB"[i % 2]) for i in range(8)] + [(1, 8 + i, 2.0 * k, 2.0 * k + 0.5, s) for i, (k, s) in enumerate((k, s) for k in range(8, 12) for s in "AB")]
    seg = spark.createDataFrame(parts, "chart_id long, seg int, s double, e double, speaker string")
    voice = frames(spark, [(0.0, 30.0)])
    lines = lambda n: [r.n for r in n.groupBy("track").agg(F.count_distinct("line_no").alias("n")).orderBy("track").collect()]
    both = assembled(words(spark, rows), voice, song(spark, "Ana y Beto"), seg)
    assert lines(both[1]) == [8, 8] and both[0].first().p2 == "Beto"
    assert lines(assembled(words(spark, rows), voice, song(spark, "Ana y Beto"), seg, unison="lead")[1]) == [8, 4]
    assert lines(assembled(words(spark, rows), voice, song(spark, "Ana y Beto"))[1]) == [12]
    charts, notes = both
    flat = evaluation.flattened(charts, notes)
    r = evaluation.duet_scores(flat, flat).first()
    assert (r.pairing, r.accuracy, r.p1.match_rate_vs_ref, r.p1.lyric_similarity) == ("direct", 1.0, 1.0, 1.0)


def test_assemble_adlibs_and_nothing(spark):
    rows = words(spark, [("hola", 1.0, 1.4), ("backing", 1.5, 1.9), (" ", 2.0, 2.2), ("mundo", 2.5, 2.9)]).withColumn("adlib", F.col("text") == "backing")
    voice = frames(spark, [(0.0, 5.0)], until=5.0)
    text = lambda drop: "".join(r.text for r in assembled(rows, voice, song(spark), drop_adlibs=drop)[1].orderBy("line_no", "note_index").collect())
    assert "ba" in text(False) and "ba" not in text(True)
    assert assembled(rows.limit(0), voice, song(spark))[1].count() == 0


def test_syllable_and_timing_scores(spark):
    part = "array<struct<text:string,start_s:double,end_s:double>>"
    rows = [(1, 0, "mano", 0.0, 1.0, [("ma", 0.0, 0.4), ("no", 0.4, 1.0)]), (1, 1, "sol", 1.0, 2.0, [("sol", 1.0, 2.0)]), (1, 2, "luna", 2.0, 3.0, [("l", 2.0, 2.2), ("u", 2.2, 2.4), ("na", 2.4, 3.0)])]
    gold = spark.createDataFrame(rows, f"chart_id long, pos int, text string, start_s double, end_s double, syllables {part}")
    letters = spark.createDataFrame([(1, 0, "mano", [(0.0, 0.1), (0.1, 0.3), (0.3, 0.6), (0.6, 1.0)])], "chart_id long, pos int, norm string, char_spans array<struct<s:double,e:double>>")
    r = evaluation.syllable_scores(gold, letters).first()
    assert (r.n_words, r.n_prop, r.n_fa, r.prop_median_ms, r.fa_median_ms) == (1, 1, 1, 100.0, 100.0)
    heard = words(spark, [("mano", 0.1, 1.2), ("luna", 2.0, 2.9)])
    pairs = spark.createDataFrame([(1, 0, 0), (1, 2, 1)], "chart_id long, left_pos int, right_pos int")
    r = evaluation.timing_scores(gold, heard, pairs).first()
    assert (r.recall, r.onset.median_ms, r.onset.bias_ms, r.end.mae_ms) == (0.667, 100.0, 50.0, 150.0)


def test_library_profile(spark):
    good = "#TITLE:a\n#BPM:240\n: 0 4 5 la\n* 6 2 8 ~ le\nF 9 1 0 x\n- 12\n: 20 4 5 li\n: 22 2 5 lo\nE\n"
    files = spark.createDataFrame([(1, good), (2, "#RELATIVE:YES\n#BPM:10\n: 0 1 1 a\n"), (3, "#BPM:240\n"), (4, None)], "chart_id long, text string")
    ok, errors = profiling.usable(files)
    assert [r.chart_id for r in ok.collect()] == [1]
    assert {(r.chart_id, r.reason) for r in errors.collect()} == {(2, "relative beats"), (3, "no lines or tempo"), (4, "no lines or tempo")}
    got = {r.metric: r for r in profiling.profile(files).collect()}
    # gaps = notes - lines, and line gaps = lines - charts
    assert (got["note_duration_ms"].n, got["intra_line_gap_ms"].n, got["inter_line_gap_s"].n, got["notes_per_line"].n) == (4, 2, 1, 2)
    assert (got["note_duration_ms"].mean, got["intra_line_gap_ms"].mean, got["inter_line_gap_s"].mean, got["pitch_step"].mean) == (187.5, 62.5, 0.75, 1.5)
    assert (got["hold_note_fraction"].mean, got["golden_fraction"].mean, got["pitch_range"].mean) == (0.25, 0.25, 3.0)
