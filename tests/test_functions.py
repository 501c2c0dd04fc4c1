"""Scalar functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from songframe.functions import arrow, text, timing


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("_"))
    return row.select(column.alias("x")).first().x


def test_timing(spark):
    at = lambda b: one(spark, timing.beat_to_time(F.lit(b), F.lit(321.0), F.lit(27300.0)))
    assert at(0) == pytest.approx(27.3)
    assert at(4) == pytest.approx(27.3 + 60 / 321)
    beat = lambda t: one(spark, timing.time_to_beat(F.lit(t), F.lit(0.0), F.lit(15.0)))
    assert [beat(x) for x in (0.5, 1.5, 2.5, -3.0)] == [0, 2, 2, 0]


def test_pitch(spark):
    assert one(spark, timing.midi_of(F.lit(440.0))) == 69
    assert one(spark, timing.hz_of(F.lit(57))) == pytest.approx(220)


def test_tempo(spark):
    assert one(spark, timing.tempo_multiple(F.lit(120.0), F.lit(485.0))) == 4
    assert one(spark, timing.tempo_deviation(F.lit(120.0), F.lit(485.0))) == pytest.approx(0.0104)
    assert one(spark, timing.tempo_multiple(F.lit(0.0), F.lit(485.0))) is None


def test_preview_is_thirty_beats_in(spark):
    assert one(spark, timing.preview_start(F.lit(100.0), F.lit(1.0), F.lit(240.0))) == pytest.approx(2.88)
    assert one(spark, timing.preview_start(F.lit(0.0), F.lit(1.0), F.lit(240.0))) is None


@pytest.mark.parametrize(("word", "key"), [("Corazón", "corazon"), ("¿Qué?", "que"), ("123", ""), ("ñoño", "nono"), ("é", "e")])
def test_letters_key(spark, word, key):
    assert one(spark, text.letters_key(F.lit(word))) == key


@pytest.mark.parametrize(
    ("f", "x", "want"),
    [
        (text.display, ' "¡Hola!" ', "Hola"), (text.display, "pa'", "pa'"), (text.number_text, 240.0, "240"), (text.number_text, 240.04, "240.04"), (text.number_text, 0.0, "0"),
        (text.number_of, "1,5", 1.5), (text.number_of, "x", None), (text.slug, " Ana & Beto! ", "Ana_Beto"), (text.artists, "Ana y Beto feat. C & Dee", ["Ana", "Beto", "Dee"]), (text.artists, "Ana", ["Ana"]),
        (text.audio_name, "a/b.OGG", "input.ogg"), (text.audio_name, "b.exe", "input.mp3"), (text.audio_name, None, "input.mp3"), (text.language_code, " Español ", "es"), (text.language_code, "Klingon", "auto"), (text.language_code, None, "auto"),
        (text.chosen_language, "EN", "es"), (text.chosen_language, "auto", "auto"), (text.stripped, "\t a\n", "a"), (text.lyric_text, "¡Hola,  Mundo!\n", "hola mundo"), (text.relative_header, "#TITLE:x\n#relative: YES\n", True), (text.relative_header, "#TITLE:x\n", False),
    ],
)
def test_text(spark, f, x, want):
    value = F.lit(x).cast("string") if x is None else F.lit(x)
    assert one(spark, f(value)) == want


def test_path_part(spark):
    part = lambda x: one(spark, text.path_part(F.lit(x).cast("string"), F.lit("song")))
    assert [part(x) for x in ("../../etc/passwd", None, " . ", "Ana: día")] == ["passwd", "song", "song", "Ana_ día"]


def test_relative_quirk(spark):
    """A header line that ends in E ends the search."""
    assert one(spark, text.relative_beats(F.lit("#RELATIVE:YES\n"))) is True
    assert one(spark, text.relative_beats(F.lit("#TITLE:LOVE\n#RELATIVE:YES\n"))) is False


def test_title_and_artist(spark):
    none = F.lit(None).cast("string")
    stem = F.lit("Ana - Luna - Live")
    assert one(spark, text.title_of(stem, none, none)) == "Luna - Live"
    assert one(spark, text.artist_of(stem, none, none)) == "Ana"
    assert one(spark, text.title_of(F.lit("luna"), none, F.lit("Tagged"))) == "Tagged"
    assert one(spark, text.artist_of(F.lit("luna"), none, none)) == "Unknown"


@pytest.mark.parametrize(("word", "parts"), [("coincidencia", "coin ci den cia"), ("corazón", "co ra zón"), ("manos", "ma nos"), ("prohibido", "pro hi bi do"), ("carro", "ca rro"), ("sol", "sol"), ("", "")])
def test_syllables(word, parts):
    assert arrow.syllables(word) == parts.split(" ")
    assert "".join(arrow.syllables(word)) == word


def test_decoded(spark):
    rows = spark.createDataFrame([(bytearray("ñ".encode("utf-8-sig")),), (bytearray("ñ".encode("cp1252")),), (bytearray(b"\x81"),), (None,)], "b binary")
    assert [r.x for r in rows.select(arrow.decoded("b").alias("x")).collect()] == ["ñ", "ñ", "\x81", None]


def test_word_keys_of_many_alphabets(spark):
    """Against the decomposition of each word."""
    import unicodedata

    words = ["čas", "Ōkami", "şarkı", "Žluťoučký", "ĐĐ", "ǎǐ", "Ｆｕｌｌ", "x²", "naïve", "ệ", "Ｉ", "İstanbul", "e\u0301té", "日本", "ﾊﾟ", "Ắ", "ø", "ß", "ŉ"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.word_key(F.col("w")).alias("k"), text.letters_key(F.col("w")).alias("l")).collect()
    for r in rows:
        apart = lambda form: "".join(c for c in unicodedata.normalize(form, r.w.lower()) if not unicodedata.combining(c))
        if r.w == "ŉ":  # two characters, one of them no letter
            continue
        assert r.k == "".join(c for c in apart("NFKD") if c in "abcdefghijklmnopqrstuvwxyz0123456789"), r
        assert r.l == "".join(c for c in apart("NFD") if c in "abcdefghijklmnopqrstuvwxyz"), r


def test_word_keys_of_characters_that_come_apart(spark):
    """Against the standard library: taken apart, without marks, a to z and digits of what is left."""
    import unicodedata

    words = ["ﬁancé", "Ĳs", "½", "Ⅷ", "㎏", "ﬀ", "ŉa", "ǆ", "™x", "a\x00b", "plain-Word_9", "ÅNGSTRÖM", "ß", "ñ̃o", "ＡＢ１", "日本", "№5", "", "…"]

    def key(w):
        return "".join(c for c in unicodedata.normalize("NFKD", w.lower()).lower() if c.isascii() and c.isalnum())

    got = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", text.word_key(F.col("w")).alias("k")).orderBy("i").collect()
    assert [r.k for r in got] == [key(w) for w in words]


def test_a_words_display_is_a_trim(spark):
    words = ["(hola!)", "¿Qué?", "“a.b”", "...", "", "a(b)c", "()x¡", "it's", "—a—", "日本。"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(text.display(F.col("w")).alias("a"), text.word_display(F.col("w")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)
