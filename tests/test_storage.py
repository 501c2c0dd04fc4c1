"""The cache of a stage by song: what is computed, kept, replaced and left alone."""

import pytest
from pyspark.sql import functions as F

from songframe.operators import storage


class Stage:
    """Words of each song's text; remembers which songs it was asked for."""

    def __init__(self):
        self.runs = []

    def __call__(self, songs):
        self.runs.append(sorted(r.id for r in songs.select("id").collect()))
        return songs.where("text <> ''").select("id", F.posexplode(F.split("text", " ")).alias("pos", "word"))


def songs(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def words(rows):
    return sorted((r.id, r.pos, r.word) for r in rows.collect())


def test_only_new_and_changed_songs_are_computed(spark, tmp_path):
    stage, path = Stage(), f"file://{tmp_path}/stage"
    first = [(i, f"a b{i}") for i in range(20)] + [(20, "")]
    want = sorted((i, p, w) for i, t in first for p, w in enumerate(t.split(" ")) if t)
    assert words(storage.by_song(songs(spark, first), "id", stage, path)) == want
    assert words(storage.by_song(songs(spark, first), "id", stage, path)) == want
    changed = [(i, "new" if i == 7 else t) for i, t in first] + [(99, "x y")]
    got = words(storage.by_song(songs(spark, changed), "id", stage, path))
    assert got == sorted((i, p, w) for i, t in changed for p, w in enumerate(t.split(" ")) if t)
    asked = [r for r in stage.runs if r]  # a run first asks for the columns, of no song
    assert asked == [[*range(10), *range(10, 21)], [7, 99]]


def test_options_are_part_of_the_digest(spark, tmp_path):
    stage, path, rows = Stage(), f"file://{tmp_path}/stage", songs(spark, [(1, "a"), (2, "b")])
    for options in ({"k": 1, "j": 2}, {"j": 2, "k": 1}, {"k": 2}):
        assert words(storage.by_song(rows, "id", stage, path, options)) == [(1, 0, "a"), (2, 0, "b")]
    assert [r for r in stage.runs if r] == [[1, 2], [1, 2]]


def test_a_run_that_fails_changes_nothing(spark, tmp_path):
    stage, path = Stage(), f"file://{tmp_path}/stage"
    storage.by_song(songs(spark, [(i, "a") for i in range(9)]), "id", stage, path)

    def broken(rows):
        return stage(rows).withColumn("word", F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("word")))

    with pytest.raises(Exception, match="lost"):
        storage.by_song(songs(spark, [(i, "z") for i in range(9)]), "id", broken, path)
    stage.runs.clear()
    assert words(storage.by_song(songs(spark, [(i, "a") for i in range(9)]), "id", stage, path)) == [(i, 0, "a") for i in range(9)]
    assert not any(stage.runs)


def test_songs_that_are_not_asked_for_stay(spark, tmp_path):
    stage, path = Stage(), f"file://{tmp_path}/stage"
    storage.by_song(songs(spark, [(1, "a"), (2, "b")]), "id", stage, path, parts=1)
    assert words(storage.by_song(songs(spark, [(3, "c")]), "id", stage, path, parts=1)) == [(3, 0, "c")]
    stage.runs.clear()
    assert words(storage.by_song(songs(spark, [(1, "a"), (2, "b"), (3, "c")]), "id", stage, path, parts=1)) == [(1, 0, "a"), (2, 0, "b"), (3, 0, "c")]
    assert not any(stage.runs)
    assert words(storage.by_song(songs(spark, []), "id", stage, path)) == []


def test_nulls_are_values(spark, tmp_path):
    stage, path = Stage(), f"file://{tmp_path}/stage"
    storage.by_song(songs(spark, [(1, None)]), "id", stage, path)
    storage.by_song(songs(spark, [(1, "")]), "id", stage, path)
    assert [r for r in stage.runs if r] == [[1], [1]]
