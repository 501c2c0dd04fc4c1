import datetime as dt
import os
import pathlib
import random

from pyspark.sql import functions as F

from songframe.streaming import lines, status


def test_new_files_are_taken_once(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    run = lambda: lines.process_new(spark, source, "song long", out, state, lambda df: df.withColumn("twice", F.col("song") * 2)).awaitTermination()
    spark.range(3).withColumnRenamed("id", "song").write.parquet(source)
    run()
    run()
    spark.range(10, 12).withColumnRenamed("id", "song").write.mode("append").parquet(source)
    run()
    assert sorted(r.twice for r in spark.read.parquet(out).collect()) == [0, 2, 4, 20, 22]


def test_note_counts(spark):
    t = dt.datetime(2024, 1, 1, 10)
    rows = spark.createDataFrame([(1, t, "golden"), (1, t + dt.timedelta(minutes=59), "normal"), (1, t + dt.timedelta(hours=1), "normal")], "chart_id long, ts timestamp, kind string")
    assert sorted((r.n, r.golden) for r in lines.note_counts(rows).collect()) == [(1, 0), (2, 1)]


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def streamed(spark, tmp_path, batches, late):
    """Statuses of events (song, second, status) that come in batches, a file each."""
    source = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame([(s, at(t), x) for s, t, x in rows], "song long, at timestamp, status string")
        frame.coalesce(1).write.mode("append").parquet(source)
        name = next(p for p in pathlib.Path(source).glob("part-*.parquet"))
        folder = pathlib.Path(source + "-ordered")
        folder.mkdir(exist_ok=True)
        name.rename(folder / f"{i:04}.parquet")
        os.utime(folder / f"{i:04}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        rows = spark.readStream.schema("song long, at timestamp, status string").option("maxFilesPerTrigger", 1).parquet(source + "-ordered")
        out = str(tmp_path / "out")
        query = status.statuses(rows, late=late).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return sorted((r.song, r.at, r.status) for r in spark.read.parquet(out).collect())


def test_statuses_equal_those_of_a_table(spark, tmp_path):
    """Late, repeated and tied events, timeouts and songs that come back."""
    rng = random.Random(3)
    events = [(s, rng.choice([0, 60, 300]) + 700 * k + rng.choice([0, 0, 900, 1800]) * (k > 2), rng.choice(status.STATES)) for s in range(25) for k in range(rng.randint(1, 6))]
    events += events[:10] + [(50, 0, "queued"), (50, 0, "running"), (51, 0, "running"), (51, 900, "done"), (52, 0, "running"), (52, 901, "done"), (53, 5, "lost"), (54, 0, "queued")]
    events = [(s, t, x) for s, t, x in events]
    events.sort(key=lambda e: e[1] + rng.random() * 1000)  # up to 1,000 seconds late
    batches = [events[i : i + 20] for i in range(0, len(events), 20)]
    end = 20_000
    batches += [[(999, end, "done")], [(999, end + 1, "done")]]
    got = streamed(spark, tmp_path, batches, "2000 seconds")
    table = spark.createDataFrame([(s, at(t), x) for b in batches for s, t, x in b], "song long, at timestamp, status string")
    want = sorted((r.song, r.at, r.status) for r in status.statuses_of(table, at(end - 2000)).collect())
    assert got == want
    assert {x for *_, x in got} == {*status.STATES, status.TIMED_OUT}
    own = {s: [(x, t.replace(tzinfo=None)) for i, t, x in want if i == s] for s in (51, 52, 54)}
    assert [x for x, _ in own[51]] == ["running", "done"] and [x for x, _ in own[52]] == ["running", status.TIMED_OUT, "done"] and [x for x, _ in own[54]] == ["queued", status.TIMED_OUT]
