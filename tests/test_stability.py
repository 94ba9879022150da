"""A file that is still written is not let in."""

import pytest

from loomdex.streaming import stability as S


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(S.STORE[0])
    spark.conf.set(*S.STORE)
    yield spark
    spark.conf.set(S.STORE[0], before)


def test_sightings_must_agree(rocks, tmp_path):
    spark, seen, box = rocks, f"{tmp_path}/seen", tmp_path / "in"
    box.mkdir()
    out = []

    def step(minute):
        S.sight(spark, str(box), seen, at=f"2024-05-01 10:{minute:02}:00")
        take = lambda df, i: out.extend((r.path.rsplit("/", 1)[1], r.status, r.size_bytes, r.first.minute, r.last.minute) for r in df.collect())
        S.settled(S.sighting_stream(spark, seen)).writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
        got, out[:] = sorted(out), []
        return got

    for name in ("still.txt", "grows.txt", "gone.txt"):
        (box / name).write_text("one")
    assert step(0) == []
    (box / "grows.txt").write_text("three")
    (box / "gone.txt").unlink()
    # each run is a new query from the checkpoint: what was pending is still there
    assert step(2) == [("grows.txt", "changed", 5, 0, 2), ("still.txt", "stable", 3, 0, 2)]
    assert step(4) == [("grows.txt", "stable", 5, 2, 4)]
    # gone.txt has its timer at minute 10; later sightings move the time on
    got = step(20) + step(22)
    assert ("gone.txt", "unconfirmed", 3, 0, 0) in got and not [x for x in got if x[:2] == ("gone.txt", "stable")]


def test_paths_of_a_bucket_do_not_mix_and_each_has_its_time(rocks, tmp_path):
    spark, out = rocks, []
    rows = [(f"p{i}", i, "x", i % 3) for i in range(30)] + [(f"p{i}", i + (i % 4 == 0), "x", 4) for i in range(0, 30, 2)]

    def step(rows):
        made = spark.createDataFrame(rows, "path string, size_bytes long, digest string, minute int")
        made.selectExpr("path", "size_bytes", "digest", "timestamp_seconds(1700000000 + 60 * minute) as at").write.mode("append").parquet(f"{tmp_path}/seen")
        take = lambda df, i: out.extend((r.path, r.status, (r.last - r.first).seconds) for r in df.collect())
        S.settled(S.sighting_stream(spark, f"{tmp_path}/seen"), late="1 hour", buckets=2).writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
        got, out[:] = sorted(out), []
        return got

    twice = range(0, 30, 2)
    assert step(rows) == sorted((f"p{i}", "changed" if i % 4 == 0 else "stable", 60 * (4 - i % 3)) for i in twice)
    # the clock's own pending sighting stays; all that is pending for ten minutes goes
    assert step([("clock", 0, "", 200)]) == sorted((f"p{i}", "unconfirmed", 0) for i in range(30) if i % 2 or i % 4 == 0)
