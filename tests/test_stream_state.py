"""A stream with a state for each key: restarts, late rows, forgetting, counters."""

import time

import pytest
from pyspark.sql import functions as F

from placeflow.functions import geo
from placeflow.streaming import state

SCHEMA = "cell long, page long, rank long, key string, lat double, lon double, ts timestamp"
BOX = (0.0, 0.0, 1.0, 1.0)


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.01)  # files are read in the order of their times


def row(cell, key, at="2024-01-01 00:00:00", lat=0.5, page=0, rank=0):
    import datetime

    return (cell, page, rank, key, lat, 0.5, datetime.datetime.fromisoformat(at))


@pytest.fixture()
def inside():
    return geo.in_box(F.col("lat"), F.col("lon"), BOX)


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_each_place_is_kept_once_across_batches_and_restarts(spark, tmp_path, inside):
    given, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    counters = state.Counters()
    spark.streams.addListener(counters)
    try:
        write(spark, given, [row(2, "a"), row(1, "a"), row(1, "b"), row(1, "out", lat=5.0), row(1, None)])
        for more in ([row(0, "a"), row(3, "c"), row(3, "none", lat=None)], [row(4, f"k{i % 3}", rank=i) for i in range(50)]):
            state.collect(source(spark, given), out, checkpoint, inside).awaitTermination()
            write(spark, given, more)
        for _ in range(2):  # the last batch, and a restart with nothing new
            state.collect(source(spark, given), out, checkpoint, inside).awaitTermination()
        for _ in range(50):
            if counters.totals().get("raw") == 58:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counters)
    got = {(r["key"], r["cell"], r["rank"]) for r in spark.read.parquet(out).collect()}
    assert got == {("a", 1, 0), ("b", 1, 0), ("c", 3, 0), ("k0", 4, 0), ("k1", 4, 1), ("k2", 4, 2)}
    assert spark.read.parquet(out).count() == 6
    assert counters.totals() == {"raw": 58, "outside_boundary": 2}
    assert state.PROVIDER not in {k for k, _ in spark.sparkContext.getConf().getAll()} and spark.conf.get(state.PROVIDER, "x") != state.ROCKSDB


def run(spark, tmp_path, **bounds):
    given, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    with state.rocksdb(spark):
        found = state.sightings(source(spark, given), "key", ("cell", "page", "rank"), **bounds)
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return sorted((r["key"], r["times"], r["cell"], r["is_new"]) for r in spark.read.parquet(out).collect())


def test_a_late_row_moves_the_first_without_being_new(spark, tmp_path):
    given = f"file://{tmp_path}/in"
    write(spark, given, [row(5, "a"), row(7, "a"), row(5, "b")])
    assert run(spark, tmp_path) == [("a", 2, 5, True), ("b", 1, 5, True)]
    write(spark, given, [row(3, "a"), row(9, "b")])
    assert run(spark, tmp_path)[-4:] == [("a", 2, 5, True), ("a", 3, 3, False), ("b", 1, 5, True), ("b", 2, 5, False)]


def test_keys_are_forgotten_after_the_horizon(spark, tmp_path):
    given, bounds = f"file://{tmp_path}/in", {"time": "ts", "horizon_ms": 3_600_000, "late": "10 minutes"}
    for rows in ([row(1, "a", "2024-01-01 00:00:00")], [row(2, "a", "2024-01-01 00:50:00")], [row(3, "b", "2024-01-01 05:00:00")], [row(4, "b", "2024-01-01 05:01:00")], [row(5, "a", "2024-01-01 05:10:00")], [row(6, "b", "2024-01-01 01:00:00")]):
        write(spark, given, rows)
    assert run(spark, tmp_path, **bounds) == [("a", 1, 1, True), ("a", 1, 5, True), ("a", 2, 1, False), ("b", 1, 3, True), ("b", 2, 3, False)]


def test_rows_are_combined_before_they_are_shuffled(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("key"), (-F.col("id")).alias("cell"))
    got = state.combined(rows.repartition(4), "key", ("cell",), None)
    assert got.count() <= 8 and got.agg(F.sum("times")).first()[0] == 20_000 and got.agg(F.min("cell")).first()[0] == -19_999


def test_a_key_reaches_the_state_once_however_many_rows_it_has(spark, tmp_path, monkeypatch):
    rows = spark.range(120_000).select((F.col("id") % 5_000).cast("string").alias("key"), (-F.col("id")).alias("cell"))
    met = []
    monkeypatch.setattr(state.shared, "spread", lambda df, *by: met.append((df, by)) or df.repartition(8, *by))
    rows.repartition(4).write.parquet(f"file://{tmp_path}/in")
    state.sightings(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in"), "key", ("cell",))
    assert len(met) == 1 and met[0][1] == ("key",)  # dealt by key before the state
    combined = state.combined(rows.repartition(4), "key", ("cell",), None)
    assert combined.count() <= 4 * 5_000
    folded = state._folded(combined.repartition(8, "key"), "key", ("cell",))
    assert folded.count() == 5_000 and folded.agg(F.sum("times")).first()[0] == 120_000 and folded.agg(F.max("cell")).first()[0] == -115_000


def test_keys_share_groups_read_at_once_or_one_by_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "SHARDS", 2)
    given, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    seen = {}
    for cell, keys in enumerate([[f"k{i}" for i in range(60)] * 2, ["k3", "new"], [f"k{i}" for i in range(61)]]):
        write(spark, given, [row(cell, k, f"2024-01-0{3 - cell} 00:00:00") for k in keys])
        with state.rocksdb(spark):
            found = state.sightings(source(spark, given), "key", ("ts", "cell"))
            stream = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            stream.awaitTermination()
        assert max(p["stateOperators"][0]["numRowsUpdated"] for p in stream.recentProgress if p["stateOperators"]) <= len(set(keys)) + 2  # a state for each key, a size for each shard
        for k in keys:
            seen.setdefault(k, []).append(cell)
        got = {r["key"]: r for r in spark.read.parquet(out).filter(F.col("cell") == cell).collect()}
        assert {k: (r["times"], r["is_new"], r["ts"].day) for k, r in got.items()} == {k: (len(seen[k]), set(seen[k]) == {cell}, 3 - cell) for k in set(keys)}


def test_all_cores_write_and_read_a_batch(spark, sf_dir, monkeypatch):
    from placeflow.plans import queries

    folder = queries.shared.folder(spark, "stream")
    monkeypatch.setattr(queries.shared, "folder", lambda *_: folder)
    queries.QUERIES["stream_state"](spark, sf_dir)
    assert len(spark.read.parquet(f"{folder}/in").inputFiles()) == 3 * spark.sparkContext.defaultParallelism
    assert spark.read.text(f"{folder}/checkpoint/commits/*").select(F.input_file_name()).distinct().count() == 3
