"""The collection sink's commits and the recorded source's filters and offsets."""

import json
import os

import pytest
from pyspark.sql import functions as F

from placeflow.sources import recorded, sink


@pytest.fixture(scope="module")
def spark_(spark):
    recorded.register(spark)
    return spark


def rows(spark, n, start=0):
    return spark.range(start, start + n).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") / 2).alias("lat"), F.struct(F.array("id").alias("ids"), F.lit(None).cast("string").alias("none")).alias("more"))


def test_commits_append_and_replace(spark_, tmp_path):
    uri = f"file://{tmp_path}/c"
    with pytest.raises(FileNotFoundError):
        sink.read(spark_, uri)
    rows(spark_, 10).repartition(3).write.format("collection").mode("append").option("query", "shops").save(uri)
    rows(spark_, 5, 10).write.format("collection").mode("append").save(uri)
    assert sorted(map(str, sink.read(spark_, uri).collect())) == sorted(map(str, rows(spark_, 15).collect()))
    assert [(r["version"], r["rows"], r["query"]) for r in sink.manifest(spark_, uri).orderBy("version").collect()] == [(1, 10, "shops"), (2, 5, None)]
    rows(spark_, 2).write.format("collection").mode("overwrite").save(uri)
    assert sink.read(spark_, uri).count() == 2 and tuple(sink.summary(spark_, uri).first()) == (1, 2)
    assert sink.vacuum(uri) > 0 and sink.read(spark_, uri).count() == 2
    rows(spark_, 0).write.format("collection").mode("overwrite").save(uri)
    assert sink.read(spark_, uri).count() == 0


def test_a_failed_task_leaves_nothing(spark_, tmp_path):
    uri = f"file://{tmp_path}/c"
    rows(spark_, 4).write.format("collection").mode("append").save(uri)

    def fails(batches):
        for batch in batches:
            yield batch
            if batch.column(0)[0].as_py() == "k20":
                raise RuntimeError("killed on purpose")

    broken = rows(spark_, 40, 10).repartitionByRange(4, "lat").mapInArrow(fails, rows(spark_, 1).schema)
    with pytest.raises(Exception, match="killed on purpose"):
        broken.write.format("collection").mode("append").save(uri)
    assert sink.read(spark_, uri).count() == 4 and sink.manifest(spark_, uri).count() == 1
    sink.vacuum(uri)
    assert len(os.listdir(tmp_path / "c" / "data")) <= 4


def test_a_stream_commits_each_batch_once(spark_, tmp_path):
    uri, given = f"file://{tmp_path}/c", f"file://{tmp_path}/in"
    for start in (0, 7):
        rows(spark_, 7, start).coalesce(1).write.mode("append").parquet(given)
        source = spark_.readStream.schema(rows(spark_, 1).schema).parquet(given)
        source.writeStream.format("collection").option("path", uri).option("name", "s").option("checkpointLocation", f"file://{tmp_path}/k").trigger(availableNow=True).start().awaitTermination()
    assert sink.read(spark_, uri).count() == 14
    writer = sink._StreamWriter({"path": uri, "name": "s"}, rows(spark_, 1).schema, False)
    writer.commit([], 1)  # the last batch again, as after a restart
    assert sink.read(spark_, uri).count() == 14 and sink.manifest(spark_, uri).filter("batch IS NOT NULL").count() == 2


def record(tmp_path, folder, query, offset, body="x", broken=False):
    path = tmp_path / "r" / folder
    path.mkdir(parents=True, exist_ok=True)
    (path / f"{offset}.json").write_text("{" if broken else json.dumps({"query": query, "offset": offset, "body": body}))


def test_files_that_are_not_asked_for_stay_closed(spark_, tmp_path):
    record(tmp_path, "query=coffee%20shop/offset=0", "coffee shop", 0)
    record(tmp_path, "query=coffee%20shop/offset=20", "coffee shop", 20)
    record(tmp_path, "query=bars/offset=0", "bars", 0, broken=True)
    record(tmp_path, "loose", "coffee shop", 40)
    load = lambda **o: spark_.read.format("recorded_search").options(**o).load(f"file://{tmp_path}/r")
    pushed = {"filters": "true"}
    assert sorted(r["offset"] for r in load(**pushed).filter("query = 'coffee shop'").collect()) == [0, 20, 40]
    assert [r["offset"] for r in load(**pushed).filter("query IN ('coffee shop', 'tea') AND offset = 20").collect()] == [20]
    assert load(**pushed).filter("query = 'tea'").count() == 0
    assert sorted(r["offset"] for r in load(query="coffee shop").collect()) == [0, 20, 40]
    assert load(query="coffee shop", offset=40).count() == 1
    with pytest.raises(Exception, match="JSONDecodeError"):
        load().collect()


def test_new_files_come_as_a_stream(spark_, tmp_path):
    def run():
        df = spark_.readStream.format("recorded_search").load(f"file://{tmp_path}/r")
        df.writeStream.format("parquet").option("path", f"file://{tmp_path}/o").option("checkpointLocation", f"file://{tmp_path}/k").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["query"], r["offset"]) for r in spark_.read.parquet(f"file://{tmp_path}/o").collect())

    record(tmp_path, "a", "q", 0)
    record(tmp_path, "a", "q", 20)
    assert run() == [("q", 0), ("q", 20)]
    record(tmp_path, "b", "z", 0)
    assert run() == [("q", 0), ("q", 20), ("z", 0)]
    assert run() == [("q", 0), ("q", 20), ("z", 0)]
