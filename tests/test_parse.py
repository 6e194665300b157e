import json

import pytest
from pyspark.sql import functions as F

from placeflow.operators import parse, quality
from placeflow.sources import recorded
from placeflow.streaming import collect

PLACES = [
    ("ChIJgolden000000000000001", "Golden Coffee Co", 30.27, -97.74, "(512) 555-0001", "1008 E 6th St", "Austin", "0xabc:0x1", "/g/gold1", "dataA", "Coffee shop", "https://goldencoffee.example"),
    ("ChIJbeacon000000000000002", "Beacon Diner", 30.28, -97.73, "(512) 555-0002", "55 Congress Ave", "Austin", "0xdef:0x2", "/g/beac2", "dataB", "Diner", "https://beacondiner.example"),
]


def place_data(p, moved=False):
    pid, name, lat, lon, phone, street, city, hex_id, ftid, data_id, category, site = p
    pd = [None] * 200
    if moved:
        pd[40], pd[80], pd[41], pd[42], pd[43], pd[44], pd[45], pd[46], pd[50] = name, pid, hex_id, ftid, data_id, f"{street}, {city}", [[phone]], [site], [None, None, lat, lon]
    else:
        pd[0], pd[2], pd[7], pd[9], pd[10], pd[11], pd[13], pd[18], pd[78], pd[89], pd[178] = data_id, [street, city], [site], [None, None, lat, lon], hex_id, name, [category], f"{street}, {city}", pid, ftid, [[phone]]
    return pd


def response(spark, entries, current=False):
    raw = [None] * 64 + [[["search metadata"], *([None, e] for e in entries)]] if current else [["q", ["meta", *([None] * 14 + [e] for e in entries)]]]
    return spark.createDataFrame([(json.dumps(raw),)], "raw string").select(F.parse_json("raw").alias("response"))


@pytest.mark.parametrize("current", [False, True])
def test_places(spark, current):
    rows = parse.parse_places(parse.place_entries(response(spark, [place_data(p) for p in PLACES], current))).collect()
    assert [(r["place_id"], r["name"], r["latitude"], r["longitude"], r["phone"], r["street"], r["city"], r["website"], r["categories"]) for r in rows] == [(p[0], p[1], p[2], p[3], p[4], p[5], p[6], p[11], [p[10]]) for p in PLACES]


def test_grouped_record(spark):
    df = parse.grouped(parse.parse_places(parse.place_entries(response(spark, [place_data(PLACES[0])]))))
    record = json.loads(df.select(F.to_json("record", {"ignoreNullFields": "true"}).alias("j")).first()["j"])
    assert record == {
        "name": "Golden Coffee Co", "place_id": PLACES[0][0], "hex_id": "0xabc:0x1", "ftid": "/g/gold1", "data_id": "dataA", "cid": "0xabc:0x1",
        "contact": {"phone": "(512) 555-0001", "website": "https://goldencoffee.example", "google_maps_url": "https://www.google.com/maps/place/?q=place_id:" + PLACES[0][0]},
        "address": {"street": "1008 E 6th St", "city": "Austin", "full": "1008 E 6th St, Austin"},
        "location": {"latitude": 30.27, "longitude": -97.74}, "business": {"categories": ["Coffee shop"]},
    }


@pytest.mark.parametrize("raw", ["null", "[]", "[null]", "{}", "3"])
def test_nothing_to_parse(spark, raw):
    df = spark.createDataFrame([(raw,)], "raw string").select(F.parse_json("raw").alias("response"))
    assert parse.place_entries(df).count() == 0


def test_missing_name_is_unhealthy_and_strict_raises(spark):
    entries = [place_data(p) for p in PLACES]
    for e in entries:
        e[11] = None
    places = parse.parse_core(parse.place_entries(response(spark, entries)))
    assert quality.health(places).first()["problems"] == ["low name coverage"]
    with pytest.raises(quality.DriftError):
        quality.validate(places, strict=True)


def test_moved_layout_heals(spark):
    df = response(spark, [place_data(p, moved=True) for p in PLACES])
    labels = [(i, f, v, None) for i, p in enumerate(PLACES) for f, v in (("name", p[1]), ("place_id", p[0]), ("phone", p[4]))] + [(i, f, None, v) for i, p in enumerate(PLACES) for f, v in (("latitude", p[2]), ("longitude", p[3]))]
    labels = spark.createDataFrame(labels, "label long, field string, value string, number double")
    places, paths, healed = quality.heal(df, labels)
    assert healed and paths["name"] == [40] and paths["latitude"] == [50, 2] and paths["phone"] == [45, 0, 0]
    assert [r["name"] for r in places.collect()] == [p[1] for p in PLACES]


def test_recorded_source_and_collection(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"query": "q", "offset": 20, "lat": 1.5, "lon": 2.5, "body": "[1]"}))
    recorded.register(spark)
    assert tuple(spark.read.format("recorded_search").load(f"file://{tmp_path}/in").first()) == ("q", 20, 1.5, 2.5, "[1]")
    (tmp_path / "austin-1.jsonl").write_text('{"name": "a", "place_id": "P1", "extra": 1}\nnot json\n')
    assert [r["place_id"] for r in recorded.read_collection(spark, f"file://{tmp_path}/austin-1.jsonl").collect()] == ["P1"]
    assert recorded.load_paths(recorded.save_paths({"name": [11]})) == {"name": [11]}
    assert recorded.load_paths("{") is None


def test_stream_collects_each_key_once(spark, tmp_path):
    rows = [(i % 7, 0, i, i % 30, i / 10) for i in range(200)]
    schema = "cell long, page int, rank int, key int, lat double"
    for n in range(2):
        spark.createDataFrame(rows[100 * n : 100 * n + 100], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    collect.collect(stream, f"{tmp_path}/out", f"{tmp_path}/cp", F.col("lat") < 15).awaitTermination()
    keys = [r["key"] for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(keys) == sorted({r[3] for r in rows if r[4] < 15})
