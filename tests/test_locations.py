import json

import pytest

from placeflow import registry
from placeflow.operators import locations

PARENT = (33.64, -84.55, 33.89, -84.29)


def hit(name, lat, lon, box, osm_id="1", kind="place"):
    return {"osm_type": "node", "osm_id": osm_id, "class": kind, "type": "suburb", "name": name, "lat": str(lat), "lon": str(lon), "boundingbox": [str(x) for x in box]}


def answers(spark, *bodies):
    return spark.createDataFrame([(n, "Atlanta", json.dumps(b)) for n, b in enumerate(bodies)], "request int, query string, body string")


def test_resolve(spark):
    first = hit("Atlanta", 33.7, -84.4, (33.64, 33.89, -84.55, -84.29), "9")
    rows = locations.resolve(answers(spark, [first, hit("x", 0, 0, (0, 1, 0, 1))], [], [{"name": "no box"}])).collect()
    assert len(rows) == 1 and tuple(rows[0]["box"]) == PARENT and rows[0]["provider_id"] == "node:9"


def test_subareas(spark):
    a = [hit("Midtown", 33.78, -84.38, (33.77, 33.79, -84.39, -84.37), "1"), hit("Outside", 40, -70, (39, 41, -71, -69), "2"), hit(" ", 33.7, -84.4, (33.6, 33.8, -84.5, -84.3), "3"), hit("Shop", 33.7, -84.4, (33.6, 33.8, -84.5, -84.3), "4", "shop")]
    b = [hit("Midtown again", 33.78, -84.38, (33.77, 33.79, -84.39, -84.37), "1"), hit("Edge", 33.95, -84.4, (33.8, 34.1, -84.5, -84.3), "5")]
    rows = locations.subareas(answers(spark, a, b), PARENT).collect()
    assert [r["name"] for r in rows] == ["Midtown", "Edge"]
    assert rows[1]["box"]["max_lat"] == 33.89 and rows[1]["lat"] == pytest.approx(33.845)
    assert locations.subareas(answers(spark, a, b), PARENT, most=1).count() == 1


def test_registry():
    r = registry.default()
    assert r.names("extractor") == ["patterns"] and r.has("repair", "labels") and not r.has("repair", "x")
    with pytest.raises(KeyError):
        r.get("extractor", "x")
    assert set(r.resolve({"extractor": "patterns"})) == {"extractor"}
