"""Recorded responses as sources, collections as sinks."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from placeflow.functions import decode
from placeflow.operators import discover

#: The grouped record of a collection, as far as readers need it; unknown fields are dropped.
RECORD = (
    "name string, place_id string, hex_id string, ftid string, data_id string, cid string, "
    "contact struct<phone: string, website: string, google_maps_url: string, emails: array<string>, social_links: map<string, string>, contact_status: string>, "
    "address struct<full: string, street: string, city: string, state: string, postal_code: string, country: string>, "
    "rating struct<rating: double, review_count: bigint>, location struct<latitude: double, longitude: double, found_in_cells: array<string>>, "
    "business struct<categories: array<string>>, is_ad boolean"
)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """(file, raw, kind, response): one whole file a response, decoded to VARIANT; refused ones keep their kind."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("raw"))
    return rows.withColumn("kind", decode.kind(F.col("raw"))).withColumn("response", decode.decoded(F.col("raw")))


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines with their file; lines that aren't JSON are skipped."""
    rows = spark.read.schema(f"{RECORD}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.select("*", F.col("_metadata.file_name").alias("file")).filter("_bad IS NULL").drop("_bad")


def load_places(snapshot: DataFrame, lines: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    return discover.snapshot_precedence(snapshot, lines, key, seq)


#: The CSV's columns and where they come from.
CSV = {
    "name": "name", "place_id": "place_id", "rating": "rating", "reviews": "review_count", "phone": "phone", "website": "website",
    "emails": "emails", "socials": "social_links", "address": "address", "lat": "latitude", "lng": "longitude",
}


def csv_rows(places: DataFrame) -> DataFrame:
    """The eleven columns of the CSV: addresses joined by "; ", links as "platform: url"; null where there is no such column."""

    def column(source: str) -> Column:
        if source not in places.columns:
            return F.lit(None).cast("string")
        if source == "emails":
            return F.array_join(source, "; ")
        if source == "social_links":
            return F.array_join(F.transform(F.array_sort(F.map_entries(source)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
        return F.col(source)

    return places.select(*(column(source).alias(name) for name, source in CSV.items()))


def text_rows(places: DataFrame) -> DataFrame:
    """A line for people: name, rating and the first five categories."""
    return places.select(F.concat_ws(" | ", "name", F.col("rating").cast("string"), F.array_join(F.slice("categories", 1, 5), ", ")).alias("value"))


def write_json(records: DataFrame, path: str) -> None:
    """JSON lines without empty fields. What stood there goes first: `api.Places.collect` writes by run, and so never
    loses what it has."""
    records.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_text(places: DataFrame, path: str) -> None:
    text_rows(places).write.mode("overwrite").text(path)


def write_csv(places: DataFrame, path: str) -> None:
    csv_rows(places).write.mode("overwrite").option("header", "true").csv(path)


def save_paths(paths: dict[str, list[int]]) -> str:
    return json.dumps({"version": 1, "paths": paths}, sort_keys=True)


def load_paths(text: str | None) -> dict[str, list[int]] | None:
    """Saved field paths, or null where there are none that can be read."""
    try:
        return {k: [int(i) for i in v] for k, v in json.loads(text or "")["paths"].items()}
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


class _Files(DataSourceReader):
    """A task a file. Folders named query=... and offset=... say what their files hold, so that the options of
    those names keep other files closed; files elsewhere are opened and say it themselves."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.wanted: dict[str, set] = {name: {options[name]} for name in ("query", "offset") if name in options}

    def files(self) -> list[tuple[int, str]]:
        """(time, path) of the files that may be asked for, in that order."""
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.root)
        found = [(f.mtime_ns or 0, f.path) for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(".json")]
        return sorted(x for x in found if self._asked_for(x[1].removeprefix(root)))

    def _asked_for(self, path: str) -> bool:
        told = dict(part.split("=", 1) for part in path.split("/")[:-1] if "=" in part)
        return all(name not in told or unquote(told[name]) in {str(v) for v in values} for name, values in self.wanted.items())

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(path) for _, path in self.files()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.root)
        with system.open_input_file(partition.value) as f:
            saved = json.loads(f.read())
        if any(str(saved.get(name, "")) not in {str(v) for v in values} for name, values in self.wanted.items()):
            return
        yield str(saved.get("query", "")), int(saved.get("offset", 0)), float(saved.get("lat", 0.0)), float(saved.get("lon", 0.0)), str(saved.get("body", ""))


class _Filtered(_Files):
    """Takes filters from Spark, which then keeps what the last query of a frame asked for: a frame for each query."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute in (("query",), ("offset",)):
                name = f.attribute[0]
                self.wanted[name] = self.wanted.get(name, values) & values
            yield f  # Spark looks at the rows too, as files elsewhere may hold anything


class _NewFiles(DataSourceStreamReader):
    """Files in the order of their times and paths; an offset is the last one read. A file must not appear with an earlier time
    than one that was read."""

    def __init__(self, options: dict):
        self.own = _Files(options)

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = self.own.files()
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return [InputPartition(x[1]) for x in self.own.files() if low < x <= high]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.own.read(partition)

    def commit(self, end: dict) -> None:
        pass


class RecordedSearch(DataSource):
    """spark.read.format("recorded_search").load(uri), or readStream: files {"query", "offset", "lat", "lon", "body"}, a task each.

    Options: path; query, offset (files of others stay closed); filters ("true": a frame's own filters do the same; Spark keeps
    what the last query of a frame asked for, so load a frame for each)."""

    @classmethod
    def name(cls) -> str:
        return "recorded_search"

    def schema(self) -> str:
        return "query string, offset int, lat double, lon double, body string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Filtered(self.options) if self.options.get("filters") == "true" else _Files(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _NewFiles(self.options)


def register(spark: SparkSession) -> None:
    """The sources `recorded_search` and `collection`."""
    from placeflow.sources import sink

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedSearch)
    spark.dataSource.register(sink.Collection)
