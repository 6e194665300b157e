"""A collection as a sink: JSON lines and their manifest, committed together.

    df.write.format("collection").mode("append").option("query", "shops").save(uri)
    df.writeStream.format("collection").option("path", uri).option("checkpointLocation", ...).start()

Tasks write files of names of their own. A commit writes one line of the manifest, which names the files and counts their rows,
beside its place and then moves it there. Readers go by the manifest, so what a failed task, a repeated attempt or a broken
job left is never read; `vacuum` removes it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

MANIFEST = "version long, batch string, replaces boolean, query string, rows long, schema string, files array<struct<name: string, rows: long>>"


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class _Store:
    """The folder of a collection."""

    def __init__(self, uri: str):
        self.system, self.root = fs.FileSystem.from_uri(uri)

    def names(self, folder: str) -> list[str]:
        found = self.system.get_file_info(fs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file)

    def write(self, name: str, parts: Iterator[bytes]) -> None:
        self.system.create_dir(f"{self.root}/{name}".rpartition("/")[0], recursive=True)
        with self.system.open_output_stream(f"{self.root}/{name}", compression=None) as out:
            for part in parts:
                out.write(part)

    def put(self, name: str, data: bytes) -> None:
        """Whole or not at all."""
        beside = f"{name.rpartition('/')[0]}/_{uuid.uuid4().hex}"
        self.write(beside, iter([data]))
        self.system.move(f"{self.root}/{beside}", f"{self.root}/{name}")

    def remove(self, name: str) -> None:
        try:
            self.system.delete_file(f"{self.root}/{name}")
        except FileNotFoundError:
            pass


def _lines(batch: pa.RecordBatch) -> bytes:
    rows = ({k: v for k, v in r.items() if v is not None} for r in batch.to_pylist())
    return b"".join(json.dumps(r, ensure_ascii=False, default=str).encode() + b"\n" for r in rows)


class _Writer:
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.uri, self.query, self.schema, self.overwrite = options["path"], options.get("query"), schema.json(), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, name, rows = _Store(self.uri), f"data/{uuid.uuid4().hex}.jsonl", 0
        first = next((b for b in iterator if b.num_rows), None)
        if first is None:
            return Written(None, 0)

        def parts():
            nonlocal rows
            for batch in chain([first], iterator):
                rows += batch.num_rows
                yield _lines(batch)

        try:
            store.write(name, parts())
        except BaseException:
            store.remove(name)  # this attempt's; another one writes a file of its own
            raise
        return Written(name, rows)

    def _commit(self, messages: list[Written | None], batch: str | None) -> None:
        store = _Store(self.uri)
        done = [m for m in messages if m is not None and m.name]
        before = store.names("manifest")
        version = 1 + max((int(n.split("-")[0]) for n in before if n[0].isdigit()), default=0)
        name = f"{version:012d}-{batch or uuid.uuid4().hex}.json"
        if batch is not None and any(n.endswith(f"-{batch}.json") for n in before):  # the batch was committed before a restart
            self._remove(messages)
            return
        line = {"version": version, "batch": batch, "replaces": self.overwrite, "query": self.query, "rows": sum(m.rows for m in done), "schema": self.schema, "files": [{"name": m.name, "rows": m.rows} for m in done]}
        store.put(f"manifest/{name}", json.dumps(line).encode() + b"\n")

    def _remove(self, messages: list[Written | None]) -> None:
        store = _Store(self.uri)
        for m in messages:
            if m is not None and m.name:
                store.remove(m.name)


class _BatchWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._commit(messages, None)

    def abort(self, messages: list[Written | None]) -> None:
        self._remove(messages)


class _StreamWriter(_Writer, DataSourceStreamArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        super().__init__(options, schema, overwrite)
        self.name = options.get("name", "stream")

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self._commit(messages, f"{self.name}-{batchId}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._remove(messages)


class Collection(DataSource):
    """Options: path; query (kept in the manifest); name (of a stream: tells its batches from another's)."""

    @classmethod
    def name(cls) -> str:
        return "collection"

    def schema(self) -> str:
        return "key string"  # of what is read without one; `read` knows the collection's own

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _BatchWriter(self.options, schema, overwrite)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self.options, schema, overwrite)


def manifest(spark: SparkSession, uri: str) -> DataFrame:
    """A row for each commit: version, batch, replaces, query, rows, schema, files."""
    return spark.read.schema(MANIFEST).json(f"{uri}/manifest")


def _live(uri: str) -> list[dict]:
    """The commits since the last one that replaced what was there."""
    store, out = _Store(uri), []
    for name in store.names("manifest"):
        if not name.startswith("_"):
            with store.system.open_input_file(f"{store.root}/manifest/{name}") as f:
                line = json.loads(f.read())
            out = [line] if line["replaces"] else [*out, line]
    return out


def read(spark: SparkSession, uri: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of all commits, with the schema of the last one."""
    commits = _live(uri)
    if not commits:
        raise FileNotFoundError(f"{uri} holds no collection")
    schema = schema or T.StructType.fromJson(json.loads(commits[-1]["schema"]))
    files = [f"{uri}/{f['name']}" for c in commits for f in c["files"]]  # names only, as any listing
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)


def summary(spark: SparkSession, uri: str) -> DataFrame:
    """One row: commits and rows that count."""
    commits = _live(uri)
    return spark.range(1).select(F.lit(len(commits)).alias("commits"), F.lit(sum(c["rows"] for c in commits)).cast("long").alias("rows"))


def vacuum(uri: str) -> int:
    """Remove data files that no commit names, and those of replaced commits; how many went. Not while a job writes."""
    store, named = _Store(uri), {f["name"] for c in _live(uri) for f in c["files"]}
    gone = [n for n in store.names("data") if f"data/{n}" not in named]
    for n in gone:
        store.remove(f"data/{n}")
    return len(gone)
