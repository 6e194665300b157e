"""Collection as a stream with a state for each key: what was first, how often it was seen, and when it is forgotten.

Unlike a comparison with what earlier batches wrote, a batch costs what it holds, however long the stream has run. Rows
are combined where they arrive, so a key of very many rows sends a row for each block of them, and once more by key, so
the state meets a row for each key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from placeflow.operators import shared

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows that a task gathers before it combines them, and combined rows it holds at most.
BLOCK, MOST_HELD = 100_000, 1_000_000
#: Groups that keys without a horizon are dealt to. State belongs to them: another number needs a new checkpoint.
SHARDS = 4096
#: A shard of so many times the keys that a batch holds of it is no longer read in one go.
SPARSE = 4


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which per-key state needs; the session's choice stays."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def combined(rows: DataFrame, key: str, order: tuple[str, ...], time: str | None) -> DataFrame:
    """A row for each key and block of rows (with `time`: each Arrow batch, as late rows are told apart after it): its first
    row by `order`, how many there were and the last time (µs)."""
    last = F.unix_micros(time) if time else F.lit(0).cast("long")
    rows = rows.select(key, *order, F.lit(1).cast("long").alias("times"), last.alias("last"))
    return _folded(rows, key, order, *((1, 1) if time else ()))


def _folded(rows: DataFrame, key: str, order: tuple[str, ...], block: int = BLOCK, most: int = MOST_HELD) -> DataFrame:
    """Rows of a key made one, as far as a task meets them; it holds at most `most` rows besides those that came since."""

    def first(tables):
        table = pa.concat_tables(tables)
        grouped = table.sort_by([(c, "ascending") for c in (key, *order)]).group_by(key, use_threads=False).aggregate([*((c, "first") for c in order), ("times", "sum"), ("last", "max")])
        columns = [grouped[key], *(grouped[f"{c}_first"] for c in order), grouped["times_sum"], grouped["last_max"]]
        return pa.Table.from_arrays([c.cast(t) for c, t in zip(columns, table.schema.types, strict=True)], schema=table.schema)

    def run(batches):
        held, size, limit = [], 0, block
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size >= limit:
                held = [first(held)]
                size = held[0].num_rows
                if size >= most:
                    yield from held[0].to_batches(max_chunksize=10_000)
                    held, size = [], 0
                limit = max(block, 2 * size)  # sorted anew only once as much has come again
        if held:
            yield from first(held).to_batches(max_chunksize=10_000)

    return rows.mapInArrow(run, rows.schema)


class Sightings(StatefulProcessor):
    """For each key: its first row by order, how often it was seen and when last. A key is forgotten once the watermark has
    passed its last sighting by `horizon_ms`, and then counts as new again."""

    def __init__(self, key: str, order: tuple[str, ...], types: tuple[str, ...], horizon_ms: int | None):
        self.key, self.order, self.types, self.horizon_ms = key, order, types, horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.row = handle, Row(self.key, *self.order, "times", "is_new")
        self.state = handle.getValueState("sightings", ", ".join([*(f"{c} {t}" for c, t in zip(self.order, self.types, strict=True)), "times long", "last long"]))

    def handleInputRows(self, key: tuple, rows: Iterable[Row], timerValues: Any) -> Iterator[Row]:
        known = self.state.get()
        first, times, last = (tuple(known[: len(self.order)]), known[-2], known[-1]) if known else (None, 0, 0)
        for row in rows:
            at = tuple(row[c] for c in self.order)
            first, times, last = at if first is None else min(first, at), times + row["times"], max(last, row["last"])
        self.state.update((*first, times, last))
        if self.horizon_ms is not None and not known:
            self.handle.registerTimer(last // 1000 + self.horizon_ms)
        yield self.row(*key, *first, times, not known)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        known = self.state.get()
        if known:
            due = known[-1] // 1000 + self.horizon_ms
            if due <= timerValues.getCurrentWatermarkInMs():
                self.state.clear()
            else:
                self.handle.registerTimer(due)  # it was seen since
        return iter([])

    def close(self) -> None:
        pass


class ShardedSightings(StatefulProcessor):
    """As `Sightings` with no horizon, for a shard of the keys: what a group costs besides its state's reads and writes (a
    record batch of its own, its key and times asked for) is paid once for many keys. Where a batch holds a good part of a
    shard's keys, their states are read in one go, otherwise one by one."""

    def __init__(self, key: T.StructField, order: tuple[T.StructField, ...]):
        self.key, self.order = key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = Row(self.key.name, *(f.name for f in self.order), "times", "is_new")
        self.state = handle.getMapState("sightings", T.StructType([self.key]), T.StructType([*self.order, T.StructField("times", T.LongType())]))
        self.size = handle.getValueState("size", "n long")

    def handleInputRows(self, key: tuple, rows: Iterable[Row], timerValues: Any) -> Iterator[Row]:
        found: dict[Any, tuple[tuple, int]] = {}
        for _, one, *at, times, _ in rows:
            before = found.get(one)
            found[one] = (tuple(at), times) if before is None else (min(before[0], tuple(at)), before[1] + times)
        (size,), new = self.size.get() or (0,), 0
        at_once = size <= SPARSE * len(found)
        held = {bytes(k) if isinstance(k, bytearray) else k: v for (k,), v in self.state.iterator()} if size and at_once else {}
        for one, (first, times) in found.items():
            known = held.get(one) if at_once else self.state.getValue((one,))
            if known:
                first, times = min(tuple(known[:-1]), first), known[-1] + times
            self.state.updateValue((one,), (*first, times))
            new += not known
            yield self.row(one, *first, times, not known)
        if new:
            self.size.update((size + new,))

    def close(self) -> None:
        pass


def sightings(rows: DataFrame, key: str, order: tuple[str, ...], time: str | None = None, horizon_ms: int | None = None, late: str = "10 minutes") -> DataFrame:
    """(key, the order columns of its first row so far, times, is_new) for each key of each batch.

    `is_new` holds once for a key, in the batch that shows it first; later batches add to `times`, and a late row that comes
    before it by `order` moves its first row, without being new. With `time` and `horizon_ms` the state is bounded: rows that
    come later than `late` behind the newest are dropped, and keys not seen for the horizon are forgotten. Rows without
    a key or an order are skipped.
    """
    rows = rows.dropna(subset=[key, *order, *([time] if time else [])])
    timed = time is not None and horizon_ms is not None
    grouped = combined(rows, key, order, time if timed else None)
    # States give zoned timestamps back without their zone, so they hold microseconds.
    zoned = [c for c in (key, *order) if isinstance(rows.schema[c].dataType, T.TimestampType)]
    grouped = grouped.withColumns({c: F.unix_micros(c) for c in zoned})
    fields = tuple(grouped.schema[c] for c in (key, *order))
    out = T.StructType([*fields, T.StructField("times", T.LongType()), T.StructField("is_new", T.BooleanType())])
    if timed:
        kinds = dict(grouped.dtypes)
        grouped = grouped.withColumn("at", F.timestamp_micros("last")).withWatermark("at", late)
        found = grouped.groupBy(key).transformWithState(Sightings(key, order, tuple(kinds[c] for c in order), horizon_ms), out, "Append", "EventTime")
    else:
        grouped = _folded(shared.spread(grouped, key), key, order)
        shard = F.pmod(F.xxhash64(key), F.lit(SHARDS)).alias("_shard")
        found = grouped.select(shard, key, *order, "times", "last").groupBy("_shard").transformWithState(ShardedSightings(fields[0], fields[1:]), out, "Append", "None")
    return found.withColumns({c: F.timestamp_micros(c) for c in zoned})


class Counters(StreamingQueryListener):
    """Totals of what streams observe under `name`, batch by batch, without a job of their own. A batch that runs again after
    a restart counts once. `batches` maps (query id, batch) to that batch's counters."""

    def __init__(self, name: str = "collection"):
        self.name = name
        self.batches: dict[tuple[str, int], dict[str, int]] = {}

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            self.batches[str(event.progress.id), event.progress.batchId] = seen.asDict()

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass

    def totals(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for one in self.batches.values():
            for k, v in one.items():
                out[k] = out.get(k, 0) + (v or 0)
        return out


def collect(occurrences: DataFrame, path: str, checkpoint: str, inside: Column, key: str = "key", order: tuple[str, ...] = ("cell", "page", "rank"), name: str = "collection", **bounds: Any) -> StreamingQuery:
    """Append each new place inside the fence to `path`, once, across batches and restarts.

    The file sink's log names the files of finished batches, so what a broken batch left is not read. Observed under
    `name`: raw rows and those outside (a `Counters` listener adds them up). `bounds` are those of `sightings`.
    """
    marked = occurrences.withColumn("_in", F.coalesce(inside, F.lit(False)))
    marked = marked.observe(name, F.count(F.lit(1)).alias("raw"), F.count_if(~F.col("_in")).alias("outside_boundary"))
    new = sightings(marked.filter("_in"), key, order, **bounds).filter("is_new").drop("is_new", "times")
    with rocksdb(occurrences.sparkSession):
        return new.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
