"""Collection as a stream: occurrences in, each key's first row out, counters beside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def first_seen(occurrences: DataFrame, key: str, time: str, horizon: str = "1 hour") -> DataFrame:
    """Rows whose key wasn't seen within the horizon; the watermark bounds the state."""
    return occurrences.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])


def windowed_counts(occurrences: DataFrame, time: str, by: tuple[str, ...], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window, appended once the watermark has passed them."""
    return occurrences.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count(F.lit(1)).alias("n"))


def collect(occurrences: DataFrame, path: str, checkpoint: str, inside: Column, key: str = "key") -> StreamingQuery:
    """Append each batch's new places to `path`, fenced and deduplicated against earlier batches.

    Each batch owns the folder batch=<id>, compares with folders of smaller ids only and overwrites its own, so a
    batch that runs twice gives the same rows once.
    """

    def batch(rows: DataFrame, n: int) -> None:
        kept = rows.filter(inside).groupBy(key).agg(F.min(F.struct("cell", "page", "rank")).alias("at")).select(key, "at.*")
        if n:
            earlier = rows.sparkSession.read.schema(T.StructType([*kept.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
            kept = kept.join(earlier.filter(F.col("batch") < n).select(key), key, "left_anti")
        kept.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return occurrences.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
