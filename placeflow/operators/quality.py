"""Health of parsed batches and re-derivation of where fields stand."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeflow.errors import DriftError
from placeflow.operators import parse, shared

#: The least coverage of a healthy batch.
LEAST = {"name": 0.90, "place_id": 0.90, "coords": 0.80}


def health(places: DataFrame, by: tuple[str, ...] = (), min_results: int = 1) -> DataFrame:
    """(by..., total, with_name, with_place_id, with_coords, coverages, problems, healthy), a row for each batch."""
    def has(c: str) -> Column:
        return F.coalesce(F.col(c) != "", F.lit(False))

    total = F.count(F.lit(1))
    rows = places.groupBy(*by).agg(total.alias("total"), F.count_if(has("name")).alias("with_name"), F.count_if(has("place_id")).alias("with_place_id"), F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("with_coords"))
    for name in LEAST:
        rows = rows.withColumn(f"{name}_coverage", F.when(F.col("total") > 0, F.col(f"with_{name}") / F.col("total")).otherwise(0.0))
    few = F.when(F.col("total") < min_results, "few results")
    low = [F.when((F.col("total") > 0) & (F.col(f"{n}_coverage") < least), f"low {n} coverage") for n, least in LEAST.items()]
    rows = rows.withColumn("problems", F.filter(F.array(few, *low), lambda p: p.isNotNull()))
    return rows.withColumn("healthy", F.size("problems") == 0)


def validate(places: DataFrame, strict: bool = False, min_results: int = 1) -> DataFrame:
    """The batch's health; with `strict` an unhealthy batch raises DriftError."""
    report = health(places, min_results=min_results)
    if strict:
        row = report.first()
        if not row["healthy"]:
            raise DriftError("; ".join(row["problems"]))
    return report


#: Lists inside each other that a search follows at most; JSON itself is parsed to that depth.
DEEPEST = 1000


def leaf_paths(entries: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(keep..., path, kind, text, number): every text, number and boolean of `pd`, however many lists deep; a recursive query
    goes a list deeper each turn. Objects aren't entered. Text values are as they are, numbers as double."""
    names = ", ".join(f"`{c}`" for c in keep)
    walked = entries.sparkSession.sql(
        f"""WITH RECURSIVE walk({names}, path, node) MAX RECURSION LEVEL {DEEPEST} AS (
              SELECT {names}, CAST(array() AS array<int>), pd FROM {{entries}}
              UNION ALL
              SELECT {', '.join(f'walk.`{c}`' for c in keep)}, concat(path, array(child.pos)), child.value
              FROM walk, LATERAL variant_explode(node) AS child WHERE startswith(schema_of_variant(node), 'ARRAY'))
            SELECT {names}, path, schema_of_variant(node) AS kind, try_variant_get(node, '$', 'string') AS text, try_variant_get(node, '$', 'double') AS number FROM walk""",
        entries=entries.select(*keep, "pd"),
    )
    return walked.filter("kind IS NOT NULL AND kind NOT LIKE 'ARRAY%' AND kind NOT LIKE 'OBJECT%' AND kind != 'VOID'")


@contextmanager
def unlimited(spark: SparkSession) -> Iterator[None]:
    """Recursive queries that run inside may give any number of rows."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, -1)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def rederive(entries: DataFrame, labels: DataFrame, entry: str = "entry", label: str = "label") -> DataFrame:
    """(field, path, votes): for each core field the path at which most labelled places show their known value.

    `labels` is long: (label, field, value string, number double). A label belongs to the first entry that
    holds one of its identifying texts; of several places of a value the first in list order counts; ties
    between paths go to the one of the smallest label. Labels meet the leaves of their own entry only.
    """
    spark = entries.sparkSession
    entries = shared.kept(entries.select(entry, "pd"), shared.folder(spark, "entries"))  # decoded once
    with unlimited(spark):
        leaves = shared.kept(leaf_paths(entries, (entry,)), shared.folder(spark, "leaves"))
    texts = leaves.filter("kind = 'STRING'").select(entry, "path", F.concat(F.lit("s:"), "text").alias("v"))
    numbers = leaves.filter("kind != 'STRING' AND kind != 'BOOLEAN' AND number IS NOT NULL").select(entry, "path", F.concat(F.lit("n:"), F.round(F.col("number") * 1e6).cast("long").cast("string")).alias("v"))
    known = labels.select(label, "field", F.coalesce(F.concat(F.lit("n:"), F.round(F.col("number") * 1e6).cast("long").cast("string")), F.concat(F.lit("s:"), "value")).alias("v"))
    values = texts.unionByName(numbers)
    earliest = values.groupBy("v").agg(F.min(entry).alias("anchor"))  # a value of many places meets each label once
    anchor = known.filter(F.col("field").isin("place_id", "hex_id", "ftid", "name")).join(earliest, "v").groupBy(label).agg(F.min("anchor").alias(entry))
    first = known.join(anchor, label).join(values, [entry, "v"]).groupBy(label, "field").agg(F.min("path").alias("path"))
    votes = first.groupBy("field", "path").agg(F.count(F.lit(1)).alias("votes"), F.min(label).alias("seen"))
    best = Window.partitionBy("field").orderBy(F.desc("votes"), "seen")
    return votes.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").select("field", "path", "votes")


def heal(responses: DataFrame, labels: DataFrame, repair: Callable[[DataFrame, DataFrame], dict[str, list[int]] | None] | None = None, strict: bool = False, keep: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, list[int]], bool]:
    """(places, paths, healed): parse; if the batch is unhealthy, repair the paths and adopt them only if the new parse
    is healthy. With `strict` a batch that stays unhealthy raises. `repair` may be any callable that gives paths."""
    entries = parse.place_entries(responses).withColumn("entry", F.col("pos"))
    paths = {k: list(p) for k, p in parse.CORE_PATHS.items()}
    places = parse.parse_core(entries, paths, keep)
    if health(places).first()["healthy"]:
        return places, paths, False
    found = (repair or _by_labels)(entries, labels)
    if found:
        again = parse.parse_core(entries, paths | found, keep)
        if health(again).first()["healthy"]:
            return again, paths | found, True
    if strict:
        validate(places, strict=True)
    return places, paths, False


def _by_labels(entries: DataFrame, labels: DataFrame) -> dict[str, list[int]] | None:
    rows = rederive(entries, labels).collect()  # ten fields at most
    return {r["field"]: list(r["path"]) for r in rows} or None


def canary(places: DataFrame, min_results: int = 1) -> DataFrame:
    return health(places, min_results=min_results).select("healthy", "problems")
