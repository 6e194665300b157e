"""Reports over requests, runs and candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty).cast("double"))


def error_class(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("rate") | low.contains("429"), "rate_limited").when(low.contains("parse"), "parse").when(low.contains("network") | low.contains("timeout") | low.contains("connect"), "network").otherwise("other")


def run_stats(requests: DataFrame, failed: Column, key: Column, seconds: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Counters of a request log: requests, successful, failed, unique keys, success rate in per cent, per minute."""
    n, bad, unique = F.count(F.lit(1)), F.count_if(failed), F.countDistinct(key)
    return requests.groupBy(*by).agg(n.alias("requests"), (n - bad).alias("successful"), bad.alias("failed"), unique.alias("unique"), ratio(100 * (n - bad), n).alias("success_rate"), ratio(unique * 60, F.max(seconds) - F.min(seconds)).alias("per_minute"))


def completeness(rows: DataFrame) -> DataFrame:
    """With `reasons` in a fixed order and `complete`, from cap_reached, cells_failed, cells_saturated, cells_total, cells_completed."""
    checks = [
        (F.col("cap_reached"), "result cap reached"), (F.col("cells_failed") > 0, "cells failed"),
        (F.col("cells_saturated") > 0, "cells saturated"), (F.col("cells_completed") + F.col("cells_failed") < F.col("cells_total"), "cells unprocessed"),
    ]
    reasons = F.filter(F.array(*(F.when(c, t) for c, t in checks)), lambda r: r.isNotNull())
    return rows.withColumn("reasons", reasons).withColumn("complete", (F.col("cells_total") > 0) & (F.size("reasons") == 0))


def recall(runs: DataFrame, group: str = "city", run: str = "run", key: str = "key", relevant: str = "relevant") -> DataFrame:
    """(group, run, retained, relevant, floor, relevant_floor, recall, relevant_recall): each run against the union of
    its group's runs. Keys are first made distinct, so a run that repeats its keys costs no more."""
    one = runs.groupBy(group, run, key).agg(F.bool_or(relevant).alias("r"))
    per_key = one.groupBy(group, key).agg(F.bool_or("r").alias("r"))
    floors = per_key.groupBy(group).agg(F.count(F.lit(1)).alias("floor"), F.count_if("r").alias("relevant_floor"))
    own = one.groupBy(group, run).agg(F.count(F.lit(1)).alias("retained"), F.count_if("r").alias("relevant"))
    return own.join(floors, group).withColumn("recall", ratio(F.col("retained"), F.col("floor"))).withColumn("relevant_recall", ratio(F.col("relevant"), F.col("relevant_floor")))


def policy_summary(policies: DataFrame, baseline: str, policy: str = "policy") -> DataFrame:
    """Adds unique_per_request and its multiple of the baseline policy's, from retained and requests."""
    rows = policies.withColumn("unique_per_request", ratio(F.col("retained"), F.col("requests"), None))
    base = rows.filter(F.col(policy) == baseline).agg(F.max("unique_per_request").alias("base"))  # one row
    return rows.withColumn("vs_baseline", ratio(F.col("unique_per_request"), base.scalar(), None))


def footprint_leak(dropped: DataFrame, retained: DataFrame, key: str = "key") -> DataFrame:
    """Keys that only ever fell outside their cell's footprint: lost by the filter."""
    return dropped.select(key).distinct().join(retained.select(key).distinct(), key, "left_anti")


def scores(counted: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, fp, fn; without predictions precision is 1, without truth recall is 1."""
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(1.0)
    rows = counted.withColumn("precision", p).withColumn("recall", r)
    both = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def evaluate_sets(cases: DataFrame, got: str, expected: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Micro-averaged scores of array columns."""
    tp, fp, fn = F.size(F.array_intersect(got, expected)), F.size(F.array_except(got, expected)), F.size(F.array_except(expected, got))
    return scores(cases.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in (("tp", tp), ("fp", fp), ("fn", fn)))))


def parse_accuracy(pairs: DataFrame, got: str = "got", expected: str = "expected", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., correct, total, accuracy) over expected fields; 1 where nothing is expected."""
    rows = pairs.groupBy(*by).agg(F.count_if(F.col(got).eqNullSafe(F.col(expected))).alias("correct"), F.count(F.lit(1)).alias("total"))
    return rows.withColumn("accuracy", ratio(F.col("correct"), F.col("total"), 1.0))


def ranked(candidates: DataFrame, score: str = "score", latency: str = "latency_ms") -> DataFrame:
    """Candidates with their rank: the best score first, ties by latency, then name; candidates are few."""
    return candidates.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(latency), "name")).cast("long"))


def promote(candidates: DataFrame, score: str = "score", latency: str = "latency_ms") -> DataFrame:
    return candidates.orderBy(F.desc(score), F.asc(latency), "name").limit(1)


def compare(results: dict[str, DataFrame]) -> DataFrame:
    """One frame of named candidates' scores."""
    return reduce(DataFrame.unionByName, (df.withColumn("name", F.lit(n)) for n, df in results.items()))


def adaptive_timeout(requests: DataFrame, latency: str, by: tuple[str, ...], base: float, least: float = 3.0, samples: int = 15) -> DataFrame:
    """(by..., n, p90, timeout): the value at 0-based rank floor(0.9 n); under `samples` the base holds.

    Ranks come from counts of distinct latencies, so a group with very many requests is not one sorted list.
    """
    counts = requests.groupBy(*by, latency).agg(F.count(F.lit(1)).alias("c"))
    run = Window.partitionBy(*by).orderBy(latency).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("c").over(run)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    p90 = F.min(F.when(F.col("upto") > F.floor(F.col("n") * 0.9), F.col(latency)))
    rows = placed.groupBy(*by).agg(F.max("n").alias("n"), p90.alias("p90"))
    return rows.withColumn("timeout", F.when(F.col("n") >= samples, F.greatest(F.lit(least), F.least(F.lit(base), F.col("p90") * 1.5))).otherwise(F.lit(base)))


def aimd(signals: Column, start: float = 1.5, least: float = 0.4, most: float = 8.0, down: float = 0.1, up: float = 2.0, needed: int = 5) -> Column:
    """The delay after an ordered array<struct<blocked boolean, retry_after double>>: every `needed` successes in a row
    take `down` off, a block multiplies by `up` (or waits as told, if longer)."""
    zero = F.struct(F.lit(start).alias("delay"), F.lit(0).alias("streak"))

    def step(a: Column, x: Column) -> Column:
        hit = a["streak"] + 1 >= needed
        eased = F.when(hit, F.greatest(F.lit(least), F.round(a["delay"] - down, 4))).otherwise(a["delay"])
        backed = F.least(F.lit(most), F.round(F.greatest(a["delay"] * up, F.coalesce(x["retry_after"], F.lit(0.0))), 4))
        return F.struct(F.when(x["blocked"], backed).otherwise(eased).alias("delay"), F.when(x["blocked"] | hit, 0).otherwise(a["streak"] + 1).alias("streak"))

    return F.aggregate(signals, zero, step, lambda a: a["delay"])


def retry_after(header: Column) -> Column:
    """Seconds that a Retry-After header asks for; null where it names no number."""
    return F.try_to_number(F.nullif(F.regexp_extract(header, r"^\s*([0-9]+)\s*$", 1), F.lit("")), F.lit("999999999999")).cast("double")


def first_errors(requests: DataFrame, failed: Column, order: str, most: int = 5) -> DataFrame:
    """The first `most` failed requests: a top-k."""
    return requests.filter(failed).orderBy(order).limit(most)


def batch_parameters(sites: Column) -> Column:
    """struct<concurrency, timeout, max_pages> for a batch of so many sites."""
    n = F.greatest(F.lit(1), sites)
    concurrency = F.least(F.lit(24), F.greatest(F.lit(4), F.ceil(n / 40).cast("int")))
    timeout = F.when(n <= 50, 12.0).when(n <= 500, 9.0).when(n <= 2000, 7.0).otherwise(5.0)
    pages = F.when(n <= 500, 3).when(n <= 2000, 2).otherwise(1)
    return F.struct(concurrency.alias("concurrency"), timeout.alias("timeout"), pages.alias("max_pages"))
