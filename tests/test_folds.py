"""Rate control as a scan against the plain fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeflow.operators import folds


def plain(hits, waits, c):
    delay, streak = c.start, 0
    for hit, wait in zip(hits, waits, strict=True):
        if hit:
            delay, streak = min(c.most, round(max(delay * c.up, wait), 4)), 0
        elif streak + 1 >= c.needed:
            delay, streak = max(c.least, round(delay - c.down, 4)), 0
        else:
            streak += 1
    return delay


CONTROLS = [folds.Control(), folds.Control(needed=1), folds.Control(start=0.1, least=0.4), folds.Control(start=20.0, up=3, down=0.0007, needed=2), folds.Control(up=1, needed=3)]


@pytest.mark.parametrize("control", CONTROLS)
def test_stretches_cut_anywhere_compose_to_the_fold(control):
    rng = np.random.default_rng(7)
    for share in (0.0, 0.03, 0.2, 0.6, 1.0):
        for n in (1, 2, 7, 300):
            hits = rng.random(n) < share
            waits = np.where(rng.random(n) < 0.3, np.round(rng.random(n) * 9, 4), 0)
            steps = folds.single(hits, np.round(waits * folds.UNIT).astype(np.int64), control)
            cuts = np.sort(rng.integers(0, n, 5)).searchsorted(np.arange(n), side="right")
            _, stretches = folds.composed(cuts, steps, control)
            _, whole = folds.composed(np.zeros(len(stretches.lead), int), stretches, control)
            assert folds.applied(whole, control)[0] == pytest.approx(plain(hits, waits, control), abs=1e-9)


def test_long_logs_keep_numbers_small():
    control, rng = folds.Control(needed=1), np.random.default_rng(1)
    hits = rng.random(200_000) < 0.2
    _, whole = folds.composed(np.zeros(len(hits), int), folds.single(hits, np.zeros(len(hits), np.int64), control), control)
    assert abs(whole.shift[0]) < 10**12 and whole.scale[0] <= control.high
    assert folds.applied(whole, control)[0] == pytest.approx(plain(hits, np.zeros(len(hits)), control))


def test_a_user_of_a_third_of_all_events_is_spread(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("u"), (F.col("id") % 40).cast("string"))).alias("who"), F.col("id").alias("at"), (F.hash("id") % 5 == 0).alias("bad"), F.when(F.col("id") % 7 == 0, F.col("id") % 11 * 0.25).alias("wait"))
    logs = {}
    for r in rows.orderBy("at").collect():
        logs.setdefault(r["who"], []).append((r["bad"], r["wait"] or 0.0))
    got = {r["who"]: r["delay"] for r in folds.aimd(rows.repartition(6), "who", ("at",), F.col("bad"), F.col("wait")).collect()}
    assert got.keys() == logs.keys() and None in got
    for who, log in logs.items():
        assert got[who] == pytest.approx(plain(*zip(*log, strict=True), folds.Control()))
    hot = folds.aimd(rows, "who", ("at",), F.col("bad"))
    assert "rangepartitioning(user" in hot._jdf.queryExecution().toString()
    assert folds.aimd(rows.limit(0), "who", ("at",), F.col("bad")).count() == 0


def test_what_doesnt_compose_is_refused():
    for bad in ({"up": 1.5}, {"down": 0.00005}):
        with pytest.raises(ValueError):
            folds.Control(**bad)
