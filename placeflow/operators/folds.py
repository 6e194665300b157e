"""Ordered folds as scans: a log's effect as a small value that composes.

A rate control's fold over a log keeps (delay, streak) and clamps the delay at every step, so a log cannot simply be summed. But what
a stretch of the log does is a function of a closed family: some successes, then from the first block on a clamped line
`min(high, max(low, scale * delay + shift))` and the streak left over. Two such functions composed are one again. So a user's log
is cut wherever a range shuffle cuts it, each stretch is composed in its task, and a value for each task and user is
left to be composed in order: a log of any length is spread over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Delays are whole multiples of a ten-thousandth.
UNIT = 10_000


@dataclass(frozen=True)
class Control:
    """Every `needed` successes in a row take `down` off the delay, a block multiplies it by `up` or waits as told, if longer."""

    start: float = 1.5
    least: float = 0.4
    most: float = 8.0
    down: float = 0.1
    up: int = 2
    needed: int = 5

    def __post_init__(self) -> None:
        if self.up != int(self.up) or self.up < 1:
            raise ValueError("`up` must be a whole number: other factors are rounded at every step and don't compose (see metrics.aimd)")
        if any(abs(x * UNIT - round(x * UNIT)) > 1e-6 for x in (self.start, self.least, self.most, self.down)):
            raise ValueError("delays are multiples of 0.0001")

    def units(self, name: str) -> int:
        return round(getattr(self, name) * UNIT)

    @property
    def low(self) -> int:
        return min(self.units("start"), self.units("least"))

    @property
    def high(self) -> int:
        return max(self.units("start"), self.units("most"))


@dataclass
class Steps:
    """Stretches of logs, one in each place of the arrays: successes before the first block; from it on, if there is one, the
    line and its bounds, and the streak at the end."""

    lead: np.ndarray
    blocked: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    low: np.ndarray
    high: np.ndarray
    streak: np.ndarray

    def __getitem__(self, at) -> Steps:
        return Steps(*(getattr(self, f.name)[at] for f in fields(self)))

    def join(self, other: Steps) -> Steps:
        return Steps(*(np.concatenate([getattr(self, f.name), getattr(other, f.name)]) for f in fields(self)))


def single(hit: np.ndarray, told: np.ndarray, control: Control) -> Steps:
    """The steps of single signals: `hit` is a block, `told` its wait in units."""
    n, most = len(hit), control.units("most")
    return Steps(np.where(hit, 0, 1), hit.astype(bool), np.full(n, control.up), np.zeros(n, np.int64), np.minimum(told, most), np.full(n, most), np.zeros(n, np.int64))


def _line(first: tuple, then: tuple) -> tuple:
    """`then` after `first`, each (scale, shift, low, high). A line so steep that a single delay lies between the bounds is
    flattened, which changes none of its values and keeps numbers small."""
    (a, b, low, high), (c, d, floor, ceiling) = first, then
    scale, shift = a * c, c * b + d
    low, high = np.clip(c * low + d, floor, ceiling), np.clip(c * high + d, floor, ceiling)
    gap = np.maximum(high - low, 1)
    at = -((shift - low) // scale)  # the smallest delay whose value reaches `low`
    steep = scale > gap
    return np.where(steep, gap, scale), np.where(steep, np.clip(scale * at + shift, low, high) - gap * at, shift), low, high


def compose(a: Steps, b: Steps, control: Control) -> Steps:
    """What `a` and then `b` do."""
    after = a.streak + b.lead
    eased = after // control.needed
    n = len(after)
    none = eased == 0
    ease = (np.ones(n, np.int64), -eased * control.units("down"), np.where(none, control.low, control.units("least")), np.full(n, control.high))
    line = _line((a.scale, a.shift, a.low, a.high), ease)
    both = _line(line, (b.scale, b.shift, b.low, b.high))
    pick = lambda x, y, z: np.where(~a.blocked, z, np.where(b.blocked, y, x))
    scale, shift, low, high = (pick(x, y, z) for x, y, z in zip(line, both, (b.scale, b.shift, b.low, b.high), strict=True))
    return Steps(np.where(a.blocked, a.lead, a.lead + b.lead), a.blocked | b.blocked, scale, shift, low, high, pick(after % control.needed, b.streak, b.streak))


def composed(owner: np.ndarray, steps: Steps, control: Control) -> tuple[np.ndarray, Steps]:
    """One step for each run of equal owners: neighbours are composed in pairs, again and again."""
    while len(owner) > 1:
        run = np.cumsum(np.concatenate([[0], owner[1:] != owner[:-1]]))
        first = np.searchsorted(run, run)
        place = np.arange(len(owner)) - first
        left = place % 2 == 0
        paired = np.zeros(len(owner), bool)
        paired[:-1] = left[:-1] & (run[1:] == run[:-1])
        if not paired.any():
            break
        at = np.flatnonzero(paired)
        made, single_ = compose(steps[at], steps[at + 1], control), np.flatnonzero(left & ~paired)
        order = np.argsort(np.concatenate([at, single_]), kind="stable")
        steps, owner = made.join(steps[single_])[order], owner[np.concatenate([at, single_])[order]]
    return owner, steps


def applied(steps: Steps, control: Control) -> np.ndarray:
    """The delays after whole logs."""
    eased = steps.lead // control.needed
    delay = np.where(eased > 0, np.maximum(control.units("least"), control.units("start") - eased * control.units("down")), control.units("start"))
    return np.where(steps.blocked, np.clip(steps.scale * delay + steps.shift, steps.low, steps.high), delay) / UNIT


_STEP = [(f.name, pa.bool_() if f.name == "blocked" else pa.int64()) for f in fields(Steps)]
_STEP_SQL = ", ".join(f"{n} {'boolean' if n == 'blocked' else 'long'}" for n, _ in _STEP)


def _runs(batches, schema: pa.Schema, read, control: Control, extra):
    """Compose each run of equal owners in a sorted stream; what the last batch ended with is carried into the next."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column(0).dictionary_encode(null_encoding="encode")
        owner, steps = composed(coded.indices.to_numpy(zero_copy_only=False), read(batch), control)
        names = coded.dictionary.take(pa.array(owner))
        if held is not None and held[0][0] == names[0]:
            steps = compose(held[1], steps[:1], control).join(steps[1:])
        elif held is not None:
            yield _batch(held[0], held[1], schema, extra)
        if len(names) > 1:
            yield _batch(names[:-1], steps[:-1], schema, extra)
        held = names[-1:], steps[-1:]
    if held is not None:
        yield _batch(held[0], held[1], schema, extra)


def _batch(names: pa.Array, steps: Steps, schema: pa.Schema, extra) -> pa.RecordBatch:
    more = extra(steps)
    return pa.RecordBatch.from_arrays([names, *(pa.array(x, f.type) for x, f in zip(more, list(schema)[1:], strict=True))], schema=schema)


def aimd(logs: DataFrame, user: str, order: tuple[str, ...], blocked: Column, retry_after: Column | None = None, control: Control | None = None) -> DataFrame:
    """(user, delay): the delay after each user's log in order; equal to the plain fold, for logs of any length.

    A null `blocked` is a success; a null, negative or missing `retry_after` asks for no wait. It is rounded to four places.
    Users without rows have none. Rows that tie in `order` are taken in any order.
    """
    control = control or Control()
    told = F.lit(0.0) if retry_after is None else F.least(F.greatest(F.coalesce(retry_after, F.lit(0.0)), F.lit(0.0)), F.lit(control.most))
    rows = logs.select(F.col(user).alias("user"), F.coalesce(blocked, F.lit(False)).alias("hit"), F.round(told * UNIT).cast("long").alias("told"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))
    keys = [f"o{i}" for i in range(len(order))]
    dealt = rows.repartitionByRange(int(logs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "user", *keys).sortWithinPartitions("user", *keys).select("user", "hit", "told")
    kind = dict(dealt.dtypes)["user"]

    def stretches(batches):
        part = TaskContext.get().partitionId()
        schema = None

        def read(batch):
            return single(batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False), control)

        for batch in batches:
            schema = pa.schema([("user", batch.schema.field(0).type), ("part", pa.int64()), *_STEP])
            break
        else:
            return
        yield from _runs(_again(batch, batches), schema, read, control, lambda s: [np.full(len(s.lead), part), *(getattr(s, n) for n, _ in _STEP)])

    def delays(batches):
        for batch in batches:
            schema = pa.schema([("user", batch.schema.field(0).type), ("delay", pa.float64())])
            break
        else:
            return

        def read(batch):
            return Steps(*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, len(_STEP) + 1)))

        yield from _runs(_again(batch, batches), schema, read, control, lambda s: [applied(s, control)])

    parts = dealt.mapInArrow(stretches, f"user {kind}, part long, {_STEP_SQL}").repartition("user").sortWithinPartitions("user", "part").drop("part")
    return parts.mapInArrow(delays, f"user {kind}, delay double").withColumnRenamed("user", user)


def _again(first, rest):
    yield first
    yield from rest
