"""T-02: which lookups are made, the others being answered by one made less than their time to live before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.skew import durable

# Seconds to live.
LOOKUP_TTL = 600
DETAIL_TTL = 3_600
# Pointers double each round: paths of up to 2 ** ROUNDS made lookups of one key.
ROUNDS = 50


def remembered(lookups: DataFrame) -> DataFrame:
    """Failed lookups are not remembered, not-found ones are."""
    return lookups.where(~F.col("outcome").eqNullSafe("neterror")) if "outcome" in lookups.columns else lookups


def _times(lookups: DataFrame, keys) -> DataFrame:
    """Distinct key and time, the key as one value (so that null is a key, too) and the time in microseconds as well."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return (
        remembered(lookups).where("ts IS NOT NULL").select(F.struct(*keys).alias("k"), micros.alias("t"), "ts")
        .groupBy("k", "t").agg(F.first("ts").alias("ts"))
    )


def successors(times: DataFrame, ttl_micros: int) -> DataFrame:
    """``k``, ``t``, ``ts`` and ``jump``: the first time of the key at least ``ttl_micros`` after ``t``, or null.

    Times and the moments they expire are put in one order and cut into ranges that are written down once. A range finds the next
    time of each of its moments alone; where it has none, the first time of the key in a later range is carried over. Only the
    key that goes on over a border needs that, so there are no more of these than ranges, and they can be broadcast.
    """
    points = times.select("k", F.col("t").alias("at"), F.col("t").alias("point"), F.lit(None).cast(times.schema["ts"].dataType).alias("ts"))
    ends = times.select("k", (F.col("t") + ttl_micros).alias("at"), F.lit(None).cast("long").alias("point"), "ts")
    both = durable(points.unionByName(ends).repartitionByRange("k", "at").withColumn("range", F.spark_partition_id()))
    # Descending, so that one running minimum looks at all later times of the range, those of the same moment included.
    later = Window.partitionBy("k", "range").orderBy(F.desc("at"))
    firsts = both.groupBy("k", "range").agg(F.min("point").alias("first"))
    beyond = Window.partitionBy("k").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = firsts.select("k", "range", F.min("first").over(beyond).alias("carried")).where("carried IS NOT NULL")
    found = both.withColumn("found", F.min("point").over(later)).where("point IS NULL")
    return found.join(F.broadcast(carried), ["k", "range"], "left").select(
        "k", (F.col("at") - ttl_micros).alias("t"), "ts", F.coalesce("found", "carried").alias("jump")
    )


def fresh_lookups(lookups: DataFrame, keys=("user_id", "event_type"), ttl_seconds: int = LOOKUP_TTL) -> DataFrame:
    """T-02 on a batch: the lookups that are made.

    The first lookup of a key is made; after one, the next is the first at least ``ttl_seconds`` later. Each time gets that
    successor, and the ones reached from the first are marked by pointer doubling: each round the marked ones mark what they
    point to, and pointers go twice as far, so a path of n made lookups takes log2(n) rounds of two joins, each written to the
    shared folder. All rows of a key are dealt by time, however many it has.

    Returns the keys and ``ts``; lookups of a key at one time are one; null keys are keys; lookups without a time are dropped.
    """
    times = _times(lookups, keys)
    nodes = successors(times, ttl_seconds * 1_000_000)
    starts = nodes.groupBy("k").agg(F.min("t").alias("start"))
    now = durable(nodes.join(starts, "k").select("k", "t", "ts", "jump", (F.col("t") == F.col("start")).alias("made")))
    for _ in range(ROUNDS):
        hits = now.where("made AND jump IS NOT NULL").select("k", F.col("jump").alias("t")).distinct().withColumn("hit", F.lit(True))
        further = now.select("k", F.col("t").alias("jump"), F.col("jump").alias("further"))
        step = now.join(hits, ["k", "t"], "left").join(further, ["k", "jump"], "left")
        now = durable(step.select("k", "t", "ts", F.col("further").alias("jump"), (F.col("made") | F.coalesce("hit", F.lit(False))).alias("made")))
        if now.where("jump IS NOT NULL").isEmpty():
            break
    return now.where("made").select("k.*", "ts")


class _Suppressor(StatefulProcessor):
    """Lookups of a key wait for the watermark and are then judged in order of time."""

    def __init__(self, keys: list[str], schema: T.StructType, ttl_micros: int):
        self.keys, self.schema, self.ttl = keys, schema, ttl_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        moment = T.StructType([T.StructField("micros", T.LongType())])
        self.last = handle.getValueState("last", moment)
        self.waiting = handle.getMapState("waiting", moment, T.StructType([T.StructField("there", T.BooleanType())]))

    def _wake(self, micros: int) -> None:
        """A timer fires when the watermark is past it, so one millisecond before covers the whole millisecond."""
        self.handle.registerTimer(micros // 1_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            for t in frame["ts"]:
                micros = t.value // 1_000
                if not self.waiting.containsKey((micros,)):
                    self.waiting.updateValue((micros,), (True,))
                    earliest = micros if earliest is None else min(earliest, micros)
        if earliest is not None:
            self._wake(earliest)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Judge all that the watermark has passed; what is made is remembered until it expires."""
        mark = timerValues.getCurrentWatermarkInMs() * 1_000
        waiting = sorted(k[0] for k in self.waiting.keys())
        due = [m for m in waiting if m < mark]
        last = self.last.get()[0] if self.last.exists() else None
        made = []
        for micros in due:
            if last is None or micros - last >= self.ttl:
                made.append(micros)
                last = micros
            self.waiting.removeKey((micros,))
        if len(due) < len(waiting):
            self._wake(waiting[len(due)])
        if last is not None:
            if mark - last >= self.ttl:
                self.last.clear()
            else:
                self.last.update((last,))
                self._wake(last + self.ttl)
        if made:
            moments = pd.to_datetime(pd.Series(made), unit="us")
            yield pd.DataFrame({**{n: [v] * len(made) for n, v in zip(self.keys, key, strict=True)}, "ts": moments})[self.schema.names]

    def close(self) -> None:
        pass


def fresh_lookup_stream(
    lookups: DataFrame, keys=("user_id", "event_type"), ttl_seconds: int = LOOKUP_TTL, delay: str | None = None
) -> DataFrame:
    """T-02 on a stream, in append mode: the same rows as ``fresh_lookups``, each when the watermark is past it.

    Lookups may come in any order within ``delay`` (the time to live, unless told). Those of a key wait as state, one entry for
    each distinct time, until the watermark has passed them, and are judged in order; a timer per key wakes the earliest. The
    last lookup made is kept until it has expired by the watermark, then the key leaves the state. A lookup that comes later
    than ``delay`` is dropped: it neither is made nor answers another. State is kept by the RocksDB store, which the session sets
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    keys = list(keys)
    source = remembered(lookups).withWatermark("ts", delay or f"{ttl_seconds} seconds").select(*keys, "ts")
    processor = _Suppressor(keys, source.schema, ttl_seconds * 1_000_000)
    return source.groupBy(*keys).transformWithStateInPandas(processor, source.schema, "Append", "EventTime")
