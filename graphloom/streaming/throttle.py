"""A sliding limit per key, on tables and on streams, and the append-only activity sink."""

from __future__ import annotations

from bisect import insort
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from graphloom.plans.tables import written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


def decide(times: Iterable[float], accepted: deque, most: int, window: float) -> list[bool]:
    """An event passes if fewer than ``most`` accepted ones lie within the window before it; refused ones do not count.

    An accepted event exactly ``window`` old still counts.
    """
    out = []
    for t in times:
        while accepted and accepted[0] < t - window:
            accepted.popleft()
        ok = len(accepted) < most
        if ok:
            accepted.append(t)
        out.append(ok)
    return out


def stretches(timed: DataFrame, key: str, order: str, window: float) -> DataFrame:
    """``timed`` (with ``_t``) with ``_stretch``: a key's events, cut wherever one comes more than ``window`` after the last.

    Events are dealt by ranges of key and time, so a key of any length is many tasks; the ends of a key's earlier ranges,
    fewer than the ranges, are all that one range needs of the others.
    """
    ranged = written(timed.repartitionByRange(key, "_t", order).withColumn("_part", F.spark_partition_id()), "ranges")
    here = Window.partitionBy("_part", key).orderBy("_t", order)
    of_key = Window.partitionBy(key).orderBy("_part")
    ends = ranged.groupBy("_part", key).agg(F.max("_t").alias("_end")).withColumn("_last", F.lag("_end").over(of_key)).where("_last is not null").drop("_end")
    a, b = ranged.withColumn("_lag", F.lag("_t").over(here)).alias("a"), F.broadcast(ends).alias("b")  # fewer rows than partitions
    before = F.coalesce("_lag", "b._last")
    flagged = a.join(b, (F.col("a._part") == F.col("b._part")) & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "left").select("a.*", F.when(F.col("_t") - before <= window, 0).otherwise(1).alias("_cut"))
    earlier = F.sum("_n").over(of_key.rowsBetween(Window.unboundedPreceding, -1))
    sums = flagged.groupBy("_part", key).agg(F.sum("_cut").alias("_n")).withColumn("_before", earlier).where("_before is not null").drop("_n")
    c, d = flagged.withColumn("_inside", F.sum("_cut").over(here)).alias("c"), F.broadcast(sums).alias("d")  # fewer rows than partitions
    joined = c.join(d, (F.col("c._part") == F.col("d._part")) & F.col(f"c.{key}").eqNullSafe(F.col(f"d.{key}")), "left")
    return joined.select(*[f"c.{x}" for x in timed.columns], (F.col("_inside") + F.coalesce("_before", F.lit(0))).alias("_stretch"))


def throttle_events(events: DataFrame, *, key: str, time: str, order: str, most: int = 30, window: float = 60.0) -> DataFrame:
    """``events`` with ``accepted``.  Within a key events are taken by time, then ``order``; one without a time is refused.

    No decision reaches beyond a pause of more than the window, so each stretch between pauses is decided by itself,
    several of one key in several tasks.  A stretch of at most ``most`` events passes whole, without Python; a longer one
    streams through one task with at most ``most`` times in memory.
    """
    fields = events.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields) + ", accepted boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, accepted = object(), deque()
        for batch in batches:
            flags = []
            starts = (batch["_key"] != batch["_key"].shift()) | (batch["_stretch"] != batch["_stretch"].shift())
            for _, rows in batch.groupby(starts.cumsum(), sort=False):
                name = (rows["_key"].iloc[0], rows["_stretch"].iloc[0])
                if name != current:
                    current, accepted = name, deque()
                flags += decide(rows["_t"], accepted, most, window)
            yield batch[fields].assign(accepted=flags)

    timed = events.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp")) / 1e6)
    cut = stretches(timed.where("_t is not null"), key, order, window)
    one = Window.partitionBy(key, "_stretch")
    counted = cut.withColumn("_n", F.count(F.lit(1)).over(one))
    short = counted.where(F.col("_n") <= most).select(*fields, F.lit(True).alias("accepted"))
    named = counted.where(F.col("_n") > most).withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))
    long = named.repartition(key, "_stretch").sortWithinPartitions(key, "_stretch", "_t", order).mapInPandas(run, schema)
    never = timed.where("_t is null").select(*fields, F.lit(False).alias("accepted"))
    return short.unionByName(long).unionByName(never)


class Throttle(StatefulProcessor):
    """Accepted times of a key, kept until the watermark leaves the window behind."""

    def __init__(self, key: str, most: int, window: float) -> None:
        self.key, self.most, self.window = key, most, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getListState("accepted", "t double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Events of a key in one batch, by time and order; one older than an accepted one counts what was accepted before it."""
        came = pd.concat([r[["t", "n"]] for r in rows]).sort_values(["t", "n"], kind="stable")  # two numbers an event
        passed = [r[0] for r in self.accepted.get()] if self.accepted.exists() else []
        late = int((came["t"] < passed[-1]).sum()) if passed else 0
        flags, times = [], came["t"].tolist()
        recent = deque(passed)
        for t in times[:late]:
            ok = sum(t - self.window <= x <= t for x in passed) < self.most
            flags.append(ok)
            if ok:
                insort(passed, t)
        if late:
            recent = deque(passed)
        flags += decide(times[late:], recent, self.most, self.window)
        passed += [t for t, ok in zip(times[late:], flags[late:], strict=True) if ok]
        oldest = timerValues.getCurrentWatermarkInMs() / 1000 - self.window
        passed = [x for x in passed if x >= oldest]
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if passed:
            self.accepted.put([(x,) for x in passed])
            self.handle.registerTimer(int((passed[-1] + self.window) * 1000) + 1)
        else:
            self.accepted.clear()
        yield pd.DataFrame({self.key: [key[0]] * len(came), "t": came["t"].to_numpy(), "n": came["n"].to_numpy(), "accepted": flags})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.accepted.clear()
        return iter([])

    def close(self) -> None:
        pass


def throttle_stream(events: DataFrame, *, key: str, time: str, order: str, most: int = 30, window: float = 60.0, delay: str = "0 seconds") -> DataFrame:
    """The same on a stream: key, t (seconds), n (``order``) and accepted.

    State is a key's accepted times of the last window; it goes by an event-time timer once the watermark has passed it.
    Events that come in time order are decided as a table's are.  An event older than one accepted in an earlier batch is
    decided by what was accepted in the window before it, and changes no earlier decision; one older than the watermark (``delay`` behind the
    newest event of earlier batches) is dropped.
    """
    events.sparkSession.conf.set(STORE, ROCKSDB)  # timers and lists need it
    seconds = (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("t")
    timed = events.select(F.col(key), F.col(time).cast("timestamp").alias("at"), seconds, F.col(order).cast("long").alias("n")).where("at is not null").withWatermark("at", delay)
    kind = timed.schema[key].dataType.simpleString()
    return timed.groupBy(key).transformWithStateInPandas(Throttle(key, most, window), f"`{key}` {kind}, t double, n long, accepted boolean", "append", "EventTime")


def activity_stream(activities: DataFrame, path: str, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
    """Append a stream of activities as JSON files.

    The checkpoint and the sink's own log make the output exactly once: a stopped stream goes on where it was.
    ``available_now`` takes what there is and ends.
    """
    writer = activities.writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)
