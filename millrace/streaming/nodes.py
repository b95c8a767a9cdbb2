"""Nodes over streams: routes need no state, the others keep keyed state that ends.

Batch and stream share their definitions: routes and unions are the same functions on a streaming DataFrame, and state machines the
same classes. Rows wait until the watermark has passed them and reach their branch's machine in the order of time, so that a
stream gives what the batch gives, whatever the order of arrival; later rows are dropped. Timers close windows and expire waiting rows where no
row comes. A branch's state is removed once its machine is idle, or after its time to live. State needs the RocksDB
provider (see configure()); at-least-once delivery follows from checkpoints.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from millrace.operators import stateful
from millrace.operators.stateful import Machine, schema_of
from millrace.operators.windows import Aggregate, by_time


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def millis(at: datetime) -> int:
    """Milliseconds since 1970; times without a zone count as UTC, as they do for watermarks."""
    return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000)


class InOrder(StatefulProcessor):
    """One branch: the rows that the watermark hasn't passed yet, and a machine that has seen all others."""

    def __init__(self, machine: Callable[[], Machine], time: str, seq: str, fields: list[str], ttl_seconds: float | None, zoned: bool):
        self.machine, self.time, self.seq, self.fields, self.ttl, self.zoned = machine, time, seq, fields, ttl_seconds, zoned

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", S.StructType([S.StructField("raw", S.BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        yield from self.advance([r.asDict(recursive=False) for r in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self.advance([], timerValues.getCurrentWatermarkInMs())

    def advance(self, new: list[dict], now: int) -> Iterator[Row]:
        waiting, kept, last = pickle.loads(self.kept.get()[0]) if self.kept.exists() else ([], None, None)
        machine = self.machine()
        if kept is not None:
            machine.__dict__.update(kept)
        waiting = sorted([*waiting, *new], key=lambda r: (r[self.time], r[self.seq]))
        ready = sum(millis(r[self.time]) <= now for r in waiting)
        at = datetime.fromtimestamp(now / 1000, UTC)
        at = at if self.zoned else at.replace(tzinfo=None)
        for row in waiting[:ready]:
            if self.over(last, row[self.time]):
                yield from self.put(machine.end())
                machine = self.machine()
            last = row[self.time]
            yield from self.put(machine.see(row))
        waiting = waiting[ready:]
        if hasattr(machine, "tick"):
            yield from self.put(machine.tick(at))
        idle = hasattr(machine, "idle") and machine.idle(at)
        dead = self.over(last, at)
        if dead and not idle:
            yield from self.put(machine.end())
        if not waiting and (idle or dead):
            self.kept.clear()
            return
        self.kept.update((pickle.dumps((waiting, None if dead else machine.__dict__, None if dead else last)),))
        due = machine.due() if hasattr(machine, "due") and not dead else None
        ends = [last + timedelta(seconds=self.ttl)] if self.ttl is not None and last and not dead else []
        times = [*(r[self.time] for r in waiting[:1]), *([due] if due else []), *ends]
        if times:
            self.handle.registerTimer(max(now + 1, millis(min(times))))

    def over(self, last: datetime | None, now: datetime) -> bool:
        """Whether a branch has had no row for longer than its time to live."""
        return self.ttl is not None and last is not None and last + timedelta(seconds=self.ttl) < now

    def put(self, rows: Iterator[dict]) -> Iterator[Row]:
        for row in rows:
            yield Row(**{f: row[f] for f in self.fields})

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, branch: Sequence[str], time: str, seq: str, machine: Callable[[], Machine], schema: str | S.StructType, late: str, ttl_seconds: float | None = None) -> DataFrame:
    """Run a machine over every branch of a stream, whose rows come up to late out of order. After ttl_seconds without a row a branch ends as the batch does."""
    made = schema_of(schema)
    processor = InOrder(machine, time, seq, made.fieldNames(), ttl_seconds, stream.schema[time].dataType != S.TimestampNTZType())
    return stream.withWatermark(time, late).groupBy(*branch).transformWithState(processor, made, "Append", "EventTime")


def deduplicate(stream: DataFrame, on: Sequence[str], time: str, seq: str, horizon_seconds: float, late: str = "10 minutes") -> DataFrame:
    """As the batch node: suppressed rows don't prolong the horizon, after which a key is forgotten."""
    return in_order(stream, on, time, seq, stateful.gate(time, horizon_seconds), stream.schema, late)


def reorder(stream: DataFrame, branch: Sequence[str], time: str, seq: str, late: str) -> DataFrame:
    """Each branch's rows in the order of time, ties by arrival; a row waits for late at most."""
    return in_order(stream, branch, time, seq, stateful.releasing(), stream.schema, late)


def correlate(
    left: DataFrame, right: DataFrame, branch: Sequence[str], time: str, seq: str, schema: str, make: stateful.Make, late: str, horizon_seconds: float, matches: Callable[[dict, dict], bool] | None = None, match: str = "earliest", timed_out: Callable[[str, dict], dict | None] = lambda side, row: None
) -> DataFrame:
    """As the batch node; unmatched rows leave when the watermark passes their horizon."""
    machine = stateful.pairing(time, make, matches, match, horizon_seconds, timed_out)
    return in_order(stateful.sides(left, right, branch, time, seq), branch, time, seq, machine, schema, late)


def anchored_windows(stream: DataFrame, branch: Sequence[str], time: str, seq: str, schema: str, make: Callable[[list[dict], object, list[dict]], dict], late: str, ttl_seconds: float | None = None, **bounds) -> DataFrame:
    """As the batch node, by the same bounds; windows close by timers where no row comes."""
    return in_order(stream, branch, time, seq, stateful.buffering(time, make, **bounds), schema, late, ttl_seconds)


def guest(stream: DataFrame, branch: Sequence[str], time: str, seq: str, machine: Callable[[], Machine], schema: str, late: str, ttl_seconds: float) -> DataFrame:
    """A stateful processor written by a user; a branch ends after ttl_seconds without a row."""
    return in_order(stream, branch, time, seq, machine, schema, late, ttl_seconds)


def latest(stream: DataFrame, branch: Sequence[str], time: str, seq: str, late: str = "10 minutes", ttl_seconds: float = 86400) -> DataFrame:
    """Materialised state: every row that is its branch's newest when its turn comes, as a change. The last change is the branch's state (see snapshot())."""

    class Latest:
        def __init__(self) -> None:
            self.best = None

        def see(self, row: dict) -> Iterator[dict]:
            if self.best is None or row[time] > self.best:  # of equal times the first stays
                self.best = row[time]
                yield row

        def end(self) -> Iterator[dict]:
            return iter(())

    return in_order(stream, branch, time, seq, Latest, stream.schema, late, ttl_seconds)


def windowed(stream: DataFrame, branch: Sequence[str], time: str, order: Sequence[str], width: str, step: str, aggregates: Mapping[str, Aggregate], late: str) -> DataFrame:
    """Aligned windows that close when the watermark passes; later rows are dropped."""
    return by_time(stream.withWatermark(time, late), branch, time, order, width, step, aggregates)


def emit(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, mode: str = "append") -> DataStreamWriter:
    """A sink by micro-batches; every None drains what is there and stops."""
    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
    return out.trigger(processingTime=every) if every else out.trigger(availableNow=True)


def keep(batch: DataFrame, number: int, path: str) -> None:
    """Write a micro-batch as a version of its own; a batch that is run again replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/version={number}")


def snapshot(spark: SparkSession, path: str, target: Sequence[str], seq: str) -> DataFrame:
    """The newest row of each target in what keep() has written."""
    versions = spark.read.parquet(path)
    row = F.struct(*[F.col(c) for c in versions.columns if c != "version"])
    return versions.groupBy(*[F.col(c).alias(f"__t{i}") for i, c in enumerate(target)]).agg(F.max_by(row, F.struct(seq, "version")).alias("__row")).select("__row.*")
