"""Nodes whose result depends on their own earlier decisions: exact deduplication, correlation, anchored windows and guests.

in_order() hands each branch's rows, sorted, to a small state machine. The rows of a branch stream through one task in
Arrow batches and are never gathered; a branch is sequential by its meaning and can't be split, so that one branch with
very many rows bounds the run time. Memory is what the machine keeps: a window its rows, correlation the unmatched rows within the
horizon. Correlation without a predicate and a horizon needs no machine: windows number the rows, and pairs meet in joins.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import timedelta
from math import ceil, floor
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.functions.expr import SchemaError
from millrace.operators.windows import Aggregate

Row = dict[str, Any]


class Machine(Protocol):
    """One branch's state. On streams, where rows come in the order of time as well, three more functions may be there: due(), the time at which tick(now) has
    something to do although no row comes, and idle(now), whether the state can be forgotten. A machine's attributes are what is kept between triggers."""

    def see(self, row: Row) -> Iterator[Row]:
        """Rows to put out for a row that came."""

    def end(self) -> Iterator[Row]:
        """Rows to put out after the branch's last row."""


def schema_of(fields: str | S.StructType) -> S.StructType:
    return fields if isinstance(fields, S.StructType) else S.StructType.fromDDL(fields)


def batched(rows: Iterator[Row], schema: pa.Schema, most: int = 5000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches; values keep their exact types."""
    out: list[Row] = []
    for row in rows:
        out.append(row)
        if len(out) >= most:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def in_order(df: DataFrame, branch: Sequence[str], order: Sequence[str], machine: Callable[[], Machine], schema: str | S.StructType) -> DataFrame:
    """Run a machine over every branch."""
    made = schema_of(schema)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
        key, at = None, None
        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[c] for c in branch)
                if at is None or own != key:
                    if at is not None:
                        yield from at.end()
                    key, at = own, machine()
                yield from at.see(row)
        if at is not None:
            yield from at.end()

    arrow = to_arrow_schema(made)
    dealt = df.repartition(*[F.col(c) for c in branch]).sortWithinPartitions(*branch, *order)
    return dealt.mapInArrow(lambda batches: batched(rows_of(batches), arrow), made)


def gate(time: str, horizon_seconds: float) -> Callable[[], Machine]:
    """Deduplication of one key."""
    horizon = timedelta(seconds=horizon_seconds)

    class Gate:
        def __init__(self) -> None:
            self.until = None

        def see(self, row: Row) -> Iterator[Row]:
            if self.until is None or row[time] >= self.until:
                self.until = row[time] + horizon
                yield row

        def end(self) -> Iterator[Row]:
            return iter(())

        def due(self) -> Any:
            return self.until

        def idle(self, now: Any) -> bool:
            return self.until is None or now >= self.until

    return Gate


def deduplicate(df: DataFrame, on: Sequence[str], time: str, seq: str, horizon_seconds: float) -> DataFrame:
    """The first row of a key passes; equal keys are suppressed until the horizon has passed since. Suppressed rows don't prolong it."""
    return in_order(df, on, [time, seq], gate(time, horizon_seconds), df.schema)


Make = Callable[[Row, Row], Row]


def correlate(left: DataFrame, right: DataFrame, branch: Sequence[str], time: str, seq: str, schema: str, make: Make, matches: Callable[[Row, Row], bool] | None = None, match: str = "earliest", horizon_seconds: float | None = None, timed_out: Callable[[str, Row], Row | None] = lambda side, row: None, native: bool = True) -> DataFrame:
    """Pair rows of two sides within a branch, one to one: an arriving row takes the earliest or latest waiting row of the other
    side that matches (any, without a predicate), and both are gone. Rows that wait longer than the horizon, or to the end, go to timed_out(side, row).

    Without predicate and horizon the pairs follow from counting and Spark finds them; native=False runs the machine then, too."""
    both = sides(left, right, branch, time, seq)
    if native and matches is None and horizon_seconds is None:
        if match not in {"earliest", "latest"}:
            raise ValueError(f"no match mode {match}")
        return counted(both, branch, time, seq, schema, make, match, timed_out)
    return in_order(both, branch, [time, seq], pairing(time, make, matches, match, horizon_seconds, timed_out), schema)


def sides(left: DataFrame, right: DataFrame, branch: Sequence[str], time: str, seq: str) -> DataFrame:
    """Both sides' rows in one table; __side tells them apart."""
    fields = sorted({*left.columns, *right.columns} - {*branch, time, seq})
    kinds = dict(left.dtypes) | dict(right.dtypes)
    cast = lambda df, side: df.select(*branch, time, seq, F.lit(side).alias("__side"), *[F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in fields])
    return cast(left, "left").unionByName(cast(right, "right"))


def pairing(time: str, make: Make, matches: Callable[[Row, Row], bool] | None, match: str, horizon_seconds: float | None, timed_out: Callable[[str, Row], Row | None]) -> Callable[[], Machine]:
    """Correlation of one branch."""
    if match not in {"earliest", "latest"}:
        raise ValueError(f"no match mode {match}")
    horizon = None if horizon_seconds is None else timedelta(seconds=horizon_seconds)

    class Pairs:
        def __init__(self) -> None:
            # by arrival, so that either end, and any row between, can be taken out at once
            self.waiting: dict[str, OrderedDict[int, Row]] = {"left": OrderedDict(), "right": OrderedDict()}
            self.arrived = 0

        def expire(self, now: Any) -> Iterator[Row]:
            for side, rows in self.waiting.items():
                while rows and next(iter(rows.values()))[time] + horizon < now:
                    if (out := timed_out(side, rows.popitem(last=False)[1])) is not None:
                        yield out

        def see(self, row: Row) -> Iterator[Row]:
            if horizon is not None:
                yield from self.expire(row[time])
            side = row.pop("__side")
            others = self.waiting["right" if side == "left" else "left"]
            pair = (lambda o: (row, o)) if side == "left" else (lambda o: (o, row))
            places = others if match == "earliest" else reversed(others)
            hit = next((k for k in places if matches is None or matches(*pair(others[k]))), None)
            if hit is None:
                self.arrived += 1
                self.waiting[side][self.arrived] = row
            else:
                yield make(*pair(others.pop(hit)))

        def end(self) -> Iterator[Row]:
            for side, rows in self.waiting.items():
                for row in rows.values():
                    if (out := timed_out(side, row)) is not None:
                        yield out

        def due(self) -> Any:
            oldest = [next(iter(rows.values()))[time] for rows in self.waiting.values() if rows]
            return min(oldest) + horizon + timedelta(milliseconds=1) if oldest and horizon is not None else None

        def tick(self, now: Any) -> Iterator[Row]:
            if horizon is not None:
                yield from self.expire(now)

        def idle(self, now: Any) -> bool:
            return not any(self.waiting.values())

    return Pairs


def counted(both: DataFrame, branch: Sequence[str], time: str, seq: str, schema: str, make: Make, match: str, timed_out: Callable[[str, Row], Row | None]) -> DataFrame:
    """Correlation where any rows match. Earliest: the k-th left row meets the k-th right one. Latest: only one side waits at a time, as a stack;
    each arrival moves the signed height by one, and the rows that cross one height meet two by two."""
    w = Window.partitionBy(*branch).orderBy(time, seq)
    if match == "earliest":
        numbered = both.withColumn("__pair", F.row_number().over(Window.partitionBy(*branch, "__side").orderBy(time, seq))).withColumn("__edge", F.lit(0))
    else:
        step = F.when(F.col("__side") == "left", 1).otherwise(-1)
        after = both.withColumn("__after", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        edges = after.withColumn("__edge", F.least(F.col("__after"), F.col("__after") - step)).drop("__after")
        crossing = F.row_number().over(Window.partitionBy(*branch, "__edge").orderBy(time, seq))
        numbered = edges.withColumn("__pair", F.floor((crossing - 1) / 2))
    row = F.struct(*[F.col(c) for c in both.columns if c != "__side"])
    side = lambda name: F.first(F.when(F.col("__side") == name, row), ignorenulls=True).alias(name)
    pairs = numbered.groupBy(*[F.col(c).alias(f"__key_{k}") for k, c in enumerate(branch)], "__edge", "__pair").agg(side("left"), side("right"))
    made = schema_of(schema)
    arrow = to_arrow_schema(made)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = make(a, b) if a and b else timed_out("left", a) if a else timed_out("right", b)
                if out is not None:
                    yield out

    return pairs.select("left", "right").mapInArrow(lambda batches: batched(rows_of(batches), arrow), made)


def anchored_windows(
    df: DataFrame, branch: Sequence[str], time: str, seq: str, schema: str, make: Callable[[list[Row], Any, list[Row]], Row], width_seconds: float | None = None, step_seconds: float | None = None, messages: int | None = None, step_messages: int | None = None, delay_seconds: float = 0.0
) -> DataFrame:
    """Windows of a width by time, anchored to the first buffered row and closed even if nothing follows, by a number of messages, or by both, whichever
    comes first. make(rows, closing time, removed rows) gives the output.

    On closing, what is older than the step leaves: a window closed by messages moves by the step's messages, one closed by time by the step's time,
    and by the other kind if the step has only that. At the end of the data time windows still close, message windows don't. Rows that left
    are handed over as removed for delay_seconds more, counted from the closing that removed them."""
    return in_order(df, branch, [time, seq], buffering(time, make, width_seconds, step_seconds, messages, step_messages, delay_seconds), schema)


def buffering(time: str, make: Callable[[list[Row], Any, list[Row]], Row], width_seconds: float | None = None, step_seconds: float | None = None, messages: int | None = None, step_messages: int | None = None, delay_seconds: float = 0.0) -> Callable[[], Machine]:
    """Windows of one branch."""
    if width_seconds is None and messages is None or step_seconds is None and step_messages is None:
        raise SchemaError("a window has a width and a step")
    for width, step in ((width_seconds, step_seconds), (messages, step_messages)):
        if step is not None and (width is None or not 0 < step <= width):
            raise SchemaError("a step is of a kind that the width has, positive, and no wider")
    width, step = (None if x is None else timedelta(seconds=x) for x in (width_seconds, step_seconds))
    delay = timedelta(seconds=delay_seconds)

    class Buffer:
        def __init__(self) -> None:
            self.rows: deque[Row] = deque()
            self.removed: deque[tuple[Any, Row]] = deque()
            self.start = None

        def close(self, now: Any, by_count: bool) -> Iterator[Row]:
            while self.removed and self.removed[0][0] + delay <= now:
                self.removed.popleft()
            yield make(list(self.rows), now, [r for _, r in self.removed])
            if step is None or (by_count and step_messages is not None):
                gone = [self.rows.popleft() for _ in range(min(step_messages, len(self.rows)))]
                self.start = self.rows[0][time] if self.rows else None
            else:
                self.start = self.start + step
                gone = []
                while self.rows and (self.rows[0][time] < self.start or (by_count and not gone)):
                    gone.append(self.rows.popleft())
                if not self.rows:
                    self.start = None
            if delay:
                self.removed.extend((now, r) for r in gone)

        def see(self, row: Row) -> Iterator[Row]:
            while width is not None and self.rows and row[time] >= self.start + width:
                yield from self.close(self.start + width, False)
            if not self.rows:
                self.start = row[time]
            self.rows.append(row)
            if messages is not None and len(self.rows) >= messages:
                yield from self.close(row[time], True)

        def end(self) -> Iterator[Row]:
            while width is not None and self.rows:
                yield from self.close(self.start + width, False)

        def due(self) -> Any:
            return self.start + width if width is not None and self.rows else None

        def tick(self, now: Any) -> Iterator[Row]:
            while width is not None and self.rows and self.start + width <= now:
                yield from self.close(self.start + width, False)

        def idle(self, now: Any) -> bool:
            return not self.rows and all(at + delay <= now for at, _ in self.removed)

    return Buffer


def releasing() -> Callable[[], Machine]:
    """Rows as they come: what reorders a stream, whose rows come in order."""

    class Release:
        def see(self, row: Row) -> Iterator[Row]:
            yield row

        def end(self) -> Iterator[Row]:
            return iter(())

        def idle(self, now: Any) -> bool:
            return True

    return Release


def aggregated(aggregates: Mapping[str, Aggregate]) -> Callable[[list[Row], Any, list[Row]], Row]:
    """A make() for anchored_windows from the closed set of aggregates. Removed rows count in histogram percentiles only."""

    def of(a: Aggregate, rows: list[Row], removed: list[Row]) -> Any:
        if a.name in {"first", "last"}:
            return rows[0 if a.name == "first" else -1][a.of] if rows else None
        values = [r[a.of] for r in ([*removed, *rows] if a.name == "percentile_linear_histogram" and a.delay_seconds else rows) if r[a.of] is not None]
        if a.name == "count":
            return len(values)
        if not values:
            return None
        if a.name == "percentile_linear_histogram":
            size = (a.high - a.low) / a.buckets
            placed = sorted(min(max(floor((v - a.low) / size), 0), a.buckets - 1) for v in values)
            return a.low + (placed[max(1, ceil(a.percent / 100 * len(placed))) - 1] + 0.5) * size
        return {"min": min, "max": max, "sum": sum}[a.name](values)

    return lambda rows, now, removed: {n: of(a, rows, removed) for n, a in aggregates.items()}


def windows(df: DataFrame, branch: Sequence[str], time: str, seq: str, aggregates: Mapping[str, Aggregate], width_seconds: float | None = None, step_seconds: float | None = None, messages: int | None = None, step_messages: int | None = None) -> DataFrame:
    """anchored_windows with the closed set of aggregates, and the branch and closing time (closed_at) of every window. All histograms that delay do so equally long."""
    delays = {a.delay_seconds for a in aggregates.values() if a.delay_seconds}
    if len(delays) > 1:
        raise SchemaError("histograms with different delays go to windows of their own")
    kinds = dict(df.dtypes)
    result = {"count": "long", "percentile_linear_histogram": "double"}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in branch), f"`closed_at` {kinds[time]}", *(f"`{n}` {result.get(a.name, kinds[a.of])}" for n, a in aggregates.items())])
    made = aggregated(aggregates)
    make = lambda rows, now, removed: {c: (rows or removed)[0][c] for c in branch} | {"closed_at": now} | made(rows, now, removed)
    return anchored_windows(df, branch, time, seq, schema, make, width_seconds, step_seconds, messages, step_messages, max(delays, default=0.0))


def guest(df: DataFrame, branch: Sequence[str], order: Sequence[str], make: Callable[[], Machine], schema: str | S.StructType) -> DataFrame:
    """A stateful processor written by a user: one machine for each branch."""
    return in_order(df, branch, order, make, schema)


#: Element type of a tensor -> numpy type.
TENSORS = {"F32": np.float32, "F64": np.float64, "I64": np.int64, "I32": np.int32}


def infer(df: DataFrame, model: bytes, inputs: Mapping[str, tuple[str, str, tuple[int | str, ...]]], outputs: Mapping[str, str], schema: str, keep: Sequence[str] = ()) -> DataFrame:
    """Score rows by an ONNX model, whose session each task opens once. inputs: tensor name -> (column, element type, dims), where a dim is a
    number, "dynamic", or "BATCH" for the axis along which rows are put together; outputs: tensor name -> column. schema types the kept columns and the outputs.

    With a BATCH axis the rows of a batch that have the same concrete shapes go to the model together, others one by one; rows keep their
    order. A row whose values are null or don't fit the dims gets null outputs."""
    made = schema_of(schema)
    arrow = to_arrow_schema(made)
    together = any("BATCH" in dims for _, _, dims in inputs.values())
    columns = list(dict.fromkeys([*keep, *(c for c, _, _ in inputs.values())]))

    def tensor(value: Any, kind: str, dims: tuple[int | str, ...]) -> np.ndarray | None:
        own = [d for d in dims if d != "BATCH"]
        try:
            x = np.asarray(value, TENSORS[kind]) if value is not None else None
        except (TypeError, ValueError):
            return None
        fixed = [d for d in own if d != "dynamic"]
        if x is not None and x.ndim < len(own) and own.count("dynamic") <= 1 and x.size % max(1, int(np.prod(fixed))) == 0:
            x = x.reshape([-1 if d == "dynamic" else d for d in own])
        fits = x is not None and x.ndim == len(own) and all(d in ("dynamic", n) for d, n in zip(own, x.shape, strict=True))
        return x if fits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        session = onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])
        for batch in batches:
            rows = [{c: r[c] for c in keep} | dict.fromkeys(outputs.values()) for r in batch.to_pylist()]
            sent = [[tensor(v, kind, dims) for v in batch.column(columns.index(c)).to_pylist()] for c, kind, dims in inputs.values()]
            groups: dict[Any, list[int]] = {}
            for k, parts in enumerate(zip(*sent, strict=True)):
                if all(p is not None for p in parts):
                    groups.setdefault(tuple(p.shape for p in parts) if together else k, []).append(k)
            for members in groups.values():
                feed = {}
                for (name, (_, _, dims)), parts in zip(inputs.items(), sent, strict=True):
                    feed[name] = np.stack([parts[k] for k in members], axis=dims.index("BATCH")) if "BATCH" in dims else parts[members[0]]
                for column, result in zip(outputs.values(), session.run(list(outputs), feed), strict=True):
                    for k, value in zip(members, result if together else [result], strict=True):
                        rows[k][column] = value.tolist() if getattr(value, "ndim", 0) else value.item()
            yield from batched(iter(rows), arrow)

    return df.select(*columns).mapInArrow(run, made)
