"""Windows by messages and by time over branches, with the closed set of aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import types as T
from millrace.functions.expr import SchemaError


@dataclass(frozen=True)
class Aggregate:
    """name: count, first, last, min, max, sum, or percentile_linear_histogram with percent, buckets, low, high and delay_seconds, for which
    values that a step removed stay in the histogram (stateful.windows() only)."""

    name: str
    of: str
    percent: float = 50.0
    buckets: int = 10
    low: float = 0.0
    high: float = 100.0
    delay_seconds: float = 0.0

    def __post_init__(self) -> None:
        if self.name not in {"count", "first", "last", "min", "max", "sum", "percentile_linear_histogram"}:
            raise SchemaError(f"no aggregate {self.name}")
        if self.name == "percentile_linear_histogram" and not (0 <= self.percent <= 100 and self.buckets > 0 and self.low < self.high):
            raise SchemaError("percent lies in 0 to 100, buckets are positive and low is below high")
        if self.delay_seconds < 0 or (self.delay_seconds and self.name != "percentile_linear_histogram"):
            raise SchemaError("only a histogram has a delay, and none below 0")


def histogram_percentile(values: Column, a: Aggregate) -> Column:
    """Midpoint of the bucket that holds the rank; values outside count for the edge buckets. A list's columns are numbers of equal buckets."""
    width = (a.high - a.low) / a.buckets
    bucket = lambda v: F.least(F.greatest(F.floor((v.cast("double") - a.low) / width), F.lit(0)), F.lit(a.buckets - 1)).cast("int")
    placed = F.array_sort(F.transform(F.filter(values, lambda v: v.isNotNull()), bucket))
    rank = F.greatest(F.lit(1), F.ceil(F.lit(a.percent / 100) * F.size(placed))).cast("int")
    return F.when(F.size(placed) > 0, a.low + (F.get(placed, rank - 1) + 0.5) * width)


def column(a: Aggregate, kind: str, order: Sequence[str], over=None) -> Column:
    """The aggregate's column, over a window or in a group."""
    c, at = F.col(a.of), F.struct(*[F.col(o) for o in order])
    on = (lambda x: x.over(over)) if over is not None else (lambda x: x)
    if a.name == "first":
        return on(F.first(c) if over is not None else F.min_by(c, at))
    if a.name == "last":
        return on(F.last(c) if over is not None else F.max_by(c, at))
    if a.name == "percentile_linear_histogram":
        return histogram_percentile(on(F.collect_list(c)), a)
    if a.name == "sum":
        return on(F.sum(c)).cast(T.spark(T.logical(kind)))
    return on({"count": F.count, "min": F.min, "max": F.max}[a.name](c))


def undelayed(aggregates: Mapping[str, Aggregate]) -> None:
    if any(a.delay_seconds for a in aggregates.values()):
        raise SchemaError("histograms with a delay need stateful.windows()")


def by_messages(df: DataFrame, branch: Sequence[str], order: Sequence[str], width: int, step: int, aggregates: Mapping[str, Aggregate], number: str = "window") -> DataFrame:
    """WIDTH width MESSAGES STEP step MESSAGES: a window each time the buffer is full; rows at the end that fill none are left.
    number counts a branch's windows from 0."""
    if not 0 < step <= width:
        raise SchemaError("a step is at least 1 and no wider than the window")
    undelayed(aggregates)
    kinds = dict(df.dtypes)
    place = F.row_number().over(Window.partitionBy(*branch).orderBy(*order))
    numbered = df.withColumn("__n", place)
    if step == width:
        groups = numbered.groupBy(*branch, F.floor((F.col("__n") - 1) / width).alias(number))
        made = groups.agg(F.count(F.lit(1)).alias("__size"), *[column(a, kinds[a.of], order).alias(n) for n, a in aggregates.items()])
        return made.filter(F.col("__size") == width).drop("__size")
    frame = Window.partitionBy(*branch).orderBy(*order).rowsBetween(1 - width, 0)
    made = numbered.select(*branch, "__n", *[column(a, kinds[a.of], order, frame).alias(n) for n, a in aggregates.items()])
    full = (F.col("__n") >= width) & ((F.col("__n") - width) % step == 0)
    return made.filter(full).withColumn(number, F.floor((F.col("__n") - width) / step)).drop("__n")


def by_time(df: DataFrame, branch: Sequence[str], time: str, order: Sequence[str], width: str, step: str, aggregates: Mapping[str, Aggregate]) -> DataFrame:
    """Windows aligned to the epoch, as Spark's own are; also for streams with a watermark."""
    undelayed(aggregates)
    kinds = dict(df.dtypes)
    made = df.groupBy(*branch, F.window(F.col(time).cast("timestamp"), width, step).alias("__w")).agg(*[column(a, kinds[a.of], order).alias(n) for n, a in aggregates.items()])
    return made.select(*branch, F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *aggregates)
