"""Stateless nodes, and stateful ones that joins, aggregates and windows express.

Time is a column (event time), arrival a sequence column that breaks ties; a branch is a tuple of key columns.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.expr import Expr, SchemaError, of_table
from millrace.operators import stateful
from millrace.operators.route import Message, Route, Routed, apply


def union(sources: Sequence[tuple[DataFrame, Callable[[Message], Expr] | None]]) -> DataFrame:
    """Bag union of sources of one schema, each filtered by its own predicate first."""
    first = sources[0][0].dtypes
    parts = []
    for df, where in sources:
        if df.dtypes != first:
            raise SchemaError("sources have one schema")
        parts.append(df.filter(where(of_table(df)).value) if where else df)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def junction(sources: Sequence[tuple[DataFrame, Callable[[Message], Expr] | None]], routes: Mapping[str, Route], where: Callable[[Message], Expr] | None = None, keep: tuple[str, ...] = (), sensitive: frozenset[str] = frozenset()) -> dict[str, Routed]:
    """Fan in, filter, and fan out into routes."""
    df = union(sources)
    message = of_table(df, sensitive)
    if where is not None:
        test = where(message)
        if test.type != "BOOL" or test.lookups:
            raise SchemaError("a filter is BOOL, and lookups belong to a route's assignments")
        df = df.filter(test.value)
    return {name: apply(df, message, route, keep) for name, route in routes.items()}


def reorder(df: DataFrame, branch: Sequence[str], by: Sequence[Column], seq: str, position: str = "position") -> DataFrame:
    """Each branch in the order of its keys, nulls first and ties by arrival; the place is a column."""
    return df.withColumn(position, F.row_number().over(Window.partitionBy(*branch).orderBy(*[c.asc_nulls_first() for c in by], F.col(seq))))


def first_of_key(df: DataFrame, on: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """Deduplication over a horizon that covers all data: the first row of each key. An aggregate, so that copies meet before the shuffle."""
    keys = [F.col(k) if isinstance(k, str) else k for k in on]
    row = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in df.columns]).alias("__row"))
    return df.groupBy(*[k.alias(f"__key_{i}") for i, k in enumerate(keys)]).agg(F.min(row).alias("__first")).select("__first.__row.*")


def latest(df: DataFrame, branch: Sequence[str], high: str, low: str, seq: str) -> DataFrame:
    """Materialised state: each branch's row of the highest watermark; the one that came first stays if watermarks are equal."""
    row = F.struct(*[F.col(c) for c in df.columns if c not in branch])
    return df.groupBy(*branch).agg(F.max_by(row, F.struct(F.col(high), F.col(low), -F.col(seq))).alias("__row")).select(*branch, "__row.*")


def with_state(df: DataFrame, state: DataFrame, branch: Sequence[str], time: str, mode: str = "skip", defaults: Mapping[str, object] | None = None, prefix: str = "state_") -> DataFrame:
    """Enrich by the same branch's latest state at each row's time (state rows of equal time count). mode: skip drops rows
    without state, default gives them the defaults, wait lets them wait for the first later state of their branch."""
    fields = [c for c in state.columns if c not in (*branch, time)]
    packed = F.struct(*[F.col(c) for c in fields])
    kind = f"struct<{','.join(f'`{n}`:{k}' for n, k in state.dtypes if n in fields)}>"
    updates = state.select(*branch, time, F.lit(0).alias("__side"), packed.alias("__state"), F.lit(None).cast(f"struct<{','.join(f'`{n}`:{k}' for n, k in df.dtypes)}>").alias("__row"))
    rows = df.select(*branch, time, F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__state"), F.struct(*[F.col(c) for c in df.columns]).alias("__row"))
    w = Window.partitionBy(*branch)
    nearest = lambda *order: F.last("__state", ignorenulls=True).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    seen = nearest(F.asc(time), F.asc("__side"))
    if mode == "wait":  # backwards in time the next state is a last one too: one pass, whatever the branch's length
        seen = F.coalesce(seen, nearest(F.desc(time), F.desc("__side")))
    out = updates.unionByName(rows).withColumn("__seen", seen).filter("__side = 1")
    if mode != "default":
        out = out.filter(F.col("__seen").isNotNull())
    values = [F.when(F.col("__seen").isNull(), F.lit((defaults or {}).get(f))).otherwise(F.col("__seen")[f]).alias(prefix + f) for f in fields]
    return out.select("__row.*", *values)


#: Bytes up to which a lookup's table may be broadcast; beyond it Spark joins by shuffles.
BROADCAST_BYTES = 32 << 20


def lookup(df: DataFrame, table: DataFrame, key: Column, table_key: str, fields: Sequence[str], order: str, prefix: str = "") -> DataFrame:
    """Left join with a hash map on the key's text; of equal keys the later entry, that of the highest order, wins. Missing keys give null."""
    entry = F.struct(*[F.col(f).alias(prefix + f) for f in fields])
    text = F.col(table_key).cast("string")
    dim = table.groupBy(text.alias("__key")).agg(F.max_by(entry, F.col(order)).alias("__entry"))
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    dim = F.broadcast(dim) if size <= BROADCAST_BYTES else dim
    joined = df.withColumn("__text", key.cast("string")).join(dim, F.col("__text") == F.col("__key"), "left")
    return joined.select(*[joined[c] for c in df.columns], "__entry.*")


def rekey(df: DataFrame, branch: Mapping[str, Column] | None) -> DataFrame:
    """Reingest: the rows under another branch (null keys are errors and don't pass), or under none."""
    if branch is None:
        return df.withColumn("_branch", F.lit(None).cast("string"))
    out = df.withColumn("_branch", F.to_json(F.struct(*[c.alias(n) for n, c in branch.items()])))
    for c in branch.values():
        out = out.filter(c.isNotNull())
    return out


def ticks(state: DataFrame, branch: Sequence[str], time: str, every_seconds: int, start: Column, end: Column) -> DataFrame:
    """Generator: at every tick from start to end one row for each branch that has state by then, with its latest state. A state makes
    its own ticks only: those from its time to before the next state's."""
    w = Window.partitionBy(*branch).orderBy(time)
    step = every_seconds * 1_000_000
    number = lambda t: F.timestamp_diff("MICROSECOND", start, t)
    first = F.greatest(F.ceil(number(F.col(time)) / step), F.lit(0))
    last = F.floor(number(end) / step)
    last = F.when(F.col("__until").isNotNull(), F.least(last, F.ceil(number(F.col("__until")) / step) - 1)).otherwise(last)
    spans = state.withColumn("__until", F.lead(time).over(w)).withColumns({"__first": first, "__last": last}).filter("__first <= __last")
    made = spans.withColumn("__n", F.explode(F.sequence("__first", "__last")))
    return made.select(*branch, F.timestamp_add("MICROSECOND", F.col("__n") * step, start).alias("tick"), *[F.col(c) for c in state.columns if c not in (*branch, time)])


def admitted(df: DataFrame, time: str, start: Column, period_seconds: int, skew_seconds: float) -> DataFrame:
    """Paced admission: whether each row's time is within the skew of a tick of the domain's clock."""
    since = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(start)
    period = period_seconds * 1_000_000
    off = F.pmod(since, F.lit(period))
    near = F.least(off, F.lit(period) - off)
    return df.withColumn("admitted", (near <= int(skew_seconds * 1_000_000)) & (since >= -int(skew_seconds * 1_000_000)))


def subscribe(df: DataFrame, sensitive: Sequence[str] = (), where: Column | None = None, sample: float | None = None, seed: int = 0) -> DataFrame:
    """A session's tap: sensitive values masked, rows filtered, and sampled if asked for."""
    out = df if where is None else df.filter(where)
    out = out if sample is None else out.sample(sample, seed)
    return out.select(*[F.when(F.col(c).isNotNull(), F.lit("<masked>")).alias(c) if c in sensitive else F.col(c) for c in df.columns])


def upsert(df: DataFrame, target: Sequence[str], seq: str, update: bool = True) -> DataFrame:
    """What a table with a conflict target holds after all rows: the last of each target (DO UPDATE) or the first (DO NOTHING)."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(c).alias(f"__t{i}") for i, c in enumerate(target)]).agg((F.max_by if update else F.min_by)(row, F.col(seq)).alias("__row")).select("__row.*")


def lives(df: DataFrame, branch: Sequence[str], time: str, seq: str, ttl_seconds: float, number: str = "life") -> DataFrame:
    """Branch time to live: a branch that was idle for longer starts anew. number counts its lives from 0; state is kept by branch and life."""
    w = Window.partitionBy(*branch).orderBy(time, seq)
    idle = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))
    fresh = F.coalesce((idle > int(ttl_seconds * 1_000_000)).cast("int"), F.lit(0))
    return df.withColumn("__fresh", fresh).withColumn(number, F.sum("__fresh").over(w)).drop("__fresh")


def most_recent(state: DataFrame, time: str, seq: str, instances: int) -> DataFrame:
    """The branches used last. A top-k, so each task sends no more rows than that."""
    return state.orderBy(F.desc(time), F.desc(seq)).limit(instances)


def evictions(df: DataFrame, branch: Sequence[str], time: str, seq: str, instances: int, number: str = "life", segments: int = 64) -> DataFrame:
    """MAX INSTANCES … EVICT LRU: a branch that isn't among the instances used last starts anew, its state being lost. number counts a
    branch's lives from 0; state is kept by branch and life.

    The order of all rows decides, yet they never meet in one task: time is cut into segments at quantiles (of 1 in 1,000), each
    segment's most recent branches are handed on to the later ones, and each runs over its own rows from what was in use at its beginning. A task holds instances
    branches, and reads as many for each segment before its own."""
    keys, at = F.struct(*[F.col(c) for c in branch]), F.unix_micros(F.col(time).cast("timestamp"))
    cuts = df.select(at.alias("at")).approxQuantile("at", [k / segments for k in range(1, segments)], 0.001) if segments > 1 else []
    cut = F.array(*[F.lit(int(c)) for c in sorted(set(cuts))]).cast("array<bigint>")
    rows = df.withColumn("__key", F.to_json(keys)).withColumn("__at", at).withColumn("__segment", F.size(F.filter(cut, lambda c: c <= F.col("__at"))))
    used = rows.groupBy("__segment", "__key").agg(F.max(F.struct("__at", F.col(seq).alias("__seq"))).alias("__last"))
    recent = used.withColumn("__place", F.row_number().over(Window.partitionBy("__segment").orderBy(F.desc("__last")))).filter(F.col("__place") <= instances)
    later = recent.withColumn("__to", F.explode(F.sequence(F.col("__segment") + 1, F.lit(segments - 1)))).filter(F.col("__segment") < segments - 1)
    held = later.groupBy(F.col("__to").alias("__segment"), "__key").agg(F.max("__last").alias("__last"))
    start = held.select("__segment", "__key", F.lit(0).alias("__side"), F.col("__last.__at").alias("__at"), F.col("__last.__seq").alias("__order"))
    own = rows.select("__segment", "__key", F.lit(1).alias("__side"), "__at", F.col(seq).alias("__order"))
    fresh = stateful.guest(start.unionByName(own), ["__segment"], ["__side", "__at", "__order"], lambda: Recent(instances), "__key string, __order long, __fresh int")
    marked = rows.join(fresh.withColumnRenamed("__order", seq), ["__key", seq])
    w = Window.partitionBy(*branch).orderBy(time, seq)
    return marked.withColumn(number, F.sum("__fresh").over(w) - 1).select(*df.columns, number)


class Recent:
    """The branches in use, least recently used first. A branch's first row, and one after its eviction, is fresh."""

    def __init__(self, instances: int):
        self.instances = instances
        self.order: OrderedDict[str, None] = OrderedDict()

    def see(self, row: dict) -> Iterator[dict]:
        key = row["__key"]
        here = key in self.order
        self.order[key] = None
        self.order.move_to_end(key)
        if len(self.order) > self.instances:
            self.order.popitem(last=False)
        if row["__side"]:
            yield {"__key": key, "__order": row["__order"], "__fresh": int(not here)}

    def end(self) -> Iterator[dict]:
        return iter(())
