"""Approximate nearest neighbours by cosine: several shifted Hilbert curves over rotated projections.

Each curve projects the unit vectors by a rotation of its own, shifts them at random in a grid and orders them by Hilbert
key; Spark range-partitions and sorts the keys. A query is compared to the vectors whose rank on some curve is within a fixed
window around its own: inside a partition as its rows stream by, across partitions by the rows at their edges, which meet by curve.
Curves carry vectors as 8-bit codes with their error; whatever the error leaves possible is kept, merged over the curves, and scored in double
precision on the vectors divided by their largest component.

Windows don't grow with the table, so that a curve costs the same for each query at any size. How many curves a recall takes depends on the data: rounds of
curves are added until the recall on a bounded sample of queries, which are compared to all vectors, reaches the target or most_curves are done.
Vectors of one direction, equal or scaled, are one entry with their smallest ids: as many as a result can need. Other
ties are all kept before ids decide.

The grid's bounds come from a bounded sample (sample vectors, picked by a hash). Rows with null vec_id, vectors that are
null, zero, of another length than most, or hold null or non-finite components take no part. Repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import map_rows, stored


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of grid cells (n x d, each below 2^bits): Gray-code transform bit by bit, then the bits interleaved."""
    x = cells.astype(np.uint32).T.copy()
    d = len(x)
    for b in range(bits - 1, 0, -1):
        bit, low = np.uint32(1 << b), np.uint32((1 << b) - 1)
        for i in range(d):
            inverted = (x[i] & bit) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(inverted, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint32)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[d - 1] >> np.uint32(b) & 1, np.uint32((1 << b) - 1), np.uint32(0))
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> np.uint32(b) & 1)
    return key


def rotations(dims: int, curves: int, axes: int, seed: int) -> np.ndarray:
    """Orthonormal projections, curves x dims x axes."""
    random = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(random.normal(size=(dims, dims)))[0][:, :axes] for _ in range(curves)])


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codes(x: np.ndarray) -> list[bytes]:
    """Unit vectors as signed bytes after their step and the length of what rounding took away."""
    step = np.abs(x).max(axis=1) / 127
    rounded = np.round(x / step[:, None]).astype(np.int8)
    lost = np.sqrt(((x - rounded * step[:, None]) ** 2).sum(axis=1))
    head = np.stack([step, lost], axis=1).astype("<f4")
    return [h.tobytes() + r.tobytes() for h, r in zip(head, rounded, strict=True)]


def decoded(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of codes, and the bounds of their errors."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, dims + 8)
    head = np.ascontiguousarray(raw[:, :8]).view("<f4")
    return np.ascontiguousarray(raw[:, 8:]).view(np.int8).astype(np.float32) * head[:, :1], head[:, 1] + np.float32(1e-6)


@dataclass
class Run:
    """Consecutive rows of one curve: ranks, partitions, entries, whether they are queries, vectors and error bounds."""

    rank: np.ndarray
    part: np.ndarray
    entry: np.ndarray
    asked: np.ndarray
    vector: np.ndarray
    lost: np.ndarray

    def __getitem__(self, rows: slice) -> Run:
        return Run(self.rank[rows], self.part[rows], self.entry[rows], self.asked[rows], self.vector[rows], self.lost[rows])

    def __len__(self) -> int:
        return len(self.rank)

    def joined(self, other: Run) -> Run:
        return Run(*[np.concatenate([getattr(self, f), getattr(other, f)]) for f in ("rank", "part", "entry", "asked", "vector", "lost")])


def met(run: Run, first: int, last: int, window: int, k: int, across: bool, span: int = 512) -> Iterator[tuple[np.ndarray, ...]]:
    """query, entry, and the bounds of their cosine, for the queries in run[first:last]: of the rows within the window (across: those of other partitions) all that may be among the k best."""
    asked = np.flatnonzero(run.asked[first:last]) + first
    for at in range(0, len(asked), span):
        some = asked[at : at + span]
        # queries that lie far apart go in groups, so that no product reaches over more than a few windows
        for group in np.split(some, np.flatnonzero(np.diff(run.rank[some]) > window) + 1):
            lo, hi = np.searchsorted(run.rank, run.rank[group[0]] - window), np.searchsorted(run.rank, run.rank[group[-1]] + window, "right")
            near = np.abs(run.rank[group][:, None] - run.rank[None, lo:hi]) <= window
            if across:
                near &= run.part[group][:, None] != run.part[None, lo:hi]
            error = run.lost[group][:, None] + run.lost[None, lo:hi] * 1.01
            rough = np.where(near, run.vector[group] @ run.vector[lo:hi].T, -9)
            low = rough - error
            most = min(k, low.shape[1])
            least = -np.partition(-low, most - 1, axis=1)[:, most - 1]
            row, col = np.nonzero(near & (rough + error >= least[:, None]))
            yield run.entry[group[row]], run.entry[lo:hi][col], low[row, col], (rough + error)[row, col]


FOUND = "curve int, part int, place long, rows long, entry long, code binary, asked boolean, query long, low float, high float"


def windows_of(sorted_rows: DataFrame, dims: int, window: int, k: int) -> DataFrame:
    """From rows (curve, key, entry, code, asked) that are sorted in every partition: pairs (query, entry, low, high), and the rows within a window of a partition's
    begin or end of a curve, with their place and the number of the curve's rows there."""
    fields = [f.split()[0] for f in FOUND.split(", ")]
    kinds = dict(zip(fields, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.float32(), pa.float32()], strict=True))

    def table(**cols) -> pa.RecordBatch:
        n = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([pa.array(cols[f], kinds[f]) if f in cols else pa.nulls(n, kinds[f]) for f in fields], fields)

    def pairs(run: Run, first: int, last: int) -> Iterator[pa.RecordBatch]:
        for query, entry, low, high in met(run, first, last, window, k, False):
            yield table(query=query, entry=entry, low=low.astype(np.float32), high=high.astype(np.float32))

    def edges(curve: int, part: int, rows: int, head: list, tail: list) -> pa.RecordBatch:
        kept = [*head, *(t for t in tail if t[0] >= len(head))]
        place, entry, code, asked = zip(*kept, strict=True)
        n = len(kept)
        return table(curve=[curve] * n, part=[part] * n, place=place, rows=[rows] * n, entry=entry, code=code, asked=asked)

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        curve, size, done = None, 0, 0
        run: Run | None = None
        head: list = []
        tail: list = []
        for batch in batches:
            of = batch.column(0).to_numpy()
            for lo, hi in pairwise([0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]):
                if curve is not None and of[lo] != curve:
                    yield from pairs(run, done, len(run))
                    yield edges(curve, part, size, head, tail)
                    run, size, done, head, tail = None, 0, 0, [], []
                curve = int(of[lo])
                rows = batch.slice(lo, hi - lo)
                entry, code, asked = (rows.column(c) for c in (2, 3, 4))
                place = np.arange(size, size + len(rows.column(0)))
                size += len(place)
                listed = lambda a, b: list(zip(place[a:b].tolist(), entry[a:b].to_pylist(), code[a:b].to_pylist(), asked[a:b].to_pylist(), strict=True))  # noqa: B023, E731
                head += listed(0, max(0, window - len(head)))
                tail = [*tail, *listed(max(0, len(place) - window), len(place))][-window:]
                vector, lost = decoded(code, dims)
                more = Run(place, np.full(len(place), part), entry.to_numpy(), asked.to_numpy(zero_copy_only=False), vector, lost)
                run = more if run is None else run.joined(more)
                ready = max(done, len(run) - window)  # queries from here on wait for rows to come
                yield from pairs(run, done, ready)
                cut = max(0, ready - window)
                run, done = run[cut:], ready - cut
        if curve is not None:
            yield from pairs(run, done, len(run))
            yield edges(curve, part, size, head, tail)

    return sorted_rows.mapInArrow(run_all, FOUND)


def across(edges: pd.DataFrame, dims: int, window: int, k: int) -> pd.DataFrame:
    """The pairs of one curve that lie in different partitions, from the rows at their edges."""
    edges = edges.sort_values(["part", "place"])
    sizes = edges.groupby("part")["rows"].first().sort_index()
    start = sizes.cumsum() - sizes
    vector, lost = decoded(pa.array(edges["code"], pa.binary()), dims)
    rank = edges["place"].to_numpy() + start.loc[edges["part"]].to_numpy()
    run = Run(rank, edges["part"].to_numpy(), edges["entry"].to_numpy(), edges["asked"].to_numpy(bool), vector, lost)
    found = list(met(run, 0, len(run), window, k, True))
    cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.array([])] * 4
    return pd.DataFrame({"query": cols[0].astype(np.int64), "entry": cols[1].astype(np.int64), "low": cols[2].astype(np.float32), "high": cols[3].astype(np.float32)})


def search(vectors: DataFrame, k: int = 5, every: int = 50, axes: int = 16, window: int = 256, curves: int = 32, most_curves: int = 512, target: float = 0.95, checked: int = 200, sample: int = 5000, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query, a row whose vec_id is divisible by every. curves are added in rounds until
    checked queries find a share of target of their neighbours, or there are most_curves."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & e.isNotNull() & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0)
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.coalesce(usable, F.lit(False)))
    sizes = valid.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], result)
    dims = sizes[0].dims
    axes = min(axes, dims)
    bits = min(10, 48 // axes)

    def directions():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = matrix(batch.column(1), dims)
            x = x / np.abs(x).max(axis=1, keepdims=True) + 0.0  # rounded once, so that exact multiples become equal; no negative zeros
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(0, x.size + 1, dims, dtype=np.int32), x.ravel())], ["vec_id", "embedding"])

        return step

    valid = map_rows(valid.filter(F.size("embedding") == dims), "vec_id long, embedding array<double>", directions)

    # vectors of one direction: the k + 1 smallest ids stand for all; Spark limits each task's rows before the shuffle
    first = Window.partitionBy("embedding").orderBy("vec_id")
    fewest = valid.distinct().withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    entries = stored(fewest.groupBy("embedding").agg(F.min("vec_id").alias("entry"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-entries")
    queries = valid.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    asked = stored(queries.join(entries.select("embedding", "entry"), "embedding").select("query_id", "entry"), "ann-asked")
    marked = entries.select("entry", "embedding").join(asked.select("entry", F.lit(True).alias("asked")).distinct(), "entry", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    marked = stored(marked, "ann-marked")
    n, n_asked = marked.agg(F.count(F.lit(1)), F.count_if("asked")).first()

    # bounds of the grid by curve, and the sample of queries against all
    picked = lambda df, most, of: df.filter(F.pmod(F.xxhash64("entry"), F.lit(1 << 40)) < max(1, round((1 << 40) * min(1.0, most / max(1, of)))))
    seen = picked(marked, sample, n).select("embedding").toArrow()
    seen = unit(matrix(seen["embedding"].combine_chunks(), dims)) if seen.num_rows else np.zeros((1, dims))
    tested = {r.entry: r.embedding for r in picked(marked.filter("asked"), checked, n_asked).select("entry", "embedding").collect()}
    truth = nearest(marked, tested, k + 1, dims)

    def keys(turns: np.ndarray, at: int):
        low, high = (np.stack([np.quantile(seen @ t, p, axis=0) for t in turns]) for p in (0.001, 0.999))
        shifts = np.random.default_rng(seed + 1 + at).random((len(turns), axes))
        scale = np.maximum(high - low, 1e-9)

        def make():
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                x = unit(matrix(batch.column(1), dims))
                cells = [np.clip(((x @ t - lo) / s * 0.5 + shift * 0.5) * (1 << bits), 0, (1 << bits) - 1).astype(np.int64) for t, lo, s, shift in zip(turns, low, scale, shifts, strict=True)]
                key = np.concatenate([hilbert(c, bits) for c in cells])
                curve = np.repeat(np.arange(at, at + len(turns), dtype=np.int32), len(x))
                again = pa.array(np.tile(np.arange(len(x)), len(turns)))
                rest = [c.take(again) for c in (batch.column(0), pa.array(codes(x), pa.binary()), batch.column(2))]
                return pa.RecordBatch.from_arrays([pa.array(curve), pa.array(key), *rest], ["curve", "key", "entry", "code", "asked"])

            return step

        return make

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = None
    for at in range(0, most_curves, curves):
        turns = rotations(dims, curves, axes, seed + at)
        ranged = map_rows(marked, "curve int, key long, entry long, code binary, asked boolean", keys(turns, at)).repartitionByRange(parts, "curve", "key", "entry").sortWithinPartitions("curve", "key", "entry")
        found = stored(windows_of(ranged, dims, window, k + 1), "ann-windows")
        edges = found.filter("query IS NULL").select("curve", "part", "place", "rows", "entry", "code", "asked")
        crossed = edges.groupBy("curve").applyInPandas(lambda pdf: across(pdf, dims, window, k + 1), "query long, entry long, low float, high float")
        pairs = found.filter("query IS NOT NULL").select("query", "entry", "low", "high").unionByName(crossed)
        pairs = pairs if merged is None else pairs.unionByName(merged)
        pairs = pairs.groupBy("query", "entry").agg(F.max("low").alias("low"), F.max("high").alias("high"))
        # of a query's pairs all that may be among the k + 1 best, the query's own entry included
        by_low = Window.partitionBy("query").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        least = F.coalesce(F.nth_value("low", k + 1).over(by_low), F.lit(-9.0).cast("float"))
        merged = stored(pairs.withColumn("least", least).filter("high >= least").drop("least"), "ann-merged")
        reached = merged.filter(F.col("query").isin(list(tested))) if tested else merged.limit(0)
        have = {(r["query"], r.entry) for r in reached.select("query", "entry").collect()}
        if sum((q, x) in have for q, xs in truth.items() for x in xs) >= target * sum(map(len, truth.values())):
            break

    vector = marked.select("entry", F.col("embedding").alias("own"))
    near = merged.join(vector, "entry").join(vector.select(F.col("entry").alias("query"), F.col("own").alias("of")), "query").select("query", "entry", "of", "own")

    def exact():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = cosine(matrix(batch.column(2), dims), matrix(batch.column(3), dims))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["query", "entry", "score"])

        return step

    scored = map_rows(near, "query long, entry long, score double", exact)
    top = scored.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entry"))).filter(F.col("place") <= k + 1)
    found = stored(top.join(entries.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id")), "ann-found")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    few = stored(found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).drop("place"), "ann-few")
    rows = asked.join(few, asked.entry == few["query"]).filter(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(marked: DataFrame, queries: dict[int, list[float]], k: int, dims: int) -> dict[int, list[int]]:
    """The k nearest entries, but for itself, of each of a bounded number of queries among all entries."""
    if not queries:
        return {}
    ids = np.array(list(queries))
    v = unit(np.array(list(queries.values())))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, entry = unit(matrix(batch.column(1), dims)), batch.column(0).to_numpy()
            score = np.where(ids[:, None] == entry[None], -9, v @ x.T)
            col = np.argsort(-score, axis=1)[:, : k - 1]
            row = np.repeat(np.arange(len(ids)), col.shape[1])
            return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(entry[col.ravel()]), pa.array(score[row, col.ravel()])], ["query", "entry", "score"])

        return step

    best = map_rows(marked.select("entry", "embedding"), "query long, entry long, score double", make).filter("score > -9")
    top = best.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entry"))).filter(F.col("place") < k)
    out: dict[int, list[int]] = {}
    for r in top.select("query", "entry").collect():
        out.setdefault(r["query"], []).append(r.entry)
    return out


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine along the last axis, in double precision."""
    return (x * y).sum(axis=-1) / (np.sqrt((x * x).sum(axis=-1)) * np.sqrt((y * y).sum(axis=-1)))
