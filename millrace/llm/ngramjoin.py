"""Exact Jaccard self-join of documents on word shingles, by prefix filters under several global token orders.

Each order sorts a set's shingles by how frequent they are (a fixed-size sketch of counts over all documents) and then by a
hash of its own. Two sets that are similar enough share a shingle among the first ones, the prefix, under every order.
The first order's prefixes are the index, with a positional filter that bounds the overlap that a shared shingle allows. Candidates
from it must also share prefix shingles under every other order: only fingerprints of those prefixes are made and joined for
that, and only of pairs that pass all orders the sets are fetched and compared.

Equal sets form a class and are compared once. A list of classes that share a shingle isn't paired with itself at once:

1. Every class of a list is compared to the list's hub only, the class that shares most of its prefix with others. Classes that link to a hub form its star, and each
   member's distance to the hub is known.
2. Lists are reduced to their stars' hubs, which are paired and compared.
3. Jaccard distance is a metric. Where hubs are further apart than the members' distances can make up for, no members
   can link; members of the remaining pairs of stars that aren't connected yet are compared where they share a shingle
   in the index and the same bound allows it.

So no link between different sets is lost, and large groups of near copies cost about as many comparisons as members.
Shingles are 64-bit hashes, of which 48 bits are compared. Classes are 64-bit hashes of their sets; where a further 64 bits show that sets of one hash
differ, those name them instead. Lists of very frequent shingles (parameter hot) are counted and joined rather than run through a window.

Null, empty and blank texts have no shingles and link with nothing; texts of fewer words than a shingle are one
shingle; rows that repeat a doc_id are documents of that id each; a null doc_id is never a component's id unless alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.llm.common import parts_of, stored

U = np.uint64
SEED = np.random.default_rng(20240607)
BYTES = SEED.integers(1, 1 << 64, 256, dtype=U)
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
BYTES[BLANK] = 0
BYTES[65:91] = BYTES[97:123]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LONGEST = 4096
with np.errstate(over="ignore"):
    POWERS = np.cumprod(np.full(LONGEST, 0x9E3779B97F4A7C15, U))
    PLACES = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, U))
SKETCH, BLOCK = 1 << 20, 4096
#: Bits of each of the two maps that tell which documents, and which of their classes, are wanted; 8 MB of each at most reach the driver.
MAP_BITS = 1 << 26
#: Prefixes shorter than this have fingerprints of two bytes a shingle, others of four.
SHORT = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(raw: np.ndarray, begins: np.ndarray, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of texts that lie one after another in raw and begin at begins, A-Z lower-cased; and the words' starts."""
    word = ~BLANK[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[begins] = word[begins]
    starts = np.flatnonzero(first)
    out = np.empty(len(starts), U)
    size = np.add.reduceat(word, starts, dtype=np.int64) if len(starts) else starts
    at = 0
    while at < len(starts):
        last = max(at + 1, int(np.searchsorted(starts, starts[at] + at_once)))
        lo, hi = starts[at], starts[last] if last < len(starts) else len(raw)
        own = (starts[at:last] - lo).astype(np.int32)
        place = np.arange(hi - lo, dtype=np.int32) - np.repeat(own, np.diff(np.append(own, hi - lo)))
        out[at:last] = np.add.reduceat(BYTES[raw[lo:hi]] * POWERS[np.minimum(place, LONGEST - 1)], own)
        at = last
    for k in np.flatnonzero(size > LONGEST):
        out[k] = int.from_bytes(blake2b(LOWER[raw[starts[k] : starts[k] + size[k]]].tobytes(), digest_size=8).digest(), "big")
    return mix(out + size.astype(U) * U(0xA24BAED4963EE407)), starts


def shingles(column: pa.Array, words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each text of a column, as 64-bit hashes."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if not len(raw):
        return [np.empty(0, U)] * len(column)
    w, starts = word_hashes(raw, ends[:-1][ends[:-1] < len(raw)])
    bounds = np.searchsorted(starts, ends)
    total = np.zeros(max(0, len(w) - words + 1), U)
    for k in range(words if len(total) else 0):
        total += w[k : len(w) - words + 1 + k] * PLACES[k]
    total = mix(total)
    out = []
    for a, b in pairwise(bounds.tolist()):
        if b - a >= words:
            s = np.sort(total[a : b - words + 1])
            fresh = np.empty(len(s), bool)
            fresh[0] = True
            np.not_equal(s[1:], s[:-1], out=fresh[1:])
            out.append(s[fresh])
        else:
            out.append(mix(np.array([(w[a:b] * PLACES[: b - a]).sum() + U(b - a)], U)) if b > a else np.empty(0, U))
    return out


def lists_of(arrays: list[np.ndarray]) -> pa.Array:
    """A list column of 64-bit integers."""
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64)))


def hashes_of(found: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set."""
    raw = blake2b(found.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def class_of(found: np.ndarray, clashes: frozenset[int] = frozenset()) -> int:
    """A set's class: the first hash, or the second where different sets have the first."""
    cls, second = hashes_of(found)
    return second if cls in clashes else cls


def prefix(found: np.ndarray, levels: np.ndarray, order: int, num: int, den: int) -> np.ndarray:
    """The first shingles of a set under an order, sorted by it: as many as any similar set must share one of."""
    n = len(found)
    first = n - -(-num * n // den) + 1
    other = found if order == 0 else mix(found ^ U(order * 0x2545F4914F6CDD1D % (1 << 64)))
    rank = (levels[(found & U(SKETCH - 1)).astype(np.int64)].astype(U) << U(56)) | (other >> U(8))
    at = np.argpartition(rank, first - 1)[:first] if first < n else np.arange(n)
    return found[at[np.argsort(rank[at], kind="stable")]]


def scan(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, and both hashes of all documents, and in rows with a block the counts of this task's shingles by their low bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "cls", "second", "block", "counts"]
        seen = np.zeros(SKETCH, np.uint32)
        for batch in parts_of(batches):
            found = shingles(batch.column(1), words)
            sizes, hashes = [len(f) for f in found], [hashes_of(f) for f in found]
            np.add.at(seen, (np.concatenate(found) & U(SKETCH - 1)).astype(np.int64), 1)
            nothing = [pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*hashes, strict=True)), *nothing], names)
        for block in range(0, SKETCH // BLOCK, 64):
            counts = [seen[k * BLOCK : (k + 1) * BLOCK] for k in range(block, min(block + 64, SKETCH // BLOCK))]
            k = len(counts)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(k, pa.int64())] * 4, pa.array(range(block, block + k), pa.int32()), pa.array([c.tobytes() for c in counts], pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, cls long, second long, block int, counts binary")


def levels(sketches: DataFrame) -> np.ndarray:
    """The frequency level of each low-bits value: quarter steps of the binary logarithm of the counts over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                add = np.frombuffer(counts, np.uint32)
                total[block] = total[block] + add if block in total else add.astype(np.int64)
        done = [np.round(4 * np.log2(1.0 + c)).astype(np.uint8).tobytes() for c in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(done, pa.binary())], ["block", "levels"])

    out = np.zeros(SKETCH, np.uint8)
    for row in sketches.repartition("block").mapInArrow(run, "block int, levels binary").collect():
        out[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.levels, np.uint8)
    return out


def indexed(docs: DataFrame, lvl, clashes: frozenset[int], words: int, num: int, den: int, hot_level: int) -> DataFrame:
    """cls, n, the first order's prefix, and how many of its shingles are below hot_level (they come first); within a task mostly once for each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in parts_of(batches):
            rows = []
            for s in shingles(batch.column(0), words):
                if not len(s) or (cls := class_of(s, clashes)) in done:
                    continue
                if len(done) > 200_000:
                    done.clear()
                done.add(cls)
                head = prefix(s, lvl.value, 0, num, den)
                cool = int(np.count_nonzero(lvl.value[(head & U(SKETCH - 1)).astype(np.int64)] < hot_level))
                rows.append((cls, len(s), head >> U(16) << U(16), cool))  # 48 bits, the others zero: they pack away with the row's head
            if rows:
                cls, n, heads, cool = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(n, pa.int64()), lists_of(list(heads)), pa.array(cool, pa.int32())], ["cls", "n", "tokens", "cool"])

    return docs.select("text").mapInArrow(run, "cls long, n long, tokens array<long>, cool int")


def similar(inter: Column, n: Column, m: Column, num: int, den: int) -> Column:
    return den * inter >= num * (n + m - inter)


TOKEN_BYTES = 6


def packed_tokens(found: np.ndarray) -> bytes:
    """The high 48 bits of each shingle, in order: two sets of thousands agree by chance in one of a hundred million comparisons at most."""
    return found.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def tokens_of(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // TOKEN_BYTES, 8), np.uint8)
    wide[:, :TOKEN_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, TOKEN_BYTES)
    return wide.reshape(-1).view(">u8").astype(U)


def fingerprints(heads: list[np.ndarray]) -> bytes:
    """The prefixes of the further orders, all of one length, as 16-bit parts of their shingles if that is short, else 32-bit ones."""
    kind = np.dtype("<u2") if len(heads[0]) < SHORT else np.dtype("<u4")
    return bytes([kind.itemsize]) + b"".join((h >> U(16)).astype(kind).tobytes() for h in heads)


def prefixes_meet(a: bytes, b: bytes, filters: int) -> bool:
    """Whether two sets may share a prefix shingle under every further order."""
    x, y = (np.frombuffer(raw, np.dtype(f"<u{raw[0]}"), offset=1).reshape(filters, -1) for raw in (a, b))
    if x.dtype != y.dtype:
        x, y = x.astype(np.uint16), y.astype(np.uint16)
    return all(len(np.intersect1d(x[k], y[k])) for k in range(filters))


def passing(pairs: DataFrame, heads: DataFrame, filters: int) -> DataFrame:
    """The pairs (a, b and more columns) that share a prefix shingle under each further order, told by fingerprints alone."""
    names = pairs.columns
    side = lambda x: heads.groupBy("cls").agg(F.first("heads").alias(f"h{x}")).withColumnRenamed("cls", x)
    rows = pairs.join(side("b"), "b").join(side("a"), "a").select(*names, "ha", "hb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ha, hb = (batch.column(len(names) + k).to_pylist() for k in range(2))
            keep = [k for k in range(batch.num_rows) if prefixes_meet(ha[k], hb[k], filters)]
            if keep:
                yield batch.select(range(len(names))).take(pa.array(keep))

    return rows.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in pairs.dtypes))


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b and more columns) with na, nb and the overlap inter of their sets."""
    names = pairs.columns
    side = lambda x: sets.groupBy("cls").agg(F.first("n").alias(f"n{x}"), F.first("tokens").alias(f"t{x}")).withColumnRenamed("cls", x)
    rows = pairs.join(side("b"), "b").join(side("a"), "a").select(*names, "na", "nb", "ta", "tb")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ta, tb = (batch.column(len(names) + k).to_pylist() for k in (2, 3))
            inter = [len(np.intersect1d(tokens_of(x), tokens_of(y), assume_unique=True)) for x, y in zip(ta, tb, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) + 2], pa.array(inter, pa.int64())], [*names, "na", "nb", "inter"])

    return rows.mapInArrow(count, ", ".join([*(f"{c} {k}" for c, k in pairs.dtypes), "na long, nb long, inter long"]))


def components(links: DataFrame) -> DataFrame:
    """v, label: the smallest of each connected component of links (a, b). Every round joins each vertex to its smallest
    neighbour and contracts the edges; labels are hashes, so that long paths shrink by a share in every round."""
    edges = stored(links.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        parent = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "parents")
        if labels is None:
            labels = parent
        else:
            moved = labels.join(parent.select(F.col("v").alias("label"), F.col("label").alias("to")), "label", "left")
            labels = stored(moved.select("v", F.coalesce("to", "label").alias("label")), "labels")
        a = parent.select(F.col("v").alias("a"), F.col("label").alias("la"))
        b = parent.select(F.col("v").alias("b"), F.col("label").alias("lb"))
        edges = stored(edges.join(a, "a").join(b, "b").filter("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("v"), F.col("b").alias("label"))


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()


def fetched(docs: DataFrame, wanted: DataFrame, owners: DataFrame, make, name: str, clashes: frozenset[int], words: int) -> DataFrame:
    """cls, n and make(set), a binary column of that name, of the wanted classes, made anew from the text of one document of each: its owner. A bit map
    of owners passes over nearly all other texts before they are read, one of owners and classes over other classes of the same id. A class that
    several tasks meet (rows repeat an id) has a row from each."""
    owner = F.pmod(F.coalesce("owner", F.lit(-1)), F.lit(MAP_BITS))
    keys = {0: owner, 1: (F.pmod("cls", F.lit(MAP_BITS)) + owner) % MAP_BITS}
    held = wanted.join(owners, "cls").select(F.explode(F.array(*[F.struct(F.lit(k).alias("map"), (v + 1).alias("key")) for k, v in keys.items()])).alias("x")).select("x.*")  # Spark's bitmaps begin at 1
    cells = held.groupBy("map", F.bitmap_bucket_number("key").alias("cell")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("key")).alias("bits")).collect()
    columns = f"cls long, n long, {name} binary"
    if not cells:
        return docs.sparkSession.createDataFrame([], columns)
    bits = np.zeros((2, MAP_BITS // 8), np.uint8)
    for row in cells:
        bits[row.map, (row.cell - 1) * 4096 : row.cell * 4096] = np.frombuffer(row.bits, np.uint8)
    shared_bits = docs.sparkSession.sparkContext.broadcast(bits)

    def there(k: int, at: int) -> bool:
        return bool(shared_bits.value[k, at >> 3] >> (at & 7) & 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            ids = [(-1 if i is None else i) % MAP_BITS for i in batch.column(0).to_pylist()]
            some = [k for k, i in enumerate(ids) if there(0, i)]
            if not some:
                continue
            for part in parts_of(iter([batch.select([1]).append_column("at", pa.array(ids)).take(pa.array(some))])):
                rows = []
                for i, s in zip(part.column(1).to_pylist(), shingles(part.column(0), words), strict=True):
                    if len(s) and (cls := class_of(s, clashes)) not in done and there(1, (cls % MAP_BITS + i) % MAP_BITS):
                        if len(done) > 200_000:
                            done.clear()
                        done.add(cls)
                        rows.append((cls, len(s), make(s)))
                if rows:
                    cls, n, made = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(made, pa.binary())], ["cls", "n", name])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, columns)


def shared_lists(index: DataFrame, any_hot: bool) -> DataFrame:
    """tok, cls, n, rest and size: the index's lists of at least two classes. rest counts the shingles from this one on, which bounds the overlap if it is the first common one."""
    # size and place in as few bits as they take, to move less: a place is below a quarter of the size, so that the size's leading bit tells where the place begins
    postings = index.select("cls", "n", "cool", (F.length(F.bin("n")) - 1).alias("b"), F.posexplode("tokens").alias("pos", "tok"))
    at = F.expr("shiftleft(n, b) + pos").alias("at")
    w = Window.partitionBy("tok")
    cool = (postings.filter("pos < cool") if any_hot else postings).select("tok", "cls", at)
    found = cool.select("*", F.min("cls").over(w).alias("one"), F.max("cls").over(w).alias("last")).filter("one <> last")
    found = found.dropDuplicates(["tok", "cls"]).withColumn("size", F.count(F.lit(1)).over(w)).drop("one", "last")  # copies in several tasks count once; the rows stay where they are
    if any_hot:
        hot = postings.filter("pos >= cool").select("tok", "cls", at).dropDuplicates(["tok", "cls"])
        sizes = hot.groupBy("tok").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        found = found.unionByName(hot.join(sizes, "tok"))
    sized = found.withColumn("b", ((F.length(F.bin("at")) - 1) / 2).cast("int")).withColumn("n", F.expr("shiftright(at, b)"))
    return stored(sized.select("tok", "cls", F.col("n").cast("int").alias("n"), F.expr("cast(n - (at - shiftleft(n, b)) AS int)").alias("rest"), "size"), "shared")


def with_hubs(shared: DataFrame, hot: int) -> DataFrame:
    """The lists with the hub of each: the more of its prefix a class shares, and with the more others, the more central it is among near copies."""
    central = stored(shared.groupBy("cls").agg((F.sum("size") / (F.first("n") + 1)).alias("weight")), "central")
    best = F.max(F.struct("weight", "cls", "n", "rest"))
    columns = ["tok", "cls", "n", "rest", "hub"]
    any_hot = not shared.filter(F.col("size") >= hot).isEmpty()
    small = (shared.filter(F.col("size") < hot) if any_hot else shared).drop("size").join(central, "cls")
    out = small.withColumn("hub", best.over(Window.partitionBy("tok"))).select(columns)
    if any_hot:
        large = shared.filter(F.col("size") >= hot).drop("size").join(central, "cls")
        out = out.unionByName(large.join(large.groupBy("tok").agg(best.alias("hub")), "tok").select(columns))
    return stored(out, "lists")


def links(docs: DataFrame, owners: DataFrame, lvl: np.ndarray, clashes: frozenset[int], words: int, num: int, den: int, orders: int, hot: int) -> DataFrame:
    """Links (a, b) between classes; classes connected by all similar pairs are connected by these."""
    shared_levels = docs.sparkSession.sparkContext.broadcast(lvl)  # SKETCH bytes
    # a bucket of the sketch counts all its shingles, so that one is hot only if it stands out among the buckets, too
    hot_level = int(np.ceil(4 * np.log2(1.0 + max(hot, 8 * float(np.exp2(lvl / 4.0).mean())))))
    any_hot = bool((lvl >= hot_level).any())
    index = indexed(docs, shared_levels, clashes, words, num, den, hot_level)
    lists = with_hubs(shared_lists(stored(index, "index") if any_hot else index, any_hot), hot)

    def sets(pairs: DataFrame) -> DataFrame:
        return fetched(docs, ends_of(pairs), owners, packed_tokens, "tokens", clashes, words)

    def filtered(pairs: DataFrame) -> DataFrame:
        """The pairs that pass the other orders."""
        make = lambda s: fingerprints([prefix(s, shared_levels.value, k, num, den) for k in range(1, orders)])
        return stored(passing(pairs, fetched(docs, ends_of(pairs), owners, make, "heads", clashes, words), orders - 1), "passing") if orders > 1 else pairs

    def may(n: str, m: str, r: str, s: str) -> Column:
        """Whether places and sizes allow an overlap of num/(num + den) of both sizes together."""
        return (F.least(F.col(r), F.col(s)) * (num + den) >= num * (F.col(n) + F.col(m))) & (den * F.least(F.col(n), F.col(m)) >= num * F.greatest(F.col(n), F.col(m)))

    # 1. stars
    stars = stored(lists.filter((F.col("cls") != F.col("hub.cls")) & may("n", "hub.n", "rest", "hub.rest")).select(F.col("hub.cls").alias("a"), F.col("cls").alias("b")).distinct(), "stars")
    stars = filtered(stars)
    done = stored(compared(stars, sets(stars)), "compared")
    linked = done.filter(similar(F.col("inter"), F.col("na"), F.col("nb"), num, den))
    distance = 1 - F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))
    roots = linked.select(F.col("a")).distinct().join(linked.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    member = linked.join(roots, "a").groupBy(F.col("b").alias("cls")).agg(F.min(F.struct(distance.alias("r"), F.col("a").alias("star"))).alias("m"))
    member = stored(member.select("cls", "m.star", "m.r"), "members")

    # 2. pairs of stars
    placed = stored(lists.join(member, "cls", "left").select("tok", "cls", "n", "rest", F.coalesce("star", "cls").alias("star"), F.coalesce("r", F.lit(0.0)).alias("r")), "placed")
    of = placed.groupBy("tok", "star").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rest").alias("rest"))
    of = stored(of.select("*", F.min("star").over(Window.partitionBy("tok")).alias("one"), F.max("star").over(Window.partitionBy("tok")).alias("last")).filter("one <> last").drop("one", "last"), "star-lists")
    x, y = (of.select("tok", *[F.col(c).alias(c + k) for c in ("star", "lo", "hi", "rest")]) for k in "ab")
    near = (F.least("resta", "restb") * (num + den) >= num * (F.col("loa") + F.col("lob"))) & (den * F.col("hib") >= num * F.col("loa")) & (den * F.col("hia") >= num * F.col("lob"))
    radius = member.groupBy("star").agg(F.max("r").alias("r"), F.count(F.lit(1)).alias("k"))
    pairs = x.join(y, (x.tok == y.tok) & (F.col("stara") < F.col("starb")) & near).select(F.col("stara").alias("a"), F.col("starb").alias("b")).distinct()
    for k in "ab":
        pairs = pairs.join(radius.select(F.col("star").alias(k), F.col("r").alias(f"r{k}"), F.col("k").alias(f"k{k}")), k, "left")
    pairs = pairs.fillna(0.0, ["ra", "rb"]).fillna(0, ["ka", "kb"]).withColumn("grown", F.col("ra") + F.col("rb") > 0)
    pairs = stored(pairs, "star-pairs")
    # between hubs with members the distance is needed, similar or not
    pairs = stored(pairs.filter("grown").unionByName(filtered(pairs.filter("NOT grown"))), "star-candidates")
    hubs = stored(compared(pairs, sets(pairs)), "star-compared").withColumn("d", distance)
    linked_hubs = hubs.filter(similar(F.col("inter"), F.col("na"), F.col("nb"), num, den)).select("a", "b")
    found = linked.select("a", "b").union(linked_hubs)

    # 3. members of stars that aren't connected but may have linked members
    most = 1 - num / den + 1e-9
    open_pairs = stored(hubs.filter(F.col("grown") & (F.col("d") > most - 2e-9) & (F.col("d") - F.col("ra") - F.col("rb") <= most)).select("a", "b", "d", "ka", "kb"), "open")
    if open_pairs.isEmpty():
        return found
    label = components(found)
    for k in "ab":
        open_pairs = open_pairs.join(label.select(F.col("v").alias(k), F.col("label").alias(f"l{k}")), k, "left")
    apart = open_pairs.filter(F.coalesce("la", "a") != F.coalesce("lb", "b"))
    # members of the smaller star by their shingles, then those of the larger one that share one where the places and the metric allow it
    less, more = F.when(F.col("ka") <= F.col("kb"), F.col("a")).otherwise(F.col("b")), F.when(F.col("ka") <= F.col("kb"), F.col("b")).otherwise(F.col("a"))
    small = apart.select(less.alias("star"), more.alias("big"), "d").join(placed, "star").select("tok", "big", "d", F.col("cls").alias("a"), "n", "rest", "r")
    large = placed.select(F.col("tok").alias("tok2"), F.col("star").alias("star2"), F.col("cls").alias("b"), F.col("n").alias("m"), F.col("rest").alias("rest2"), F.col("r").alias("r2"))
    allowed = may("n", "m", "rest", "rest2") & (F.col("d") - F.col("r") - F.col("r2") <= most)
    open_pairs = small.join(large, (F.col("tok") == F.col("tok2")) & (F.col("big") == F.col("star2")) & allowed)
    inner = stored(open_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "inner-pairs")
    if inner.isEmpty():
        return found
    inner = filtered(inner)
    last = compared(inner, sets(inner)).filter(similar(F.col("inter"), F.col("na"), F.col("nb"), num, den))
    return found.union(stored(last.select("a", "b"), "inner"))


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 75, den: int = 100, orders: int = 3, hot: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id of every document (columns doc_id and text). orders is the number of token orders, hot the rows of a list from which on it is counted and joined."""
    scanned = stored(scan(docs, words), "scan")
    members = scanned.filter("block IS NULL").select("doc_id", "n", "cls", "second")
    lvl = levels(scanned.filter("block IS NOT NULL").select("block", "counts"))

    def by_class(rows: DataFrame) -> DataFrame:
        some = rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("size"), F.min("second").alias("low"), F.max("second").alias("high"))
        return stored(some, "owners")

    owners = by_class(members)
    clashes = frozenset(r.cls for r in owners.filter("low <> high").select("cls").collect())  # among 10^10 sets about three are to be expected
    if clashes:
        members = members.withColumn("cls", F.when(F.col("cls").isin(list(clashes)), F.col("second")).otherwise(F.col("cls")))
        owners = by_class(members)
    label = components(links(docs, owners.select("cls", "owner"), lvl, clashes, words, num, den, orders, hot))
    named = owners.select("cls", F.col("owner").alias("first"), "size").join(label, F.col("cls") == F.col("v"), "left").withColumn("label", F.coalesce("label", "cls")).drop("v")
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"), F.sum("size").alias("size"))
    of = stored(named.drop("size").join(stored(smallest.filter("size > 1").drop("size"), "smallest"), "label").select("cls", "component_id"), "component-of")
    return members.withColumn("key", F.when(F.col("n") > 0, F.col("cls"))).join(of.withColumnRenamed("cls", "key"), "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
