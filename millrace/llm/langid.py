"""Language identification: multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies are counted over all training rows in Spark. The regression is fitted on the driver by
follow-the-regularised-leader with L1 and L2 penalties, on a bounded sample: about per_language documents of each
language, fewer where that is more than most_rows in all (both are parameters of train()), picked by a hash of key and
text; rows that repeat both are picked once. All languages are learned, so that the weights grow with their number. A tenth of the
sample is kept back to choose the temperature by which the logits are divided.

Null text and text without a letter get `und` and score 0, as does every text if nothing could be learned. Rows with
null language teach nothing. Repeated rows count and are predicted each; very long texts are used whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_rows, parts_of, texts

#: Numerals that Python counts as word characters without being letters or decimal digits, such as fractions and circled numbers.
NUMERALS = frozenset(c for c in map(chr, range(0x80, 0x20000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
BLANKED = dict.fromkeys(map(ord, NUMERALS), " ")
NO_LETTERS = re.compile(r"[\W\d_]+")
MIX = np.uint32(2654435761)
BUCKETS = 1 << 15


def grams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed character 1- to 3-grams of a text's letters, words being set apart by one space; empty without letters."""
    text = text.lower()
    if not text.isascii() and not NUMERALS.isdisjoint(text):
        text = text.translate(BLANKED)
    words = NO_LETTERS.sub(" ", text).strip()
    if not words:
        return np.zeros(0, np.uint32)
    one = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    shift = np.uint32(32 - buckets.bit_length() + 1)
    two = (one[:-1] * np.uint32(0x01000193) ^ one[1:]) * MIX
    three = (two[:-1] ^ one[2:] * np.uint32(0x85EBCA6B)) * MIX
    return np.concatenate([one * MIX, two, three * np.uint32(0x9E3779B1)]) >> shift


def weights(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their normalised weights."""
    counts = np.bincount(grams(text, len(idf)), minlength=len(idf))
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, x / max(1e-12, float(np.sqrt((x * x).sum())))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    w: np.ndarray
    temperature: float = 1.0

    def predict(self, text: str) -> tuple[str, float]:
        at, x = weights(text, self.idf)
        if not self.languages or not len(at):
            return "und", 0.0
        p = softmax(x @ self.w[at] / self.temperature)
        k = int(np.argmax(p))
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], features: int, classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3) -> np.ndarray:
    """Weights (features x classes) by per-coordinate FTRL-proximal, elastic net included."""
    z, n = np.zeros((features, classes)), np.zeros((features, classes))

    def current(at: np.ndarray | slice) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            w = current(at)
            miss = softmax(x @ w)
            miss[y] -= 1
            g = x[:, None] * miss
            square = n[at] + g * g
            z[at] += g - (np.sqrt(square) - np.sqrt(n[at])) / alpha * w
            n[at] = square
    return current(slice(None))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on rows that weren't trained on."""
    tries = np.geomspace(0.02, 5, 60)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() + 1e-6 * abs(np.log(t)) for t in tries]
    return float(tries[int(np.argmin(loss))])


def frequencies(docs: DataFrame, text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """How many rows have each feature, and the number of rows. Each task sends one row for each feature that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets + 1, np.int64)
        for batch in parts_of(batches):
            for t in texts(batch.column(0)):
                seen[np.flatnonzero(np.bincount(grams(t, buckets), minlength=buckets))] += 1
                seen[buckets] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], ["bucket", "n"])

    total = np.zeros(buckets + 1, np.int64)
    for row in docs.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row.bucket] = row.n
    return total[:buckets], int(total[buckets])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 400, most_rows: int = 40_000) -> Model:
    """Learn from the text and language of all rows given."""
    known = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)))
    languages = sorted(sizes)
    seen, n = frequencies(known, "text")
    idf = np.log((1 + n) / (1 + seen)) + 1
    each = min(per_language, max(1, most_rows // len(languages)))
    shares = docs.sparkSession.createDataFrame([(name, min(1 << 40, max(1, round((1 << 40) * each / sizes[name])))) for name in languages], "lang string, share long")
    rank: Column = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 40))
    picked = known.withColumn("rank", rank).join(F.broadcast(shares), "lang").filter("rank < share").dropDuplicates(["lang", "rank"])  # one row of shares for each language
    picked = picked.select("lang", "text", (F.col("rank") % 10 == 0).alias("kept_back"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [weights(t, idf) for t in texts(batch.column(1))]
            cols = [pa.array([a.astype(np.int32) for a, _ in rows], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in rows], pa.list_(pa.float32()))]
            return pa.RecordBatch.from_arrays([batch.column(0), *cols, batch.column(2)], ["lang", "at", "x", "kept_back"])

        return step

    sample = map_rows(picked, "lang string, at array<int>, x array<float>, kept_back boolean", make).toArrow()
    number = {name: k for k, name in enumerate(languages)}
    rows = [(at.values.to_numpy(), x.values.to_numpy().astype(np.float64), number[y.as_py()]) for at, x, y in zip(sample["at"], sample["x"], sample["lang"], strict=True)]
    back = sample["kept_back"].to_pylist()
    learn = [r for r, b in zip(rows, back, strict=True) if not b] or rows
    w = ftrl(learn, BUCKETS, len(languages))
    rest = [r for r, b in zip(rows, back, strict=True) if b]
    t = temperature(np.array([x @ w[at] for at, x, _ in rest]), np.array([y for *_, y in rest])) if rest and len(languages) > 1 else 1.0
    return Model(languages, idf, w.astype(np.float32), t)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns of keep with two more, by default lang_pred and score."""
    keep = keep or [c for c in docs.columns if c != text]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2^15 weights: a bound of its own

    def make():
        model = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            said = [model.predict(t) for t in texts(batch.column(0))]
            cols = [pa.array([s for s, _ in said], pa.string()), pa.array([p for _, p in said], pa.float64())]
            return pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], [*keep, *names])

        return step

    kinds = dict(docs.dtypes)
    return map_rows(docs.select(F.col(f"`{text}`").alias("__text"), *[F.col(f"`{c}`") for c in keep]), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{names[0]}` string, `{names[1]}` double"]), make)


def held_out(key: str = "doc_id") -> Column:
    """Whether crc32 of the key as text leaves 1 when divided by 3; a null key isn't held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learned from the rows that aren't held out."""
    model = train(docs.filter(F.col("doc_id").isNotNull() & ~held_out()))
    return predict(docs.select("text", "doc_id", held_out().alias("held_out")), model)
