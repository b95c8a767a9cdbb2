"""Quality by weak labels: overlapping heuristic labellers, their accuracies by expectation-maximisation, and a linear scorer.

Every document gets the votes (good, bad or none) of all labellers. Documents are counted by vote pattern over the
whole table in Spark; there are at most 3^9 patterns, so EM runs on the driver over those counts and gives each
labeller's accuracies and each pattern's posterior. A logistic scorer on hashed features (character n-grams, shapes of
words, and coarse statistics) is then fitted to the posteriors on a bounded sample, about per_side documents from
each side (a parameter) picked by a hash of key and text, rows that repeat both once, and scores every document.

Null and empty text, and text without a word, is bad (score 0). Repeated rows count each. A table in which all
documents look alike gives the prior as every posterior. Very long texts are used whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_rows, texts

BUCKETS = 1 << 16
#: Frequent short words of English, German, French and Spanish.
STOP = frozenset(
    "the of and to in a is that for it was on are as with be by at this from der die und in den von zu das mit sich auf für ist im dem nicht ein eine le la les de des du et un une que qui dans est pour par sur pas au avec el los las y en del se por con una su para al lo como".split()
)
SYMBOLS = re.compile(r"[^\w\s.,;:'()+-]")
LABELLERS = ("capitals", "symbols", "repeats", "runs", "packing", "bars", "stop_words", "sentences", "lengths")


def statistics(text: str) -> np.ndarray:
    """One number for each labeller."""
    words = text.split()
    n = max(1, len(words))
    upper = sum(map(str.isupper, words))
    symbols = len(SYMBOLS.findall(text)) / max(1, len(text))
    same = list(map(eq, words, words[1:]))
    run = longest = 0
    if True in same:
        for s in same:
            run = run + 1 if s else 0
            longest = max(longest, run)
    raw = text.encode("utf-8", "surrogatepass")
    packed = len(zlib.compress(raw, 1)) / len(raw) if len(raw) >= 200 else 0.5
    counts = Counter(words)
    bare = plain = stop = 0
    for w, k in counts.items():
        core = w.strip(".,;:!?")
        if not core.isalnum() and not any(map(str.isalnum, core)):
            bare += k
        elif core.isalpha() and core[1:].islower() | (len(core) == 1):
            plain += k
        if len(core) < 5 and core.lower() in STOP:
            stop += k
    x = [upper / n, symbols, sum(same) / n, longest, packed, bare / n, stop / n, plain / n, sum(map(len, words)) / n]
    return np.array(x) if n >= LEAST_WORDS else np.full(len(x), np.nan)


#: With fewer words no labeller votes.
LEAST_WORDS = 6
#: For each labeller the range that it calls good and the range that it calls bad; elsewhere it doesn't vote.
GOOD = ((0, 0.3), (0, 0.05), (0, 0.05), (0, 2), (0.35, 1e12), (0, 0.05), (0.15, 1), (0.8, 1), (3, 9))
BAD = ((0.6, 1), (0.12, 1), (0.2, 1), (5, 1e12), (0, 0.28), (0.2, 1), (-1, 0.03), (-1, 0.4), (14, 1e12))


def votes(x: np.ndarray) -> int:
    """The votes as a number in base 3: 0 none, 1 good, 2 bad."""
    code = 0
    for v, (a, b), (c, d) in zip(x, GOOD, BAD, strict=True):
        code = 3 * code + (1 if a <= v <= b else 2 if c <= v <= d else 0)
    return code


def digits(code: int) -> list[int]:
    return [code // 3**k % 3 for k in reversed(range(len(LABELLERS)))]


def accuracies(patterns: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], np.ndarray, float]:
    """EM over pattern counts. Gives each pattern's probability of being good, table[y, labeller, vote], and the share of good documents."""
    codes = sorted(patterns)
    seen = np.array([digits(c) for c in codes])
    n = np.array([patterns[c] for c in codes], float)
    good, bad = (seen == 1).sum(axis=1), (seen == 2).sum(axis=1)
    # a bad vote is rarer and says more: two outweigh good votes of all other labellers, so that large groups of like bad documents don't begin, and stay, as good ones
    post = 1 / (1 + np.exp(3.0 * bad - 0.5 * good - 1))
    table = np.zeros((2, len(LABELLERS), 3))
    prior = 0.5
    for _ in range(rounds):
        sides = (n * (1 - post), n * post)
        prior = float(sides[1].sum() / n.sum())
        for y, w in enumerate(sides):
            for v in range(3):
                table[y, :, v] = ((seen == v) * w[:, None]).sum(axis=0) + 0.5
        table[:, :, 0] = 0  # no vote says nothing
        table /= table.sum(axis=2, keepdims=True)
        logs = np.log(np.where(table > 0, table, 1))
        like = [sum(logs[y, k, seen[:, k]] for k in range(len(LABELLERS))) for y in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1] + np.log((1 - prior + 1e-9) / (prior + 1e-9)), -50, 50)))
        if np.abs(new - post).max() < 1e-7:
            break
        post = new
    return dict(zip(codes, map(float, post), strict=True)), table, prior


def features(text: str, x: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: character 2- and 3-grams with case kept, and the statistics in coarse steps."""
    one = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    mix, shift = np.uint32(2654435761), np.uint32(32 - buckets.bit_length() + 1)
    two = (one[:-1] * np.uint32(0x01000193) ^ one[1:]) * mix
    three = (two[:-1] ^ one[2:] * np.uint32(0x85EBCA6B)) * mix
    counts = np.bincount(np.concatenate([two, three * np.uint32(0x9E3779B1)]) >> shift, minlength=buckets)
    at = np.flatnonzero(counts)
    v = 1 + np.log(counts[at])
    v /= max(1e-9, float(np.sqrt((v * v).sum())))
    x = np.where(np.isnan(x), -0.05, x)
    steps = np.minimum(20 * np.where(x > 1, x / 20, x), 20).astype(np.int64)
    shape = ((np.arange(len(x)) * 64 + steps + 1) * 40503 % buckets).astype(np.int64)
    return np.concatenate([at, shape]), np.concatenate([v, np.full(len(x), 0.5)])


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 12, rate: float = 0.5, l2: float = 1e-5) -> np.ndarray:
    """Logistic weights by AdaGrad on soft labels; the last weight is the bias."""
    w, sq = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            g = (1 / (1 + np.exp(-np.clip(x @ w[at], -30, 30))) - y) * x + l2 * w[at]
            sq[at] += g * g
            w[at] -= rate * g / np.sqrt(sq[at])
    return w


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", per_side: int = 1500, keep: list[str] | None = None, names: tuple[str, str, str] = ("votes", "posterior", "quality")) -> DataFrame:
    """The columns of keep (key by default) with three more, by default votes, posterior (of the labellers) and quality (0 to 1, of the scorer)."""
    keep = keep or [key]

    def count():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = Counter(votes(statistics(t)) for t in texts(batch.column(0)))
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), pa.array(found.values(), pa.int64())], ["votes", "n"])

        return step

    patterns = {r.votes: r.n for r in map_rows(docs.select(text), "votes int, n long", count).groupBy("votes").agg(F.sum("n").alias("n")).collect()}
    post, _, _ = accuracies(patterns) if patterns else ({}, None, 0.5)
    # the share of each side that is sampled, by a hash of key and text
    sides = [sum(n for c, n in patterns.items() if (post[c] >= 0.5) == y) for y in (False, True)]
    shares = [min(1 << 40, round((1 << 40) * per_side / max(1, n))) for n in sides]

    def sample():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows = []
            for t, rank in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                x = statistics(t)
                p = post[votes(x)]
                if rank < shares[p >= 0.5]:
                    rows.append((*features(t, x), p))
            if not rows:
                return None
            at, v, p = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([a.astype(np.float32) for a in v], pa.list_(pa.float32())), pa.array(p, pa.float64())], ["at", "x", "p"])

        return step

    rank = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text)), F.lit(1 << 40)).alias("rank")
    most = max(shares, default=0)
    chosen = map_rows(docs.select(F.col(text).alias("text"), rank).filter(F.col("rank") < most).dropDuplicates(["rank"]), "at array<int>, x array<float>, p double", sample).toArrow() if patterns else None
    rows = [(a.values.to_numpy(), x.values.to_numpy().astype(float), p.as_py()) for a, x, p in zip(chosen["at"], chosen["x"], chosen["p"], strict=True)] if chosen is not None else []
    w = fit(rows).astype(np.float32) if rows else np.zeros(BUCKETS + 1, np.float32)
    w[BUCKETS] += np.log(max(1, sides[1]) / max(1, sides[0])) - np.log(max(1, shares[1] * sides[1]) / max(1, shares[0] * sides[0]))  # the sides' shares as they are in the table
    shared = docs.sparkSession.sparkContext.broadcast((w, post))  # 2^16 weights and at most 3^9 patterns

    def score():
        w, post = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for t in texts(batch.column(0)):
                x = statistics(t)
                code = votes(x)
                at, v = features(t, x)
                z = float(v @ w[at] + w[BUCKETS])
                out.append((code, post.get(code, 0.5), 1 / (1 + float(np.exp(-np.clip(z, -30, 30)))) if any(map(str.isalnum, t)) else 0.0))
            code, p, q = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(code, pa.int32()), pa.array(p, pa.float64()), pa.array(q, pa.float64())], [*keep, *names])

        return step

    kinds = dict(docs.dtypes)
    return map_rows(docs.select(F.col(f"`{text}`").alias("__text"), *[F.col(f"`{c}`") for c in keep]), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{names[0]}` int, `{names[1]}` double, `{names[2]}` double"]), score)


def classify(docs: DataFrame, least: float = 0.6) -> DataFrame:
    """doc_id, quality, posterior and keep of every document."""
    return judge(docs).select("doc_id", "quality", "posterior", (F.col("quality") >= least).alias("keep"))
