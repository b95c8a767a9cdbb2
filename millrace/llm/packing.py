"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each task packs the documents of its own partition, so nothing is shuffled. A piece goes to the fill level h that
makes the sum over levels of (number of open windows at that level) squared smallest; the counts are kept in one array
indexed by level. Documents longer than a window fill whole windows first and the remainder is packed. When a
partition ends, the windows still open are closed by cutting pieces of the emptiest to top up the fullest, so at most
one window of a partition is padded.

Null or empty text is a document of its end token alone; a null doc_id stays null; repeated rows are packed each on
their own; an empty table gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from string import punctuation
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from millrace.llm.bpe import byte_letters
from millrace.llm.common import parts_of, texts

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ChunkTokens:
    """Ids of texts by a tokenizers file whose pre-tokenizer drops white space and whose normalizer lower-cases.

    White-space-free chunks are coded once and kept in a bounded table. Of new chunks, those made of letters, with or
    without punctuation at the end, go to the library's model as words, the others to its whole tokenizer.
    """

    def __init__(self, path: str, eos: int | None, limit: int = 800_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.eos = b"" if eos is None else np.uint32(eos).tobytes()
        self.letters = {b: c for c, b in byte_letters().items()}
        self.limit = limit
        self.known: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}

    def learn(self, chunks: set[str]) -> None:
        """Put the ids of new chunks in the table."""
        if len(self.known) + len(chunks) > self.limit:
            self.known = {"": b""}
            chunks = chunks | {""}
        if len(self.words) > self.limit:
            self.words = {}
        parts: dict[str, tuple[str, str]] = {}
        single = []
        for chunk in chunks - {""}:
            bare = chunk.rstrip(punctuation)
            if bare.isalpha() and "\u0130" not in bare and "\u03a3" not in bare:
                parts[chunk] = bare.lower(), chunk[len(bare) :]
            else:
                single.append(chunk)
        self.words.update((w, self.word(w)) for w in {w for w, _ in parts.values()}.difference(self.words))
        ends = list({e for _, e in parts.values() if e}.difference(self.known))
        self.known.update(zip(ends, self.alone(ends), strict=True))
        self.known.update((c, self.words[w] + self.known[e]) for c, (w, e) in parts.items())
        self.known.update(zip(single, self.alone(single), strict=True))

    def word(self, word: str) -> bytes:
        """Ids of one lower-case word of letters: one pre-token, whose bytes' letters go to the model."""
        letters = word if word.isascii() else normalize("NFC", word).encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.model.tokenize(letters)]).tobytes()

    def alone(self, chunks: list[str]) -> list[bytes]:
        return [np.array(c.ids, np.uint32).tobytes() for c in self.model.encode_batch_fast(chunks, add_special_tokens=False)]

    def __call__(self, batch: list[str]) -> Iterator[np.ndarray]:
        """Ids of each of a batch of texts."""
        split, new = [], set()
        for text in batch:
            for blank in "\n\t\r":
                text = text.replace(blank, " ")
            split.append(text.split(" "))
            new.update(split[-1])
        fresh = new.difference(self.known)
        if fresh:
            self.learn(new if len(self.known) + len(fresh) > self.limit else fresh)
        for chunks in split:
            yield np.frombuffer(b"".join(map(self.known.__getitem__, chunks)) + self.eos, np.uint32)


class SumOfSquares:
    """Open windows by fill level. place() returns the window that a piece of the given size went to."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        # what a level adds to the sum of squares as the one that a window leaves (never one without windows, but for the empty one) and as the one that it comes to
        self.left, self.met = np.full(capacity + 1, 1 << 40), np.zeros(capacity + 1, np.int64)
        self.left[0] = self.met[capacity] = -1
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]

    def level(self, size: int) -> int:
        """The level whose use makes the sum of squared counts smallest; ties go to the fullest."""
        top = self.capacity - size
        # moving a window from h to h + size changes the sum by 2 (N[h + size] - N[h]) + 2, one less each if h is empty or h + size full
        change = self.met[size:] + self.left[: top + 1]
        return top - int(change[::-1].argmin())

    def count(self, level: int, more: int) -> None:
        self.counts[level] += more
        n = int(self.counts[level])
        self.met[level], self.left[level] = 2 * n, -2 * n if n else 1 << 40

    def place(self, piece: tuple, size: int) -> list | None:
        """Put a piece in; a window that it fills is returned and forgotten."""
        h = self.level(size)
        if h:
            window = self.open[h].pop()
            self.count(h, -1)
        else:
            window = []
        window.append(piece)
        if h + size == self.capacity:
            return window
        self.open[h + size].append(window)
        self.count(h + size, 1)
        return None

    def rest(self) -> list[list]:
        """The windows still open, fullest first."""
        return [w for level in reversed(self.open) for w in level]


def close(windows: list[list], capacity: int) -> Iterator[list]:
    """Top up the fullest windows with pieces cut from the emptiest."""
    windows = list(windows)
    low = len(windows) - 1
    spare: list[tuple] = []
    for k, window in enumerate(windows):
        if k > low and not spare:
            return
        if k > low:
            window = []
        room = capacity - sum(len(p[2]) for p in window)
        while room:
            if not spare:
                if low <= k:
                    break
                spare = list(windows[low])
                low -= 1
            key, start, ids, total = spare.pop()
            if len(ids) > room:
                spare.append((key, start + room, ids[room:], total))
                ids = ids[:room]
            window = [*window, (key, start, ids, total)]
            room -= len(ids)
        yield window
    if spare:
        yield spare


def pack(docs: DataFrame, tokens: Callable[[], Callable[[list[str]], Iterable[np.ndarray]]], capacity: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each piece of each document (columns of PIECES); tokens() gives, once in each task, the function from a batch of texts to their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = tokens(), SumOfSquares(capacity)
        base, made = TaskContext.get().partitionId() << 36, 0
        rows: list[tuple] = []

        def emit(window: list) -> None:
            nonlocal made
            at = 0
            for doc, start, ids, total in window:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, base + made, at))
                at += len(ids)
            made += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            names = [c.split()[0] for c in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        for batch in parts_of(batches):
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts(batch.column(1))), strict=True):
                ids = ids.astype("<u4", copy=False)
                whole = len(ids) // capacity * capacity
                for start in range(0, whole, capacity):
                    emit([(doc, start, ids[start : start + capacity], len(ids))])
                if whole < len(ids) and (full := bins.place((doc, whole, ids[whole:], len(ids)), len(ids) - whole)):
                    emit(full)
            if rows:
                yield flush()
        for window in close(bins.rest(), capacity):
            emit(window)
        if rows:
            yield flush()

    return docs.select(key, text).mapInArrow(run, PIECES)
