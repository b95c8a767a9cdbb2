"""Byte-level BPE: encoding by a priority queue of merge ranks over a doubly linked symbol list, decoding by concatenation.

Encoding one pre-token puts its bytes' symbols in a doubly linked list and every adjacent pair that merges in a heap
keyed by (rank, position). Popped entries whose pair is no longer there are stale and skipped. Pre-tokens seen before
come from a bounded table of the worker. Null text encodes as empty; very long pre-tokens cost n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millrace.llm.common import map_rows

#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """A tokenizer file's vocabulary, merges and added tokens."""

    def __init__(self, path: str, limit: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.strings: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, k in vocab.items():
            self.strings[k] = bytes(letters[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, k in self.added.items():
            self.strings[k] = token.encode()
        self.decimal = [str(k) for k in range(len(self.strings))]
        self.first = [vocab[c] for c in sorted(letters, key=letters.get)]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 20 | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.split = regex.compile(PATTERN)
        self.special = re.compile("|".join(map(re.escape, self.added))) if self.added else None
        self.limit = limit
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        symbols = list(map(self.first.__getitem__, word))
        n = len(symbols)
        if n < 2:
            return symbols
        rank_of, merged, push, pop = self.rank.get, self.merged, heapq.heappush, heapq.heappop
        after = [*range(1, n), -1]
        before = list(range(-1, n - 1))
        heap = [r << 32 | i for i, (a, b) in enumerate(pairwise(symbols)) if (r := rank_of(a << 20 | b, -1)) >= 0]
        heapq.heapify(heap)
        while heap:
            entry = pop(heap)
            i = entry & 0xFFFFFFFF
            j = after[i]
            a = symbols[i]
            if j < 0 or a < 0 or rank_of(a << 20 | symbols[j]) != (r := entry >> 32):
                continue  # stale: one of the two was merged away
            symbols[i], symbols[j] = a, _ = merged[r], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (s := rank_of(a << 20 | symbols[k], -1)) >= 0:
                    push(heap, s << 32 | i)
            h = before[i]
            if h >= 0 and (s := rank_of(symbols[h] << 20 | a, -1)) >= 0:
                push(heap, s << 32 | h)
        return [s for s in symbols if s >= 0]

    def plain(self, text: str) -> bytes:
        """Ids (unsigned 32 bit) of a text, by the pattern."""
        words, out = self.words, []
        for word in self.split.findall(text):
            ids = words.get(word)
            if ids is None:
                ids = array("I", self.merge(word.encode())).tobytes()
                if len(word) < 64:
                    if len(words) >= self.limit:
                        words.clear()
                    words[word] = ids
            out.append(ids)
        return b"".join(out)

    def chunk(self, word: str) -> bytes:
        """As plain(), for a space and a chunk without white space."""
        bare = word[:-1] if word[-1:] in {",", "."} else word
        if not bare.isalpha():
            return self.plain(" " + word)
        ids = self.chunks.get(bare)
        if ids is None:
            ids = array("I", self.merge(f" {bare}".encode())).tobytes()
            if len(bare) < 64:
                self.chunks[bare] = ids
        return ids if bare is word else ids + self.plain(word[-1])

    def blocks(self, text: str) -> bytes:
        """As plain(), for a text without added tokens. A single space before a visible character always starts a pre-token, so that
        such texts are cut at their spaces and the chunks kept; a text with longer runs of white space is split as a whole."""
        if re.search(r"\s \s|\s \Z", text) or " " not in text or text[0] == " ":
            return self.plain(text)
        head, *tail = text.split(" ")
        chunks = self.chunks
        try:
            return self.plain(head) + b"".join(map(chunks.__getitem__, tail))
        except KeyError:
            if len(chunks) >= self.limit:
                chunks.clear()
            for t in set(tail).difference(chunks):
                chunks[t] = self.chunk(t)
            return self.plain(head) + b"".join(map(chunks.__getitem__, tail))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text. Added tokens are found first, as the tokenizers library does."""
        if not self.special or not self.special.search(text):
            return np.frombuffer(self.blocks(text), np.uint32)
        parts, at = [], 0
        for m in self.special.finditer(text):
            parts += [self.blocks(text[at : m.start()]) if m.start() > at else b"", np.uint32(self.added[m.group()]).tobytes()]
            at = m.end()
        parts.append(self.blocks(text[at:]) if at < len(text) else b"")
        return np.frombuffer(b"".join(parts), np.uint32)

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings concatenated; bytes that aren't UTF-8 become the replacement character."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    """One for each worker process."""
    return ByteBpe(path)


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc key and its ids (array of int)."""

    def make():
        bpe = tokenizer(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [bpe.encode(v.as_py() or "").astype(np.int32) for v in batch.column(1)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

        return step

    return map_rows(docs.select(key, text), f"{key} {dict(docs.dtypes)[key]}, ids array<int>", make)


def decode(coded: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """doc key and the text of its ids; null ids give null."""

    def make():
        bpe = tokenizer(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [None if (v := x.as_py()) is None else bpe.decode(v) for x in batch.column(1)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, "text"])

        return step

    return map_rows(coded.select(key, ids), f"{key} {dict(coded.dtypes)[key]}, text string", make)


def digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each document its number of ids, and digests of the ids and of the text decoded from them; both ways in one task."""

    def make():
        bpe = tokenizer(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, coded, decoded = [], [], []
            for v in batch.column(1):
                ids = bpe.encode(v.as_py() or "").tolist()
                counts.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    return map_rows(docs.select(key, text), f"{key} {dict(docs.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
