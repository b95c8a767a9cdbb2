"""Telephony audio: WAV containers with mu-law, A-law or IMA ADPCM samples, decoded by lookup tables and resampled to PCM.

store() writes, for each row, the payload as a WAV file in a binary column of a table in the shared folder, reads it back and gives beside it
that file's sound as 16-bit PCM at pcm_rate. The sound follows from the stored file, so that it takes no disk of its own: it is decoded where
it is read, every sample of it. Mu-law and A-law are one byte a sample and
expand by a 256-entry table; IMA ADPCM holds 128 nibbles in each 68-byte block (4-byte header) and is decoded step by
step across all blocks at once. Every byte of a payload is a sample (or two nibbles), so that it comes back unchanged.

Null text is an empty payload, which is padded to one block of zeros; repeated rows give equal files; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_rows, stored, texts

#: WAV format tags.
PCM, ADPCM, ALAW, MULAW = 1, 17, 6, 7
CODECS = (MULAW, ALAW, ADPCM)
NAMES = {PCM: "pcm", ADPCM: "adpcm", ALAW: "alaw", MULAW: "mulaw"}
#: The index steps of IMA ADPCM by nibble.
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int64)
#: The 89 step sizes of IMA ADPCM.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
     157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
     1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
     12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int64)
BLOCK = 64


def mulaw_table() -> np.ndarray:
    """16-bit value of each mu-law byte."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit value of each A-law byte."""
    code = np.arange(256) ^ 0x55
    part, low = code >> 4 & 7, (code & 0x0F) << 4
    size = np.where(part == 0, low + 8, low + 0x108 << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def padded(text: str) -> tuple[bytes, int]:
    """UTF-8 of a text with zero bytes up to a positive multiple of a block, and the length before that."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK)), len(raw)


def wav(payload: bytes, codec: int, rate: int, block: int, bits: int, extra: bytes = b"", samples: int = 0) -> bytes:
    """A mono WAV file."""
    layout = struct.pack("<HHIIHH", codec, 1, rate, rate * block // max(1, samples or 1), block, bits) + (struct.pack("<H", len(extra)) + extra if codec != PCM else b"")
    fact = struct.pack("<4sII", b"fact", 4, len(payload) // block * max(1, samples or 1)) if codec != PCM else b""
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(layout)) + layout + fact + struct.pack("<4sI", b"data", len(payload)) + payload + bytes(len(payload) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def chunks(data: bytes) -> dict[bytes, bytes]:
    """The chunks of a RIFF file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found = 12, {}
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        found[name] = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return found


def encode(payload: bytes, codec: int, rate: int) -> bytes:
    """The payload, a multiple of 64 bytes, as a WAV file."""
    if codec != ADPCM:
        return wav(payload, codec, rate, 1, 8, samples=1)
    body = np.zeros((len(payload) // BLOCK, BLOCK + 4), np.uint8)
    body[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    samples = 2 * BLOCK + 1
    return wav(body.tobytes(), ADPCM, rate, BLOCK + 4, 4, struct.pack("<H", samples), samples)


def payload_of(data: bytes) -> tuple[bytes, int, int]:
    """Payload, codec and rate of a WAV file that encode() made."""
    found = chunks(data)
    codec, _, rate = struct.unpack("<HHI", found[b"fmt "][:8])
    body = found[b"data"]
    if codec == ADPCM:
        body = np.frombuffer(body, np.uint8).reshape(-1, BLOCK + 4)[:, 4:].tobytes()
    return body, codec, rate


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """16-bit samples of IMA ADPCM blocks (rows of header and nibbles): the steps of all blocks run side by side."""
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int64)
    index = np.minimum(blocks[:, 2].astype(np.int64), 88)
    nibbles = np.empty((len(blocks), 2 * (blocks.shape[1] - 4)), np.uint8)
    nibbles[:, ::2], nibbles[:, 1::2] = blocks[:, 4:] & 15, blocks[:, 4:] >> 4
    steps = np.ascontiguousarray(nibbles.T).astype(np.int64)
    out = np.empty((len(steps) + 1, len(blocks)), np.int16)
    out[0] = value
    for k, nibble in enumerate(steps, 1):
        step = STEPS[index]
        size = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
        value = np.clip(np.where(nibble & 8, value - size, value + size), -32768, 32767)
        index = np.clip(index + INDEX_STEPS[nibble], 0, 88)
        out[k] = value
    return np.ascontiguousarray(out.T).reshape(-1)


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """16-bit samples and rate of a WAV file."""
    found = chunks(data)
    codec, _, rate, _, block, _ = struct.unpack("<HHIIHH", found[b"fmt "][:16])
    body = np.frombuffer(found[b"data"], np.uint8)
    if codec == PCM:
        return body.view("<i2"), rate
    return (adpcm(body.reshape(-1, block)) if codec == ADPCM else TABLES[codec][body]), rate


def decode_all(files: list[bytes], at_once: int = 1 << 15) -> list[tuple[np.ndarray, int]]:
    """decode() of each file; the ADPCM blocks of all files go side by side."""
    out: list = [None] * len(files)
    bodies, owners = [], []
    for k, data in enumerate(files):
        found = chunks(data)
        codec, _, rate, _, block, _ = struct.unpack("<HHIIHH", found[b"fmt "][:16])
        if codec == ADPCM and block == BLOCK + 4:
            bodies.append(np.frombuffer(found[b"data"], np.uint8).reshape(-1, block))
            owners.append((k, rate))
        else:
            out[k] = decode(data)
    if bodies:
        blocks = np.concatenate(bodies)
        sound = np.concatenate([adpcm(blocks[a : a + at_once]) for a in range(0, len(blocks), at_once)])
        at = 0
        for (k, rate), body in zip(owners, bodies, strict=True):
            n = len(body) * (2 * BLOCK + 1)
            out[k] = sound[at : at + n], rate
            at += n
    return out


@cache
def phases(n: int, half: int = 16, beta: float = 8.0) -> list[np.ndarray]:
    """The n - 1 filters between two samples: a sinc in a Kaiser window, in whole 2^-15 parts that sum to 1."""
    out = []
    for k in range(1, n):
        at = np.arange(1 - half, half + 1) - k / n
        taps = np.round(32768 * np.sinc(at) * np.i0(beta * np.sqrt(1 - (at / half) ** 2)) / np.i0(beta))
        taps[np.argmax(taps)] += 32768 - taps.sum()
        out.append(taps)
    return out


def raised(samples: np.ndarray, n: int, at_once: int = 1 << 18) -> np.ndarray:
    """Samples at n times the rate: the given ones and n - 1 between each two by filters; the ends are held. Sums of whole numbers are exact in any order."""
    out, filters = np.empty((len(samples), n), np.int16), phases(n)
    half = len(filters[0]) // 2
    out[:, 0] = samples
    for a in range(0, len(samples), at_once):
        b = min(len(samples), a + at_once)
        x = samples[max(0, a - half + 1) : b + half].astype(np.float64)
        x = np.pad(x, (max(0, half - 1 - a), max(0, b + half - len(samples))), mode="edge")
        for k, taps in enumerate(filters, 1):
            out[a:b, k] = np.clip(np.floor((np.correlate(x, taps, "valid") + 16384) / 32768), -32768, 32767)
    return out.reshape(-1)


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Samples at another rate: filters between the samples where the rate divides it, means of whole windows where it divides the rate, else linear interpolation."""
    if rate == to or not len(samples):
        return samples
    if to % rate == 0:
        return raised(samples, to // rate)
    if rate % to == 0:
        n = rate // to
        tail = -len(samples) % n
        full = np.concatenate([samples, np.repeat(samples[-1:], tail)]) if tail else samples
        return np.round(full.reshape(-1, n).mean(axis=1)).astype(np.int16)
    at = np.arange(max(1, len(samples) * to // rate)) * (rate / to)
    return np.round(np.interp(at, np.arange(len(samples)), samples)).astype(np.int16)


def store(docs: DataFrame, text: str = "text", key: str = "doc_id", rate: int = 8000, pcm_rate: int = 8000) -> DataFrame:
    """Write key, n_bytes and media (the WAV file), read them back and add pcm (a WAV file of the stored one's sound).

    The codec of a row follows from its payload's checksum, so that equal texts give equal files."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            payloads = [padded(t) for t in texts(batch.column(1))]
            sizes = [n for _, n in payloads]
            media = [encode(p, CODECS[zlib.crc32(p) % 3], rate) for p, _ in payloads]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

        return step

    return heard(stored(map_rows(docs.select(key, text), f"{key} {dict(docs.dtypes)[key]}, n_bytes long, media binary", make), "media"), key, pcm_rate)


def heard(files: DataFrame, key: str = "doc_id", pcm_rate: int = 8000) -> DataFrame:
    """key, n_bytes and media of stored files, and pcm: a WAV file of each one's sound at pcm_rate."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sounds = decode_all(batch.column(2).to_pylist())
            pcm = [wav(resample(*sound, pcm_rate).astype("<i2").tobytes(), PCM, pcm_rate, 2, 16, samples=1) for sound in sounds]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(pcm, pa.binary())], [key, "n_bytes", "media", "pcm"])

        return step

    return map_rows(files.select(key, "n_bytes", "media"), f"{key} {dict(files.dtypes)[key]}, n_bytes long, media binary, pcm binary", make)


def describe(stored_media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests of the stored files and of the payloads read back from them, and features of the stored sound."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for n, file, sound in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                payload, codec, rate = payload_of(file)
                pcm, pcm_rate = decode(sound)
                loud = math.isqrt(sum(int(np.square(pcm[a : a + (1 << 18)], dtype=np.int64).sum()) for a in range(0, len(pcm), 1 << 18)) // len(pcm))
                below = pcm < 0
                crossings = int(np.count_nonzero(below[1:] != below[:-1]))
                peak = max(int(pcm.max()), -int(pcm.min()))
                feature = f"{NAMES[codec]} {rate} Hz; pcm {pcm_rate} Hz, {len(pcm)} samples, rms {loud}, peak {peak}, crossings {crossings}, crc32 {zlib.crc32(sound)}"
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(file), hashlib.sha256(file).hexdigest(), feature))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), *cols], [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

        return step

    cols: list[Column] = [F.col(c) for c in (key, "n_bytes", "media", "pcm")]
    return map_rows(
        stored_media.select(*cols),
        f"{key} {dict(stored_media.dtypes)[key]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
        make,
    )
