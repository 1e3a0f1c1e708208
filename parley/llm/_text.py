"""Vectorised views of a batch of texts (numpy over Arrow buffers), used inside mapInArrow tasks.

Texts are cut into slices of about SLICE bytes of whole documents, so that the working arrays stay a few
tens of MB however large an Arrow batch is; a longer document forms a slice of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18
U64 = np.uint64
_R = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_RI = U64(pow(int(_R), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}

#: [\x20\x09-\x0D] as a byte mask; valid on UTF-8, whose other bytes are all 0x80 or more.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A fixed pseudo-random number for each byte.
BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Odd multipliers for the places of a sequence of up to 64 words.
PLACE = np.random.default_rng(20240502).integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, SLICE + (SLICE >> 2))
        for k, r in (("up", _R), ("down", _RI)):
            p = np.full(size, r, U64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U64)
    return _powers["up"][:n], _powers["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = the sum of BYTE[data[k]] * R**k over i <= k < j, modulo 2**64."""
    up, _ = _upto(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], alike for alike bytes wherever they stand."""
    _, down = _upto(len(p))
    return mix((p[end] - p[start]) * down[start] + (end - start).astype(U64) * PLACE[0])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and n + 1 offsets. A null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "" if not pa.types.is_binary(texts.type) else b"")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    n = len(texts)
    offs = np.frombuffer(offsets, kind)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def give_back() -> None:
    """Python workers outlive their tasks: hands memory that is free again back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts."""
    data, offs = buffers(texts)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        hi = min(hi, lo + 65536, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
    if len(data) > 1 << 20:
        give_back()


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that stay within a text: starts, ends, and for each text the index of its first run (n + 1)."""
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offs[:-1][offs[:-1] < n]] = False
        after[offs[1:][offs[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def sequence_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k words in a row; words holds well mixed hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, U64(k), U64)
    for i in range(k):
        out += words[i : i + n] * PLACE[i]
    return mix(out)
