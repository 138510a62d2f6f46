"""Word shingles of whole batches of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 1 << 64)
#: Bytes hashed at a time; a longer word is still hashed whole.
STRETCH = 1 << 18


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * U(0x7FB5D329728EA185)
    h = h ^ (h >> U(27))
    h = h * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P, dtype=U), np.full(n, _INVERSE, dtype=U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """A number for each byte, the same for A-Z as for a-z."""
    table = _mixed(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
    table[65:91] = table[97:123]
    return table


@lru_cache(maxsize=1)
def _spaces() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty), and where each starts and the last ends."""
    texts = texts.cast(pa.binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return data, ends - ends[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of ``texts`` (A-Z in lower case, split at 0x20 and 0x09-0x0D), and where each text's words start."""
    data, ends = text_bytes(texts)
    space = _spaces()[data]
    first = np.ones(len(data) + 1, dtype=bool)
    first[1:] = False
    first[ends] = True
    inside = ~space
    starts = inside.copy()
    if len(data):
        starts[1:] &= space[:-1] | first[1:-1]
        last = inside.copy()
        last[:-1] &= space[1:] | first[1:-1]
        begin, end = np.flatnonzero(starts), np.flatnonzero(last) + 1
    else:
        begin = end = np.zeros(0, dtype=np.int64)
    counts = np.searchsorted(begin, ends)
    out = np.zeros(len(begin), dtype=U)
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(end, begin[at] + STRETCH, side="right")))
        low, high = int(begin[at]), int(end[to - 1])
        up, down = _powers(max(STRETCH, high - low) if high - low <= STRETCH else high - low)
        sums = np.zeros(high - low + 1, dtype=U)
        np.cumsum(_letters()[data[low:high]] * up[: high - low], out=sums[1:])
        b, e = begin[at:to] - low, end[at:to] - low
        out[at:to] = _mixed((sums[e] - sums[b]) * down[b] + (e - b).astype(U))
        at = to
    return out, counts


def shingle_sets(texts: pa.Array, n: int = 3) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``n`` words; the whole text's if it has fewer words, none without words."""
    words, at = word_hashes(texts)
    out = []
    weights = [U(w) for w in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
    if len(words) >= n:
        every = np.zeros(len(words) - n + 1, dtype=U)
        for i in range(n):
            every += words[i : len(words) - n + 1 + i] * weights[i]
        every = _mixed(every)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(every[a : b - n + 1]))
        elif b > a:
            short = np.zeros(1, dtype=U)  # wraps around, as all sums here do
            for i, w in enumerate(words[a:b]):
                short += np.array([w]) * weights[i]
            out.append(_mixed(short ^ U(0x5851F42D4C957F2D + b - a)))
        else:
            out.append(np.zeros(0, dtype=U))
    return out
