"""Hashes of the words of a batch of texts, computed with NumPy over the bytes of the whole batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0x589965CC75374CC3))
#: Bytes that are hashed at once; a longer text is hashed on its own.
CHUNK = 1 << 20
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, min(2 * n, 2 * CHUNK), 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers[key][:n]


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column without NULLs."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def lowered(raw: np.ndarray) -> np.ndarray:
    return raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)


def _chunk(raw: np.ndarray, offsets: np.ndarray, lower: bool = True, marks: np.ndarray | None = None):
    """Word hashes of the texts between the offsets, words per text, and each word's first and last byte.

    With ``marks``, 256 flags, a word also ends at a letter or digit of ASCII before a marked byte.
    """
    data = raw[offsets[0]:offsets[-1]]
    data = lowered(data) if lower else data
    cuts = offsets - offsets[0]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64), none, none
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = cuts[(cuts > 0) & (cuts < n)]
    if marks is not None:
        inner = np.union1d(inner, 1 + np.flatnonzero(_ALNUM[data[:-1]] & marks[data[1:]]))
    begins[inner] = solid[inner]
    starts = np.flatnonzero(begins)
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[inner - 1] = solid[inner - 1]
    stops = np.flatnonzero(ends)
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), dtype=np.uint64)
    head = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    value = (sums[stops] - head) * _power(_BACK, n)[starts]
    hashes = mixed(value ^ ((stops - starts + 1).astype(np.uint64) * _PLACES[1]))
    return hashes, np.diff(np.searchsorted(starts, cuts)), starts + offsets[0], stops + offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in order, number of words per text).

    Words are runs of bytes other than white space, with A-Z in lower case; NULL has none.
    """
    raw, offsets = _buffers(texts)
    parts, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in pieces(offsets):
        h, c, _, _ = _chunk(raw, offsets[a:b + 1])
        parts.append(h)
        counts.append(c)
    return np.concatenate(parts), np.concatenate(counts)


def pieces(offsets: np.ndarray, size: int = CHUNK):
    """Runs of texts of about ``size`` bytes, as (first, behind the last)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to
        at = to


def grams(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside a text, and their number per text.

    A text of fewer words, but not none, has one run: all its words.
    """
    full = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    place = _power(_PLACES[0], size)
    for j in range(size):
        full += words[j:j + len(full)] * place[j]
    full = mixed(full)
    n = np.maximum(counts - size + 1, 0)
    first = np.cumsum(counts) - counts
    keep = np.zeros(len(full) + 1, np.int64)
    some = n > 0
    np.add.at(keep, first[some], 1)
    np.add.at(keep, (first + n)[some], -1)
    inside = np.cumsum(keep)[:len(full)] > 0
    short = (counts > 0) & (counts < size)
    if not short.any():
        return full[inside], n
    whole = counts[short].astype(np.uint64) * _PLACES[1]
    for j in range(size - 1):
        has = counts[short] > j
        whole[has] += words[first[short][has] + j] * place[j]
    out_n = np.where(short, 1, n)
    out = np.empty(int(out_n.sum()), np.uint64)
    at = np.cumsum(out_n) - out_n
    is_whole = np.zeros(len(out), bool)
    is_whole[at[short]] = True
    out[is_whole], out[~is_whole] = mixed(whole), full[inside]
    return out, out_n
