"""Word shingles and minwise sketches of whole texts, in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the memory of a task.
CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_POWER = np.uint64(0x9E3779B97F4A7C15)
_STEP = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
MAX_FUNCTIONS = 64
_A = _rng.integers(0, 2**64, MAX_FUNCTIONS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**64, MAX_FUNCTIONS, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) and, per text, where its words begin (n + 1)."""
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    solid = ~_SPACE[data]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    new = np.empty(len(at), bool)
    new[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=new[1:])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, size)
    powers = np.cumprod(np.full(int(size.max()), _POWER))
    hashes = mixed(np.add.reduceat(_BYTE[data[at]] * powers[place], first) + size.astype(np.uint64))
    return hashes, np.searchsorted(at[first], np.concatenate([[0], ends])).astype(np.int64)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles of ``width`` words, sorted; a text of fewer words has
    its whole sequence as one; one without words has none."""
    words, begin = word_hashes(texts)
    out = []
    n = len(words)
    joined = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        joined += mixed(words[k : n - width + 1 + k] * _STEP[k] + np.uint64(k))
    joined = mixed(joined)
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            short = words[a:b] * _STEP[32 : 32 + b - a] + np.uint64(b - a)
            out.append(mixed(mixed(short).sum(keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minwise(sets: list[np.ndarray], functions: int) -> np.ndarray:
    """Minimum of each hash function over each set, as signed longs; empty sets give 0."""
    out = np.zeros((len(sets), functions), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        every = np.concatenate([sets[i] for i in full])
        begin = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        for k in range(functions):
            v = every * _A[k] + _B[k]
            v ^= v >> np.uint64(32)
            out[full, k] = np.minimum.reduceat(v * _A[-1 - k], begin)
    return out.view(np.int64)


def chunks(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """A column of texts as (first row, texts) of about CHUNK_BYTES; null is empty."""
    start, size, part = 0, 0, []
    for i, x in enumerate(column):
        t = b"" if not x.is_valid else x.as_buffer().to_pybytes()
        part.append(t)
        size += len(t)
        if size >= CHUNK_BYTES:
            yield start, part
            start, size, part = i + 1, 0, []
    if part:
        yield start, part
