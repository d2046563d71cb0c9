"""Vectorised 64-bit hashes of words, word shingles and byte windows, equal on every worker."""

from __future__ import annotations

import numpy as np

_B = 0x9E3779B97F4A7C15 | 1
_BASE, _INVERSE = np.uint64(_B), np.uint64(pow(_B, -1, 1 << 64))
#: One random word for each byte value, from a fixed generator.
BYTE_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Bytes hashed at a time; powers are kept for so many.
SLICE = 1 << 22

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            all_ = np.full(max(n, 4096), base, np.uint64)
            all_[0] = 1
            _powers[name] = np.multiply.accumulate(all_)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread each word's bits over all 64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of code times power before each position, one more than there are bytes; words of 64 bits are codes."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((BYTE_CODES[data] if data.dtype == np.uint8 else data) * up, out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes from each start to each end, wherever they stand."""
    _, down = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each run of bytes other than space and tab to carriage return, A-Z in lower case."""
    return word_spans(text.lower())[2]


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each run of bytes other than space and tab to carriage return."""
    data = np.frombuffer(text, np.uint8)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        if end < len(data):  # end the slice at a separator
            gaps = np.flatnonzero(_SEPARATOR[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                more = np.flatnonzero(_SEPARATOR[data[end:]])
                end = end + int(more[0]) + 1 if len(more) else len(data)
        part = data[at:end]
        edge = np.diff(np.concatenate([[True], _SEPARATOR[part], [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(starts):
            out.append((starts + at, ends + at, spans_hash(prefix_sums(part), starts, ends)))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))


def shingle_set(text: bytes, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; of all words where there are fewer; none without words."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        h = mixed(h * _BASE + words[j : len(words) - n + 1 + j])
    return np.unique(h)
