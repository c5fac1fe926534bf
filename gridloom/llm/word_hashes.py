"""Hashes of the words of a text, and of stretches of them, by sums of powers: no table of words is kept."""

from __future__ import annotations

import numpy as np

#: Bytes of text, and words, hashed at once; words longer than LONG_WORD bytes are hashed one by one.
CHUNK, LONG_WORD = 1 << 18, 256
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Roll:
    """Hashes of all stretches of a sequence by sums of powers modulo 2**64; ``inverse`` undoes a power."""

    def __init__(self, base: int):
        self.up, self.down = powers(base, CHUNK + LONG_WORD), powers(pow(base, -1, 1 << 64), CHUNK + LONG_WORD)

    def sums(self, values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=total[1:])
        return total

    def windows(self, values: np.ndarray, size: int) -> np.ndarray:
        """The hash of every window of ``size`` values."""
        out = []
        for at in range(0, len(values) - size + 1, CHUNK):
            total = self.sums(values[at : at + CHUNK + size - 1])
            n = len(total) - size
            out.append(mixed((total[size:] - total[:n]) * self.down[:n]))
        return np.concatenate(out) if out else np.empty(0, np.uint64)


BYTES = Roll(0xD6E8FEB86659FD93)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text."""
    import xxhash

    data = np.frombuffer(text, np.uint8)
    edge = np.diff(np.concatenate(([True], SPACE[data], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        to = int(np.searchsorted(ends, base + CHUNK, "right"))
        if to > at:
            total = BYTES.sums(data[base : ends[to - 1]].astype(np.uint64) + np.uint64(1))
            s, e = starts[at:to] - base, ends[at:to] - base
            out[at:to] = (total[e] - total[s]) * BYTES.down[s]
        at = max(to, at + 1)
    lengths = ends - starts
    out = mixed(out ^ (lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    for i in np.flatnonzero(lengths > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(text[starts[i] : ends[i]])
    return out
