"""Words of many texts at once: their places in the joined bytes, 64-bit hashes by running sums, and places of 64-bit keys."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PRIME = np.uint64((1 << 31) - 1)
_SECOND = 1_234_567_891
_POWERS: dict[str, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """Powers modulo the prime, by doubling."""
    out = np.ones(n, np.uint64)
    known = 1
    while known < n:
        more = min(known, n - known)
        out[known : known + more] = out[:more] * np.uint64(pow(base, known, int(_PRIME))) % _PRIME
        known += more
    return out


def _powers(n: int) -> tuple[np.ndarray, ...]:
    """Powers of both bases and of their inverses, modulo 2**64 and modulo the prime."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
        _POWERS["up2"], _POWERS["down2"] = _powers_of(_SECOND, n), _powers_of(pow(_SECOND, -1, int(_PRIME)), n)
    return _POWERS["up"], _POWERS["down"], _POWERS["up2"], _POWERS["down2"]


def places(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of all words in order.

    symbols: of all texts, zero between words; offsets: where each text begins, and the end, counted from the start.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = symbols != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    starts[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hashed(symbols: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """64 bits of each word: a polynomial modulo 2**64, and one modulo a prime over it.

    The first alone gives some regular words the same value (a Thue-Morse word and its complement); the second tells those apart.
    """
    n = len(symbols)
    up, down, up2, down2 = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * up[:n], out=sums[1:])
    first = (sums[to] - sums[at]) * down[at]
    np.cumsum(symbols * up2[:n] % _PRIME, out=sums[1:])
    second = (sums[to] - sums[at]) % _PRIME * down2[at] % _PRIME
    return first ^ second * _BASE


class Finder:
    """Places of 64-bit keys among distinct ones, by tables of hashes: a key that another one keeps out of a table is in a later one."""

    def __init__(self, keys: np.ndarray):
        self.keys, left = keys, np.arange(len(keys), dtype=np.int32)
        self.tables: list[tuple[np.uint64, np.uint64, np.ndarray]] = []
        rng = np.random.default_rng(1)
        while len(left):
            bits = (2 * len(left)).bit_length() + 1
            times, shift = rng.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1), np.uint64(64 - bits)
            table = np.zeros(1 << bits, np.int32)
            slot = keys[left] * times >> shift
            table[slot] = left
            self.tables.append((times, shift, table))
            left = left[table[slot] != left]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; all must be there."""
        out, rest = np.zeros(len(keys), np.int32), None
        for times, shift, table in self.tables:
            wanted = keys if rest is None else keys[rest]
            at = table[wanted * times >> shift]
            hit = self.keys[at] == wanted
            if rest is None:
                out, rest = at, np.flatnonzero(~hit)
            else:
                out[rest[hit]] = at[hit]
                rest = rest[~hit]
            if not len(rest):
                break
        if rest is not None and len(rest):
            raise KeyError("a key that is not there")
        return out
