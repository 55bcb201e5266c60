"""Hashes of texts in NumPy, the same in every process."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Words of a code text: runs of ASCII letters, digits and underscores, and every other non-blank character alone.
CODE_TOKEN = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")
#: Words of a prose text, after lower-casing.
WORD = re.compile(r"[a-z0-9]+")

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31, _S11 = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(11)


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def stream(x: np.ndarray, n: int) -> np.ndarray:
    """The n-th number of a pseudorandom stream of each seed."""
    with np.errstate(over="ignore"):
        return mix(x + np.uint64(n + 1) * _STEP)


def unit(x: np.ndarray) -> np.ndarray:
    """To (0, 1]."""
    return ((x >> _S11).astype(np.float64) + 1.0) * 2.0**-53


class TokenHash(dict):
    """xxh64 of a string, remembered for up to ``most`` strings of up to 64 characters."""

    def __init__(self, most: int = 500_000):
        self.most = most

    def __missing__(self, key: str) -> int:
        h = xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"))
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = h
        return h


def hashed(tokens: list[str], memory: TokenHash) -> np.ndarray:
    return np.fromiter(map(memory.__getitem__, tokens), np.uint64, len(tokens))


def ordered(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive hashes, that minds their order; empty if there are fewer."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(out)]
        return mix(out + np.uint64(n))


def sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive numbers."""
    out, have = h, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
