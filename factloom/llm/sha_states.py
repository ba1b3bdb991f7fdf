"""SHA-256 of many messages at once, with states that can be kept and resumed.

A message here is a run of digests, each as its 64 lowercase hexadecimal characters.
That is exactly one block of the hash function, so the state before any digest of the
run is eight 32-bit words and the number of digests before it, and nothing else.
States are arrays of shape (8, n), digests of shape (n, 32).
"""

from __future__ import annotations

from math import isqrt

import numpy as np

_WORD = 0xFFFFFFFF


def _primes(count: int) -> list[int]:
    found: list[int] = []
    n = 2
    while len(found) < count:
        if all(n % p for p in found):
            found.append(n)
        n += 1
    return found


def _cube_root(n: int) -> int:
    low, high = 0, 1 << (n.bit_length() // 3 + 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**3 <= n else (low, middle - 1)
    return low


# The function's constants: fractions of the square and cube roots of the first primes.
START = np.array([isqrt(p << 64) & _WORD for p in _primes(8)], dtype=np.uint32)
ROUNDS = np.array([_cube_root(p << 96) & _WORD for p in _primes(64)], dtype=np.uint32)
HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def start(n: int) -> np.ndarray:
    """The states of ``n`` empty messages."""
    return np.repeat(START[:, None], n, axis=1)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def _advance(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states after one block each; ``block`` has shape (16, n)."""
    w = list(block)
    for t in range(16, 64):
        low, high = w[t - 15], w[t - 2]
        s0 = _turn(low, 7) ^ _turn(low, 18) ^ (low >> np.uint32(3))
        s1 = _turn(high, 17) ^ _turn(high, 19) ^ (high >> np.uint32(10))
        w.append(w[t - 16] + s0 + w[t - 7] + s1)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        mixed = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + ROUNDS[t] + w[t]
        moved = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = mixed + moved, a, b, c, d + mixed, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def absorb(state: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """The states after one more digest each."""
    text = np.empty((len(digests), 64), dtype=np.uint8)
    text[:, 0::2], text[:, 1::2] = HEX[digests >> 4], HEX[digests & 15]
    return _advance(state, np.ascontiguousarray(text.view(">u4").astype(np.uint32).T))


def finish(state: np.ndarray, absorbed: np.ndarray) -> np.ndarray:
    """The digests of the messages, given how many digests each has absorbed."""
    last = np.zeros((16, state.shape[1]), dtype=np.uint32)
    last[0] = 0x80000000
    bits = absorbed.astype(np.uint64) * np.uint64(512)
    last[14], last[15] = bits >> np.uint64(32), bits & np.uint64(_WORD)
    return to_bytes(_advance(state, last))


def to_bytes(state: np.ndarray) -> np.ndarray:
    """States as rows of 32 bytes."""
    return np.ascontiguousarray(state.T).astype(">u4").view(np.uint8).reshape(-1, 32)


def from_bytes(rows: np.ndarray) -> np.ndarray:
    """Rows of 32 bytes as states."""
    return np.ascontiguousarray(np.ascontiguousarray(rows).view(">u4").astype(np.uint32).T)
