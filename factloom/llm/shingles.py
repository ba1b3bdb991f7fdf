"""Hashes of words and of occurrence-labelled word k-mers, for many texts at once."""

from __future__ import annotations

import numpy as np

K = 5

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def spread(value: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit number of each number, one to one."""
    value = value ^ (value >> np.uint64(32))
    value = value * np.uint64(0xD6E8FEB86659FD93)
    value = value ^ (value >> np.uint64(32))
    value = value * np.uint64(0xD6E8FEB86659FD93)
    return value ^ (value >> np.uint64(32))


def _byte_numbers() -> np.ndarray:
    """A number for each byte of a word, equal for both cases of a letter; 0 between words."""
    of = np.zeros(256, dtype=np.uint64)
    word = [b for b in range(256) if b >= 128 or chr(b).isalnum()]
    folded = [b + 32 if 65 <= b <= 90 else b for b in word]
    of[word] = spread(np.array(folded, dtype=np.uint64) + np.uint64(1)) | np.uint64(1)
    return of


BYTE_NUMBERS = _byte_numbers()


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and how many words each text has.

    Words are runs of letters and digits of ASCII, in any case, and of all other
    characters beyond ASCII.
    """
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(encoded) + b" ", dtype=np.uint8)
    number = BYTE_NUMBERS[data]
    inside = number != 0
    edge = np.flatnonzero(np.diff(np.r_[False, inside].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    lengths = ends - starts
    number = number[inside]
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.cumsum(lengths) - lengths
    offset = np.arange(len(number)) - np.repeat(first, lengths)
    power = np.cumprod(np.full(int(lengths.max()), _ODD[0]))
    hashes = spread(np.add.reduceat(number * power[offset], first))
    upto = np.cumsum([len(e) + 1 for e in encoded])
    return hashes, np.diff(np.r_[0, np.searchsorted(starts, upto)])


def labelled(texts: list[str], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (word k-mer, how often it came before in its text), in text order, and
    how many each text has. A text of fewer than ``k`` words is one k-mer."""
    word, count = word_hashes(texts)
    if not len(word):
        return word, count
    text = np.repeat(np.arange(len(texts)), count)
    grams = np.where(count > 0, np.maximum(count - k + 1, 1), 0)
    rank = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.flatnonzero(rank < np.repeat(grams, count))
    total = np.zeros(len(begin), dtype=np.uint64)
    for j in range(k):
        at = np.minimum(begin + j, len(word) - 1)
        there = (begin + j < len(word)) & (text[at] == text[begin])
        total = total * _ODD[1] + np.where(there, word[at], np.uint64(j))
    total = spread(total)
    own = spread(total + text[begin].astype(np.uint64) * _ODD[0])
    order = np.argsort(own, kind="stable")
    fresh = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]])
    before = np.empty(len(order), dtype=np.uint64)
    before[order] = np.arange(len(order)) - np.repeat(fresh, np.diff(np.r_[fresh, len(order)]))
    return spread(total + before * _ODD[1]), grams
