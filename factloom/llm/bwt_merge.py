"""Repeated strings of many short texts, found by merging Burrows-Wheeler transforms.

The texts are dealt to shards; each shard sorts its own suffixes and keeps its
transform. The shards are merged without sorting suffixes again: starting from one
shard after the other, the interleave of the shards is refined round by round. In a
round every row moves, by its shard's transform, to the row of the suffix that is one
symbol longer; rows with equal symbols keep their order. After ``h`` rounds the rows are
in the order of the first ``h`` symbols of their suffixes, and a row begins a new
interval exactly if these differ from those of the row before. After ``width`` rounds the
intervals are the suffixes whose common prefix has ``width`` symbols.

Only suffixes with ``width`` bytes are asked for. In round ``h`` these come from the
suffixes ``width - h`` symbols on, and no others, so all other rows are left out.
"""

from __future__ import annotations

import numpy as np

SHARD_BYTES = 1 << 18


class Shard:
    """Texts with their suffix order and transform. Every text ends with a mark of its
    own, smaller than any byte; marks are in the order of the texts."""

    def __init__(self, texts: list[bytes], width: int) -> None:
        lengths = np.array([len(t) + 1 for t in texts])
        self.begins = np.cumsum(lengths) - lengths
        self.ends = self.begins + lengths - 1
        symbol = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8).astype(np.int64)
        symbol += len(texts)
        symbol[self.ends] = np.arange(len(texts))
        rank, step = symbol, 1
        while True:
            # The mark ends a suffix, so what follows it never decides.
            follows = np.zeros(len(rank), dtype=np.int64)
            follows[:-step] = rank[step:] + 1 if step < len(rank) else 0
            key = rank * (int(rank.max()) + 2) + follows
            order = np.argsort(key, kind="stable")
            if step >= width:
                break
            changed = np.r_[False, key[order][1:] != key[order][:-1]]
            rank = np.empty(len(key), dtype=np.int64)
            rank[order] = np.cumsum(changed)
            step *= 2
        self.order = order
        at = np.empty(len(order), dtype=np.int32)
        at[order] = np.arange(len(order), dtype=np.int32)
        # Of each row the symbol before its suffix, and the row of the longer suffix.
        self.transform = (symbol[order - 1] - len(texts)).astype(np.uint8)
        self.longer = at[order - 1]
        # Where the suffixes begin that lie ``width`` behind a string of that width.
        counts = np.maximum(lengths - width, 0)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.rows = at[np.repeat(self.begins, counts) + width + inside]


def merged(shards: list[Shard], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows in the order of their first ``width`` symbols, and where intervals begin.

    Rows count through the shards, one behind the other.
    """
    bases = sizes_before(shards)
    transform = np.concatenate([s.transform for s in shards])
    longer = np.concatenate([s.longer + np.int32(b) for s, b in zip(shards, bases, strict=True)])
    rows = np.concatenate([s.rows + np.int32(b) for s, b in zip(shards, bases, strict=True)])
    interval = np.zeros(len(rows), dtype=np.int32)
    begins = np.zeros(len(rows), dtype=bool)
    for _ in range(width):
        symbol = transform[rows]
        order = np.argsort(symbol, kind="stable")
        rows, symbol, interval = longer[rows[order]], symbol[order], interval[order]
        begins = np.r_[True, (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])]
        interval = np.cumsum(begins, dtype=np.int32)
    return rows, begins


def sizes_before(shards: list[Shard]) -> np.ndarray:
    sizes = np.array([len(s.order) for s in shards])
    return np.cumsum(sizes) - sizes


def repeats(texts: list[bytes], width: int, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each text, for each place where ``width`` bytes begin, whether the same bytes
    begin in an earlier text, or earlier in this one."""
    shards: list[Shard] = []
    held: list[bytes] = []
    size = 0
    for text in [*texts, None]:
        if held and (text is None or size + len(text) > shard_bytes):
            shards.append(Shard(held, width))
            held, size = [], 0
        if text is not None:
            held.append(text)
            size += len(text) + 1
    found = [np.zeros(max(len(t) - width + 1, 0), dtype=bool) for t in texts]
    if not any(len(f) for f in found):
        return found
    rows, begins = merged(shards, width)
    begin = np.concatenate([s.begins + b for s, b in zip(shards, sizes_before(shards), strict=True)])
    suffix = np.concatenate([s.order + b for s, b in zip(shards, sizes_before(shards), strict=True)])[rows]
    text_of = np.searchsorted(begin, suffix, side="right") - 1
    offset = suffix - begin[text_of]
    place = text_of << 32 | offset
    starts = np.flatnonzero(begins)
    earliest = np.minimum.reduceat(place, starts)
    later = place > np.repeat(earliest, np.diff(np.r_[starts, len(place)]))
    order = np.flatnonzero(later)
    order = order[np.argsort(text_of[order], kind="stable")]
    cuts = np.flatnonzero(np.r_[True, np.diff(text_of[order]) != 0])
    for a, b in zip(cuts, np.r_[cuts[1:], len(order)], strict=True):
        if a < b:
            found[text_of[order[a]]][offset[order[a:b]]] = True
    return found
