"""Burrows-Wheeler transforms of shards of strings, merged by refining their interleave.

A shard is the concatenation of its strings, taken as a circle, with its rotations sorted by their first DEPTH bytes.
Of the merge only the interleave is kept, the shard of each merged row. It starts as all rows of the first shard, then
all of the second, and so on: rows sorted by no bytes. One round reads the two bytes before each row from the shards'
transforms in the order of the interleave and moves rows stably to these bytes' place: then rows are sorted by two bytes
more. Blocks of rows that agree so far are refined in the same round, which is where common prefixes are seen to end.
When rows are sorted by DEPTH bytes, the blocks are the repeated intervals of that depth. No suffix is compared or
sorted again. An odd depth starts with a round of one byte.
"""

from __future__ import annotations

import numpy as np


def rotations(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the rotations of text in the order of their first `depth` bytes, by prefix doubling."""
    n = len(text)
    at = np.arange(n)
    rank = np.zeros(n, np.uint64)
    for k in range(min(7, depth)):
        rank = (rank << np.uint64(8)) | text[(at + k) % n].astype(np.uint64)
    known = min(7, depth)
    order = np.argsort(rank)
    while True:
        line = rank[order]
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(np.r_[0, line[1:] != line[:-1]])
        if known >= depth or dense[order[-1]] == n - 1:
            return order
        step = min(known, depth - known)
        rank = dense * n + np.roll(dense, -(step % n)) if step < n else dense
        order = np.argsort(rank)
        known += step


def merged_blocks(shards: list[np.ndarray], depth: int) -> list[np.ndarray]:
    """Per shard and byte a number that two bytes share just if the `depth` bytes from there on are equal."""
    order = [rotations(x, depth) for x in shards]
    one = np.concatenate([x[o - 1] for x, o in zip(shards, order, strict=True)])
    two = np.concatenate([x[(o - 2) % len(x)] for x, o in zip(shards, order, strict=True)]).astype(np.uint16) << 8 | one
    shard = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.uint16), [len(x) for x in shards])
    n = len(shard)
    block, blocks = np.zeros(n, np.int32), 1
    split = np.empty(n, bool)
    for before in [one] * (depth % 2) + [two] * (depth // 2):
        symbol = np.empty(n, before.dtype)
        symbol[np.argsort(shard, kind="stable")] = before
        to = np.argsort(symbol, kind="stable")
        shard, symbol, block = shard[to], symbol[to], block[to]
        split[0] = False
        np.not_equal(symbol[1:], symbol[:-1], out=split[1:])
        split[1:] |= block[1:] != block[:-1]
        block = np.cumsum(split, dtype=np.int32)
        if (count := int(block[-1]) + 1) == blocks:  # a round that splits no block is followed by such rounds only
            break
        blocks = count
    place = np.argsort(shard, kind="stable")
    out, start = [], 0
    for x, o in zip(shards, order, strict=True):
        own = np.empty(len(x), np.int64)
        own[o] = block[place[start : start + len(x)]]
        out.append(own)
        start += len(x)
    return out
