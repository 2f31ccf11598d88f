"""Burrows-Wheeler transforms of small sets of byte strings, and their merge by interleave refinement.

Every string of a shard ends in a terminator of its own, smaller than all bytes and ordered by the
string's place. A shard is sorted once; merging never sorts suffixes again: a round moves every row one
byte to the left through its transform and deals the rows stably by that byte. After round k rows are
in the order of their first k bytes, and the rows of one shard are in the shard's own order, so the
shards of the rows are the interleaving of that round. A boundary between neighbours that comes up in
round k marks a common prefix of k - 1 bytes; rows still without a boundary after ``length`` rounds
form the repeated intervals of that length. A row alone in its block stays alone when it is extended,
so it leaves the rounds.
"""

from __future__ import annotations

import numpy as np

FIRST = 7  # bytes of the first sort, nine bits each


class Shard:
    """The sorted suffixes of ``strings`` (UTF-8, so no byte 255): owner and offset, byte before, row of the suffix before."""

    def __init__(self, strings: list[bytes]):
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        ends = np.cumsum(lengths + 1) - 1  # the terminators
        symbols = np.zeros(int(ends[-1]) + 1, np.uint8)
        whole = np.ones(len(symbols), bool)
        whole[ends] = False
        symbols[whole] = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1)
        owner = np.repeat(np.arange(len(strings), dtype=np.int32), lengths + 1)
        order = sort_suffixes(symbols, ends[owner] - np.arange(len(symbols)))
        row_of = np.empty(len(order), np.int32)
        row_of[order] = np.arange(len(order), dtype=np.int32)
        before = order - 1
        starts = ends - lengths
        first = np.isin(order, starts, assume_unique=True)
        before[first] = order[first]
        self.before = symbols[before]
        self.before[first] = 0
        self.back = row_of[before]
        self.owner = owner[order]
        self.offset = (order - starts[self.owner]).astype(np.int32)


def sort_suffixes(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes; ``left`` are the symbols before the terminator. Prefix doubling."""
    n = len(symbols)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([symbols, np.zeros(FIRST, np.uint8)]).astype(np.int64)
    for j in range(FIRST):
        key = (key << 9) | np.where(left >= j, padded[j : n + j], 0)
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | (left[order[1:]] < FIRST)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    depth = FIRST
    while len(slots):
        held = order[slots]
        pair = rank[held] * n + rank[held + depth]
        turn = np.argsort(pair, kind="stable")
        held, pair = held[turn], pair[turn]
        order[slots] = held
        new = np.append(True, pair[1:] != pair[:-1])
        rank[held] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        slots = slots[~(new & np.append(new[1:], True))]
        depth *= 2
    return order


def repeated_intervals(shards: list[Shard], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, interval) of every ``length``-byte string that stands at two places or more.

    Strings are numbered through the shards; equal interval numbers mean equal bytes.
    """
    sizes = [len(s.before) for s in shards]
    base = np.cumsum([0, *sizes])
    before = np.concatenate([s.before for s in shards])
    back = np.concatenate([s.back + np.int32(b) for s, b in zip(shards, base)])
    offset = np.concatenate([s.offset for s in shards])
    rows = np.flatnonzero(offset >= length).astype(np.int32)  # after all rounds these stand at the strings' starts, others before them
    block = np.zeros(len(rows), np.int32)
    for _ in range(length):
        symbol = before[rows]
        turn = np.argsort(symbol, kind="stable")
        symbol, held = symbol[turn], block[turn]
        rows = back[rows[turn]]
        new = np.ones(len(rows), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (held[1:] != held[:-1])
        more = ~(new & np.append(new[1:], True)) if len(new) else new
        rows = rows[more]
        block = np.cumsum(new[more], dtype=np.int32)
        if not len(rows):
            break
    strings = np.cumsum([0, *(int(s.owner.max()) + 1 for s in shards)])
    owner = np.concatenate([s.owner + np.int32(b) for s, b in zip(shards, strings)])
    return owner[rows], offset[rows], block
