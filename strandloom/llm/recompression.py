"""Recompression of word sequences: rounds that name runs and pairs alike everywhere.

Every word starts as a 64-bit symbol. A run round replaces maximal runs of one symbol, a pair round
replaces neighbours (a, b) with a on the left and b on the right side of that round. A symbol's name
and side are functions of its content alone, so equal substrings get equal symbols in their interior
wherever they stand, without any exchange between tasks. Symbols of at least ``window`` words stop
merging with each other.

Core of a window: the symbols that its words alone determine. At a pair round the first symbol leaves
the core if it is a right one, the last if it is a left one (either may merge with a neighbour outside);
at a run round the first and the last run leave. Equal windows have equal cores in every round. The
core of the last round but one that has any, named by its first and last symbols, is the ``anchor`` that
all copies of a window share; it is long enough to be rare. (A window whose core ends within a round
or two of the first look is named by its own ends.)
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import mixed

RUN_ROUNDS = frozenset(range(0, 64, 6))
ROUNDS = 30
FIRST_LOOK = 4
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Parse:
    """Results over the concatenated words of some documents."""

    at: np.ndarray  # start of each window
    anchor: np.ndarray  # its anchor
    fresh: np.ndarray  # is it the first window of that anchor's occurrence?
    node_start: np.ndarray  # symbols of at least `window` words
    node_end: np.ndarray


def _side(names: np.ndarray, level: int) -> np.ndarray:
    """True for left symbols of this round."""
    return (((names + np.uint64(level)) * _ODD) ^ (names >> np.uint64(level + 3))) >> np.uint64(63) == 0


def window_starts(sizes: np.ndarray, window: int) -> np.ndarray:
    """Start of every window that lies in one document."""
    counts = np.maximum(sizes - window + 1, 0)
    first = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts)
    return first + np.arange(len(first))


def parse(names: np.ndarray, sizes: np.ndarray, window: int, at: np.ndarray | None = None, nodes: bool = True) -> Parse:
    """``names``: word hashes of all documents one after the other, ``sizes``: words of each; ``at``:
    starts of the windows that need an anchor."""
    n = len(names)
    ends = np.cumsum(sizes)
    last = np.zeros(n, np.bool_)
    last[ends[sizes > 0] - 1] = True
    start = np.arange(n + 1, dtype=np.int64)
    at = np.zeros(0, np.int64) if at is None else at
    live = np.arange(len(at))
    li, ri = at.copy(), at + window

    # Name and stretch of each window's core in the current and in the previous round. Cores last for
    # more than FIRST_LOOK rounds, but for windows of long runs, which are named by their ends.
    name = mixed(names[at] * _ODD + names[at + window - 1] * _PAIR) if len(at) else np.zeros(0, np.uint64)
    begin, end = at.copy(), at + window
    last_name, last_begin, last_end = name, begin, end

    def look(level: int) -> None:
        nonlocal last_name, last_begin, last_end
        if level == FIRST_LOOK:
            last_name, last_begin, last_end = name.copy(), begin.copy(), end.copy()
        else:
            last_name[live], last_begin[live], last_end[live] = name[live], begin[live], end[live]
        name[live] = mixed(names[li] * _PAIR + names[ri - 1] * _ODD + np.uint64(level))
        begin[live], end[live] = start[li], start[ri]

    for level in range(ROUNDS):
        if not len(live) and not nodes:
            break
        if len(live) and level >= FIRST_LOOK:
            look(level)
        if level in RUN_ROUNDS:
            begins = np.ones(len(names), np.bool_)
            begins[1:] = (names[1:] != names[:-1]) | last[:-1]
            run = np.cumsum(begins) - 1
            if len(live):
                new_l, new_r = run[li] + 1, run[ri - 1]
                left = new_l < new_r
                live, li, ri = live[left], new_l[left], new_r[left]
            head = np.flatnonzero(begins)
            length = np.diff(np.append(head, len(names)))
            tail = head + length - 1
            repeated = length > 1
            out = names[head]
            out[repeated] = mixed(out[repeated] ^ (length[repeated].astype(np.uint64) * _ODD))
            names, last, start = out, last[tail], np.append(start[head], start[-1])
        if not len(names):
            break
        left_side = _side(names, level)
        span = np.diff(start)
        merge = np.zeros(len(names), np.bool_)
        merge[:-1] = left_side[:-1] & ~left_side[1:] & ~last[:-1]
        if level > 5:
            merge[:-1] &= (np.minimum(span[:-1], span[1:]) < window) & (span[:-1] + span[1:] <= 8 * window)
        keep = np.ones(len(names), np.bool_)
        keep[1:] = ~merge[:-1]
        index = np.cumsum(keep) - 1
        if len(live):
            new_l, new_r = li + ~left_side[li], ri - left_side[ri - 1]
            left = new_l < new_r
            live, li, ri = live[left], index[new_l[left]], index[new_r[left] - 1] + 1
        at_pair = np.flatnonzero(merge)
        out = names.copy()
        out[at_pair] = mixed(names[at_pair] * _PAIR + (names[at_pair + 1] ^ (names[at_pair + 1] >> np.uint64(29))) * _ODD)
        last = last.copy()
        last[at_pair] = last[at_pair + 1]
        names, last, start = out[keep], last[keep], np.append(start[:-1][keep], start[-1])
    anchor, begin, end = last_name, last_begin, last_end
    fresh = np.ones(len(at), np.bool_)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    span = np.diff(start)
    big = np.flatnonzero(span >= window)
    return Parse(at, anchor, fresh, start[big], start[big] + span[big])
