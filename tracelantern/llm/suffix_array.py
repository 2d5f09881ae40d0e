"""Suffix sorting by grouping."""

from __future__ import annotations

import numpy as np


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in order; the last symbol must be smaller than all others."""
    return suffix_order(np.asarray(text)).tolist()


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` in order; the last symbol must be smaller than all others.

    Suffixes are grouped by a growing prefix, first by as many symbols as a number holds.
    Each group is named by its first place in the order.  The name of a suffix and that of
    the suffix behind its prefix stand for a prefix twice as long, so a round splits every
    group by the groups of what follows.  A group of one has its place and is left alone.
    """
    symbols = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    width = min(63 // bits, n)
    key = np.zeros(n, np.int64)
    for k in range(width):
        # the last symbol is no other's, so it does not matter what stands behind it
        key[:n - k] |= symbols[k:] << bits * (width - 1 - k)
    order = np.argsort(key)
    group = np.empty(n, np.int64)
    places = np.arange(n)
    key = key[order]
    while True:
        new = np.append(True, key[1:] != key[:-1])
        first = places[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        members = order[places]
        group[members] = first
        # suffixes that share their group
        shared = ~(new & np.append(new[1:], True))
        places, members, first = places[shared], members[shared], first[shared]
        if not len(places):
            return order
        # two suffixes of a group agree in all of the prefix, so neither ends within it
        key = first * n + group[members + width]
        by = np.argsort(key)
        order[places], key = members[by], key[by]
        width *= 2
