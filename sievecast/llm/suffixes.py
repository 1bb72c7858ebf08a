"""Suffix sorting of numbered words by prefix doubling, in numpy, for one task's share of the texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Words that the first sort compares.
FIRST = 4


class Numbered(dict):
    """Words numbered from 1 in the order they come; 0 stands for the end of a text."""

    def codes(self, words: list[bytes]) -> np.ndarray:
        try:
            found = list(map(self.__getitem__, words))
        except KeyError:
            self.update((w, k) for k, w in enumerate([w for w in set(words) if w not in self], len(self) + 1))
            found = list(map(self.__getitem__, words))
        return np.array(found, np.int32)


def _groups(keys: np.ndarray) -> np.ndarray:
    """Of each of some sorted keys, where the first equal one stands."""
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


def sorted_levels(codes: np.ndarray, depth: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``length, suffixes, ranks`` for lengths 4, 8, 16 ...: the places in the order of that many words, and of each place the first with equal words in that order.

    Ends when all places differ (but for zeros at the end of all) or, if given, ``depth`` words are in order. Both arrays are worked on in place
    between the steps; a later order only moves places within equal ones of an earlier. Each step sorts
    only what isn't settled.
    """
    n = len(codes)
    bits = max(1, int(codes.max(initial=0)).bit_length())
    width = FIRST if FIRST * bits <= 63 else 2 if 2 * bits <= 63 else 1
    keys = codes.astype(np.int64)
    for k in range(1, width):
        keys <<= bits
        keys[: max(n - k, 0)] |= codes[k:]
    order = np.argsort(keys)
    suffixes, ranks = order.astype(np.int32), np.empty(n, np.int32)
    ranks[suffixes] = _groups(keys[order])
    del keys, order
    while True:
        if width >= FIRST:
            yield width, suffixes, ranks
        first = ranks[suffixes]
        equal = np.zeros(n, bool)
        np.equal(first[1:], first[:-1], out=equal[1:])
        equal[:-1] |= equal[1:]
        open_ = np.flatnonzero(equal)
        if width >= FIRST and (not len(open_) or width >= (n if depth is None else depth)):
            return
        at = suffixes[open_]
        following = at.astype(np.int64) + width
        keys = ranks[at].astype(np.int64) * (n + 1) + np.where(following < n, ranks[np.minimum(following, n - 1)] + 1, 0)
        order = np.argsort(keys)
        at = at[order]
        suffixes[open_] = at
        ranks[at] = open_[_groups(keys[order])]
        width *= 2


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """The places of ``codes`` in the order of at least ``depth`` words."""
    suffixes = np.zeros(0, np.int32)
    for _, suffixes, _ in sorted_levels(codes, depth):
        pass
    return suffixes


def joined(parts: Iterable[np.ndarray]) -> np.ndarray:
    parts = list(parts)
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)
