"""PartEnum signatures for exact Jaccard thresholds (Arasu, Ganti, Kaushik, VLDB 2006).

Sizes fall into bands [low, high] with high = low / threshold, so two sets whose Jaccard similarity
reaches the threshold lie in one band or in neighbouring ones.  A set signs its own band and the next.
In a band two such sets differ in at most k features.  The feature domain is cut into parts, more than
k / (borne + 1) of them, so that one has at most borne differences; a part into cells, of which these differences
spoil as many; the others agree, so each subset of that many cells is a signature and a similar pair
shares one with certainty.

Empty subsets would be one signature for all sets of a band.  So a band may have spare parts: with spare parts beyond
those needed, spare + 1 have at most borne differences.  A set with empty subsets in at most spare parts leaves
these subsets out; one of the spare + 1 parts has none, and what the pair shares there both have signed.  Only a
set with more of them signs all its subsets.  Of all ways to cut a band the one is taken whose number of signatures,
times 1 and what part of the band's sets has a given empty subset in units of SHARED_EMPTY, is least.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np

from .words import Words, mix, rolling, sequences, within

SHARED_EMPTY = 2e-3


@dataclass(frozen=True)
class Shape:
    """How a band cuts the feature domain: parts of cells, subsets of so many cells, and parts that may be left out."""

    parts: int
    cells: int
    chosen: int
    spare: int


@dataclass(frozen=True)
class Threshold:
    """Similarity of num / den or more, kept as whole numbers so that ties are exact."""

    num: int
    den: int

    @lru_cache(maxsize=None)
    def bands(self, upto: int) -> np.ndarray:
        """Upper ends of the bands up to a size."""
        ends = [1]
        while ends[-1] < upto:
            ends.append(max(ends[-1] + 1, (ends[-1] + 1) * self.den // self.num))
        return np.array(ends)

    @lru_cache(maxsize=None)
    def shape(self, high: int) -> Shape:
        """Cut of the band whose larger end is high."""
        k, size = 2 * high * (self.den - self.num) // (self.den + self.num), high * self.num / self.den
        ways = []
        for borne in range(min(k, 1), 5):
            need = k // (borne + 1) + 1
            for chosen in (1, 2, 3, 4):
                cells = borne + chosen
                subsets = math.comb(cells, chosen)
                for spare in (x for x in _SPARES if x <= need // 2):
                    parts = need + spare
                    empty = (1 - chosen / (cells * parts)) ** size
                    share = empty * _at_least(spare, parts * subsets * empty)
                    ways.append((parts * subsets * (1 + share / SHARED_EMPTY), Shape(parts, cells, chosen, spare)))
        return min(ways, key=lambda x: x[0])[1]


_SPARES = [0, 1, 2, 3, 4, *(int(4 * 1.3**i) for i in range(1, 28))]


def _at_least(n: int, mean: float) -> float:
    """Chance that a Poisson number is n or more."""
    if mean > 50:
        return 0.5 * math.erfc((n - 0.5 - mean) / math.sqrt(2 * mean))
    term, below = math.exp(-mean), 0.0
    for i in range(n):
        below += term
        term *= mean / (i + 1)
    return max(0.0, 1.0 - below)


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text, sorted, in one array; first index of each text's; 64-bit hash of each text's word sequence.

    A text of fewer than n words, but not none, has its whole sequence as its only shingle.
    """
    hashes, whole = rolling(words.hash, n), sequences(words.hash, words.first)
    counts = np.diff(words.first)
    out, first = [], np.zeros(len(counts) + 1, np.int64)
    for i, c in enumerate(counts.tolist()):
        a = words.first[i]
        if c >= n:
            part = np.sort(hashes[a : a + c - n + 1])
            if len(part) > 1:
                part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        else:
            part = mix(whole[i : i + 1] + np.uint64(c))[: min(c, 1)]
        out.append(part)
        first[i + 1] = first[i] + len(part)
    return (np.concatenate(out) if out else hashes[:0]), first, whole


def signatures(sets: np.ndarray, first: np.ndarray, at: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of all sets in one array, and the first index of each set's."""
    size = np.diff(first)
    ends = at.bands(int(size.max(initial=1)) * 2 + 2)
    own = np.searchsorted(ends, size)
    salt = mix(sets ^ np.uint64(0x5851F42D4C957F2D))
    owners, sigs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for band in np.unique(np.concatenate([own[size > 0], own[size > 0] + 1])).tolist():
        which = np.flatnonzero(((own == band) | (own + 1 == band)) & (size > 0))
        shape, count = at.shape(int(ends[band])), size[which]
        step = np.cumsum(count)
        at_set = np.arange(step[-1]) + np.repeat(first[which] - (step - count), count)
        value, mixed = sets[at_set], salt[at_set]
        part = (mixed % np.uint64(shape.parts)).astype(np.int64)
        cell = ((mixed >> np.uint64(40)) % np.uint64(shape.cells)).astype(np.int64)
        place = (np.repeat(np.arange(len(which)), count) * shape.parts + part) * shape.cells + cell
        sums = np.zeros(len(which) * shape.parts * shape.cells, np.uint64)
        np.add.at(sums, place, value)
        sums = sums.reshape(-1, shape.cells)
        held = np.bincount(place, minlength=sums.size).reshape(-1, shape.cells)
        number = np.tile(np.arange(shape.parts, dtype=np.uint64), len(which))
        subsets = list(combinations(range(shape.cells), shape.chosen))
        filled = np.stack([held[:, list(x)].any(axis=1) for x in subsets])
        bare = (~filled.all(axis=0)).reshape(len(which), shape.parts).sum(axis=1)
        sent = filled | np.repeat(bare > shape.spare, shape.parts)
        for p, cells in enumerate(subsets):
            live = np.flatnonzero(sent[p])
            sig = mix(number[live] * np.uint64(64) + np.uint64((band << 40) + p))
            for c in cells:
                sig = mix(sig + sums[live, c])
            owners.append(which[live // shape.parts])
            sigs.append(sig)
    owner, sig = np.concatenate(owners), np.concatenate(sigs)
    order = np.argsort(owner, kind="stable")
    return sig[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(size)))))
