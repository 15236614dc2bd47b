"""Order of suffixes with their common prefixes, by external induced sorting.

Suffixes are S or L as they are less or greater than the next one.  The leftmost S suffixes of each ascent are
sorted by merging on 8 bytes at a time down to the depth that matters; all others are induced: read in
order, each suffix places the one before it in the queue of its first byte, L ones upwards and S ones downwards.
Since suffixes arrive in order, a queue per byte that keeps the order of arrival is a priority queue.  It carries
pairs of a suffix and its common prefix with the one before it in the queue: one more than the least common prefix
that was read since that one's place was taken, as the least over a range of neighbours is that of its ends.

Queues, sorted runs and results share the memory; what goes beyond waits in temporary files of the task
that sorts, and is read again as runs of bounded size.  Text and types lie in such files too if they are large.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np


class Pairs:
    """Runs of (suffix, common prefix) in order of arrival; what goes beyond the shared memory waits in a file."""

    def __init__(self, held: list[int], memory: int, index: type):
        self.held, self.memory, self.runs, self.file, self.end = held, memory, [], None, 0
        self.kind = np.dtype([("at", index), ("lcp", np.uint8)])

    def push(self, at: np.ndarray, lcp: np.ndarray) -> None:
        if not len(at):
            return
        size = at.nbytes + lcp.nbytes
        if self.held[0] + size <= self.memory:
            self.held[0] += size
            self.runs.append((at, lcp, size))
            return
        rows = np.empty(len(at), self.kind)
        rows["at"], rows["lcp"] = at, lcp
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(self.end * self.kind.itemsize)
        self.file.write(rows.tobytes())
        if self.runs and len(self.runs[-1]) == 2:
            self.runs[-1] = self.runs[-1][0], self.end + len(rows)
        else:
            self.runs.append((self.end, self.end + len(rows)))
        self.end += len(rows)

    def _read(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        self.file.seek(start * self.kind.itemsize)
        rows = np.frombuffer(self.file.read((end - start) * self.kind.itemsize), self.kind)
        return np.ascontiguousarray(rows["at"]), np.ascontiguousarray(rows["lcp"])

    def chunks(self, step: int, back: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All runs, from the last to the first if back; those in the file so many at a time."""
        for run in reversed(self.runs) if back else self.runs:
            if len(run) == 3:
                yield run[:2]
            else:
                starts = range(run[0], run[1], step)
                for a in reversed(starts) if back else starts:
                    yield self._read(a, min(run[1], a + step))

    def pop(self, step: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The first runs that are in memory, or so many of the first in the file."""
        if not self.runs:
            return None
        n = next((i for i, run in enumerate(self.runs) if len(run) == 2), len(self.runs))
        if n:
            at, lcp, sizes = zip(*self.runs[:n])
            self.held[0] -= sum(sizes)
            del self.runs[:n]
            return (np.concatenate(at), np.concatenate(lcp)) if n > 1 else (at[0], lcp[0])
        start, end = self.runs[0]
        to = min(end, start + step)
        out = self._read(start, to)
        if to < end:
            self.runs[0] = to, end
        else:
            del self.runs[0]
            if not any(len(run) == 2 for run in self.runs):
                self.file.close()
                self.file, self.end = None, 0
        return out


def space(n: int, kind: type, memory: int, fill: int = 0) -> np.ndarray:
    """An array of n values, in a file if it is larger than memory."""
    if n * np.dtype(kind).itemsize <= memory:
        return np.full(n, fill, kind)
    out = np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,))
    for a in range(0, n, 1 << 20):
        out[a : a + (1 << 20)] = fill
    return out


def types(text: np.ndarray, memory: int, step: int) -> np.ndarray:
    """True for S suffixes; the last one, a separator, is S."""
    n = len(text)
    out = space(n, bool, memory)
    out[n - 1] = True
    for b in range(n - 1, 0, -step):
        a = max(0, b - step)
        here, after = text[a:b], text[a + 1 : b + 1]
        differ = np.append(np.flatnonzero(here != after), b - a)
        rises = np.append(here[differ[:-1]] < after[differ[:-1]], out[b])
        out[a:b] = np.repeat(rises, np.diff(np.concatenate(([-1], differ))))[: b - a]
    return out


def _eight(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place as one number, most significant first, over a padded text."""
    return np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))


def _sorted_starts(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """starts in the order of the depth bytes from each, ties by place, and common prefixes with the start before."""
    n = len(text)
    group, order, open_ = np.zeros(len(starts), np.int64), starts.copy(), np.arange(len(starts))
    lcp = np.zeros(len(starts), np.uint8)
    edge = np.zeros(len(starts), bool)  # whose common prefix with the start before is known
    edge[:1] = True
    tail = np.concatenate([text[max(0, n - depth - 16) :], np.zeros(depth + 32, np.uint8)])
    whole, last, shift = _eight(text) if n >= 8 else None, _eight(tail), max(0, n - depth - 16)

    def words(at: np.ndarray) -> np.ndarray:
        far = at > n - 8
        out = np.empty(len(at), np.uint64)
        if (~far).any():
            out[~far] = whole[at[~far]]
        out[far] = last[np.minimum(at[far], n + depth) - shift]
        return out

    for at in range(0, depth, 8):
        if not len(open_):
            break
        own = order[open_]
        key = words(own + at)
        g = group[open_]
        by = np.lexsort((key, g)) if at else np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[open_] = own
        other = np.zeros(len(key), np.uint64)
        other[1:] = key[1:] ^ key[:-1]
        beside = np.concatenate(([False], g[1:] == g[:-1]))
        new = np.flatnonzero(beside & (other != 0))
        lcp[open_[new]] = np.minimum(depth, at + _zero_bytes(other[new]))
        edge[open_[new]] = True
        first = np.flatnonzero(~beside | (other != 0))
        size = np.diff(np.append(first, len(own)))
        group[open_] = open_[np.repeat(first, size)]
        open_ = open_[np.repeat(size > 1, size)]
    lcp[~edge] = depth
    return order, lcp


def _zero_bytes(x: np.ndarray) -> np.ndarray:
    """Leading bytes of numbers that are zero."""
    out = np.zeros(len(x), np.int64)
    for b in range(1, 8):
        out += x < np.uint64(1 << (64 - 8 * b))
    return out


class Sort:
    """One sort of a uint8 text, in which 0 separates strings and ends the text."""

    def __init__(self, text: np.ndarray, depth: int, memory: int):
        self.text, self.depth, self.memory = text, depth, memory
        self.index = np.int32 if len(text) < 1 << 31 else np.int64
        self.step, self.held = max(1024, memory // 64), [0]
        self.is_s = types(text, memory, self.step)
        self.queues = self.pairs()
        self.restart()

    def pairs(self) -> list[Pairs]:
        return [Pairs(self.held, self.memory, self.index) for _ in range(256)]

    def restart(self) -> None:
        self.carry, self.seen = np.full(256, self.depth, np.uint8), np.zeros(256, bool)

    def common(self, a: int, b: int) -> int:
        """Common prefix of two suffixes by their bytes."""
        x, y = self.text[a : a + self.depth], self.text[b : b + self.depth]
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        return int(differ[0]) if len(differ) else n

    def stars(self) -> list[Pairs]:
        """Leftmost S suffixes in order, by first byte; sorted by ranges of their first two bytes, as many as fit in memory at once."""
        n, counts, none = len(self.text), np.zeros(1 << 16, np.int64), np.zeros(0, np.int64)

        def some(low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for a in range(0, n, self.step):
                b = min(n, a + self.step)
                star = np.array(self.is_s[a:b])
                star[1:] &= ~self.is_s[a : b - 1]
                star[0] &= a > 0 and not self.is_s[a - 1]
                at = np.flatnonzero(star) + a
                two = self.text[at].astype(np.int32) << 8 | np.where(at + 1 < n, self.text[np.minimum(at + 1, n - 1)], 0)
                own = (two >= low) & (two < high)
                yield at[own], two[own]

        for _, two in some(0, 1 << 16):
            counts += np.bincount(two, minlength=1 << 16)
        upto = np.concatenate(([0], np.cumsum(counts)))
        out, low, before = self.pairs(), 0, None
        while low < 1 << 16:
            high = max(low + 1, int(np.searchsorted(upto, upto[low] + self.step, "right")) - 1)
            if upto[high] > upto[low]:
                starts, lcp = _sorted_starts(self.text, np.concatenate([*(at for at, _ in some(low, high)), none]), self.depth)
                first = self.text[starts]
                if before is not None:
                    lcp[0] = self.common(before, starts[0])
                before = starts[-1]
                cuts = [0, *(np.flatnonzero(first[1:] != first[:-1]) + 1).tolist(), len(first)]
                for x, y in zip(cuts[:-1], cuts[1:]):
                    out[first[x]].push(starts[x:y].astype(self.index), lcp[x:y])
            low = high
        return out

    def induce(self, at: np.ndarray, lcp: np.ndarray, want: bool) -> None:
        """Queue the suffixes before these, that are of the wanted type, with their common prefixes."""
        if len(at) == 1:  # steps along a run of one byte
            np.minimum(self.carry, lcp[0], out=self.carry)
            before = at[0] - 1
            if before >= 0 and self.is_s[before] == want:
                c = self.text[before]
                found = min(self.carry[c] + 1, self.depth) if self.seen[c] else 0
                self.seen[c], self.carry[c] = True, self.depth
                self.queues[c].push(at - 1, np.full(1, found, np.uint8))
            return
        for a in range(0, len(at), self.step):
            p, own = at[a : a + self.step], lcp[a : a + self.step]
            carry = np.minimum(self.carry, own.min())
            which = np.flatnonzero(p > 0)
            before = p[which] - 1
            ok = self.is_s[before] == want
            which, before = which[ok], before[ok]
            chars = self.text[before]
            order = np.argsort(chars, kind="stable")
            which, before, chars = which[order], before[order], chars[order]
            cuts = [0, *(np.flatnonzero(chars[1:] != chars[:-1]) + 1).tolist(), len(chars)] if len(chars) else [0]
            for x, y in zip(cuts[:-1], cuts[1:]):
                c, i = chars[x], which[x:y]
                to = int(i[-1]) + 1
                least = np.minimum.reduceat(own[:to], np.concatenate(([0], i[:-1] + 1)))
                least[0] = min(least[0], self.carry[c])
                found = np.minimum(least + np.uint8(1), np.uint8(self.depth))
                if not self.seen[c]:
                    self.seen[c], found[0] = True, 0
                self.queues[c].push(before[x:y], found)
                carry[c] = own[to:].min() if to < len(own) else self.depth
            self.carry = carry

    def run(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        low, high, stars = self.pairs(), self.pairs(), self.stars()
        for c in range(256):
            before = None
            while (q := self.queues[c].pop(self.step)) is not None:
                low[c].push(*q)
                self.induce(*q, False)
                before = q[0][-1]
            while (q := stars[c].pop(self.step)) is not None:
                at, lcp = q
                if before is not None:
                    lcp = lcp.copy()
                    lcp[0], before = self.common(before, at[0]), None
                self.induce(at, lcp, False)
        self.restart()
        for c in range(255, -1, -1):
            after = None
            while (q := self.queues[c].pop(self.step)) is not None:
                high[c].push(*q)
                self.induce(*q, True)
                after = q[0][-1]
            following = None
            for at, lcp in low[c].chunks(self.step, back=True):
                if following is None:
                    following = 0 if after is None else self.common(after, at[-1])
                self.induce(at[::-1], np.append(lcp[1:], np.uint8(following))[::-1], True)
                following = lcp[0]
        last = np.array([len(self.text) - 1], self.index)
        self.induce(last, np.zeros(1, np.uint8), True)  # the last separator, less than all else, has no next one to be induced from
        while (q := self.queues[0].pop(self.step)) is not None:
            high[0].push(*q)
            self.induce(*q, True)
        yield last, np.zeros(1, np.uint8)
        for c in range(256):
            before = None
            for at, lcp in low[c].chunks(self.step):
                yield at, lcp
                before = at[-1]
            smaller = None
            for at, lcp in high[c].chunks(self.step, back=True):
                if smaller is None:
                    smaller = 0 if before is None else self.common(before, at[-1])
                yield at[::-1], np.append(lcp[1:], np.uint8(smaller))[::-1]
                smaller = lcp[0]


def suffix_order(text: np.ndarray, depth: int, memory: int = 64 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of (start, common prefix with the suffix before) of all suffixes, in the order of at least their first depth bytes.

    Common prefixes are counted up to depth (below 256), and across separators.
    """
    if len(text):
        yield from Sort(text, depth, memory).run()
