"""External induced sorting: order and common prefixes of the suffixes of a byte string, through disk-backed queues.

Suffixes are larger (L) or smaller (S) than their successor; the leftmost S ones of each run are *seeds*.

1. Substrings between seeds are sorted by inducing from unsorted seeds, and named.
2. Where names repeat, the string of names (at most half as long) is sorted by the same method, recursively.
3. The common prefixes of neighbouring seeds are read off the text; from there on they are carried: L suffixes
   are induced from sorted seeds front to back, S suffixes from the L ones back to front, and a suffix tuple
   that enters a queue brings the common prefix with the tuple before it in its bucket, one more than the
   least of those between the two suffixes that follow. Only where L and S suffixes of a first symbol meet, bytes are compared.

A tuple is (first symbol, position, common prefix); tuples reach a queue in the order of the suffix that follows
their first symbol, so a priority queue over them is one first-in-first-out run per symbol (per range of names in
the recursion, where tuples of a range are ordered among themselves when it is taken). A queue keeps at most ``MEMORY`` tuples
in memory and appends the rest to files; text, order and all arrays with more than ``MEMORY`` entries are
memory maps of files, so that a shard may be far larger than memory. Files live in a folder of the task that ends with it.

Common prefixes are counted up to ``depth`` bytes (below 2**16); the order is exact to the end. A tuple is stored
as position * 2**16 + common prefix.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

BLOCK = 1 << 17
RANGE = 1 << 13  # suffixes of a range of names
MEMORY = 1 << 16
BITS, MASK = 16, (1 << 16) - 1


class Disk:
    """A folder of the task for what exceeds memory; ``spilled`` counts the tuples that queues wrote to it."""

    def __init__(self) -> None:
        self.folder, self.spilled = tempfile.mkdtemp(prefix="induced-"), 0

    def __enter__(self) -> Disk:
        return self

    def __exit__(self, *_: object) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)

    def path(self) -> str:
        fd, path = tempfile.mkstemp(dir=self.folder)
        os.close(fd)
        return path

    def array(self, n: int, dtype: type) -> np.ndarray:
        """Zeros, in memory or in a file."""
        if n <= MEMORY:
            return np.zeros(n, dtype)
        path = self.path()
        os.truncate(path, n * np.dtype(dtype).itemsize)
        return np.memmap(path, dtype, "r+", shape=n)


class Run:
    """Tuples in order of insertion, filed when the queue asks for room; taken in blocks."""

    __slots__ = ("at", "filed", "held", "path", "wait")

    def __init__(self) -> None:
        self.path, self.filed, self.at, self.held = "", 0, 0, 0
        self.wait: list[np.ndarray] = []

    def push(self, rows: np.ndarray) -> None:
        self.wait.append(rows)
        self.held += len(rows)

    def spill(self, disk: Disk) -> None:
        self.path = self.path or disk.path()
        with open(self.path, "ab") as f:
            for rows in self.wait:
                rows.astype(np.int64).tofile(f)
        self.filed += self.held
        disk.spilled += self.held
        self.wait, self.held = [], 0

    def take(self) -> np.ndarray:
        if self.at < self.filed:
            rows = np.fromfile(self.path, np.int64, min(BLOCK, self.filed - self.at), offset=self.at * 8)
            self.at += len(rows)
            return rows
        rows = self.wait[0] if len(self.wait) == 1 else np.concatenate(self.wait)
        if self.path:
            os.truncate(self.path, 0)
        self.wait, self.held, self.filed, self.at = [], 0, 0, 0
        return rows

    def left(self) -> bool:
        return self.at < self.filed or bool(self.held)


class Queue:
    """One run per bucket; at most ``MEMORY`` tuples of all runs together are in memory."""

    def __init__(self, disk: Disk, buckets: int):
        self.disk, self.runs, self.held = disk, [Run() for _ in range(buckets)], 0

    def insert(self, bucket: np.ndarray, rows: np.ndarray) -> None:
        """Rows of ascending buckets."""
        if not len(rows):
            return
        cut = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        a = 0
        for b in [*cut.tolist(), len(bucket)]:
            self.runs[bucket[a]].push(rows[a:b])
            a = b
        self.held += len(rows)
        if self.held > MEMORY:
            for run in self.runs:
                if run.held:
                    run.spill(self.disk)
            self.held = 0

    def take(self, bucket: int) -> Iterator[np.ndarray]:
        """Blocks of a bucket, those included that are inserted meanwhile."""
        run = self.runs[bucket]
        while run.left():
            held = run.held
            rows = run.take()
            self.held -= held - run.held
            yield rows


def types(text: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """True where the suffix is smaller than its successor; the empty suffix is smallest, so the last is L."""
    n = len(text)
    s = np.zeros(n, bool) if out is None else out
    after = False  # type of the suffix behind the block
    for b in range(n, 0, -BLOCK):
        a = max(0, b - BLOCK)
        part = np.asarray(text[a : min(b + 1, n)])
        k = b - a
        less, equal = np.zeros(k, bool), np.zeros(k, bool)
        m = len(part) - 1  # places that have a successor
        less[:m], equal[:m] = part[:-1] < part[1:], part[:-1] == part[1:]
        nxt = np.where(equal, k, np.arange(k))  # the place that decides: the next one with another successor
        nxt = np.minimum.accumulate(nxt[::-1])[::-1]
        s[a:b] = np.where(nxt < k, less[np.minimum(nxt, k - 1)], after)
        after = bool(s[a])
    return s


def table_of(x: np.ndarray) -> list[np.ndarray]:
    """Minima of all stretches of 1, 2, 4, ... entries."""
    out, reach = [x], 1
    while 2 * reach <= len(x):
        out.append(np.minimum(out[-1][:-reach], out[-1][reach:]))
        reach *= 2
    return out


def least(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of the entries lo..hi, both included."""
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out = np.empty(len(lo), table[0].dtype)
    for k in np.unique(level).tolist():
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[k][lo[at]], table[k][hi[at] - (1 << k) + 1])
    return out


class Carry:
    """Least common prefix between what was scanned since the last tuple of each bucket, and now."""

    def __init__(self, depth: int):
        self.depth, self.since, self.met = depth, np.full(256, depth, np.uint16), np.zeros(256, bool)

    def passed(self, prefix: np.ndarray, at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Common prefixes of tuples that the scanned entries ``at`` insert into ``bucket`` (ascending, ``at`` ascending within one).

        ``prefix``: that of each scanned entry with the one scanned before it.
        """
        if not len(at):
            np.minimum(self.since, prefix.min(), out=self.since)
            return np.zeros(0, np.uint16)
        lead = np.append(True, bucket[1:] != bucket[:-1])
        lo = np.append(0, at[:-1] + 1)
        lo[lead] = 0
        table = table_of(prefix)
        m = least(table, lo, at)
        one = bucket[lead]
        m[lead] = np.minimum(m[lead], self.since[one])
        out = np.minimum(m + np.uint16(1), np.uint16(self.depth))
        out[np.flatnonzero(lead)[~self.met[one]]] = 0  # first of its bucket
        np.minimum(self.since, prefix.min(), out=self.since)
        rest = at[np.append(lead[1:], True)] + 1
        tail = np.full(len(one), self.depth, np.uint16)
        some = rest < len(prefix)
        tail[some] = least(table, rest[some], np.full(int(some.sum()), len(prefix) - 1))
        self.since[one], self.met[one] = tail, True
        return out


def common(text: np.ndarray, a: int, b: int, depth: int) -> int:
    x, y = text[a : a + depth], text[b : b + depth]
    k = min(len(x), len(y))
    differ = np.flatnonzero(x[:k] != y[:k])
    return int(differ[0]) if len(differ) else k


def induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, prefix: np.ndarray | None, depth: int, disk: Disk, only: np.ndarray | None = None) -> np.ndarray:
    """Suffixes from the last to the first in the order that the order of the seeds induces, as tuples with the common prefix with the one before in this list.

    ``prefix``: common prefixes of neighbouring seeds; without it none are carried. ``only`` marks the suffixes that are wanted.
    """
    n = len(text)
    first = text[seeds]
    by = np.argsort(first, kind="stable")
    cut = np.searchsorted(first[by], np.arange(257))
    seeded = seeds[by]

    def grow(queue: Queue, carry: Carry, at: np.ndarray, with_: np.ndarray, want: bool) -> None:
        q = at - 1
        ok = np.flatnonzero(at > 0)
        ok = ok[small[q[ok]] == want]
        bucket = text[q[ok]]
        order = np.argsort(bucket, kind="stable")
        ok, bucket = ok[order], bucket[order]
        rows = q[ok] << BITS
        if prefix is not None:
            rows |= carry.passed(with_, ok, bucket)
        queue.insert(bucket, rows)

    queue, carry = Queue(disk, 256), Carry(depth)
    # the empty suffix comes first of all and induces the last symbol, which is L
    queue.insert(np.array(text[n - 1 :]), np.array([(n - 1) << BITS]))
    carry.met[text[n - 1]], carry.since[:] = True, 0
    large, bound, at = disk.array(n - int(np.count_nonzero(small)), np.int64), [0], 0
    for c in range(256):
        for rows in queue.take(c):
            large[at : at + len(rows)] = rows
            at += len(rows)
            grow(queue, carry, rows >> BITS, (rows & MASK).astype(np.uint16), False)
        for a in range(cut[c], cut[c + 1], BLOCK):
            part = seeded[a : min(a + BLOCK, cut[c + 1])]
            with_ = np.zeros(len(part), np.uint16) if prefix is None else prefix[by[a : a + len(part)]]
            if a == cut[c] and prefix is not None:
                with_[0] = common(text, int(large[at - 1]) >> BITS, int(part[0]), depth) if at > bound[-1] else 0
            grow(queue, carry, part, with_, False)
        bound.append(at)
    queue, carry = Queue(disk, 256), Carry(depth)
    out, done = disk.array(n if only is None else int(np.count_nonzero(only)), np.int64), 0

    def emit(rows: np.ndarray) -> None:
        nonlocal done
        rows = rows if only is None else rows[only[rows >> BITS]]
        out[done : done + len(rows)] = rows
        done += len(rows)

    for c in range(255, -1, -1):
        lowest = -1
        for rows in queue.take(c):
            emit(rows)
            lowest = int(rows[-1]) >> BITS
            grow(queue, carry, rows >> BITS, (rows & MASK).astype(np.uint16), True)
        before = 0
        for b in range(bound[c + 1], bound[c], -BLOCK):
            rows = np.array(large[max(bound[c], b - BLOCK) : b][::-1])
            with_ = (rows & MASK).astype(np.uint16)
            if b == bound[c + 1]:
                before = common(text, int(rows[0]) >> BITS, lowest, depth) if lowest >= 0 and prefix is not None else 0
            with_, before = np.append(np.uint16(before), with_[:-1]), int(with_[-1])
            emit((rows >> BITS << BITS) | with_)
            grow(queue, carry, rows >> BITS, with_, True)
    return out


def named(text: np.ndarray, seeds: np.ndarray, ordered: np.ndarray, disk: Disk) -> tuple[np.ndarray, int]:
    """(name of every seed in text order, number of names); ``ordered`` has the seeds by their substrings."""
    n = len(text)
    stop = np.append(seeds[1:] + 1, n)  # a seed's substring runs to the next seed, inclusive
    k = np.searchsorted(seeds, ordered)
    length = stop[k] - ordered
    same = np.zeros(len(ordered), bool)
    cand = np.flatnonzero(length[1:] == length[:-1]) + 1
    for part in np.array_split(cand, max(1, int(length[cand].sum()) // (4 * BLOCK))) if len(cand) else []:
        if not len(part):
            continue
        size = length[part]
        at = np.cumsum(size) - size
        off = np.arange(int(size.sum())) - np.repeat(at, size)
        eq = text[np.repeat(ordered[part], size) + off] == text[np.repeat(ordered[part - 1], size) + off]
        same[part] = np.logical_and.reduceat(eq, at)
    name = disk.array(len(seeds), np.int64)
    name[k] = np.cumsum(~same) - 1
    return name, int(len(same) - same.sum())


def scanned(names: np.ndarray, small: np.ndarray, want: bool, bucket_of: np.ndarray, given: Callable[[int], np.ndarray], disk: Disk) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Induction over ranges of names: (range, its suffixes in scanning order, which of them were induced).

    L suffixes (``want`` false) are scanned from the first range to the last, S ones back. Suffixes induced
    within a range form chains; they are ordered link by link, by the place of the suffix that follows.
    """
    ranges = int(bucket_of.max()) + 1
    queue = Queue(disk, ranges)
    if not want:
        queue.insert(bucket_of[names[-1:]], np.array([len(names) - 1]))
    for r in range(ranges - 1, -1, -1) if want else range(ranges):
        came = [np.zeros(0, np.int64), *queue.take(r)]
        a, g = np.concatenate(came), given(r)
        pos, src = np.concatenate([a, g]), np.zeros(0, np.int64)
        told = np.append(np.arange(len(a)), np.arange(len(g)))
        ends, fresh = [len(pos)], np.arange(len(pos))
        while len(fresh):
            q = pos[fresh] - 1
            ok = np.flatnonzero(q >= 0)
            ok = ok[small[q[ok]] == want]
            ok = ok[bucket_of[names[q[ok]]] == r]
            src, pos = np.append(src, fresh[ok]), np.append(pos, q[ok])
            fresh = np.arange(ends[-1], len(pos))
            ends.append(len(pos))
        induced = np.ones(len(pos), bool)
        induced[len(a) : len(a) + len(g)] = False
        group = ((-names[pos] if want else names[pos]) * 2 + ~induced) * (2 * len(pos) + 1)
        order = np.argsort(group[: ends[0]] + told)
        rank = np.empty(len(pos), np.int64)
        for end in ends[1:-1]:
            rank[order] = np.arange(len(order))
            order = np.argsort(np.append(group[: ends[0]] + told, group[ends[0] : end] + len(a) + rank[src[: end - ends[0]]]))
        scan, induced = pos[order], induced[order]
        q = scan[scan > 0] - 1
        q = q[small[q] == want]
        to = bucket_of[names[q]]
        q, to = q[to != r], to[to != r]
        by = np.argsort(to, kind="stable")
        queue.insert(to[by], q[by])
        yield r, scan, induced


def induce_names(names: np.ndarray, small: np.ndarray, seeds: np.ndarray, disk: Disk) -> np.ndarray:
    """All suffixes of a string of names, in the order that the order of the seeds induces."""
    count = np.bincount(names)
    bucket_of = np.unique((np.cumsum(count) - count) // RANGE, return_inverse=True)[1].reshape(-1)
    of = bucket_of[names[seeds]]
    by = np.argsort(of, kind="stable")
    cut = np.searchsorted(of[by], np.arange(int(bucket_of.max()) + 2))
    large, bound = disk.array(len(names) - int(np.count_nonzero(small)), np.int64), [0]
    ranks = np.empty(len(seeds), np.int64)
    ranks[by] = np.arange(len(seeds))
    for _, scan, induced in scanned(names, small, False, bucket_of, lambda r: seeds[by[cut[r] : cut[r + 1]]], disk):
        rows = scan[induced]
        large[bound[-1] : bound[-1] + len(rows)] = rows
        bound.append(bound[-1] + len(rows))
    out, at = disk.array(len(names), np.int64), len(names)
    for _, scan, _ in scanned(names, small, True, bucket_of, lambda r: np.array(large[bound[r] : bound[r + 1]][::-1]), disk):
        out[at - len(scan) : at] = scan[::-1]
        at -= len(scan)
    return out


def order_names(names: np.ndarray, disk: Disk) -> np.ndarray:
    """Suffix order of a string of names."""
    n = len(names)
    if n < 2:
        return np.arange(n)
    small = types(names, disk.array(n, bool))
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(seeds) > 1:
        mark = disk.array(n, bool)
        mark[seeds] = True
        ordered = induce_names(names, small, seeds, disk)
        seeds = sorted_seeds(names, seeds, ordered[mark[ordered]], disk)
    return induce_names(names, small, seeds, disk)


def sorted_seeds(text: np.ndarray, seeds: np.ndarray, ordered: np.ndarray, disk: Disk) -> np.ndarray:
    """Seeds in the order of their suffixes; where substrings repeat, the string of their names is sorted in turn."""
    name, names = named(text, seeds, ordered, disk)
    return ordered if names == len(seeds) else seeds[order_names(name, disk)]


def suffixes(text: np.ndarray, depth: int, disk: Disk) -> np.ndarray:
    """Tuples of all suffixes of ``text`` (uint8) from the last to the first, with the common prefix (up to ``depth``) with the one before in this list."""
    n = len(text)
    if n < 2:
        return np.zeros(n, np.int64)
    small = types(text, disk.array(n, bool))
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(seeds) > 1:
        mark = disk.array(n, bool)
        mark[seeds] = True
        ordered = (induce(text, small, seeds, None, depth, disk, mark) >> BITS)[::-1]
        seeds = sorted_seeds(text, seeds, ordered, disk)
    return induce(text, small, seeds, shared(text, seeds, depth), depth, disk)


def shared(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix, up to ``depth``, of each suffix of ``at`` with the one before it (0 for the first)."""
    out = np.zeros(len(at), np.uint16)
    alive = np.arange(1, len(at))
    n = len(text)
    for d in range(depth):
        a, b = at[alive] + d, at[alive - 1] + d
        ok = (a < n) & (b < n)
        ok[ok] = text[a[ok]] == text[b[ok]]
        alive = alive[ok]
        if not len(alive):
            break
        out[alive] = d + 1
    return out
