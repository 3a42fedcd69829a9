"""Suffix sorting by induction, with queues that go to disk and common-prefix lengths that travel along.

Suffixes that start smaller than their successor and follow a larger byte (S*) are named by the stretch up to the
next one, and sorted by their names. From them the larger-than-successor suffixes (L) are induced in rising order, and
from these the rest (S) in falling order: each byte has a queue of (place, common prefix with the one before it), and
whoever leaves a queue puts the suffix before it into the queue of its byte. A whole block of a queue is dealt at
once. Queues hold their blocks in memory up to a budget that all share, then in a scratch file of the task.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes that the queues of one sort hold in memory.
BUDGET = 64 << 20
#: Suffixes of one block.
BLOCK = 1 << 18


class Scratch:
    """Where blocks go: memory while the budget lasts, then one file (removed with the object)."""

    def __init__(self, budget: int = BUDGET):
        self.left, self.file, self.end = budget, None, 0

    def put(self, place: np.ndarray, lcp: np.ndarray):
        size = 5 * len(place)
        if size <= self.left:
            self.left -= size
            return place.astype(np.uint32), lcp
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.end
        self.file.seek(at)
        self.file.write(place.astype("<u4").tobytes() + lcp.tobytes())
        self.end += size
        return at, len(place)

    def get(self, block, free: bool = True) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(block[0], np.ndarray):
            if free:
                self.left += 5 * len(block[0])
            return block[0].astype(np.int64), block[1]
        self.file.seek(block[0])
        data = self.file.read(5 * block[1])
        return np.frombuffer(data, "<u4", block[1]).astype(np.int64), np.frombuffer(data, np.uint8, block[1], 4 * block[1])


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, ``cap`` at most."""
    out = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    while len(alive):
        same = text[np.minimum(a[alive] + out[alive], len(text) - 1)] == text[np.minimum(b[alive] + out[alive], len(text) - 1)]
        same &= np.maximum(a[alive], b[alive]) + out[alive] < len(text)
        alive = alive[same]
        out[alive] += 1
        alive = alive[out[alive] < cap]
    return out.astype(np.uint8)


def _names(code: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ranks of the stretches of ``code`` (10-bit values) from ``first`` on, ``size`` long."""
    rank = np.zeros(len(first), np.int64)
    active = np.arange(len(first))
    done = 0
    while len(active):
        chunk = np.zeros(len(active), np.uint64)
        for j in range(6):
            inside = done + j < size[active]
            value = code[np.minimum(first[active] + done + j, len(code) - 1)].astype(np.uint64) + np.uint64(1)
            chunk = (chunk << np.uint64(10)) | np.where(inside, value, np.uint64(0))
        by = np.lexsort((chunk, rank[active]))
        r, c = rank[active][by], chunk[by]
        new = np.append(True, (r[1:] != r[:-1]) | (c[1:] != c[:-1]))
        head = np.append(True, r[1:] != r[:-1])
        # a group's ranks go up from its old one, which left room for all its members
        start = np.flatnonzero(new)
        inner = start - np.maximum.accumulate(np.where(head, np.arange(len(r)), 0))[start]
        rank[active[by]] = r + np.repeat(inner, np.diff(np.append(start, len(r))))
        many = np.repeat(np.diff(np.append(start, len(r))) > 1, np.diff(np.append(start, len(r))))
        done += 6
        active = active[by][many]
        active = active[size[active] > done]
        # ended members of a group come before longer ones, so they keep their rank
    return np.unique(rank, return_inverse=True)[1]


def sort_starred(text: np.ndarray, is_s: np.ndarray, starred: np.ndarray) -> np.ndarray:
    """The S* suffixes in order. Their names are sorted by doubling, as there are nearly as many names as suffixes."""
    size = np.append(np.diff(starred) + 1, 1)
    rank = _names(text.astype(np.uint16) * 2 + is_s, starred, size)
    step, n = 1, len(rank)
    while n and rank.max() < n - 1:
        after = np.append(rank[step:] + 1, np.zeros(min(step, n), np.int64))
        rank = np.unique((rank << 32) | after, return_inverse=True)[1]
        step *= 2
    return starred[np.argsort(rank)]


class _Queues:
    """A queue of suffixes per byte, and what the common prefix of the next one with the last one is bounded by."""

    def __init__(self, scratch: Scratch, cap: int):
        self.scratch, self.cap = scratch, cap
        self.blocks: list[list] = [[] for _ in range(258)]
        self.bound = np.full(258, cap, np.int64)
        self.held = np.zeros(258, bool)

    def deal(self, place: np.ndarray, lcp: np.ndarray, byte: np.ndarray, chosen: np.ndarray) -> None:
        """Put the suffixes before ``place[chosen]`` into the queues of their bytes."""
        n = len(place)
        levels = [lcp]
        while 2 ** len(levels) <= n:
            half = 2 ** (len(levels) - 1)
            levels.append(np.append(np.minimum(levels[-1][:-half], levels[-1][half:]), np.zeros(half, np.uint8)))
        table = np.stack(levels)

        def least(low, high):
            size = high - low + 1
            k = np.frexp(size.astype(float))[1] - 1
            return np.minimum(table[k, low], table[k, high - 2**k + 1]).astype(np.int64)

        if len(chosen):
            by = np.argsort(byte, kind="stable")
            at, byte = chosen[by], byte[by]
            head = np.append(True, byte[1:] != byte[:-1])
            low = np.where(head, 0, np.append(0, at[:-1] + 1))
            common = least(low, at)
            common = np.where(head, np.minimum(common, self.bound[byte]), common)
            common = np.where(head & ~self.held[byte], 0, np.minimum(common + 1, self.cap)).astype(np.uint8)
            starts = np.flatnonzero(head)
            ends = np.append(starts[1:], len(at))
            self.bound = np.minimum(self.bound, int(lcp.min()))
            for a, b in zip(starts.tolist(), ends.tolist()):
                c, last = int(byte[a]), int(at[b - 1])
                self.bound[c] = self.cap if last == n - 1 else int(lcp[last + 1 :].min())
                self.held[c] = True
                self.blocks[c].append(self.scratch.put(place[at[a:b]] - 1, common[a:b]))
        else:
            self.bound = np.minimum(self.bound, int(lcp.min()))

    def take(self, c: int) -> tuple[np.ndarray, np.ndarray] | None:
        if not self.blocks[c]:
            return None
        found, size = [], 0
        while self.blocks[c] and size < BLOCK:
            found.append(self.scratch.get(self.blocks[c].pop(0)))
            size += len(found[-1][0])
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def suffixes(data: np.ndarray, cap: int, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes of ``data`` (bytes), in blocks: places, and the common prefix of each with the next smaller of its
    class (``cap`` at most; 0 for the first). Blocks come byte by byte: of the L class rising, then, byte by byte from
    the top, of the S class falling. Of a byte, L suffixes are smaller than S ones.
    """
    n = len(data)
    if n == 0:
        return
    text = np.append(data.astype(np.int16) + 1, np.int16(0))
    change = np.flatnonzero(text[1:] != text[:-1])
    rising = np.append(text[change] < text[change + 1], True)
    length = np.diff(np.concatenate([[-1], change, [n]]))
    is_s = np.repeat(rising, length)
    run = np.repeat(np.append(change, n), length) - np.arange(n + 1) + 1
    starred = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    ordered = sort_starred(text, is_s, starred)
    seed_lcp = np.append(np.uint8(0), common_prefix(text, ordered[:-1], ordered[1:], cap))
    cuts = np.searchsorted(text[ordered], np.arange(258))
    scratch = Scratch(budget)
    queues = _Queues(scratch, cap)
    large: list[list] = [[] for _ in range(258)]
    seam = lambda a, b: np.uint8(min(int(run[a]), int(run[b]), cap))

    def feed(place, lcp, want_s):
        before = place - 1
        ok = (place > 0) & (is_s[before] == want_s)
        chosen = np.flatnonzero(ok)
        queues.deal(place, lcp, text[before[chosen]], chosen)

    for c in range(258):
        last = None
        while (got := queues.take(c)) is not None:
            place, lcp = got
            feed(place, lcp, False)
            large[c].append(scratch.put(place, lcp))
            last = int(place[-1])
            yield place, lcp
        for a in range(cuts[c], cuts[c + 1] if c < 257 else len(ordered), BLOCK):
            place = ordered[a : min(a + BLOCK, cuts[c + 1] if c < 257 else len(ordered))]
            lcp = seed_lcp[a : a + len(place)].copy()
            if a == cuts[c]:
                lcp[0] = 0 if last is None else seam(last, int(place[0]))
            feed(place, lcp, False)
    queues = _Queues(scratch, cap)
    for c in range(257, 0, -1):
        last = None
        while (got := queues.take(c)) is not None:
            place, lcp = got
            feed(place, lcp, True)
            last = int(place[-1])
            yield place, lcp
        following = None
        for block in reversed(large[c]):
            place, lcp = scratch.get(block, free=False)
            back = place[::-1]
            near = np.append(np.uint8(0), lcp[::-1][:-1])
            near[0] = following if following is not None else 0 if last is None else seam(last, int(back[0]))
            following = lcp[0]
            feed(back, near, True)


def repeated(data: np.ndarray, length: int, budget: int = BUDGET) -> np.ndarray:
    """Whether the ``length`` bytes from each place on (255 at most) also start elsewhere in ``data``."""
    marked = np.zeros(len(data), bool)
    if not len(data):
        return marked
    last, byte, rest = None, None, {}
    change = np.flatnonzero(data[1:] != data[:-1])
    run = np.repeat(np.append(change, len(data) - 1), np.diff(np.concatenate([[-1], change, [len(data) - 1]]))) - np.arange(len(data)) + 1
    for place, lcp in suffixes(data, length, budget):
        near = np.flatnonzero(lcp >= length)
        marked[place[near]] = True
        marked[place[near[near > 0] - 1]] = True
        if len(near) and near[0] == 0 and last is not None:
            marked[last] = True
        last = int(place[-1])
    # where an L and an S suffix of one byte are neighbours, they have the shorter of their runs of it in common
    long = np.flatnonzero(run >= length)
    if len(long):
        for c in np.unique(data[long]):
            own = long[data[long] == c]
            if len(own) > 1:
                marked[own] = True
    return marked
