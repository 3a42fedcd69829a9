"""Matching-block similarity of two texts, equal to the standard library's ``SequenceMatcher`` ratio.

The library walks every character of a range again and again. In a text of 200 or
more characters only rare characters may start a block, so this version visits only
those; in a shorter text it holds all pairs of equal characters as the bits of one
number and finds the longest run by shifting that along its diagonal. It can also stop
as soon as a required ratio is out of reach.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np


class Prepared:
    """A second text with the places of the characters that may start a block."""

    def __init__(self, text: str):
        self.text = text
        self.counts = Counter(text)
        self.plain = len(text) < 200
        limit = len(text) // 100 + 1
        self.places: dict[str, list[int]] = {}
        for at, ch in enumerate("" if self.plain else text):
            if self.counts[ch] <= limit:
                self.places.setdefault(ch, []).append(at)
        # a row of bits per character, one column wider than the text, in whole bytes
        self.bytes = len(text) // 8 + 1
        bits: dict[str, int] = {}
        for at, ch in enumerate(text if self.plain else ""):
            bits[ch] = bits.get(ch, 0) | 1 << at
        self.rows = {ch: b.to_bytes(self.bytes, "little") for ch, b in bits.items()}

    def tables(self, texts: Texts) -> np.ndarray:
        """The rows of bits of all characters of some texts; those of a text's characters in turn are its table."""
        none = bytes(self.bytes)
        return np.frombuffer(b"".join([self.rows.get(ch, none) for ch in texts.alphabet]), np.uint8).reshape(-1, self.bytes)


class Texts:
    """Several texts as numbers of their characters in a common alphabet."""

    def __init__(self, texts: list[str]):
        codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
        points, numbers = np.unique(np.concatenate(codes), return_inverse=True)
        self.alphabet = points.tobytes().decode("utf-32-le")
        self.numbers = np.split(numbers, np.cumsum([len(c) for c in codes])[:-1])

    def table(self, row: int, tables: np.ndarray) -> int:
        return int.from_bytes(tables[self.numbers[row]].tobytes(), "little")


#: Characters of the shorter range from which the bit table beats substring search.
_ROWS = 20


def _bit_table(a: str, other: Prepared) -> int:
    """Bit (i * row + j) is set where ``a[i]`` equals the other text's character j."""
    none = bytes(other.bytes)
    return int.from_bytes(b"".join([other.rows.get(ch, none) for ch in a]), "little")


def _part(table: int, other: Prepared, low_a, high_a, low_b, high_b):
    """The rows of a table from ``low_a`` to ``high_a``, with the bits of some columns only."""
    row = other.bytes * 8
    columns = ((1 << high_b) - (1 << low_b)).to_bytes(other.bytes, "little")
    return table >> low_a * row & int.from_bytes(columns * (high_a - low_a), "little")


def _longest_in_part(part: int, other: Prepared, low_a):
    """Longest common run of the ranges whose bits are given, the first in ``a`` and then in ``b`` among equals."""
    row = other.bytes * 8
    size, ends = 0, 0
    while part:  # the ends of runs of size + 1 characters
        ends, size = part, size + 1
        part &= part << row + 1
    first = (ends & -ends).bit_length() - 1
    return low_a + first // row - size + 1, first % row - size + 1, size


def _longest_plain(a, b, low_a, high_a, low_b, high_b):
    """Longest common run inside the ranges, the first in ``a`` and then in ``b`` among equals."""
    part = b[low_b:high_b]
    at, size = low_a, 0
    i = low_a
    while i + size < high_a:
        while i + size < high_a and a[i : i + size + 1] in part:
            at, size = i, size + 1
        i += 1
    return at, low_b + part.find(a[at : at + size]), size


def _longest_from_b(a, b, low_a, high_a, low_b, high_b):
    """The same, for a short range of the other text: its runs are searched for in this one."""
    part = a[low_a:high_a]
    j, size = low_b, 0
    while j + size < high_b:
        while j + size < high_b and b[j : j + size + 1] in part:
            size += 1
        j += 1
    if not size:
        return low_a, low_b, 0
    found = [(part.find(b[j : j + size]), j) for j in range(low_b, high_b - size + 1)]
    i, j = min([pair for pair in found if pair[0] >= 0])
    return low_a + i, j, size


def _longest(a, starts, seeds, b, low_a, high_a, low_b, high_b):
    """Longest common run inside the ranges: begun by seed characters, then grown on both sides."""
    at_a, at_b, size = low_a, low_b, 0
    runs: dict[int, int] = {}
    last = -2
    for n in range(bisect_left(starts, low_a), bisect_left(starts, high_a)):
        i, spots = seeds[n]
        before = runs if i == last + 1 else {}
        runs, last = {}, i
        for j in spots:
            if j >= high_b:
                break
            if j >= low_b:
                k = runs[j] = before.get(j - 1, 0) + 1
                if k > size:
                    at_a, at_b, size = i - k + 1, j - k + 1, k
    while at_a > low_a and at_b > low_b and a[at_a - 1] == b[at_b - 1]:
        at_a, at_b, size = at_a - 1, at_b - 1, size + 1
    while at_a + size < high_a and at_b + size < high_b and a[at_a + size] == b[at_b + size]:
        size += 1
    return at_a, at_b, size


def ratio(a: str, other: Prepared, floor: float = 0.0, counts: Counter | None = None, table: int | None = None) -> float | None:
    """Twice the matched characters over both lengths; None once it must stay below ``floor``.

    ``table`` is the bit table of both texts, where it is at hand.
    """
    b = other.text
    total = len(a) + len(b)
    if not total:
        return 1.0
    if floor > 0.0 and counts is not None:
        common = sum(min(n, counts[ch]) for ch, n in other.counts.items())
        if 2.0 * common / total < floor:
            return None
    if other.plain and table is None:
        table = _bit_table(a, other)
    seeds = [(i, other.places[ch]) for i, ch in enumerate(a) if ch in other.places] if other.places else []
    starts = [i for i, _ in seeds]
    matched, possible = 0, min(len(a), len(b))
    # with the bits of its rows from row ``top`` on, of which those outside the range are left out when it comes up
    ranges = [(0, len(a), 0, len(b), table, 0)]
    while ranges:
        low_a, high_a, low_b, high_b, part, top = ranges.pop()
        rows, columns = high_a - low_a, high_b - low_b
        possible -= min(rows, columns)
        if other.plain and min(rows, columns) >= _ROWS:
            part = _part(part, other, low_a - top, high_a - top, low_b, high_b)
            i, j, size = _longest_in_part(part, other, low_a)
        elif other.plain:
            i, j, size = (_longest_plain if rows <= columns else _longest_from_b)(a, b, low_a, high_a, low_b, high_b)
        else:
            i, j, size = _longest(a, starts, seeds, b, low_a, high_a, low_b, high_b)
        if not size:
            continue
        matched += size
        left, right = min(i - low_a, j - low_b), min(high_a - i, high_b - j) - size
        pieces = [(left, (low_a, i, low_b, j, part, low_a)), (right, (i + size, high_a, j + size, high_b, part, low_a))]
        # the one with more room comes up first, as it tells most of what is out of reach
        for room, piece in pieces if left <= right else pieces[::-1]:
            if room == 1 and other.plain:
                one_a, one_b = a[piece[0] : piece[1]], b[piece[2] : piece[3]]
                matched += one_a in one_b or one_b in one_a
            elif room > 0:
                ranges.append(piece)
                possible += room
        if floor > 0.0 and 2.0 * (matched + possible) / total < floor:
            return None
    return 2.0 * matched / total


#: Buckets that characters and runs of two to four of them are hashed to; collisions only raise a bound.
_CHARS, _RUNS, _RUN = 128, 4096, (2, 3, 4)


def _run_keys(code: np.ndarray, n: int) -> np.ndarray:
    return sum(code[i : len(code) - n + 1 + i] * 31**i for i in range(n)) % _RUNS


class Bounds:
    """Counts of several texts' characters, and which runs they hold: upper bounds of all their ratios follow at once."""

    def __init__(self, texts: list[str], others: list[Prepared] | None = None):
        self.length = np.array([len(t) for t in texts])
        self.chars = np.zeros((len(texts), _CHARS), np.int32)
        self.codes = [np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) for text in texts]
        self.runs = {n: np.zeros((len(texts), _RUNS), bool) for n in _RUN}
        self.others = others or []
        for row, code in enumerate(self.codes):
            self.chars[row] = np.bincount(code % _CHARS, minlength=_CHARS)
            for n in _RUN:
                if len(code) >= n and not others:
                    self.runs[n][row, _run_keys(code, n)] = True

    def _covered(self, code: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """How many places of a long text may lie in blocks common to it and each of these texts.

        A block holds a rare character, but for one at the very beginning of both. So its places are a rare character that
        a text has, or runs of two or three with such a character that it has, or lie in a stretch of its runs of four.
        """
        at = (self.chars[:, code % _CHARS] > 0) & rare
        covered = at.copy()
        covered[:, :3] = True
        for n in _RUN:
            size = len(code) - n + 1
            held = self.runs[n][:, _run_keys(code, n)]
            with_rare = at[:, :size].copy()
            for i in range(1, n):
                with_rare |= at[:, i : i + size]
            if n == _RUN[-1]:
                with_rare[:, 0] = True
                # one place between the texts, so that stretches end with theirs
                flat = np.zeros((len(held), size + 1), bool)
                flat[:, 1:] = held
                stretch = np.cumsum(flat.ravel()[1:] > flat.ravel()[:-1])
                stretch = np.append(0, stretch).reshape(flat.shape)[:, 1:]
                reached = np.zeros(stretch[-1, -1] + 1, bool)
                reached[stretch[held & with_rare]] = True
                runs = held & reached[stretch]
            else:
                runs = held & with_rare
            for i in range(n):
                covered[:, i : i + size] |= runs
        return covered.sum(axis=1)

    def to(self, openings: Bounds):
        """Upper bounds of the ratios of these texts (rows) with prepared ``openings`` (columns): matched characters are
        common to both texts, and in a long opening they lie in its places that blocks can cover."""
        out = np.ones((len(self.length), len(openings.length)))
        for j, other in enumerate(openings.others):
            most = np.minimum(self.chars, openings.chars[j]).sum(axis=1, dtype=np.int64)
            if not other.plain:
                rare = np.array([ch in other.places for ch in other.text])
                most = np.minimum(most, self._covered(openings.codes[j], rare))
            total = self.length + openings.length[j]
            out[:, j] = np.where(total > 0, 2.0 * most / np.maximum(total, 1), 1.0)
        return out
