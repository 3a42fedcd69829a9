"""Cheapest edits that make a conversation well-formed, found by dynamic programming over persistent audits.

An audit is a string of edits: K keep, R rerole, D delete, I insert. Audits that share a prefix share its nodes: each node
has the last edit, its place, a rolling hash of the whole string, and binary-lifting ancestors. Of two audits of equal
cost the one that is least in ASCII stays: a search for the longest common prefix climbs both by powers of two while
their hashes differ, and prefixes of equal hash are verified edit by edit where they aren't the same nodes.
"""

from __future__ import annotations

#: A turn's code is one character: 4 * (initial: s, u, a or other) + fault, from "A" on.
INITIALS = "sua"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Costs of the edits, and of a truncated turn that stays.
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
LEFT_TRUNCATED = 5

#: What the repaired turns end in so far: nothing, a system turn, a user turn, an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What a user or assistant turn may follow.
BEFORE = {USER: (NOTHING, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
NEXT = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}

PRIME, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51


class Audits:
    """A tree of strings; a string is the number of its last node, 0 the empty one."""

    def __init__(self):
        self.edit, self.size, self.hash, self.up = [""], [0], [0], [()]

    def grown(self, node: int, edit: str) -> int:
        """The string of ``node`` with one more edit."""
        up = [node]
        while len(self.up[up[-1]]) >= len(up):
            up.append(self.up[up[-1]][len(up) - 1])
        self.edit.append(edit)
        self.size.append(self.size[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(edit)) % PRIME)
        self.up.append(tuple(up))
        return len(self.edit) - 1

    def cut(self, node: int, size: int) -> int:
        """The prefix of ``size`` edits."""
        while self.size[node] > size:
            node = self.up[node][(self.size[node] - size).bit_length() - 1]
        return node

    def equal(self, a: int, b: int) -> bool:
        """Whether two strings of one size are the same: hashes first, then edits up to the node they share."""
        if self.hash[a] != self.hash[b]:
            return False
        while a != b:
            if self.edit[a] != self.edit[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` comes before that of ``b`` in ASCII order (a prefix before what it begins)."""
        size = min(self.size[a], self.size[b])
        x, y = self.cut(a, size), self.cut(b, size)
        if self.equal(x, y):
            return self.size[a] < self.size[b]
        k = len(self.up[x]) - 1
        while k >= 0:  # to the first place where they differ
            if k < len(self.up[x]) and not self.equal(self.up[x][k], self.up[y][k]):
                x, y = self.up[x][k], self.up[y][k]
            k -= 1
        return self.edit[x] < self.edit[y]

    def text(self, node: int, after: int = 0) -> str:
        """The edits of a string beyond its first ``after``."""
        out = []
        while self.size[node] > after:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))


class Repair:
    """The cheapest audits of the turns met so far, one for each ending, the least in ASCII of those that cost the same."""

    #: Nodes after which what all audits begin with is written out and forgotten.
    SETTLE = 1 << 14

    def __init__(self):
        self.audits, self.best, self.settled, self.limit = Audits(), {NOTHING: (0, 0)}, [], self.SETTLE
        self._insert()

    def _offer(self, best: dict, ending: int, cost: int, node: int, edit: str) -> None:
        held = best.get(ending)
        if held is None or cost <= held[0]:
            new = self.audits.grown(node, edit)
            if held is None or cost < held[0] or self.audits.less(new, held[1]):
                best[ending] = (cost, new)

    def _insert(self) -> None:
        for ending, froms in BEFORE.items():
            for before in froms:
                if before in self.best:
                    cost, node = self.best[before]
                    self._offer(self.best, ending, cost + COST["I"], node, "I")

    def turn(self, initial: int, fault: int) -> None:
        """Meet the next turn."""
        best: dict = {}
        for ending, (cost, node) in self.best.items():
            self._offer(best, ending, cost + COST["D"], node, "D")
            if fault in (BLANK, DUPLICATE):
                continue
            stay = cost + (LEFT_TRUNCATED if fault == TRUNCATED else 0)
            if initial == 0 and ending == NOTHING:
                self._offer(best, SYSTEM, stay, node, "K")
            if initial == NEXT[ending] - 1:
                self._offer(best, NEXT[ending], stay, node, "K")
            else:
                self._offer(best, NEXT[ending], stay + COST["R"], node, "R")
        self.best = best
        self._insert()
        self._drop()
        if len(self.audits.edit) > self.limit:
            self._settle()

    def _drop(self) -> None:
        """Forget endings from which no rest can be cheaper than the same rest from a better one (see the tests)."""
        cost = {ending: c for ending, (c, _) in self.best.items()}
        user, assistant = cost[USER], cost[ASSISTANT]
        for ending, more in ((NOTHING, COST["D"]), (SYSTEM, 0)):
            if ending in cost and cost[ending] > min(assistant, user + COST["I"]) + more:
                del self.best[ending]

    def _settle(self) -> None:
        old = self.audits
        nodes = [node for _, node in self.best.values()]
        size = min(old.size[n] for n in nodes)
        low = 0
        while low < size:  # the longest prefix that all share
            middle = (low + size + 1) // 2
            cuts = [old.cut(n, middle) for n in nodes]
            low, size = (middle, size) if all(old.equal(cuts[0], c) for c in cuts[1:]) else (low, middle - 1)
        self.settled.append(old.text(old.cut(nodes[0], low)))
        self.audits = Audits()
        again = {0: 0}  # old node: new node
        again[old.cut(nodes[0], low)] = 0
        for ending, (cost, node) in self.best.items():
            chain = []
            while old.size[node] > low and node not in again:
                chain.append(node)
                node = old.up[node][0]
            new = again.get(node, 0)
            for n in reversed(chain):
                new = again[n] = self.audits.grown(new, old.edit[n])
            self.best[ending] = (cost, new)
        self.limit = max(self.SETTLE, 4 * len(self.audits.edit))

    def done(self) -> tuple[int, str]:
        """Cost and audit of what is well-formed as a whole: no turn at all, or one that ends with an assistant turn."""
        cost, node = self.best[ASSISTANT]
        if NOTHING in self.best:
            other, empty = self.best[NOTHING]
            if other < cost or other == cost and self.audits.less(empty, node):
                cost, node = other, empty
        return cost, "".join(self.settled) + self.audits.text(node)


def audit(codes: str) -> tuple[int, int, str, str]:
    """Of a conversation's codes: adjacent turns that may not follow each other, cost, audit, and roles.

    ``roles`` has for each edit the initial of the repaired turn: u or a where the edit sets it, a blank where the
    turn keeps its own role or is deleted.
    """
    repair = Repair()
    illegal, last = 0, None
    for code in codes:
        initial, fault = divmod(ord(code) - 65, 4)
        illegal += last is not None and (last, initial) not in ((0, 1), (1, 2), (2, 1))
        last = initial
        repair.turn(initial, fault)
    cost, edits = repair.done()
    return illegal, cost, edits, roles(codes, edits)


def roles(codes: str, edits: str) -> str:
    """The role that each edit sets."""
    ending, at, out = NOTHING, 0, []
    for edit in edits:
        own = (ord(codes[at]) - 65) // 4 if edit != "I" else None
        at += edit != "I"
        if edit == "D" or edit == "K" and own == 0:
            ending = SYSTEM if edit == "K" else ending
            out.append(" ")
            continue
        ending = NEXT[ending]
        out.append(" " if edit == "K" else "ua"[ending - USER])
    return "".join(out)
