import itertools
import random

import pytest

from corpusloom.llm import audits
from corpusloom.llm.audits import Audits, Repair


def brute(rows):
    """The least (cost, audit) over all ways of editing, inserting at most twice in one place."""
    best = None

    def walk(at, ending, inserted, cost, edits):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if at == len(rows) and ending in ("", "a"):
            found = (cost, "".join(edits))
            best = found if best is None else min(best, found)
        if inserted < 2:
            walk(at, "a" if ending == "u" else "u", inserted + 1, cost + 5, edits + ["I"])
        if at == len(rows):
            return
        initial, fault = rows[at]
        walk(at + 1, ending, 0, cost + 2, edits + ["D"])
        if fault in (1, 2):
            return
        more = 5 if fault == 3 else 0
        nxt = "a" if ending == "u" else "u"
        if initial == "s" and ending == "":
            walk(at + 1, "s", 0, cost + more, edits + ["K"])
        if initial == nxt:
            walk(at + 1, nxt, 0, cost + more, edits + ["K"])
        walk(at + 1, nxt, 0, cost + more + 1, edits + ["R"])

    walk(0, "", 0, 0, [])
    return best


def code(rows):
    return "".join(chr(65 + 4 * "suax".index(i) + f) for i, f in rows)


@pytest.mark.parametrize("size", [0, 1, 2])
def test_all_short_conversations(size):
    for rows in itertools.product(itertools.product("suax", range(4)), repeat=size):
        assert audits.audit(code(rows))[1:3] == brute(list(rows))


def test_random_conversations():
    r = random.Random(1)
    for _ in range(1500):
        rows = [(r.choice("suuaax"), r.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(r.randint(3, 8))]
        assert audits.audit(code(rows))[1:3] == brute(rows)


def test_settled_prefixes_change_nothing(monkeypatch):
    r = random.Random(2)
    long = [code([(r.choice("suaax"), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]) for n in (50, 400, 3000)]
    long += ["E" * 2000, "EI" * 1000, "IE" * 1000, "H" * 500]
    want = [audits.audit(c) for c in long]
    monkeypatch.setattr(Repair, "SETTLE", 20)
    assert [audits.audit(c) for c in long] == want


def test_very_long_conversation_is_kept_in_small_memory():
    repair = Repair()
    for _ in range(60_000):
        repair.turn(1, 0)
        repair.turn(2, 0)
        assert len(repair.audits.edit) < 3 * Repair.SETTLE
    assert repair.done() == (0, "K" * 120_000)


def test_strings_compare_like_text():
    r = random.Random(3)
    tree, texts = Audits(), [""]
    for _ in range(400):
        node, edit = r.randrange(len(texts)), r.choice("DIKR")
        texts.append(texts[node] + edit)
        assert tree.grown(node, edit) == len(texts) - 1 and tree.text(len(texts) - 1) == texts[-1]
    for _ in range(5000):
        a, b = r.randrange(len(texts)), r.randrange(len(texts))
        assert tree.less(a, b) == (texts[a] < texts[b])


def test_collisions_of_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(audits, "PRIME", 3)  # nearly all strings collide
    r = random.Random(4)
    for _ in range(300):
        rows = [(r.choice("suuaax"), r.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(r.randint(3, 7))]
        assert audits.audit(code(rows))[1:3] == brute(rows)


def test_roles_and_illegal_pairs():
    # user, user, other, then nothing: keep, rerole, rerole, insert
    illegal, cost, edits, set_ = audits.audit(code([("s", 0), ("u", 0), ("u", 0), ("a", 0)]))
    assert (illegal, cost, edits, set_) == (1, 2, "KDKK", "    ")
    assert audits.audit(code([("u", 3), ("a", 0)])) == (0, 4, "DD", "  ")
    assert audits.audit(code([("u", 0), ("u", 0)]))[1:] == (1, "KR", " a")
    assert audits.audit("") == (0, 0, "", "")
