import hashlib
import random
import re
import zlib

import pytest

from corpusloom.llm import conversation_repair
from test_audits import brute

SOUND = re.compile(r"[^\x20\x09-\x0D]")
COLUMNS = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def expected(rows):
    """Report and repaired lines of one conversation's ordered (turn, role, text) rows."""
    seen, marked, counts = set(), [], [0, 0, 0, 0]
    for _, role, text in rows:
        last = SOUND.findall(text)
        fault = 1 if not last else 2 if (role, text) in seen else 3 if last[-1] not in ".!?" else 0
        seen.add((role, text))
        counts[fault] += 1
        marked.append((role[:1] if role[:1] and role[:1] in "sua" else "x", fault))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    cost, audit = brute(marked)
    lines, ending, at = [], "", 0
    for edit in audit:
        nxt = {"": "user", "s": "user", "a": "user", "u": "assistant"}[ending]
        if edit != "I":
            _, role, text = rows[at]
            at += 1
        if edit == "D":
            continue
        role, text = (nxt, "") if edit == "I" else (nxt, text) if edit == "R" else (role, text)
        lines.append(f"{role}:{text}")
        ending = role[0]
    return (gaps, *counts[1:], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def conversations(seed, n):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "What?", "cut off", "", " \t\n", "One. two", "end.  \n", "É.", None, "x" * 50_000 + "."]
    out = []
    for conv in range(n):
        turn = 0
        for k in range(r.randint(0, 6)):
            turn += r.choice([1, 1, 1, 2])
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "uncle", ""]) if r.random() < 0.4 else ("user", "assistant")[k % 2]
            out.append((conv, None if r.random() < 0.05 else turn, role, f"{k}" + "w" * r.randint(1, 9) + "." if r.random() < 0.7 else r.choice(texts)))
    return out


def grouped(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, role, text))
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, v in out.items()}


def test_repair_equals_brute_force(spark):
    rows = conversations(1, 120)
    rows += rows[:3] + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes.")]
    table = spark.createDataFrame([(*x, 1, 2, "p") for x in rows], COLUMNS + ", block int, at int, place string")
    report, repaired = conversation_repair.repair(table)
    found = {x.conv_id: tuple(x)[1:] for x in report.collect()}
    lines = {}
    for x in sorted(repaired.collect(), key=lambda x: x.place):
        lines.setdefault(x.conv_id, []).append(f"{x.role}:{x.text}")
    hashed = {x.conv_id: x.repaired_sha256 for x in conversation_repair.digests(repaired).collect()}
    plain = grouped([(c, t, r or "", s or "") for c, t, r, s in rows])
    assert found.keys() == plain.keys()
    for conv, own in plain.items():
        want, want_lines = expected(own)
        assert (*found[conv], hashed.get(conv, EMPTY)) == want
        assert lines.get(conv, []) == want_lines


def test_one_conversation_over_many_blocks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(7, k, ("user", "assistant")[k % 2], f"Line {k}.") for k in range(3000) if k not in (1000, 2001)]
    table = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert conversation_repair.in_order(table).select("block").distinct().count() > 1
    report, repaired = conversation_repair.repair(table)
    # the cheapest: turn 1001 doesn't follow 999's kind, and so on; one edit each
    row = report.first()
    assert (row.gaps, row.illegal, row.cost, len(row.audit)) == (2, 2, 4, 2998) and row.audit.count("D") == 2
    assert repaired.count() == 2996
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty_table(spark):
    report, repaired = conversation_repair.repair(spark.createDataFrame([], COLUMNS))
    assert (report.count(), repaired.count(), conversation_repair.digests(repaired).count()) == (0, 0, 0)


@pytest.mark.parametrize("seed", [2])
def test_query(spark, tmp_path, seed):
    from corpusloom.llm.queries import QUERIES

    rows = conversations(seed, 150) + [(None, None, None, None), (None, 3, "user", "Why?")]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/conversations.parquet")
    found = {x.conv_id: tuple(x)[1:] for x in QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    damaged = []
    for conv, turn, role, text in rows:
        blank = lambda x: " " if x is None else str(x)
        h = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        damaged += [] if h == 0 else [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    plain = grouped(damaged)
    want = {c: expected(plain[c])[0] if c in plain else (0,) * 6 + ("", EMPTY) for c, *_ in rows}
    assert found == want
