"""Repairs of conversations against a shortest path over all edits, written apart from the search."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from pixelweft.llm import conversations as C
from pixelweft.llm import queries

BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")


def rule(rows):
    """(role, text) in order to (blank, duplicate, truncated, illegal, cost, audit, repaired rows)."""
    seen, faults = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    names = {"u": "user", "a": "assistant"}
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, last, out = heapq.heappop(queue)
        if i == len(rows) and last in ("", "a"):
            break
        if (i, last) in done:
            continue
        done.add((i, last))
        for x in "ua":
            if x in after[last]:
                heapq.heappush(queue, (cost + 3, audit + "I", i, x, (*out, (names[x], ""))))
        if i < len(rows):
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, last, out))
            if faults[i] not in ("b", "d"):
                more = 3 * (faults[i] == "t")
                role, text = rows[i]
                if role[:1] and role[:1] in after[last]:
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, role[0], (*out, rows[i])))
                for x in "ua":
                    if x in after[last]:
                        heapq.heappush(queue, (cost + 3 + more, audit + "R", i + 1, x, (*out, (names[x], text))))
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, out


def test_search_against_shortest_paths():
    rng = random.Random(5)
    for _ in range(400):
        rows = [rng.choice((1, 2, 2, 3, 3, 4)) * 4 + rng.choice((0, 0, 0, 0, 1, 2, 3)) for _ in range(rng.randint(0, 14))]
        as_rows = [("suax"[r // 4 - 1], {0: f"{i}.", 1: "", 2: "", 3: f"{i}"}[r % 4]) for i, r in enumerate(rows)]
        want = rule(as_rows)
        assert C.repair(rows) == want[4:6]
        # cut anywhere, the parts give the same
        n = rng.randint(0, len(rows))
        costs, audits = C.joined(C.ways_through(rows[:n]), C.ways_through(rows[n:]))
        assert min((costs[g], audits[g]) for g in (0, 3) if costs[g] >= 0) == want[4:6]


def damage(rows):
    for conv, turn, role, text in rows:
        s = lambda v: " " if v is None else v
        x = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        if x:
            text = "" if x == 1 else re.sub("[.!?]", "", text) if x == 2 else text
            yield from [(conv, turn, "user" if x == 4 else role, text)] * (2 if x == 3 else 1)


def expected(rows):
    convs = {}
    for r in damage(rows):
        convs.setdefault(r[0], []).append(r[1:])
    out = set()
    for conv in {r[0] for r in rows}:
        own = sorted(convs.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        blank, dup, short, illegal, cost, audit, out_rows = rule([r[1:] for r in own])
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out_rows).encode()).hexdigest()
        out.add((conv, gaps, blank, dup, short, illegal, cost, audit, sha))
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query_over_the_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in queries.op13_repair(spark, d).select(*COLUMNS).collect()} == expected(rows)


@pytest.mark.parametrize("span", [C.SPAN, 3])
def test_awkward(spark, tmp_path, monkeypatch, span):
    """Nulls everywhere, empty and long texts, ties of turns, repeated rows, odd roles, a long conversation, extra columns; short stretches too."""
    rng = random.Random(2)
    rows = [(None, 0, "user", "Hi."), (None, None, None, None), (1, None, "user", "a."), (1, 2, None, "b."), (1, 2, "", "c."), (1, 9, "assistant", None)]
    rows += [(2, 5, "tool", "x" * 200_000 + "."), (2, 5, "tool", "y"), (2, 5, "assistant", " 　"), (3, 0, "user", "s."), (3, 0, "user", "s."), (3, 0, "user", "s.")]
    rows += [(4, t, rng.choice(("user", "assistant", "system", "tool")), rng.choice(("a.", "b", "", f"{t}!"))) for t in range(300)]
    rows += [(5 + c, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for c in range(40) for t in range(rng.randint(1, 3))]
    monkeypatch.setattr(C.repair_conversations, "__defaults__", (*C.repair_conversations.__defaults__[:-1], span))
    spark.createDataFrame([(*r, 7, "z") for r in rows], "conv_id long, turn long, role string, text string, fault int, at string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {tuple(r) for r in queries.op13_repair(spark, str(tmp_path)).select(*COLUMNS).collect()} == expected(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (2, 0, "system", "s."), (2, 1, "assistant", ""), (3, 0, "assistant", "")]
    x = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    report, audits, faulty = C.repair_conversations(x)
    want = {(c, i, *r) for c in (1, 2, 3) for i, r in enumerate(rule([r[2:] for r in rows if r[0] == c])[6], 1)}
    assert {(r["conv"], r["place"], r["role"], r["text"]) for r in C.repaired_rows(faulty, audits).collect()} == want
    assert C.repair_conversations(x.limit(0))[0].count() == 0
