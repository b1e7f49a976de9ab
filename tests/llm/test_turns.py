from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import opskpi.llm.turns as turns
from opskpi.llm.turns import BEGUN, FORCED, TRUNCATED, chain, damage_and_repair, forward, repair, solve

LEGAL = {"su", "ua", "au"}


def cheapest(codes):
    """Every state's least (cost, audit, roles) row by row; ties by the audit."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}      # what may follow the last role

    def closed(states):
        todo = list(states.items())
        while todo:
            at, (cost, audit, out) = todo.pop()
            to, new = step[at], (cost + 2, audit + "I", out + [(None, step[at])])
            if to not in states or new[:2] < states[to][:2]:
                states[to] = new
                todo.append((to, new))
        return states

    states = {"": (0, "", [])}
    for i, (role, forced, cut) in enumerate(codes):
        now = {}
        for at, (cost, audit, out) in closed(dict(states)).items():
            edits = [(3, "D", at, out)]
            if not forced:
                edits.append((2 + cut, "R", step[at], out + [(i, step[at])]))
                if role == step[at] or (role == "s" and at == ""):
                    edits.append((cut, "K", role, out + [(i, None)]))
            for c, e, to, o in edits:
                new = (cost + c, audit + e, o)
                if to not in now or new[:2] < now[to][:2]:
                    now[to] = new
        states = now
    return min((v for k, v in closed(dict(states)).items() if k in ("", "a")), key=lambda v: v[:2])


def brute(rows, damaged=True):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        own = convs[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))
        seen, codes, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = ("blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen
                     else "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
            if fault:
                count[fault] += 1
            codes.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit, made = cheapest(codes)
        names = {"u": "user", "a": "assistant"}
        lines = [f"{names[new] if new else own[i][1]}:{own[i][2] if i is not None else ''}" for i, new in made]
        known = [t for t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(codes, codes[1:]))
        out.append((conv, gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def table(spark, rows):
    return spark.createDataFrame([(*r, "?", 0) for r in rows],
                                 "conv_id long, turn long, role string, text string, rid string, code int").repartition(3)


def run(spark, rows):
    return sorted((tuple(r[c] for c in COLUMNS) for r in damage_and_repair(table(spark, rows)).collect()), key=str)


def talk(seed, convs, longest):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "well", "Why? ", "one two.\n", "half a", "", " \t", "É."]
    out = []
    for c in range(convs):
        for t in range(r.randint(1, longest)):
            out.append((r.choice([c, c, c, None]), r.choice([t, t, t, t + 1, None]),
                        r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]),
                        r.choice(texts + [f"n{t} {c}.", f"m{t}!", None])))
    return out


def test_brute_force(spark):
    rows = talk(1, 60, 12)
    assert run(spark, rows) == brute(rows)


def test_long_conversations_cross_segments(spark, monkeypatch):
    monkeypatch.setattr(turns, "SEGMENT", 7)
    rows = [(i % 2, i, ["user", "assistant", "system", "x"][(i * i) % 7 % 4], f"t{i % 90}{'.' if i % 5 else ''}") for i in range(400)]
    rows += talk(5, 10, 30)
    assert run(spark, rows) == brute(rows)


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in damage_and_repair(df).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("seed", range(40))
def test_divide_and_conquer_is_audit_least(seed):
    r = random.Random(seed)
    roles = [("", 0), ("s", 1), ("u", 2), ("a", 3)]
    picks = [(r.choice(roles), r.random() < 0.2, r.random() < 0.3) for _ in range(r.randint(0, 40))]
    codes = bytes(k | (FORCED if f else TRUNCATED if c else 0) for (_, k), f, c in picks)
    want = cheapest([(n, f, c and not f) for (n, _), f, c in picks])
    assert solve(codes, BEGUN, None) == (want[1], want[0])
    # cut into segments, joined by their matrices
    if len(codes) > 3:
        cuts = sorted({0, len(codes), *r.sample(range(1, len(codes)), 3)})
        parts = [codes[a:b] for a, b in zip(cuts, cuts[1:])]
        both = [[forward(p, s) for s in range(4)] for p in parts]
        states = chain(np.asarray([[c for c, _ in m] for m in both]), np.asarray([[k for _, k in m] for m in both]))
        solved = [solve(p, a, b) for p, a, b in zip(parts, states, [*states[1:], None])]
        assert ("".join(a for a, _ in solved), sum(c for _, c in solved)) == (want[1], want[0])


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "tool", "4"), (2, None, "assistant", "Yes.")]
    done = repair(table(spark, rows))
    got = [tuple(r[c] for c in ("conv_id", "edit", "fault", "role", "text"))
           for r in done.rows.orderBy("conv_id", "rid", "place").collect()]
    assert got == [(1, "K", None, "system", "Be brief."), (1, "K", None, "user", "Hi."), (1, "D", "duplicate", None, None),
                   (1, "R", "truncated", "assistant", "4"), (2, "I", None, "user", ""), (2, "K", None, "assistant", "Yes.")]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert damage_and_repair(empty).collect() == [] and repair(empty).rows.collect() == []
    gone = next((c, t) for c in range(9) for t in range(99) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    assert run(spark, [(*gone, "user", "x")]) == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_far_turns(spark):
    rows = [(1, -2 ** 63, "user", "a."), (1, 2 ** 63 - 1, "assistant", "b.")]
    assert repair(table(spark, rows)).conversations.first()["gaps"] == 2 ** 63 - 1
