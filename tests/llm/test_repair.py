"""Conversation repair against an exhaustive search."""

import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from lurewatch.llm import repair

sys.setrecursionlimit(20_000)      # the search below is recursive
SPACE = "[\x20\x09-\x0D]"


def _damaged(rows):
    for c, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(c, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def _least(rows):
    """(cost, audit) over all edits, by exhaustive search; rows are (initial, must go, truncated)."""
    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "")] if i == len(rows) and state in (0, 3) else []
        if inserted < 3:
            c, a = best(i, 3 if state == 2 else 2, inserted + 1)
            found.append((c + 2, "I" + a))
        if i < len(rows):
            initial, gone, cut = rows[i]
            c, a = best(i + 1, state, 0)
            found.append((c + 3, "D" + a))
            if not gone:
                to = 3 if state == 2 else 2
                c, a = best(i + 1, to, 0)
                found.append((c + 2 + cut, "R" + a))
                if initial == ("a" if state == 2 else "u"):
                    found.append((c + cut, "K" + a))
                if initial == "s" and state == 0:
                    c, a = best(i + 1, 1, 0)
                    found.append((c + cut, "K" + a))
        return min(found, default=(10**6, ""))
    return best(0, 0, 0)


def _report(rows):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, digest)} of damaged rows."""
    by = defaultdict(list)
    for c, *rest in rows:
        by[c].append(rest)
    out = {}
    for c, v in by.items():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in v if r[0] is not None]
        seen, faults, coded = set(), [], []
        for _, role, text in v:
            solid = re.sub(SPACE, "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
            coded.append((role[:1], faults[-1] in ("blank", "duplicate"), int(faults[-1] == "truncated")))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(v, v[1:]))
        cost, audit = _least(tuple(coded))
        state, i, lines = 0, 0, []
        for e in audit:
            to = ("assistant", 3) if state == 2 else ("user", 2)
            if e in "IR":
                lines.append(f"{to[0]}:{'' if e == 'I' else v[i][2]}")
                state = to[1]
            elif e == "K":
                lines.append(f"{v[i][1]}:{v[i][2]}")
                state = 1 if v[i][1][:1] == "s" else to[1]
            i += e != "I"
        assert i == len(v) and re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines))
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                  illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _rows():
    rng = random.Random(4)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "u", "super"], ["Yes.", "No!", "why?  ", "cut off", "", " \n", None, "É.", "a.\x0b", "x. y"]
    rows = [(c, rng.choice([t, t, t + 5, None]), rng.choice(roles if c % 3 else roles[:3]), f"{rng.choice(texts) or ''}" if rng.random() < .9 else None)
            for c in range(60) for t in range(c % 13)]
    rows += [(None, 1, "user", "lost."), (None, None, "user", "lost."), (500, 3, "assistant", "alone."), (-7, 1, "system", "s."), (-7, 1, "system", "s.")]
    rows += [(600, t, rng.choice(roles[:4]), f"turn {t % 90}{rng.choice('.! ')}") for t in range(300)]      # spans partitions
    return rows + [r for r in rows if r[0] in (5, 8)]


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, cost int, sha string")


def _got(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.mark.parametrize("spread", [False, True])
def test_damage_report(spark, spread):
    rows = _rows()
    if spread:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        want = _report(_damaged(rows))
        nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        assert _got(repair.damage_report(_frame(spark, rows))) == {**{r[0]: nothing for r in rows}, **want}
        assert repair.damage_report(_frame(spark, rows).limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_registered_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = _got(repair.op13_structure_repair(spark, sf))
    want = _report(_damaged(rows))
    assert {c: got[c] for c in want} == want and set(got) == {r[0] for r in rows}


def test_turns_and_audits_agree(spark):
    df = _frame(spark, _rows())
    turns = defaultdict(list)
    for r in repair.repaired_turns(df).collect():
        turns[r.conv_id].append(((r.part, r.seq, r.step), r.edit, r.role, r.text))
    audits = {r.conv_id: (r.audit, r.repaired_sha256) for r in repair.conversation_audits(df).collect()}
    assert set(turns) == set(audits)
    for c, v in turns.items():
        v.sort()
        lines = [f"{role}:{text}" for _, e, role, text in v if e != "D"]
        assert ("".join(e for _, e, _, _ in v), hashlib.sha256("\n".join(lines).encode()).hexdigest()) == audits[c]


def test_divide_and_conquer_finds_the_least_audit():
    rng = random.Random(9)
    for n in [0, 1, 2, 7, 8, 9, 17, 40, 90] * 6:
        codes = bytearray(rng.randrange(8) for _ in range(n))
        vector, cost = repair.from_state(codes, 0, n, 0)
        end = repair.best_end(vector, repair.END)
        audit = "".join(repair.AUDIT[e] for e in repair.edits_between(codes, 0, end)) + "I" * len(repair.TAIL[end])
        want = _least(tuple(("sua-"[c // 2], False, c % 2) for c in codes))
        assert (cost + vector[end][0] + repair.END[end], audit) == want
