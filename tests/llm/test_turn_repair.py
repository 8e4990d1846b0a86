"""Conversation repair against brute force: all edit scripts of short conversations, whole audits carried on longer ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ratewise.llm import queries, turn_repair
from ratewise.llm.common import table

SF = "/root/testdata/sf0.001"
NAMES = {"u": "user", "a": "assistant"}


def best(rows, fault):
    """(cost, audit, turns) of the cheapest edits: for every text of initials so far the least (cost, audit) is carried whole."""
    def inserted(states):
        out = dict(states)
        for _ in range(2):
            for state, (cost, audit, turns) in list(out.items()):
                for c in "ua":
                    to = {"": {"u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(c)
                    if to:
                        out[to] = min(out.get(to, (10**9, "", ())), (cost + 5, audit + "I", turns + ((NAMES[c], ""),)))
        return out

    states = {"": (0, "", ())}
    for (role, text), f in zip(rows, fault):
        now = {}
        for state, (cost, audit, turns) in inserted(states).items():
            ways = [(state, 2, "D", ())]
            if f not in ("blank", "duplicate"):
                extra = 5 if f == "truncated" else 0
                for c in "sua":
                    fits = c in {"": "su", "s": "u", "u": "a", "a": "u"}[state]
                    if fits and role[:1] == c:
                        ways.append((c, extra, "K", ((role, text),)))
                    if fits and c != "s":
                        ways.append((c, 1 + extra, "R", ((NAMES[c], text),)))
            for to, more, letter, made in ways:
                now[to] = min(now.get(to, (10**9, "", ())), (cost + more, audit + letter, turns + made))
        states = now
    ended = inserted(states)
    return min(x for k, x in ended.items() if k in ("", "a"))


def all_scripts(rows, fault):
    found = []
    for edits in itertools.product(*[[(ins, e) for ins in ("", "u", "a", "ua", "au") for e in "DKua"] for _ in rows], *[[("", ""), ("u", ""), ("a", ""), ("ua", ""), ("au", "")]]):
        cost, audit, turns = 0, "", []
        for (ins, e), row, f in itertools.zip_longest(edits, rows, fault):
            for c in ins:
                cost, audit = cost + 5, audit + "I"
                turns.append((NAMES[c], ""))
            if not row:
                continue
            if e == "D":
                cost, audit = cost + 2, audit + "D"
            else:
                if f in ("blank", "duplicate"):
                    break
                cost += (5 if f == "truncated" else 0) + (e != "K")
                audit += "K" if e == "K" else "R"
                turns.append((row[0], row[1]) if e == "K" else (NAMES[e], row[1]))
        else:
            if re.fullmatch("(s?(ua)+)?", "".join(t[0][:1] for t in turns)):
                found.append((cost, audit, tuple(turns)))
    return min(found)


def fault_of(rows):
    out, seen = [], set()
    for role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]+", "", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def expected(conv):
    """``conv``: (turn, role, text) rows of one conversation."""
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in conv), key=lambda v: (v[0], v[1], v[2].encode(), v[3].encode()))
    turns = {t for known, t, _, _ in rows if known}
    rows = [(r, x) for _, _, r, x in rows]
    fault = fault_of(rows)
    cost, audit, made = best(rows, fault)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    text = "\n".join(f"{r}:{x}" for r, x in made)
    return (gaps, *[fault.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def code(role, f):
    c = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return "d" if f in ("blank", "duplicate") else c.upper() if f else c


def sample(r, n):
    return [(r.choice(["user", "assistant", "system", "tool", "user", "assistant"]), r.choice(["Hi there.", "cut", "", "What?", f"t{r.random()}.", f"t{r.random()}"])) for _ in range(n)]


def test_least_scripts_are_the_least_of_all():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 3):
        for _ in range(6):
            rows = sample(r, n)
            assert best(rows, fault_of(rows)) == all_scripts(rows, fault_of(rows))


def test_hirschberg_and_summaries_match():
    r = random.Random(5)
    for _ in range(300):
        rows = sample(r, r.randint(1, 40))
        fault = fault_of(rows)
        codes = "".join(code(role, f) for (role, _), f in zip(rows, fault))
        cost, audit, _ = best(rows, fault)
        end = turn_repair.last_state(turn_repair.forward(codes, turn_repair.only(0)))
        assert "".join(turn_repair.audits(codes, 0, end)) + "I" * turn_repair.TRAIL[end] == audit
        cut = r.randint(0, len(codes))
        whole = turn_repair.joined(turn_repair.summary(codes[:cut]), turn_repair.summary(codes[cut:]))
        assert whole == turn_repair.summary(codes) and whole[end] + 5 * turn_repair.TRAIL[end] == cost


def conversations(r):
    out = []
    for conv in [1, 2, 3, 4, 5, 6, None, 9]:
        n = {2: 1, 3: 150, 6: 0}.get(conv, 9)
        out += [(conv, None if r.random() < 0.05 else t + (t > 6), *x) for t, x in enumerate(sample(r, n))]
    out += [(4, 2, None, "null role."), (4, 3, "user", None), (4, 3, "user", None), (5, 1, "", "no role."), (7, 0, "user", ""), (8, None, "user", "a."), (8, None, "assistant", "b."), (9, 3, "user", "long " * 50_000 + ".")]
    return out


@pytest.mark.parametrize("block_rows", [3, 4096])
def test_repair_matches_brute_force(spark, block_rows):
    rows = conversations(random.Random(3))
    d = spark.createDataFrame([(*x, "p", "e") for x in rows], "conv_id long, turn long, role string, text string, pos string, edit string")
    marked, turns = turn_repair.repair(d, block_rows)
    told = {r.conv_id: tuple(r)[1:] for r in turn_repair.reports(marked).collect()}
    digest = {r.conv_id: tuple(r)[1:] for r in turn_repair.digests(marked, turns).collect()}
    by = {}
    for c, *row in rows:
        by.setdefault(c, []).append(row)
    assert set(told) == set(digest) == set(by)
    for c, conv in by.items():
        assert told[c] + digest[c] == expected(conv), c
    empty = turn_repair.repair(d.limit(0), block_rows)
    assert empty[0].count() == empty[1].count() == turn_repair.reports(empty[0]).count() == turn_repair.digests(*empty).count() == 0


def test_query_matches_brute_force(spark):
    given = table(spark, SF, "conversations").collect()
    found = {r.conv_id: tuple(r)[1:] for r in queries.op12_turn_repair(spark, SF).collect()}
    by = {r.conv_id: [] for r in given}
    for r in given:
        d = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", r.text) if d == 2 else r.text
        if d:
            by[r.conv_id] += [(r.turn, "user" if d == 4 else r.role, text)] * (2 if d == 3 else 1)
    assert set(found) == set(by)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert all(found[c] == (expected(conv) if conv else nothing) for c, conv in by.items())


def test_damage_of_nulls(spark):
    d = spark.createDataFrame([(None, t, None, None) for t in range(40)] + [(1, None, "user", "x.")], "conv_id long, turn long, role string, text string")
    got = queries.damaged(d).where("conv_id IS NULL").collect()
    n = {t: zlib.crc32(f" :{t}".encode()) % 20 for t in range(40)}
    assert len(got) == sum(0 if k == 0 else 2 if k == 3 else 1 for k in n.values())
    assert all(r.text == ("" if n[r.turn] == 1 else " ") and r.role == ("user" if n[r.turn] == 4 else " ") for r in got)
