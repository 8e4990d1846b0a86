"""Periodic runs against a brute-force search, and grammar extensions against letter-by-letter ones."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewise.llm import queries, recompression
from ratewise.llm.common import table

SF = "/root/testdata/sf0.001"


def brute_runs(w):
    """Maximal stretches of 12 words and two periods at least: for each period all stretches, then the smallest period of each."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        s = 0
        while s + p < len(w):
            e = s
            while e + p < len(w) and w[e] == w[e + p]:
                e += 1
            if e + p - s >= max(12, 2 * p):
                found.setdefault((s, e + p - s), p)
            s = e + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def kept(w, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return [x for k, x in enumerate(w) if k not in gone]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def texts():
    r = random.Random(8)
    out = [[], ["x"], ["x"] * 11, ["x"] * 12, ["x"] * 500, list("ab" * 300), list("ab" * 6 + "a"), fibonacci(700), list("abcabcabcabcx" * 20)]
    for k in range(60):
        w = [r.choice("abcdefgh"[: r.randint(1, 8)]) for _ in range(r.randint(1, 120))]
        for _ in range(r.randint(0, 4)):
            p = r.randint(1, 20)
            s = r.randint(0, len(w))
            unit = [r.choice("abcxyz") for _ in range(p)]
            w[s:s] = (unit * 20)[: r.randint(p, 5 * p + 8)]
        out.append(w)
    return out


def test_extensions_match_brute_force():
    r = random.Random(2)
    rows = [t for t in texts() if t]
    parts, top = [np.array([100])], 100
    for k, t in enumerate(rows):
        parts += [np.array([ord(c) % 100 for c in t]), np.array([101 + k])]
    sym = np.concatenate(parts).astype(np.int64)
    _, sym = np.unique(sym, return_inverse=True)
    levels = recompression.grammar(sym.astype(np.int64), len(rows) + 1)
    a = np.array([r.randrange(len(sym)) for _ in range(4000)])
    b = np.array([r.randrange(len(sym)) for _ in range(4000)])
    a, b = a[a != b], b[a != b]
    for view in (levels, recompression.backwards(levels)):
        flat = view[0].sym.tolist()
        want = []
        for x, y in zip(a.tolist(), b.tolist()):
            n = 0
            while max(x, y) + n < len(flat) and flat[x + n] == flat[y + n]:
                n += 1
            want.append(n)
        assert recompression.extensions(view, a, b).tolist() == want
    assert len(levels[-1].sym) <= 2 * len(rows) + 1  # every text is one symbol


@pytest.mark.parametrize("together,grid", [(1, 1 << 21), (70, 1 << 21), (70, 50)])
def test_runs_match_brute_force(monkeypatch, together, grid):
    monkeypatch.setattr(recompression, "GRID", grid)
    rows = texts()
    for k in range(0, len(rows), together):
        some = rows[k:k + together]
        got = recompression.runs_of([np.array([ord(c) for c in t], np.int64) for t in some])
        for t, g in zip(some, got):
            assert [tuple(x) for x in g.tolist()] == brute_runs(t)
            assert [c for c, keep in zip(t, recompression.kept_words(len(t), g)) if keep] == kept(t, brute_runs(t))


def test_collapse_on_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b\tc\r\nd"), (None, "x " * 12), (None, None), (4, "a b\tc\r\nd"), (5, "é 漢 " * 40 + "end"),
            (6, " ".join(f"w{i % 1000}" for i in range(150_000))), (7, "a b " * 30)]
    d = spark.createDataFrame([(i, t, "r", "c", 3) for i, t in rows], "doc_id long, text string, runs string, collapsed string, n_words int")
    got = recompression.collapse_runs(d).collect()
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = [(0, 150_000, 1000)] if i == 6 else brute_runs(w)
        want.append((i, len(w), runs, " ".join(kept(w, runs))))
    assert sorted([(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got], key=repr) == sorted(want, key=repr)
    assert recompression.collapse_runs(d.limit(0)).count() == 0


def test_query_matches_brute_force(spark):
    docs = table(spark, SF, "documents").where(F.length("text") < 6000)
    extra = spark.createDataFrame([(None, "a " * 30), (80, None), (99, "z " * 13)], "doc_id long, text string")
    given = docs.select("doc_id", "text").unionByName(extra)
    planted = {(r.doc_id, r.text) for r in queries.with_planted_runs(given).collect()}
    want = set()
    for r in given.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        h = None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode())
        if h is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want.add((r.doc_id, " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))))
        else:
            want.add((r.doc_id, r.text))
    assert planted == want
    found = {r.doc_id: r for r in queries.op11_recompression(spark, SF).collect()}
    for i, text in planted:
        if i is None or i in (80, 99):
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = brute_runs(w)
        top = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        got = found[i]
        assert (got.n_runs, got.start, got.length, got.period) == (len(runs), *top)
        assert got.exponent_milli == (None if top[1] is None else 1000 * top[1] // top[2])
        assert got.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert got.collapsed_sha256 == hashlib.sha256(" ".join(kept(w, runs)).encode()).hexdigest()
    assert sum(r.n_runs > 0 for r in found.values()) > 10
