"""Winnowing against a brute-force search for shared word runs, with the edge cases of its docstring."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ratewise.llm import winnowing
from ratewise.llm.common import bit_filter, perhaps_in, with_bit

DOCS = "doc_id long, text string, n_words string, items string, spans string, k1 string, words string"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, window):
    out = []
    for i, text in docs:
        w, hit, ids = words(text), set(), set()
        for name, item in items:
            v = words(item)
            n = min(window, len(v))
            runs = {tuple(v[s:s + n]) for s in range(len(v) - n + 1)} if n else set()
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in runs:
                    hit |= set(range(s, s + n))
                    ids.add("null" if name is None else str(name))
        out.append((i, len(w), len(hit), tuple(sorted(ids)), tuple(sorted(hit))))
    return sorted(out, key=repr)


def got(spark, docs, items, **params):
    d = spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, item string")
    rows = winnowing.contamination(d, b, **params).collect()
    for r in rows:
        assert all(x.end < y.start for x, y in zip(r.spans, r.spans[1:]))
    return sorted([(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(k for s in r.spans for k in range(s.start, s.end))) for r in rows], key=repr)


@pytest.mark.parametrize("window,gram,letters", [(10, 5, "ab"), (10, 5, "abcdefgh"), (6, 6, "abc"), (7, 2, "abcd")])
def test_matches_brute_force(spark, window, gram, letters):
    r = random.Random(window * 31 + len(letters))
    text = lambda n: " ".join(r.choice(letters) for _ in range(n))
    items = [(i, text(r.randint(1, 40))) for i in range(25)] + [(None, text(14)), (3, text(30)), (90, ""), (91, None), (92, "... !")]
    items += [(93, items[0][1].upper()), (94, "É" + text(12))]
    docs = [(i, text(r.randint(0, 60))) for i in range(30)]
    docs += [(100 + i, f"{text(20)}, {items[i % 25][1]}. {text(20)}") for i in range(20)]
    docs += [(None, None), (None, items[2][1]), (5, items[2][1]), (5, ""), (7, "-- \x00 --"), (8, items[5][1].upper()), (9, "a " * 3000), (10, " É" + items[31][1])]
    docs += [docs[31]] * 4
    assert got(spark, docs, items, window=window, gram=gram) == brute(docs, items, window)


def test_every_shared_window_is_found(spark):
    """A passage of exactly ``window`` words at every offset of random surroundings; one word less is clean."""
    r = random.Random(4)
    word = lambda: f"w{r.randint(0, 10**9)}"
    item = [word() for _ in range(40)]
    docs = [(k, " ".join([word() for _ in range(k % 13)] + item[k % 31:k % 31 + 10 - (k >= 60)] + [word() for _ in range(k % 7)])) for k in range(120)]
    for i, n, hit, ids, at in got(spark, docs, [(1, " ".join(item))]):
        assert (hit, ids) == ((10, ("1",)) if i < 60 else (0, ()))


def test_empty_tables_and_long_text(spark):
    item = " ".join(f"x{i}" for i in range(300))
    long = "lorem ipsum dolor " * 60_000 + item + " sit amet" * 60_000
    assert got(spark, [(1, long)], [(7, item)])[0][:4] == (1, 300_300, 300, ("7",))
    assert got(spark, [], [(7, item)]) == []
    assert got(spark, [(1, item)], []) == [(1, 300, 0, (), ())]
    assert got(spark, [(1, item)], [(2, None)]) == [(1, 300, 0, (), ())]


def test_bit_filter_keeps_every_key(spark):
    rows = spark.range(50_000).select("id", F.xxhash64("id").alias("h"))
    keys = rows.where("id % 7 = 0").select("h")
    kept = {r.id for r in perhaps_in(rows, "h", keys).collect()}
    assert {i for i in range(50_000) if i % 7 == 0} <= kept and len(kept) < 12_000
    marked = with_bit(rows, "h", bit_filter(keys, "h"), "m")
    assert marked.columns == ["id", "h", "m"] and marked.count() == 50_000 and marked.where("m IS NULL").isEmpty()
    assert perhaps_in(rows, "h", keys.limit(0)).count() == 0
