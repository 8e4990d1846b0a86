"""The stages that keep or repeat rows, by brute force: null, repeated and equal ids, clashing columns, empty tables."""

import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from ratewise.llm import block_naming, mixing, popcount_simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, _id long, _key string, _mark string, _h long, fp string"


def simhash(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """Least fingerprint of each fingerprint's group of links within 3 bits."""
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in prints}


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 7, "r", 3, "k", "m", 5, "f") for i, t, s in rows], SCHEMA)


def rows():
    r = random.Random(7)
    words = "red green blue pink grey".split()
    long = " ".join(r.choice(words) + str(r.randint(0, 9)) for _ in range(400))
    near = long.rsplit(" ", 1)[0] + " other"
    out = [(1, "alpha beta gamma", "a"), (5, "alpha beta gamma", "a"), (5, "delta epsilon zeta", "b"), (7, "delta epsilon zeta", "b"),
           (None, "same text", None), (None, "same text", "a"), (None, "same  text", "a"), (9, "nine", "b"), (9, "nine", "b"), (9, "nine", "b"),
           (None, None, None), (None, "", "c"), (12, "", "c"), (13, " \n", "c"), (20, long, "a"), (21, near, "b"), (22, near, None), (20, near, "a")]
    return out + [(100 + i % 9, " ".join(r.choice(words) for _ in range(r.randint(1, 6))), r.choice(["a", "b", None])) for i in range(60)]


def order(row, *rest):
    return (row[0] is None, row[0] or 0, *rest)


def test_keep_one(spark):
    given = rows()
    first = {}
    for row in given:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", row[1] or "")
        first.setdefault(key, set()).add(row[0])
    got = block_naming.keep_one(table(spark, given))
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    kept = Counter((re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id) for r in got.collect())
    assert kept == Counter((k, min(ids, key=lambda i: (i is None, i or 0))) for k, ids in first.items())
    assert block_naming.keep_one(table(spark, [])).count() == 0


def test_keep_first(spark):
    given = rows()
    root = groups({simhash(t) for _, t, _ in given})
    by = defaultdict(list)
    for row in given:
        f = simhash(row[1])
        signed = f - (1 << 64) if f >> 63 else f
        by[root[f]].append((order(row, signed), row[0], f))
    got = popcount_simhash.keep_first(table(spark, given))
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    kept = sorted(((r.doc_id is None, r.doc_id or 0, simhash(r.text)) for r in got.collect()))
    assert kept == sorted((min(x)[1] is None, min(x)[1] or 0, min(x)[2]) for x in by.values())
    assert popcount_simhash.keep_first(table(spark, [])).count() == 0


def test_links_across_components(spark):
    """Fingerprints and component ids of the whole operator against brute force."""
    given = rows()
    root = groups({simhash(t) for _, t, _ in given})
    low = {}
    for i, t, _ in given:
        g = root[simhash(t)]
        low[g] = min((x for x in (low.get(g), i) if x is not None), default=None)
    got = popcount_simhash.near_duplicates(table(spark, given)).collect()
    want = [(str(i), f"{simhash(t):016x}", str(low[root[simhash(t)]])) for i, t, _ in given]
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == sorted(want)


@pytest.mark.parametrize("share", [1.5, 0.37, 0.9])
def test_mixed_repeats_rows_as_often_as_the_mix_takes_them(spark, share):
    given = rows() + [(None, "one two three", "a")] * 25 + [(300, f"w{i} x", "b") for i in range(15)]
    t = table(spark, given)
    size = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x or ""))
    want = Counter()
    for r in mixing.mix(t.select("doc_id", "text", "source"), share=share).collect():
        want[r.doc_id, r.source, size(r.text)] += r["_epochs"]
    out = mixing.mixed(t, share=share)
    assert out.columns == t.columns
    got = out.collect()
    assert Counter((r.doc_id, r.source, size(r.text)) for r in got) == +want
    assert Counter(map(str, got)) == Counter(map(str, mixing.mixed(t.repartition(5), share=share).collect()))
    assert mixing.mixed(table(spark, [])).count() == 0
