"""Exact dedup, mixing, SimHash, BPE, toxicity: brute force on small tables, with the edge cases of their docstrings."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ratewise.llm import block_naming, cnn_toxicity, mixing, popcount_simhash, segment_bpe
from ratewise.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, name string, rid long"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    base = ["", None, " ", "a", "A b\tc\n d", "a  b c", "word " * 3000, "x" * 5000, "word " * 2999 + "end", "été ñ Ж 漢字 😀 " * 50]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, r.choice(base)) for i in range(30)]
    rows += [(200 + i, " ".join(r.choice("red green blue pink".split()) for _ in range(r.randint(1, 900)))) for i in range(30)]
    rows += [(None, "a"), (None, "only null id"), (3, "a"), (3, "a"), (500, "word " * 3000)]
    return spark.createDataFrame([(i, t, "en", r.choice(["s1", "s2", None, "Z"]), 0, 7, "n", 1) for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup_matches_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    got = block_naming.exact_dedup(docs, block_bytes=64).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), str(min((x for x in groups[norm(t)] if x is not None), default=None)), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(g.doc_id), str(g.keep_id), g.group_size, g.text_sha256) for g in got) == want
    assert sum(g.kept for g in got) == len(groups)
    kept = block_naming.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(norm(r.text) for r in kept.collect()) == sorted(groups)
    assert block_naming.exact_dedup(empty(spark)).count() == 0


def test_mix_matches_brute_force(spark, docs):
    got = mixing.mix(docs.select("doc_id", "text", "source")).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = [(r.doc_id, size(r.text), r.source) for r in docs.collect()]
    total = defaultdict(int)
    for _, n, s in rows:
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}
    target, over = {}, set()
    while True:
        free = [s for s in names if s not in over]
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in over)) / sum(w[s] for s in free)
        new = {s for s in free if w[s] * level > 2 * total[s]}
        if not new:
            break
        over |= new
    target = {s: 2.0 * total[s] if s in over else w[s] * level for s in names}
    taken = defaultdict(int)
    for g in got:
        assert g["_target"] == target[g.source] and g["_source_size"] == total[g.source] and 0 <= g["_taken"] <= 2 * g["_size"]
        taken[g.source] += g["_taken"]
    assert {s: int(target[s]) for s in names} == dict(taken)
    assert len(got) == len(rows)
    again = mixing.mix(docs.select("doc_id", "text", "source")).collect()
    key = lambda x: sorted((str(g.doc_id), str(g.source), g["_size"], g["_taken"]) for g in x)
    assert key(again) == key(got)
    emitted = mixing.mixed(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(g["_epochs"] for g in got)
    assert mixing.mix(empty(spark)).count() == 0


def test_links_are_all_pairs_within_the_distance(spark):
    r = random.Random(5)
    fps = {0, (1 << 64) - 1, 1, 7, 15}
    for _ in range(60):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(4):
            fps.add(x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))))
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    for bits in (1, 2, 3, 4, 5):
        got = {tuple(sorted(x)) for x in popcount_simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), bits).collect()}
        want = {tuple(sorted((a, b))) for k, a in enumerate(fps) for b in fps[:k] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= bits}
        assert got == want


def test_simhash_edges(spark, docs):
    got = popcount_simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    zero = {g.doc_id for g in got if g.fingerprint == "0" * 16}
    assert {0, 1, 2} <= zero
    kept = popcount_simhash.keep_first(docs)
    # of the two rows with null ids one has the text of a document with an id, which stands first
    assert kept.columns == docs.columns and [r.text for r in kept.where("doc_id is null").collect()] == ["only null id"]
    assert popcount_simhash.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(300, 330)] + [(5, 5), (330, 300)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long"), "t").collect())
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in [7, *range(300, 331)]}}


def test_bpe_equals_the_library(spark, docs):
    import base64

    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    hard = ["  \n\t  x", "<|endoftext|>", "don't 've 1234567", "a" * 3000, "".join(chr(r.randint(33, 0x2FF)) for _ in range(2000)), "ab" * 40, "日本語" * 60]
    more = docs.unionByName(spark.createDataFrame([(1000 + i, t, "", "", 0, 0, "", 0) for i, t in enumerate(hard)], SCHEMA))
    text = [(x.doc_id, x.text or "") for x in more.collect()]
    got = segment_bpe.encode(more, path, P.PATTERN).collect()
    want = sorted((str(i), enc.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in text)
    assert sorted((str(g.doc_id), list(g.ids), g.decoded_sha256) for g in got) == want
    codec = segment_bpe.Merges(segment_bpe.load_ranks(path))
    assert codec.encode_long(b"a" * 777) == enc.encode_ordinary("a" * 777)
    assert segment_bpe.encode(empty(spark), path, P.PATTERN).count() == 0


def test_toxicity_learns_words_and_leaves_clean_rows(spark):
    r = random.Random(2)
    plain = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 7))) for _ in range(3000)]
    bad = ["zork", "quux", "blarg"]
    rows, labels = [], []
    for i in range(900):
        words = [r.choice(plain) for _ in range(r.randint(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            words[r.randrange(len(words))] = r.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(None, "zork zork"), (2000, ""), (2001, None), (5, rows[5][1])]
    labels += [(None, 1), (3000, None)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(9)), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = cnn_toxicity.toxicity(d, lab).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got)
    truth = {i: t for i, t in labels if i is not None}
    held = [(g.predicted, truth[g.doc_id]) for g in got if g.held_out and g.doc_id in truth]
    assert sum(p for p, t in held if t) >= 0.9 * sum(t for _, t in held)
    assert sum(p for p, t in held if not t) <= 0.1 * len(held)
    import zlib
    assert all(g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got)
    clean = cnn_toxicity.keep_clean(d, lab)
    assert clean.columns == d.columns
    nothing = cnn_toxicity.toxicity(d, lab.where("false")).collect()
    assert {g.score for g in nothing} == {0.5}
    assert cnn_toxicity.toxicity(d.where("false"), lab).count() == 0


def test_toxicity_cuts_cover_all_labels(spark):
    """Each language's cut is of least cost over all its labels, though the sample holds few of them."""
    r = random.Random(8)
    plain = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 7))) for _ in range(300)]
    signs = [(f"sign{k}", 0.02 + 0.04 * k, 0.3 - 0.03 * k) for k in range(8)]  # word, share of clean and of toxic rows
    rows, labels = [], []
    for i in range(2500):
        french, toxic = i % 8 == 0, r.random() < 0.4
        words = [r.choice(plain) for _ in range(12)] + (["le", "la", "les"] if french else ["the", "of", "and"])
        words += [w for w, clean, bad in signs if r.random() < (bad if toxic else clean * (2 if french else 1))]
        rows.append((i, " ".join(r.sample(words, len(words)))))
        labels.append((i, int(toxic)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    truth = dict(labels)
    got = [(g.doc_id, g.score) for g in cnn_toxicity.toxicity(d, lab, cnn_toxicity.Params(positives=40, negatives=60)).collect() if not g.held_out]

    def cost(own, cut):
        missed = sum(s < cut for i, s in own if truth[i]) / sum(truth[i] for i, _ in own)
        return missed + 3 * sum(s >= cut for i, s in own if not truth[i]) / sum(not truth[i] for i, _ in own)

    for french in (False, True):
        own = [(i, s) for i, s in got if (i % 8 == 0) == french]
        best = min(cost(own, c) for c in [2, *(s for _, s in own)])
        assert cost(own, 0.5) <= best + 0.03, (french, cost(own, 0.5), best)


def test_links_are_all_pairs_for_even_distances(spark):
    r = random.Random(9)
    fps = {0, 3, 5, (1 << 33) | 1, (1 << 40) | (1 << 33) | 5}
    for _ in range(40):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(4):
            fps.add(x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))))
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    for bits in (0, 2, 4):
        got = {tuple(sorted(x)) for x in popcount_simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), bits).collect()}
        want = {tuple(sorted((a, b))) for k, a in enumerate(fps) for b in fps[:k] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= bits}
        assert got == want
