"""The pipeline's stages against brute force, each on its own input."""

import hashlib
import re

import corpus_pipeline as C
from ratewise.llm import cnn_toxicity, mixing, popcount_simhash
from ratewise.llm.common import materialize, table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    got = {}
    for name, stage in C.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF), f"test-{name}")
        got[name] = before, docs
        if name != "encoding":
            assert docs.columns == table(spark, SF, "documents").columns
    before, after = got["toxicity"]
    bad = {r.doc_id for r in cnn_toxicity.toxicity(before, table(spark, SF, "labels")).where("predicted = 1").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
    before, after = got["exact_dedup"]
    first = {}
    for r in before.collect():
        t = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        first[t] = min(first.get(t, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(first.values())
    before, after = got["near_dedup"]
    groups = {r.component_id for r in popcount_simhash.near_duplicates(before).collect()}
    assert {r.doc_id for r in after.collect()} == groups
    before, after = got["mixing"]
    assert after.count() == sum(r["_epochs"] for r in mixing.mix(before).collect())
    before, after = got["encoding"]
    text = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in before.collect()}
    rows = after.collect()
    assert len(rows) == before.count() and all(text[r.doc_id] == r.decoded_sha256 for r in rows)


def test_last_stage_returns_the_encoded_documents(spark):
    import public_tokenizers as P

    from ratewise.llm import segment_bpe

    docs = table(spark, SF, "documents").limit(20)
    want = segment_bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    rows = C.encoding(spark, docs, SF).collect()
    assert {r.doc_id: list(r.ids) for r in rows} == {r.doc_id: list(r.ids) for r in want} and any(r.ids for r in rows)
