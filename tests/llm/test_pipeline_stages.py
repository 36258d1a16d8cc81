"""What each stage of the pipeline keeps, against brute force on the stage's own input."""

import hashlib

import brute
import pytest
from tokenizers import Tokenizer

from paylens.llm.registry import VOCABULARY

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_give_what_brute_force_gives(spark, tmp_path):
    stages, read = dict(pipeline.STAGES), lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    def run(name):
        out = f"{tmp_path}/{name.replace(' ', '_')}"
        stages[name](spark, docs, SF).write.parquet(out)
        return spark.read.parquet(out)

    before = read(docs)
    want = brute.components(list(before.items()))
    docs = run("n-gram Jaccard join")
    assert read(docs) == {i: t for i, t in before.items() if want[i][1] == i} and docs.count() < len(before)

    before = read(docs)
    want = brute.repeats(list(before.items()), 50)
    docs = run("substring dedup")
    assert {i: (t or "").encode().split() for i, t in read(docs).items()} == {i: kept for i, (_, kept) in want.items()}

    before = read(docs)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaking = {d for d, _ in brute.leaks(list(before.items()), items)}
    docs = run("benchmark decontamination")
    assert leaking and read(docs) == {i: t for i, t in before.items() if i not in leaking}

    before = read(docs)
    reference = Tokenizer.from_file(VOCABULARY)
    rows = run("BPE encoding and decoding").collect()
    assert len(rows) == len(before)
    for r in rows:
        ids = reference.encode(before[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, bytes(r.ids)) == (len(ids), b"".join(x.to_bytes(4, "little") for x in ids))
        assert r.decoded_sha256 == hashlib.sha256((before[r.doc_id] or "").encode()).hexdigest()
