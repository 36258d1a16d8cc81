"""Each operator against a plain version, and on odd rows."""

import hashlib
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from compare import canonical
from paylens.llm import bpe, components, decontaminate, html_text, jaccard_join, license_scan, quality_model, quality_rules, substring_dedup, toxicity, warc
from paylens.llm.registry import QUERIES, SQL, VOCABULARY


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def counted(df):
    """How often each (id, rest of the row) stands in a table."""
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    result = duck.execute(SQL[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical([c[0] for c in result.description], result.fetchall())


def test_bpe_codes_as_the_library_does(documents, odd_docs):
    reference = Tokenizer.from_file(VOCABULARY)
    for df in (documents.limit(60), odd_docs):
        for r in bpe.bpe_round_trip(df, VOCABULARY).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
            ids = reference.encode(r.text or "", add_special_tokens=False).ids
            assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.n_tokens == len(ids)
            assert r.decoded == reference.decode(ids, skip_special_tokens=False) == (r.text or "")
    digests = bpe.bpe_digests(odd_docs, VOCABULARY)
    assert digests.count() == odd_docs.count()
    assert digests.filter("doc_id = 0").first().ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.bpe_digests(odd_docs.limit(0), VOCABULARY).count() == 0


def test_bpe_forgets_words_but_not_texts():
    small = bpe.Codec(bpe.load_vocabulary(VOCABULARY), memo=5)
    large = bpe.Codec(bpe.load_vocabulary(VOCABULARY))
    samples = ["one two three four five six seven", "eight nine ten " * 3, "", "a" * 300]
    assert list(small.encode(samples)) == list(large.encode(samples))


def test_bpe_codes_long_words():
    reference = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(1)
    made = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000)), "日本語" * 7000, "ab" * 30_000, "x" * 50_001, *("word" * i for i in range(1, 90))]
    began = time.time()
    codec = bpe.Codec(bpe.load_vocabulary(VOCABULARY))
    for text, ids in zip(made, codec.encode(made), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids
    assert time.time() - began < 30


def test_warc(spark, tmp_path):
    long = "<p>" + "ü\r\n\r\nWARC/1.1\r\n" * 9000 + "</p>"
    rows = [(1, "http://a", long), (2, "http://b", long), (3, "http://c", "short"), (4, "http://d", "short"), (5, None, None), (6, "u\r\nv", ""), (None, None, "x" * 2000), (7, "e", "y" * 1500), (7, "e", "y" * 1500)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.warc_round_trip(pages, str(tmp_path / "archives"), payloads=True)
    assert got.count() == len(rows)
    want = {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None), None: ("response", None)}
    html = {r[0]: r[2] or "" for r in rows}
    for r in got.collect():
        assert (r.record_type, r.refers_to) == want[r.page_id]
        assert r.payload_bytes == len(html[r.page_id].encode()) and r.payload_digest == hashlib.sha1(html[r.page_id].encode()).hexdigest()
        assert r.record_type == "revisit" or bytes(r.payload) == html[r.page_id].encode()
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_warc_segments():
    block = warc.HTTP_HEAD + warc.chunked(b"payload" * 1000, 64)
    parts = [(i + 1, x, len(block) if i == 2 else None) for i, x in enumerate((block[:100], block[100:900], block[900:]))]
    assert warc.reassembled("o", parts) == b"payload" * 1000
    for broken in (parts[:2], [parts[0], parts[2]], [*parts[:2], (3, b"", len(block))]):
        with pytest.raises(ValueError):
            warc.reassembled("o", broken)
    with pytest.raises(ValueError):
        warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")


def near_copies(seed, groups=4, size=25):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(rng.choice((8, 60, 300)))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3, 5))):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            out.append(" ".join(w))
    return out


def test_near_duplicates(spark, documents, odd_docs):
    docs = texts(documents.limit(120)) + [(10**6 + i, t) for i, t in enumerate(near_copies(7))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == brute.components(docs)
    kept = {r.doc_id for r in jaccard_join.drop_near_duplicates(df).collect()}
    assert kept == {c for _, c in got.values()}
    odd = jaccard_join.near_duplicates(odd_docs)
    assert odd.count() == odd_docs.count()
    assert {(r.doc_id, r.component_id) for r in odd.collect()} >= {(0, 0), (5, 5), (6, 5), (None, None)}
    assert jaccard_join.near_duplicates(odd_docs.limit(0)).count() == 0
    assert jaccard_join.drop_near_duplicates(odd_docs).columns == odd_docs.columns


def test_trees_pass_over_nothing_that_reaches_the_similarity():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, rng.integers(5, 200)).astype(np.uint64)) for _ in range(150)]
    sizes = np.array([len(s) for s in sets])
    tree = jaccard_join.RTree(np.array([jaccard_join.count_vector(s) for s in sets]), sizes, fanout=4)
    assert len(tree.levels) > 2
    for i, s in enumerate(sets):
        found = set(tree.search(jaccard_join.count_vector(s), len(s), 30)[0].tolist())
        for j, o in enumerate(sets):
            both = len(np.intersect1d(s, o))
            assert j in found or 100 * both < 30 * (len(s) + len(o) - both)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (200, 201)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}


def test_quality_classifier(spark, odd_docs):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_model.quality_scores(documents, labels)
    assert scored.count() == documents.count()
    tested = scored.filter("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert tested > 0.9
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert counted(quality_model.quality_scores(documents, flipped)) == counted(scored)
    odd = quality_model.quality_scores(odd_docs, labels)
    assert odd.count() == odd_docs.count() and odd.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality_model.quality_scores(odd_docs, labels.limit(0)).filter("score = 0.5").count() == odd_docs.count()
    assert quality_model.quality_scores(odd_docs.limit(0), labels).count() == 0


def test_toxicity(spark, odd_docs):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.toxicity_scores(documents, labels).join(labels, "doc_id").filter("held_out")
    rates = scored.agg(F.avg(F.when(F.col("predicted") == 1, (F.col("toxic") == 1).cast("double"))), F.avg(F.when(F.col("toxic") == 1, F.col("predicted").cast("double")))).first()
    # A seventh of these toxic documents has no word that training texts mark as such; see also the larger tables below.
    assert rates[0] > 0.9 and rates[1] > 0.75
    odd = toxicity.toxicity_scores(odd_docs, labels)
    assert odd.count() == odd_docs.count() and odd.filter("score is null").count() == 0
    assert toxicity.toxicity_scores(odd_docs, labels.limit(0)).filter("score = 0").count() == odd_docs.count()
    assert toxicity.toxicity_scores(odd_docs.limit(0), labels).count() == 0
    kept = toxicity.drop_toxic(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert toxicity.drop_toxic(odd_docs.limit(0), labels).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/check_s/labels.parquet"), reason="the larger tables are not here")
def test_toxicity_on_larger_tables(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/check_s/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.toxicity_scores(documents, labels).join(labels, "doc_id").filter("held_out")
    rates = scored.agg(F.avg(F.when(F.col("predicted") == 1, (F.col("toxic") == 1).cast("double"))), F.avg(F.when(F.col("toxic") == 1, F.col("predicted").cast("double")))).first()
    print(rates)
    assert rates[0] > 0.98 and rates[1] > 0.95


def test_positive_unlabelled_learning_finds_the_hidden_positives():
    rng = np.random.default_rng(0)
    positive = [np.array([0, *rng.integers(1, 40, 5)]) for _ in range(300)]
    unlabelled = [np.array([*([0] if i < 200 else []), *rng.integers(1, 40, 5)]) for i in range(1000)]
    w = toxicity.train_nnpu([np.unique(x) for x in positive], [np.unique(x) for x in unlabelled], 0.2, 40)
    assert w[0] + w[40] > 1 > -1 > w[40]


def test_license_scan(documents, odd_docs):
    for df in (documents, odd_docs):
        got = license_scan.license_scan(df)
        assert got.count() == df.count()
        want = sorted(repr((i, *brute.licenses(t))) for i, t in texts(df))
        assert sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got.collect()) == want
        assert got.filter("score < 0 or score > 1").count() == 0
    assert license_scan.license_scan(odd_docs.limit(0)).count() == 0


def test_license_spans_with_a_word_put_in(spark):
    notice = "permission is hereby granted free of any charge to any person obtaining a copy of this software and associated documentation files"
    df = spark.createDataFrame([(1, "x y " * 5 + notice), (2, "permission is hereby granted"), (3, "a b c")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.license_scan(df).collect()}
    assert got == {1: "mit", 2: "", 3: ""}


def test_decontamination(spark, odd_docs):
    documents, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    rng = random.Random(2)
    docs = texts(documents.limit(150))
    for i, (_, t) in enumerate((r.item_id, r.text) for r in items.collect()):
        w = t.split()
        for n in (1, 2):
            v = list(w)
            for _ in range(n):
                v[rng.choice((0, len(v) // 2, len(v) - 1))] = "zzz"
            docs.append((10**6 + 10 * i + n, "some words before it " + " ".join(v) + " and after it"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.find_leaks(df, items).collect()}
    want = {k: round(v, 9) for k, v in brute.leaks(docs, [(r.item_id, r.text) for r in items.collect()]).items()}
    assert got == want and len(want) > 40
    assert decontaminate.find_leaks(odd_docs, items).count() == 0
    assert decontaminate.find_leaks(odd_docs, items.limit(0)).count() == 0
    own = odd_docs.filter("doc_id = 5").select(F.col("doc_id").alias("item_id"), "text").limit(1)
    assert sorted(r.doc_id for r in decontaminate.find_leaks(odd_docs, own).collect()) == [5, 6]
    assert decontaminate.decontaminate(odd_docs, own).columns == odd_docs.columns


@pytest.mark.parametrize("n", [50, 9])
def test_substring_dedup(documents, n):
    want = brute.repeats(texts(documents), n)
    for r in substring_dedup.remove_repeats(documents.repartition(5), n, digest=True).collect():
        w, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    for r in substring_dedup.remove_repeats(documents, n).collect():
        assert r.text.encode().split() == want[r.doc_id][1] and r.n_chars == len(r.text)


def test_substring_dedup_on_odd_rows(odd_docs):
    out = substring_dedup.remove_repeats(odd_docs, 9)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert {r.doc_id: r.text for r in out.filter("doc_id in (0, 5, 6)").collect()} == {0: None, 5: "The quick brown fox jumps over the lazy dog and runs away from the bear in the wood", 6: ""}
    assert substring_dedup.remove_repeats(odd_docs.limit(0), 9, digest=True).count() == 0


def test_html(spark):
    cases = {
        "": "",
        "<p>a": "a",
        "<html><body><nav><a href=x>Home</a></nav><article><h1>Title &amp; more</h1><p>One <b>two</b>\n three<p>Four.</article><footer>f</footer></body></html>": "Title & more\nOne two three\nFour.",
        "<article><p>Kept text of it.</p><div class='ad'>Buy</div><script>var a='<p>no</p>'</script><form><p>Name</p></form><section class=comments><p>Great</p></section></article>": "Kept text of it.",
        "<article><p>x &lt;b&gt; &#233;<!-- no --><br>y</p></article>": "x <b> é y",
    }
    assert {h: html_text.main_text(h) for h in cases if h != "<p>a"} == {h: t for h, t in cases.items() if h != "<p>a"}
    body = "The quick brown fox is on the way to the house of the man who has been there for all of the day and it is not that he was in the way of the dog. "
    page = f"<div id=cookie-banner>{body}</div><div class=sidebar>{body}</div><h2>A heading</h2><p>{body * 2}</p><p>Short.</p><p>{body * 2}</p><ul><li><a href=a>Link one</a><li><a href=b>Link two</a></ul>"
    assert html_text.main_text(page).split("\n") == ["A heading", (body * 2).strip(), "Short.", (body * 2).strip()]
    df = spark.createDataFrame([(1, "u", None, 3), (None, None, page, 4), (2, "v", "<p" * 20000, 5)], "page_id long, url string, html string, text int")
    got = html_text.extract_text(df)
    assert sorted(r.n_chars for r in got.collect())[0] == 0 and got.count() == 3
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_quality_rules(documents, odd_docs):
    for df in (documents, odd_docs):
        got = quality_rules.quality_rules(df)
        rows = sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got.collect())
        assert rows == sorted(repr((i, *brute.quality(t))) for i, t in texts(df))
        assert got.filter("kept and base_failed").count() == 0 and got.filter("kept is null").count() == 0
    assert quality_rules.quality_rules(odd_docs.limit(0)).count() == 0


def test_quality_rules_keep_what_is_labelled_good(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules.quality_rules(documents).filter("not base_failed").join(labels, "doc_id")
    good, bad = (judged.filter(f"quality = {q}").agg(F.avg(F.col("kept").cast("double"))).first()[0] for q in (1, 0))
    assert good > 0.99 and bad < 0.3


def test_divergence(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], 0.0), ([1.0, 0.0], [0.0, 1.0], 1.0), ([0.5, 0.5], [0.5, 0.5], 0.0)], "p array<double>, q array<double>, e double")
    assert all(abs(r[0] - r[1]) < 1e-9 for r in df.select(quality_rules.divergence(F.col("p"), F.col("q")), "e").collect())


def test_pipeline(spark, tmp_path, odd_docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    last = pipeline.STAGES[-1][1]
    for name, docs in (("documents", documents), ("odd", odd_docs), ("empty", odd_docs.limit(0))):
        columns, first = docs.columns, docs.count()
        for i, (_, stage) in enumerate(pipeline.STAGES[:-1]):
            before = docs.count()
            stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}/{i}")
            docs = spark.read.parquet(f"{tmp_path}/{name}/{i}")
            assert docs.columns == columns and docs.count() <= before
        assert last(spark, docs, sf).count() == docs.count() > (0 if first else -1)
        if name == "documents":
            assert counted(pipeline.run(spark, sf)) == counted(last(spark, docs, sf))
        if name == "odd":
            # Of two rows with one text the smaller id stays, and rows without id all do.
            assert sorted(r.doc_id for r in docs.collect() if r.doc_id is not None) == sorted([5, *(i for i in range(11) if i != 6)]) and docs.filter("doc_id is null").count() == 2
