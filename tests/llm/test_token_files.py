"""Token files against the tokenizers library on whole texts, and the coding of ranks on its own."""

import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paylens.llm.common import Scratch
from paylens.llm.registry import WORD_VOCABULARY
from paylens.llm.token_files import encoder_of, pack_ranks, read_token_files, token_file_digests, unpack_ranks, write_token_files


def expected(rows):
    """rows of (doc_id, text) in their final order."""
    library, start, out = Tokenizer.from_file(WORD_VOCABULARY), 0, []
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), ids.tobytes()))
        start += len(ids)
    return out


ODD = [
    (9, "Don't stop, it's 1234 o'clock!  ###\tÑandú STRASSE straße\nend"), (3, None), (7, ""), (8, "   \n\t"), (-4, "İstanbul ΣΊΣΥΦΟΣ Σας ΌΣΟΣ"), (None, "no id"),
    (5, "<|endoftext|>x <|startoftext|> a<|endoftext|>"), (6, "café é ́x ﬁ ½ ² ٣ 漢字かな　交じり 🙂👍🏽 a b c\u0085d\x1ce"),
    (12, "same"), (12, "other words"), (12, "same"), (2**40, "w" * 300 + " " + "long" * 9000), (1, "‘quoted’ “x” — 5 €"), (2, "’s ’t 'S 'RE 'll"),
]


def test_odd_rows_as_the_library_codes_them(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("start", F.lit("clash")).withColumn("tie", F.lit(1)).repartition(4)
    scratch = Scratch(spark)
    write_token_files(docs, folder := scratch.path("t"), WORD_VOCABULARY, ids_per_file=60)
    got = sorted(((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in read_token_files(spark, folder).collect()), key=lambda r: r[1])
    order = [r[0] for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0)) and len(got) == len(ODD)
    texts = {}
    for doc_id, text in ODD:
        texts.setdefault(doc_id, {})[expected([(0, text)])[0][3]] = text
    assert got == expected([(r[0], texts[r[0]][r[3]]) for r in got])
    assert sorted(map(str, [r[0] for r in got])) == sorted(str(i) for i, _ in ODD)
    digests = {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_file_digests(docs, WORD_VOCABULARY, scratch=scratch).collect()}
    assert digests == {(a, b, c, zlib.crc32(d)) for a, b, c, d in got}
    scratch.discard()


def test_documents_of_the_smallest_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in token_file_digests(docs.repartition(3), WORD_VOCABULARY, ids_per_file=20_000).collect())
    assert got == [(a, b, c, zlib.crc32(d)) for a, b, c, d in expected(rows)]


def test_an_empty_table(spark):
    assert token_file_digests(spark.createDataFrame([], "doc_id long, text string"), WORD_VOCABULARY).collect() == []


def test_a_full_memory_starts_anew():
    encoder = type(encoder_of(WORD_VOCABULARY))(WORD_VOCABULARY, memo=5)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcñ 漢", k=4)) for _ in range(30)) for _ in range(20)]
    got = [np.frombuffer(x, encoder.kind).astype("<u4").tobytes() for i in range(0, 20, 3) for x in encoder.encode(pa.array(texts[i : i + 3]), 2).to_pylist()]
    assert got == [x[3] for x in expected(enumerate(texts))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.sampled_from([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24]), max_size=40))
def test_ranks_come_back(ranks):
    control, data = pack_ranks(np.array(ranks, "<u4"))
    assert len(control) == -(-len(ranks) // 4)
    assert unpack_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(ranks)).tolist() == ranks


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2100, exclude_categories=["Cs"]), max_size=40))
def test_any_text_as_the_library_codes_it(text):
    encoder = encoder_of(WORD_VOCABULARY)
    assert np.frombuffer(encoder.encode(pa.array([text]), 2)[0].as_py(), encoder.kind).tolist() == [*encoder.library.encode(text, add_special_tokens=False).ids, 2]
