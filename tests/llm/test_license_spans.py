"""License spans against a plain aligner, and spans that get the votes but not the words in order."""

import random
import re

import pytest

from paylens.llm import license_scan

SCHEMA = "doc_id long, text string"


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text)) if w]


def best_alignment(w, t):
    """The share of a template that is left after the fewest edits to make it of any run of words."""
    before = [0] * (len(w) + 1)
    for i, x in enumerate(t, 1):
        now = [i]
        for j, y in enumerate(w, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return 1 - min(before) / len(t)


def scan(spark, docs):
    return {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(docs, SCHEMA)).collect()}


def edited(w, rate, rng):
    out = []
    for x in w:
        kind = rng.random() / rate if rate else 9
        out += [] if kind < 0.3 else ["new", x] if kind < 0.6 else ["other"] if kind < 1 else [x]
    return out


def test_method_labels_are_those_of_an_aligner(spark):
    rng = random.Random(4)
    docs = []
    for i, (_, text) in enumerate(license_scan.TEMPLATES):
        for n, rate in enumerate((0, 0.02, 0.05, 0.5)):
            filler = [f"filler{rng.randrange(300)}" for _ in range(60)]
            docs.append((10 * i + n, " ".join(filler[:30] + edited(words(text), rate, rng) + filler[30:])))
    got = scan(spark, docs)
    for i, text in docs:
        rates = {}
        for label, t in license_scan.TEMPLATES:
            rates[label] = max(rates.get(label, 0), best_alignment(words(text), words(t)))
        method = set(got[i].labels.split(",")) - {""} - set(got[i].base_labels.split(","))
        # Every label found is in the text in order; what is there nearly whole is found.
        assert all(rates[x] >= 0.6 for x in method)
        assert {x for x, rate in rates.items() if rate >= 0.85} <= set(got[i].labels.split(","))
    assert sum(i % 10 == 0 and got[i].n_spans > 0 for i, _ in docs) == len(license_scan.TEMPLATES)


def test_votes_alone_are_no_span(spark):
    label, text = license_scan.TEMPLATES[-1]
    w = words(text)
    spread = [x for i in range(0, len(w), 4) for x in [*w[i : i + 4], "one", "two", "three"]]
    got = scan(spark, [(1, " ".join(spread)), (2, text), (3, " ".join(w[::-1])), (4, " ".join(w[:8] + ["indeed"] + w[8:])), (5, None), (6, "")])
    assert {i: r.labels for i, r in got.items()} == {1: "", 2: label, 3: "", 4: label, 5: "", 6: ""}
    assert got[2].score == 1.0 and 0.9 < got[4].score < 1.0


def test_rows_alike_share_a_scan(spark):
    text = license_scan.TEMPLATES[-1][1]
    rows = license_scan.license_scan(spark.createDataFrame([(1, text), (1, text), (None, text), (1, "another text")], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.labels, r.n_spans) for r in rows) == [(0, "mpl-2.0", 1), (1, "", 0), (1, "mpl-2.0", 1), (1, "mpl-2.0", 1)]


def test_parts_repeated_beside_a_notice_do_not_hide_it(spark):
    rng = random.Random(9)
    docs, sizes = [(1, "may be released under the released under the MIT License"), (2, "under the MIT under the MIT License")], {}
    for label in ("mit", "mpl-2.0", "cc-by"):
        w = next(words(t) for x, t in license_scan.TEMPLATES if x == label)
        for a in range(len(w) - 2):
            for b in range(a + 3, len(w) + 1):
                for apart in range(11):
                    between = [f"other{rng.randrange(90)}" for _ in range(apart)]
                    for parts in ([*w[a:b], *between, *w], [*w, *between, *w[a:b]], [*w[a:b], *between, *w, *between, *w[a:b]]):
                        docs.append((len(docs) + 1, " ".join(parts)))
                        sizes[len(docs)] = label
    got = scan(spark, docs)
    assert got[1].labels == got[2].labels == "mit" and got[1].score == 1.0 and abs(got[2].score - 0.8) < 1e-9
    assert all(label in got[i].labels.split(",") and got[i].score == 1.0 for i, label in sizes.items())


def test_a_to_z_are_lowered_in_words_with_other_letters(spark):
    docs = spark.createDataFrame([(1, "under \u00c91 \u00c9lan \u00c9vasion licence ok"), (2, "\u00c9lan \u00c9VASION LICENCE"), (3, "\u00e9lan \u00e9vasion licence")], SCHEMA)
    got = {r.doc_id: r.labels for r in license_scan.license_scan(docs, [("elan", "\u00c9lan \u00c9VASION licence")]).collect()}
    assert got == {1: "elan", 2: "elan", 3: ""}


def test_templates_too_long_for_the_aligner_are_an_error(spark):
    docs = spark.createDataFrame([(1, "a b c")], SCHEMA)
    with pytest.raises(ValueError, match="more than 50000 words"):
        license_scan.license_scan(docs, [("long", "word " * 60000)])
