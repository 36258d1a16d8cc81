"""License scans: rolling word k-grams joined to template positions, votes by diagonal, spans verified word by word."""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Scratch
from .native import let, runs_hashed, words_of

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
DOC = ["doc_id", "text_key"]
MAX_TEMPLATE_WORDS = 50_000

# The base phrases with their labels, and public notices and licences by SPDX-like label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
        " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS,"
        " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
        " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
        " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"
        " and/or other materials provided with the distribution."
        " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,"
        " THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
        " IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
        " (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
        " HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)"
        " ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl", "licensed under the GNU General Public License, version"),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by"
        " the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
        " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or"
        " FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies."
        " THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
        " IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,"
        " WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software),"
        " to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,"
        " and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
        " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
        " THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,"
        " FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,"
        " WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
]


def hashed_words(text: Column) -> Column:
    """A hash for each word; A-Z alone count as lower case, in words with other letters too."""

    def lowered(w: Column) -> Column:
        # What lower() leaves alone has no A-Z; translate() is for the few words that are neither.
        return F.when(F.octet_length(w) == F.length(w), F.lower(w)).when(w == F.lower(w), w).otherwise(F.translate(w, ascii_uppercase, ascii_lowercase))

    return F.transform(words_of(text, SEPARATORS), lambda w: F.xxhash64(lowered(w)))


def template_words(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """template, label and pattern, the hashes of its words.

    The aligner writes a template's places as characters, which are too few for longer ones.
    """
    for label, text in templates:
        if len(re.split(f"{SEPARATORS}+", text)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"a template of {label} has more than {MAX_TEMPLATE_WORDS} words")
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    return rows.select("template", "label", hashed_words(F.col("text")).alias("pattern"))


def phrase_hashes(spark: SparkSession) -> dict[str, int]:
    """The hash of each base phrase, over as many words as it has."""
    return spark.range(1).select(*[F.element_at(runs_hashed(hashed_words(F.lit(p)), len(p.split())), 1).alias(p) for p in PHRASES]).first().asDict()


def edits(words: Column, pattern: Column) -> Column:
    """How many words have to be put in, left out or replaced to make the pattern of the words.

    Both are written with one character for each word: its place in the pattern, the same for all other words.
    """
    def spelled(values: Column) -> Column:
        codes = F.transform(values, lambda w: F.lpad(F.hex(F.array_position(pattern, w) + 256), 4, "0"))
        return F.decode(F.unhex(F.array_join(codes, "")), "UTF-16BE")

    return F.levenshtein(spelled(words), spelled(pattern))


def license_scan(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, k: int = 3, max_shift: int = 3, min_votes: float = 0.4, min_coverage: float = 0.6, broadcast_rows: int = 500_000, scratch: Scratch | None = None
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and n_spans, per row of docs(doc_id, text).

    Each rolling k-gram of words is joined to the places where templates have it. Hits of a document on the
    same template with the same offset (word minus template word) vote together; neighbouring offsets, at
    most max_shift apart, merge, as a word put in or left out shifts what follows. What lies from one diagonal of a
    merged band to another is verified where it has votes for min_votes of the template's k-grams and is no
    wider than the edits that min_coverage allows, so a repeated part beside a notice can't spoil it: the
    document's words from where the first diagonal puts the template's first word to where the other puts
    its last are compared with the template's in order, and are a license span if the words that agree, all but
    the least number of edits, are min_coverage of the template. score is the largest such coverage, 0 without
    a span and 1 with a base phrase; n_spans counts bands with a span. Templates are a parameter, longer ones
    than MAX_TEMPLATE_WORDS an error; they are broadcast up to broadcast_rows words in all; with fewer than k
    words they never match.
    Null text has no words, and texts of any length are scanned whole; null ids and repeated rows keep rows of
    their own (equal rows share one scan), an empty table gives an empty one, other columns aren't read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    templates = TEMPLATES if templates is None else templates
    found, few = phrase_hashes(spark), sum(len(text.split()) for _, text in templates) <= broadcast_rows
    patterns = template_words(spark, templates)
    grams = patterns.select("template", "label", F.size("pattern").alias("size"), runs_hashed(F.col("pattern"), k).alias("grams"))
    known = grams.select("template", "label", "size", F.size("grams").alias("grams"), F.posexplode("grams").alias("at", "gram"))
    keyed = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_key"), F.col("text"))

    def base(h: Column) -> Column:
        def places(phrase: str) -> Column:
            runs, none = runs_hashed(h, len(phrase.split())), F.array().cast("array<bigint>")
            return let(runs, lambda r: F.when(F.array_contains(r, F.lit(found[phrase])), F.array_compact(F.transform(r, lambda x, i: F.when(x == found[phrase], i.cast("long"))))).otherwise(none))

        return F.struct(F.size(h).cast("long").alias("n_words"), *[places(p).alias(label) for p, label in PHRASES.items()])

    counted = keyed.select(*DOC, let(hashed_words(F.col("text")), base).alias("b")).select(*DOC, "b.*")
    places = [F.col(f"`{label}`") for label in PHRASES.values()]
    counted = counted.select(
        *DOC, "n_words", sum((F.size(p) for p in places[1:]), F.size(places[0])).cast("long").alias("n_base"),
        F.array_min(F.concat(*places)).alias("first_word"), F.array_max(F.concat(*places)).alias("last_word"),
        F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(places, PHRASES.values(), strict=True)])).alias("base"),
    )

    rolling = keyed.select(*DOC, F.posexplode(runs_hashed(hashed_words(F.col("text")), k)).alias("word", "gram"))
    hits = rolling.join(F.broadcast(known) if few else known, "gram").select(*DOC, "template", "label", "size", "grams", "at", (F.col("word") - F.col("at")).alias("diagonal"))
    votes = hits.groupBy(*DOC, "template", "label", "size", "grams", "diagonal").agg(F.collect_set("at").alias("ats"))
    by_template = Window.partitionBy(*DOC, "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(by_template) <= max_shift, 0).otherwise(1)
    merged = votes.withColumn("new", apart).withColumn("band", F.sum("new").over(by_template))
    # An edit shifts by one word at most, so a span's diagonals are no further apart than its edits may be.
    allowed = F.floor(F.round((1 - min_coverage) * F.col("size"), 6))
    widest = int((1 - min_coverage) * max((len(re.split(f"{SEPARATORS}+", text)) for _, text in templates), default=0)) + 1
    following = F.array_sort(F.collect_list(F.struct("diagonal", "band", "ats")).over(by_template.rangeBetween(0, widest)))
    own = F.filter(following, lambda x: (x.band == F.col("band")) & (x.diagonal - F.col("diagonal") <= allowed))

    def ends(near: Column) -> Column:
        return F.transform(near, lambda x, i: F.struct(x.diagonal.alias("high"), F.size(F.array_distinct(F.flatten(F.transform(F.slice(near, F.lit(1), i + 1), lambda y: y.ats)))).alias("hit")))

    bands = merged.select(*DOC, "template", "label", "size", "grams", "band", F.col("diagonal").alias("low"), own.alias("near"))
    voted = bands.select(*DOC, "template", "label", "size", "band", "low", F.explode(F.filter(let(F.col("near"), ends), lambda e: e.hit >= F.lit(min_votes) * F.col("grams"))).alias("end"))
    likely = scratch.table(voted.select(*DOC, F.struct("template", "label", "size", "band", "low", "end.high").alias("place")), "bands")

    right = likely.groupBy(*DOC).agg(F.collect_list("place").alias("places")).withColumnsRenamed({"doc_id": "right_id", "text_key": "right_key"})
    right = F.broadcast(right) if likely.count() <= broadcast_rows // 10 else right
    same = F.col("doc_id").eqNullSafe(F.col("right_id")) & (F.col("text_key") == F.col("right_key"))

    def spans_of(words: Column) -> Column:
        def span(p: Column) -> Column:
            at = F.greatest(p.low, F.lit(0))
            return F.struct(p.template.alias("template"), p.label.alias("label"), p["size"].alias("size"), p.band.alias("band"), F.slice(words, at + 1, F.greatest(F.least(p.high + p["size"], F.size(words)) - at, F.lit(0))).alias("span"))

        return F.transform("places", span)

    asked = keyed.join(right, same).select(*DOC, "text", "places").dropDuplicates(DOC)
    spans = asked.select(*DOC, F.explode(let(hashed_words(F.col("text")), spans_of)).alias("s")).select(*DOC, "s.*")
    aligned = spans.join(F.broadcast(patterns.select("template", "pattern")) if few else patterns.select("template", "pattern"), "template")
    verified = aligned.select(*DOC, "template", "label", "band", (1 - edits(F.col("span"), F.col("pattern")) / F.col("size")).alias("coverage")).filter(F.col("coverage") >= min_coverage)
    verified = verified.groupBy(*DOC, "template", "label", "band").agg(F.max("coverage").alias("coverage"))
    by_document = verified.groupBy(*DOC).agg(F.collect_set("label").alias("found"), F.max("coverage").alias("coverage"), F.count("*").alias("n_spans"))

    joined = counted.join(by_document.withColumnsRenamed({"doc_id": "right_id", "text_key": "right_key"}), same, "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("coverage", F.lit(0.0))).alias("score"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
    )
