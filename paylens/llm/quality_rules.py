"""Quality rules: counts per document, and divergence of its histograms from those of languages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch
from .native import let, runs_hashed, words_of

SPACES = r"[\x20\x09-\x0D]"

# Frequent function words by language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "it", "that", "for", "with", "as", "are"],
    "de": ["der", "die", "und", "das", "den", "von", "zu", "mit", "ein", "nicht", "auf", "im"],
    "fr": ["de", "la", "le", "et", "les", "des", "un", "une", "que", "qui", "est", "pour"],
    "es": ["de", "la", "que", "el", "en", "los", "se", "del", "las", "un", "por", "con"],
}
WORD_LIST = sorted({w for words in COMMON_WORDS.values() for w in words})
CHARACTER_CLASSES = ["symbol", "upper", "digit", "punctuation", "wide", "other"]


def occurrences(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def repeated_words(words: Column, window: int) -> Column:
    """How many words lie in a window of consecutive words that occurs twice or more, all its places counted."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def covered(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            n = F.size(s) - 1
            twins = F.zip_with(F.slice(s, F.lit(1), n), F.slice(s, F.lit(2), n), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)).otherwise(F.array().cast("array<int>")))
            return F.array_sort(F.array_distinct(F.flatten(twins)))

        def length(p: Column) -> Column:
            steps = F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window))))
            return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

        return let(let(ordered, places), length)

    return let(runs_hashed(hashes, window), lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), F.lit(0)).otherwise(covered(r))).cast("long")


def document_counts(docs: DataFrame, window: int = 8) -> DataFrame:
    """Per row of docs(doc_id, text, lang): the base counts, and counts of character classes and common words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    frequent = [x for w in WORD_LIST for x in (w, w.capitalize())]

    def of_words(words: Column) -> Column:
        joined = F.array_join(words, "")
        common = F.concat(F.lit(" "), F.lower(F.array_join(F.filter(words, lambda w: w.isin(frequent)), "  ")), F.lit(" "))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            joined.alias("joined"),
            common.alias("common"),
            repeated_words(words, window).alias("n_repeat_words"),
        )

    rows = docs.select("doc_id", "lang", let(words_of(text, SPACES), of_words).alias("w"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    classes = {"symbol": r"[#*$%&|<>]+", "upper": r"\p{Lu}+", "digit": r"[0-9]+", "punctuation": r"[!\"'()+,\-./:;=?@\[\]\\^_`{}~]+"}
    counted = rows.select(
        "doc_id", "lang", F.col("w.n_words"), F.length("w.joined").cast("long").alias("word_chars"), "n_dup_lines", F.col("w.n_repeat_words"),
        *[occurrences(F.col("w.joined"), p).cast("long").alias(f"n_{name}") for name, p in classes.items()],
        (F.octet_length("w.joined") - F.length("w.joined")).cast("long").alias("n_wide"),
        F.array(*[((F.length("w.common") - F.length(F.replace(F.col("w.common"), F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("int") for w in WORD_LIST]).alias("word_counts"),
    )
    return counted.withColumnRenamed("n_symbol", "n_symbols")


def _shares(counts: list[Column], total: Column) -> Column:
    """Counts as shares of a total, with the rest of it as the last share; all null where the total is 0."""
    rest = F.greatest(total - reduce(lambda a, b: a + b, counts), F.lit(0))
    whole = reduce(lambda a, b: a + b, [*counts, rest])
    return F.array(*[F.try_divide(c, whole).cast("double") for c in [*counts, rest]])


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, 0 to 1, of two arrays of shares."""
    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    total = F.aggregate(F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _references(rows: DataFrame) -> DataFrame:
    """One row with an array of the mean shares by language."""
    means = rows.groupBy("lang").agg(
        F.array(*[F.avg(F.col("classes")[i]) for i in range(len(CHARACTER_CLASSES))]).alias("c"),
        F.array(*[F.avg(F.col("words")[i]) for i in range(len(WORD_LIST) + 1)]).alias("w"),
    )
    return means.agg(F.array_sort(F.collect_list(F.struct("lang", "c", "w"))).alias("refs"))


def _nearest(rows: DataFrame, references: DataFrame) -> DataFrame:
    """rows with best, the language with the nearest words and the distances to it, and foreign: a language without a reference."""
    distances = F.transform("refs", lambda r: F.struct(divergence(F.col("words"), r.w).alias("word_distance"), divergence(F.col("classes"), r.c).alias("character_distance"), r.lang.alias("nearest")))
    foreign = F.col("lang").isNotNull() & ~F.exists("refs", lambda r: r.lang == F.col("lang"))
    return rows.join(F.broadcast(references)).withColumns({"best": F.when(F.col("n_words") > 0, F.array_min(distances)), "foreign": foreign}).drop("refs")


def document_histograms(counts: DataFrame, min_words: int, max_repeat_percent: int) -> DataFrame:
    """document_counts with base_failed, and the shares of character classes and of common words."""
    classes = _shares([F.col(c) for c in ("n_symbols", "n_upper", "n_digit", "n_punctuation", "n_wide")], F.col("word_chars") + F.col("n_wide"))
    words = _shares([F.col("word_counts")[i] for i in range(len(WORD_LIST))], F.col("n_words"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return counts.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), classes.alias("classes"), words.alias("words"))


def language_references(histograms: DataFrame, languages: tuple[str, ...] = tuple(COMMON_WORDS), min_histogram_words: int = 50, max_character_distance: float = 0.35, max_word_distance: float = 0.5) -> DataFrame:
    """One row with refs, the mean shares of each language's documents that pass the base rules and aren't far from the mean of all those.

    Junk that the base rules let pass would blur the means: those far from the first means don't count for the
    second. Written once, the row can judge later corpora by the same measure.
    """
    known = histograms.filter(F.col("lang").isin(list(languages)) & ~F.col("base_failed") & (F.col("n_words") >= min_histogram_words))
    first = _nearest(known, _references(known))
    return _references(first.filter((F.col("best.character_distance") <= max_character_distance) & (F.col("best.word_distance") <= max_word_distance)))


def quality_rules(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, min_histogram_words: int = 50, max_character_distance: float = 0.35, max_word_distance: float = 0.5, max_both: tuple[float, float] = (0.185, 0.21), languages: tuple[str, ...] = tuple(COMMON_WORDS), references: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distances and kept.

    The references are the mean shares, per language, of character classes and common words: those of
    language_references over all documents, unless a row of references is given. A document is compared with
    the language whose words are nearest. It is kept if it passes the base rules and each distance is within
    its bound and not both are over those of max_both, or if it has too few words for a histogram to say
    anything (min_histogram_words), or if there is no reference for its language: then the base rules alone
    decide. A document without lang is held against all references; equal distances go to the first language by name.
    Null text counts as none: 0 words, base_failed. Texts of any length are counted whole. Null ids and
    repeated rows keep rows of their own, an empty table gives an empty one; columns beyond doc_id, text and
    lang are not read. One pass reads the texts; its counts are written once and serve references and
    verdicts. The references have one row a language and are broadcast.
    """
    counts = (scratch or Scratch(docs.sparkSession)).table(document_counts(docs), "quality")
    rows = document_histograms(counts, min_words, max_repeat_percent)
    if references is None:
        references = language_references(rows, languages, min_histogram_words, max_character_distance, max_word_distance)
    judged = _nearest(rows, references)
    far_in_both = (F.col("best.character_distance") > max_both[0]) & (F.col("best.word_distance") > max_both[1])
    near = (F.col("best.character_distance") <= max_character_distance) & (F.col("best.word_distance") <= max_word_distance) & ~far_in_both
    fits = (F.col("n_words") < min_histogram_words) | F.col("best").isNull() | F.col("foreign") | near
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fits).alias("kept"),
        F.col("best.nearest").alias("nearest_language"), F.col("best.character_distance"), F.col("best.word_distance"),
    )
