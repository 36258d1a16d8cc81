"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact weighted similarity."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, free_name
from .native import runs_hashed, words_of

SPACES = r"[\x20\x09-\x0D]"
BITS, BLOCKS = 64, 8
DOC = ["doc_id", "text_key"]
# Windows of a region share a running sum; size is that of an item in shingles of width words.
REGION = [*DOC, "width", "size", "low"]


def word_hashes(text: Column) -> Column:
    """A hash of each word of a text, in lower case."""
    return F.transform(words_of(text, SPACES), lambda w: F.xxhash64(F.lower(w)))


def lane_bits(most: int) -> int:
    """Bits for a count of up to most, where the sums below are packed: 16 for windows up to 32767 shingles, else 32."""
    return 16 if most < 1 << 15 else 32


def _mask(lane: int, lanes: int) -> int:
    return sum(1 << lane * k for k in range(lanes))


def ballots(h: Column, lane: int) -> list[Column]:
    """The bits of a hash as addends: of number j, lane k holds bit lane * k + j. A null hash adds nothing."""
    mask = F.lit(_mask(lane, BITS // lane))
    return [F.coalesce(F.shiftrightunsigned(h, j).bitwiseAND(mask), F.lit(0)) for j in range(lane)]


def majority(sums: list[Column], voters: Column, lane: int) -> Column:
    """The fingerprint: each bit that more than half of the voters have.

    A lane whose count passes half of the voters carries into its top bit once the rest to that is added; the
    last lane is taken by itself, as its top bit is the sign.
    """
    top = BITS - lane
    rest = F.lit((1 << lane - 1) - 1) - F.shiftright(voters, 1).cast("long")
    low, carries = F.lit(_mask(lane, BITS // lane - 1)), F.lit(_mask(lane, BITS // lane - 1) << lane - 1)

    def passed(total: Column) -> Column:
        below = (total.bitwiseAND((1 << top) - 1) + rest * low).bitwiseAND(carries)
        last = F.shiftleft((F.shiftrightunsigned(total, top) + rest).bitwiseAND(1 << lane - 1), top - lane + 1)
        return F.shiftrightunsigned(below, lane - 1).bitwiseOR(last)

    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(passed(v), j) for j, v in enumerate(sums)])


def block(fingerprint: Column, i: int) -> Column:
    width = BITS // BLOCKS
    return F.shiftrightunsigned(fingerprint, i * width).bitwiseAND((1 << width) - 1)


def bounded(df: DataFrame, rows: int, most: int) -> DataFrame:
    """With a broadcast hint where the table is known to have few rows; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if rows <= most else df


def benchmark_items(benchmark: DataFrame, k: int) -> DataFrame:
    """item_id, item_key, width, grams and size of each item with a word: shingles of k words, or all words as one if they are fewer."""
    words = benchmark.select("item_id", F.xxhash64("text").alias("item_key"), word_hashes(F.col("text")).alias("words")).filter(F.size("words") > 0).distinct()
    of_width = [F.when(F.size("words") == w, runs_hashed(F.col("words"), w)) for w in range(1, k)]
    grams = F.coalesce(*of_width, runs_hashed(F.col("words"), k))
    return words.select("item_id", "item_key", F.least(F.size("words"), F.lit(k)).alias("width"), grams.alias("grams")).withColumn("size", F.size("grams"))


def regions(docs: DataFrame, places: DataFrame, widths: list[int], min_similarity: float) -> DataFrame:
    """REGION, n, high and hits: the runs of starts, low to high, at which a window might be similar enough to an item of its size.

    hits are the places and hashes of shingles that items of that size have. A window of similarity s with an
    item shares s times the item's shingles or more with it, so windows without so many hits are passed over;
    hits further apart than a window can afford belong to regions of their own.
    """
    words = docs.select("doc_id", F.xxhash64("text").alias("text_key"), word_hashes(F.col("text")).alias("words"))
    each = reduce(DataFrame.unionByName, [
        words.select(*DOC, F.lit(w).alias("width"), runs_hashed(F.col("words"), w).alias("grams")).select(*DOC, "width", F.size("grams").alias("n"), F.posexplode("grams").alias("at", "gram"))
        for w in widths
    ])
    hits = each.join(places, ["width", "gram"]).groupBy(*DOC, "width", "size").agg(F.max("n").alias("n"), F.collect_set(F.struct("at", "gram")).alias("hits"))
    least = F.ceil(F.lit(min_similarity) * F.col("size") - 1e-9).cast("int")
    hits = hits.filter(F.size("hits") >= least).withColumn("hit", F.explode("hits")).drop("hits")

    in_order = Window.partitionBy(*DOC, "width", "size").orderBy("hit.at")
    apart = F.when(F.col("hit.at") - F.lag("hit.at").over(in_order) <= F.col("size") - least + 1, 0).otherwise(1)
    runs = hits.withColumn("new", apart).withColumn("run", F.sum("new").over(in_order))
    runs = runs.groupBy(*DOC, "width", "size", "run").agg(F.max("n").alias("n"), F.min("hit.at").alias("first"), F.max("hit.at").alias("last"), F.sort_array(F.collect_list("hit")).alias("hits"))
    runs = runs.filter(F.size("hits") >= least)
    return runs.select(*DOC, "width", "size", (F.col("first") - F.col("size") + least).alias("low"), "n", (F.col("last") - least + 1).alias("high"), "hits")


def fingerprints(docs: DataFrame, found: DataFrame, few: bool, widths: list[int], lane: int) -> DataFrame:
    """REGION, start, n_window and fingerprint of every window of the regions found.

    The bits of a shingle's hash are counted in from the window that begins size - 1 places before it, and out
    again from the one after it, so a running sum over the starts holds the counts of every window.
    """
    own = found.groupBy(*DOC).agg(F.collect_list(F.struct("width", "size", "low", "high", "n")).alias("regions"))
    own = own.withColumnsRenamed({"doc_id": "own_id", "text_key": "own_key"})
    own = F.broadcast(own) if few else own
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    texts = keyed.join(own, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key"))).drop("own_id", "own_key")
    # Rows that repeat both doc_id and text are one document.
    texts = texts.groupBy(*DOC).agg(F.first("text").alias("text"), F.first("regions").alias("regions"))
    grams = texts.select(*DOC, "regions", word_hashes(F.col("text")).alias("words")).select(*DOC, F.explode("regions").alias("r"), *[runs_hashed(F.col("words"), w).alias(f"g{w}") for w in widths])
    starts = grams.select(*DOC, "r.*", *[f"g{w}" for w in widths]).withColumn("start", F.explode(F.sequence(F.col("low") - F.col("size") + 1, F.col("high"))))

    def gram(at: Column) -> Column:
        return F.coalesce(*[F.when(F.col("width") == w, F.get(f"g{w}", at)) for w in widths])

    moved = starts.select(*REGION, "n", "start", gram(F.col("start") + F.col("size") - 1).alias("enters"), F.when(F.col("start") > F.col("low"), gram(F.col("start") - 1)).alias("leaves"))
    before = Window.partitionBy(*REGION).orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    votes = [F.sum(i - o).over(before).alias(f"v{j}") for j, (i, o) in enumerate(zip(ballots(F.col("enters"), lane), ballots(F.col("leaves"), lane), strict=True))]
    n_window = F.least(F.col("start") + F.col("size"), F.col("n")) - F.greatest(F.col("start"), F.lit(0))
    counted = moved.select(*REGION, "start", n_window.alias("n_window"), *votes).filter(F.col("start") >= F.col("low"))
    return counted.select(*REGION, "start", "n_window", majority([F.col(f"v{j}") for j in range(lane)], F.col("n_window"), lane).alias("fingerprint"))


def near_pairs(windows: DataFrame, items: DataFrame, lane: int, radius: int, few: bool) -> DataFrame:
    """windows with item_id and item_key of every item of their size whose fingerprint is within the radius, each once.

    By the pigeonhole principle two such fingerprints have one of the 8 blocks within radius // 8 bits, so
    items are listed under all such neighbours of their blocks and windows under their own blocks. A pair
    that meets in several blocks is taken at the first of them.
    """
    slack = radius // BLOCKS
    flips = [sum(1 << b for b in bits) for n in range(slack + 1) for bits in combinations(range(BITS // BLOCKS), n)]
    counts = items.select("item_id", "item_key", "width", "size", F.explode("grams").alias("gram")).groupBy("item_id", "item_key", "width", "size").agg(*[F.sum(b).alias(f"v{j}") for j, b in enumerate(ballots(F.col("gram"), lane))])
    printed = counts.select("item_id", "item_key", "width", "size", majority([F.col(f"v{j}") for j in range(lane)], F.col("size"), lane).alias("item_print"))
    listed = printed.select("*", F.posexplode(F.array(*[block(F.col("item_print"), i) for i in range(BLOCKS)])).alias("i", "v"))
    listed = listed.select("item_id", "item_key", "width", "size", "item_print", "i", F.explode(F.transform(F.array(*[F.lit(x) for x in flips]), lambda x: F.col("v").bitwiseXOR(x))).alias("value"))
    own = windows.select("*", F.posexplode(F.array(*[block(F.col("fingerprint"), i) for i in range(BLOCKS)])).alias("i", "value"))
    met = own.join(F.broadcast(listed) if few else listed, ["width", "size", "i", "value"])
    apart = F.col("fingerprint").bitwiseXOR(F.col("item_print"))
    first = F.coalesce(*[F.when(F.bit_count(block(apart, i)) <= slack, i) for i in range(BLOCKS)])
    return met.filter((F.bit_count(apart) <= radius) & (first == F.col("i"))).select(*REGION, "start", "n_window", "item_id", "item_key")


def leaking_windows(docs: DataFrame, benchmark: DataFrame, k: int, min_similarity: float, radius: int, broadcast_rows: int, scratch: Scratch) -> DataFrame:
    """DOC, width, size, start, n_window, item_id, item_key and similarity of every window of a document that is similar enough to an item."""
    items = scratch.table(benchmark_items(benchmark, k), "items")
    # The benchmark's extent decides how the joins below are run, not what they give.
    extent = items.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), F.coalesce(F.max("size"), F.lit(1)), F.collect_set("width")).first()
    widths, lane = sorted(extent[3]) or [k], lane_bits(extent[2])
    listed = items.select("item_id", "item_key", "width", "size", F.explode("grams").alias("gram"))
    places = bounded(listed.select("width", "size", "gram").distinct(), extent[0], broadcast_rows)

    found = scratch.table(regions(docs, places, widths, min_similarity), "regions")
    few = found.count() <= broadcast_rows // 10
    windows = fingerprints(docs, found.drop("hits"), few, widths, lane)
    pairs = near_pairs(windows, items, lane, radius, extent[1] * BLOCKS * 37 <= broadcast_rows)

    hits = found.select(*[F.col(c).alias(f"own_{c}") for c in REGION], "hits")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in REGION])
    inside = F.filter("hits", lambda h: (h.at >= F.col("start")) & (h.at < F.col("start") + F.col("size")))
    one = [*REGION, "start", "n_window", "item_id", "item_key"]
    held = pairs.join(hits, same).select(*one, F.explode(inside).alias("hit")).groupBy(*one, F.col("hit.gram").alias("gram")).agg(F.count("*").alias("n"))
    counts = listed.groupBy("item_id", "item_key", "gram").agg(F.count("*").alias("n_item")).withColumnsRenamed({"item_id": "its_id", "item_key": "its_key", "gram": "its_gram"})
    both = held.join(bounded(counts, extent[0], broadcast_rows), F.col("item_id").eqNullSafe(F.col("its_id")) & (F.col("item_key") == F.col("its_key")) & (F.col("gram") == F.col("its_gram")))
    shared = both.groupBy(*one).agg(F.sum(F.least("n", "n_item")).alias("both"))
    similarity = F.col("both") / (F.col("n_window") + F.col("size") - F.col("both"))
    return shared.select(*DOC, "width", "size", "start", "n_window", "item_id", "item_key", similarity.alias("similarity")).filter(F.col("similarity") >= min_similarity)


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, min_similarity: float = 0.8, radius: int = 23, broadcast_rows: int = 500_000, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, item_id, similarity, first_word, last_word: the best window of each document for each item in it.

    A window has as many shingles (k words in lower case each) as the item, at any place of the whole text;
    at its ends it is cut off. An item of fewer than k words is one shingle of all its words. Windows get a
    SimHash from running counts of the bits of their shingles' hashes; those that hold fewer of the benchmark's
    shingles than the similarity takes are passed over before that. A join over 8 Hamming blocks finds all
    items within the radius of a window, and nothing else makes a pair. Pairs are verified by the exact
    weighted similarity: shared shingles over all, with repeats (multiset Jaccard). Shingles whose
    share is 0.8 differ in 10 of 64 bits on average, so a radius of 23 lets 1 in 10**5 pass by. Ties go to
    the first window, then to the longest.

    Null and empty texts have no words and match nothing. Texts may be of any length: of their words only the
    benchmark's shingles leave a task. Rows that repeat both doc_id and text are one document; rows that
    repeat a doc_id alone, null ids too, give the best window of any of them. Repeated items count once, items that repeat an
    id count as one with several texts. Empty tables give no rows; other columns aren't read. The item tables
    are broadcast only if they have at most broadcast_rows rows, and joined by a shuffle beyond.
    """
    found = leaking_windows(docs, benchmark, k, min_similarity, radius, broadcast_rows, scratch or Scratch(docs.sparkSession))
    ranked = F.struct("similarity", (-F.greatest("start", F.lit(0))).alias("back"), "n_window", "width")
    best = found.groupBy("doc_id", "item_id").agg(F.max(ranked).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.back")).cast("long").alias("first_word"), (-F.col("b.back") + F.col("b.n_window") + F.col("b.width") - 2).cast("long").alias("last_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 5, min_similarity: float = 0.8, radius: int = 23, broadcast_rows: int = 500_000, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs whose own text holds no leak, whatever other rows share their doc_id; options as in find_leaks."""
    found = leaking_windows(docs, benchmark, k, min_similarity, radius, broadcast_rows, scratch or Scratch(docs.sparkSession))
    own, key = free_name("leaking_id", docs), free_name("leaking_key", docs)
    leaks = found.select(F.col("doc_id").alias(own), F.col("text_key").alias(key)).distinct()
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(key)), "left_anti")
