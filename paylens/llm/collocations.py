"""Phrases whose words stand together more often than chance would have them, by language.

Words that are frequent enough get ids, texts become runs of ids, and runs of 2 to 5 ids are counted level by level
in counting quotient filters: each task fills one, its shards go to the tasks that merge them. Before a run is
counted, both shorter runs in it must be frequent, as a phrase isn't more frequent than its parts; that is looked up in a
bitmap of fixed size, where a false hit costs work only. So counts are exact, and what is broadcast doesn't grow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch, mix64, small, utf8_values, word_hashes
from .quotient_filter import CountingQuotientFilter, Layout

# Bytes of texts that are looked at together, and entries of a task's filter before its shards are sent on.
CHUNK, ENTRIES = 1_000_000, 1_500_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# 0 in words, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[9, 32]] = 1
KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2
BREAKS = KIND == 2


def language_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes]]]:
    """Languages and texts, about CHUNK bytes at a time; a longer text is cut between pieces, where there are such places."""
    langs, texts, held = [], [], 0
    for batch in small(batches, 200):
        for lang, text in zip(batch.column(0).to_pylist(), utf8_values(batch.column(1)), strict=True):
            while text:
                part, text = text, b""
                if len(part) > 2 * CHUNK:
                    ends = np.flatnonzero(BREAKS[np.frombuffer(part, np.uint8, len(part) - CHUNK, CHUNK)])
                    if len(ends):
                        part, text = part[: CHUNK + int(ends[0]) + 1], part[CHUNK + int(ends[0]) + 1 :]
                langs.append(lang)
                texts.append(part)
                held += len(part)
                if held >= CHUNK:
                    yield langs, texts
                    langs, texts, held = [], [], 0
    if texts:
        yield langs, texts


class Words:
    """The words of some texts: bounds in the joined text in lower case, hash with the language, piece, text."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        self.text = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
        kind = KIND[self.text]
        edge = np.diff(np.concatenate([[True], kind > 0]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.starts]
        sizes = np.cumsum([len(t) + 1 for t in texts])
        self.doc = np.searchsorted(sizes, self.starts, side="right")
        by_lang = {lang: language_hash(lang) for lang in set(langs)}
        of_doc = np.array([by_lang[lang] for lang in langs], np.uint64)
        self.hashes = mix64(word_hashes(self.text, self.starts, self.ends) ^ of_doc[self.doc])


def count_words(texts: DataFrame) -> DataFrame:
    """lang, word and f; the row without a word has the number of all words of its language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        names: dict[int, tuple[str, bytes]] = {}
        totals: dict[str, int] = {}

        def rows() -> pa.RecordBatch:
            found = [(*names[h], n) for h, n in counts.items()] + [(lang, None, n) for lang, n in totals.items()]
            columns = zip(*found, strict=True) if found else ((), (), ())
            kinds = (pa.string(), pa.binary(), pa.int64())
            lang, word, f = (pa.array(c, k) for c, k in zip(columns, kinds, strict=True))
            return pa.RecordBatch.from_arrays([lang, word, f], ["lang", "word", "f"])

        for langs, texts in chunks(batches):
            words = Words(langs, texts)
            raw = words.text.tobytes()
            keys, first, n = np.unique(words.hashes, return_index=True, return_counts=True)
            starts, ends, docs = words.starts[first].tolist(), words.ends[first].tolist(), words.doc[first].tolist()
            for i, (h, count) in enumerate(zip(keys.tolist(), n.tolist(), strict=True)):
                if h in counts:
                    counts[h] += count
                else:
                    counts[h] = count
                    names[h] = langs[docs[i]], raw[starts[i] : ends[i]]
            for doc, count in enumerate(np.bincount(words.doc, minlength=len(texts)).tolist()):
                totals[langs[doc]] = totals.get(langs[doc], 0) + count
            if len(counts) > 300_000:
                yield rows()
                counts.clear()
                names.clear()
                totals.clear()
        yield rows()

    found = texts.mapInArrow(run, "lang string, word binary, f long")
    return found.groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.sum("f").alias("f"))


def numbered(words: DataFrame, buckets: int = 256) -> DataFrame:
    """words with ids from 0 on, without a gap: rows are numbered within buckets, which are counted first."""
    dealt = words.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(buckets)))
    sizes = {r.bucket: r.n for r in dealt.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    starts = np.cumsum([0, *[sizes.get(b, 0) for b in range(buckets)]]).tolist()
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "word"))
    start = F.element_at(F.array(*[F.lit(s) for s in starts]), (F.col("bucket") + 1).cast("int"))
    return dealt.withColumn("id", (start + place - 1).cast("long")).drop("bucket")


def with_hashes(words: DataFrame) -> DataFrame:
    """hash and id of words, as Words has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = Words(batch.column(0).to_pylist(), utf8_values(batch.column(1))).hashes  # one of each, as words have no separators
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column(2)], ["hash", "id"])

    return words.select("lang", "word", "id").mapInArrow(run, "hash long, id long")


def runs_of_ids(words: Words, keys: np.ndarray, ids: np.ndarray, none: int) -> np.ndarray:
    """Ids of words with `none` between runs; keys are sorted hashes. Runs of one word are left out, nothing begins in them."""
    at = keys.searchsorted(words.hashes)
    at[at == len(keys)] = 0
    found = np.where(keys[at] == words.hashes, ids[at], none) if len(keys) else np.full(len(at), none)
    broken = np.diff(words.piece, prepend=words.piece[:1]) != 0
    out = np.full(len(found) + int(broken.sum()) + 2, none, np.uint32)
    out[np.arange(1, len(found) + 1) + np.cumsum(broken)] = found
    gap = out == none
    alone = ~gap[1:-1] & gap[:-2] & gap[2:]
    out[1:-1][alone] = none
    gap = out == none
    return out[~(gap & np.concatenate([[True], gap[:-1]]))]


def planes(ids: np.ndarray, size: int) -> bytes:
    """Numbers by bytes of equal weight, which compress better."""
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :size].T.tobytes()


def from_planes(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 4), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(size, -1).T
    return out.view("<u4").ravel().astype(np.uint64)


def id_runs(texts: DataFrame, dictionary: DataFrame, n_words: int, bits: int, broadcast_words: int, scratch: Scratch) -> DataFrame:
    """Texts as runs of ids, in bytes. Up to broadcast_words words the dictionary is broadcast, beyond that it is joined to each text's words."""
    none, size, hashed = (1 << bits) - 1, (bits + 7) // 8, with_hashes(dictionary)
    if n_words <= broadcast_words:
        found = hashed.toArrow()
        keys = found.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two words have one hash")
        known = texts.sparkSession.sparkContext.broadcast((keys[order], found.column("id").to_numpy()[order].astype(np.uint32)))

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in chunks(batches):
                out = planes(runs_of_ids(Words(*part), *known.value, none), size)
                yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["runs"])

        return texts.mapInArrow(coded, "runs binary")

    rows = scratch.table(texts.withColumn("row", F.monotonically_increasing_id()), "texts")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 100):
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                found = {int(h) for piece in chunks(iter([part])) for h in np.unique(Words(*piece).hashes).view(np.int64)}
                yield pa.RecordBatch.from_arrays([pa.array([part.column(2)[0].as_py()] * len(found), pa.int64()), pa.array(sorted(found), pa.int64())], ["row", "hash"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 100):
            for i in range(batch.num_rows):
                pairs = batch.column(2)[i].as_py() or []
                keys = np.array([p["hash"] for p in pairs], np.int64).view(np.uint64)
                order = np.argsort(keys)
                ids = np.array([p["id"] for p in pairs], np.uint32)[order]
                for part in chunks(iter([batch.slice(i, 1)])):
                    yield pa.RecordBatch.from_arrays([pa.array([planes(runs_of_ids(Words(*part), keys[order], ids, none), size)], pa.binary())], ["runs"])

    held = rows.select("lang", "text", "row").mapInArrow(distinct, "row long, hash long").join(hashed, "hash")
    own = held.groupBy("row").agg(F.collect_list(F.struct("hash", "id")).alias("own"))  # as many as one text has
    return rows.join(own, "row", "left").select("lang", "text", "own").mapInArrow(joined, "runs binary")


def places(ids: np.ndarray, none: int, k: int) -> np.ndarray:
    """Whether k ids of one run begin at each place."""
    real = ids != none
    out = real[: max(len(ids) - k + 1, 0)].copy()
    for i in range(1, k):
        out &= real[i : i + len(out)]
    return out


def bit_places(layout: Layout, lanes: list[np.ndarray], bits: int) -> np.ndarray:
    h = np.zeros(len(lanes[0]), np.uint64)
    for lane in lanes:
        h = mix64(h + lane + np.uint64(layout.k))
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def bitmap_of(grams: DataFrame, k: int, id_bits: int, bits: int) -> np.ndarray:
    """A bitmap with the bits of these phrases of k words; its size is fixed, parts of it come from the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = Layout(k, id_bits)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u4").astype(np.uint64)
            at = bit_places(layout, layout.pack(ids, np.arange(0, len(ids), k)), bits)
            yield pa.RecordBatch.from_arrays([pa.array(at + 1)], ["at"])

    out = np.zeros(1 << bits - 3, np.uint8)
    marked = grams.select("gram").mapInArrow(run, "at long")
    parts = marked.groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map"))
    for r in parts.toLocalIterator():
        out[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.map, np.uint8)[: len(out)]
    return out


def count_phrases(runs: DataFrame, k: int, id_bits: int, least: int, shard_bits: int, shorter: DataFrame | None, bitmap_bits: int) -> DataFrame:
    """gram (its ids, four bytes each) and f of the phrases of k words that stand at least so often; shorter: those of k - 1."""
    none, size = (1 << id_bits) - 1, (id_bits + 7) // 8
    spark = runs.sparkSession
    bitmap = spark.sparkContext.broadcast(bitmap_of(shorter, k - 1, id_bits, bitmap_bits)) if shorter is not None else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, below = Layout(k, id_bits), Layout(max(k - 1, 2), id_bits)
        counted = CountingQuotientFilter(layout)
        marked = bitmap.value if bitmap else None

        def sent() -> Iterator[pa.RecordBatch]:
            for shard, raw in counted.shards(shard_bits):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([raw], pa.binary())], ["shard", "raw"])

        for batch in batches:
            for raw in batch.column(0):
                ids = from_planes(raw.as_py(), size)
                here = places(ids, none, k)
                if marked is not None:
                    some = np.flatnonzero(places(ids, none, k - 1))
                    at = bit_places(below, below.pack(ids, some), bitmap_bits)
                    held = np.zeros(len(ids) + 1, bool)
                    held[some] = marked[at >> 3] >> (at & 7).astype(np.uint8) & 1
                    here &= held[: len(here)] & held[1 : len(here) + 1]
                counted.add(layout.pack(ids, np.flatnonzero(here)))
                if len(counted) > ENTRIES:
                    counted.settle()
                    if len(counted) > ENTRIES // 2:
                        yield from sent()
                        counted = CountingQuotientFilter(layout)
        yield from sent()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, now, merged = Layout(k, id_bits), None, None

        def kept() -> pa.RecordBatch:
            ids, f = merged.frequent(least)
            raw = ids.astype(">u4").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([raw[i : i + 4 * k] for i in range(0, len(raw), 4 * k)], pa.binary()), pa.array(f)], ["gram", "f"])

        for batch in batches:
            for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != now:
                    if merged is not None:
                        yield kept()
                    now, merged = shard, CountingQuotientFilter(layout)
                merged.add_bytes(raw.as_py(), shard, shard_bits)
        if merged is not None:
            yield kept()

    shards = runs.mapInArrow(count, "shard long, raw binary").repartition("shard").sortWithinPartitions("shard")
    return shards.mapInArrow(merge, "gram binary, f long")


def collocations(
    docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, lang_column: str = "lang", text_column: str = "text",
    broadcast_words: int = 2_000_000, words_per_shard: int = 1_000_000, bitmap_bits: int = 27, scratch: Scratch | None = None,
) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase is 2 to `longest` words in a row within a piece that stand there at least `least` times (a). Its score is
    1000 * a * n over the product of its two parts' counts (l, r), for the cut with the lowest score, ties to the shortest first
    part; n is the number of the language's words. A phrase within a longer one as frequent as itself is left out. Ranks go by
    score, a (both falling), then the phrase's bytes.

    A null language is `und`; null and empty texts have no words; repeated rows count as often as they stand there; an empty
    table gives no rows. Texts are read whole; one beyond 2 MB is cut between pieces. Words of a language are told apart by
    64-bit hashes until they have ids (an equal hash of two frequent words is an error), phrases by their ids. Other columns
    aren't read. Scratch tables stay until scratch is discarded.
    """
    spark: SparkSession = docs.sparkSession
    scratch = scratch or Scratch(spark)
    texts = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), F.col(text_column).cast("string").alias("text"))
    counted = scratch.table(count_words(texts).filter((F.col("f") >= least) | F.col("word").isNull()), "words")
    totals = counted.filter("word is null").select("lang", F.col("f").alias("n"))
    dictionary = scratch.table(numbered(counted.filter("word is not null")), "dictionary")
    n_words = dictionary.count()
    all_words = totals.agg(F.sum("n")).first()[0] or 0
    if n_words >= 1 << 32:
        raise ValueError("more than 2**32 frequent words")
    id_bits = max(n_words + 1, 2).bit_length()
    shard_bits = min(16, max(4, -(-all_words // words_per_shard)).bit_length())
    coded = id_runs(texts, dictionary, n_words, id_bits, broadcast_words, scratch)
    coded.write.option("compression", "zstd").parquet(path := scratch.path("runs"))
    runs, levels = spark.read.schema(coded.schema).parquet(path), []
    for k in range(2, longest + 1):
        levels.append(scratch.table(count_phrases(runs, k, id_bits, least, shard_bits, levels[-1] if levels else None, bitmap_bits), f"phrases-{k}"))
    phrases = levels[0]
    for level in levels[1:]:
        phrases = phrases.unionByName(level)
    return ranked(phrases, dictionary, totals, top)


def ranked(phrases: DataFrame, dictionary: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """Counted phrases (gram, f) with names, best cuts and ranks."""
    k = F.length("gram") / 4
    piece = lambda first, n: F.substring("gram", first * 4 + 1, n * 4)
    rows = phrases.select("gram", F.col("f").alias("a"), k.cast("int").alias("k"))
    # A longer phrase as frequent as one within it has, of every length between, one that is so too: one word more is enough.
    within = rows.filter("k > 2").select("a", F.explode(F.array(piece(F.lit(0), F.col("k") - 1), piece(F.lit(1), F.col("k") - 1))).alias("gram"))
    covered = within.groupBy("gram").agg(F.max("a").alias("longer"))
    kept = rows.join(covered, "gram", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("a"))).drop("longer")

    # Big-endian bytes of an id, as they stand in a phrase.
    singles = dictionary.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("part"), "f", "lang", "word")
    counts = singles.select("part", "f").unionByName(phrases.select(F.col("gram").alias("part"), "f"))
    cuts = kept.select("gram", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("gram", "cut", piece(F.lit(0), F.col("cut")).alias("first"), piece(F.col("cut"), F.col("k") - F.col("cut")).alias("rest"))
    cuts = cuts.join(counts.select(F.col("part").alias("first"), F.col("f").alias("l")), "first").join(counts.select(F.col("part").alias("rest"), F.col("f").alias("r")), "rest")
    cuts = cuts.groupBy("gram").agg(F.collect_list(F.struct("cut", "l", "r")).alias("cuts"))

    named = kept.select("gram", "a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("at")).withColumn("part", piece(F.col("at"), F.lit(1)))
    named = named.join(singles.drop("f"), "part").groupBy("gram", "a").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"), F.first("lang").alias("lang"))
    named = named.select("gram", "a", "lang", F.array_join("words.word", " ").alias("phrase")).join(totals, "lang")

    both = named.join(cuts, "gram").select("lang", "phrase", "a", "n", F.explode("cuts").alias("c")).select("lang", "phrase", "a", "n", "c.*")
    big = "cast({} as decimal(18,0))".format
    score = F.expr(f"(cast(1000 as decimal(4,0)) * {big('a')} * {big('n')}) div ({big('l')} * {big('r')})")
    best = both.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select("lang", "phrase", "a", "n", "b.l", "b.r", "b.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's phrases are dealt over 64 parts, whose first ones meet.
    dealt = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return last.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
