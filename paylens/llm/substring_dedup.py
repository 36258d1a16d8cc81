"""Substring dedup: passages of a fixed number of words that an earlier document has too, found by doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, free_name, small, utf8_values, window_hashes, word_bounds, word_hashes

# Stands for the hash of a window that reaches beyond its text; hashes have 32 bits.
_OUTSIDE = -1


def hashed(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a text, and where its words start and end."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = word_bounds(data)
    return word_hashes(data, starts, ends), starts, ends


def least_places(windows: np.ndarray, span: int) -> np.ndarray:
    """For each run of span windows, the position of its least hash, the last of equals.

    It depends on the run alone: texts with a passage of span windows in common have its least one in common.
    """
    n = len(windows)
    if n < span:
        return np.zeros(0, np.int64)
    # The least of each run, from those of runs of 1, 2, 4 ... windows; positions settle ties to the right.
    place = np.lexsort((-np.arange(n), windows))
    order = np.empty(n, np.int64)
    order[place] = np.arange(n)
    least, width = order, 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < span:
        least = np.minimum(least[: n - span + 1], least[span - width : span - width + n - span + 1])
    return place[least]


def anchors(windows: np.ndarray, span: int) -> np.ndarray:
    """The positions that are least in any run of span windows."""
    return np.unique(least_places(windows, span))


def level_lengths(words: int, base: int) -> list[int]:
    """Lengths from the base on, each twice the one before, for windows of so many words.

    Around the base window that lies at any place of a full window there must be room for one of the longer
    ones that begin a multiple of the base before it; that takes 2**level + 1 times the base.
    """
    base = min(base, (words + 1) // 2)
    return [base * 2**level for level in range(words.bit_length()) if (2**level + 1) * base <= words + 1]


def extensions(lengths: list[int]) -> list[tuple[int, int]]:
    """Level and offset (in base lengths) of the windows around a base window, level by level; those of a level
    add one of the level before to either side."""
    return [(level, c) for level in range(1, len(lengths)) for c in range(2**level)]


def _rows(docs: DataFrame, lengths: list[int], span: int) -> DataFrame:
    """doc_id, window (hash of the base length) and at, of the anchors of every text, with hashes x0, x1 ... of the longer windows around each (null: beyond the text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    around = extensions(lengths)
    names = ["doc_id", "window", "at", *[f"x{i}" for i in range(len(around))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(batches):
            found, counts = [], []
            for text in utf8_values(part.column(1)):
                words = hashed(text or b"")[0]
                windows = window_hashes(words, lengths[0])
                at = anchors(windows, span)
                longer = [window_hashes(words, n) for n in lengths]
                short = []
                for level, c in around:
                    start = at - c * lengths[0]
                    inside = (start >= 0) & (start < len(longer[level]))
                    value = np.full(len(at), _OUTSIDE, np.int64)
                    value[inside] = (longer[level][start[inside]] >> np.uint64(32)).astype(np.int64)
                    short.append(value)
                found.append((windows[at].view(np.int64), at.astype(np.int32), *short))
                counts.append(len(at))
            for out in _emit(part.column(0), counts, found, names):
                columns = [c if i < 3 else pc.cast(pc.if_else(pc.equal(c, _OUTSIDE), None, pc.subtract(c, 1 << 31)), pa.int32()) for i, c in enumerate(out.columns)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, window long, at int" + "".join(f", {x} int" for x in names[3:]))


def _emit(ids: pa.Array, counts: list[int], found: list[tuple[np.ndarray, ...]], names: list[str], size: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Batches of ids with the arrays found for each, of about size rows."""
    first = 0
    while first < len(counts):
        last, total = first, 0
        while last < len(counts) and (total == 0 or total + counts[last] <= size):
            total += counts[last]
            last += 1
        if total:
            owner = pa.array(np.repeat(np.arange(first, last), counts[first:last]))
            yield pa.RecordBatch.from_arrays([ids.take(owner), *[pa.array(np.concatenate(x)) for x in zip(*found[first:last], strict=True)]], names)
        first = last


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """The windows that more than one document has, and the smallest of their doc_ids. Counts are summed before the shuffle."""
    return rows.groupBy(*keys).agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id").select(*keys, "first_id")


def surviving_anchors(known: DataFrame, lengths: list[int], span: int, scratch: Scratch) -> DataFrame:
    """doc_id and at of the anchors around which every length is repeated in another document.

    Level by level: a window that two documents have is extended to twice its length, to either side; one that
    is in one document alone goes no further. Levels end when none is left.
    """
    base = _rows(known, lengths, span)
    names = {pair: f"x{i}" for i, pair in enumerate(extensions(lengths))}
    alive = base.join(scratch.table(_shared(base, "window").select("window"), "shared"), "window").withColumn("c", F.lit(0))
    for level in range(1, len(lengths)):
        # Windows of a level have the same base window in common, so short hashes of the rest tell them apart.
        longer = F.array(*[F.col(names[level, c]) for c in range(2**level)])
        alive = scratch.table(alive, "alive")
        grown = alive.withColumn("c", F.explode(F.array("c", F.col("c") + 2 ** (level - 1)))).withColumn("x", F.get(longer, F.col("c"))).filter("x is not null")
        shared = scratch.table(_shared(grown, "window", "c", "x").drop("first_id"), "shared")
        alive = grown.join(shared, ["window", "c", "x"]).drop("x")
        if shared.isEmpty():
            break
    return alive.select("doc_id", "at").distinct()


def repeated_windows(docs: DataFrame, words: int = 50, base_words: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """doc_id and at: the starts of windows of so many words whose words also start in a document with a smaller doc_id.

    Lengths double from base_words on (10, 20, 40 for 50 words). The base level looks at anchors only, one in
    every run of windows that a full window has; what is repeated there is extended to twice the length, and
    so on, while anything survives. Around surviving anchors alone the full windows are compared in turn. What occurs
    in one document alone ends at the base level, so most of a corpus is never looked at in full length.
    Equality is that of 64-bit hashes. Rows without doc_id neither lose words nor cost others theirs. A window
    in a third of all documents is one row a task before the shuffle; the shared windows are written, so that
    the joins back have a plain shuffle on both sides and Spark can split the rows of a window among tasks.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    lengths = level_lengths(words, base_words)
    span = words - lengths[0] + 1
    known = docs.filter("doc_id is not null").select("doc_id", "text")
    held = surviving_anchors(known, lengths, span, scratch).groupBy("doc_id").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    extended = known.join(held, "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(batches):
            found, counts = [], []
            for text, ats in zip(utf8_values(part.column(1)), part.column(2), strict=True):
                hashes = hashed(text or b"")[0]
                windows = window_hashes(hashes, words)
                alive = np.zeros(len(hashes), bool)
                ats = np.asarray(ats.values, np.int64)
                # Rows that repeat a doc_id may have other texts, with other places.
                alive[ats[ats < len(hashes)]] = True
                at = np.flatnonzero(alive[least_places(window_hashes(hashes, lengths[0]), span)])
                found.append((windows[at].view(np.int64), at.astype(np.int32)))
                counts.append(len(at))
            yield from _emit(part.column(0), counts, found, ["doc_id", "window", "at"])

    full = scratch.table(extended.mapInArrow(extend, f"doc_id {kind}, window long, at int"), "windows")
    return full.join(scratch.table(_shared(full, "window"), "shared"), "window").filter("doc_id > first_id").select("doc_id", "at")


def remove_repeats(docs: DataFrame, words: int = 50, digest: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """docs with the words of repeated windows taken out; digest gives doc_id, n_words, n_removed and kept_sha256 instead.

    Every word in a window of so many words is removed whose words also start in a document with a smaller
    doc_id, as judged on the input. What is kept of a changed text is its lines, with words that stood in one
    line joined by one space; a text that loses nothing stays as it is, and n_chars follows if there is one.
    The digest is that of all kept words joined by one space. Null texts have no words, and texts of any length are taken whole, one at a time. Rows with the same
    doc_id don't count as earlier than each other, and each loses what any of them has to lose at that
    place; rows without doc_id stay as they are. Empty tables give empty ones; other columns pass through.
    """
    lost = repeated_windows(docs, words, scratch=scratch).groupBy("doc_id").agg(F.sort_array(F.collect_set("at")).alias(free_name("lost_at", docs))).withColumnRenamed("doc_id", own := free_name("lost_id", docs))
    joined = docs.join(lost, F.col("doc_id") == F.col(own), "left").drop(own)
    names = docs.columns
    where = {n: i for i, n in enumerate(names)}
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(text: bytes, ats: pa.ListScalar) -> tuple[int, int, bytes, np.ndarray]:
        """Words, removed words, kept words joined by one space, and which are kept."""
        data = np.frombuffer(text, np.uint8)
        starts, ends = word_bounds(data)
        keep = np.ones(len(starts), bool)
        if ats.is_valid:
            at = np.asarray(ats.values, np.int64)
            mark = np.zeros(len(starts) + 1, np.int64)
            at = at[at + words <= len(starts)]
            np.add.at(mark, at, 1)
            np.add.at(mark, at + words, -1)
            keep = np.cumsum(mark)[:-1] == 0
        return len(starts), int(len(starts) - keep.sum()), starts, ends, keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts, lists = utf8_values(batch.column(where["text"])), batch.column(len(names))
            if digest:
                n_words, n_removed, digests = [], [], []
                for text, ats in zip(texts, lists, strict=True):
                    parts = (text or b"").split()
                    n, removed, _, _, keep = cut(text or b"", ats)
                    kept = parts if not removed else [p for p, k in zip(parts, keep.tolist(), strict=True) if k]
                    n_words.append(n)
                    n_removed.append(removed)
                    digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(where["doc_id"]), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])
                continue
            kept, sizes = [], []
            for text, ats in zip(texts, lists, strict=True):
                if text is None or not ats.is_valid:
                    kept.append(None if text is None else text.decode())
                else:
                    _, removed, starts, ends, keep = cut(text, ats)
                    kept.append(rebuilt(text, starts[keep], ends[keep]) if removed else text.decode())
                sizes.append(None if kept[-1] is None else len(kept[-1]))
            columns = list(batch.columns[:-1])
            columns[where["text"]] = pa.array(kept, pa.string())
            if "n_chars" in where:
                field = batch.schema.field(where["n_chars"])
                columns[where["n_chars"]] = pa.array(sizes, field.type)
            yield pa.RecordBatch.from_arrays(columns, names)

    if digest:
        return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
    return joined.mapInArrow(run, docs.schema)


def rebuilt(text: bytes, starts: np.ndarray, ends: np.ndarray) -> str:
    """The given words of a text; a line feed where one or more stood between two of them, else a space."""
    out, last = [], 0
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if out:
            out.append(b"\n" if text.find(b"\n", last, s) >= 0 else b" ")
        out.append(text[s:e])
        last = e
    return b"".join(out).decode()
