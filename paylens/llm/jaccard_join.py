"""N-gram Jaccard join: exact near-duplicate links between shingle sets, by R-trees over count vectors.

Every distinct set of shingles is a point: its shingles hashed into groups, counted by group. Two sets
share at most the sum of the smaller counts, and a box of points at most the sum of the minima of a set's
counts and the box's upper corner, so a search passes over boxes and points that can't reach the overlap.

Which points meet in a tree is settled by prefixes: in any one order of all shingles, sets of Jaccard
similarity t share one of their first n - ceil(t n) + 1. The order puts shingles that a fixed share of
documents has last (their number is bounded by that share), the rest by hash: passages that many texts quote
bring unlike texts together only where a text has little else. Points with a prefix shingle in common form
a tree; trees with the same points are built once.

Links come in rounds. In the first ones each point meets a few of its candidates: the best one, and those
that many others have, which joins copies of one text into components. Then points of different components
meet all candidates the bounds let pass. So a group of n near copies costs about n verifications instead of
n squared, and no link is lost. A tree with more points than one task should hold is dealt out: a point meets
those of its part and some pivots that all parts have, and in the last round all parts meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, free_name, mix64, small, utf8_values, window_hashes, word_bounds, word_hashes
from .components import connected_components

GROUPS = 256
# Counts are kept in 16 bits; what reaches the top is taken for unbounded.
TOP = 65535
# Sets of at least so many shingles have a second, finer vector of 8-bit counts, for a second look at pairs.
FINE_FROM, FINE_GROUPS, FINE_TOP = 800, 4096, 255
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles of a whole text with A-Z in lower case."""
    data = _LOWER[np.frombuffer(text or b"", np.uint8)]
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(word_hashes(data, starts, ends), min(k, len(starts))))


def set_key(shingles: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    return int(mix64((mix64(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))).reshape(1)).view(np.int64)[0])


def count_vector(shingles: np.ndarray) -> np.ndarray:
    return np.minimum(np.bincount((shingles & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), TOP).astype(np.uint16)


def fine_vector(shingles: np.ndarray) -> bytes | None:
    if len(shingles) < FINE_FROM:
        return None
    return np.minimum(np.bincount((shingles & np.uint64(FINE_GROUPS - 1)).astype(np.int64), minlength=FINE_GROUPS), FINE_TOP).astype(np.uint8).tobytes()


def prefix(shingles: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set one of which it shares with any other of enough similarity."""
    n = len(shingles)
    size = n - -(-percent * n // 100) + 1
    order = shingles[np.argsort(mix64(shingles))]
    if len(common):
        at = np.minimum(common.searchsorted(order), len(common) - 1)
        order = order[np.argsort(common[at] == order, kind="stable")]
    return order[:size]


def survey(docs: DataFrame, k: int, share: float) -> DataFrame:
    """One pass over the texts with two kinds of rows: doc_id, set_key, n and vector of every text; and, where common
    is true, shingles (as set_key) with counts (as n) that runs of documents have often.

    A shingle that a share of all documents has is as frequent in some run of them, so a task passes on only
    those that are in one of its runs; the sums decide.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def frequent(ids: pa.DataType) -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            many = c >= max(8, share * len(held))
            return pa.RecordBatch.from_arrays([pa.nulls(int(many.sum()), ids), pa.array(u[many].view(np.int64)), pa.array(c[many]), pa.array(np.ones(int(many.sum()), bool)), pa.nulls(int(many.sum()), pa.binary()), pa.nulls(int(many.sum()), pa.binary())], ["doc_id", "set_key", "n", "common", "vector", "fine"])

        ids = None
        for batch in small(batches):
            ids, keys, sizes, vectors, fine = batch.column(0).type, [], [], [], []
            for text in utf8_values(batch.column(1)):
                s = shingle_set(text, k)
                keys.append(set_key(s))
                sizes.append(len(s))
                vectors.append(count_vector(s).tobytes())
                fine.append(fine_vector(s))
                held.append(s)
                size += len(s)
                if size >= 1_000_000:
                    yield frequent(ids)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.zeros(len(keys), bool)), pa.array(vectors, pa.binary()), pa.array(fine, pa.binary())], ["doc_id", "set_key", "n", "common", "vector", "fine"])
        if held:
            yield frequent(ids)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, set_key long, n long, common boolean, vector binary, fine binary")


def common_shingles(surveyed: DataFrame, documents: int, share: float) -> np.ndarray:
    """Sorted hashes of the shingles that reach the share; at most the mean number of shingles a document over the share, and broadcast."""
    counts = surveyed.filter("common").groupBy("set_key").agg(F.sum("n").alias("n"))
    found = counts.filter(F.col("n") >= max(32, int(share * documents))).select("set_key").toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))


def prefix_rows(docs: DataFrame, k: int, percent: int, common: np.ndarray) -> DataFrame:
    """shingle, set_key and n_shingles for the prefixes of the distinct sets each task sees."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, owners, sizes, total = [], [], [], 0

        def emit() -> pa.RecordBatch:
            counts = [len(x) for x in keys]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(owners, np.int64), counts)), pa.array(np.repeat(np.array(sizes, np.int32), counts))], ["shingle", "set_key", "n"])

        for batch in small(batches):
            for text in utf8_values(batch.column(0)):
                s = shingle_set(text, k)
                if not len(s) or (key := set_key(s)) in seen:
                    continue
                seen.add(key)
                keys.append(prefix(s, shared.value, percent))
                owners.append(key)
                sizes.append(len(s))
                total += len(keys[-1])
                if total >= 500_000:
                    yield emit()
                    keys, owners, sizes, total = [], [], [], 0
        if keys:
            yield emit()

    return docs.filter("doc_id is not null").select("text").mapInArrow(run, "shingle long, set_key long, n int")


def blocks(rows: DataFrame) -> DataFrame:
    """block and set_key: the sets with a prefix shingle in common, each such group of sets once.

    One shuffle by shingle; the groups are read in order and never held together with others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def grouped(key: np.ndarray, own: np.ndarray) -> pa.RecordBatch | None:
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
            key, own = key[first], own[first]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            counts = np.diff(np.append(starts, len(key)))
            print_ = mix64(np.add.reduceat(mix64(own.view(np.uint64)), starts) + counts.astype(np.uint64)).view(np.int64)
            many = np.repeat(counts > 1, counts)
            if not many.any():
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(print_, counts)[many]), pa.array(own[many])], ["block", "set_key"])

        for batch in batches:
            key = np.concatenate([rest[0], batch.column(0).to_numpy()])
            own = np.concatenate([rest[1], batch.column(1).to_numpy()])
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if cut and (out := grouped(key[:cut], own[:cut])) is not None:
                yield out
            rest = (key[cut:], own[cut:])
        if len(rest[0]) and (out := grouped(*rest)) is not None:
            yield out

    ordered = rows.select("shingle", "set_key").repartition("shingle").sortWithinPartitions("shingle", "set_key")
    return ordered.mapInArrow(run, "block long, set_key long").distinct()


class RTree:
    """Points in leaves of like points, boxes over leaves, boxes over boxes; a box keeps its upper corner and sizes."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, fanout: int = 16):
        order = self._packed(vectors, sizes, fanout)
        self.order, self.levels, self.fanout = order, [(vectors[order], sizes[order], sizes[order])], fanout
        while len(self.levels[-1][0]) > fanout:
            corner, low, high = self.levels[-1]
            at = np.arange(0, len(corner), fanout)
            self.levels.append((np.maximum.reduceat(corner, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    @staticmethod
    def _packed(vectors: np.ndarray, sizes: np.ndarray, fanout: int) -> np.ndarray:
        """Sort by size into slabs, then each slab by its most varied group."""
        n = len(sizes)
        order = np.argsort(sizes, kind="stable")
        slab = fanout * max(1, int(np.sqrt(n / fanout)))
        for i in range(0, n if n > fanout else 0, slab):
            part = order[i : i + slab]
            order[i : i + slab] = part[np.argsort(vectors[part, vectors[part].var(axis=0).argmax()], kind="stable")]
        return order

    def search(self, vector: np.ndarray, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Points that may reach the similarity, and the bounds of their overlaps."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, low, high = self.levels[depth]
            nodes = nodes[(100 * high[nodes] >= percent * size) & (percent * low[nodes] <= 100 * size)]
            bound = overlap_bound(corner[nodes], vector)
            # overlap >= percent / 100 of the union, which is size + other - overlap; others are at least low.
            needed = percent * (size + np.maximum(low[nodes], -(-percent * size // 100)))
            passed = (100 + percent) * bound >= needed
            nodes, bound = nodes[passed], bound[passed]
            if depth:
                children = (nodes[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                nodes = children[children < len(self.levels[depth - 1][0])]
        exact = (100 + percent) * bound >= percent * (size + self.levels[0][1][nodes])
        return self.order[nodes[exact]], bound[exact]


def overlap_bound(corners: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """The summed minima of coordinates; unbounded where both sides have one at the top."""
    least = np.minimum(corners, vector)
    return least.sum(axis=1, dtype=np.int64) + (np.int64(2**40) * (least == TOP).any(axis=1) if vector.max(initial=0) == TOP else 0)


def block_parts(met: DataFrame, most: int) -> DataFrame:
    """block and parts, of the blocks of met(block, set_key) with more than most points."""
    return met.groupBy("block").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).filter("parts > 1")


def grouped(rows: DataFrame, columns: list[str], run_group, schema: str) -> DataFrame:
    """run_group over the rows (set_key, n, vector, label and columns) of each block, part and against, one group at a time."""

    def emit(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], [c.split()[0] for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        out: list[tuple[np.ndarray, ...]] = []
        held = 0

        def add(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal out, held
            for pair in run_group(part[0][0], *part[3:]):
                out.append(pair)
                held += len(pair[0])
                if held >= 200_000:
                    yield emit(out)
                    out, held = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint16).reshape(-1, GROUPS)
            new = [vectors if i == 5 else batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            whole = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
            change = (whole[0][1:] != whole[0][:-1]) | (whole[1][1:] != whole[1][:-1]) | (whole[2][1:] != whole[2][:-1])
            starts = np.flatnonzero(np.concatenate([[True], change]))
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                yield from add([x[s:e] for x in whole])
            rest = [x[starts[-1] :] for x in whole]
        if rest is not None:
            yield from add(rest)
        if out:
            yield emit(out)

    key = ["block", "part", "against"]
    ordered = rows.select(*key, "set_key", "n", "vector", "label", *columns).repartition(*key).sortWithinPartitions(*key, "set_key")
    return ordered.mapInArrow(run, schema)


def nearest_candidates(points: DataFrame, parts: DataFrame, percent: int, most: int, turn: int = 0, pivots: int = 32) -> DataFrame:
    """block, a, b, rate, degree and pivot: a few candidates of other labels for each of points(block, set_key, n, vector, label).

    Each point gets the best one and the one that most points of its part have as a candidate (degree); where
    a block has several parts also those two among its pivots, about as many points as given, which stand in
    every part. Parts and pivots are drawn anew each turn.
    """

    def run_group(block: int, keys: np.ndarray, sizes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, pivot: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        tree = RTree(vectors, sizes)
        degree, every = np.zeros(len(keys), np.int64), []
        for i in range(len(keys)):
            found, bound = tree.search(vectors[i], int(sizes[i]), percent)
            other = labels[found] != labels[i]
            found, rate = found[other], bound[other] / (sizes[i] + sizes[found[other]])
            degree[i] = len(found)
            every.append((found.astype(np.int32), rate.astype(np.float32)))
        for i, (found, rate) in enumerate(every):
            take = []
            for some in (np.arange(len(found)), np.flatnonzero(pivot[found])):
                if len(some):
                    # Ties go to the smallest key, so that all points of a group choose the same one.
                    take += [some[np.argmax(rate[some])], some[np.lexsort((keys[found[some]], -degree[found[some]]))[0]]]
            if take:
                take = np.unique(take)
                b = found[take]
                yield np.full(len(b), block), np.full(len(b), keys[i]), keys[b], rate[take].astype(float), degree[b], pivot[b]

    dealt = points.join(parts, "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    pivot = (F.col("parts") > 1) & (F.pmod(F.xxhash64("set_key", F.lit(turn)), F.greatest(F.col("parts") * F.lit(most) / pivots, F.lit(1)).cast("long")) == 0)
    own = F.array(F.pmod(F.xxhash64("set_key", F.lit(-1 - turn)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("pivot", pivot).withColumn("part", F.explode(F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own))).withColumn("against", F.lit(0))
    return grouped(dealt, ["pivot"], run_group, "block long, a long, b long, rate double, degree long, pivot boolean")


def few_pairs(nearest: DataFrame) -> DataFrame:
    """Up to four pairs for each a of the nearest candidates: the best b and the most frequent one, of all and of the pivots."""
    best, hub = F.struct("rate", "b"), F.struct("degree", -F.col("b"))
    four = nearest.groupBy("a").agg(*[F.max_by("b", x) for x in (best, hub, F.when(F.col("pivot"), best), F.when(F.col("pivot"), hub))]).toDF("a", "w", "x", "y", "z")
    return ordered_pairs(four.select("a", F.explode(F.array("w", "x", "y", "z")).alias("b")).filter("b is not null"))


def all_candidates(points: DataFrame, parts: DataFrame, main: DataFrame, percent: int) -> DataFrame:
    """a and b: every pair with different labels that the trees let pass, from points(block, set_key, n, vector, label).

    main has the label most points of a block have: those points are searched for but don't search. Where a
    block has several parts, each part of those that search meets each part of all its points in a group.
    """

    def run_group(_: int, keys: np.ndarray, sizes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, searches: np.ndarray, held: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        there = np.flatnonzero(held)
        if not len(there):
            return
        tree = RTree(vectors[there], sizes[there])
        for i in np.flatnonzero(~held):
            found = there[tree.search(vectors[i], int(sizes[i]), percent)[0]]
            # Two points that both search meet once.
            found = found[(labels[found] != labels[i]) & (~searches[found] | (keys[found] > keys[i]))]
            if len(found):
                yield np.full(len(found), keys[i]), keys[found]

    dealt = points.join(main, "block").join(parts, "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("searches", F.col("label") != F.col("main"))
    own, every = F.pmod(F.xxhash64("set_key"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = dealt.filter("searches").withColumn("part", own).withColumn("against", every).withColumn("held", F.lit(False))
    # Only parts with points that search need the others.
    asked = left.select("block", "part").distinct()
    right = dealt.withColumn("against", own).join(asked, "block").withColumn("held", F.lit(True))
    return grouped(left.unionByName(right), ["searches", "held"], run_group, "a long, b long")


def second_look(pairs: DataFrame, fine: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) that the finer vectors of fine(set_key, n, fine) let pass, too; those without one pass.

    The coarse bound says little about long sets, whose texts are the dearest to compare.
    """
    left = fine.select(F.col("set_key").alias("a"), F.col("n").alias("n_a"), F.col("fine").alias("x"))
    right = fine.select(F.col("set_key").alias("b"), F.col("n").alias("n_b"), F.col("fine").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            keep = []
            for n_a, n_b, x, y in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                if x is None or y is None:
                    keep.append(True)
                    continue
                least = np.minimum(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8))
                keep.append(bool((least == FINE_TOP).any()) or (100 + percent) * int(least.sum(dtype=np.int64)) >= percent * (n_a + n_b))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a", "left").join(right, "b", "left").select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, points: DataFrame, k: int, percent: int, scratch: Scratch, broadcast_rows: int = 500_000) -> DataFrame:
    """The pairs(a, b) whose sets have the similarity, from the whole text of one document of each set.

    Texts are shuffled rather than shingles: they are smaller. Only texts that a pair needs leave their task;
    their ids are broadcast where they are few, by count, and joined by a shuffle beyond.
    """
    wanted = scratch.table(pairs.select(F.col("a").alias("set_key")).unionByName(pairs.select(F.col("b").alias("set_key"))).distinct().join(points, "set_key").select("set_key", "rep"), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    texts = docs.select("doc_id", "text").join(few, F.col("doc_id") == F.col("rep")).select("set_key", "text")
    left = texts.select(F.col("set_key").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("set_key").alias("b"), F.col("text").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            keep = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8_values(batch.column(2)), utf8_values(batch.column(3)), strict=True):
                x, y = shingle_set(x, k), shingle_set(y, k)
                both = len(np.intersect1d(x, y, assume_unique=True))
                # Rows that repeat a doc_id may have other texts than the one meant.
                keep.append(100 * both >= percent * (len(x) + len(y) - both) and set_key(x) == a and set_key(y) == b)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def ordered_pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, common_share: float = 0.001, block_points: int = 256, enough_pairs: int = 50_000_000, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and n_copies (rows with the same set), per row of docs(doc_id, text).

    component_id is the smallest doc_id that links reach: links join sets with 100 * shared >= percent * all.
    Rows with equal sets are one point, so copies are never compared or paired. Null and wordless texts have
    empty sets and are linked with nothing; texts shorter than k words are one shingle, and texts of any
    length are taken whole, one at a time. Rows without doc_id link nothing and have no component; rows that
    repeat a doc_id are points of their own. Empty tables give empty ones; other columns aren't read.
    Shingles are compared by 64-bit hashes. A task holds the points of one part of a block, block_points and
    some pivots, at a time; rounds of a few pairs a point go on while more than enough_pairs pairs may be left.
    Both settle how the work is dealt out, not what is found.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    surveyed = scratch.table(survey(docs, k, common_share), "sets")
    sets = surveyed.filter("not common").select("doc_id", "set_key", F.col("n").alias("n_shingles"))
    named = sets.filter("doc_id is not null and n_shingles > 0")
    points = named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"))
    common = common_shingles(surveyed, sets.count(), common_share)
    met = scratch.table(blocks(prefix_rows(docs, k, percent, common)), "blocks")
    parts = scratch.table(block_parts(met, block_points), "parts")

    # Copies go before the shuffle, task by task: one set may be that of a third of all rows.
    every = surveyed.filter("not common and doc_id is not null and n > 0").select("set_key", "n", "vector", "fine").dropDuplicates(["set_key"])
    known = scratch.table(every.join(met.select("set_key").distinct(), "set_key", "left_semi"), "vectors")
    vectors, fine = known.select("set_key", "n", "vector"), known.filter("fine is not null").select("set_key", "n", "fine")

    def linked(pairs: DataFrame) -> DataFrame:
        return scratch.table(verified(scratch.table(second_look(pairs, fine, percent), "pairs"), docs, points, k, percent, scratch), "links")

    nearest = scratch.table(nearest_candidates(met.join(vectors, "set_key").withColumn("label", F.col("set_key")), parts, percent, block_points), "nearest")
    tested = scratch.table(few_pairs(nearest), "pairs")
    links = linked(tested)
    joined = connected_components(links, scratch=scratch)

    # Only points with a candidate can have more of them, and those of blocks that were dealt out.
    live = nearest.select("block", F.col("a").alias("set_key")).unionByName(met.join(parts, "block").select("block", "set_key"))
    live = scratch.table(live.distinct(), "live")
    label = F.coalesce("label", F.col("set_key"))
    before, turn = None, 0
    while True:
        # Blocks where components are left apart, and how many pairs they have at most.
        labelled = scratch.table(live.join(joined.withColumnRenamed("node", "set_key"), "set_key", "left").select("block", "set_key", label.alias("label")), "labelled")
        main = labelled.groupBy("block", "label").agg(F.count("*").alias("n")).groupBy("block").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")).filter("all > most")
        main = scratch.table(main, "main")
        work = main.agg(F.coalesce(F.sum(F.expr("(all - most) * all")), F.lit(0))).first()[0]
        mixed = labelled.join(main.select("block"), "block").join(vectors, "set_key")
        # Another round of a few pairs a point pays where it leaves far fewer of all pairs.
        if work <= enough_pairs or before and work > 0.7 * before:
            break
        before, turn = work, turn + 1
        more = scratch.table(few_pairs(nearest_candidates(mixed, parts, percent, block_points, turn)).join(tested, ["a", "b"], "left_anti"), "pairs")
        tested, links = tested.unionByName(more), links.unionByName(linked(more))
        joined = connected_components(links, scratch=scratch)

    rest = ordered_pairs(all_candidates(mixed, parts, main.select("block", "main"), percent))
    rest = scratch.table(rest.join(tested, ["a", "b"], "left_anti"), "pairs")
    joined = scratch.table(connected_components(links.unionByName(linked(rest)), scratch=scratch), "components")

    member = points.select("set_key", "rep", "n_copies").join(joined.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("label", label)
    # Written, so that Spark can split the join's rows of a label that very many points have.
    least = scratch.table(member.groupBy("label").agg(F.min("rep").alias("component_id")), "least")
    found = member.join(least, "label").select(F.col("set_key").alias("key"), "component_id", "n_copies")
    out = sets.join(found, (F.col("set_key") == F.col("key")) & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").cast(kind).alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id is that of their component: one document of each group, and all without links.

    Rows without doc_id stay. Of rows that repeat a doc_id all stay if that id names the component.
    """
    found = near_duplicates(docs, **options)
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias(own := free_name("gone", docs))).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(own), "left_anti")
