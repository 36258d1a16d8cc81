"""Token ids of whole texts in binary files, and the way back.

Ids are replaced by their rank among all ids of the corpus, most frequent first, so that most fit into one byte.
Ranks are written in one to four bytes each; two bits a rank say how many, four ranks a control byte, and the
control bytes of a block stand before its data bytes. Reading is a table lookup: a control byte gives four
lengths, their running sum the places of the ranks, and a table by rank the ids.

A folder holds `ranks` (a Parquet table of rank, id and count) and `ids`, one file a shard in ascending order
of documents. A file is a row of blocks, each with a header, see HEADER; a new line ends every block, as
Spark's text writer puts one there.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from .bpe import byte_symbols
from .common import Scratch, small

# Magic, shard, block of the shard, documents, ids, control bytes, data bytes. After it: the documents' ids (8 bytes
# each), one byte each that is 1 for a null id, their numbers of ids (8 bytes each), control bytes, data bytes.
HEADER = "<4sqqqqqq"
MAGIC = b"PLT1"
BLOCK_IDS = 500_000
# Lengths of the four ranks of each control byte, and how many bytes they take; masks by length.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


# Fixed value: the pieces that the vocabulary's file splits lower-cased texts into.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Texts without these characters are the same in normal form C, and have a plain lower case and white space (Latin letters, common signs).
UNUSUAL = ["\x1c-\x1f", "\x85", "\xa0", "\u0130", "\u017f-\u200f", "\u2028-\u20ab", "\u20ad-\U0010ffff"]


class Encoder:
    """Ids of whole texts by the tokenizers library, whose model is asked once for each distinct piece.

    A text of plain characters is cut into words here, words into the vocabulary's pieces, and what becomes of both is
    remembered. Of texts with unusual characters or special tokens, every word (between white space 20, 09-0D, across which
    no step of the library looks) that has one is coded by the whole library. memo bounds what is remembered.
    """

    def __init__(self, path: str, memo: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        self.library, self.memo = Tokenizer.from_file(path), memo
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        if PIECES not in json.dumps(spec["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\"):
            raise ValueError(f"{path} doesn't split texts as this operator does")
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        suffix = spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for token, i in self.library.get_vocab().items() if token.endswith(suffix)]] = True
        self.symbols = {b: c for c, b in byte_symbols().items()} | {32: " "}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile(PIECES + r"|\n").findall
        self.unusual = "|".join([f"[{''.join(UNUSUAL)}]", *[regex.escape(t) for t in self.special]])
        self.unusual_word = regex.compile(self.unusual).search
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}

    def ask(self, pieces: list[str]) -> None:
        """Ask the model for pieces, a thousand at a time as one text; a piece's last id is one of a word's end."""
        texts = [" ".join(pieces[i : i + 1000]).encode("utf-8", "replace").decode("latin-1").translate(self.symbols) for i in range(0, len(pieces), 1000)]
        for i, found in enumerate(self.model.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, self.kind)
            raw, ends = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize).tolist()
            self.pieces.update(zip(pieces[1000 * i : 1000 * i + 1000], map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def learn(self, words: list[str]) -> None:
        """Remember the ids of plain words in lower case."""
        found = self.split("\n".join([*words, ""]))
        parts = list(map(self.pieces.get, found))
        new = {x for x, ids in zip(found, parts, strict=True) if ids is None}
        if len(new) + len(self.pieces) > self.memo:
            self.pieces.clear()
            new = set(found)
        if new:
            self.pieces["\n"] = b""
            self.ask(list(new - {"\n"}))
            parts = list(map(self.pieces.__getitem__, found))
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))[[i for i, x in enumerate(found) if x == "\n"]].tolist()
        self.known.update(zip(words, map(b"".join(parts).__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of distinct plain words in lower case."""
        raw = list(map(self.known.get, words))
        new = [x for x, ids in zip(words, raw, strict=True) if ids is None]
        if not new:
            return raw
        if len(new) + len(self.known) > self.memo:
            self.known.clear()
            new = words
        self.learn(new)
        return list(map(self.known.__getitem__, words))

    def encode_plain(self, texts: pa.Array, end_id: int) -> pa.Array:
        """The ids of plain texts and the end id of each: every distinct word is looked at once, the rest are array operations."""
        words = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        coded = words.flatten().dictionary_encode()
        raw = self.ids_of(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // self.kind.itemsize
        flat, counts = joined(np.frombuffer(b"".join(raw), self.kind), sizes, coded.indices.to_numpy(), words.value_lengths().to_numpy())
        ends = np.cumsum(counts)
        offsets = np.concatenate([[0], ends + np.arange(1, len(texts) + 1)]) * self.kind.itemsize
        data = np.insert(flat, ends, np.array(end_id, self.kind))
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])

    def encode(self, texts: pa.Array, end_id: int) -> pa.Array:
        """The ids of each text (null: empty) and the end id, as numbers of self.kind."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.unusual)
        usual = self.encode_plain(texts.filter(pc.invert(odd)), end_id)
        if len(usual) == len(texts):
            return usual
        end, out = np.array(end_id, self.kind).tobytes(), iter(usual.to_pylist())
        return pa.array([self.encode_mixed(t.as_py()) + end if o.as_py() else next(out) for t, o in zip(texts, odd, strict=True)], pa.binary())

    def encode_mixed(self, text: str) -> bytes:
        """The ids of one text, word by word."""
        words = regex.findall(r"[^ \t-\r]+", text)
        plain = {w for w in words if not self.unusual_word(w)}
        raw = self.encode_plain(pa.array(sorted(plain), pa.string()), 0).to_pylist()
        ids = {w: x[: -self.kind.itemsize] for w, x in zip(sorted(plain), raw, strict=True)}
        for w in set(words) - plain:
            if w not in self.odd:
                if len(self.odd) >= self.memo // 5:
                    self.odd.clear()
                self.odd[w] = np.array(self.library.encode(w, add_special_tokens=False).ids, self.kind).tobytes()
            ids[w] = self.odd[w]
        return b"".join(map(ids.__getitem__, words))


def joined(values: np.ndarray, sizes: np.ndarray, items: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What rows of items stand for, one after the other, and how many values each row has; item i is the next sizes[i] values."""
    counts, first = sizes[items], np.cumsum(sizes) - sizes
    ends = np.concatenate([[0], np.cumsum(counts)])
    flat = values[np.arange(ends[-1]) + np.repeat(first[items] - ends[:-1], counts)]
    return flat, np.diff(ends[np.concatenate([[0], np.cumsum(per_row)])])


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One for each vocabulary in a worker process, which may run many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_texts(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_tokens and ids of every whole text, as little-endian numbers of 2 bytes (4 where the vocabulary has more than 65536 entries)."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        for batch in small(batches, 300):
            ids = encoder.encode(batch.column(1), end_id)
            sizes = pc.divide(pc.binary_length(ids).cast(pa.int64()), encoder.kind.itemsize)
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, ids], ["id", "n_tokens", "ids"])

    return rows.mapInArrow(run, "id long, n_tokens long, ids binary")


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    n = len(ranks)
    ranks = np.concatenate([ranks.astype("<u4"), np.zeros(-n % 4, "<u4")])
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = more.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    used = np.arange(4) <= more[:n, None]
    return control.astype(np.uint8).tobytes(), ranks[:n].view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n numbers that control and data bytes stand for."""
    lengths = LENGTHS[control].ravel()[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    wide = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
    return wide[ends - lengths] & MASKS[lengths]


def count_ids(coded: DataFrame) -> DataFrame:
    """id and count over all documents; at most as many rows as the vocabulary has entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                more = np.bincount(np.frombuffer(raw := ids.as_py(), f"<u{len(raw) // n}"), minlength=len(counts))
                more[: len(counts)] += counts
                counts = more
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["id", "count"])

    return coded.select("n_tokens", "ids").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", ids_per_file: int = 8_000_000) -> None:
    """Write the ids of every whole text, each followed by end_id, in ascending order of document ids.

    A null text counts as empty: the end id alone. Null ids come first. Rows with one id keep a fixed order, by a checksum of
    their ids, which also parts an id that many rows have; equal rows are interchangeable. An empty table gives a
    folder without blocks. Texts of any length are coded whole. Other columns aren't read. Texts are coded once, into a
    table beside the files; their ids are counted (as few as the vocabulary, ranked on the driver), then dealt by ranges of
    documents and written. Each step reads what the one before has written, so a lost task is simply run again.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    coded = encode_texts(docs, tokenizer_path, end_id, id_column, text_column)
    coded.write.option("compression", "zstd").parquet(path := scratch.path("coded"))
    coded = spark.read.schema(coded.schema).parquet(path)
    counted = count_ids(coded).orderBy(F.desc("count"), "id").toArrow()
    ids, counts = counted.column("id").to_numpy(), counted.column("count").to_numpy()
    spark.createDataFrame(pa.table({"rank": np.arange(len(ids)), "id": ids, "count": counts}), "rank long, id long, count long").write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank_of)  # as long as the vocabulary
    shards = max(1, -(-int(counts.sum()) // ids_per_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of, shard, block = ranks.value, TaskContext.get().partitionId(), 0
        doc_ids, sizes, parts, held = [], [], [], 0

        def packed() -> pa.RecordBatch:
            joined = rank_of[np.concatenate(parts)]
            control, data = pack_ranks(joined)
            head = struct.pack(HEADER, MAGIC, shard, block, len(doc_ids), len(joined), len(control), len(data))
            names, lengths = np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(sizes, "<i8").tobytes()
            content = b"".join([head, names, bytes(d is None for d in doc_ids), lengths, control, data])
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["value"])

        for batch in batches:
            for doc_id, n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = ids.as_py()
                doc_ids.append(doc_id)
                sizes.append(n)
                parts.append(np.frombuffer(raw, f"<u{len(raw) // n}"))
                held += n
                if held >= BLOCK_IDS:
                    yield packed()
                    block, doc_ids, sizes, parts, held = block + 1, [], [], [], 0
        if doc_ids:
            yield packed()

    tied = coded.withColumn("tie", F.crc32("ids"))
    dealt = tied.repartitionByRange(shards, "id", "tie", "n_tokens").sortWithinPartitions("id", "tie", "n_tokens").drop("tie")
    # The text writer writes a string's bytes as they are, so blocks are handed to it as strings.
    dealt.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.text(f"{folder}/ids")
    scratch.discard()


def blocks(content: bytes) -> Iterator[tuple]:
    """shard, block, documents' ids (masked where null), numbers of ids, control bytes, data bytes of each block of a file."""
    at = 0
    while at < len(content):
        magic, shard, block, docs, _, n_control, n_data = struct.unpack_from(HEADER, content, at)
        if magic != MAGIC:
            raise ValueError(f"no block of token ids at byte {at}")
        at += struct.calcsize(HEADER)
        doc_ids, nulls = np.frombuffer(content, "<i8", docs, at), np.frombuffer(content, np.uint8, docs, at + 8 * docs)
        sizes = np.frombuffer(content, "<i8", docs, at + 9 * docs)
        at += 17 * docs
        control, data = np.frombuffer(content, np.uint8, n_control, at), np.frombuffer(content, np.uint8, n_data, at + n_control)
        yield shard, block, pa.array(doc_ids, mask=nulls.astype(bool)), sizes, control, data
        at += n_control + n_data + 1


def read_token_files(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit integers) of each document.

    With digest, ids_crc32 in place of ids. A file is read by one task, block by block. Starts come from the files'
    totals: within runs of 1000 shards by a window each, over the runs by one more, and within a file by running sums.
    """
    files = spark.read.format("binaryFile").load(f"{folder}/ids").select("content")
    table = spark.read.parquet(f"{folder}/ranks").select("rank", "id").toArrow().sort_by("rank")
    by_rank = spark.sparkContext.broadcast(table.column("id").to_numpy().astype("<u4"))  # as long as the vocabulary

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = [(b[0], int(b[3].sum())) for b in blocks(content.as_py())]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([found[0][0]]), pa.array([sum(n for _, n in found)])], ["shard", "n"])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = by_rank.value
        for batch in batches:
            for content in batch.column(0):
                before = 0
                for shard, _, doc_ids, sizes, control, data in blocks(content.as_py()):
                    ends = np.cumsum(sizes)
                    ids = ids_of[unpack_ranks(control, data, int(ends[-1]))]
                    raw = memoryview(ids.tobytes())
                    spans = zip((4 * (ends - sizes)).tolist(), (4 * ends).tolist(), strict=True)
                    last = pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64()) if digest else pa.array([bytes(raw[a:b]) for a, b in spans], pa.binary())
                    columns = [pa.array(np.full(len(sizes), shard)), doc_ids, pa.array(before + ends - sizes), pa.array(sizes), last]
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "place", "n_tokens", "ids_crc32" if digest else "ids"])
                    before += int(ends[-1])

    sizes = files.mapInArrow(totals, "shard long, n long").withColumn("run", F.floor(F.col("shard") / 1000))
    runs = sizes.groupBy("run").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("run_start"))
    within = Window.partitionBy("run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("in_run", F.coalesce(F.sum("n").over(within), F.lit(0))).join(runs, "run")
    starts = starts.select("shard", (F.col("run_start") + F.col("in_run")).alias("shard_start"))
    last = "ids_crc32 long" if digest else "ids binary"
    docs = files.mapInArrow(decoded, f"shard long, doc_id long, place long, n_tokens long, {last}")
    return docs.join(starts, "shard").select("doc_id", (F.col("shard_start") + F.col("place")).alias("start"), "n_tokens", last.split()[0])


def token_file_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", ids_per_file: int = 8_000_000, scratch: Scratch | None = None) -> DataFrame:
    """Files written to the shared folder and read back: doc_id, start, n_tokens and ids_crc32, the CRC-32 of a document's ids.

    The files stay until scratch is discarded; docstrings of the writer and the reader say what odd rows become.
    """
    folder = (scratch or Scratch(docs.sparkSession)).path("token-files")
    write_token_files(docs, folder, tokenizer_path, end_id, id_column, text_column, ids_per_file)
    return read_token_files(docs.sparkSession, folder, digest=True).withColumnRenamed("doc_id", id_column)
