"""Byte-level BPE: encoding and decoding of whole texts.

Merges run over a segment tree whose leaves hold, for each adjacent pair of symbols, the pair's rank and
position as one number. The root is the leftmost pair of the lowest rank; a merge changes three leaves and
the paths above them, so a word of n bytes takes O(n log n). Many words are merged at once: words of like
length form the rows of an array, and each step merges the root pair of every row that still has one; the few words
of a rare length, long ones above all, have a tree each.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import small

# Fixed values of the byte-level scheme: the splitting pattern and the printable stand-ins of the bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NONE = np.int64(2**62)
_POSITION_BITS = 40
# Bytes of words merged at once: the arrays stay in the processor's cache.
STEP = 30_000
# Below so many words of a length each is merged by itself.
FEW = 24


def byte_symbols() -> dict[str, int]:
    """Printable character of each byte: itself where printable, else the next code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """The tables of a tokenizers file that coding needs; its size is that of the vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, symbols = spec["model"]["vocab"], byte_symbols()
    size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
    tokens = [b""] * size
    for token, i in vocab.items():
        tokens[i] = bytes(symbols[c] for c in token)
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    for token, i in added.items():
        tokens[i] = token.encode()
    single = np.zeros(256, np.int64)
    for symbol, b in symbols.items():
        single[b] = vocab[symbol]
    keys, made = [], []
    for pair in spec["model"]["merges"]:
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        keys.append(vocab[left] << 32 | vocab[right])
        made.append(vocab[left + right])
    keys, made = np.array(keys, np.int64), np.array(made, np.int64)
    order = np.argsort(keys)
    return {"tokens": tokens, "added": added, "single": single, "keys": keys[order], "rank": order.astype(np.int64), "made": made[order]}


class Merger:
    """Merges the bytes of words by rank."""

    def __init__(self, vocabulary: dict):
        self.single, self.keys, self.rank, self.made = (vocabulary[k] for k in ("single", "keys", "rank", "made"))
        self.pairs: dict[int, tuple[int, int]] | None = None
        # The sum of a pair's ids picks a slot; only pairs whose slot is used are looked up.
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.int64(0x9E3779B1) >> 21) & np.int64((1 << 20) - 1)

    def leaves(self, left: np.ndarray, right: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Rank and position of each pair as one number; _NONE where the pair can't be merged."""
        key = left << 32 | right
        out = np.full(len(key), _NONE)
        some = np.flatnonzero(self.seen.take(self._slot(key)) & (right >= 0))
        at = self.keys.searchsorted(key.take(some))
        at[at == len(self.keys)] = 0
        hit = self.keys.take(at) == key.take(some)
        some, at = some[hit], at[hit]
        out[some] = self.rank.take(at) << _POSITION_BITS | position.take(some)
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers; all words have the same length, at least 1."""
        n, count = len(words[0]), len(words)
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)].reshape(count, n)
        if n == 1:
            return [x.tobytes() for x in ids.astype("<u4")]
        if count < FEW:
            return [self.merge_one(row) for row in ids.tolist()]
        # All arrays are flat: word i holds ids from i * step on, with one more place for the word's end, and
        # its tree from i * size on, with the root at 1 and the leaves from width on.
        step, width = n + 1, 1 << (n - 2).bit_length() if n > 2 else 1
        size, levels = 2 * width, width.bit_length() - 1
        ids = np.concatenate([ids, np.full((count, 1), -1)], axis=1).ravel()
        after = np.tile(np.minimum(np.arange(1, step + 1), n), count)
        before = np.tile(np.arange(-1, n), count)
        tree = np.full((count, size), _NONE)
        grid = ids.reshape(count, step)
        tree[:, width : width + n - 1] = self.leaves(grid[:, : n - 1].ravel(), grid[:, 1:n].ravel(), np.tile(np.arange(n - 1), count)).reshape(count, n - 1)
        for level in range(levels):
            low = width >> (level + 1)
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
        tree = tree.ravel()

        def update(base: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            """Sets one leaf in each tree that begins at base, and the minima above it."""
            node = leaf + width
            tree[base + node] = value
            for _ in range(levels):
                value = np.minimum(value, tree.take(base + (node ^ 1)))
                node = node >> 1
                tree[base + node] = value

        row = np.flatnonzero(tree[1::size] < _NONE)
        while len(row):
            base, start = row * size, row * step
            at = tree.take(base + 1) & ((1 << _POSITION_BITS) - 1)
            here = start + at
            gone = after.take(here)
            there = start + gone
            new = self.made.take(self.keys.searchsorted(ids.take(here) << 32 | ids.take(there)))
            right = after.take(there)
            left = before.take(here)
            ids[here] = new
            ids[there] = -1
            after[here] = right
            before[start + right] = at
            update(base, at, self.leaves(new, ids.take(start + right), at))
            inner = np.flatnonzero(gone < n - 1)
            update(base.take(inner), gone.take(inner), np.full(len(inner), _NONE))
            has = np.flatnonzero(left >= 0)
            update(base.take(has), lefts := left.take(has), self.leaves(ids.take(start.take(has) + lefts), new.take(has), lefts))
            row = row[tree.take(base + 1) < _NONE]
        flat = ids.reshape(count, step)[:, :n]
        keep = flat >= 0
        data, ends = flat[keep].astype("<u4").tobytes(), np.cumsum(keep.sum(axis=1)) * 4
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def merge_one(self, ids: list[int]) -> bytes:
        """The same for one word, in plain numbers: steps over an array pay only for many words at once."""
        if self.pairs is None:
            self.pairs = dict(zip(self.keys.tolist(), zip((self.rank << _POSITION_BITS).tolist(), self.made.tolist(), strict=True), strict=True))
        n, pairs, none = len(ids), self.pairs, int(_NONE)
        unknown = (none, -1)
        after, before = [*range(1, n), n], [-1, *range(n - 1)]
        width = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = pairs.get(ids[i] << 32 | ids[i + 1], unknown)[0]
            tree[width + i] = rank | i if rank < none else none
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(leaf: int, rank: int) -> None:
            node = leaf + width
            tree[node] = rank | leaf if rank < none else none
            node >>= 1
            while node:
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    return
                tree[node] = least
                node >>= 1

        while tree[1] < none:
            at = tree[1] & ((1 << _POSITION_BITS) - 1)
            gone = after[at]
            new = ids[at] = pairs[ids[at] << 32 | ids[gone]][1]
            ids[gone] = -1
            right, left = after[gone], before[at]
            after[at] = right
            if right < n:
                before[right] = at
            update(at, pairs.get(new << 32 | ids[right], unknown)[0] if right < n else none)
            if gone < n - 1:
                update(gone, none)
            if left >= 0:
                update(left, pairs.get(ids[left] << 32 | new, unknown)[0])
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()


class Codec:
    """Encodes and decodes texts. memo bounds the remembered words, not the texts: a full memory starts anew."""

    def __init__(self, vocabulary: dict, memo: int = 200_000):
        self.tokens, self.added = vocabulary["tokens"], vocabulary["added"]
        self.merger, self.memo, self.known = Merger(vocabulary), memo, {}
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > self.memo:
            self.known.clear()
        groups: dict[int, list[str]] = {}
        coded = {w: w.encode() for w in words}
        for w, b in coded.items():
            groups.setdefault(len(b), []).append(w)
        for n, group in groups.items():
            step = max(1, STEP // n)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                self.known.update(zip(part, self.merger.merge([coded[w] for w in part]), strict=True))

    def pieces(self, text: str) -> list[str | int]:
        """The text's words, and the ids of the special tokens that stand in it."""
        if self.special is None or not any(t in text for t in self.added):
            return self.split(text)
        out: list[str | int] = []
        for part in self.special.split(text):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out += self.split(part)
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, a bounded number of texts at a time."""
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (size == 0 or size + len(texts[end]) <= 1_000_000):
                size += len(texts[end])
                end += 1
            split = [self.pieces(t) for t in texts[at:end]]
            words = {w for p in split for w in p if isinstance(w, str)} if self.special and any(isinstance(w, int) for p in split for w in p) else set().union(*split)
            known = self.known
            new = {w for w in words if w not in known}
            if new:
                self.learn(new)
                missing = {w for w in words if w not in known}  # the memory was emptied
                if missing:
                    self.learn(missing) if len(missing) <= self.memo else None
            for p in split:
                try:
                    yield b"".join(map(known.__getitem__, p))
                except KeyError:
                    yield b"".join(int(w).to_bytes(4, "little") if isinstance(w, int) else known[w] if w in known else self.merger.merge([w.encode()])[0] for w in p)
            at = end

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids; bytes that aren't UTF-8 become U+FFFD."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


SCHEMA = "n_tokens long, ids binary, decoded string"
DIGEST_SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _coded(docs: DataFrame, vocabulary_path: str, id_column: str, text_column: str, digest: bool) -> DataFrame:
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    rows = docs.select(F.col(id_column), F.col(text_column).cast("string").alias("__text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary.value)
        for batch in small(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts, first, second = [], [], []
            for ids in codec.encode(texts):
                text = codec.decode(ids)
                counts.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest() if digest else ids)
                second.append(hashlib.sha256(text.encode()).hexdigest() if digest else text)
            names = [id_column, "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string() if digest else pa.binary()), pa.array(second, pa.string())], names)

    return rows.mapInArrow(run, f"`{id_column}` {kind}, {DIGEST_SCHEMA if digest else SCHEMA}")


def bpe_round_trip(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_tokens, ids (little-endian unsigned 32-bit integers) and the decoded text of every whole text.

    A null text counts as empty: no ids, an empty text. Null ids, repeated rows and ties stay rows of their
    own; an empty table gives an empty one. Texts of any length are coded whole, a word without a space or other
    break too: its tree grows with it. Other columns aren't read. The only state is the vocabulary,
    broadcast once (its size is fixed), and a bounded memory of words in each task, so a lost task is
    simply run again. Nothing is shuffled.
    """
    return _coded(docs, vocabulary_path, id_column, text_column, digest=False)


def bpe_digests(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """As bpe_round_trip, with SHA-256 digests in place of ids and text, taken where they are made."""
    return _coded(docs, vocabulary_path, id_column, text_column, digest=True)
