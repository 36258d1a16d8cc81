"""Counting quotient filters over runs of word ids, without loss.

A run of k ids of some bits each is packed into two or more lanes of up to 64 bits. Rounds that add a hash of the other
lanes to each lane permute all such keys: every key has one image and every image one key. The image's upper bits
are its quotient, the others its remainder, kept in full, so a filter counts keys and never mixes two of them up. In memory a filter
is its entries in order of their images; on its way between tasks it is the classical layout: a bit string
that gives each quotient's entries in unary, remainders in as many bytes as they need, counters in a byte each with
larger ones apart. Filters with the same layout merge as sorted lists do.
"""

from __future__ import annotations

import struct

import numpy as np

from .common import mix64

ROUNDS = 2
_ADDED = np.uint64(0x632BE59BD9B4E019)


class Layout:
    """How k ids of so many bits become lanes, and lanes the sort keys of a filter."""

    def __init__(self, k: int, bits: int):
        self.k, self.bits = k, bits
        lanes = max(2, -(-k // (64 // bits)))
        self.words = [k // lanes + (i < k % lanes) for i in range(lanes)]
        self.widths = [w * bits for w in self.words]
        # Keys that fit into one number are one, others are compared lane by lane.
        self.keys = [sum(self.widths)] if sum(self.widths) <= 64 else self.widths

    def pack(self, ids: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Lanes of the k ids from each place on."""
        lanes, first = [], 0
        for words in self.words:
            lane = np.zeros(len(at), np.uint64)
            for i in range(first, first + words):
                lane = lane << np.uint64(self.bits) | ids[at + i]
            lanes.append(lane)
            first += words
        return lanes

    def unpack(self, lanes: list[np.ndarray]) -> np.ndarray:
        """The k ids of each key as a row."""
        mask, columns = np.uint64((1 << self.bits) - 1), []
        for lane, words in zip(lanes, self.words, strict=True):
            columns += [lane >> np.uint64(self.bits * i) & mask for i in range(words - 1, -1, -1)]
        return np.stack(columns, axis=1).astype(np.uint32)

    def _round(self, lanes: list[np.ndarray], i: int, r: int) -> None:
        others = np.full(len(lanes[0]), (r * 8 + i + 1) * int(_ADDED) & (2**64 - 1), np.uint64)
        for j, lane in enumerate(lanes):
            if j != i:
                others = mix64(others + lane)
        lanes[i] = lanes[i] ^ (others & np.uint64((1 << self.widths[i]) - 1))

    def permute(self, lanes: list[np.ndarray]) -> list[np.ndarray]:
        """Images of packed keys, as sort keys with the most significant first."""
        lanes = list(lanes)
        for r in range(ROUNDS):
            for i in range(len(lanes)):
                self._round(lanes, i, r)
        if len(self.keys) > 1:
            return lanes
        joined = lanes[0]
        for lane, width in zip(lanes[1:], self.widths[1:], strict=True):
            joined = joined << np.uint64(width) | lane
        return [joined]

    def restore(self, keys: list[np.ndarray]) -> list[np.ndarray]:
        """The packed keys of images."""
        lanes = list(keys)
        if len(self.keys) == 1:
            joined, lanes = keys[0], []
            for width in reversed(self.widths):
                lanes.insert(0, joined & np.uint64((1 << width) - 1))
                joined = joined >> np.uint64(width) if width < 64 else joined
        for r in range(ROUNDS - 1, -1, -1):
            for i in range(len(lanes) - 1, -1, -1):
                self._round(lanes, i, r)
        return lanes


def summed(keys: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys in order, with the sums of their counts (1 each where none are given)."""
    if not len(keys[0]):
        return keys, np.zeros(0, np.int64)
    if len(keys) == 1 and counts is None:
        first = np.sort(keys[0])
        keys = [first]
    else:
        order = np.argsort(keys[0])
        if len(keys) > 1:
            same = keys[0][order][1:] == keys[0][order][:-1]
            if any((k[order][1:] != k[order][:-1])[same].any() for k in keys[1:]):
                order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        counts = counts if counts is None else counts[order]
    fresh = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    at = np.flatnonzero(fresh)
    sums = np.diff(np.append(at, len(fresh))) if counts is None else np.add.reduceat(counts, at)
    return [k[at] for k in keys], sums.astype(np.int64)


class CountingQuotientFilter:
    """Counts keys of one layout; what is added waits until it is worth merging."""

    def __init__(self, layout: Layout, pending: int = 500_000):
        self.layout, self.pending = layout, pending
        self.keys, self.counts = [np.zeros(0, np.uint64) for _ in layout.keys], np.zeros(0, np.int64)
        self.parts: list[tuple[list[np.ndarray], np.ndarray]] = []
        self.waiting = 0

    def add(self, lanes: list[np.ndarray]) -> None:
        """Count packed keys, any number of each."""
        self.add_sorted(*summed(self.layout.permute(lanes)))

    def add_sorted(self, keys: list[np.ndarray], counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.waiting += len(counts)
        if self.waiting > max(self.pending, len(self.counts)):
            self.settle()

    def settle(self) -> None:
        """Merge what waits into the entries."""
        if self.parts:
            parts = [(self.keys, self.counts), *self.parts]
            self.keys, self.counts = summed([np.concatenate(x) for x in zip(*[p[0] for p in parts], strict=True)], np.concatenate([p[1] for p in parts]))
            self.parts, self.waiting = [], 0

    def __len__(self) -> int:
        return len(self.counts) + self.waiting

    def shards(self, shard_bits: int):
        """(shard, bytes) for each value of the quotient's first bits that has entries."""
        self.settle()
        width, shard_bits = self.layout.keys[0], min(shard_bits, self.layout.keys[0])
        shard = (self.keys[0] >> np.uint64(width - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(self.counts), np.int64)
        at = [*np.flatnonzero(np.diff(shard, prepend=-1)).tolist(), len(shard)]
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield int(shard[a]), self.to_bytes(a, b, shard_bits)

    def to_bytes(self, a: int, b: int, shard_bits: int) -> bytes:
        """Entries a to b, which share the first shard_bits of their quotients."""
        n, width = b - a, self.layout.keys[0]
        q = min(shard_bits + max(n.bit_length() - 1, 0), width)
        first, counts = self.keys[0][a:b], self.counts[a:b]
        local = (first >> np.uint64(width - q)).astype(np.int64) & ((1 << q - shard_bits) - 1) if q else np.zeros(n, np.int64)
        runs = np.zeros(n + (1 << q - shard_bits), np.uint8)
        runs[np.arange(n) + local] = 1
        rests = [rest_bytes(first & np.uint64((1 << width - q) - 1), width - q), *[rest_bytes(k[a:b], w) for k, w in zip(self.keys[1:], self.layout.keys[1:], strict=True)]]
        small = np.minimum(counts, 255).astype(np.uint8)
        return b"".join([struct.pack("<qh", n, q), np.packbits(runs).tobytes(), *rests, small.tobytes(), counts[small == 255].astype("<i8").tobytes()])

    def add_bytes(self, raw: bytes, shard: int, shard_bits: int) -> None:
        """Merge what to_bytes has made of a filter's shard."""
        width, shard_bits = self.layout.keys[0], min(shard_bits, self.layout.keys[0])
        n, q = struct.unpack_from("<qh", raw)
        size = n + (1 << q - shard_bits)
        at = 10 + (size + 7) // 8
        runs = np.unpackbits(np.frombuffer(raw, np.uint8, at - 10, 10))[:size]
        quotients = (np.flatnonzero(runs) - np.arange(n)).astype(np.uint64) | np.uint64(shard << q - shard_bits)
        keys = []
        for i, w in enumerate([width - q, *self.layout.keys[1:]]):
            rest, taken = rest_values(raw, at, n, w)
            keys.append(rest | quotients << np.uint64(width - q) if i == 0 and width - q < 64 else rest)
            at += taken
        counts = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
        large = counts == 255
        counts[large] = np.frombuffer(raw, "<i8", int(large.sum()), at + n)
        self.add_sorted(keys, counts)

    def frequent(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of keys counted so often, as rows, and their counts."""
        self.settle()
        some = self.counts >= least
        return self.layout.unpack(self.layout.restore([k[some] for k in self.keys])), self.counts[some]


def rest_bytes(values: np.ndarray, width: int) -> bytes:
    """Numbers of so many bits in as few bytes each as hold them."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (width + 7) // 8].tobytes()


def rest_values(raw: bytes, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    size = (width + 7) // 8
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(n, size)
    return out.view("<u8").ravel(), n * size
