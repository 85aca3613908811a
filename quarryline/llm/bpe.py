"""Byte-level BPE encoding and decoding in two tiers.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is itself an
entry; all distinct pre-tokens of a batch of texts are looked up at once, in numpy. Tier two: a
heap of adjacent pairs over a linked list of bytes merges the rest by rank.

The codec is built once, in the driver, and broadcast; its size is the vocabulary's. What tier
two has worked out, a worker remembers, up to CACHE_ENTRIES pre-tokens.

Edge cases: a null text counts as empty; an empty text gives no ids; texts and single
pre-tokens of any length are encoded whole (n log n); repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import buffer_of, mix, slices, span_hashes

#: Pre-tokens whose merges a worker remembers before it starts afresh.
CACHE_ENTRIES = 600_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token of a vocabulary file with lines 'base64 rank'."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class PerfectHash:
    """Minimal perfect hash (hash and displace) of n 64-bit numbers: n slots, buckets of about three keys.

    A bucket of several keys stores the displacement at which they all fall on free slots; a
    bucket of one key stores its slot, as -1 - slot.
    """

    def __init__(self, keys: np.ndarray):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        bucket, g, step = self._split(keys)
        by = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.buckets)
        first = np.cumsum(size) - size
        self.seed, free = np.zeros(self.buckets, np.int64), np.ones(n, bool)
        g_of, step_of = g.tolist(), step.tolist()
        for b in np.argsort(-size, kind="stable").tolist():
            own = by[first[b] : first[b] + size[b]].tolist()
            if len(own) < 2:
                break
            d = 0
            while True:
                slots = {((g_of[k] + d * step_of[k] & 0xFFFFFFFFFFFFFFFF) >> 16) % n for k in own}
                if len(slots) == len(own) and all(free[s] for s in slots):
                    break
                d += 1
            self.seed[b] = d
            free[list(slots)] = False
        alone = np.flatnonzero(size == 1)
        self.seed[alone] = -1 - np.flatnonzero(free)

    def _split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (keys % np.uint64(self.buckets)).astype(np.int64), mix(keys + np.uint64(1)), mix(keys + np.uint64(2)) | np.uint64(1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; of an unknown key, any."""
        if not self.n:
            return np.zeros(len(keys), np.int64)
        bucket, g, step = self._split(keys)
        d = self.seed[bucket]
        placed = ((g + np.maximum(d, 0).astype(np.uint64) * step) >> np.uint64(16)) % np.uint64(self.n)
        return np.where(d < 0, -1 - d, placed.astype(np.int64))


class Codec:
    """Encoder and decoder of one vocabulary; what pickles is the vocabulary and its perfect hash."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        tokens = sorted(ranks)
        ends = np.cumsum([len(t) for t in tokens], dtype=np.int64)
        buf = np.frombuffer(b"".join(tokens), np.uint8)
        keys = self._hashes(buf, np.append(0, ends[:-1])[: len(tokens)], ends)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two tokens have one hash")
        self.hash = PerfectHash(keys)
        at = np.empty(len(tokens), np.int64)
        at[self.hash.slots(keys)] = np.arange(len(tokens))
        self.tokens = [tokens[k] for k in at]
        self.rank_at = np.array([ranks[t] for t in self.tokens], np.int64)
        self.size_at = np.array([len(t) for t in self.tokens], np.int64)
        self.bytes_at = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.start_at = np.cumsum(self.size_at) - self.size_at
        self.digest = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()

    @staticmethod
    def _hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return span_hashes(buf, starts, ends, fold=False)

    def ready(self) -> Codec:
        """Adds what a worker works out for itself: the pairs that merge, the pattern, and its memory of merges."""
        self.bytes_of = dict(zip(self.rank_at.tolist(), self.tokens, strict=True))
        rank = dict(zip(self.tokens, self.rank_at.tolist(), strict=True))
        self.shift = max(rank.values(), default=0).bit_length()
        self.byte_rank = [rank.get(bytes([b]), -1) for b in range(256)]
        self.pair: dict[int, int] = {}
        for token, r in rank.items():
            for k in range(1, len(token)):
                left, right = rank.get(token[:k]), rank.get(token[k:])
                if left is not None and right is not None:
                    self.pair[left << self.shift | right] = r
        one = [(b, r) for b, r in enumerate(self.byte_rank) if r >= 0]
        self.first_pair = [-1] * 65536
        for a, left in one:
            for b, right in one:
                self.first_pair[a << 8 | b] = self.pair.get(left << self.shift | right, -1)
        self.find = regex.compile(self.pattern).findall
        self.merged: dict[str, tuple[int, ...]] = {}
        return self

    def lookup(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tier one: the rank of each span of bytes that is in the vocabulary, else -1."""
        out = np.full(len(starts), -1, np.int64)
        if not len(starts) or not self.hash.n:
            return out
        slot, size = self.hash.slots(self._hashes(buf, starts, ends)), ends - starts
        maybe = np.flatnonzero(size == self.size_at[slot])
        # The bytes themselves decide.
        n = size[maybe]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        same = buf[np.repeat(starts[maybe], n) + step] == self.bytes_at[np.repeat(self.start_at[slot[maybe]], n) + step]
        wrong = np.bincount(np.repeat(np.arange(len(maybe)), n), weights=~same, minlength=len(maybe))
        maybe = maybe[wrong == 0]
        out[maybe] = self.rank_at[slot[maybe]]
        return out

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Tier two: lowest rank first, leftmost among equals, over a linked list of parts.

        A heap entry is rank and place in one number; it counts only while the pair at its place
        still has that rank.
        """
        get, shift, first, n = self.pair.get, self.shift, self.first_pair, len(piece)
        part = [self.byte_rank[b] for b in piece]
        if min(part) < 0:
            raise ValueError(f"the vocabulary lacks a byte of {piece[:32]!r}")
        width = n.bit_length()
        mask = (1 << width) - 1
        now = [first[a << 8 | b] for a, b in zip(piece, piece[1:])]  # noqa: B905
        now.append(-1)
        heap = [r << width | i for i, r in enumerate(now) if r >= 0]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            x = heappop(heap)
            i = x & mask
            r = x >> width
            if now[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            part[i] = r
            part[j] = now[j] = -1
            if k < n:
                before[k] = i
                q = now[i] = get(r << shift | part[k], -1)
                if q >= 0:
                    heappush(heap, q << width | i)
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                q = now[h] = get(part[h] << shift | r, -1)
                if q >= 0:
                    heappush(heap, q << width | h)
        return tuple([x for x in part if x >= 0])

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. Each distinct pre-token of all of them is looked up once."""
        pieces = [self.find(t) for t in texts]
        distinct = list(set(chain.from_iterable(pieces)))
        raw = [p.encode() for p in distinct]
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        ranks = self.lookup(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends).tolist() if raw else []
        if len(self.merged) > CACHE_ENTRIES:
            self.merged.clear()
        ids_of, merged = {}, self.merged
        for p, r, b in zip(distinct, ranks, raw, strict=True):
            if r >= 0:
                ids_of[p] = (r,)
            else:
                ids = merged.get(p)
                if ids is None:
                    ids = merged[p] = self.merge(b)
                ids_of[p] = ids
        return [list(chain.from_iterable(map(ids_of.__getitem__, own))) for own in pieces]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_READY: dict[str, Codec] = {}


def on_worker(shared: Codec) -> Codec:
    """The worker's own codec of a vocabulary, by a digest of all of it and its pattern."""
    if shared.digest not in _READY:
        _READY.clear()
        _READY[shared.digest] = shared.ready()
    return _READY[shared.digest]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """Per document: the `keep` columns, n_tokens, ids (array<int>, if asked for), ids_sha256 and decoded_sha256.

    The codec, of the vocabulary's size, is broadcast; no shuffle.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Codec(read_ranks(ranks_path), pattern))
    inp = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    extra = ", ids array<int>" if ids else ""
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inp.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = on_worker(shared.value)
        text_of = {r: str(r) for r in c.bytes_of}
        for batch in batches:
            for lo, hi in slices(buffer_of(batch.column(batch.num_columns - 1))[1]):
                part = batch.slice(lo, hi - lo)
                every = c.encode_all([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                sha = [hashlib.sha256(" ".join(map(text_of.__getitem__, got)).encode()).hexdigest() for got in every]
                back = [hashlib.sha256(c.decode(got)).hexdigest() for got in every]
                cols = [*part.columns[:-1], pa.array([len(got) for got in every], pa.int64()), *([pa.array(every, pa.list_(pa.int32()))] if ids else []), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, [*part.schema.names[:-1], "n_tokens", *(["ids"] if ids else []), "ids_sha256", "decoded_sha256"])

    return inp.mapInArrow(run, f"{head}, n_tokens long{extra}, ids_sha256 string, decoded_sha256 string")


def decode_documents(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns and text: the ids' bytes as UTF-8 (a stray byte gives U+FFFD; null ids give null)."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    @F.pandas_udf("string")
    def text_of(col):
        table = {r: k for k, r in shared.value.items()}
        return col.map(lambda x: None if x is None else b"".join(table[i] for i in x).decode("utf-8", "replace"))

    return encoded.select(*keep, text_of(F.col(ids_col)).alias("text"))
