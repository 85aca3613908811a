"""Language-model scoring with sharded Elias-Fano n-gram tries.

Documents are dealt into chunks by id and text, so that rows of one id spread. A chunk asks the word and n-gram shards about each distinct
word and n-gram it has, once, with its counts in training documents; a shard sums the counts of
all chunks, builds its trie, and answers every chunk in the order it asked. So both the model
and the lookups are spread by hash: no n-gram and no context is hot, as a chunk sends each at
most once. The documents are shuffled by chunk once and read twice. A message holds its shard's
range of mixed keys as an Elias-Fano list, and counts in two bits with an escape.

A chunk has about CHUNK_BYTES of text whatever the input's size, so that a task's memory doesn't
grow with it, until a message would stand for less than MESSAGE_BYTES of text; from there on
(10 GB of text at 6 MiB and 8 KiB) chunks grow with the input's root.

A shard's trie has a level of contexts (Elias-Fano), monotone pointers into the level of
successors (Elias-Fano), and the successors themselves, relative to their context, with 16-bit
codes of their probability: the count, of which the smoothed probability follows with the
context's count. The levels are written to one file, memory-mapped, and queried by
context-relative successor search.

Smoothing interpolates each order with the next lower one:
P(w | ctx) = (c(ctx, w) + T P'(w)) / (c(ctx) + T), T = c(ctx) ** TYPES_POWER standing for the
number of distinct successors; the lowest order is (c + 0.1) / (N + 0.1 (V + 1)).

Edge cases: null and empty texts are the end token alone; repeated rows share a chunk and score alike; with no
training rows all probabilities are 0.1 / 0.1 = 1 and scores 0; one document may be longer than
a chunk and is scored whole; an empty table gives no rows.

A word is known by 64 bits of its hash. An n-gram is known by a third of its key's bits of its
context's hash, and two thirds of a hash of the two together; the key has KEY_SPARE bits more than
the logarithm of the number of tokens, so about 2 ** -KEY_SPARE of the unseen n-grams are taken
for a seen one.
"""

from __future__ import annotations

import math
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import buffer_of, mix, pair_hash, slices, span_hashes, words

END = np.uint64(0xE4D0F0E4D0F0E4D1)
START = np.uint64(0x57A47057A4705731)
TYPES_POWER = 0.9
#: Text of a chunk, and of a chunk's part that goes to one of the shards, at the least.
CHUNK_BYTES, MESSAGE_BYTES = 6 << 20, 8192
KEY_SPARE = 14


#: Low bits at the most: with any offset in a byte they lie within eight bytes.
LOW_BITS = 57


class EliasFano:
    """n non-decreasing numbers below `universe` in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ranks = n, low_bits, low, high, ranks

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = min(LOW_BITS, max(0, int(math.log2(max(universe, 1) / n)))) if n else 0
        values = values.astype(np.uint64)
        low = np.zeros(n * bits // 8 + 9, np.uint8)
        if n and bits:
            for a in range(0, n, 1 << 16):
                each = np.unpackbits(values[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits]
                packed = np.packbits(each.ravel(), bitorder="little")
                low[a * bits // 8 : a * bits // 8 + len(packed)] = packed
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros((int(at[-1]) // 64 + 1) * 64 if n else 64, np.uint8)
        flags[at] = 1
        high = np.packbits(flags, bitorder="little").view("<u8")
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(high))]).astype(np.int64)
        return cls(n, bits, low, high, ranks)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.int64) * self.low_bits
        byte, out = bit >> 3, np.zeros(len(i), np.uint64)
        for k in range(min(8, (self.low_bits + 14) // 8)):
            out |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        return (out >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i: select in the high bits, and the low bits."""
        word = np.searchsorted(self.ranks, i, "right") - 1
        rest, bits, at = i - self.ranks[word], np.asarray(self.high)[word], np.zeros(len(i), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            right = rest >= below
            rest, at = np.where(right, rest - below, rest), np.where(right, at + width, at)
            bits = np.where(right, bits >> np.uint64(width), bits)
        return ((word * 64 + at - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(np.asarray(self.high).view(np.uint8), bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return ((at - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """First place in each [lo, hi) whose value is at least x, or hi: binary search over all queries at once."""
        lo, hi = lo.astype(np.int64).copy(), hi.astype(np.int64).copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self.get(mid) < x[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        return lo

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.ranks]


# 16-bit codes of counts: up to EXACT themselves, then in steps of about 0.04 % up to 2 ** 48.
EXACT = 4096
_STEP = (2.0**48 / EXACT) ** (1 / (65535 - EXACT))
VALUE_OF = np.concatenate([np.arange(EXACT + 1.0), EXACT * _STEP ** np.arange(1, 65536 - EXACT)])


def code_of(counts: np.ndarray) -> np.ndarray:
    c = np.maximum(counts.astype(float), 0)
    return np.where(c <= EXACT, c, EXACT + np.minimum(np.round(np.log(np.maximum(c, EXACT) / EXACT) / math.log(_STEP)), 65535 - EXACT)).astype(np.uint16)


def pack_codes(codes: np.ndarray) -> bytes:
    """The low bytes, then the high ones, which are nearly all zero and compress away."""
    return codes.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def unpack_codes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(2, -1).T).view("<u2").ravel()


class Trie:
    """Contexts, pointers, successors and codes of one shard; keys are context << word_bits | word, ascending and distinct."""

    def __init__(self, word_bits: int, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray):
        self.word_bits, self.contexts, self.pointers, self.successors, self.codes = word_bits, contexts, pointers, successors, codes

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, word_bits: int = 32) -> Trie:
        shift = np.uint64(word_bits)
        ctx = keys >> shift
        first = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1])) if len(keys) else np.zeros(0, np.int64)
        rank = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys)))).astype(np.uint64)
        relative = rank << shift | keys & np.uint64((1 << word_bits) - 1)
        return cls(word_bits, EliasFano.of(ctx[first], int(ctx[-1]) + 1 if len(keys) else 1), EliasFano.of(np.append(first, len(keys)), len(keys) + 1), EliasFano.of(relative, max(len(first), 1) << word_bits), code_of(counts))

    def save(self, path: str) -> None:
        arrays = [*self.contexts.parts(), *self.pointers.parts(), *self.successors.parts(), self.codes]
        with open(path, "wb") as out:
            np.array([self.word_bits, *[len(a) for a in arrays]], np.int64).tofile(out)
            for a in arrays:
                np.ascontiguousarray(a).tofile(out)
                out.write(b"\0" * (-a.nbytes % 8))

    @classmethod
    def map(cls, path: str) -> Trie:
        raw = np.memmap(path, np.uint8, "r")
        (word_bits, *sizes), at, arrays = raw[: 14 * 8].view(np.int64).tolist(), 14 * 8, []
        for n, kind in zip(sizes, [np.int64, np.uint8, np.uint64, np.int64] * 3 + [np.uint16], strict=True):
            nbytes = n * np.dtype(kind).itemsize
            arrays.append(raw[at : at + nbytes].view(kind))
            at += nbytes + (-nbytes % 8)
        levels = [EliasFano(int(arrays[k][0]), int(arrays[k][1]), *arrays[k + 1 : k + 4]) for k in (0, 4, 8)]
        return cls(word_bits, *levels, arrays[12])

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Codes of ascending keys, 0 where there is none."""
        out = np.zeros(len(keys), np.uint16)
        if not self.contexts.n or not len(keys):
            return out
        contexts, ctx = self.contexts.all(), keys >> np.uint64(self.word_bits)  # ascending as the keys are: one merge
        rank = np.minimum(np.searchsorted(contexts, ctx), len(contexts) - 1)
        known = np.flatnonzero(contexts[rank] == ctx)
        rank = rank[known]
        x = rank.astype(np.uint64) << np.uint64(self.word_bits) | keys[known] & np.uint64((1 << self.word_bits) - 1)
        lo, hi = self.pointers.get(rank).astype(np.int64), self.pointers.get(rank + 1).astype(np.int64)
        at = self.successors.successor(lo, hi, x)
        hit = np.flatnonzero(at < hi)
        hit = hit[self.successors.get(at[hit]) == x[hit]]
        out[known[hit]] = self.codes[at[hit]]
        return out


def word_bits(bits: int) -> int:
    """Bits of a key of so many that tell a context's successors apart."""
    return bits * 2 // 3


class Chunk:
    """Tokens of a chunk's documents: their distinct words and n-grams, scattered and ascending, and where each token has them."""

    def __init__(self, texts: pa.ChunkedArray, order: int, bits: int = 64):
        hashes, counts = [], []
        for part in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
            buf, at = buffer_of(part)
            for lo, hi in slices(at):
                own = buf[at[lo] : at[hi]]
                starts, ends, w = words(own, at[lo : hi + 1] - at[lo])
                hashes.append(span_hashes(own, starts, ends))
                counts.append(np.diff(w))
        n = np.concatenate(counts)
        self.n_tokens = n + 1
        edges = np.cumsum(self.n_tokens)
        h = np.full(edges[-1], END, np.uint64)
        inside = np.ones(len(h), bool)
        inside[edges - 1] = False
        h[inside] = np.concatenate(hashes)
        self.first = edges - self.n_tokens
        self.words, self.word_at = np.unique(scatter(h, 64), return_inverse=True)
        before = np.empty_like(h)
        before[1:], before[self.first] = h[:-1], START
        ctx, self.grams = before, []
        high, low = np.uint64(64 - bits), np.uint64((1 << word_bits(bits)) - 1)
        for n in range(2, order + 1):
            key = (mix(ctx + np.uint64(n)) >> high) & ~low | pair_hash(ctx, h, 7 + n) & low
            self.grams.append(np.unique(scatter(key, bits), return_inverse=True))
            older = np.empty_like(ctx)
            older[1:], older[self.first] = ctx[:-1], START
            ctx = pair_hash(older, before, n)

    def asked(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        return [(0, self.words, self.word_at), *[(n + 1, keys, at) for n, (keys, at) in enumerate(self.grams)]]


_ODD = (0x94D049BB133111EB, 0xBF58476D1CE4E5B9)


def scatter(x: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of the numbers of so many bits that spreads neighbours."""
    half, mask = np.uint64(bits - bits // 2), np.uint64((1 << bits) - 1)
    for odd in _ODD:
        x = ((x ^ (x >> half)) * np.uint64(odd)) & mask
    return x ^ (x >> half)


def gather(x: np.ndarray, bits: int) -> np.ndarray:
    """The inverse of scatter: a shift by half the bits or more undoes itself."""
    half, mask = np.uint64(bits - bits // 2), np.uint64((1 << bits) - 1)
    for odd in _ODD[::-1]:
        x = x ^ (x >> half)
        x = (x * np.uint64(pow(odd, -1, 1 << bits))) & mask
    return x ^ (x >> half)


def deal(keys: np.ndarray, shards: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of keys when scattered, these in that order, and the shards+1 edges: a shard has a range of `span_of` numbers."""
    far = scatter(keys, bits)
    by = np.argsort(far, kind="stable")
    far = far[by]
    return by, far, edges_of(far, shards, bits)


def edges_of(far: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """The shards+1 edges of ascending scattered keys."""
    starts = np.array([s * span_of(shards, bits) for s in range(shards)], np.uint64)
    return np.append(np.searchsorted(far, starts), len(far))


def span_of(shards: int, bits: int) -> int:
    return -(-(1 << bits) // shards)


def pack_keys(far: np.ndarray, shard: int, shards: int, bits: int) -> bytes:
    """Ascending distinct numbers of a shard's range as their count and an Elias-Fano list."""
    ef = EliasFano.of(far - np.uint64(shard * span_of(shards, bits)), span_of(shards, bits))
    return np.array([ef.n, ef.low_bits], "<i4").tobytes() + ef.low.tobytes() + ef.high.tobytes()


def unpack_keys(raw: bytes, shard: int, shards: int, bits: int) -> np.ndarray:
    n, low_bits = np.frombuffer(raw, "<i4", 2).tolist()
    rest = np.frombuffer(raw, np.uint8, offset=8)
    size = n * low_bits // 8 + 9
    return EliasFano(n, low_bits, rest[:size], rest[size:], np.zeros(0, np.int64)).all() + np.uint64(shard * span_of(shards, bits))


def pack_counts(counts: np.ndarray) -> bytes:
    """Two bits each: 0, 1, 2, or 3 for one that follows in a byte, whose 255 stands for one that follows in eight."""
    small = np.minimum(counts, 3).astype(np.uint8)
    more = counts[counts >= 3]
    return b"".join(x.tobytes() for x in (np.packbits(small & 1), np.packbits(small >> 1), np.minimum(more, 255).astype(np.uint8), more[more >= 255].astype("<u8")))


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    size = -(-n // 8)
    one, two = (np.unpackbits(np.frombuffer(raw, np.uint8, size, k * size), count=n) for k in (0, 1))
    out = (one + 2 * two).astype(np.uint64)
    at = np.flatnonzero(out == 3)
    out[at] = np.frombuffer(raw, np.uint8, len(at), 2 * size)
    at = at[out[at] == 255]
    out[at] = np.frombuffer(raw, "<u8", len(at), len(raw) - 8 * len(at))
    return out


ASK = "kind int, shard int, chunk long, keys binary, counts binary"
ANSWER = "chunk long, kind int, shard int, values binary, n long, v long"


def bits_of(kind: int, key_bits: int) -> int:
    return 64 if kind == 0 else key_bits


def _answer(table: pa.Table, shards: int, key_bits: int) -> pa.Table:
    """Sums of one shard: for words exact counts, for n-grams the codes of its trie."""
    kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
    bits = bits_of(kind, key_bits)
    asked = [gather(unpack_keys(k.as_py(), shard, shards, bits), bits) for k in table.column("keys")]
    told = [unpack_counts(c.as_py(), len(k)) for c, k in zip(table.column("counts"), asked, strict=True)]
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(told), minlength=len(keys)).astype(np.uint64)
    if kind == 0:
        values = total
    else:
        learned = total > 0
        handle, path = tempfile.mkstemp(suffix=".trie")
        os.close(handle)
        try:
            Trie.of(keys[learned], total[learned], word_bits(bits)).save(path)
            values = Trie.map(path).lookup(keys)
        finally:
            os.unlink(path)
    out = np.split(values[at], np.cumsum([len(a) for a in asked])[:-1])
    n = table.num_rows
    return pa.table(
        {
            "chunk": table.column("chunk"), "kind": pa.array([kind] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int32()), "values": pa.array([pack_counts(v) if kind == 0 else pack_codes(v) for v in out], pa.binary()),
            "n": pa.array([int(total.sum()) if kind == 0 else 0] * n, pa.int64()), "v": pa.array([int((total > 0).sum()) if kind == 0 else 0] * n, pa.int64()),
        }
    )


def score_documents(docs: DataFrame, held_out, order: int = 2, text_col: str = "text", chunks: int | None = None) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score; learned from the rows where held_out is false. Order 1 asks for no n-grams: score is base_score."""
    total = docs.agg(F.sum(F.octet_length(text_col)) + F.count(F.lit(1))).first()[0] or 0
    if chunks is None:
        chunks = max(4, math.ceil(total / max(CHUNK_BYTES, math.sqrt(total * MESSAGE_BYTES / 2))))
    shards = max(2, chunks // 2)
    key_bits = min(64, max(40, math.ceil(math.log2(max(total / 2, 2)) + KEY_SPARE)))  # a token has two bytes at the least
    rows = docs.select(F.pmod(F.xxhash64("doc_id", text_col), F.lit(chunks)).alias("chunk"), "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    out_type = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def ask(table: pa.Table) -> pa.Table:
        chunk = Chunk(table.column("text"), order, key_bits)
        train = np.repeat(~np.array(table.column("held_out")), chunk.n_tokens)
        rows = {"kind": [], "shard": [], "keys": [], "counts": []}
        for kind, far, at in chunk.asked():
            bits = bits_of(kind, key_bits)
            edges = edges_of(far, shards, bits)
            counts = np.bincount(at, weights=train, minlength=len(far)).astype(np.uint64)
            for s in range(shards):
                own = slice(edges[s], edges[s + 1])
                if edges[s] < edges[s + 1] or kind == 0:  # every word shard is asked, so that every chunk hears all of N and V
                    for name, value in zip(rows, (kind, s, pack_keys(far[own], s, shards, bits), pack_counts(counts[own])), strict=True):
                        rows[name].append(value)
        n = len(rows["kind"])
        return pa.table({"kind": pa.array(rows["kind"], pa.int32()), "shard": pa.array(rows["shard"], pa.int32()), "chunk": pa.array([table.column("chunk")[0].as_py()] * n, pa.int64()), "keys": pa.array(rows["keys"], pa.binary()), "counts": pa.array(rows["counts"], pa.binary())})

    def judge(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(table.column("text"), order, key_bits)
        got = {(k, s): v for k, s, v in zip(answers.column("kind").to_pylist(), answers.column("shard").to_pylist(), answers.column("values"), strict=True)}
        n, v = sum(answers.column("n").to_pylist()), sum(answers.column("v").to_pylist())
        found = []
        for kind, far, at in chunk.asked():
            edges = edges_of(far, shards, bits_of(kind, key_bits))
            values = np.zeros(len(far))
            for s in range(shards):
                if edges[s] < edges[s + 1]:
                    raw = got[kind, s].as_py()
                    values[edges[s] : edges[s + 1]] = unpack_counts(raw, edges[s + 1] - edges[s]) if kind == 0 else VALUE_OF[unpack_codes(raw)]
            found.append(values[at])
        c = found[0]
        p = (c + 0.1) / (n + 0.1 * (v + 1))
        base = np.log10(p)
        end_count = c[chunk.first[0] + chunk.n_tokens[0] - 1]
        context = np.empty_like(c)
        context[1:], context[chunk.first] = c[:-1], end_count  # as many starts as ends
        for joint in found[1:]:
            joint = np.minimum(joint, context)
            types = context**TYPES_POWER
            p = np.where(context > 0, (joint + types * p) / np.maximum(context + types, 1e-300), p)
            longer = np.empty_like(joint)
            longer[1:], longer[chunk.first] = joint[:-1], end_count
            context = longer
        each = lambda x: np.add.reduceat(x, chunk.first)
        return pa.table(
            {
                "doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": pa.array(chunk.n_tokens.astype(np.int64)), "n_known": pa.array(each((c > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(table.num_rows, n, np.int64)), "base_score": pa.array(each(base)), "score": pa.array(each(np.log10(p))),
            }
        )

    asked = rows.groupBy("chunk").applyInArrow(ask, ASK)
    answers = asked.groupBy("kind", "shard").applyInArrow(lambda table: _answer(table, shards, key_bits), ANSWER)
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(judge, out_type)
