"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, of their first bytes (an inflected or
compounded word keeps its stem), of adjacent pairs and of pairs with one word between, after
lower-casing A-Z and taking ASCII punctuation as white space. Each
coordinate has its own learning rate; L1 leaves few weights that aren't zero, so that the model
is a sorted array of (hash, weight) of bounded size, which is broadcast.

It is fitted on a bounded sample of labelled rows (TRAIN_ROWS, least by a hash of doc_id), whole
texts each; scoring covers every row and whole texts, without a shuffle.

Edge cases: null and empty texts have the bias only and so score the base rate; a text of any
length is used whole; repeated rows score alike; without labelled rows every score is 0.5;
columns of the label table other than its key and label don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import buffer_of, mix, pair_hash, slices, span_hashes, words

#: Most labelled rows that the model is fitted on.
TRAIN_ROWS = 8_000
#: Feature space: hashes are cut to so many bits.
HASH_BITS = 26
#: Bytes of a longer word that count as its stem.
STEM = 4
THRESHOLD = 0.3
_PUNCT = np.arange(256, dtype=np.uint8)
_PUNCT[[c for c in range(128) if not chr(c).isalnum()]] = 0x20


def features(buf: np.ndarray, at: np.ndarray, bits: int = HASH_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts (repeats included) and the text of each."""
    plain = _PUNCT[buf]
    starts, ends, w = words(plain, at)
    h = span_hashes(plain, starts, ends)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(w))
    out, of = [h], [doc]
    long = ends - starts > STEM
    out.append(mix(span_hashes(plain, starts[long], starts[long] + STEM) + np.uint64(10)))
    of.append(doc[long])
    for gap, salt in ((1, 11), (2, 12)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            out.append(pair_hash(h[:-gap], h[gap:], salt)[same])
            of.append(doc[gap:][same])
    return (np.concatenate(out) >> np.uint64(64 - bits)).astype(np.int32), np.concatenate(of)


@dataclass
class Model:
    """Bias and the weights that aren't zero, by ascending feature number."""

    bias: float
    keys: np.ndarray
    weights: np.ndarray
    bits: int = HASH_BITS

    def scores(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.full(len(at) - 1, self.bias)
        if len(self.keys):
            f, doc = features(buf, at, self.bits)
            k = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
            hit = self.keys[k] == f
            both = np.unique(doc[hit].astype(np.int64) * len(self.keys) + k[hit])  # a feature counts once a text
            np.add.at(total, both // len(self.keys), self.weights[both % len(self.keys)])
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit_ftrl(rows: list[tuple[np.ndarray, int]], bits: int = HASH_BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 10.0, l2: float = 1.0, epochs: int = 4) -> Model:
    """FTRL-proximal over (distinct features, label) rows, in their order."""
    if not rows:
        return Model(0.0, np.zeros(0, np.int32), np.zeros(0), bits)
    # A gradient is at most 1, so a feature of few rows never passes l1: leaving it out changes nothing.
    seen = np.zeros(1 << bits, np.uint8)
    for f, _ in rows:
        seen[f] = np.minimum(seen[f], 254) + 1
    kept = [f[seen[f].astype(np.int64) * epochs > l1] for f, _ in rows]
    del seen
    vocabulary = np.unique(np.concatenate(kept))
    ids = [np.searchsorted(vocabulary, f) for f in kept]
    z, n = np.zeros(len(vocabulary)), np.zeros(len(vocabulary))
    rate = min(max(np.mean([y for _, y in rows]), 1e-3), 1 - 1e-3)
    bias, bias_n = float(np.log(rate / (1 - rate))), 0.0

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for f, (_, y) in zip(ids, rows, strict=True):
            zi, ni = z[f], n[f]
            w = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            z[f] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[f] = ni + g * g
            bias_n += g * g
            bias -= alpha / (beta + bias_n**0.5) * g
    w = weights(z, n)
    keep = np.flatnonzero(w)
    return Model(bias, vocabulary[keep], w[keep], bits)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", usable: Column | None = None, train_rows: int = TRAIN_ROWS, text_col: str = "text", **options) -> Model:
    """A model from at most train_rows labelled documents; `usable` is a condition on doc_id."""
    marked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__y"))
    if usable is not None:
        marked = marked.filter(usable)
    chosen = marked.dropDuplicates(["__id"]).orderBy(F.xxhash64("__id"), "__id").limit(train_rows)
    rows = docs.select(F.col("doc_id").alias("__doc"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("__id", "__y", "__text")
    bits = options.get("bits", HASH_BITS)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = buffer_of(batch.column(2))
            for lo, hi in slices(at):
                f, doc = features(buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], bits)
                both = np.unique(doc.astype(np.int64) << 32 | f)
                edges = np.searchsorted(both >> 32, np.arange(hi - lo + 1))
                f = (both & 0xFFFFFFFF).astype("<i4")
                packed = [f[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(packed, pa.binary())], ["id", "y", "f"])

    got = rows.mapInArrow(hashed, f"id {rows.schema['__id'].dataType.simpleString()}, y int, f binary")
    local = sorted(((r.id, r.y, r.f) for r in got.toLocalIterator()), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    seen: dict = {}
    for i, y, f in local:
        seen.setdefault(i, (np.frombuffer(f, "<i4"), y))
    return fit_ftrl(list(seen.values()), **options)


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inp = docs.select("doc_id", F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = buffer_of(batch.column(1))
            for lo, hi in slices(at):
                s = shared.value.scores(buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return inp.mapInArrow(run, f"doc_id {inp.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at or above the threshold; rows pass through the scorer whole, unshuffled."""
    shared, at_text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = buffer_of(batch.column(at_text))
            for lo, hi in slices(at):
                s = shared.value.scores(buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                yield batch.slice(lo, hi - lo).filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)
