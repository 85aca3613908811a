"""Ranked lexical search: the best documents for each item of a query set, found by presence masks.

One pass turns each document into its number of terms and the counts of those terms that the
items use; from this small table come all corpus statistics. A second pass goes over it in chunks of
documents. In a chunk each term has a bitmap of the documents that hold it. For an item,
terms that even together can't lift a document to its present best scores are left out; the OR
of the others' bitmaps gives the candidates, and the bits of all its terms the mask of each. Masks
are taken by descending maximum score (of each term in the mask, the most that it gives in
this chunk), their documents scored exactly, until the next mask can't reach the scores found.
So every document that isn't scored is known to stay below. Each task sends its best rows an
item; a window over these takes the last ones.

The items are handled in blocks of about BLOCK_BYTES of text, which bounds what is broadcast;
each block is searched against all documents.

Edge cases: a null or empty text has no terms and is never found; an item without terms has no rows; equal
rows of items count once, items of one id and different texts are ranked each for itself; repeated documents are
ranked one after the other; null ids come last among equal scores; no documents or no items give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .textops import _FOLD, buffer_of, same_bytes, slices, span_hashes, words

#: Documents of a chunk; documents that are scored before the first look at the best.
CHUNK_DOCS, FIRST_DOCS = 1 << 14, 64
#: Bytes of item texts that are searched at once, which bounds the broadcast.
BLOCK_BYTES = 4 << 20

#: A term is a maximal run of ASCII letters and digits and of anything beyond ASCII.
_BREAKS = np.ones(256, bool)
_BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


class Vocabulary:
    """The distinct terms of a block of items, by hash and bytes; term ids follow the hashes' order."""

    def __init__(self, texts: list[str]):
        buf, at = buffer_of(pa.array([t or "" for t in texts], pa.large_string()))
        folded = _FOLD[buf]
        starts, ends, of = words(folded, at, _BREAKS)
        hashes, first, inverse = np.unique(span_hashes(folded, starts, ends), return_index=True, return_inverse=True)
        self.hashes, self.size_of = hashes, (ends - starts)[first]
        self.bytes = np.frombuffer(b"".join(folded[a:b].tobytes() for a, b in zip(starts[first], ends[first], strict=True)), np.uint8)
        self.start_of = np.cumsum(self.size_of) - self.size_of
        if not self._same(folded, starts, ends, inverse).all():
            raise ValueError("two terms have one hash")
        # Each item's distinct terms and their repeats.
        self.items = [np.unique(inverse[a:b], return_counts=True) for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)]

    def _same(self, folded: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = (ends - starts) == self.size_of[ids]
        maybe = np.flatnonzero(out)
        out[maybe] = same_bytes(folded, starts[maybe], self.bytes, self.start_of[ids[maybe]], self.size_of[ids[maybe]])
        return out

    def find(self, folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The term id of each span, else -1; the bytes themselves decide."""
        if not len(self.hashes) or not len(starts):
            return np.full(len(starts), -1, np.int64)
        h = span_hashes(folded, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        hit = hit[self._same(folded, starts[hit], ends[hit], at[hit])]
        out = np.full(len(starts), -1, np.int64)
        out[hit] = at[hit]
        return out


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(flat.astype(np.int32)))


def index(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n, terms, tfs) of each document with a term: all its terms with repeats, and which of the vocabulary it holds how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    inp = docs.select(F.col(key).alias("__key"), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            buf, offsets = buffer_of(batch.column(1))
            for lo, hi in slices(offsets):
                part, at = _FOLD[buf[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, of = words(part, at, _BREAKS)
                n = np.diff(of)
                term = v.find(part, starts, ends)
                doc = np.repeat(np.arange(hi - lo), n)[term >= 0]
                wide = max(len(v.hashes), 1)
                pair, tf = np.unique(doc * wide + term[term >= 0], return_counts=True)
                full = np.flatnonzero(n)
                held = np.bincount(pair // wide, minlength=hi - lo)[full]
                cols = [batch.column(0).slice(lo, hi - lo).take(pa.array(full)), pa.array(n[full], pa.int64()), _lists(pair % wide, held), _lists(tf, held)]
                yield pa.RecordBatch.from_arrays(cols, ["__key", "n", "terms", "tfs"])

    return inp.mapInArrow(run, f"__key {inp.schema['__key'].dataType.simpleString()}, n long, terms array<int>, tfs array<int>")


def _document_counts(indexed: DataFrame, n_terms: int) -> dict[int, int]:
    """How many documents hold each term: summed in each task, then over tasks; as many rows as terms at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], ["term", "df"])

    rows = indexed.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {r.term: r.df for r in rows}


class Chunk:
    """Documents in the order of their ids: postings and bitmaps of each term."""

    def __init__(self, n: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_docs: int, n_all: int):
        self.size = len(n)
        top = int(n.max(initial=0))
        n = n.astype(object) if 25 * top * n_docs >= 2**63 else n  # beyond 64 bits Python's integers go on
        m = (75 + 25 * n * n_docs // n_all).astype(np.int64)
        doc = np.repeat(np.arange(self.size), counts)
        tf = tfs.astype(np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
        order = np.argsort(terms, kind="stable")
        self.doc, self.impact = doc[order], impact[order]
        present, first = np.unique(terms[order], return_index=True)
        ends = np.append(first, len(order))[1:]
        self.at = dict(zip(present.tolist(), zip(first.tolist(), ends.tolist(), strict=True), strict=True))
        self.most = dict(zip(present.tolist(), (np.maximum.reduceat(self.impact, first) if len(first) else first).tolist(), strict=True))
        self._bitmaps: dict[int, np.ndarray] = {}

    def bitmap(self, term: int) -> np.ndarray:
        """The documents that hold a term, as packed bits."""
        if term not in self._bitmaps:
            bits = np.zeros(self.size, bool)
            a, b = self.at[term]
            bits[self.doc[a:b]] = True
            self._bitmaps[term] = np.packbits(bits)
        return self._bitmaps[term]

    def scores(self, docs: np.ndarray, terms: list[int], values: list[int]) -> np.ndarray:
        """Exact scores of some documents for terms and what each gives per impact."""
        if 16 * len(docs) > self.size:
            every = np.zeros(self.size, np.int64)
            for t, v in zip(terms, values, strict=True):
                a, b = self.at[t]
                every[self.doc[a:b]] += v * self.impact[a:b]
            return every[docs]
        out = np.zeros(len(docs), np.int64)
        for t, v in zip(terms, values, strict=True):
            a, b = self.at[t]
            at = a + np.minimum(np.searchsorted(self.doc[a:b], docs), b - a - 1)
            out += np.where(self.doc[at] == docs, v * self.impact[at], 0)
        return out

    def best(self, terms: np.ndarray, values: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): the k best of at least `floor` (and above 0), equal scores by order; values: weight times repeats of each term."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = [(self.most[t] * v, t, v) for t, v in zip(terms.tolist(), values.tolist(), strict=True) if t in self.at and v]
        if not held:
            return none
        held.sort(reverse=True)
        gain = np.array([h[0] for h in held], np.int64)
        own, each = [h[1] for h in held], [h[2] for h in held]
        floor = max(floor, 1)
        rest = np.cumsum(gain[::-1])[::-1]  # what a term and all after it can give
        needed = int(np.count_nonzero(rest >= floor))
        if not needed:
            return none
        found = np.bitwise_or.reduce([self.bitmap(t) for t in own[:needed]])
        docs = np.flatnonzero(np.unpackbits(found, count=self.size))
        bits = np.unpackbits(np.stack([self.bitmap(t) for t in own]), axis=1, count=self.size)[:, docs]
        masks, group = np.unique(np.packbits(bits.T, axis=1), axis=0, return_inverse=True) if len(own) > 64 else _masks(bits)
        bound = np.unpackbits(masks, axis=1, count=len(own)).astype(np.int64) @ gain
        by = np.argsort(-bound, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        group = place[group.reshape(-1)]  # groups by descending bound
        docs = docs[np.argsort(group, kind="stable")]
        upto, bound = np.cumsum(np.bincount(group, minlength=len(by))), bound[by]
        top, score, lo, step = *none, 0, FIRST_DOCS
        while lo < len(upto) and bound[lo] >= floor:
            start = upto[lo - 1] if lo else 0
            hi = min(int(np.searchsorted(upto, start + step)) + 1, int(np.count_nonzero(bound >= floor)))
            some = docs[start : upto[hi - 1]]
            got = self.scores(some, own, each)
            fine = got >= floor
            top, score = np.append(top, some[fine]), np.append(score, got[fine])
            first = np.lexsort((top, -score))[:k]
            top, score = top[first], score[first]
            if len(top) == k:
                floor = max(floor, int(score[-1]))
            lo, step = hi, 2 * step
        return top, score


def _masks(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of at most 64 rows of bits, packed, and the place of each column among them."""
    packed = np.zeros((bits.shape[1], 8), np.uint8)
    own = np.packbits(bits.T, axis=1)
    packed[:, : own.shape[1]] = own
    masks, group = np.unique(packed.view(">u8").reshape(-1), return_inverse=True)
    return masks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, : own.shape[1]], group


def _search_block(docs: DataFrame, items: list, k: int, key: str, text_col: str) -> DataFrame:
    """(item, __key, score): the k best of each task for each item of one block."""
    spark = docs.sparkSession
    vocabulary = Vocabulary([r.text for r in items])
    indexed = stored(index(docs, vocabulary, key, text_col))
    total = indexed.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = _document_counts(indexed, len(vocabulary.hashes))
    weight = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary.hashes))], np.int64)
    queries = [(terms, weight[terms] * repeats) for terms, repeats in vocabulary.items]
    shared = spark.sparkContext.broadcast((queries, total.docs, max(total.terms, 1)))
    chunk_docs = CHUNK_DOCS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, n_docs, n_all = shared.value
        best: list[list[tuple]] = [[] for _ in queries]  # (-score, null id, id), ascending
        kind, waiting, rows = None, [], 0

        def take(table: pa.Table) -> None:
            table = table.take(pc.sort_indices(table, sort_keys=[("__key", "ascending")], null_placement="at_end")).combine_chunks()
            flat = lambda name: table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            counts = pc.list_value_length(table.column("terms")).to_numpy()
            c = Chunk(table.column("n").to_numpy(), counts, flat("terms"), flat("tfs"), n_docs, n_all)
            ids = table.column("__key")
            for own, (terms, values) in zip(best, queries, strict=True):
                top, score = c.best(terms, values, k, -own[-1][0] if len(own) == k else 0)
                if len(top):
                    got = ids.take(pa.array(top)).to_pylist()
                    own.extend((-s, i is None, 0 if i is None else i) for s, i in zip(score.tolist(), got, strict=True))
                    own.sort()
                    del own[k:]

        for batch in batches:
            kind = batch.schema.field("__key").type
            for lo in range(0, batch.num_rows, chunk_docs):
                part = batch.slice(lo, chunk_docs)
                if rows + part.num_rows > chunk_docs:
                    take(pa.Table.from_batches(waiting))
                    waiting, rows = [], 0
                waiting.append(part)
                rows += part.num_rows
        if rows:
            take(pa.Table.from_batches(waiting))
            flat = [(q, None if null else i, -s) for q, own in enumerate(best) for s, null, i in own]
            cols = [pa.array([f[0] for f in flat], pa.int64()), pa.array([f[1] for f in flat], kind), pa.array([f[2] for f in flat], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["item", "__key", "score"])

    return indexed.mapInArrow(run, f"item long, __key {indexed.schema['__key'].dataType.simpleString()}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text_col: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_key, rank, key, score): the k documents of the highest scores above 0 for each item, equal scores by ascending key."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text")).distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    parts = []
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        found = _search_block(docs, rows, k, key, text_col)
        w = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("__key").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item long, __item {items.schema[item_key].dataType.simpleString()}")
        part = found.join(F.broadcast(names), "item").select(F.col("__item").alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("__key").alias(key), "score")
        parts.append(part if blocks == 1 else stored(part))
    if not parts:
        return spark.createDataFrame([], f"`{item_key}` {items.schema[item_key].dataType.simpleString()}, rank int, `{key}` {docs.schema[key].dataType.simpleString()}, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
