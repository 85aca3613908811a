"""Quality by co-training: a text view and a metadata view teach each other.

Each view is a logistic regression. The text view sees what is written: character classes,
repetition, hashed words. The metadata view sees what a crawl records without reading: source,
language, length, and the sizes in bytes, words and lines against each other. Over some rounds,
each view scores unlabelled rows, and the other learns those that it is sure of as well.
Both are then calibrated on labelled rows set aside, and their calibrated log odds are combined,
again fitted on those rows.

The fit uses at most TRAIN_ROWS labelled rows, the least by a hash of doc_id, of whole texts. In every
round a view hands over the unlabelled rows of the least hashes that it is at least `trust` sure of, at
most HANDED_ROWS times the round's number. They are the first ones in the order of hashes, so the search
begins with a part of the rows and goes on to all of them only where too few are sure; the
features of the part are kept between rounds in the checkpoint folder (about 800 bytes a row). What is
found depends neither on partitions nor on where the rows lie. Scoring covers all rows and whole
texts, unshuffled.

Edge cases: null and empty texts have zero text features and are scored by metadata and bias;
null metadata is a value of its own; without labels of both kinds every score is the base rate;
repeated rows score alike; other columns of the label table don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut
from .textops import buffer_of, slices, span_hashes, window_hashes, words

TRAIN_ROWS = 8_000
#: Most rows that a view hands over in the first round; in the n-th, n times as many. Both labels together.
HANDED_ROWS = 1_000
#: Rows in the first part that is searched for sure ones, times those wanted; and by how much a part grows.
SEARCH_TIMES = 8
TEXT_BUCKETS, META_BUCKETS = 256, 128
STATS = 12
#: Rows of the labelled sample, of ten, that are set aside for calibration.
CALIBRATION_TENTHS = 3


def text_view(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shares of byte classes, repetition and word shape, then log shares of hashed words."""
    n_docs = len(at) - 1
    size = np.maximum(np.diff(at), 1).astype(float)
    starts, ends, w = words(buf, at)
    h = span_hashes(buf, starts, ends)
    n = np.maximum(np.diff(w), 1).astype(float)
    doc = np.repeat(np.arange(n_docs), np.diff(w))
    byte_doc = np.repeat(np.arange(n_docs), np.diff(at))
    share = lambda mask: np.bincount(byte_doc[mask], minlength=n_docs) / size
    is_ = lambda chars: np.isin(buf, np.frombuffer(chars.encode(), np.uint8))
    distinct = lambda x, d, m: np.bincount(d[np.unique(x ^ (d.astype(np.uint64) << np.uint64(40)), return_index=True)[1]], minlength=n_docs) / m
    g, ge = window_hashes(h, w, 3)
    gdoc = np.repeat(np.arange(n_docs), np.diff(ge))
    long = ends - starts
    stats = np.stack(
        [
            share((buf >= 65) & (buf <= 90)), share((buf >= 97) & (buf <= 122)), share((buf >= 48) & (buf <= 57)), share(buf >= 128), share(is_("%$#&*@^~=<>{}[]\\")),
            share(is_("!?")), share(is_("|_+")), share(is_(".,;:")) * 4, distinct(h, doc, n) if len(h) else np.zeros(n_docs), distinct(g, gdoc, np.maximum(np.diff(ge), 1)) if len(g) else np.zeros(n_docs),
            np.bincount(doc, weights=long, minlength=n_docs) / n / 10, np.log1p(np.diff(w)) / 10,
        ],
        axis=1,
    )
    bag = np.bincount(doc * TEXT_BUCKETS + (h % np.uint64(TEXT_BUCKETS)).astype(np.int64), minlength=n_docs * TEXT_BUCKETS).reshape(n_docs, TEXT_BUCKETS)
    return np.hstack([stats, np.sqrt(bag / n[:, None])]).astype(np.float32)


def sizes(buf: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Bands of each text's size in bytes, its bytes per word, and its words per line."""
    starts, _, w = words(buf, at)
    n_bytes, n_words = np.diff(at), np.diff(w)
    lines = 1 + np.diff(np.append(0, np.cumsum(buf == 10))[at])
    band = lambda x, steps: np.floor(steps * np.log2(1 + x)).astype(int)
    return {"bytes": band(n_bytes, 1), "word": band(n_bytes / np.maximum(n_words, 1), 6), "line": band(n_words / lines, 2)}


def meta_view(columns: list[pa.Array], names: list[str], measured: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """Hashed name=value of each metadata column; of numbers, the power of two; and of measured bands."""
    measured = measured or {}
    n = len(columns[0]) if columns else len(next(iter(measured.values()), ()))
    out = np.zeros((n, META_BUCKETS), np.float32)
    values_of = {}
    for name, column in zip(names, columns, strict=True):
        values = column.to_pylist()
        if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
            values = [None if v is None else int(np.log2(1 + max(v, 0))) for v in values]
        values_of[name] = values
    for name, values in {**values_of, **{f"size {k}": v.tolist() for k, v in measured.items()}}.items():
        slot = {v: xxhash.xxh32_intdigest(f"{name}={v!r}") % META_BUCKETS for v in set(values)}
        out[np.arange(n), [slot[v] for v in values]] = 1
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0, steps: int = 25) -> np.ndarray:
    """Newton steps; the last coefficient is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """Coefficients of both views, of their calibrations, and of the combination."""

    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray
    meta_scale: np.ndarray
    both: np.ndarray

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = odds(odds(text, self.text)[:, None], self.text_scale), odds(odds(meta, self.meta)[:, None], self.meta_scale)
        return sigmoid(odds(np.stack([a, b], 1), self.both)), sigmoid(a), sigmoid(b)


class Pool:
    """Unlabelled rows at hand, as the two views' arrays."""

    def __init__(self, text: np.ndarray, meta: np.ndarray):
        self.views = (text, meta)

    def sure(self, w: list[np.ndarray], trust: float, quota: dict[float, int]) -> dict[tuple[int, float], tuple[np.ndarray, np.ndarray]]:
        """Per view and label: both views' rows of which that view is at least `trust` sure, at most the label's quota."""
        out = {}
        for k, x in enumerate(self.views):
            p = sigmoid(odds(x, w[k])) if len(x) else np.zeros(0)
            for label, n in quota.items():
                best = np.flatnonzero((p if label else 1 - p) >= trust)[:n]
                out[k, label] = (self.views[0][best], self.views[1][best])
        return out


class TablePool:
    """Unlabelled rows of a corpus of which `upto` gives those with hashes below a part of all hashes, as (h, x): x the packed features, of which the first `width` are the text's.

    The sure rows of the least hashes are wanted. So a part is searched that has a few times as many rows as are
    wanted; only if it has too few sure ones the part grows, up to all rows. What is found is the
    same as in a search of all rows, and doesn't depend on how they are dealt.
    """

    def __init__(self, upto: Callable[[float], DataFrame], n_rows: int, width: int):
        self.upto, self.n_rows, self.width, self.part, self.rows = upto, n_rows, width, 0.0, None

    def sure(self, w: list[np.ndarray], trust: float, quota: dict[float, int]) -> dict[tuple[int, float], tuple[np.ndarray, np.ndarray]]:
        """As of Pool, over the whole corpus; of equal hashes those of the least features first."""
        wanted = min(1.0, SEARCH_TIMES * sum(quota.values()) / max(self.n_rows, 1))
        while True:
            if self.part < wanted:
                self.part, self.rows = wanted, cut(self.upto(wanted))
            found = self._search(w, trust, quota)
            if self.part >= 1 or all(len(found[k, label][0]) >= n for k in (0, 1) for label, n in quota.items()):
                return found
            wanted = min(1.0, SEARCH_TIMES * self.part)

    def _search(self, w: list[np.ndarray], trust: float, quota: dict[float, int]) -> dict[tuple[int, float], tuple[np.ndarray, np.ndarray]]:
        width, labels = self.width, sorted(quota)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict[tuple[int, float], list] = {(k, label): [] for k in (0, 1) for label in labels}
            for batch in batches:
                x = unpack(batch.column(1))
                h = batch.column(0).to_numpy()
                for k, view in enumerate((x[:, :width], x[:, width:])):
                    p = sigmoid(odds(view, w[k]))
                    for label in labels:
                        best = np.flatnonzero((p if label else 1 - p) >= trust)
                        best = best[np.argsort(h[best], kind="stable")]
                        if len(best) > quota[label]:  # with all of the last hash
                            best = best[h[best] <= h[best[quota[label] - 1]]]
                        own = kept[k, label] + [(int(h[i]), x[i].astype("<f2").tobytes()) for i in best]
                        kept[k, label] = sorted(own)[: quota[label]]
            for (k, label), own in kept.items():
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(own), pa.int32()), pa.array([label] * len(own)), pa.array([a for a, _ in own], pa.int64()), pa.array([b for _, b in own], pa.binary())], ["view", "label", "h", "x"])

        got = self.rows.mapInArrow(run, "view int, label double, h long, x binary")
        place = F.row_number().over(Window.partitionBy("view", "label").orderBy("h", "x"))
        most = max(quota.values())
        rows = got.withColumn("n", place).filter(F.col("n") <= most).collect()  # at most two views' and two labels' quotas
        out = {}
        for k in (0, 1):
            for label, n in quota.items():
                own = sorted((r.h, bytes(r.x)) for r in rows if r.view == k and r.label == label)[:n]
                x = np.frombuffer(b"".join(b for _, b in own), "<f2").astype(np.float32).reshape(len(own), -1) if own else np.zeros((0, STATS + TEXT_BUCKETS + META_BUCKETS), np.float32)
                out[k, label] = (x[:, :width], x[:, width:])
        return out


def unpack(column: pa.Array) -> np.ndarray:
    """float32 rows of a binary column of packed float16 features."""
    n = len(column)
    if not n:
        return np.zeros((0, STATS + TEXT_BUCKETS + META_BUCKETS), np.float32)
    return np.frombuffer(b"".join(column.to_pylist()), "<f2").astype(np.float32).reshape(n, -1)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: Pool | TablePool, rounds: int = 4, handed: int = HANDED_ROWS, trust: float = 0.95) -> Model:
    """y is 0 or 1. After each round each view hands over rows of the pool, of either kind in the labels' proportion, that it is at least `trust` sure of."""
    if len(y) < 10 or y.min() == y.max():
        rate = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        flat = np.array([0.0, np.log(rate / (1 - rate))])
        return Model(np.zeros(text.shape[1] + 1), np.zeros(meta.shape[1] + 1), flat, flat, np.array([0.5, 0.5, 0.0]))
    aside = np.arange(len(y)) % 10 < CALIBRATION_TENTHS
    learn = ~aside
    cal = aside if 0 < y[aside].sum() < aside.sum() else np.ones(len(y), bool)
    one = np.ones(cal.sum())
    views = (text, meta)
    told = {k: (np.zeros((0, v.shape[1]), np.float32), np.zeros(0)) for k, v in enumerate(views)}
    for step in range(rounds + 1):
        w = [fit_logistic(np.vstack([x[learn], told[k][0]]), np.concatenate([y[learn], told[k][1]]), np.concatenate([np.ones(learn.sum()), np.full(len(told[k][1]), 0.5)])) for k, x in enumerate(views)]
        if step == rounds:
            break
        rate = float(y.mean())
        quota = {label: int((step + 1) * handed * share) + 1 for label, share in ((1.0, rate), (0.0, 1 - rate))}
        # A view's sureness is what its odds are worth on the rows set aside, so a view that knows little hands over little.
        worth = [fit_logistic(odds(x[cal], w[k])[:, None], y[cal], one, 0.3) for k, x in enumerate(views)]
        sure = pool.sure([np.append(w[k][:-1] * max(a, 0.0), w[k][-1] * max(a, 0.0) + b) for k, (a, b) in enumerate(worth)], trust, quota)
        for k in (0, 1):  # what the other view is sure of
            given = [(sure[1 - k, label][k], label) for label in quota]
            told[k] = (np.vstack([x for x, _ in given]), np.concatenate([np.full(len(x), label) for x, label in given]))
    scale = [fit_logistic(odds(x[cal], w[k])[:, None], y[cal], one, 1e-2) for k, x in enumerate(views)]
    z = np.stack([odds(odds(x[cal], w[k])[:, None], scale[k]) for k, x in enumerate(views)], 1)
    both = fit_logistic(z, y[cal], one, 1e-2)
    if (both[:2] < 0).any():  # a view that adds nothing is left out rather than held against itself
        both = fit_logistic(z * (both[:2] >= 0), y[cal], one, 1e-2)
    return Model(w[0], w[1], scale[0], scale[1], both)


def _views(batch: pa.RecordBatch, first: int, meta: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Views of a batch whose columns from `first` on are the text and the metadata."""
    buf, at = buffer_of(batch.column(first))
    for lo, hi in slices(at):
        own, edges = buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        yield lo, hi, text_view(own, edges), meta_view([c.slice(lo, hi - lo) for c in batch.columns[first + 1 :]], meta, sizes(own, edges))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", meta: tuple[str, ...] = ("source", "lang", "n_chars"), usable: Column | None = None, text_col: str = "text", train_rows: int = TRAIN_ROWS, **options) -> Model:
    """A model from at most train_rows labelled rows and all unlabelled ones; `usable` is a condition on __id, the label's doc_id."""
    marked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__y"))
    chosen = (marked.filter(usable) if usable is not None else marked).orderBy(F.xxhash64("__id"), "__id").limit(train_rows)
    body = docs.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", text_col).alias("h"), F.col(text_col).alias("__text"), *[F.col(c).alias(f"m_{c}") for c in meta])
    names = list(meta)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.schema.names.index("__text")
            for lo, hi, t, m in _views(batch, first, names):
                rows = np.hstack([t, m]).astype("<f2")
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[:first]], pa.array([r.tobytes() for r in rows], pa.binary())], [*batch.schema.names[:first], "x"])

    labelled = body.join(F.broadcast(chosen), F.col("id") == F.col("__id")).select("__y", *[c for c in body.columns if c != "id"])
    rows = sorted((r[1], r[0], bytes(r[2])) for r in labelled.mapInArrow(packed, "__y int, h long, x binary").toLocalIterator())
    width = STATS + TEXT_BUCKETS
    x = np.frombuffer(b"".join(r[2] for r in rows), "<f2").reshape(len(rows), -1).astype(np.float32) if rows else np.zeros((0, width + META_BUCKETS), np.float32)
    y = np.array([r[1] for r in rows], float)

    def upto(part: float) -> DataFrame:
        """Unlabelled rows with a hash in the first part of all hashes."""
        some = body if part >= 1 else body.filter(F.col("h") < int(-(2**63) + part * 2**64))
        rest = some.join(marked.select("__id"), F.col("id") == F.col("__id"), "left_anti") if part < 1 else None
        if rest is not None:
            return rest.drop("id").mapInArrow(packed, "h long, x binary")
        # All rows: their features are narrower than their texts, so these are joined.
        every = some.mapInArrow(packed, f"id {docs.schema['doc_id'].dataType.simpleString()}, h long, x binary")
        return every.join(marked.select("__id"), F.col("id") == F.col("__id"), "left_anti").select("h", "x")

    return co_train(x[:, :width], x[:, width:], y, TablePool(upto, docs.count(), width), **options)


def score(docs: DataFrame, model: Model, meta: tuple[str, ...] = ("source", "lang", "n_chars"), text_col: str = "text") -> DataFrame:
    """doc_id, score, text_score and meta_score of every row. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inp = docs.select("doc_id", F.col(text_col).alias("__text"), *[F.col(c).alias(f"m_{c}") for c in meta])
    names = list(meta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, t, m in _views(batch, 1, names):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(s) for s in shared.value.scores(t, m)]], ["doc_id", "score", "text_score", "meta_score"])

    return inp.mapInArrow(run, f"doc_id {inp.schema['doc_id'].dataType.simpleString()}, score double, text_score double, meta_score double")
