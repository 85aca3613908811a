"""Bottom-k sketches of word shingles: mergeable fingerprints of documents.

A sketch is the k least distinct 64-bit hashes (as signed longs, ascending) of a text's 5-word
shingles. Sketches of parts merge to the sketch of the whole; two sketches give an estimate of
resemblance and containment, and one gives the number of distinct shingles.

Edge cases: null and empty texts have an empty sketch (two empty ones resemble by 1); a text
with fewer than five words is one shingle; equal texts have equal sketches; texts are used
whole; with one document, the next document is itself; rows with a null doc_id come first;
rows that share a doc_id are ordered by text.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, shuffle_width
from .textops import buffer_of, slices, span_hashes, window_hashes, words

K = 128
SHINGLE = 5


def sketches(buf: np.ndarray, at: np.ndarray, k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """int64 sketches of the texts of a buffer."""
    starts, ends, w = words(buf, at)
    h, edges = window_hashes(span_hashes(buf, starts, ends), w, shingle)
    h, out = h.view(np.int64), []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        x = np.sort(h[a:b])
        if b - a > 1:
            x = x[np.append(True, x[1:] != x[:-1])]
        out.append(x[:k])
    return out


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets of two sketches."""
    both = np.sort(np.concatenate([a, b]))
    if not len(both):
        return 1.0
    first = np.append(True, both[1:] != both[:-1])
    twice = np.append(both[1:] == both[:-1], False)[first]
    return float(np.count_nonzero(twice[:k]) / min(k, len(twice)))


def sketch_documents(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """The `keep` columns and sketch array<bigint>. No shuffle."""
    inp = docs.select(*keep, F.col(text_col).alias("__text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inp.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = buffer_of(batch.column(batch.num_columns - 1))
            for lo, hi in slices(at):
                got = sketches(buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], k, shingle)
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[:-1]], pa.array(got, pa.list_(pa.int64()))], [*batch.schema.names[:-1], "sketch"])

    return inp.mapInArrow(run, f"{head}, sketch array<bigint>")


def merge_sketches(parts: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """One sketch per group: the k least distinct hashes of its parts. Each task keeps k per group before the shuffle."""
    one = parts.select(*by, F.explode("sketch").alias("h")).distinct()
    least = one.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).filter(F.col("n") <= k)
    return least.groupBy(*by).agg(F.array_sort(F.collect_list("h")).alias("sketch"))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sketch columns."""
    both = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash's share of the hash range."""
    share = (F.element_at(sketch, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    union = distinct_shingles(F.slice(F.array_sort(F.array_union(a, b)), 1, k), k)
    return F.least(F.lit(1.0), F.when(F.size(a) == 0, F.lit(1.0)).otherwise(resemblance(a, b, k) * union / distinct_shingles(a, k)))


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<i8").tobytes()).decode()


def with_next(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (o, doc_id, text, last) dealt and sorted so that each row's next document is the next row.

    Ids are cut into ranges at approximate quantiles; each range ends with a copy of the first
    document of the next range (last = true; after the last range, of the first), which is
    nobody's own row. One shuffle of the texts, ranges of about equal numbers of rows. Ids that
    aren't whole numbers are ordered as text.
    """
    spark = docs.sparkSession
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        number = docs.select(F.col("doc_id").cast("string").alias("__key")).filter("__key is not null").distinct()
        numbered = numbered_keys(number)
        kind = docs.schema["doc_id"].dataType
        docs = docs.select(F.col("doc_id").alias("__id"), F.col(text_col).alias("__text")).join(numbered, F.col("__id").cast("string") == F.col("__key"), "left").select(F.col("__n").alias("doc_id"), "__text", "__id")
        out = _with_next(docs, "__text", "__id")
        return out.withColumn("doc_id", F.col("doc_id").cast(kind))
    return _with_next(docs, text_col, "doc_id")


def numbered_keys(keys: DataFrame) -> DataFrame:
    """(__key, __n): the distinct texts of __key numbered from 0 in order, by ranges; what meets in one place is one row a range."""
    parts = cut(keys.repartitionByRange("__key").sortWithinPartitions("__key").withColumn("__m", F.monotonically_increasing_id()))
    parts = parts.withColumn("__p", F.shiftright("__m", 33)).withColumn("__k", F.col("__m").bitwiseAND(F.lit(2**33 - 1)))
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(F.broadcast(sizes.select("__p", before.alias("__before"))), "__p").select("__key", (F.col("__before") + F.col("__k")).alias("__n"))


def cuts_below(cuts: list[int], x: Column) -> Column:
    """How many of the ascending cuts are less than x: first among every s-th of them, then among the s from there, s their number's root."""
    s = math.isqrt(len(cuts) - 1) + 1
    below = lambda some: F.size(F.filter(some, lambda c: c < x))
    coarse, fine = F.array(*[F.lit(c) for c in cuts[::s]]), F.array(*[F.lit(c) for c in cuts])
    skipped = F.greatest(below(coarse) - 1, F.lit(0)) * s
    # The number stands in an array of one, so that both uses share one evaluation of it.
    return F.element_at(F.transform(F.array(skipped), lambda k: k + below(F.slice(fine, k + 1, F.lit(s)))), 1)


def _with_next(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("o"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = max(1, shuffle_width(spark))
    cuts = sorted({max(-(2**63), min(int(x), 2**63 - 1)) for x in rows.select(F.col("o").cast("double")).approxQuantile("o", [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []
    part = F.lit(0)
    if cuts:
        part = cuts_below(cuts, F.col("o"))
    rows = rows.withColumn("part", part.cast("int"))
    firsts = sorted((r.part, r.o) for r in rows.groupBy("part").agg(F.min("o").alias("o")).collect())
    if not firsts:
        return rows.withColumn("last", F.lit(False))
    after = spark.createDataFrame([(p, firsts[(k + 1) % len(firsts)][1]) for k, (p, _) in enumerate(firsts)], "to_part int, o long")
    heads = rows.filter(F.col("o").isin([o for _, o in firsts])).groupBy("o").agg(F.min_by(F.struct("doc_id", "text"), F.col("text")).alias("s"))
    tails = heads.join(F.broadcast(after), "o").select("o", "s.doc_id", "s.text", F.col("to_part").alias("part"), F.lit(True).alias("last"))
    every = rows.withColumn("last", F.lit(False)).unionByName(tails)
    return every.repartition(len(firsts), "part").sortWithinPartitions("part", "last", "o", "text")


def fingerprint_edits(docs: DataFrame, text_col: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Per document: its fingerprint, that of its text with the second half taken from the next document, and the likenesses."""
    rows = with_next(docs, text_col).select("part", "doc_id", "text", "last")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            for lo, hi in slices(buffer_of(batch.column(2))[1]):
                piece = batch.slice(lo, hi - lo)
                table = pa.Table.from_batches([piece] if held is None else [held, piece]).combine_chunks()
                both = table.to_batches()[0]
                held = both.slice(both.num_rows - 1)
                if both.num_rows > 1:
                    yield of(both)

    def of(both: pa.RecordBatch) -> pa.RecordBatch:
        """All rows but the last, whose next document isn't known yet, and the copies."""
        last = both.column(3).to_pylist()
        buf, at = buffer_of(both.column(2))
        own = sketches(buf, at, k, shingle)
        texts = both.column(2).to_pylist()
        mine = [i for i in range(both.num_rows - 1) if not last[i]]
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in mine]
        new = sketches(*buffer_of(pa.array(edited, pa.large_string())), k, shingle)
        columns = [
            both.column(1).take(pa.array(mine, pa.int64())),
            pa.array([len(texts[i]) for i in mine], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([encode(own[i]) for i in mine], pa.string()),
            pa.array([encode(x) for x in new], pa.string()),
            pa.array([likeness(own[i], x, k) for i, x in zip(mine, new, strict=True)], pa.float64()),
            pa.array([likeness(own[i], own[i + 1], k) for i in mine], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in out.split(", ")])

    return rows.mapInArrow(run, out)
