"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; bit b is set if over half of the text's 4-word shingles (repeats
counted) have it in their XXH64. To find all pairs within `radius` bits, each bit position gets
a random vector of radius + 1 bits, not zero; the mask of vector v, not zero, keeps the
positions whose vector has an odd number of bits in common with v. At most `radius` positions
span at most a `radius`-dimensional space, so some v is orthogonal to all of them: that mask
keeps none of the differing bits, and the pair meets in that table. 2^(radius+1) - 1 tables.

A bucket that holds too many fingerprints is dealt again by a second, independent family of
masks, which is as exact, then by a third and a fourth: each multiplies only these rows, by 31.
Fingerprints that share a bucket agree in all bits that its masks keep; with four families
these are so many (`largest_last_bucket`) that no bucket of the last can be large, whatever the
data. Within a bucket only a spanning forest of the links is kept; links of all buckets then
meet in connected components. Joins on fingerprints, hubs and labels send those with many rows
by broadcast (`join_heavy`), so that no copy, hub or component fills one task.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; a text
with fewer than four words is one shingle; equal fingerprints are one node, so copies are never
paired; repeated doc_ids are rows of their own with one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, cut, join_heavy
from .textops import _FOLD, buffer_of, mix, pair_hash, slices, span_hashes, window_hashes, words

SHINGLE = 4
RADIUS = 4
SEED = 42
#: A bucket with more fingerprints is dealt again by the next of FAMILIES families of masks.
SPLIT_ABOVE = 512
FAMILIES = 4


def _fingerprints(buf: np.ndarray, at: np.ndarray, shingle: int) -> np.ndarray:
    """uint64 fingerprints of the texts of a buffer."""
    folded = _FOLD[buf]
    starts, ends, w = words(folded, at)
    out = np.zeros(len(at) - 1, np.uint64)
    # Words joined by one space, so that a shingle is one slice.
    sizes = ends - starts + 1
    to = np.concatenate([[0], np.cumsum(sizes)])
    joined = np.full(to[-1], 0x20, np.uint8)
    solid = np.repeat(starts - to[:-1], sizes) + np.arange(to[-1])
    inside = np.ones(to[-1], bool)
    inside[to[1:] - 1] = False
    joined[inside] = folded[solid[inside]]
    raw, h64 = joined.tobytes(), xxhash.xxh64_intdigest
    n = np.diff(w)
    n_sh = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), n_sh)
    base = np.concatenate([[0], np.cumsum(n_sh)])
    first = w[:-1][doc] + np.arange(base[-1]) - base[:-1][doc]
    last = first + np.minimum(n[doc], shingle) - 1
    h = np.fromiter((h64(raw[a:b], SEED) for a, b in zip(to[first].tolist(), (to[last + 1] - 1).tolist(), strict=True)), np.uint64, base[-1])
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = np.flatnonzero(n_sh)
    if len(full):
        votes = np.add.reduceat(bits, base[:-1][full], axis=0, dtype=np.int32)
        out[full] = np.packbits(votes * 2 > n_sh[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, mark (a hash of the text) and fp, the fingerprint as a signed long of the same bits. No shuffle."""
    inp = docs.select("doc_id", F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = buffer_of(batch.column(2))
            for lo, hi in slices(at):
                fp = _fingerprints(buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], shingle)
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[:2]], pa.array(fp.view(np.int64))], ["doc_id", "mark", "fp"])

    return inp.mapInArrow(run, f"doc_id {inp.schema['doc_id'].dataType.simpleString()}, mark long, fp long")


def covering_masks(radius: int = RADIUS, family: int = 0) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits, such that any `radius` positions are all outside one of them."""
    rng = np.random.default_rng([SEED, family])
    vector = rng.integers(1, 2 ** (radius + 1), 64)
    return [sum(1 << i for i in range(64) if bin(int(vector[i]) & v).count("1") % 2) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _tables(nodes: DataFrame, radius: int, family: int) -> DataFrame:
    """Each node once a mask: key is a hash of what it had as key and of the masked bits."""
    masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius, family)])
    return nodes.select("fp", "key", F.posexplode(masks).alias("t", "m")).select("fp", F.xxhash64("key", "t", F.col("fp").bitwiseAND(F.col("m"))).alias("key"))


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one bucket's distinct fingerprints."""
    left, right, todo = [], [], fps
    while len(todo):
        frontier, todo = todo[:1], todo[1:]
        while len(frontier) and len(todo):
            step = 1 + 2_000_000 // len(todo)  # bounds the matrix, not what is compared
            some, frontier = frontier[:step], frontier[step:]
            near = np.bitwise_count(todo[:, None] ^ some[None, :]) <= radius
            hit = near.any(axis=1)
            left.append(some[near[hit].argmax(axis=1)])
            right.append(todo[hit])
            frontier, todo = np.concatenate([frontier, todo[hit]]), todo[~hit]
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
    return join(left), join(right)


def _links_in_buckets(radius: int):
    """Over rows (key, fp) that come sorted by key: the forest of each bucket."""

    def of(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(edges, len(keys)))
        left, right = [], []
        pair = edges[size == 2]
        ok = np.bitwise_count(fps[pair] ^ fps[pair + 1]) <= radius
        left.append(fps[pair][ok])
        right.append(fps[pair + 1][ok])
        for a, n in zip(edges[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            x, y = _forest(fps[a : a + n], radius)
            left.append(x)
            right.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).view(np.int64)) for z in (left, right)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if len(keys):
                whole = np.searchsorted(keys, keys[-1])  # the last bucket may go on in the next batch
                if whole:
                    yield of(keys[:whole], fps[:whole])
                    keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield of(keys, fps)

    return run


def largest_last_bucket(radius: int = RADIUS, families: int = FAMILIES) -> int:
    """Most distinct fingerprints that a bucket of the last family can hold: 2 to the number of bits that none of its masks keeps."""
    kept = np.zeros(1, np.uint64)
    for family in range(families):
        kept = np.unique(kept[:, None] | np.array(covering_masks(radius, family), np.uint64)[None, :])
    return 2 ** (64 - int(np.bitwise_count(kept).min()))


def links(nodes: DataFrame, radius: int = RADIUS, families: int = FAMILIES, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(u, v) links between distinct fingerprints `fp` that span all pairs within radius."""
    found, now = None, nodes.select("fp", F.lit(0).cast("long").alias("key"))
    for family in range(families):
        tables = cut(_tables(now, radius, family))
        sizes = tables.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        large = sizes.filter(F.col("n") > split_above) if family + 1 < families else sizes.filter("false")
        n_large = large.count()
        shared = tables.join(sizes.filter(F.col("n") <= split_above) if n_large else sizes, "key")
        some = shared.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links_in_buckets(radius), "u long, v long")
        found = some if found is None else found.unionByName(some)
        if not n_large:
            break
        now = tables.join(large.select("key"), "key").select("fp", "key")
    return found.distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, label) of all nodes with a link; label is the smallest node reachable.

    Alternates large-star and small-star steps, each a minimum per node and a join, until
    nothing changes; the rounds grow with the logarithm of the longest path.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    state = lambda x: x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state(e)
    for _ in range(max_rounds):
        few = before[0] <= BROADCAST_KEYS
        joined = (lambda rows, keyed: rows.join(F.broadcast(keyed.drop("n")), "u")) if few else (lambda rows, keyed: join_heavy(rows, keyed, "u"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).withColumn("m", F.least("u", "m"))
        # Large star: a node's larger neighbours go to the least node around it.
        large = joined(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = large if few else cut(large)
        # Small star: a node's smaller neighbours, and itself, go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = joined(large, low).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("s")).select("s.u", "s.v")
        e = cut(small.filter("u != v").distinct())
        now = state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def with_component(prints: DataFrame, nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """prints with component_id: the least of least_id over the nodes (key, least_id, n: its rows in prints) that edges connect."""
    label = cut(components(edges).withColumnRenamed("node", key))
    ids = join_heavy(nodes.select(key, "least_id").join(label, key), label.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label")
    ids = cut(ids.groupBy("label").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    linked = join_heavy(label, ids, "label").select(key, "component_id")
    of = cut(nodes.join(linked, key, "left").select(key, "n", F.coalesce("component_id", "least_id").alias("component_id")))
    return join_heavy(prints, of, key)


def _keep_least(docs: DataFrame, groups: DataFrame, text_col: str) -> DataFrame:
    """docs' rows whose (doc_id, mark) in groups has its own doc_id as component_id."""
    keep = groups.filter("doc_id <=> component_id").select(F.col("doc_id").alias("__keep"), F.col("mark").alias("__mark")).distinct()
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col("__keep")) & (F.xxhash64(docs[text_col]) == F.col("__mark")), "left_semi")


def _near(docs: DataFrame, text_col: str, radius: int, shingle: int) -> DataFrame:
    prints = cut(fingerprints(docs, text_col, shingle))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")))
    return with_component(prints, nodes, links(nodes, radius), "fp")


def near_duplicates(docs: DataFrame, text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links of at most `radius` bits."""
    return _near(docs, text_col, radius, shingle).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id. Repeats of the kept row (its id and its text) all stay, as do rows without an id in components without any."""
    return _keep_least(docs, _near(docs, text_col, radius, shingle), text_col)


# --- Near copies by similarity -------------------------------------------------------------
# Texts whose shingle sets are similar by 0.8 differ in some 7 to 10 of 64 bits, more than a
# covering family of practical size reaches. For them minima of hashes, in bands, make texts
# meet, a wider fingerprint drops those that are far apart, and the sets themselves decide.
# `drop_near_or_similar` adds these links to those of the covering family.

#: 64-bit words of the wide fingerprint, and most bits that candidates differ in. Sets similar by
#: 0.8 differ in 78 bits in the mean, with a standard deviation of 8: 128 leaves none of them out.
WIDE_WORDS, WIDE_RADIUS = 8, 128
#: Smaller sets have many ties of votes; they are candidates whatever their fingerprints.
WIDE_LEAST = 64
#: Texts are linked from this Jaccard similarity of their shingle sets on, as a fraction.
SIMILARITY = (4, 5)
BANDS, BAND_ROWS = 16, 3
#: A bucket with more nodes, or more shingles, is worked on in pairs of blocks of about so many.
BLOCK, BLOCK_SHINGLES = 1000, 2_000_000
#: Up to so many nodes that need their sets are sent to every executor; more are joined by shuffle.
BROADCAST_ROWS = 100_000


def _sets(buf: np.ndarray, at: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct shingles of each text, one text after the other, their n+1 offsets, and per text a hash of its set."""
    starts, ends, w = words(buf, at)
    h, edges = window_hashes(span_hashes(buf, starts, ends), w, shingle)
    n_docs = len(at) - 1
    if not len(h):
        return h, np.zeros(n_docs + 1, np.int64), np.zeros(n_docs, np.uint64)
    doc = np.repeat(np.arange(n_docs), np.diff(edges))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    once = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
    h, doc = h[once], doc[once]
    edges = np.searchsorted(doc, np.arange(n_docs + 1))
    full = np.flatnonzero(np.diff(edges))
    node = np.zeros(n_docs, np.uint64)
    node[full] = pair_hash(np.add.reduceat(mix(h + np.uint64(2000)), edges[full]), np.diff(edges)[full].astype(np.uint64))
    return h, edges, node


def _marks(h: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per set WIDE_WORDS words of SimHash and its size, and its band keys; an empty set has zeros."""
    n_docs = len(edges) - 1
    fp, bands = np.zeros((n_docs, WIDE_WORDS + 1), np.uint64), np.zeros((n_docs, BANDS), np.uint64)
    if not len(h):
        return fp, bands
    full = np.flatnonzero(np.diff(edges))
    first, n = edges[full], np.diff(edges)[full]
    fp[full, WIDE_WORDS] = n
    for k in range(WIDE_WORDS):
        bits = np.unpackbits(mix(h + np.uint64(k + 1)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        fp[full, k] = np.packbits(votes * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    for b in range(BANDS):
        key = np.full(len(full), b + 1, np.uint64)
        for r in range(BAND_ROWS):
            key = pair_hash(key, np.minimum.reduceat(mix(h + np.uint64(1000 + b * BAND_ROWS + r)), first))
        bands[full, b] = key
    return fp, bands


def wide_fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 5) -> DataFrame:
    """doc_id, mark (a hash of the text), narrow (the fingerprint of `fingerprints`), node (a hash of the set of shingles), fp (WIDE_WORDS longs, then the set's size) and bands (BANDS longs). No shuffle."""
    inp = docs.select("doc_id", F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("__text"))

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.view(np.int64).ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = buffer_of(batch.column(2))
            for lo, hi in slices(at):
                own, own_at = buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                narrow, (h, edges, node) = _fingerprints(own, own_at, SHINGLE), _sets(own, own_at, shingle)
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[:2]], *[pa.array(x.view(np.int64)) for x in (narrow, node)], *map(lists, _marks(h, edges))], ["doc_id", "mark", "narrow", "node", "fp", "bands"])

    return inp.mapInArrow(run, f"doc_id {inp.schema['doc_id'].dataType.simpleString()}, mark long, narrow long, node long, fp array<long>, bands array<long>")


def shingle_sets(docs: DataFrame, text_col: str = "text", shingle: int = 5) -> DataFrame:
    """node and its set of shingles, a row for each of docs. Sets are larger than texts, so they are worked out again where they are needed rather than kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = buffer_of(batch.column(0))
            for lo, hi in slices(at):
                h, edges, node = _sets(buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], shingle)
                sets = pa.array([h[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), sets], ["node", "shingles"])

    return docs.select(F.col(text_col).alias("__text")).mapInArrow(run, "node long, shingles binary")


def _candidates(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether sets' sizes allow SIMILARITY, and their wide fingerprints are close or one set is small."""
    close = np.bitwise_count(a[..., :WIDE_WORDS] ^ b[..., :WIDE_WORDS]).sum(axis=-1, dtype=np.int32) <= radius
    least, most = np.minimum(a[..., WIDE_WORDS], b[..., WIDE_WORDS]), np.maximum(a[..., WIDE_WORDS], b[..., WIDE_WORDS])
    return (close | (least < WIDE_LEAST)) & (np.uint64(SIMILARITY[1]) * least >= np.uint64(SIMILARITY[0]) * most)


def _candidate_groups(nodes: np.ndarray, fps: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """One bucket's nodes by the components of candidates, with a hash of each component's nodes; lone nodes are left out."""
    nodes, first = np.unique(nodes, return_index=True)
    fps, keys, members = fps[first], [], []
    todo = np.arange(len(nodes))
    while len(todo):
        frontier, todo = todo[:1], todo[1:]
        found = [frontier]
        while len(frontier) and len(todo):
            some, frontier = frontier[:32], frontier[32:]
            hit = _candidates(fps[todo][:, None, :], fps[some][None, :, :], radius).any(axis=1)
            found.append(todo[hit])
            frontier, todo = np.concatenate([frontier, todo[hit]]), todo[~hit]
        own = nodes[np.concatenate(found)]
        if len(own) > 1:
            key = mix(np.add.reduce(mix(own.view(np.uint64)), keepdims=True) + np.uint64(len(own)))
            keys.append(np.repeat(key.view(np.int64), len(own)))
            members.append(own)
    return keys, members


def _exact_forest(nodes: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one group's sets under SIMILARITY, decided by the sets."""
    num, den = SIMILARITY
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        ok = (num + den) * len(np.intersect1d(*sets, assume_unique=True)) >= num * size.sum()
        return (nodes[:1], nodes[1:]) if ok else (nodes[:0], nodes[:0])
    distinct, ids = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.split(ids, np.cumsum(size)[:-1])
    inside = np.zeros(len(distinct), bool)
    left, right = [], []
    todo = np.arange(len(nodes))
    while len(todo):
        frontier, todo = [int(todo[0])], todo[1:]
        rest = np.concatenate([of[k] for k in todo]) if len(todo) else ids[:0]
        while frontier and len(todo):
            one = frontier.pop()
            inside[of[one]] = True
            common = np.add.reduceat(inside[rest], np.cumsum(size[todo]) - size[todo], dtype=np.int64) if len(rest) else np.zeros(len(todo), np.int64)
            inside[of[one]] = False
            hit = (num + den) * common >= num * (size[todo] + size[one])
            if hit.any():
                left.append(np.full(hit.sum(), nodes[one]))
                right.append(nodes[todo[hit]])
                frontier += todo[hit].tolist()
                rest, todo = rest[np.repeat(~hit, size[todo])], todo[~hit]
    join = lambda x: np.concatenate(x) if x else nodes[:0]
    return join(left), join(right)


def _exact_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (key, node, shingles) that come sorted by key: the forest of each group."""
    key, nodes, sets = None, [], []

    def of() -> pa.RecordBatch:
        u, v = _exact_forest(np.array(nodes, np.int64), sets)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        for k, node, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if k != key:
                if len(nodes) > 1:
                    yield of()
                key, nodes, sets = k, [], []
            nodes.append(node)
            sets.append(np.frombuffer(raw.as_py(), np.uint64))
    if len(nodes) > 1:
        yield of()


def similar_links(nodes: DataFrame, sets: DataFrame, radius: int = WIDE_RADIUS, block: int = BLOCK) -> DataFrame:
    """(u, v) links between nodes (node, fp, bands) that share a band and have sets similar by SIMILARITY, spanning all such.

    A bucket's candidates are those within radius bits, with sizes in proportion; each component
    of them is a group, whose sets (of `sets`: node, shingles) decide. A bucket of
    more than `block` nodes is dealt into blocks, and each two of its blocks meet in a group of
    their own: exact, and no task holds more than two blocks.
    """
    rows = cut(nodes.select("node", "fp", F.explode("bands").alias("key")))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.element_at("fp", WIDE_WORDS + 1)).alias("size")).filter("n > 1")
    parts = F.least(F.col("n"), F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("size") / BLOCK_SHINGLES)))
    met = rows.join(sizes, "key").withColumn("parts", parts.cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    met = met.select(key.alias("key"), "node", "fp").repartition("key").sortWithinPartitions("key", "node")

    def of(keys: np.ndarray, ids: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(edges, len(keys)))
        pair = edges[size == 2]
        pair = pair[_candidates(fps[pair], fps[pair + 1], radius) & (ids[pair] != ids[pair + 1])]
        key = mix(mix(ids[pair].view(np.uint64)) + mix(ids[pair + 1].view(np.uint64)) + np.uint64(2)).view(np.int64)
        groups, members = [key, key], [ids[pair], ids[pair + 1]]
        for a, n in zip(edges[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            x, y = _candidate_groups(ids[a : a + n], fps[a : a + n], radius)
            groups += x
            members += y
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(groups)), pa.array(np.concatenate(members))], ["key", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, fps = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, WIDE_WORDS + 1), np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            ids = np.concatenate([ids, batch.column(1).to_numpy()])
            fps = np.concatenate([fps, batch.column(2).flatten().to_numpy().view(np.uint64).reshape(-1, WIDE_WORDS + 1)])
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if whole:
                yield of(keys[:whole], ids[:whole], fps[:whole])
                keys, ids, fps = keys[whole:], ids[whole:], fps[whole:]
        if len(keys):
            yield of(keys, ids, fps)

    groups = cut(met.mapInArrow(run, "key long, node long").distinct())
    wanted = groups.select(F.col("node").alias("__node")).distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    own_sets = sets.select("node", "shingles").join(wanted, F.col("node") == F.col("__node"), "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    whole = groups.join(own_sets, "node").select("key", "node", "shingles").repartition("key").sortWithinPartitions("key", "node")
    return whole.mapInArrow(_exact_links, "u long, v long").distinct()


def covering_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) links that connect the nodes of prints (narrow, node) whose fingerprints are within radius bits, through nodes that stand for fingerprints.

    Only fingerprints that meet another, or have several nodes, are tied to their nodes.
    """
    pairs = cut(prints.select(F.col("narrow").alias("fp"), "node").distinct())
    each = cut(pairs.groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
    near = cut(links(each, radius))
    met = near.select(F.explode(F.array("u", "v")).alias("fp")).distinct().withColumn("met", F.lit(True))
    tied = join_heavy(pairs, cut(each.join(met, "fp", "left").filter("n > 1 OR met").select("fp", "n")), "fp")
    print_node = lambda c: F.xxhash64(F.lit("fingerprint"), c)
    return near.select(print_node("u").alias("u"), print_node("v").alias("v")).unionByName(tied.select(print_node("fp").alias("u"), F.col("node").alias("v")))


def _similar(docs: DataFrame, text_col: str, shingle: int, radius: int, near: bool = False) -> DataFrame:
    prints = cut(wide_fingerprints(docs, text_col, shingle))
    nodes = cut(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")))
    edges = similar_links(nodes, shingle_sets(docs, text_col, shingle), radius)
    if near:
        edges = cut(covering_links(prints).unionByName(edges))
    return with_component(prints.select("doc_id", "mark", "node"), nodes, edges, "node")


def similar_components(docs: DataFrame, text_col: str = "text", shingle: int = 5, radius: int = WIDE_RADIUS) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over links between texts whose shingle sets are similar by SIMILARITY."""
    return _similar(docs, text_col, shingle, radius).select("doc_id", "component_id")


def drop_similar(docs: DataFrame, text_col: str = "text", shingle: int = 5, radius: int = WIDE_RADIUS) -> DataFrame:
    """docs without the rows whose component of similar texts has a smaller doc_id. Repeats of the kept row (its id and its text) all stay, as do rows without an id in components without any."""
    return _keep_least(docs, _similar(docs, text_col, shingle, radius), text_col)


def near_or_similar_components(docs: DataFrame, text_col: str = "text", shingle: int = 5, radius: int = WIDE_RADIUS) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over links of both kinds: fingerprints within RADIUS bits, as in near_duplicates, and shingle sets similar by SIMILARITY."""
    return _similar(docs, text_col, shingle, radius, near=True).select("doc_id", "component_id")


def drop_near_or_similar(docs: DataFrame, text_col: str = "text", shingle: int = 5, radius: int = WIDE_RADIUS) -> DataFrame:
    """docs without the rows whose component over links of both kinds has a smaller doc_id; repeats and rows without an id as in drop_near_duplicates."""
    return _keep_least(docs, _similar(docs, text_col, shingle, radius, near=True), text_col)
