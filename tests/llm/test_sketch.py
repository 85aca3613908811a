import hashlib

import numpy as np
from pyspark.sql import functions as F

from quarryline.llm import sketch


def shingles(t):
    q = (t or "").encode().lower().split()
    return {tuple(q[i : i + 5]) for i in range(max(len(q) - 4, 1))} if q else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_all_documents(documents, texts):
    order, error = sorted(texts), []
    got = {r.doc_id: r for r in sketch.fingerprint_edits(documents).collect()}
    assert sorted(got) == order
    for k, i in enumerate(order):
        t, after = texts[i], texts[order[(k + 1) % len(order)]]
        n = len(t)
        edited = t[: n - n // 2] + after[: n // 2]
        assert got[i].n_chars == n and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        error += [got[i].near_edited - jaccard(shingles(t), shingles(edited)), got[i].near_next - jaccard(shingles(t), shingles(after))]
    assert np.abs(error).mean() < 0.02 and np.abs(error).max() < 0.2
    assert all(len({got[i].fingerprint for i in order if texts[i] == t}) == 1 for t in texts.values())


def test_merge_resemblance_containment_and_counts(spark):
    words = [f"w{i}" for i in range(3000)]
    parts = {"a1": words[:1204], "a2": words[1200:2000], "b": words[1000:3000]}
    df = spark.createDataFrame([(k, k[0], " ".join(v)) for k, v in parts.items()], "doc_id string, g string, text string")
    merged = sketch.merge_sketches(sketch.sketch_documents(df, keep=("g",)), ["g"])
    whole = spark.createDataFrame([("a", " ".join(words[:2000]))], "g string, text string")
    one = sketch.sketch_documents(whole, keep=("g",)).first().sketch
    assert merged.filter("g = 'a'").first().sketch == one
    pair = merged.filter("g = 'a'").select(F.col("sketch").alias("a")).crossJoin(merged.filter("g = 'b'").select(F.col("sketch").alias("b")))
    r = pair.select(sketch.resemblance(F.col("a"), F.col("b")).alias("r"), sketch.containment(F.col("a"), F.col("b")).alias("c"), sketch.distinct_shingles(F.col("a")).alias("n")).first()
    assert abs(r.r - 1 / 3) < 0.13 and abs(r.c - 0.5) < 0.17 and abs(r.n / 1996 - 1) < 0.3


def test_edges(spark, edges, empty):
    got = sketch.fingerprint_edits(edges).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == 12 and by[1][0].fingerprint == by[2][0].fingerprint == "" and by[1][0].near_next == 1.0
    assert by[4][0].fingerprint == by[5][0].fingerprint and by[4][0].near_next == 1.0 and len({r.fingerprint for r in by[6]}) == 1
    one = sketch.fingerprint_edits(edges.filter("doc_id = 4")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    nulls = edges.filter("doc_id IN (4, 8)").withColumn("doc_id", F.when(F.col("doc_id") != 4, F.col("doc_id")))
    assert {r.doc_id for r in sketch.fingerprint_edits(nulls).collect()} == {None, 8}
    assert sketch.fingerprint_edits(empty).count() == 0


def test_text_ids_are_ordered_as_text(spark):
    rows = [(f"k{k:02d}", f"text number {k} of some words here") for k in range(30)] + [(None, "first of all of them")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or ""))
    want = {}
    for k, (i, t) in enumerate(ordered):
        n, after = len(t) // 2, ordered[(k + 1) % len(ordered)][1]
        want[i] = hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()
    assert {r.doc_id: r.edited_sha256 for r in sketch.fingerprint_edits(df).collect()} == want


def test_cuts_below(spark):
    for n in (1, 2, 3, 7, 16, 17, 100):
        cuts = [3 * k - 40 for k in range(n)]
        xs = [*range(-45, 3 * n), -(2**63), 2**63 - 1]
        got = spark.createDataFrame([(x,) for x in xs], "x long").select("x", sketch.cuts_below(cuts, F.col("x")).alias("k")).collect()
        assert [r.k for r in got] == [sum(c < r.x for c in cuts) for r in got]


def test_ids_at_the_ends_of_their_range(spark):
    """Ids near the least and the greatest long, and null, are in order."""
    top = 2**63 - 1
    rows = [(i, f"text {i} of some words") for i in (-(2**63), -1, 0, top - 1, top, None)] + [(top - k, f"more {k}") for k in range(2, 60)]
    got = {r.doc_id: r for r in sketch.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    texts = dict(rows)
    half = lambda a, b: a[: len(a) - len(a) // 2] + b[: len(a) // 2]
    assert got[top - 1].edited_sha256 == hashlib.sha256(half(texts[top - 1], texts[top]).encode()).hexdigest()
