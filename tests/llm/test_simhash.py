import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quarryline.llm import simhash


def brute(texts):
    out = {}
    for k, t in texts.items():
        q = (t or "").encode().lower().split()
        shingles = [b" ".join(q[i : i + 4]) for i in range(max(len(q) - 3, 1))] if q else []
        votes = np.zeros(64, int)
        for s in shingles:
            h = xxhash.xxh64_intdigest(s, 42)
            votes += [(h >> b) & 1 for b in range(64)]
        out[k] = sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles)) if shingles else 0
    return out


def closure(fps):
    comp = {k: k for k in fps}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in itertools.combinations(sorted(fps), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 4:
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    return {k: root(k) for k in fps}


def test_every_close_pair_shares_a_bucket():
    rng = random.Random(1)
    for family in (0, 1, 2):
        masks = simhash.covering_masks(4, family)
        assert len(masks) == 31
        for _ in range(2000):
            flips = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(m & flips == 0 for m in masks)


def test_all_documents_against_brute_force(documents, texts):
    fps = brute(texts)
    got = {r.doc_id: r for r in simhash.near_duplicates(documents).collect()}
    assert {k: r.fingerprint for k, r in got.items()} == {k: f"{v:016x}" for k, v in fps.items()}
    assert {k: r.component_id for k, r in got.items()} == closure(fps)


def test_links_of_planted_fingerprints_with_split_buckets(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for seed in list(fps)[:20]:
        for _ in range(20):
            fps.add(seed ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    nodes = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    label = {r.node % 2**64: r.label for r in simhash.components(simhash.links(nodes, split_above=4)).collect()}
    want = closure({x: x for x in fps})
    groups = {}
    for x, c in want.items():
        groups.setdefault(c, set()).add(x)
    for g in groups.values():
        assert len({label.get(x, simhash._signed(x)) for x in g}) == 1
    assert len({label.get(x, simhash._signed(x)) for x in fps}) == len(groups)


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.label for r in simhash.components(edges).collect()} == {0}
    assert simhash.components(edges.filter("false")).count() == 0


def test_edges(edges, empty):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(edges).collect()}
    by = {d: (f, c) for d, f, c in got}
    assert by[1] == by[2] == by[3] == ("0" * 16, 1)
    assert by[4][1] == by[5][1] == 4 and by[6][1] == by[7][1] == 6
    assert {r.doc_id for r in simhash.drop_near_duplicates(edges).collect()} >= {1, 4, 6, 8}
    assert simhash.drop_near_duplicates(edges).columns == edges.columns
    assert simhash.near_duplicates(empty).count() == 0


def shingles(t):
    q = (t or "").encode().lower().split()
    return {tuple(q[i : i + 5]) for i in range(max(len(q) - 4, 1))} if q else set()


def test_similar_texts_of_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.component_id for r in simhash.similar_components(docs).collect()}
    assert sorted(got) == sorted(sets)
    near, far = [], {}
    for a, b in itertools.combinations(sorted(sets), 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0
        if j >= 0.83:
            near.append(got[a] == got[b])
        far[a], far[b] = max(far.get(a, 0), j), max(far.get(b, 0), j)
    assert near and np.mean(near) > 0.97
    assert np.mean([got[k] == k for k, j in far.items() if j < 0.7]) > 0.99
    assert all(got[k] == k for k, j in far.items() if j < 0.6)


def test_similar_in_blocks_and_edges(spark, edges, empty):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    rows = [(0, " ".join(words))]
    for k in range(1, 120):
        copy = list(words)
        copy[rng.randrange(300)] = "changed"
        rows.append((k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = simhash.wide_fingerprints(docs)
    label = simhash.components(simhash.similar_links(nodes, simhash.shingle_sets(docs), block=10))
    assert label.select("label").distinct().count() == 1 and label.count() == nodes.select("node").distinct().count()
    assert {r.component_id for r in simhash.similar_components(docs).collect()} == {0}
    got = {(r.doc_id, r.component_id) for r in simhash.similar_components(edges).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6)} <= got
    assert simhash.drop_similar(edges).columns == edges.columns and simhash.similar_components(empty).count() == 0


def test_similarity_decides_at_the_limit(spark):
    """Pairs on either side of 0.8, also of small and of repetitive texts, and sets that tie with it."""
    rng, rows, want = random.Random(9), [], {}
    for k in range(400):
        n = rng.choice([12, 30, 80, 300, 900])
        a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        b = list(a)
        while (j := len(shingles(" ".join(a)) & shingles(" ".join(b))) / len(shingles(" ".join(a)) | shingles(" ".join(b)))) > rng.uniform(0.74, 0.88):
            b[rng.choice([0, -1, rng.randrange(n)])] = f"x{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        want[2 * k + 1] = j >= 0.8
    w = [f"t{k}" for k in range(13)]  # 9 shingles, of which 8 are common: 8 / 10
    rows += [(1000, " ".join(w)), (1001, " ".join([*w[:-1], "other"])), (1002, " ".join([*w, *w])), (1003, " ".join([*w, *w, *w]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_components(docs).collect()}
    assert {k: got[k] == k - 1 for k in want} == want and 100 < sum(want.values()) < 300
    assert got[1001] == 1000 and got[1002] == got[1003] == 1002


def test_similar_texts_are_the_closure_of_exact_links(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.select("doc_id", "text").collect()}
    comp = {k: k for k in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    assert {r.doc_id: r.component_id for r in simhash.similar_components(docs).collect()} == {k: root(k) for k in sets}


def test_joins_of_hot_keys_and_rows_of_one_id(spark, monkeypatch):
    """Hubs, labels and copies above HEAVY_ROWS take the broadcast way and give the same."""
    star = spark.range(1, 60).select(F.lit(0).alias("u"), F.col("id").alias("v")).unionByName(spark.range(100, 140).select(F.lit(200).alias("u"), F.col("id").alias("v")))
    want = sorted(map(tuple, simhash.components(star).collect()))
    base = [f"word{k}" for k in range(40)]
    rows = [(k, " ".join(base)) for k in range(30)] + [(40 + k, " ".join([*base[:-1], f"end{k}"])) for k in range(8)] + [(0, "another text that is nothing like the first one"), (None, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, simhash.similar_components(df).collect()), key=str)
    monkeypatch.setattr("quarryline.llm.common.HEAVY_ROWS", 5)
    assert sorted(map(tuple, simhash.components(star).collect())) == want
    monkeypatch.setattr("quarryline.llm.common.BROADCAST_KEYS", 1)
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", 1)
    assert sorted(map(tuple, simhash.components(star).collect())) == want
    assert sorted(map(tuple, simhash.similar_components(df).collect()), key=str) == plain
    kept = simhash.drop_similar(df.filter("doc_id > 0 OR text LIKE 'another%' OR doc_id IS NULL")).collect()
    assert sorted(r.doc_id for r in kept) == [0, 1]  # id 0's other text doesn't keep its copies


def test_the_last_family_has_no_large_bucket():
    assert simhash.largest_last_bucket() <= 2**15


def test_fingerprints_with_many_sets(spark, monkeypatch, edges, empty):
    """Texts of one fingerprint but other sets are one component, by the broadcast way too."""
    lines = ["so " * 400 + f"x{k} y{k} z{k}" for k in range(30)]
    docs = spark.createDataFrame([*enumerate(lines), (99, "nothing like the others at all")], "doc_id long, text string")
    fps = brute(dict(enumerate(lines)))
    assert len(set(fps.values())) == 1 and len({frozenset(shingles(t)) for t in lines}) == 30
    monkeypatch.setattr("quarryline.llm.common.HEAVY_ROWS", 5)
    assert {r.doc_id for r in simhash.drop_near_or_similar(docs).collect()} == {0, 99}
    monkeypatch.undo()
    got = {r.doc_id: r.component_id for r in simhash.near_or_similar_components(edges).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[4] == got[5] == 4 and got[6] == got[7] == 6
    assert simhash.drop_near_or_similar(edges).columns == edges.columns and simhash.near_or_similar_components(empty).count() == 0
