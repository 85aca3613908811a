import math
import random
import re

import pytest

from quarryline.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k=20):
    """(item, rank, id, score) by scoring every document for every item."""
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_all = len(bags), sum(len(b) for _, b in bags)
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in set(items):
        scored = []
        for i, b in bags:
            m, s = 75 + 25 * len(b) * n_docs // n_all, 0
            for t in terms(text):
                if tf := b.count(t):
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf // (1000 * tf + 12 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, **kw):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in lexical.search(d, b, **kw).collect()), key=str)


@pytest.mark.parametrize("chunk", [1 << 14, 7])
def test_equals_brute_force(spark, monkeypatch, chunk):
    """Skewed words, copies and ties, in one chunk and in many."""
    monkeypatch.setattr(lexical, "CHUNK_DOCS", chunk)
    rng = random.Random(chunk)
    vocabulary = [f"w{k}" for k in range(200)]
    draw = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.05)), 199)] for _ in range(n))
    docs = [(k, draw(rng.randint(1, 40))) for k in range(300)]
    docs += [(1000 + k, docs[5][1]) for k in range(60)] + [(5, docs[5][1]), (None, docs[5][1]), (2000, None), (2001, ""), (2002, "--- !!")]
    items = [(k, draw(rng.randint(1, 12))) for k in range(20)] + [(50, docs[5][1]), (51, None), (52, "zzz"), (53, "w1 w1 W1 w2"), (53, "w1 w1 W1 w2"), (0, "w3 w150"), (54, " ".join(vocabulary))]
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 40)
    docs = [(k, f"common a{k % 7} b{k % 11}") for k in range(100)]
    items = [(k, f"a{k % 7} b{k % 5} common") for k in range(12)]
    assert run(spark, docs, items, k=5) == brute(docs, items, 5)


def test_masks_beyond_64_terms_and_large_counts(spark):
    docs = [(k, " ".join(f"t{j}" for j in range(k % 90 + 1))) for k in range(200)] + [(900, "t3 " * 50_000)]
    items = [(1, " ".join(f"t{j}" for j in range(90))), (2, "t3")]
    assert run(spark, docs, items) == brute(docs, items)


def test_terms_beyond_ascii(spark):
    docs = [(1, "É é Straße-STRASSE x_y z"), (2, "é straße"), (3, "x y"), (4, "nothing")]
    items = [(1, "é"), (2, "STRASSE x"), (3, "y z")]
    assert run(spark, docs, items) == brute(docs, items)


def test_edges(spark, edges, empty):
    items = spark.createDataFrame([(1, "one two"), (2, "héé 日本語"), (3, "")], "item_id long, text string").selectExpr("*", "'clash' AS score", "'clash' AS n")
    got = [tuple(r) for r in lexical.search(edges, items).collect()]
    docs = [(r.doc_id, r.text) for r in edges.collect()]
    assert sorted(got, key=str) == brute(docs, [(1, "one two"), (2, "héé 日本語"), (3, "")])
    assert lexical.search(empty, items).collect() == []
    assert lexical.search(edges, items.limit(0)).collect() == []


def test_string_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z"), (None, "x y")], "id string, body string")
    items = spark.createDataFrame([("q", "x z")], "q string, words string")
    got = [tuple(r) for r in lexical.search(docs, items, 20, "id", "body", "q", "words").orderBy("rank").collect()]
    assert [g[2] for g in got] == ["c", "a", "b", None] and [g[1] for g in got] == [1, 2, 3, 4]
