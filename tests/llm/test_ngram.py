import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quarryline.llm import ngram
from quarryline.llm.common import doc_key


@pytest.mark.parametrize("n, universe", [(0, 10), (1, 1), (5, 100), (1000, 1 << 40), (1000, 300)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, universe, n).astype(np.uint64))
    ef = ngram.EliasFano.of(v, universe)
    assert (ef.all() == v).all() and (not n or (ef.get(np.arange(n)) == v).all())
    x = rng.integers(0, universe + 1, 50).astype(np.uint64)
    lo, hi = np.zeros(50, np.int64), np.full(50, n)
    assert (ef.successor(lo, hi, x) == np.searchsorted(v, x)).all()
    assert ef.low.nbytes + ef.high.nbytes <= n * (2 + math.log2(max(universe / max(n, 1), 1)) + 1) / 8 + 40


@pytest.mark.parametrize("n", [*range(1, 70), 127, 128, 129])
def test_elias_fano_of_few_wide_numbers(n):
    """Lists so short that nearly all of 64 bits are low bits."""
    rng = np.random.default_rng(n)
    for top in (2**64 - 1, 2**63, 2**58, 2**57, 2**56):
        v = np.sort(rng.integers(0, top, n, np.uint64, endpoint=top == 2**64 - 1))
        ef = ngram.EliasFano.of(v, top)
        assert (ef.all() == v).all() and (ef.get(np.arange(n)) == v).all()
    for shards in (2, 3):
        keys = np.unique(rng.integers(0, 2**64 - 1, n, np.uint64))
        by, far, edges = ngram.deal(keys, shards, 64)
        back = [ngram.gather(ngram.unpack_keys(ngram.pack_keys(far[edges[s] : edges[s + 1]], s, shards, 64), s, shards, 64), 64) for s in range(shards)]
        assert (np.concatenate(back) == keys[by]).all()


def test_trie_from_its_file(tmp_path):
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 50, 3000).astype(np.uint64) << np.uint64(32) | rng.integers(0, 400, 3000).astype(np.uint64))
    counts = rng.integers(1, 60, len(keys)).astype(np.uint64)
    ngram.Trie.of(keys, counts).save(str(tmp_path / "t"))
    trie = ngram.Trie.map(str(tmp_path / "t"))
    assert (trie.lookup(keys) == counts).all()
    other = np.setdiff1d(np.arange(60, dtype=np.uint64) << np.uint64(32) | np.uint64(7), keys)
    assert not trie.lookup(other).any() and not ngram.Trie.of(keys[:0], counts[:0]).lookup(keys).any()


def test_codes_are_monotone_and_close():
    c = np.unique(np.concatenate([np.arange(1, 2000), 2.0 ** np.arange(11, 40)]))
    back = ngram.VALUE_OF[ngram.code_of(c)]
    assert (np.abs(back / c - 1) < 0.0003).all() and (back[c <= ngram.EXACT] == c[c <= ngram.EXACT]).all() and ngram.code_of(np.array([0]))[0] == 0
    codes = ngram.code_of(c)
    assert (ngram.unpack_codes(ngram.pack_codes(codes)) == codes).all() and len(ngram.unpack_codes(b"")) == 0


def brute(texts, held, order):
    tokens = {k: (t or "").encode().lower().split() + [None] for k, t in texts.items()}
    learn = [t for k, t in tokens.items() if not held[k]]
    one = Counter(w for t in learn for w in t)
    n, v = sum(one.values()), len(one)
    grams = [Counter(tuple(([0] * (m - 1) + t)[i : i + m]) for t in learn for i in range(len(t))) for m in range(2, order + 1)]
    out = {}
    for k, t in tokens.items():
        base = score = 0.0
        for i, w in enumerate(t):
            p = (one[w] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            context = one[None] if i == 0 else one[t[i - 1]]
            for m in range(2, order + 1):
                joint = min(grams[m - 2][tuple(([0] * (m - 1) + t)[i : i + m])], context)
                if context:
                    p = (joint + context**0.9 * p) / (context + context**0.9)
                context = one[None] if i == 0 else grams[m - 2][tuple(([0] * (m - 1) + t)[i - 1 : i - 1 + m])]
            score += math.log10(p)
        out[k] = (len(t), sum(one[w] > 0 for w in t), n, base, score)
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_all_documents(documents, texts, order):
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in texts}
    want = brute(texts, held, order)
    got = ngram.score_documents(documents, doc_key() % 10 == 0, order).collect()
    assert len(got) == len(texts)
    for r in got:
        n_tokens, n_known, n, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], n_tokens, n_known, n)
        assert abs(r.base_score - base) < 1e-9 * abs(base) and abs(r.score - score) < 0.001 * abs(score)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_edges(edges, empty):
    rows = edges.collect()
    want = brute({k: r.text for k, r in enumerate(rows)}, dict.fromkeys(range(len(rows)), False), 2)
    expected = sorted((r.doc_id, want[k][0], want[k][1], want[k][2], round(want[k][3], 6)) for k, r in enumerate(rows))
    got = ngram.score_documents(edges, F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    for r in got:
        assert abs(r.score - next(want[k][4] for k, x in enumerate(rows) if x.doc_id == r.doc_id)) < 0.001 * max(1, abs(r.score))
    untrained = ngram.score_documents(edges, F.lit(True)).collect()
    assert all(r.n_known == 0 and abs(r.score) < 1e-9 for r in untrained)
    assert ngram.score_documents(empty, F.lit(False)).count() == 0


@pytest.mark.parametrize("n, copies", [(40, 0), (300, 500)])
def test_small_tables_and_hot_ids(spark, n, copies):
    """Few distinct words a chunk, and half of the rows under one id."""
    rng = np.random.default_rng(n)
    docs = [(k, " ".join(f"w{x}" for x in rng.integers(0, 30, rng.integers(0, 9)))) for k in range(n)] + [(7, f"hot w{k % 30} w{k}") for k in range(copies)]
    want = brute(dict(enumerate(t for _, t in docs)), {k: zlib.crc32(str(i).encode()) % 10 == 0 for k, (i, _) in enumerate(docs)}, 3)
    got = ngram.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), doc_key() % 10 == 0, 3, chunks=8).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted((docs[k][0], *w[:3], round(w[3], 6)) for k, w in want.items())


def test_registered_query_scores_by_trigrams(spark, sf, documents, texts):
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in texts}
    want = {order: brute(texts, held, order) for order in (2, 3)}
    got = {r.doc_id: r.score for r in __spark_entry__.queries()["op2_lm_scoring"](spark, sf).collect()}
    off = {order: sum(abs(got[k] - w[4]) for k, w in want[order].items()) for order in want}
    assert len(got) == len(texts) and off[3] < 0.1 * off[2]


@pytest.mark.parametrize("n, shards, bits", [(0, 2, 40), (1, 3, 64), (1000, 7, 64), (70_000, 2, 64), (70_000, 5, 34)])
def test_messages_come_back(n, shards, bits):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**bits - 1, n, np.uint64, endpoint=True)) if n else np.zeros(0, np.uint64)
    assert (ngram.gather(ngram.scatter(keys, bits), bits) == keys).all()
    by, far, edges = ngram.deal(keys, shards, bits)
    parts = [far[edges[s] : edges[s + 1]] for s in range(shards)]
    raw = [ngram.pack_keys(x, s, shards, bits) for s, x in enumerate(parts)]
    back = np.concatenate([ngram.gather(ngram.unpack_keys(x, s, shards, bits), bits) for s, x in enumerate(raw)])
    assert (back == keys[by]).all() and (n < 10_000 or sum(map(len, raw)) < (4.1 + bits - math.log2(n)) / 8 * n)
    counts = rng.choice(np.array([0, 1, 2, 3, 254, 255, 256, 2**50], np.uint64), len(keys))
    assert (ngram.unpack_counts(ngram.pack_counts(counts), len(keys)) == counts).all()


def test_chunks_keep_their_size(documents, texts):
    few = {r.doc_id: (r.n_known, r.base_score, r.score) for r in ngram.score_documents(documents, doc_key() % 10 == 0, 3, chunks=2).collect()}
    for r in ngram.score_documents(documents, doc_key() % 10 == 0, 3, chunks=23).collect():
        known, base, score = few[r.doc_id]
        assert r.n_known == known and abs(r.base_score - base) < 1e-9 * abs(base) and abs(r.score - score) < 1e-9 * abs(score)


def test_base_scores_ask_for_no_ngrams(spark, sf, monkeypatch):
    """lm_base_scores gives op2's figures and takes words alone; its plan is of order 1."""
    orders, score = [], ngram.score_documents
    monkeypatch.setattr(ngram, "score_documents", lambda *a, **k: orders.append(k["order"]) or score(*a, **k))
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score")]
    queries = __spark_entry__.queries()
    got = sorted(map(tuple, queries["lm_base_scores"](spark, sf).collect()))
    assert orders == [1] and got == sorted(map(tuple, queries["op2_lm_scoring"](spark, sf).select(*columns).collect()))
    assert len(got) == 200


def test_a_chunk_asks_in_the_order_of_shards():
    import pyarrow as pa

    chunk = ngram.Chunk(pa.chunked_array([["a b a c", None, "c b a"]]), 2, 40)
    for kind, far, at in chunk.asked():
        bits = ngram.bits_of(kind, 40)
        _, same, edges = ngram.deal(ngram.gather(far, bits), 3, bits)
        assert (same == far).all() and (ngram.edges_of(far, 3, bits) == edges).all() and (np.unique(at) == np.arange(len(far))).all()
