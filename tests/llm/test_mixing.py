import math
import re
import time

import pytest
from pyspark.sql import functions as F

from quarryline.llm import mixing


def webster(votes, seats):
    got = dict.fromkeys(votes, 0)
    for _ in range(seats):
        k = max(votes, key=lambda x: votes[x] / (2 * got[x] + 1))  # the first of equals
        got[k] += 1
    return got


@pytest.mark.parametrize("votes, seats", [({"a": 53.0, "b": 24.0, "c": 23.0}, 7), ({"a": 1.0, "b": 1.0, "c": 1.0}, 2), ({"a": 0.0, "b": 5.0}, 3), ({"a": 1000.0, "b": 1.0}, 40), ({"a": 9.0}, 0)])
def test_highest_quotients(spark, votes, seats):
    df = spark.createDataFrame(list(votes.items()), "k string, v double")
    got = {r.k: r.s for r in mixing.sainte_lague(df, [], ["k"], "v", F.lit(seats), "s").collect()}
    assert got == webster(votes, seats)


def test_targets_by_water_filling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 5)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    total = 1.5 * 1115
    assert got["a"] == 20 and got["b"] == 200 and got[None] == 10 and abs(got["c"] - (total - 230)) < 1e-6


def test_mix_of_all(documents, texts):
    rows = mixing.plan_mix(documents).collect()
    assert len(rows) == len(texts) and {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in mixing.plan_mix(documents).collect()}
    per = {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])) and 0 <= r.taken <= 2 * r.size
        per.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(taken - target) <= max(0.03 * target, 64) for target, taken in per.values())


def test_texts_of_the_mix(documents):
    plan = {r.doc_id: r.taken for r in mixing.plan_mix(documents).collect()}
    got = {}
    for r in mixing.mix_documents(documents).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert got == {k: v for k, v in plan.items() if v}


def by_hand(documents, shard_words=200_000, block_words=64, seed=mixing.SEED):
    """Words taken of each row, worked out block by block and word by word."""
    h = lambda k, *c: F.xxhash64(F.lit(seed + k), *c)
    rows = documents.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), F.xxhash64("text").alias("mark"))
    rows = rows.withColumns({"a": h(0, "doc_id", "mark"), "b": h(1, "doc_id", "mark")}).collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    order = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    weight = {x: (5.0, 2.0, 1.0)[k % 3] for k, x in enumerate(order)}
    target, left, open_ = {}, min(1.5 * sum(sizes.values()), 2.0 * sum(sizes.values())), set(sizes)
    while open_:
        level = left / sum(weight[x] for x in open_)
        full = {x for x in open_ if 2.0 * sizes[x] <= level * weight[x]}
        for x in full or open_:
            target[x] = 2.0 * sizes[x] if full else level * weight[x]
        left -= sum(target[x] for x in full or open_)
        open_ -= full or open_
    unit = {x: 1 if target[x] < mixing.SMALL_BLOCKS * block_words else block_words for x in order}
    quota = {}
    for u in set(unit.values()):
        own = {x: target[x] for x in order if unit[x] == u}
        quota |= webster(own, int(sum(own.values()) / u + 0.5))
    spark, taken = documents.sparkSession, []
    for x in order:
        own = [r for r in rows if r.source == x]
        n_shards = math.ceil(sizes[x] / max(shard_words, sizes[x] / mixing.MAX_SHARDS))
        shards = {}
        for r in own:
            shards.setdefault(r.a % n_shards if n_shards else 0, []).append(r)
        seats = {k: 0 for k in shards}
        votes = {k: sum(r.size for r in v) for k, v in shards.items()}
        for _ in range(quota[x] if sum(votes.values()) else 0):
            seats[max(sorted(seats), key=lambda k: votes[k] / (2 * seats[k] + 1))] += 1
        for k, docs in shards.items():
            total = votes[k]
            n = max(int(total / unit[x] + 0.5), 1)
            got = min(seats[k], 2 * n)
            begin = spark.range(1).select(F.pmod(h(2, F.lit(x).cast("string"), F.lit(k).cast("long")), F.lit(n))).first()[0]
            picked = [got // n + ((j + 1) * (got % n) + begin) // n - (j * (got % n) + begin) // n for j in range(n)]
            block_of = [j for j in range(n) for _ in range(j * total // n, (j + 1) * total // n)]
            at = 0
            for r in sorted(docs, key=lambda r: (r.b, r.doc_id is not None, r.doc_id or 0, r.mark)):
                taken.append((str(r.doc_id), r.size, sum(picked[j] for j in block_of[at : at + r.size])))
                at += r.size
    return sorted(taken)


@pytest.mark.parametrize("shard_words", [200_000, 3_000])
def test_words_of_each_document_by_hand(documents, edges, shard_words):
    for df in (documents, edges):
        got = sorted((str(r.doc_id), r.size, r.taken) for r in mixing.plan_mix(df, shard_words=shard_words).collect())
        assert got == by_hand(df, shard_words)


def test_small_sources_come_near_their_targets(spark):
    """Sources of a few words, beside large ones."""
    sizes = {"a": 30, "b": 36, "c": 45, "d": 1, "e": 400, "f": 90_000, "g": 120_000, None: 7}
    rows = [(k, " ".join(["w"] * n), s) for k, (s, n) in enumerate((s, len(part)) for s, n in sizes.items() for part in [range(n)[i : i + 700] for i in range(0, n, 700)])]
    got = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert {r.source for r in got} == set(sizes)
    for r in got:
        assert abs(r.taken - r.target) <= max(1, 0.01 * r.target)


def test_edges(edges, empty):
    rows = mixing.plan_mix(edges).collect()
    assert len(rows) == 12 and all(r.taken == 0 for r in rows if not r.size)
    got = mixing.mix_documents(edges)
    assert got.columns == edges.columns and got.schema == edges.schema
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in got.collect()) == sum(r.taken for r in rows)
    assert mixing.plan_mix(empty).collect() == [] and mixing.mix_documents(empty).collect() == []


def test_rows_of_one_id_keep_their_own_plans_and_long_texts_are_quick(spark):
    long = " ".join(f"w{k % 977}" for k in range(200_000))
    rows = [(1, "a " * 500, "s"), (1, "b " * 3000, "s"), (2, "c " * 3000, "s"), (None, "d " * 50, "t"), (None, "e " * 900, "t"), (None, "d " * 50, "t"), (8, long, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan, began = {}, time.time()
    for r in mixing.plan_mix(df).collect():
        plan[r.size] = plan.get(r.size, 0) + r.taken
    out, got = mixing.mix_documents(df), {}
    began = time.time()
    for r in out.collect():
        size = {"a": 500, "b": 3000, "c": 3000, "d": 50, "e": 900}.get(r.text[0], 200_000)
        got[size] = got.get(size, 0) + len(r.text.split())
    assert got == plan and time.time() - began < 20
