import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import language, quality, toxicity
from quarryline.llm.common import doc_key


def table(spark, name, sf="/root/testdata/sf0.01"):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_ftrl_is_the_plain_formula():
    rng = np.random.default_rng(0)
    rows = [(np.unique(rng.integers(0, 40, 8)).astype(np.int32), int(rng.random() < 0.4)) for _ in range(300)]
    got = toxicity.fit_ftrl(rows, bits=8, l1=0.5, epochs=2)
    z, n = np.zeros(40), np.zeros(40)
    rate = np.mean([y for _, y in rows])
    bias, bn = np.log(rate / (1 - rate)), 0.0
    weight = lambda f: 0.0 if abs(z[f]) <= 0.5 else -(z[f] - np.sign(z[f]) * 0.5) / (1 + np.sqrt(n[f]) + 1)
    for _ in range(2):
        for f, y in rows:
            w = {k: weight(k) for k in f}
            g = 1 / (1 + np.exp(-(bias + sum(w.values())))) - y
            for k in f:
                z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) * w[k]
                n[k] += g * g
            bn += g * g
            bias -= g / (1 + bn**0.5)
    dense = np.zeros(40)
    dense[got.keys] = got.weights
    assert np.allclose(dense, [weight(k) for k in range(40)]) and abs(got.bias - bias) < 1e-9


def test_toxicity_held_out(spark):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.1"), table(spark, "labels", "/root/testdata/sf0.1")
    model = toxicity.train(docs, labels, usable=doc_key("__id") % 4 != 2)
    got = toxicity.score(docs, model).join(labels, "doc_id").filter(doc_key() % 4 == 2).toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / (got.predicted == 1).sum() > 0.9 and hit / (got.toxic == 1).sum() > 0.85
    assert len(model.keys) < 5000 and got.score.between(0, 1).all()


def test_toxicity_ignores_other_columns_and_edges(spark, edges, empty, labels):
    model = toxicity.Model(-2.0, np.zeros(0, np.int32), np.zeros(0))
    got = toxicity.score(edges, model).collect()
    assert len(got) == 12 and len({r.score for r in got}) == 1 and all(r.predicted == 0 for r in got)
    assert toxicity.drop_toxic(edges, model).columns == edges.columns and toxicity.drop_toxic(edges, model).count() == 12
    assert toxicity.train(empty, labels).scores(np.zeros(0, np.uint8), np.zeros(2, np.int64)).tolist() == [0.5]
    assert toxicity.score(empty, model).count() == 0
    two = spark.createDataFrame([(4, 1), (4, 1), (6, 0), (None, 1), (7, None)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    assert toxicity.train(edges, two) is not None


def test_quality_held_out(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = quality.train(docs, labels, usable=doc_key("__id") % 4 != 2)
    got = quality.score(docs, model).join(labels, "doc_id").filter(doc_key() % 4 == 2).toPandas()
    assert len(got) and ((got.score >= 0.5) == (got.quality == 1)).mean() > 0.95


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 2000).astype(float)
    text, meta = rng.normal(size=(2000, 12)) + y[:, None] * 0.8, rng.normal(size=(2000, 6)) + y[:, None] * 0.8
    few, none = slice(0, 40), quality.Pool(text[:0], meta[:0])
    alone = quality.co_train(text[few], meta[few], y[few], none)
    both = quality.co_train(text[few], meta[few], y[few], quality.Pool(text[40:1500], meta[40:1500]), trust=0.9)
    right = lambda m: ((m.scores(text[1500:], meta[1500:])[0] >= 0.5) == y[1500:]).mean()
    assert right(both) > 0.9 and right(both) > right(alone)


def test_exchange_raises_held_out_accuracy_with_few_labels(spark):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.1"), table(spark, "labels", "/root/testdata/sf0.1")
    got = {}
    for rounds in (0, 4):
        model = quality.train(docs, labels, usable=doc_key("__id") % 4 != 2, train_rows=250, rounds=rounds)
        rows = quality.score(docs, model).join(labels, "doc_id").filter(doc_key() % 4 == 2).toPandas()
        got[rounds] = [((rows[c] >= 0.5) == (rows.quality == 1)).mean() for c in ("score", "text_score", "meta_score")]
        base = (rows.quality == 1).mean()
    assert all(a > b + 0.01 for a, b in zip(got[4], got[0], strict=True)) and got[4][2] > base + 0.05


def test_quality_edges(spark, edges, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(edges, none)
    got = quality.score(edges, model).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got) and quality.score(empty, model).count() == 0


def test_rare_wrong_and_missing_declarations(spark, documents):
    """Declarations in variants, a tenth wrong, a tenth missing; and more languages than any table holds by default."""
    k = F.xxhash64("doc_id") % 10
    worse = documents.withColumn("said", F.when(k == 0, F.lit("fr")).when(k != 1, F.concat(F.upper("lang"), F.lit("-XX"))))
    got = language.identify(worse, declared=F.col("said"), host=F.col("source")).join(documents, "doc_id").filter("n_trigrams > 20").toPandas()
    assert (got.language == got.lang).mean() > 0.99
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + (i + j) % 26)}word" for j in range(12)), f"{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(300)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(many, declared=F.col("lang")).join(many, "doc_id").toPandas()
    assert (got.language == got.lang).all()


def test_keep_languages_judges_rows(spark):
    words = {"en": "the house and the sea are far away from the town", "de": "das haus und die see sind weit weg von der stadt"}
    rows = [(k, words[x], x, "s") for k, x in enumerate(["en", "de"] * 40)] + [(500, words["en"], "en", "s"), (500, words["de"], "de", "s"), (None, words["de"], "de", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = language.keep_languages(df, ("en",)).collect()
    assert len(kept) == 41 and {r.lang for r in kept} == {"en"}


def test_languages_of_all_documents(documents):
    got = language.identify(documents, declared=F.col("lang"), host=F.col("source")).join(documents, "doc_id").toPandas()
    assert len(got) == documents.count() and (got.language == got.lang).mean() > 0.99
    assert language.keep_languages(documents, ("en", "de", "fr", "es")).count() == documents.count()


def test_evidence_decides_where_text_is_silent(spark):
    rows = [(k, "the house and the sea are far away from the town", "en", "en.example", "com") for k in range(60)] + [(100 + k, "das haus und die see sind weit weg von der stadt", "de", "de.example", "de") for k in range(60)]
    rows += [(900, "", None, "de.example", "de"), (901, None, "en", None, None), (902, "12 34", None, "new.de.example", "de"), (903, "das haus und die see", "en", "en.example", "com")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string, suffix string")
    got = {r.doc_id: r for r in language.identify(df, declared=F.col("lang"), host=F.col("host"), suffix=F.col("suffix")).collect()}
    assert [got[k].language for k in (900, 901, 902, 903)] == ["de", "en", "de", "de"]


def test_page_evidence(spark):
    df = spark.createDataFrame([("<HTML class=x LANG='De-at'><p>", "https://me@A.Example.DE:80/x?y"), (None, None), ("<p>no", "not a url")], "html string, url string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in language.page_evidence(df).items()]).collect()]
    assert got == [("de", "a.example.de", "de"), (None, None, None), (None, None, None)]


def test_language_edges(spark, edges, empty):
    got = language.identify(edges, declared=F.col("lang"), host=F.col("source")).collect()
    assert len(got) == 12 and all(0 <= r.posterior <= 1.0000001 for r in got)
    assert language.identify(empty, declared=F.col("lang")).count() == 0
    silent = language.identify(edges).collect()
    assert len(silent) == 12 and all(r.language is None for r in silent)
    assert language.keep_languages(edges).columns == edges.columns


@pytest.mark.parametrize("parts", [1, 7])
def test_search_for_sure_rows_is_that_of_all_rows(spark, documents, parts):
    """The least hashes of all sure rows, whether a part has enough of them or all rows must be searched."""
    n, width = 3000, quality.STATS + quality.TEXT_BUCKETS
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, width + quality.META_BUCKETS)).astype("<f2")
    h = rng.integers(-(2**63), 2**63 - 1, n)
    # Rows lie sorted by their first feature, so that sure ones are together.
    order = np.argsort(x[:, 0].astype(float))
    df = spark.createDataFrame([(int(h[i]), x[i].tobytes()) for i in order], "h long, x binary").coalesce(1).repartition(parts)
    seen = []

    def upto(part):
        seen.append(part)
        return df.filter(F.col("h") < int(-(2**63) + part * 2**64)) if part < 1 else df

    w = [np.zeros(width + 1), np.zeros(quality.META_BUCKETS + 1)]
    w[0][0], w[1][0] = 4.0, 4.0
    for quota, most in (({1.0: 5, 0.0: 9}, 0.5), ({1.0: 400, 0.0: 2000}, 1.0)):
        pool = quality.TablePool(upto, n, width)
        got = pool.sure(w, 0.95, quota)
        assert pool.part <= most
        for k, view in enumerate((x[:, :width], x[:, width:])):
            p = 1 / (1 + np.exp(-(view.astype(np.float32) @ w[k][:-1] + w[k][-1])))
            for label, q in quota.items():
                best = np.flatnonzero((p if label else 1 - p) >= 0.95)
                best = best[np.argsort(h[best])][:q]
                assert (got[k, label][0] == x[best][:, :width].astype(np.float32)).all() and len(got[k, label][0]) == len(best)
