"""Language identification by Bayesian fusion of evidence.

The posterior of a language multiplies
- the text's likelihood: a multinomial over hashed byte trigrams of its lower-cased words, with
  counts of all documents summed per declared language, damped to TEXT_TRIGRAMS of evidence;
- the declared markup language: how often a declaration goes with a language, from counts of
  (declared, language by text);
- the prior of the host, smoothed towards that of its address suffix, and that towards the
  overall shares, all from grouped counts.

Counts are made by grouped aggregation over all rows; a hot host adds one partial row a task.
Declarations count by their primary subtag in lower case (en-US is en). A language is told apart if
its declared texts have MIN_TRIGRAMS trigrams or a thousandth of all; so many numbers of trigram
buckets are broadcast. Host priors grow with the data and are joined.

Edge cases: null and empty texts have no text evidence and fall to the declaration and prior;
a null declaration or host gives no evidence of its own; an empty table gives no rows; with no
declared language anywhere, language is null and the posterior 0; ties go to the first language
by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .textops import _FOLD, buffer_of, slices

BUCKETS = 1 << 14
#: Trigrams of declared text that a language needs; less is enough if it is a thousandth of all.
MIN_TRIGRAMS = 2000
#: A long text counts as so many independent trigrams at most, as neighbours overlap.
TEXT_TRIGRAMS = 60.0
KAPPA = 20.0
BROADCAST_ROWS = 100_000


def primary(declared: Column) -> Column:
    """The primary subtag of a declared language, in lower case; blank is null."""
    return F.nullif(F.lower(F.trim(F.split(declared.cast("string"), "[-_]")[0])), F.lit(""))


def trigrams(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the letter trigrams of all texts, and the text of each; anything but letters is a word edge."""
    b = _FOLD[buf]
    letter = (b >= 0x80) | ((b >= 0x61) & (b <= 0x7A))
    x = np.where(letter, b, 0x20).astype(np.int64)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ok = letter[1:-1] & (doc[2:] == doc[:-2])
    code = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    return ((code[ok] * 0x9E3779B1) >> 8) % BUCKETS, doc[1:-1][ok]


def trigram_counts(docs: DataFrame, text_col: str, lang: Column) -> DataFrame:
    """(lang, bucket, n) over all documents with a declared language; summed in each task before the shuffle."""
    inp = docs.select(lang.alias("lang"), F.col(text_col).alias("text")).filter("lang is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            buf, at = buffer_of(batch.column(1))
            names, code = np.unique(np.array(batch.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
            for lo, hi in slices(at):
                t, doc = trigrams(buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                got = np.bincount(code.ravel()[lo + doc] * BUCKETS + t, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for k, name in enumerate(names):
                    if got[k].any():
                        sums[name] = sums.get(name, 0) + got[k]
        for name, n in sums.items():
            at_bucket = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at_bucket)), pa.array(at_bucket.astype(np.int32)), pa.array(n[at_bucket].astype(np.int64))], ["lang", "bucket", "n"])

    return inp.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def text_model(docs: DataFrame, text_col: str = "text", declared: Column | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each trigram bucket in each: BUCKETS numbers a language."""
    counts = cut(trigram_counts(docs, text_col, primary(F.col("lang") if declared is None else declared)))
    sums = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    every = sums.agg(F.sum("n")).first()[0] or 0
    top = [r.lang for r in sums.filter((F.col("n") >= MIN_TRIGRAMS) | (F.col("n") * 1000 >= every)).collect()]
    langs = sorted(top, key=lambda x: x.encode())
    n = np.zeros((len(langs), BUCKETS))
    where = {x: k for k, x in enumerate(langs)}
    for r in counts.filter(F.col("lang").isin(langs)).toLocalIterator():
        n[where[r.lang], r.bucket] = r.n
    return langs, np.log((n + 0.5) / (n.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))


def likelihoods(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str, keep: list[str]) -> DataFrame:
    """The `keep` columns, n_trigrams, and ll: the mean log likelihood of the text's trigrams in each language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inp = docs.select(*keep, F.col(text_col).alias("__text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inp.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logp = shared.value
        for batch in batches:
            buf, at = buffer_of(batch.column(batch.num_columns - 1))
            for lo, hi in slices(at):
                t, doc = trigrams(buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                n = np.bincount(doc, minlength=hi - lo)
                ll = np.zeros((hi - lo, len(langs)))
                for k in range(len(langs)):
                    ll[:, k] = np.bincount(doc, weights=logp[k][t], minlength=hi - lo)
                ll /= np.maximum(n, 1)[:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * len(langs), pa.int32()), pa.array(ll.ravel()))
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[:-1]], pa.array(n.astype(np.int64)), lists], [*batch.schema.names[:-1], "n_trigrams", "ll"])

    return inp.mapInArrow(run, f"{head}, n_trigrams long, ll array<double>")


def _first_max(values: Column) -> Column:
    """1-based place of the first largest entry."""
    return F.array_position(values, F.array_max(values)).cast("int")


def identify(docs: DataFrame, key: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, model: tuple | None = None) -> DataFrame:
    """key, language, posterior, text_language, n_trigrams, log_likelihood (mean, of the language).

    declared: the markup's language. host and suffix: of the address.
    """
    none = F.lit(None).cast("string")
    declared = none if declared is None else primary(declared)
    host = none if host is None else host
    suffix = none if suffix is None else suffix
    facts = docs.select(F.col(key).alias("__key"), declared.cast("string").alias("__declared"), host.cast("string").alias("__host"), suffix.cast("string").alias("__suffix"), F.col(text_col).alias("__words"))
    langs, logp = model or text_model(facts, "__words", F.col("__declared"))
    if not langs:
        return facts.select(F.col("__key").alias(key), none.alias("language"), F.lit(0.0).alias("posterior"), none.alias("text_language"), F.lit(0).cast("long").alias("n_trigrams"), F.lit(0.0).alias("log_likelihood"))
    names = F.array(*[F.lit(x) for x in langs])
    seen = cut(likelihoods(facts, (langs, logp), "__words", ["__key", "__declared", "__host", "__suffix"]))
    seen = seen.withColumn("text_language", F.when(F.col("n_trigrams") > 0, F.element_at(names, _first_max(F.col("ll")))))

    # Grouped counts of what the text says, per host and per declaration.
    pairs = seen.filter("text_language is not null").groupBy("__host", "__suffix", "__declared", "text_language").agg(F.count(F.lit(1)).alias("n"))
    pairs = cut(pairs)
    count_of = lambda group: pairs.groupBy(*group).agg(*[F.sum(F.when(F.col("text_language") == x, F.col("n")).otherwise(0)).cast("double").alias(f"n{k}") for k, x in enumerate(langs)])
    vector = lambda: F.array(*[F.col(f"n{k}") for k in range(len(langs))])
    total = count_of([]).first()
    overall = [(float(x or 0) + 1) / (sum(float(y or 0) for y in total) + len(langs)) for x in total]
    share = lambda n, prior: F.transform(F.arrays_zip(n.alias("n"), prior.alias("p")), lambda z: (z["n"] + KAPPA * z["p"]) / (F.aggregate(n, F.lit(0.0), lambda a, b: a + b) + KAPPA))
    base = F.array(*[F.lit(x) for x in overall])
    by_suffix = count_of(["__suffix"]).select(F.col("__suffix").alias("__s"), share(vector(), base).alias("__prior_s"))
    by_host = count_of(["__host", "__suffix"]).filter("__host is not null")
    by_host = by_host.join(F.broadcast(by_suffix) if by_suffix.count() <= BROADCAST_ROWS else by_suffix, F.col("__suffix").eqNullSafe(F.col("__s")), "left")
    by_host = cut(by_host.select(F.col("__host").alias("__h"), F.col("__suffix").alias("__hs"), share(vector(), F.coalesce("__prior_s", base)).alias("__prior")))
    by_host = F.broadcast(by_host) if by_host.count() <= BROADCAST_ROWS else by_host
    # P(declared | language): columns of the declaration table, each language's counts smoothed over the declarations seen.
    sums = [float(x or 0) for x in total]
    by_declared = count_of(["__declared"]).filter("__declared is not null")
    spread = F.array(*[(F.col(f"n{k}") + 0.5) / (sums[k] + 0.5 * (len(langs) + 1)) for k in range(len(langs))])
    by_declared = cut(by_declared.select(F.col("__declared").alias("__d"), spread.alias("__channel")))
    by_declared = F.broadcast(by_declared) if by_declared.count() <= BROADCAST_ROWS else by_declared

    flat = F.array(*[F.lit(1.0)] * len(langs))
    joined = seen.join(by_host, (F.col("__host") == F.col("__h")) & F.col("__suffix").eqNullSafe(F.col("__hs")), "left").join(by_declared, F.col("__declared") == F.col("__d"), "left")
    joined = joined.withColumn("__p", F.coalesce("__prior", base)).withColumn("__c", F.coalesce("__channel", flat))
    weight = F.least(F.col("n_trigrams").cast("double"), F.lit(TEXT_TRIGRAMS))
    logs = F.transform(F.arrays_zip("ll", "__p", "__c"), lambda z: z["ll"] * weight + F.log(z["__p"]) + F.log(z["__c"]))
    joined = joined.withColumn("__logs", logs).withColumn("__top", F.array_max("__logs")).withColumn("__at", _first_max(F.col("__logs")))
    posterior = 1 / F.aggregate("__logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("__top")))
    return joined.select(F.col("__key").alias(key), F.element_at(names, F.col("__at")).alias("language"), posterior.alias("posterior"), "text_language", "n_trigrams", F.element_at("ll", F.col("__at")).alias("log_likelihood"))


def page_evidence(pages: DataFrame) -> dict[str, Column]:
    """declared, host and suffix of a page: the html element's lang, the url's host and its last label."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    lang = F.lower(F.nullif(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1), F.lit("")))
    host = F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    return {"declared": lang, "host": host, "suffix": F.element_at(F.split(host, r"\."), -1)}


def page_text(pages: DataFrame) -> Column:
    """A page's text without scripts, styles, comments and tags, for its trigrams."""
    return F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&\w+;", " ")


#: A document's language counts as known from this posterior on.
MIN_POSTERIOR = 0.5


def keep_languages(docs: DataFrame, languages: tuple[str, ...] | None = None, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """docs' rows whose language is known and, if languages are given, one of them; rows of one doc_id are judged each by itself."""
    mark = F.xxhash64("text", "lang", "source")
    got = identify(docs.withColumn("__row", F.struct("doc_id", mark.alias("mark"))), "__row", declared=F.col("lang"), host=F.col("source"))
    ok = (F.col("posterior") >= min_posterior) & F.col("language").isNotNull()
    if languages is not None:
        ok &= F.col("language").isin(*languages)
    keep = got.filter(ok).select(F.col("__row.doc_id").alias("__keep"), F.col("__row.mark").alias("__mark"))
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col("__keep")) & (mark == F.col("__mark")), "left_semi")
