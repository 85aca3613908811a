"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_text, language, lexical, manifest, mixing, ngram, quality, simhash, sketch, telephony, toxicity, treebpe
from .common import doc_key, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % of all words, sources weighing 5, 2, 1, takes of each document."""
    return mixing.plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 trigram probability of every document, learned from those whose crc32(doc_id) mod 10 isn't 0."""
    return ngram.score_documents(table(spark, sf_dir, "documents"), doc_key() % 10 == 0, order=3)


def op3_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as mu-law samples in a WAVE file, read back."""
    return telephony.to_media(table(spark, sf_dir, "documents"), store=False)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how near they are."""
    return sketch.fingerprint_edits(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned without the rows whose crc32(doc_id) mod 4 is 2."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), usable=doc_key("__id") % 4 != 2)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (doc_key() % 4 == 2).alias("held_out"), "score", "text_score", "meta_score", (F.col("score") >= 0.5).alias("keep"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned without the rows whose crc32(doc_id) mod 4 is 2."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=doc_key("__id") % 4 != 2)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (doc_key() % 4 == 2).alias("held_out"), "score", "predicted")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the round trip through them."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, ids=False)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: text, declared language, and the prior of its source."""
    docs = table(spark, sf_dir, "documents")
    got = language.identify(docs, declared=F.col("lang"), host=F.col("source"))
    return got.withColumn("keep", F.col("language").isNotNull() & (F.col("posterior") >= language.MIN_POSTERIOR))


def op11_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by a vocabulary with word ends, and the text that they decode to."""
    return treebpe.encode_documents(table(spark, sf_dir, "documents"), WORD_BPE, ids=False)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash, proof and verification of every document, where a third of the texts has been lower-cased since."""
    return manifest.verify(table(spark, sf_dir, "documents"), manifest.lowered_third)


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page: text, the html element's lang, address suffix and host."""
    pages = table(spark, sf_dir, "pages")
    return language.identify(pages.withColumn("__text", language.page_text(pages)), "page_id", "__text", **language.page_evidence(pages))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_telephony_audio": op3_telephony_audio,
    "op4_html_text": op4_html_text,
    "op5_bottom_k": op5_bottom_k,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_language_id": op10_language_id,
    "op11_tree_bpe": op11_tree_bpe,
    "op12_lexical_search": op12_lexical_search,
    "op13_merkle_manifest": op13_merkle_manifest,
    "language_id_pages": language_id_pages,
}


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 knows of each document before blocks are dealt: size, source's size and target."""
    return mixing.plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2's counts and base score, of words alone: no n-gram has a part in them."""
    return ngram.score_documents(table(spark, sf_dir, "documents"), doc_key() % 10 == 0, order=1).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's lengths and the digests of its edited texts."""
    return op5_bottom_k(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES |= {"mixing_targets": mixing_targets, "lm_base_scores": lm_base_scores, "edited_texts": edited_texts}

#: DuckDB's regular expressions are bytes' or characters' alike here: a word has no ASCII white space in it.
_WORD = r"[^\x20\x09-\x0D]+"


def _with_crc(condition: str) -> str:
    """CTEs up to d: documents with `hit`, whether crc32(doc_id), as c, fulfils the condition."""
    return f"""WITH RECURSIVE bit(i, k, c) AS (SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bit WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM bit WHERE k = 8),
d AS (SELECT * EXCLUDE (c), {condition} AS hit FROM (SELECT documents.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS c FROM documents, crc_table))"""


_FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"



def _hashed(text: str) -> str:
    """SQL of a row's leaf."""
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, leaves: str) -> str:
    """CTE of all nodes (g, lvl, idx, h) over leaves (g, idx, h), until each tree has one."""
    return f"{name}(g, lvl, idx, h) AS (SELECT g, 0, idx, h FROM {leaves} UNION ALL SELECT g, lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {name}) WHERE c > 1 GROUP BY g, lvl, idx // 8)"


ORACLE_SQL: dict[str, str] = {
    # All nodes of the trees of languages and of the tree over these; siblings left and right of each row on each level; then the fold.
    "op13_merkle_manifest": f"""{_with_crc("c % 3 = 0")},
leaves AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, {_hashed("text")} AS h, CASE WHEN hit THEN {_hashed(_FOLDED.format("text"))} ELSE {_hashed("text")} END AS now FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS idx FROM leaves),
{_levels("low", "placed")},
depth AS (SELECT g, max(lvl) AS depth FROM low GROUP BY g),
subs AS (SELECT '' AS g, tree, row_number() OVER (ORDER BY tree) - 1 AS idx, h FROM (SELECT g AS tree, h FROM low SEMI JOIN depth ON low.g = depth.g AND lvl = depth)),
{_levels("high", "subs")},
root AS (SELECT h AS root, lvl AS above FROM high ORDER BY lvl DESC LIMIT 1),
steps AS (SELECT doc_id, lvl, n.idx AS spot, p.idx // CAST(8 ** lvl AS BIGINT) AS own, n.h FROM placed p JOIN low n ON p.g = n.g AND n.idx // 8 = p.idx // CAST(8 ** lvl AS BIGINT) // 8 JOIN depth ON p.g = depth.g AND lvl < depth
UNION ALL SELECT doc_id, depth + lvl, n.idx, s.idx // CAST(8 ** lvl AS BIGINT), n.h FROM placed p JOIN subs s ON p.g = s.tree JOIN depth ON p.g = depth.g JOIN high n ON n.idx // 8 = s.idx // CAST(8 ** lvl AS BIGINT) // 8, root WHERE lvl < above),
sides AS (SELECT doc_id, lvl, coalesce(string_agg(h, '' ORDER BY spot) FILTER (WHERE spot < own), '') AS l, coalesce(string_agg(h, '' ORDER BY spot) FILTER (WHERE spot > own), '') AS r FROM steps GROUP BY ALL),
fold(doc_id, lvl, h) AS (SELECT doc_id, 0, now FROM placed UNION ALL SELECT f.doc_id, f.lvl + 1, sha256(l || h || r) FROM fold f JOIN sides s ON f.doc_id = s.doc_id AND f.lvl = s.lvl)
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, root, sha256(coalesce(q.proof, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM placed p JOIN subs s ON p.g = s.tree JOIN (SELECT doc_id, arg_max(h, lvl) AS h FROM fold GROUP BY 1) f ON p.doc_id = f.doc_id LEFT JOIN (SELECT doc_id, string_agg(l || r, '' ORDER BY lvl) AS proof FROM sides GROUP BY 1) q ON p.doc_id = q.doc_id, root""",
    "op12_lexical_search": f"""WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
g AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_all FROM s),
i AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, g GROUP BY term, n_docs),
r AS (SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_all)))) AS BIGINT) AS score FROM i JOIN f USING (term) JOIN w USING (term) JOIN s USING (doc_id), g GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 20""",
    # The first water level at which no cap is passed, with sources by cap / weight.
    "mixing_targets": f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight FROM d GROUP BY 1),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS level, 1.5::DOUBLE * sum(source_size) OVER () AS wanted FROM s),
w AS (SELECT *, row_number() OVER o AS k, (wanted - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS common FROM c WINDOW o AS (ORDER BY level, source NULLS LAST)),
l AS (SELECT arg_min(common, k) AS common FROM w WHERE common <= level)
SELECT doc_id, size, source_size, round(least(cap, coalesce(l.common * weight, cap)), 4) AS target FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source, l""",
    "lm_base_scores": f"""{_with_crc("c % 10 = 0")},
t AS (SELECT doc_id, hit AS held_out, unnest(list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}'), ' ')) AS word FROM d),
c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))), 4) AS base_score FROM t LEFT JOIN c USING (word), n GROUP BY doc_id""",
    "edited_texts": """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lead(coalesce(text, '')) OVER w AS after, first_value(coalesce(text, '')) OVER w AS start FROM documents WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(left(text, length(text) - length(text) // 2) || left(coalesce(after, start), length(text) // 2)) AS edited_sha256 FROM d""",
}
