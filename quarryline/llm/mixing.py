"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Each source has a target: its weight's share of the wanted total, but at most
   `max_passes` times its size, what is over going to the others by weight.
2. The blocks of the mix go to sources, and a source's blocks to its shards, by the highest
   quotients target / (2k + 1).
3. A shard lays its texts end to end in seeded order and cuts them into blocks of equal
   length; its quota takes blocks by a seeded permutation, whole passes first.

A shard holds at most about `shard_words` words whatever its source's size, so a source with a
third of all rows is spread over as many tasks as its size asks for. Only per-source and
per-shard sums are ranked.

A source has at most MAX_SHARDS shards, whose quotients one task ranks; of a source beyond
MAX_SHARDS * shard_words words the shards grow instead.

Edge cases: a null or empty text has size 0 and is never taken; a null source is a source, last
in order; an empty table gives an empty mix; rows that share a doc_id, or have none, are texts
of their own, each with its own plan, dealt to shards by doc_id and text; rows that share both
are in one shard, and which of them is taken is left open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut

SEED = 17


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, max_passes: int = 2) -> DataFrame:
    """source, source_size, target of (source, size) rows; weights repeat over the sources by code point, null last.

    Water-filling in closed form: with sources by size / weight ascending, the first k stand at
    their cap, where k is the first at which the rest's common level doesn't pass the next cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    at = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(max_passes))
    every = Window.partitionBy(F.lit(0))
    by_level = Window.partitionBy(F.lit(0)).orderBy("level", F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    return (
        per.withColumn("cap", cap)
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("wanted", F.least(F.sum("source_size").over(every) * F.lit(float(share)), F.sum("cap").over(every)))
        .withColumn("common", (F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("common", F.min(F.when(F.col("common") <= F.col("level"), F.struct(F.row_number().over(by_level).alias("k"), "common"))).over(every)["common"])
        .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("common") * F.col("weight"), F.col("cap"))))
        .select("source", "source_size", "target")
    )


def sainte_lague(parties: DataFrame, group: list[str], key: list[str], votes: str, seats: Column, out: str) -> DataFrame:
    """Adds `out`: each party's seats among those of its group, by the highest quotients votes / (2k + 1), ties by key.

    Seats that every divisor near the exact one gives are dealt by rounding; only the few in
    doubt, at most about two a party, are ranked as quotients.
    """
    own = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    p = parties.withColumn("__seats", seats).withColumn("__all", F.sum(votes).over(own)).withColumn("__n", F.count(F.lit(1)).over(own))

    def rounded(total: Column) -> Column:
        return F.when((F.col(votes) > 0) & (total > 0), F.floor(F.col(votes) * total / F.col("__all") + 0.5)).otherwise(0).cast("long")

    p = p.withColumn("__low", rounded(F.col("__seats") - F.col("__n") / 2 - 1)).withColumn("__high", F.when(F.col("__seats") > 0, rounded(F.col("__seats") + F.col("__n") / 2 + 1)).otherwise(0))
    p = p.withColumn("__left", F.col("__seats") - F.sum("__low").over(own))
    doubt = p.filter(F.col("__high") > F.col("__low")).select("*", F.explode(F.sequence("__low", F.col("__high") - 1)).alias("__k"))
    by = own.orderBy((F.col(votes) / (2 * F.col("__k") + 1)).desc(), *[F.col(c).isNull() for c in key], *[F.col(c) for c in key])
    won = doubt.withColumn("__rank", F.row_number().over(by)).filter(F.col("__rank") <= F.col("__left")).groupBy(*key).agg(F.count(F.lit(1)).alias("__won"))
    won = won.select(*[F.col(c).alias(f"__w_{c}") for c in key], "__won")
    same = [p[c].eqNullSafe(won[f"__w_{c}"]) for c in key]
    return p.join(won, same, "left").withColumn(out, F.col("__low") + F.coalesce("__won", F.lit(0))).drop(*[c for c in p.columns if c.startswith("__")], *won.columns)


#: Most rows of a per-source or per-shard table that is sent to every executor; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
#: A source with a target below so many blocks is dealt blocks of one word.
SMALL_BLOCKS = 64
#: Most shards of one source: their quotients are ranked together, in one task.
MAX_SHARDS = 1_000_000


def _placed(docs: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    """docs (with doc_id, source, size, mark) and each row's source number, shard and source facts."""
    out = docs.join(quotas, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    return out.withColumn("shard", F.when(F.col("shards") > 0, F.pmod(F.xxhash64(F.lit(seed), "doc_id", "mark"), F.col("shards"))).otherwise(F.lit(0).cast("long")))


def _plan(sizes: DataFrame, rows: DataFrame, weights: tuple[float, ...], share: float, max_passes: int, block_words: int, shard_words: int, seed: int) -> DataFrame:
    """rows (with doc_id, source, size, mark; the same in sizes) with source_size, target and blocks. Rows pass one shuffle, by shard."""
    targets = source_targets(sizes, weights, share, max_passes)
    # Sources whose target is a few blocks only are dealt words, so that these too come near it.
    unit = F.when(F.col("target") < SMALL_BLOCKS * block_words, 1).otherwise(block_words)
    blocks = F.round(F.sum("target").over(Window.partitionBy("unit")) / F.col("unit")).cast("long")
    quotas = sainte_lague(targets.withColumn("unit", unit), ["unit"], ["source"], "target", blocks, "source_blocks")
    per = F.greatest(F.lit(shard_words).cast("double"), F.col("source_size") / MAX_SHARDS)
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    quotas = cut(quotas.select(F.col("source").alias("__s"), number.alias("src"), "source_size", "target", "unit", "source_blocks", F.ceil(F.col("source_size") / per).cast("long").alias("shards")))
    small = F.broadcast(quotas) if quotas.count() <= BROADCAST_ROWS else quotas

    shard_sizes = _placed(sizes, small, seed).groupBy("src", "shard").agg(F.sum("size").alias("shard_size"), F.max("source_blocks").alias("source_blocks"), F.max("unit").alias("unit"))
    per_shard = sainte_lague(shard_sizes, ["src"], ["src", "shard"], "shard_size", F.col("source_blocks"), "quota")
    n = F.greatest(F.round(F.col("shard_size") / F.col("unit")), F.lit(1)).cast("long")
    per_shard = per_shard.withColumn("n_blocks", n).withColumn("quota", F.least(F.col("quota"), F.col("n_blocks") * max_passes))
    per_shard = cut(per_shard.select("src", "shard", "shard_size", "n_blocks", "quota"))
    per_shard = F.broadcast(per_shard) if per_shard.count() <= BROADCAST_ROWS else per_shard

    running = Window.partitionBy("src", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "mark"), "doc_id", "mark", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = _placed(rows, small, seed).withColumn("stop", F.sum("size").over(running)).withColumn("start", F.col("stop") - F.col("size"))
    return laid.join(per_shard, ["src", "shard"], "left").withColumn("blocks", _blocks(seed))


def _facts(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    """doc_id, source, size, and mark: a hash of the text, so that rows of one doc_id are told apart."""
    return docs.select("doc_id", "source", word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("mark"), *more)


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, max_passes: int = 2, block_words: int = 64, shard_words: int = 200_000, seed: int = SEED, text_col: str = "text") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, and blocks: (times, start, stop) word ranges, stop exclusive.

    One pass over the texts; what is shuffled is (doc_id, source, size, mark).
    """
    sizes = cut(_facts(docs, text_col))
    laid = _plan(sizes, sizes, weights, share, max_passes, block_words, shard_words, seed)
    taken = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, s: a + s["times"] * (s["stop"] - s["start"]))
    return laid.select("doc_id", "source", "size", "source_size", "target", "blocks").withColumn("taken", F.coalesce(taken, F.lit(0).cast("long")))


def _blocks(seed: int) -> Column:
    """The word ranges of a laid-out text, and how often its shard's quota takes each.

    Block j of n covers words floor(j * S / n) to floor((j + 1) * S / n) - 1 of the shard. The
    quota's whole passes take each block; the rest, r of n, takes exactly r by systematic
    selection from a seeded start. The texts' order is seeded too.
    """
    begin = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.col("n_blocks"))
    rest = F.col("quota") % F.col("n_blocks")
    whole = F.expr("quota div n_blocks")

    def block(j: Column) -> Column:
        bound = lambda k: F.floor(k * F.col("shard_size") / F.col("n_blocks"))
        picked = F.floor(((j + 1) * rest + begin) / F.col("n_blocks")) - F.floor((j * rest + begin) / F.col("n_blocks"))
        left = F.greatest(bound(j), F.col("start")) - F.col("start")
        right = F.least(bound(j + 1), F.col("stop")) - F.col("start")
        return F.struct((whole + picked).cast("long").alias("times"), left.cast("long").alias("start"), right.cast("long").alias("stop"))

    # The block of word w is the last j with floor(j * S / n) <= w.
    lo, hi = F.expr("((start + 1) * n_blocks - 1) div shard_size"), F.expr("(stop * n_blocks - 1) div shard_size")
    taken = F.filter(F.transform(F.sequence(lo, hi), block), lambda s: (s["times"] > 0) & (s["stop"] > s["start"]))
    return F.when((F.col("size") > 0) & (F.col("quota") > 0), taken)


#: A word and the white space after it.
_PIECE = r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, max_passes: int = 2, block_words: int = 64, shard_words: int = 200_000, seed: int = SEED, text_col: str = "text") -> DataFrame:
    """The mix itself: docs' columns, one row for each text and pass that takes words of it, text cut to those words.

    The rows themselves are laid out in their shards, so each gets its own plan, whatever ids it
    shares with others. A text that a pass takes whole stays as it is; of another, the words taken
    keep the white space that follows them. n_chars, if there is one, becomes the new text's length.
    """
    columns = docs.columns
    sizes = cut(_facts(docs, text_col))
    laid = _plan(sizes, _facts(docs, text_col, F.struct(*[F.col(c) for c in columns]).alias("__row")), weights, share, max_passes, block_words, shard_words, seed)
    out = laid.filter(F.size("blocks") > 0).select("__row", "size", "blocks").withColumn("__pass", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("blocks", lambda b: b["times"])).cast("int"))))
    own = F.filter("blocks", lambda b: b["times"] >= F.col("__pass"))
    out = out.select("__row", "size", own.alias("__own"))
    text = F.col("__row")[text_col]
    # The words stand in an array of one array, so that the pieces below share one evaluation of them.
    words = F.array(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(1)))
    pieces = lambda w: F.transform("__own", lambda b: F.array_join(F.slice(w, (b["start"] + 1).cast("int"), (b["stop"] - b["start"]).cast("int")), ""))
    n = F.aggregate("__own", F.lit(0).cast("long"), lambda a, b: a + b["stop"] - b["start"])
    part = F.element_at(F.transform(words, lambda w: F.array_join(pieces(w), "")), 1)
    out = out.select(F.col("__row"), F.when(n == F.col("size"), text).otherwise(part).alias("__text"))
    new = {text_col: F.col("__text")}
    if "n_chars" in columns:
        new["n_chars"] = F.length("__text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("__row")[c]).alias(c) for c in columns])
