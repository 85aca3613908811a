"""A Merkle manifest of a dataset: the hash of every row, the tree over them, and each row's proof.

The rows of a group (by default of a language) ascend by key; every FAN consecutive nodes become
their hash until one is left, the subroot; the subroots, ordered by group, become the root likewise.

A group's place of each row comes from a sort by ranges and the counts of ranges before. A superblock is the
subtree over FAN ** LEVELS consecutive nodes. Its top is reduced from its nodes alone; the tops are the nodes of the next
forest, some thousandth of the rows, and so on until each tree has one node. On the way
back each superblock's nodes meet the outer nodes that their proofs need (the runs on the way
from the superblock's top to the root) in one cogroup, which reduces the superblock, joins
inner and outer siblings to proofs and folds every row's present leaf with them. No group is larger
than a superblock; a hot language is many of them.

Edge cases: null columns count as '-', so null and empty texts differ; null groups come first, as a group of their own; null
keys come first in their group; rows of equal keys are ordered by their leaves; equal rows are proved each
at its own place; a single row is its subroot, with an empty proof where it is the only one; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_key, shuffle_width, stored

#: Nodes of a run, and levels of a superblock: 4096 leaves.
FAN, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(columns: list[Column]) -> Column:
    """SHA-256 of the columns one after the other: '-' for null, else the count of UTF-8 bytes, ':' and the value."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def lowered_third(text: Column) -> tuple[Column, Column]:
    """(condition, value): rows whose crc32 of doc_id is divisible by 3 have A-Z lower-cased."""
    return doc_key() % 3 == 0, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def reduce_levels(nodes: list[str], depth: int | None = None) -> list[list[str]]:
    """All levels over consecutive nodes, from themselves to a single one, or over `depth` levels."""
    levels = [nodes]
    while (len(levels[-1]) > 1) if depth is None else len(levels) <= depth:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return levels


def depth_of(n: int) -> int:
    """Levels between n leaves and their root."""
    d = 0
    while n > 1:
        n, d = -(-n // FAN), d + 1
    return d


def place(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """rows with `pos`, the place from 0 in the order of their tree, and `n`, the tree's size.

    Ranges of (tree, order) are sorted apart; a range's offset is what earlier ranges have of the tree.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(shuffle_width(spark), F.col(tree), *order).withColumn("__range", F.spark_partition_id())
    # Written, so that a range is the same rows for the counts and for the places.
    ranged = stored(ranged.sortWithinPartitions(tree, *order))
    counts = ranged.groupBy(tree, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(tree).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("n", F.sum("__n").over(Window.partitionBy(tree)))
    local = F.row_number().over(Window.partitionBy("__range", tree).orderBy(*order)) - 1
    return ranged.withColumn("__local", local).join(counts.drop("__n"), [tree, "__range"]).withColumn("pos", F.col("__before") + F.col("__local")).drop("__range", "__local", "__before")


def tops(nodes: DataFrame) -> DataFrame:
    """(tree, pos, n, hash) of superblocks, from the same of nodes: each one's own top."""

    def top(key, block):
        block = block.sort_values("pos")
        n = int(block["n"].iloc[0])
        h = reduce_levels(block["hash"].tolist(), min(LEVELS, depth_of(n)))[-1][0]
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "n": [-(-n // FAN**LEVELS)], "hash": [h]})

    return nodes.groupBy("tree", F.expr(f"pos div {FAN**LEVELS}").alias("block")).applyInPandas(top, "tree string, pos long, n long, hash string")


def _inner(block: pd.DataFrame) -> Iterator[tuple[int, list[tuple[int, list[str]]]]]:
    """Of each row of a sorted superblock: (index, its runs up to the superblock's top as (own place, nodes))."""
    depth = min(LEVELS, depth_of(int(block["n"].iloc[0])))
    levels = reduce_levels(block["hash"].tolist(), depth)
    for i in range(len(block)):
        at, runs = i, []
        for level in levels[:depth]:
            lo = at - at % FAN
            runs.append((at - lo, level[lo : lo + FAN]))
            at //= FAN
        yield i, runs


_PATH = "tree string, pos long, at array<int>, runs array<array<string>>, top string"


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, pos, at, runs, top) of (tree, pos, n, hash): every run from a node to its tree's root, the node's place in it, and the root."""
    nodes = stored(nodes)
    widest = nodes.agg(F.max("n")).first()[0] or 0
    outer = None if widest <= FAN**LEVELS else paths(tops(nodes))

    def finish(key, block, above):
        block = block.sort_values("pos")
        at, runs = ([], []) if not len(above) else (list(above["at"].iloc[0]), [list(r) for r in above["runs"].iloc[0]])
        rows = [([k for k, _ in own] + at, [r for _, r in own] + runs) for _, own in _inner(block)]
        top = above["top"].iloc[0] if len(above) else reduce_levels(block["hash"].tolist())[-1][0]
        return pd.DataFrame({"tree": block["tree"], "pos": block["pos"], "at": [r[0] for r in rows], "runs": [r[1] for r in rows], "top": top})

    return _with_outer(nodes, outer, finish, _PATH)


def _with_outer(nodes: DataFrame, outer: DataFrame | None, finish: Callable, schema: str) -> DataFrame:
    """finish over each superblock's nodes and the one row of outer nodes that it has."""
    spark = nodes.sparkSession
    outer = spark.createDataFrame([], _PATH) if outer is None else outer
    own = nodes.withColumn("block", F.expr(f"pos div {FAN**LEVELS}"))
    return own.groupBy("tree", "block").cogroup(outer.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInPandas(finish, schema)


def verify(docs: DataFrame, tamper: Callable[[Column], tuple[Column, Column]] | None = None, key: str = "doc_id", by: str = "lang", text: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    tamper: of the text column, (which rows, their text now); their present leaf is folded with the siblings of the manifest.
    """
    columns = [F.col(f) for f in fields]
    now = leaf(columns)
    if tamper is not None:
        where, value = tamper(F.col(text))
        now = F.when(where, leaf([value if f == text else F.col(f) for f in fields]))
    # '-' comes before '=', so that the null group is the first; groups are ordered by bytes.
    tree = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("-"))
    leaves = stored(docs.select(F.col(key).alias("__key"), tree.alias("tree"), leaf(columns).alias("hash"), now.alias("now")))
    placed = stored(place(leaves, "tree", [F.col("__key").asc_nulls_first(), F.col("hash")]).select("__key", "tree", "hash", F.coalesce("now", "hash").alias("now"), F.col("pos").cast("long"), F.col("n").cast("long")))
    # Runs from each superblock's top to its subroot, and from the subroot to the root.
    inner = paths(tops(placed))
    subroots = inner.filter("pos = 0").select(F.lit("").alias("all"), "tree", F.col("top").alias("hash"))
    forest = stored(place(stored(subroots), "all", [F.col("tree")]).select(F.col("all").alias("tree"), F.col("tree").alias("group"), F.col("pos").cast("long"), F.col("n").cast("long"), "hash"))
    upper = paths(forest.drop("group")).select("pos", F.col("at").alias("u_at"), F.col("runs").alias("u_runs"), F.col("top").alias("root"))
    upper = forest.select(F.col("group").alias("tree"), "pos").join(upper, "pos").drop("pos")
    outer = inner.join(upper, "tree")

    def finish(group, block, above):
        block = block.sort_values("pos")
        row = above.iloc[0]
        outside = list(zip([*row["at"], *row["u_at"]], [list(r) for r in [*row["runs"], *row["u_runs"]]], strict=True))
        # What stands around a row's place in each run outside is the same for the whole superblock.
        around = [("".join(r[:k]), "".join(r[k + 1 :])) for k, r in outside]
        rest = "".join(a + b for a, b in around)
        proof, folded = [], []
        now = block["now"].tolist()
        for i, runs in _inner(block):
            h, told = now[i], []
            for k, r in runs:
                a, b = "".join(r[:k]), "".join(r[k + 1 :])
                told += (a, b)
                h = digest(a + h + b)
            for a, b in around:
                h = digest(a + h + b)
            proof.append(digest("".join(told) + rest))
            folded.append(h)
        out = pd.DataFrame({"__key": block["__key"], "leaf": block["hash"], "subroot": row["top"], "root": row["root"], "proof_sha256": proof, "folded_root": folded})
        out["verified"] = out["folded_root"] == row["root"]
        return out

    kind = docs.schema[key].dataType.simpleString()
    both = placed.withColumn("block", F.expr(f"pos div {FAN**LEVELS}")).groupBy("tree", "block").cogroup(outer.withColumnRenamed("pos", "block").groupBy("tree", "block"))
    return both.applyInPandas(finish, f"__key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean").withColumnRenamed("__key", key)
