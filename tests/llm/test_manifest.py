import zlib
from hashlib import sha256

import pytest

from quarryline.llm import manifest

COLUMNS = "doc_id", "source", "lang", "n_chars", "text"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, lower=False):
    out = []
    for c in COLUMNS:
        v = row[c]
        if c == "text" and lower and v is not None:
            v = "".join(x.lower() if "A" <= x <= "Z" else x for x in v)
        out.append(field(v))
    return h(*out)


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute(rows):
    """Every row's result from whole trees in memory."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = climb([leaf(r) for r in groups[g]])
    top = climb([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            steps = []
            for levels, at in ((trees[g], i), (top, k)):
                for level in levels[:-1]:
                    lo = at - at % 8
                    steps.append((level[lo:at], level[at + 1 : lo + 8]))
                    at //= 8
            lower = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            now = leaf(r, lower)
            for a, b in steps:
                now = h(*a, now, *b)
            root = top[-1][0]
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], root, h(*[x for a, b in steps for x in a + b]), now, now == root))
    return sorted(out, key=str)


def run(df):
    return sorted((tuple(r) for r in manifest.verify(df, manifest.lowered_third).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65])
def test_small_trees(spark, n):
    rows = [{"doc_id": k, "source": "s", "lang": None if k % 5 == 3 else "ab"[k % 2], "n_chars": k, "text": f"Text {k}"} for k in range(n)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    assert run(df) == brute(rows)


def test_several_superblocks(spark):
    """A language of more leaves than two superblocks, so that outer nodes are on another forest; many small languages beside it."""
    rows = [{"doc_id": k, "source": "s", "lang": "hot" if k < 8200 else f"l{k % 70}", "n_chars": k % 9, "text": f"Row {k % 100}"} for k in range(9000)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    assert run(df) == brute(rows)


def test_edges(spark, edges, empty):
    """Null and repeated ids, equal rows, null text and empty text, clashing columns."""
    more = spark.createDataFrame([(None, "x", "en", None, 1), (None, "x", "en", None, 1), (None, "y", None, "a", 1), (20, "", "é", "", 0), (21, None, "", "", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    df = edges.unionByName(more, allowMissingColumns=True)
    assert run(df) == brute([{c: r[c] for c in COLUMNS} for r in df.collect()])
    assert run(empty) == []
    assert all(r.verified for r in manifest.verify(edges).collect())


def test_a_changed_text_is_found(spark, documents):
    got = {r.doc_id: r.verified for r in manifest.verify(documents, manifest.lowered_third).collect()}
    changed = {r.doc_id for r in documents.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text and r.text != "".join(x.lower() if "A" <= x <= "Z" else x for x in r.text)}
    assert {i for i, fine in got.items() if not fine} == changed
