import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarryline.llm import treebpe
from quarryline.llm.queries import op11_tree_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec():
    return treebpe.read_codec(PATH).ready()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(codec, library, texts):
    got = [x.tolist() for x in codec.encode_all(texts)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []
    assert [codec.decode(x) for x in got] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_long_unsplit_texts(codec, library):
    """Lengths around the leaves' bounds, periodic and random letters, where joins must grow."""
    rng = random.Random(7)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "lo", "aeinrst", "the", "!?", "👍x", "é́e", "日本") for n in (1, 63, 64, 65, 127, 128, 129, 1000, 4000)]
    texts += [unit * 2500 for unit in ("x", "ab", "lol", "haha", "tion", "aab", "=-", "́", "ö", "👍")]
    check(codec, library, texts)


def test_windows_grow_until_both_sides_agree(codec):
    """Joining any two encodings is the encoding of the whole; so is a tree of leaves of one byte."""
    rng = random.Random(3)
    for n in (2, 9, 40, 300):
        raw = "".join(rng.choice("aeinrsthl") for _ in range(n)).encode()
        base = codec.inner[np.frombuffer(raw, np.uint8)]
        base[-1] = codec.last[raw[-1]]
        whole = codec.merge(base.copy(), np.array([n]))[0].tolist()
        for at in {1, n // 3 or 1, n - 1}:
            left, right = codec.merge(base[:at].copy(), np.array([at]))[0], codec.merge(base[at:].copy(), np.array([n - at]))[0]
            assert codec.join([(left, right)])[0].tolist() == whole


def test_normalisation(codec, library):
    """Special tokens, composition, white space and case, over all code points."""
    texts = ["", " \t", "Hello<|endoftext|>world<|ENDOFTEXT|>", "e<|startoftext|>́", "ΑΣ ΟΔΟΣ İ ǅ", "don'T 'S a1b22", "a\x1cb\x85c　d​e", "Å ẛ̣ q࢙࢘́"]
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += [" ".join(every[k : k + 2000]) for k in range(0, 0x20000, 2000)] + ["q".join(every[k : k + 500]) for k in range(0, 0x3000, 500)]
    check(codec, library, texts)


def test_merges_that_cannot_be_joined_are_not_cut():
    """Where two merges make one token, a piece is merged whole, as by hand."""
    import json

    vocab = {t: i for i, t in enumerate(["a", "b", "c", "ab", "bc", "abc", "a</w>", "b</w>", "c</w>"])}
    spec = {"added_tokens": [], "model": {"vocab": vocab, "merges": ["a b", "ab c", "b c", "a bc"], "end_of_word_suffix": "</w>"}}
    c = treebpe.TreeCodec(json.dumps(spec)).ready()
    assert not c.proper and c.decode(c.encode("abc" * 100)) == " ".join(["abc"] * 99 + ["ab", "c</w>"])
    assert c.encode("xyz") == []


def test_documents_and_edges(spark, edges, empty, library):
    rows = treebpe.encode_documents(edges, PATH).collect()
    texts = {r.doc_id: r.text or "" for r in edges.collect()}
    assert len(rows) == edges.count()
    for r in rows:
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    back = treebpe.decode_documents(treebpe.encode_documents(edges, PATH), PATH).collect()
    assert {r.doc_id: r.text for r in back} == {i: library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for i, t in texts.items()}
    assert treebpe.encode_documents(empty, PATH).collect() == []
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert treebpe.decode_documents(none, PATH).first().text is None


def test_query(spark, sf, texts, library):
    for r in op11_tree_bpe(spark, sf).collect():
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert op11_tree_bpe(spark, sf).agg(F.count("*")).first()[0] == len(texts)
