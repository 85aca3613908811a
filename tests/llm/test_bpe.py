import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quarryline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN).ready()
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def looked_up(codec, pieces):
    ends = np.cumsum([len(p) for p in pieces])
    return codec.lookup(np.frombuffer(b"".join(pieces), np.uint8), ends - [len(p) for p in pieces], ends).tolist()


def test_the_hash_is_minimal_and_perfect():
    buf = np.frombuffer(b"".join(RANKS), np.uint8)
    ends = np.cumsum([len(k) for k in RANKS])
    slots = CODEC.hash.slots(CODEC._hashes(buf, ends - [len(k) for k in RANKS], ends))
    assert sorted(slots.tolist()) == list(range(len(RANKS)))
    assert looked_up(CODEC, list(RANKS)) == list(RANKS.values())
    assert looked_up(CODEC, [b"no such token at all", b"the", b"\xff\xfe\xfd", b"zq"]) == [RANKS.get(b"no such token at all", -1), RANKS[b"the"], -1, RANKS.get(b"zq", -1)]


def test_two_vocabularies_of_one_size(spark, tmp_path):
    """Each encodes by its own merges, in one session's workers."""
    single = [bytes([b]) for b in range(256)]
    df = spark.createDataFrame([(1, "the hat")], "doc_id long, text string")
    got = []
    for name, merges in (("a", [b"he", b"th", b"the"]), ("b", [b"th", b"he", b"the"])):
        ranks = {t: k for k, t in enumerate(single + merges)}
        path = tmp_path / name
        path.write_text("\n".join(f"{base64.b64encode(t).decode()} {r}" for t, r in ranks.items() if t != b"the" or name == "a"))
        mine = bpe.read_ranks(str(path))
        ids = bpe.encode_documents(df, str(path), public_tokenizers.PATTERN).first().ids
        own = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=mine, special_tokens={})
        assert ids == own.encode_ordinary("the hat")
        got.append(ids)
    assert got[0] != got[1]


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, "  \n\n x", "héé 😀😀 \x00 it's", "<|endoftext|>", "日本語テキスト", "\r\n\t", "don'T"])
def test_as_tiktoken(text):
    assert CODEC.encode(text) == REFERENCE.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)).decode() == text


def test_random_texts():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choices("ab éü日\n'st1.,-  ", k=rng.randint(1, 200)))
        assert CODEC.encode(text) == REFERENCE.encode_ordinary(text)


def test_all_documents(documents, texts):
    for r in bpe.encode_documents(documents, PATH, public_tokenizers.PATTERN).collect():
        ids = REFERENCE.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edges_and_round_trip(edges, empty):
    coded = bpe.encode_documents(edges, PATH, public_tokenizers.PATTERN)
    back = sorted((r.doc_id, r.text) for r in bpe.decode_documents(coded, PATH).collect())
    assert back == sorted((r.doc_id, r.text or "") for r in edges.collect())
    assert bpe.encode_documents(empty, PATH, public_tokenizers.PATTERN).count() == 0
