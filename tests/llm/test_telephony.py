import hashlib
import zlib

import numpy as np
import pytest

from quarryline.llm import telephony as t


def test_companding_tables():
    # G.711 end points, zero and monotony of each half.
    assert t.MULAW[0] == -32124 and t.MULAW[0x80] == 32124 and t.MULAW[0x7F] == t.MULAW[0xFF] == 0
    assert t.ALAW[0x55] == -8 and t.ALAW[0xD5] == 8 and t.ALAW[0xAA] == 32256 and t.ALAW[0x2A] == -32256
    assert len(set(t.MULAW.tolist())) == 255 and len(set(t.ALAW.tolist())) == 256
    assert (np.diff(t.MULAW[128:].astype(int)) <= 0).all()


def scalar_adpcm(block):
    value, index, out = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88), []
    out.append(value)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(t.STEP_SIZE[index])
            change = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                change += part if code & bit else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(t.INDEX_STEP[code])))
            out.append(value)
    return out


def test_adpcm_blocks_side_by_side():
    blocks = np.random.default_rng(0).integers(0, 256, (50, 64), dtype=np.uint8)
    assert t.decode_ima_adpcm(blocks).tolist() == [scalar_adpcm(bytes(b)) for b in blocks]


@pytest.mark.parametrize("codec", list(t.FORMATS))
def test_wave_round_trip(codec):
    for n in (0, 1, 64, 129):
        data = bytes(range(n % 256)) + b"x" * (n - n % 256)
        assert t.read_wave(t.wave(data, codec)) == (codec, 8000, data)


def test_resample():
    assert t.resample(np.array([0, 100, -100], np.int16), 8000, 16000).tolist() == [0, 50, 100, 0, -100, -100]
    assert len(t.resample(np.zeros(8000, np.int16), 8000, 11025)) == 11025


def test_all_documents(documents, texts):
    for r in t.to_media(documents).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and t.read_wave(bytes(r.media))[2] == payload
        assert len(r.pcm) == 4 * len(payload)


def test_edges(edges, empty):
    got = {}
    for r in t.to_media(edges, store=False).collect():
        got.setdefault(r.doc_id, set()).add((r.payload_bytes, r.payload_sha256, r.feature))
    assert got[1] == got[2] and got[4] == got[5] and all(len(v) == 1 for v in got.values())
    assert t.to_media(empty).count() == 0
