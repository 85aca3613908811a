"""Telephony audio columns: mu-law, A-law and IMA ADPCM, decoded with numpy, and resampled PCM.

Companded samples expand by 256-entry tables computed from the codec's rule. ADPCM blocks are
decoded side by side: the loop runs over the samples of a block, each step over all blocks.

Edge cases: a null payload counts as empty; an empty text becomes one padded unit of 64 zero
bytes; equal payloads give equal media and features; payloads of any length are used whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import buffer_of, slices

RATE = 8000
BLOCK = 64
#: WAVE format tags.
FORMATS = {"pcm": 1, "alaw": 6, "mulaw": 7, "ima_adpcm": 17}

# Fixed values of the IMA ADPCM format: the change of the step index for each 4-bit code.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
# Fixed values of the IMA ADPCM format: the 89 step sizes.
STEP_SIZE = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
        157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
        1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
        12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)


def mulaw_table() -> np.ndarray:
    """int16 value of each mu-law byte (G.711: inverted bits, bias 132)."""
    u = ~np.arange(256, dtype=np.int64) & 0xFF
    size = ((((u & 15) << 3) + 132) << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """int16 value of each A-law byte (G.711: even bits inverted)."""
    a = np.arange(256, dtype=np.int64) ^ 0x55
    exponent, size = (a >> 4) & 7, ((a & 15) << 4) + 8
    size = np.where(exponent > 0, (size + 256) << np.maximum(exponent - 1, 0), size)
    return np.where(a & 128, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()
# One step of the decoder for each (step index, code): the difference, by the format's shift-and-add rule.
_CODE = np.arange(16)
_STEP = STEP_SIZE[:, None]
DIFFERENCE = (_STEP >> 3) + np.where(_CODE & 4, _STEP, 0) + np.where(_CODE & 2, _STEP >> 1, 0) + np.where(_CODE & 1, _STEP >> 2, 0)
DIFFERENCE = np.where(_CODE & 8, -DIFFERENCE, DIFFERENCE).astype(np.int32).ravel()
NEXT_INDEX = np.clip(np.arange(89)[:, None] + INDEX_STEP[None, :], 0, 88).astype(np.int32).ravel()


def decode_ima_adpcm(blocks: np.ndarray) -> np.ndarray:
    """int16 samples (blocks x (1 + 2 * (bytes - 4))) of mono blocks: int16 predictor, step index, reserved byte, codes low nibble first.

    A step index beyond 88 is taken as 88.
    """
    blocks = np.ascontiguousarray(blocks, np.uint8)
    n, width = blocks.shape
    value = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    out[0] = value
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(width - 4):
        for half, code in enumerate((data[k] & 15, data[k] >> 4)):
            at = index * 16 + code
            value = np.clip(value + DIFFERENCE[at], -32768, 32767)
            index = NEXT_INDEX[at]
            out[1 + 2 * k + half] = value
    return out.T


def resample(pcm: np.ndarray, rate_in: int, rate_out: int) -> np.ndarray:
    """Linear interpolation to another rate; int16 in and out, the last sample held."""
    if rate_in == rate_out or len(pcm) == 0:
        return pcm
    if rate_out == 2 * rate_in:
        out = np.empty(2 * len(pcm), np.int16)
        out[::2] = pcm
        out[1::2] = (pcm.astype(np.int32) + np.append(pcm[1:], pcm[-1:])) >> 1
        return out
    t = np.arange(len(pcm) * rate_out // rate_in) * (rate_in / rate_out)
    return np.interp(t, np.arange(len(pcm)), pcm).round().astype(np.int16)


def wave(data: bytes, codec: str = "mulaw", rate: int = RATE) -> bytes:
    """A mono RIFF/WAVE file around `data`, which is stored as it is."""
    if codec == "ima_adpcm":
        per_block = 1 + 2 * (BLOCK - 4)
        fmt = struct.pack("<HHIIHHHH", FORMATS[codec], 1, rate, rate * BLOCK // per_block, BLOCK, 4, 2, per_block)
    else:
        width = 2 if codec == "pcm" else 1
        fmt = struct.pack("<HHIIHH", FORMATS[codec], 1, rate, rate * width, width, 8 * width)
    pad = b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 20 + len(fmt) + len(data) + len(pad)) + b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + pad


def read_wave(media: bytes) -> tuple[str, int, bytes]:
    """Codec, rate and data bytes of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, codec, rate = 12, "", 0
    while at + 8 <= len(media):
        name, (size,) = media[at : at + 4], struct.unpack_from("<I", media, at + 4)
        body = at + 8
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, body)
            codec = next((k for k, v in FORMATS.items() if v == tag), "")
        elif name == b"data":
            return codec, rate, media[body : body + size]
        at = body + size + (size & 1)
    raise ValueError("no data chunk")


def expand(data: bytes, codec: str) -> np.ndarray:
    """int16 samples of stored data."""
    raw = np.frombuffer(data, np.uint8)
    if codec == "mulaw":
        return MULAW[raw]
    if codec == "alaw":
        return ALAW[raw]
    if codec == "ima_adpcm":
        return decode_ima_adpcm(raw[: len(raw) // BLOCK * BLOCK].reshape(-1, BLOCK)).reshape(-1)
    if codec == "pcm":
        return raw[: len(raw) // 2 * 2].view("<i2")
    raise ValueError(f"unknown codec {codec!r}")


def features(pcm: np.ndarray) -> list[float]:
    """RMS, peak, zero-crossing rate and mean absolute slope of int16 samples."""
    if not len(pcm):
        return [0.0, 0.0, 0.0, 0.0]
    x = pcm.astype(np.int64)
    sign = pcm < 0
    return [float(np.sqrt(np.mean(x * x))), float(np.abs(x).max()), float(np.count_nonzero(sign[1:] != sign[:-1]) / len(x)), float(np.abs(np.diff(x)).mean() if len(x) > 1 else 0.0)]


def to_media(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), codec: str = "mulaw", rate_out: int = 2 * RATE, store: bool = True) -> DataFrame:
    """Per row: n_bytes, media (the WAVE bytes, if store), payload facts read back from it, pcm (resampled, if store) and a feature string.

    feature: `codec`'s samples as rms;peak;zcr;slope, the crc32 of the resampled PCM, and the
    same four figures of the payload read as IMA ADPCM blocks of 64 bytes. Not shuffled.
    """
    inp = docs.select(*keep, F.col(text_col).alias("__text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inp.schema.fields[:-1])
    out = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in out.split(", ")] + ["media", "pcm"] * store

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = buffer_of(batch.column(batch.num_columns - 1))
            for lo, hi in slices(at):
                yield pa.RecordBatch.from_arrays([c.slice(lo, hi - lo) for c in batch.columns[:-1]] + _measure(buf, at[lo : hi + 1], codec, rate_out, store), [*batch.schema.names[:-1], *names])

    return inp.mapInArrow(run, f"{head}, {out}" + ", media binary, pcm binary" * store)


def _measure(buf: np.ndarray, at: np.ndarray, codec: str, rate_out: int, store: bool) -> list[pa.Array]:
    payloads, medias, rows = [], [], []
    for a, b in zip(at[:-1], at[1:], strict=True):
        raw = buf[a:b].tobytes()
        medias.append(media := wave(raw + b"\0" * (-len(raw) % BLOCK or BLOCK * (not raw)), codec))
        payloads.append(read_wave(media)[2])
    # ADPCM state is per block: the blocks of all rows are decoded in one pass.
    n_blocks = [len(p) // BLOCK for p in payloads]
    adpcm = decode_ima_adpcm(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK))
    first, pcms = 0, []
    for raw_size, payload, media, n in zip(np.diff(at).tolist(), payloads, medias, n_blocks, strict=True):
        pcm = expand(payload, codec)
        wide = resample(pcm, RATE, rate_out)
        figures = [*features(pcm), *features(adpcm[first : first + n].reshape(-1))]
        first += n
        text = codec + ":" + ";".join(f"{x:.6g}" for x in figures[:4]) + f"|pcm{rate_out}:{zlib.crc32(wide.tobytes()):08x}|ima_adpcm:" + ";".join(f"{x:.6g}" for x in figures[4:])
        rows.append((raw_size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), text))
        if store:
            pcms.append(wide.tobytes())
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    return columns + ([pa.array(medias, pa.binary()), pa.array(pcms, pa.binary())] if store else [])
