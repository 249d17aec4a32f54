"""Telephony audio columns: mu-law, A-law and ADPCM in WAVE files, expanded and resampled.

Companded samples are expanded by lookup tables. Blocks of ADPCM are independent of each other, so
numpy decodes one sample of all blocks at a time. The 8 kHz signal is resampled to 16 kHz by a
half-band filter in integers, so every machine gets the same samples.
"""

from __future__ import annotations

import hashlib
import struct
import sys
import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evlake.llm.common import text_blocks
from evlake.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RATE = 8000
# A payload is whole units of this many bytes, two blocks of ADPCM.
UNIT = 576
BLOCK_DATA = 288
BLOCK_ALIGN = BLOCK_DATA + 4
BLOCK_SAMPLES = 1 + 2 * BLOCK_DATA
# Bytes of media decoded together, and samples resampled at once.
TOGETHER = 1 << 20
SAMPLES = 1 << 18

# Fixed values of the formats: WAVE format tags, the step sizes and index changes of IMA ADPCM.
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73,
    80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494,
    544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499,
    2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
INDEX_CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)
# Half-band filter: the sample between two samples from the four on either side, in 1/32768.
BETWEEN = np.array([-345, 1653, -5110, 20186, 20186, -5110, 1653, -345], dtype=np.int64)


def mulaw_table() -> np.ndarray:
    """Linear values of the 256 mu-law codes."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear values of the 256 A-law codes."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    step, exponent = (code & 0x0F) << 4, code >> 4 & 7
    size = np.where(exponent > 0, step + 0x108 << np.maximum(exponent - 1, 0), step + 8)
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def adpcm_samples(blocks: np.ndarray) -> np.ndarray:
    """Samples of blocks (rows of bytes), one column after the other across all blocks."""
    head = blocks[:, :4].astype(np.int32)
    value = (head[:, 0] | head[:, 1] << 8) << 16 >> 16
    index = np.clip(head[:, 2], 0, len(STEPS) - 1)
    out = np.empty((len(blocks), 1 + 2 * (blocks.shape[1] - 4)), dtype=np.int16)
    out[:, 0] = value
    codes = blocks[:, 4:].T.astype(np.int32)
    for i, pair in enumerate(codes):
        for j, code in enumerate((pair & 15, pair >> 4)):
            step = STEPS[index]
            change = step >> 3
            change = change + (step & -(code >> 2 & 1)) + (step >> 1 & -(code >> 1 & 1)) + (step >> 2 & -(code & 1))
            value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
            index = np.clip(index + INDEX_CHANGES[code], 0, len(STEPS) - 1)
            out[:, 1 + 2 * i + j] = value
    return out


def padded(data: bytes) -> bytes:
    """With bytes 255 up to a positive multiple of the unit."""
    size = max(UNIT, -(-len(data) // UNIT) * UNIT)
    return data + b"\xff" * (size - len(data))


def codec_of(payload: bytes) -> str:
    """A codec by the content, so that equal payloads are stored alike."""
    return sorted(TAGS)[zlib.crc32(payload) % len(TAGS)]


def wave(payload: bytes, codec: str) -> bytes:
    """A mono WAVE file at 8 kHz whose codes are the payload. A block of ADPCM starts at zero."""
    samples = len(payload)
    if codec == "adpcm":
        rows = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK_DATA)
        data = np.concatenate([np.zeros((len(rows), 4), np.uint8), rows], axis=1).tobytes()
        samples = len(rows) * BLOCK_SAMPLES
        form = struct.pack("<HHIIHHHH", TAGS[codec], 1, RATE, RATE * BLOCK_ALIGN // BLOCK_SAMPLES,
                           BLOCK_ALIGN, 4, 2, BLOCK_SAMPLES)
    else:
        data = payload
        form = struct.pack("<HHIIHHH", TAGS[codec], 1, RATE, RATE, 1, 8, 0)
    chunks = b"".join(
        name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
        for name, body in ((b"fmt ", form), (b"fact", struct.pack("<I", samples)), (b"data", data))
    )
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def parts(media: bytes) -> tuple[str, bytes, int]:
    """Codec, data and block size of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag, align = 12, None, 1
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, align = struct.unpack_from("<H", media, at + 8)[0], struct.unpack_from("<H", media, at + 20)[0]
        elif name == b"data":
            codec = {v: k for k, v in TAGS.items()}[tag]
            return codec, media[at + 8 : at + 8 + size], align
        at += 8 + size + size % 2
    raise ValueError("no data in the WAVE file")


def decoded(files: list[bytes]) -> Iterator[tuple[str, bytes, np.ndarray]]:
    """Codec, payload and 8 kHz samples of each file; ADPCM blocks of all files go together."""
    opened = [parts(f) for f in files]
    rows = [np.frombuffer(d, np.uint8).reshape(-1, a) for c, d, a in opened if c == "adpcm"]
    samples: list[np.ndarray] = []
    if rows:
        blocks = np.concatenate(rows)
        values = np.concatenate([adpcm_samples(blocks[i : i + 4096]) for i in range(0, len(blocks), 4096)])
        samples = np.split(values, np.cumsum([len(r) for r in rows])[:-1])
    turn = iter(zip(rows, samples))
    for codec, data, _ in opened:
        if codec == "adpcm":
            own, values = next(turn)
            yield codec, own[:, 4:].tobytes(), values.ravel()
        else:
            yield codec, data, TABLES[codec][np.frombuffer(data, np.uint8)]


def resampled(samples: np.ndarray) -> Iterator[np.ndarray]:
    """The signal at 16 kHz in blocks; silence stands before the first and after the last sample."""
    half = len(BETWEEN) // 2
    for at in range(0, len(samples), SAMPLES):
        stop = min(len(samples), at + SAMPLES)
        low, high = at - half + 1, stop + half
        near = samples[max(0, low) : high].astype(np.int64)
        near = np.pad(near, (max(0, -low), max(0, high - len(samples))))
        out = np.empty(2 * (stop - at), dtype=np.int16)
        out[::2] = samples[at:stop]
        total = sum(h * near[k : k + stop - at] for k, h in enumerate(BETWEEN.tolist()))
        out[1::2] = np.clip(total + (1 << 14) >> 15, -32768, 32767)
        yield out


def features(codec: str, samples: np.ndarray) -> str:
    """Codec, samples at 16 kHz, peak, root mean square, sign changes and CRC of the resampled PCM."""
    count = peak = energy = changes = crc = 0
    last = False
    for block in resampled(samples):
        wide = block.astype(np.int64)
        sign = np.concatenate([[last], block < 0]) if count else block < 0
        changes += int((sign[1:] != sign[:-1]).sum())
        last = bool(sign[-1])
        peak = max(peak, int(np.abs(wide).max()))
        energy += int((wide * wide).sum())
        count += len(block)
        crc = zlib.crc32(block.astype("<i2").tobytes(), crc)
    return f"{codec}:{count}:{peak}:{isqrt(energy // max(1, count))}:{changes}:{crc:08x}"


def media_of(text: Column) -> Column:
    """The stored form of a text's payload; a null text is empty."""

    @F.pandas_udf("binary")
    def store(texts: pd.Series) -> pd.Series:
        payloads = (padded((t or "").encode("utf-8", "replace")) for t in texts)
        return pd.Series([wave(p, codec_of(p)) for p in payloads], dtype=object)

    return store(text.cast("string"))


READ = T.StructType([
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
])


def read_back(media: Column) -> Column:
    """A struct of what the stored bytes hold: sizes, digests and features of the resampled PCM."""

    @F.pandas_udf(READ)
    def read(column: pd.Series) -> pd.DataFrame:
        files, rows = [bytes(m) for m in column], []
        for first, last in text_blocks(files, TOGETHER):
            group = files[first:last]
            for raw, (codec, payload, samples) in zip(group, decoded(group)):
                rows.append((
                    len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw),
                    hashlib.sha256(raw).hexdigest(), features(codec, samples),
                ))
        return pd.DataFrame(rows, columns=[f.name for f in READ])

    return read(media)


def pcm(media: Column) -> Column:
    """The resampled 16-bit PCM of a stored file, little-endian."""

    @F.pandas_udf("binary")
    def decode(column: pd.Series) -> pd.Series:
        files, out = [bytes(m) for m in column], []
        for first, last in text_blocks(files, TOGETHER):
            for _, _, samples in decoded(files[first:last]):
                out.append(b"".join(b.astype("<i2").tobytes() for b in resampled(samples)))
        return pd.Series(out, dtype=object)

    return decode(media)


def stored_media(docs: DataFrame, text_col: str = "text", name: str = "media") -> DataFrame:
    """``docs`` with the stored form of each text, written to the shared folder and read again."""
    return cut_lineage(docs.withColumn(name, media_of(F.col(text_col))))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes`` and what the stored bytes of each text hold, read back.

    Null and empty texts are one unit of padding. Rows with equal or null ids are rows of their
    own; equal texts have equal values; other columns are not read; an empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"),
        media_of(text).alias("media"),
    ))
    return rows.select("doc_id", "n_bytes", read_back(F.col("media")).alias("m")).select("doc_id", "n_bytes", "m.*")
