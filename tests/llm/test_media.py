"""Round trips of stored audio, and decoders against plain ones."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evlake.llm import media


def plain_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(88, block[2]), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            change = step >> 3
            change += step if code & 4 else 0
            change += step >> 1 if code & 2 else 0
            change += step >> 2 if code & 1 else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(media.INDEX_CHANGES[code])))
            out.append(value)
    return out


def test_tables():
    mulaw, alaw = media.TABLES["mulaw"], media.TABLES["alaw"]
    assert (mulaw[0], mulaw[0x80], mulaw[0x7F], mulaw[0xFF]) == (-32124, 32124, 0, 0)
    assert (alaw[0xD5], alaw[0x55], alaw[0xAA], alaw[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(alaw.tolist())) == 256 and len(set(mulaw.tolist())) == 255


def test_adpcm_across_blocks():
    rng = random.Random(3)
    blocks = np.array([[rng.randrange(256) for _ in range(40)] for _ in range(9)], dtype=np.uint8)
    assert media.adpcm_samples(blocks).tolist() == [plain_adpcm(b.tobytes()) for b in blocks]


@pytest.mark.parametrize("codec", sorted(media.TAGS))
def test_stored_payload_comes_back(codec):
    rng = random.Random(codec)
    files = [media.wave(media.padded(rng.randbytes(n)), codec) for n in (0, 1, 576, 577, 5000)]
    for raw, (found, payload, samples) in zip(files, media.decoded(files)):
        assert found == codec and media.wave(payload, codec) == raw
        whole = np.concatenate(list(media.resampled(samples)))
        assert (whole[::2] == samples).all() and len(whole) == 2 * len(samples)


def test_resampling_in_blocks(monkeypatch):
    samples = np.random.default_rng(2).integers(-32768, 32767, 1000).astype(np.int16)
    whole = np.concatenate(list(media.resampled(samples)))
    said = media.features("x", samples)
    monkeypatch.setattr(media, "SAMPLES", 37)
    assert (np.concatenate(list(media.resampled(samples))) == whole).all()
    assert media.features("x", samples) == said
    wide = np.concatenate([np.zeros(3), samples, np.zeros(4)])
    for n in (0, 1, 500, 999):
        want = int(sum(h * wide[n + k] for k, h in enumerate(media.BETWEEN.tolist())) + (1 << 14)) >> 15
        assert whole[2 * n + 1] == max(-32768, min(32767, want))


def test_query_rows(spark):
    texts = ["", None, "é", "a" * 576, "b" * 577, "a" * 576, "long " * 40000]
    docs = spark.createDataFrame([(i if i else None, t, t) for i, t in enumerate(texts)], "doc_id bigint, text string, media string")
    got = {r.doc_id: r for r in media.text_media(docs).collect()}
    for i, t in enumerate(texts):
        r, data = got[i or None], (t or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_bytes > len(payload)
    assert got[3][2:] == got[5][2:]
    assert media.text_media(docs.limit(0)).count() == 0
    stored = media.stored_media(docs.drop("media"))
    sizes = stored.select(F.octet_length(media.pcm(F.col("media"))).alias("n"), "text").collect()
    assert {r.n for r in sizes if not r.text} <= {576 * 4, 2 * media.BLOCK_SAMPLES * 4}
