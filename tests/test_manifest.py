"""Chunk manifests against a version that goes byte by byte."""

import hashlib
import random

from arbor.operators import storage
from arbor.plans import registry

M = 2**64 - 1


def mixed(x):
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * by & M
    return x ^ x >> 33


GEAR = [mixed((i + 1) * 0x9E3779B97F4A7C15 & M) for i in range(256)]


def bytewise(raw):
    """seq, offset, length, chunk id and repeat of each chunk of a file."""
    if len(raw) < 128 << 10:
        return [(0, 0, len(raw), hashlib.sha256(b"whole\0" + raw).hexdigest(), 1)] if raw else []
    out, start, h = [], 0, 0
    for end, byte in enumerate(raw, 1):
        h = (h << 1) + GEAR[byte] & M
        if end - start >= 8 << 10 and h >> 50 == 0 or end - start == 32 << 10 or end == len(raw):
            part = raw[start:end]
            name = hashlib.sha256(b"chunk\0" + part).hexdigest()
            if out and out[-1][3] == name and len(part) == 32 << 10 and not any(part):
                out[-1] = (*out[-1][:4], out[-1][4] + 1)
            else:
                out.append((len(out), start, len(part), name, 1))
            start = end
    return out


def test_manifest_rows(spark):
    rng = random.Random(6)
    files = {"empty": b"", "short": b"abc", "just whole": rng.randbytes((128 << 10) - 1), "cut": rng.randbytes(128 << 10), "long": rng.randbytes(700_001), "zeros": rng.randbytes(50_000) + bytes(300_000) + rng.randbytes(9), "text": b"one line of many\n" * 20_000}
    docs = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "content_id string, bytes binary")
    got = sorted((r["content_id"], r["seq"], r["offset"], r["length"], r["chunk_id"], r["repeat"]) for r in storage.chunk_manifest(docs).collect())
    assert got == sorted((k, *c) for k, v in files.items() for c in bytewise(v))


def test_the_registered_manifest_has_its_rows(spark):
    d = "/root/testdata/sf0.001"
    got = registry.queries()["chunk_manifest_rows"](spark, d)
    rows = got.orderBy("content_id", "seq").collect()
    assert got.columns == ["content_id", "seq", "offset", "length", "chunk_id", "repeat"]
    from arbor.plans import stores

    files = {r["content_id"]: bytes(r["bytes"]) for r in stores._files(spark, d).select("content_id", "bytes").collect()}
    assert [tuple(r) for r in rows] == [(k, *c) for k in sorted(files) for c in bytewise(files[k])]
