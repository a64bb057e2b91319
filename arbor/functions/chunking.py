"""Content-defined chunks and similarity signatures of byte strings."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes of a chunk at least, about and at most; of a file that is stored whole; of the windows of a signature; its hashes.
LEAST, MEAN, MOST = 8 << 10, 16 << 10, 32 << 10
WHOLE = 128 << 10
SHINGLE, SIGNATURE = 16, 8

U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U(33))


_GEAR = _mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def _rolling(raw: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the 64 up to it, by doubling the window."""
    h = _GEAR[raw]
    for k in (1, 2, 4, 8, 16, 32):
        with np.errstate(over="ignore"):
            h[k:] = h[k:] + (h[:-k] << U(k))
    return h


def cut_points(raw: bytes) -> list[int]:
    """Ends of the chunks."""
    x = np.frombuffer(raw, np.uint8)
    ends, at = [], 0
    hit = np.flatnonzero((_rolling(x.copy()) >> U(64 - 14)) == 0) + 1 if len(x) else np.zeros(0, np.int64)
    while at < len(x):
        near = hit[np.searchsorted(hit, at + LEAST) :][:1]
        end = int(near[0]) if len(near) and near[0] <= at + MOST else at + MOST
        ends.append(min(end, len(x)))
        at = ends[-1]
    return ends


def object_id(domain: str, raw: bytes) -> str:
    return hashlib.sha256(domain.encode() + b"\0" + raw).hexdigest()


def chunks(raw: bytes) -> list[tuple[int, int, int, str, int]]:
    """(seq, offset, length, chunk id, repeat) of a file: none if empty, one if
    it is stored whole, else its chunks, a run of zero chunks as one."""
    if not raw:
        return []
    if len(raw) < WHOLE:
        return [(0, 0, len(raw), object_id("whole", raw), 1)]
    out, at = [], 0
    for end in cut_points(raw):
        part = raw[at:end]
        name = object_id("chunk", part)
        if out and len(part) == MOST == out[-1][2] and name == out[-1][3] and not any(part[:64]):
            seq, start, length, _, times = out[-1]
            out[-1] = (seq, start, length, name, times + 1)
        else:
            out.append((len(out), at, len(part), name, 1))
        at = end
    return out


def signature(raw: bytes) -> list[int]:
    """The smallest distinct 32-bit hashes of the 16-byte windows."""
    x = np.frombuffer(raw, np.uint8).astype(U)
    n = len(x) - SHINGLE + 1
    if n <= 0:
        return []
    h = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            h = h * U(257) + x[k : k + n]
    h = _mixed(h)
    h = ((h >> U(32)) ^ h) & U(0xFFFFFFFF)
    few = np.unique(np.partition(h, min(n - 1, 4 * SIGNATURE))[: 4 * SIGNATURE + 1])
    found = few if len(few) >= SIGNATURE else np.unique(h)
    return found[:SIGNATURE].astype(np.int64).tolist()
