"""Whole Arrow batches of text as numpy arrays: words, shingles, pre-tokens."""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pandas as pd

U = np.uint64
_P = U(0x9E3779B97F4A7C15 | 1)
_INV = U(pow(int(_P), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_POINT = mix(np.arange(1, 0x3001, dtype=U))
_pow = np.ones(1, U)
_inv = np.ones(1, U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            p, q = np.full(size, _P), np.full(size, _INV)
            p[0] = q[0] = 1
            _pow, _inv = np.cumprod(p, dtype=U), np.cumprod(q, dtype=U)
    return _pow, _inv


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of a sequence of 64-bit values."""
    p, q = _powers(len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.empty(len(values) + 1, U)
        total[0] = 0
        np.cumsum(values * p[: len(values)], out=total[1:])
        return mix((total[end] - total[start]) * q[start] + (end - start).astype(U) * U(0xA0761D6478BD642F))


def exact_codes(values: np.ndarray, mixed: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal spans of values share a code: the first place of each distinct
    span, in order, and each span's code. A hash of the mixed values groups
    them; then each is compared, value by value, with the first of its group,
    and should a hash have met two that differ, they are told apart by their bytes."""
    code, found = pd.factorize(span_hashes(mixed, start, end))
    first = np.empty(len(found), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    size, like = end - start, first[code]
    same = np.array_equal(size, size[like])
    if same:
        other = np.flatnonzero(like != np.arange(len(like)))
        n = size[other]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        same = np.array_equal(values[np.repeat(start[other], n) + inner], values[np.repeat(start[like[other]], n) + inner])
    if not same:
        known: dict[bytes, int] = {}
        code = np.fromiter((known.setdefault(values[s:e].tobytes(), len(known)) for s, e in zip(start.tolist(), end.tolist())), np.int64, len(start))
        first = np.empty(len(known), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
    return first, code


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, 9, 10, 11, 12, 13]] = False


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes in table, which end at a row's end: their start, end and
    the number of the row."""
    inside = table[data]
    before = np.empty(len(inside), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    cut = before.copy()
    cut[first] = False
    start = np.flatnonzero(inside & ~cut)
    after = np.empty(len(inside), bool)
    after[-1:] = False
    after[:-1] = inside[1:] & cut[1:]
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


#: Words whose digests a task remembers.
KNOWN_WORDS = 100_000
_digests: dict[bytes, bytes] = {}


def word_digests(words: list[bytes]) -> np.ndarray:
    """128 bits of BLAKE2 of each word, as two columns of 64."""
    if len(_digests) + len(words) > KNOWN_WORDS:
        _digests.clear()
    out = []
    for w in words:
        d = _digests.get(w)
        if d is None:
            d = _digests[w] = hashlib.blake2b(w, digest_size=16).digest()
        out.append(d)
    if len(_digests) > KNOWN_WORDS:
        _digests.clear()
    return np.frombuffer(b"".join(out), U).reshape(-1, 2)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128 bits of each k-word shingle of each row, words being runs without
    ASCII white space with A-Z lower-cased; a row of fewer words gives the
    whole sequence as one, a row without words none. Returns (row, first half,
    second half), each row's distinct ones in ascending order."""
    low = LOWER[data]
    start, end, row = word_spans(low, offsets, SPACE_WORD)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
    at, code = exact_codes(low, _BYTE[low], start, end)
    raw = low.tobytes()
    each = word_digests([raw[s:e] for s, e in zip(start[at].tolist(), end[at].tolist())])
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    last = np.cumsum(count)
    keep = np.arange(len(code)) + k <= last[row]
    short = np.flatnonzero((count > 0) & (count < k))  # such a sequence stands at its first word's place
    keep[last[short] - count[short]] = True
    halves = []
    for half in (0, 1):
        w = each[code, half]
        with np.errstate(over="ignore"):
            h = np.zeros(len(w), U)
            for j in range(k):
                part = w[j:] if j else w
                h[: len(part)] += mix(part + U(j) * U(0xE7037ED1A0B428DB)) * U(2 * j + 1)
            for r in short.tolist():
                s, e = last[r] - count[r], last[r]
                h[s] = (mix(w[s:e] * U(3) + np.arange(e - s, dtype=U)).sum(dtype=U) ^ U(e - s)) + U(e - s)
            halves.append(mix(h)[keep])
    row = row[keep]
    order = np.empty(len(row), np.int64)
    s = 0
    for e in np.cumsum(np.bincount(row, minlength=n)).tolist():
        order[s:e] = halves[0][s:e].argsort() + s
        s = e
    one, two = halves[0][order], halves[1][order]
    first = np.ones(len(one), bool)
    first[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (row[1:] != row[:-1])
    return row[first], one[first], two[first]


#: Unicode White_Space.
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_class = None
#: A code point that this Python doesn't know; the libraries' Unicode may be newer.
_UNKNOWN = 5


def _classes() -> np.ndarray:
    """Of each code point: 0 space, 1 other white space, 2 letter, 3 number, 4
    the rest, 5 unknown here."""
    global _class
    if _class is None:
        names = np.frombuffer("".join(map(unicodedata.category, map(chr, range(0x110000)))).encode(), np.uint8).reshape(-1, 2)
        _class = np.full(0x110000, 4, np.uint8)
        _class[names[:, 0] == ord("L")] = 2
        _class[names[:, 0] == ord("N")] = 3
        _class[(names == np.frombuffer(b"Cn", np.uint8)).all(1)] = _UNKNOWN
        _class[_WHITE] = 1
        _class[0x20] = 0
    return _class


def _known_classes(cp: np.ndarray) -> np.ndarray:
    """The classes of cp; those unknown here are asked of a library's own
    pattern, once each."""
    c = _classes()[cp]
    if (c == _UNKNOWN).any():
        import tiktoken

        asked = np.unique(cp[c == _UNKNOWN])
        _class[asked] = 4
        for kind, pattern in ((2, r"\p{L}"), (3, r"\p{N}")):
            e = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            hit = bytes(e.encode_ordinary("".join(map(chr, asked.tolist())))).decode()
            _class[[ord(x) for x in hit]] = kind
        c = _class[cp]
    return c


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points one after another, and len+1 offsets."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def pre_tokens(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches of the pattern of the byte-level vocabularies in each text: their
    starts (each ends where the next begins) and the number of each one's text.

    The pattern takes, in this order: a contraction ('s 't 're 've 'm 'll 'd);
    letters, numbers or other marks with at most one space before; white space
    but its last character if something follows; other white space."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = _known_classes(cp)
    kind = np.maximum(c, 1)
    new = np.empty(n, bool)  # a run begins
    new[0] = True
    new[1:] = kind[1:] != kind[:-1]
    head = np.zeros(n + 1, bool)  # a text begins
    head[offsets] = True
    new |= head[:n]
    white = kind == 1
    spaced = np.zeros(n, bool)  # a space of the same text stands before
    spaced[1:] = (c[:-1] == 0) & ~head[1:n]
    start = new & (white | ~spaced)
    last = np.zeros(n, bool)  # the last white space before something else
    last[:-1] = white[:-1] & ~white[1:] & ~head[1:n]
    start |= last
    mark = np.flatnonzero(start[:-1] & (cp[:-1] == 39) & ~head[1:n])
    if len(mark):
        a = cp[mark + 1]
        two = np.where(mark + 2 < n, cp[np.minimum(mark + 2, n - 1)], 0)
        two[head[np.minimum(mark + 2, n)]] = 0
        one = np.isin(a, [ord(x) for x in "stmd"])
        pair = ((a == ord("r")) | (a == ord("v"))) & (two == ord("e")) | (a == ord("l")) & (two == ord("l"))
        start[mark[one | pair] + 1] = False
        for hit, width in ((one, 2), (pair, 3)):
            after = mark[hit] + width
            start[after[after < n]] = True
    at = np.flatnonzero(start)
    return at, np.searchsorted(offsets, at, "right") - 1


def distinct_spans(cp: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal spans share a code: the first place of each, and each span's code."""
    return exact_codes(cp, _POINT[cp] if not len(cp) or cp.max() < len(_POINT) else mix(cp.astype(U) + U(1)), start, np.append(start[1:], len(cp)))
