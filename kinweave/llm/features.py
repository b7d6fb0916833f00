"""Hashed text features over whole batches of texts at once, in numpy."""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the polynomial hash, and feature space.
MULTIPLIER, BITS = 0x9E3779B97F4A7C15, 20
SIZE = 1 << BITS
_POWERS: dict[str, np.ndarray] = {}

_CLASS = bytearray(range(256))
for _b in range(256):
    _CLASS[_b] = ord("x") if chr(_b).islower() and _b < 128 or _b >= 128 else ord("X") if _b < 128 and chr(_b).isupper() else ord("0") if _b < 128 and chr(_b).isdigit() else _b
_CLASS = bytes(_CLASS)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", MULTIPLIER), ("down", pow(MULTIPLIER, -1, 1 << 64))):
            steps = np.full(n + n // 8 + 1024, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches where the mask holds."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].view(np.int8)))
    return edge[::2], edge[1::2]


class Hashed:
    """The bytes of some texts with prefix sums, for hashes of any of their stretches."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        up, self.down = _power(len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=self.total[1:], dtype=np.uint64)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.total[ends] - self.total[starts]) * self.down[starts]


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of a hash."""
    with np.errstate(over="ignore"):
        x = (h ^ np.uint64(seed * 0x9E3779B9 + 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        return x * np.uint64(0x94D049BB133111EB)


def bucket(h: np.ndarray, seed: int) -> np.ndarray:
    """Feature numbers of hashes."""
    return (mixed(h, seed) >> np.uint64(64 - BITS)).astype(np.int64)


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes (null: none), a line end after each, and where each begins."""
    parts = [(t or "").encode() for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts])
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), np.r_[0, ends[:-1]] if len(parts) else np.zeros(0, np.int64)


def word_ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of hashed word n-grams: words and word pairs (A-Z in lower case), the words' shapes, shape pairs, and
    the share of three-word windows seen before. Values are shares of the text's words; texts without words have none."""
    raw, starts_of = joined(texts)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    a, b = runs(~space)
    if not len(a):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    doc = np.searchsorted(starts_of, a, side="right") - 1
    n = np.bincount(doc, minlength=len(texts)).astype(np.float64)
    lower = np.frombuffer(raw.tobytes().lower(), np.uint8)
    h1 = Hashed(lower).of(a, b)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    h2 = mixed(h1[pair], 11) + h1[pair + 1]
    shape = np.frombuffer(raw.tobytes().translate(_CLASS), np.uint8)
    keep = np.r_[True, (shape[1:] != shape[:-1]) | space[1:]]
    short = shape[keep]
    gap = (short == 32) | ((short >= 9) & (short <= 13))
    sa, sb = runs(~gap)
    s1 = Hashed(short).of(sa, sb)
    s2 = mixed(s1[pair], 12) + s1[pair + 1]
    parts = [(doc, bucket(h1, 1)), (doc[pair], bucket(h2, 2)), (doc, bucket(s1, 3)), (doc[pair], bucket(s2, 4))]
    d, f = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    v = 1.0 / n[d]
    three = pair[:-1][np.diff(pair) == 1] if len(pair) > 1 else pair[:0]
    if len(three):
        h3 = mixed(mixed(h1[three], 13) + h1[three + 1], 14) + h1[three + 2]
        key = mixed(h3, 15) ^ (doc[three].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        _, first = np.unique(key, return_index=True)
        fresh = np.bincount(doc[three[first]], minlength=len(texts))
        total = np.bincount(doc[three], minlength=len(texts))
        some = np.flatnonzero(total)
        seen = 1 - fresh[some] / total[some]
        d, f, v = np.r_[d, some], np.r_[f, bucket(np.floor(seen * 10).astype(np.uint64), 5)], np.r_[v, np.ones(len(some))]
    return d, f, v


def letter_runs(texts: list[str | None], prefixes: tuple[int, ...] = (4, 5, 6, 8)) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the words of each text, as runs of letters with A-Z in lower case, and of their first bytes; with repeats."""
    raw, starts_of = joined(texts)
    lower = np.frombuffer(raw.tobytes().lower(), np.uint8)
    a, b = runs(((lower >= 97) & (lower <= 122)) | (lower >= 128))
    doc = np.searchsorted(starts_of, a, side="right") - 1
    hashed = Hashed(lower)
    d, f = [doc], [bucket(hashed.of(a, b), 6)]
    for k in prefixes:
        long = np.flatnonzero(b - a >= k)
        d.append(doc[long])
        f.append(bucket(hashed.of(a[long], a[long] + k), 10 + k))
    return np.concatenate(d), np.concatenate(f)
