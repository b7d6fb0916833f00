"""Content-defined anchors: equal strings of WIDTH bytes choose the same anchor, so they can be found by grouping anchors."""

from __future__ import annotations

import numpy as np

from .features import Hashed, mixed

#: Bytes of an anchor, and of a text that is anchored at once (longer ones in pieces that overlap).
GRAM, PIECE = 32, 1 << 22
_POS_BITS = 23


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row, from running minima of blocks of w, forwards and backwards."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def regions(raw: bytes, width: int) -> list[tuple[int, int, int, int]]:
    """(anchor hash, first start, last start, anchor's place) of stretches of window starts that share their anchor.

    The anchor of a window of `width` bytes is the leftmost of its byte strings of length GRAM with the least hash: equal windows,
    wherever they are, have equal anchors at equal distances from their starts.
    """
    out: list[tuple[int, int, int, int]] = []
    gram = min(GRAM, width)
    for base in range(0, max(1, len(raw) - width + 1), PIECE):
        part = np.frombuffer(raw, np.uint8)[base : base + PIECE + width - 1]
        if len(part) < width:
            break
        at = np.arange(len(part) - gram + 1)
        h = mixed(Hashed(part).of(at, at + gram), 31)
        key = (h >> np.uint64(_POS_BITS)) << np.uint64(_POS_BITS) | at.astype(np.uint64)
        anchor = (_sliding_min(key, width - gram + 1) & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        last = np.r_[first[1:] - 1, len(anchor) - 1]
        place = anchor[first]
        out += zip(h[place].view(np.int64).tolist(), (first + base).tolist(), (last + base).tolist(), (place + base).tolist(), strict=True)
    return out
