"""Best partial match of a short text in a long one, by longest common subsequences of all windows at once."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_OTHER = re.compile(r"[^\w]|_", re.UNICODE)
#: Windows of the long text that are looked at together.
TOGETHER = 1 << 15


def plain(text: str | None) -> str:
    """Lower case, one blank for each sign that is no letter or digit, trimmed."""
    return _OTHER.sub(" ", text or "").lower().strip()


def common_lengths(short: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``short`` with each column of ``windows`` (characters by windows).

    Bit-parallel: a window's state is one bit for each character of ``short``, in words of 64 bits; all windows
    take their next character together.
    """
    words = -(-len(short) // 64)
    letters, code = np.unique(short, return_inverse=True)
    masks = np.zeros((len(letters) + 1, words), np.uint64)
    for i, c in enumerate(code):
        masks[c, i >> 6] |= np.uint64(1 << (i & 63))
    place = np.minimum(np.searchsorted(letters, windows), len(letters) - 1)
    place = np.where(letters[place] == windows, place, len(letters))
    state = np.full((words, windows.shape[1]), ~np.uint64(0))
    for row in place:
        carry = np.zeros(windows.shape[1], np.uint64)
        mask = masks[row]
        for w in range(words):
            v, hit = state[w], state[w] & mask[:, w]
            total = v + hit
            over = total < v
            total2 = total + carry
            carry = (over | (total2 < total)).astype(np.uint64)
            state[w] = total2 | (v - hit)
    used = np.full(words, ~np.uint64(0))
    if len(short) & 63:
        used[-1] = np.uint64((1 << (len(short) & 63)) - 1)
    return np.bitwise_count(~state & used[:, None]).sum(0).astype(np.int64)


def partial_ratio(a: str, b: str) -> float:
    """100 times the best ratio of the shorter text with a window of the longer one of at most its length.

    The ratio of two texts is twice their longest common subsequence over their lengths together.  Windows
    that hang over an end of the longer text count with what is inside.  Two empty texts match whole, an
    empty one matches no other.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    short, text = (np.frombuffer(x.encode("utf-32-le"), np.uint32).astype(np.int64) for x in (a, b))
    m = len(short)
    edge = np.full(m - 1, -1)
    padded = np.concatenate([edge, text, edge])
    starts = len(padded) - m + 1
    best = 0.0
    for lo in range(0, starts, TOGETHER):
        at = np.arange(lo, min(lo + TOGETHER, starts))
        inside = np.minimum(at + m, len(text) + m - 1) - np.maximum(at, m - 1)
        common = common_lengths(short, padded[np.arange(m)[:, None] + at])
        best = max(best, float((200.0 * common / (m + inside)).max()))
    return best


@F.pandas_udf(DoubleType())
def best_match(window: pd.Series, content: pd.Series) -> pd.Series:
    """``partial_ratio`` of both texts in plain form; an empty window scores 0."""
    return pd.Series([partial_ratio(x, y) if (x := plain(w)) and (y := plain(c)) else 0.0 for w, c in zip(window, content)], dtype="float64")
