"""Texts cut into pieces that a byte-level tokenizer treats independently.

A byte-level pre-tokenizer never joins characters over a blank between two
characters that are not white space, so a text can be cut there and equal pieces
encoded once.  A piece that begins with white space (or an empty one, between two
blanks) may belong to a longer run of white space; then the whole text is one piece.
"""

from __future__ import annotations

import re

import numpy as np

#: Characters of text that a task encodes at once, so that equal pieces among them are looked up once.
BUFFER = 4 << 20
#: A blank before white space or at the end: the text is not cut.
UNCUT = re.compile(r" (?=\s|\Z)")
_SPREAD = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


class PieceTable(dict):
    """piece -> encoded value of the piece with a blank before it.

    ``encode`` maps a text to its value.  At most twice ``bound`` pieces are held: a
    full table becomes the old one, from which pieces in use move over, and what
    was in the old one before is let go.  ``special``: strings of special tokens.
    """

    def __init__(self, encode, special: tuple[str, ...], bound: int):
        self.encode, self.bound, self.old, self.marks = encode, bound, {}, tuple(s.encode() for s in special)
        self.special = tuple(s for s in special if s.strip() != s or len(s.split()) != 1)

    def __missing__(self, piece: str):
        if len(self) > self.bound:
            self.old = dict(self)
            self.clear()
        value = self.old.get(piece)
        if value is None and piece and not piece[0].isspace():
            value = self.encode(" " + piece)
        self[piece] = value
        return value

    def entries(self, text: str) -> list:
        """Values whose concatenation is the value of the text."""
        if not text:
            return []
        first, *rest = text.split(" ")
        found = list(map(self.__getitem__, rest))
        if None in found or (rest and first and first[-1].isspace() and rest[0][:1].isspace()) or any(s in text for s in self.special):
            return [self.encode(text)]
        return [self.encode(first), *found] if first else found


def buffered(batches, column: int = 0):
    """Lists of record batches with about BUFFER bytes in one text column each."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= BUFFER:
            yield held
            held, size = [], 0
    if held:
        yield held


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps)


def _piece_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each piece; pieces follow each other with one byte between them."""
    out, up, down = np.empty(len(start), np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(start, start[at] + step)))
        lo, hi = int(start[at]), int(end[stop - 1])
        if hi - lo > len(up):
            up, down = _powers(_BASE, hi - lo), _powers(pow(_BASE, -1, 1 << 64), hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_SPREAD[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = start[at:stop] - lo, end[at:stop] - lo
        out[at:stop] = (sums[e] - sums[s]) * down[s] ^ (e - s).astype(np.uint64)
        at = stop
    return out


def _all_equal(data: np.ndarray, start: np.ndarray, end: np.ndarray, like: np.ndarray, step: int = 1 << 17) -> bool:
    """Whether each piece has the bytes of the piece at ``like``, compared some pieces at a time."""
    size = end - start
    if (size != size[like]).any():
        return False
    for lo in range(0, len(start), step):
        n, s, o = size[lo : lo + step], start[lo : lo + step], start[like[lo : lo + step]]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if (data[np.repeat(s, n) + inside] != data[np.repeat(o, n) + inside]).any():
            return False
    return True


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = True
_SIGN[48:58], _SIGN[_LETTER] = False, False


def inner_cuts(data: np.ndarray) -> np.ndarray:
    """Places inside pieces where one pre-token ends for certain: behind a letter before a sign, and around a line end that
    stands alone between a letter or sign and a letter (all of them ASCII)."""
    letter, sign = _LETTER[data], _SIGN[data]
    at = np.flatnonzero(letter[:-1] & sign[1:]) + 1
    line = np.flatnonzero(data == 10)
    line = line[(line > 0) & (line < len(data) - 1)]
    line = line[(letter | sign)[line - 1] & letter[line + 1]]
    return np.sort(np.concatenate([at, line, line + 1]))


def _gathered(found: list[bytes], inverse: np.ndarray, stop: np.ndarray, step: int = 1 << 17) -> list[bytes]:
    """The values at inverse[: stop[0]], inverse[stop[0] : stop[1]], ... each joined, some pieces at a time."""
    size = np.fromiter(map(len, found), np.int64, len(found))
    unit = next(n for n in (4, 2, 1) if not (size % n).any())
    data, size = np.frombuffer(b"".join(found), np.dtype(f"u{unit}")), size // unit
    begin, parts = np.cumsum(size) - size, []
    for lo in range(0, len(inverse), step):
        own = inverse[lo : lo + step]
        n = size[own]
        behind = np.cumsum(n)
        parts.append(data[np.repeat(begin[own] - behind + n, n) + np.arange(int(behind[-1]))])
    whole, cut = np.concatenate(parts), [0, *np.cumsum(size[inverse])[stop - 1].tolist()]
    return [whole[a:b].tobytes() for a, b in zip(cut, cut[1:])]


def values(texts: list[str | None], table: PieceTable, inner: bool = False) -> list[bytes]:
    """The value of each text, where a table's values are bytes; equal pieces of all these texts are looked up once.

    Pieces are told apart by a hash and then compared byte by byte, so the result never depends on the hash.
    With ``inner`` words are cut from signs and line ends too, unless a special token stands in these texts.
    """
    out: list = [b""] * len(texts)
    cut = []
    for i, t in enumerate(texts):
        if t and (UNCUT.search(t) or any(s in t for s in table.special)):
            out[i] = table.encode(t)
        elif t:
            cut.append(i)
    if not cut:
        return out
    joined = " ".join([texts[i] for i in cut]).encode()
    data = np.frombuffer(joined, np.uint8)
    blanks = np.flatnonzero(data == 32)
    start, end = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(data)]])
    stop = np.cumsum([texts[i].count(" ") + 1 for i in cut])
    cuts = inner_cuts(data) if inner and not any(s in joined for s in table.marks) else np.empty(0, np.int64)
    stop = stop + np.searchsorted(cuts, end[stop - 1])
    start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
    first = np.zeros(len(start), bool)
    first[np.concatenate([[0], stop[:-1]])] = True  # has no blank before it
    first[np.searchsorted(start, cuts)] = True
    h = _piece_hashes(data, start, end)
    h[first] ^= np.uint64(_BASE)
    _, like, inverse = np.unique(h, return_index=True, return_inverse=True)
    if (first != first[like[inverse]]).any() or not _all_equal(data, start, end, like[inverse]):
        for i in cut:
            out[i] = b"".join(table.entries(texts[i]))
        return out
    pieces = [joined[s:e].decode() for s, e in zip(start[like].tolist(), end[like].tolist())]
    found = [(table.encode(p) if p else b"") if f else table[p] for p, f in zip(pieces, first[like].tolist())]
    for i, value in zip(cut, _gathered(found, inverse, stop)):
        out[i] = value
    return out
