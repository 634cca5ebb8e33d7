"""Double-array tries over byte strings, built level by level, and matched at many text positions at once."""

from __future__ import annotations

import numpy as np

#: The byte behind a whole key; keys do not hold it.
END = 10
#: Nodes with more children get 256 places of their own.
WIDE = 48


def _edges(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(parent, byte, child, key or -1) of all edges of sorted distinct keys, parents together; node 0 is the root."""
    node, nodes, out = np.zeros(len(start), np.int64), 1, []
    active, depth = np.arange(len(start)), 0
    while len(active):
        ended = size[active] == depth
        done = active[ended]
        out.append((node[done], np.full(len(done), END, np.int64), np.arange(nodes, nodes + len(done)), done))
        nodes += len(done)
        active = active[~ended]
        if not len(active):
            break
        code = node[active] << 8 | data[start[active] + depth]
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        node[active] = nodes + np.cumsum(new) - 1
        code = code[new]
        out.append((code >> 8, code & 255, np.arange(nodes, nodes + len(code)), np.full(len(code), -1, np.int64)))
        nodes += len(code)
        depth += 1
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none, none
    parent, byte, child, key = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(parent, kind="stable")
    return parent[order], byte[order], child[order], key[order]


class DoubleArray:
    """base and check: state s goes by byte c to t = base[s] + c where check[t] == s; a key's end holds its number as base."""

    def __init__(self, base: np.ndarray, check: np.ndarray, keys: int):
        self.base, self.check, self.keys = base, check, keys

    @classmethod
    def of(cls, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> DoubleArray:
        """data[start:start+size] are the keys, sorted and distinct."""
        parent, byte, child, key = _edges(data, start, size)
        inner, first, n = np.unique(parent, return_index=True, return_counts=True)
        base = _placed(byte, first, n)
        place = np.empty(len(parent) + 1, np.int64)  # of nodes; the root stands at 0
        place[0] = 0
        at = np.repeat(base, n) + byte
        place[child] = at
        length = int(at.max(initial=0)) + 257
        bases, check = np.zeros(length, np.int32), np.full(length, -1, np.int32)
        check[at] = np.repeat(place[inner], n)
        bases[place[inner]] = base
        bases[at[key >= 0]] = key[key >= 0]
        return cls(bases, check, len(start))

    def matches(self, text: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the keys that begin at the places ``at`` and end where ``ends[text byte behind]`` holds, one by one.

        All places advance together, a byte a step; text must end with a byte that no key holds.
        """
        base, check, state, found = self.base, self.check, np.zeros(len(at), np.int32), []
        while len(at):
            c = text[at]
            over = ends[c]
            if over.any():
                s = state[over]
                t = base[s] + END
                hit = check[t] == s
                if hit.any():
                    found.append(base[t[hit]])
            t = base[state] + c
            go = np.flatnonzero((check[t] == state) & (c != END))
            state, at = t[go], at[go] + 1
        return np.concatenate(found) if found else np.empty(0, np.int32)


def _placed(byte: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A base for each node so that no two children share a place; children of node i are byte[first[i]:first[i]+n[i]]."""
    rng, base = np.random.default_rng(7), np.zeros(len(n), np.int64)
    wide = np.flatnonzero(n > WIDE)
    base[wide] = 256 + 256 * np.arange(len(wide))
    size = 512 + 256 * len(wide) + int(1.1 * n.sum())
    used = np.zeros(size, bool)
    used[np.repeat(base[wide], n[wide]) + byte[_spans(first[wide], n[wide])]] = True
    for lo, hi in ((17, WIDE), (9, 16), (5, 8), (3, 4), (2, 2)):
        left = np.flatnonzero((n >= lo) & (n <= hi))
        while len(left):
            k = n[left]
            own = byte[_spans(first[left], k)]
            tried = rng.integers(256, size - 256, len(left))
            at = np.repeat(tried, k) + own
            bad = used[at]
            order = np.argsort(at, kind="stable")
            twice = at[order][1:] == at[order][:-1]
            bad[order[1:][twice]] = True
            good = ~np.logical_or.reduceat(bad, np.cumsum(k) - k)
            base[left[good]] = tried[good]
            used[at[np.repeat(good, k)]] = True
            if good.mean() < 0.03:
                used = np.concatenate([used, np.zeros(size // 5, bool)])
                size = len(used)
            left = left[~good]
    one = np.flatnonzero(n == 1)
    free = np.flatnonzero(~used[512:]) + 512
    if len(free) < len(one):
        free = np.concatenate([free, size + np.arange(len(one) - len(free))])
    base[one] = free[: len(one)] - byte[first[one]]
    return base


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
