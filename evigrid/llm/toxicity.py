"""Toxicity by a factorization machine over hashed terms (operator 3).

A document is the set of its hashed terms: lower-case words (even ids) and the
first four and five bytes of longer words (odd ids), so that unseen endings of a
known stem count.  The score is ``sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>)`` over
the terms that the model kept; the pair part is where an insult next to a group
mention weighs more than both alone.

A term is a candidate if the toxic documents hold it at least ``SURPRISE``
standard deviations more or less often than their share, or if two words together
are toxic (or clean) beyond what each of them tells, by a likelihood ratio that chance
reaches in any of the counted pairs with at most about ``PAIR_CHANCE``; so words that are neutral alone are learned, too.  Linear weights
follow FTRL-proximal steps, whose L1 part leaves only terms that carry signal;
factors are learned for all candidates, whatever their linear weights.

Training takes a bounded sample, the documented parameters: labels of at most
``MAX_ROWS`` documents in the order of a hash of the key, as far as their terms are at
most ``MAX_TERMS``; pairs are counted among words of at least ``WORD_LEAST`` documents,
in documents of at most ``PAIR_WORDS`` such words.  The order is total, so the sample does not depend on partitions.  Scoring reads
every whole text once, in place, without a shuffle.

Results for odd input: null and empty texts get the score of the bias alone; very
long texts are scored whole; without labelled rows the score is 0.25 everywhere; null
labels are left out and of several labels of one document the highest counts; repeated
documents train each; a score of exactly 0.5 is toxic; an empty table gives no rows;
columns named like the result are replaced, others carried.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from evigrid.session import ship

MAX_ROWS, MAX_TERMS, BITS, FACTORS, EPOCHS, SEED = 12_000, 6_000_000, 20, 8, 12, 7
SURPRISE, PAIR_CHANCE, PAIR_LEAST, PAIR_WORDS, WORD_LEAST, FIRST_EVIDENCE = 4.5, 0.01, 5, 200, 20, 8.0
#: ASCII signs part words, all other bytes belong to them.
PARTS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> set[bytes]:
    return set(text.lower().encode().translate(PARTS).split()) if text else set()


def term_ids(word: bytes) -> tuple[int, ...]:
    mask = (1 << BITS) - 1
    ids = [xxhash.xxh3_64_intdigest(word) & mask & ~1]
    for n in (4, 5):
        if len(word) > n:
            ids.append(xxhash.xxh3_64_intdigest(word[:n] + b"*") & mask | 1)
    return tuple(ids)


def held_out(key: str = "doc_id") -> Column:
    """Rows that no label is learned from."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Machine:
    """Weights of the kept terms; small, since L1 keeps few of them."""

    def __init__(self, bias: float, ids: np.ndarray, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v
        self.at = {int(i): k for k, i in enumerate(ids)}

    def score(self, kept: list[int]) -> float:
        z = self.bias
        if kept:
            v = self.v[kept]
            total = v.sum(0)
            z += float(self.w[kept].sum() + 0.5 * (total @ total - (v * v).sum()))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _codes(terms: np.ndarray, of: int) -> np.ndarray:
    """A number for each pair of different terms of one document."""
    i, j = np.triu_indices(len(terms), 1)
    return terms[i].astype(np.int64) * of + terms[j]


def pair_terms(rows: list[np.ndarray], y: np.ndarray, seen: np.ndarray, pos_seen: np.ndarray) -> np.ndarray:
    """Terms of pairs whose joint share of toxic documents their single shares do not explain.

    rows: sorted term numbers of each document.  Pairs frequent among toxic documents, or
    among as many clean ones, are then counted in all documents.
    """
    out, of, n, pos = np.zeros(len(seen), bool), len(seen), len(y), int(y.sum())
    toxic, clean = np.flatnonzero(y > 0), np.flatnonzero(y == 0)
    share = pos / n
    logit = lambda p: np.log(p / (1 - p))
    single = logit((pos_seen + 10 * share) / (seen + 10)) - logit(share)  # what a word tells alone

    def evidence(codes, k, both, base):
        """Twice the log likelihood ratio of k toxic documents out of both, against what the two words tell."""
        e = both / (1 + np.exp(-(single[codes // of] + single[codes % of] + logit(base))))
        part = lambda k, e: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(e, 1e-9)), 0.0)
        return 2 * (part(k, e) + part(both - k, both - e))

    slot = lambda c: ((c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int32)

    def counted(docs):
        """Pairs in PAIR_LEAST or more of the documents: slots of hashes leave out the rest before pairs are held."""
        slots = np.zeros(1 << 24, np.uint16)
        for d in docs:
            np.add.at(slots, slot(_codes(rows[d], of)), np.uint16(1))
        parts = [np.empty(0, np.int64)]
        for d in docs:
            c = _codes(rows[d], of)
            parts.append(c[slots[slot(c)] >= PAIR_LEAST])
        codes, n = np.unique(np.concatenate(parts), return_counts=True)
        return codes[n >= PAIR_LEAST], n[n >= PAIR_LEAST]

    # pairs that stand out between the toxic documents and as many clean ones
    few = min(len(toxic), len(clean))
    (t_codes, t), (c_codes, c) = counted(toxic[:few]), counted(clean[:few])
    codes = np.union1d(t_codes, c_codes)
    tested = max(len(codes), 1)

    def of_codes(known, count):
        at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
        return np.where(known[at] == codes, count[at], 0.0) if len(known) else np.zeros(len(codes))

    t, c = of_codes(t_codes, t), of_codes(c_codes, c)
    codes = codes[evidence(codes, t, t + c, 0.5) >= FIRST_EVIDENCE]
    if not len(codes):
        return out
    # those are counted in all documents
    named = np.zeros(of, bool)
    named[codes // of] = named[codes % of] = True
    perhaps = np.zeros(1 << 24, bool)
    perhaps[slot(codes)] = True
    both, both_pos = np.zeros(len(codes)), np.zeros(len(codes))
    for d, row in enumerate(rows):
        c = _codes(row[named[row]], of)
        c = c[perhaps[slot(c)]]
        at = np.searchsorted(codes, c)
        at = at[codes[np.minimum(at, len(codes) - 1)] == c]
        both[at] += 1
        both_pos[at] += y[d]
    strong = codes[evidence(codes, both_pos, both, share) >= 2 * math.log(tested / PAIR_CHANCE)]
    out[strong // of] = out[strong % of] = True
    return out


def fit(labels: list[int], terms: list[np.ndarray]) -> Machine:
    """Mini-batch training on a bounded sample."""
    y = np.asarray(labels, float)
    n, pos = len(y), float(sum(labels))
    bias = math.log((pos + 0.5) / (n - pos + 1.5))
    empty = Machine(bias, np.empty(0, int), np.empty(0), np.empty((0, FACTORS)))
    if not n or not pos or pos == n:
        return empty
    size = np.array([len(t) for t in terms])
    flat = np.concatenate(terms)
    row = np.repeat(np.arange(n, dtype=np.int32), size)
    seen = np.bincount(flat, minlength=1 << BITS)
    ids = np.flatnonzero(seen)
    renumber = np.zeros(1 << BITS, np.int32)
    renumber[ids] = np.arange(len(ids))
    where, seen = renumber[flat], seen[ids]
    del flat
    pos_seen, share = np.bincount(where, y[row], len(ids)), pos / n
    expected = seen * share
    surprise = (pos_seen - expected) / np.sqrt(np.maximum(expected * (1 - share), 0.25))
    known = np.flatnonzero((seen >= WORD_LEAST) & (ids % 2 == 0))  # whole words
    number = np.full(len(ids), -1, np.int32)
    number[known] = np.arange(len(known))
    ends = np.cumsum(size)
    rows = [number[where[e - k : e]] for k, e in zip(size, ends)]
    rows = [r for r in (np.sort(r[r >= 0]) for r in rows)]
    rows = [r if len(r) <= PAIR_WORDS else r[:0] for r in rows]
    paired = np.zeros(len(ids), bool)
    paired[known] = pair_terms(rows, y, seen[known].astype(float), pos_seen[known])
    often = (seen >= 3) & (np.abs(surprise) >= SURPRISE) | paired
    if not often.any():
        return empty
    renumber = np.cumsum(often) - 1
    keep = often[where]
    col, row, ids, paired = renumber[where[keep]], row[keep], ids[often], paired[often]
    start = np.searchsorted(row, np.arange(n + 1))
    rng, d = np.random.default_rng(SEED), len(ids)
    weight = np.where(y > 0, max(1.0, min(10.0, math.sqrt((n - pos) / pos))), 1.0)
    z, sq, w = np.zeros(d), np.zeros(d), np.zeros(d)
    v, vsq = rng.normal(0, 0.05, (d, FACTORS)), np.ones((d, FACTORS))
    bsq, rate, l1, l2 = 1.0, 0.3, 0.3, 0.1
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for lo in range(0, n, 16):
            batch = order[lo : lo + 16]
            cols = [col[start[i] : start[i + 1]] for i in batch]
            at = np.concatenate(cols)
            part = np.repeat(np.arange(len(batch)), [len(c) for c in cols])
            total = np.zeros((len(batch), FACTORS))
            np.add.at(total, part, v[at])
            squares = np.bincount(part, (v[at] ** 2).sum(1), len(batch))
            logit = bias + np.bincount(part, w[at], len(batch)) + 0.5 * ((total**2).sum(1) - squares)
            g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[batch]) * weight[batch]
            grad = np.bincount(at, g[part], d) if d < 4 * len(at) else None
            if grad is None:
                u, inv = np.unique(at, return_inverse=True)
                gu = np.bincount(inv, g[part], len(u))
            else:
                u = np.flatnonzero(grad)
                gu = grad[u]
            new = sq[u] + gu * gu
            z[u] += gu - (np.sqrt(new) - np.sqrt(sq[u])) / rate * w[u]
            sq[u] = new
            if len(at):
                gv = g[part][:, None] * (total[part] - v[at]) + 1e-3 * v[at]
                np.add.at(vsq, at, gv * gv)
                np.add.at(v, at, -0.1 * gv / np.sqrt(vsq[at]))
            w[u] = np.where(np.abs(z[u]) <= l1, 0.0, -(z[u] - np.sign(z[u]) * l1) / ((1 + np.sqrt(sq[u])) / rate + l2))
            bsq += float(g.sum()) ** 2
            bias -= 0.1 * float(g.sum()) / math.sqrt(bsq)
    kept = (w != 0) | paired | ((v**2).sum(1) > 0.25)
    return Machine(bias, ids[kept], w[kept], v[kept])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    """A machine from the labels outside the held-out fifth."""
    ship(docs.sparkSession)
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
        .groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label).cast("int")).alias("_y"))
        .orderBy(F.xxhash64("_key"), "_key").limit(MAX_ROWS)
    )
    sample = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")  # at most MAX_ROWS ids

    def run(batches):
        for b in batches:
            ids = [np.unique(np.fromiter(chain.from_iterable(map(term_ids, words(t))), np.int32)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ids, pa.binary())], names=["y", "place", "ids"])

    y, terms, total = [], [], 0
    found = sample.select("_y", "_text", F.xxhash64("_key").alias("_place")).mapInArrow(run, "y int, place long, ids binary")
    for r in found.orderBy("place", "ids").toLocalIterator():
        total += len(r["ids"]) // 4
        if total > MAX_TERMS:
            break
        y.append(r["y"])
        terms.append(np.frombuffer(bytes(r["ids"]), np.int32))
    return fit(y, terms)


def score(docs: DataFrame, machine: Machine, text: str = "text", into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of ``docs`` with score and verdict added under the names ``into`` (replacing columns of these names)."""
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (*into, text)]
    schema = docs.select(text, *rest).schema.add(into[0], "double").add(into[1], "integer")

    def run(batches):
        at, known = machine.at, {}
        for b in batches:
            scores = []
            for t in b.column(0):
                kept: set[int] = set()
                for x in words(t.as_py()):
                    ids = known.get(x)
                    if ids is None:
                        if len(known) > 100_000:
                            known.clear()
                        ids = known[x] = tuple(at[i] for i in term_ids(x) if i in at)
                    kept.update(ids)
                scores.append(machine.score(sorted(kept)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=schema.names)

    return docs.select(text, *rest).mapInArrow(run, schema)
