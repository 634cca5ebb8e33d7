"""Byte-pair encoding as a deterministic automaton over tokens (operator 7).

The automaton is the one that successive merge gadgets build.  It starts as one
state with a loop for every byte.  The gadget of merge ``u v -> w`` (in rank
order) does three things:

1. the state entered by ``w`` is a copy of the state entered by ``v``;
2. the arc ``v`` is cut from the state entered by ``u``;
3. every state with an arc ``u`` gets an arc ``w``.

States are only ever entered by one token, so a state is named by its token.
The finished table has |vocabulary|^2 cells; it is kept in factored form, as the
list of gadgets (what was copied, from where, when, and what was cut); a cell is
unfolded when a word first needs it, then remembered.  The paths of the automaton
are exactly the tokenizations that the merges produce, so a word has one accepting
path, and so has each of its beginnings.  A second table leads from byte to byte to
the labels that end behind a byte.  Encoding is one pass over a word's bytes by look-ups
in both, without a way back: of the labels that end at a byte exactly one has an arc from the state
in which it begins.  Decoding writes out the labels' bytes.

Results for odd input: null and empty text give no tokens; the text of a special
token gives that token; very long words cost time linear in their length.
"""

from __future__ import annotations

import gc
import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from evigrid.llm.chunks import PieceTable, buffered, values
from evigrid.session import ship

#: White space as the byte-level pre-tokenizer counts it.
WHITE = r"\t-\r \x85\xa0  -     　"
#: Contractions, letters, digits, other signs and white space, one leading blank allowed.
WORDS = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)


def printable_bytes() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class MergeAutomaton:
    """The compiled merges of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = printable_bytes()
        spell = lambda s: bytes(to_byte[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.label = [b""] * size
        self.left, self.right, self.born = [-1] * size, [-1] * size, [-1] * size
        for s, i in vocab.items():
            self.label[i] = spell(s)
        self.token = {self.label[i]: i for i in vocab.values()}
        for s, i in self.special.items():
            self.label[i] = s.encode()
        self.cut: dict[int, int] = {}
        self.size = size
        for rank, pair in enumerate(spec["model"]["merges"]):
            self._gadget(rank, *(vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair)), vocab)
        self.arcs: dict[int, bool] = {}
        self.own: dict[int, bool] = {}
        self._byte_table()
        self._split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def _gadget(self, rank: int, u: int, v: int, vocab: dict) -> None:
        w = self.token[self.label[u] + self.label[v]]
        self.left[w], self.right[w], self.born[w] = u, v, rank
        self.cut[u * self.size + v] = rank

    def arc(self, state: int, token: int) -> bool:
        """Whether the finished automaton has an arc ``token`` from ``state``."""
        key = state * self.size + token
        known = self.arcs.get(key)
        if known is None:
            known = self.arcs[key] = self._unfold(state, token)
            if len(self.arcs) > 400_000:
                self.arcs.clear()
        return known

    def _unfold(self, s: int, t: int) -> bool:
        cut, born, size, before = self.cut, self.born, self.size, len(self.cut) + 1
        while True:
            when = cut.get(s * size + t)
            if when is not None and when < before:
                return False
            if born[s] < 0 and born[t] < 0:
                return True
            if born[s] > born[t]:  # the state was copied, before the cut of its own gadget
                before = born[s]
                s = self.right[s]
            else:  # the arc was copied, after that cut
                before = born[t] + 1
                t = self.left[t]

    def _byte_table(self) -> None:
        """The byte side of the table: from each place in the labels the next place per byte, and the labels that end there."""
        self.step: dict[int, int] = {}
        places, own = 1, {}
        for label, t in self.token.items():
            if not self._reaches(t):
                continue
            at = 0
            for byte in label:
                key = at << 8 | byte
                if key not in self.step:
                    self.step[key] = places
                    places += 1
                at = self.step[key]
            own[at] = (t, len(label))
        self.shorter = [0] * places  # the place of the longest proper suffix
        self.ends: list[tuple] = [()] * places
        into = [0] * places
        for key, at in self.step.items():
            into[at] = key
        for at in self._by_depth(into, places):
            before, byte = into[at] >> 8, into[at] & 255
            self.shorter[at] = self._next(self.shorter[before], byte) if before else 0
            self.ends[at] = ((own[at],) if at in own else ()) + self.ends[self.shorter[at]]

    @staticmethod
    def _by_depth(into: list[int], places: int) -> list[int]:
        depth = [0] * places
        for at in range(1, places):  # a place is made after the one before it
            depth[at] = depth[into[at] >> 8] + 1
        return sorted(range(1, places), key=depth.__getitem__)

    def _next(self, at: int, byte: int) -> int:
        known = self.step.get(at << 8 | byte)
        if known is None:
            known = self._next(self.shorter[at], byte) if at else 0
            self.step[at << 8 | byte] = known
        return known

    def path(self, word: bytes) -> tuple[int, ...]:
        """Tokens of one pre-split word: the labels on its only accepting path.

        One pass of look-ups: a byte leads to the labels that end behind it, and of these
        exactly one has an arc from the state in which it would begin.
        """
        whole = self.token.get(word)
        if whole is not None and self._reaches(whole):
            return (whole,)
        step, ends, arcs, size, at = self.step, self.ends, self.arcs, self.size, 0
        states = [-1]
        for place, byte in enumerate(word, 1):
            known = step.get(at << 8 | byte)
            at = self._next(at, byte) if known is None else known
            for t, n in ends[at]:
                before = states[place - n]
                if before < 0:
                    break
                passes = arcs.get(before * size + t)
                if self.arc(before, t) if passes is None else passes:
                    break
            states.append(t)
        out, place = [], len(word)
        while place:
            out.append(states[place])
            place -= len(self.label[states[place]])
        return tuple(out[::-1])

    def _reaches(self, w: int) -> bool:
        """A token stands for its own bytes unless its parts could not meet."""
        known = self.own.get(w)
        if known is None:
            known = self.own[w] = self._made(w)
        return known

    def _made(self, w: int) -> bool:
        u, v = self.left[w], self.right[w]
        if u < 0:
            return self.born[w] < 0 and len(self.label[w]) == 1
        # the two parts must still be next to each other when the gadget runs
        s, t, before = u, v, self.born[w]
        cut, born, size = self.cut, self.born, self.size
        while True:
            when = cut.get(s * size + t)
            if when is not None and when < before:
                return False
            if born[s] < 0 and born[t] < 0:
                return self._reaches(u) and self._reaches(v) if (born[u] >= 0 or born[v] >= 0) else True
            if born[s] > born[t]:
                before, s = born[s], self.right[s]
            else:
                before, t = born[t] + 1, self.left[t]

    def tokens(self, text: str) -> tuple[int, ...]:
        """Whole text: special tokens first, then pre-split words; letters after a blank are one word."""
        if text[:1] == " " and text[1:].isalpha() and text.isascii():
            return self.path(text.encode())
        if self._split is None or not any(s in text for s in self.special):
            return tuple(chain.from_iterable([self.path(w.encode()) for w in WORDS.findall(text)]))
        out: list[int] = []
        for p in self._split.split(text):
            out.extend((self.special[p],) if p in self.special else self.tokens(p) if p else ())
        return tuple(out)

    def decode(self, ids) -> str:
        """Emit the arc labels; broken UTF-8 becomes replacement characters."""
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


IDS = np.dtype("<i4")
_loaded: dict[str, tuple] = {}


def automaton(path: str) -> tuple[MergeAutomaton, PieceTable]:
    """The automaton of a file and a bounded table of pieces already encoded, one per worker."""
    if path not in _loaded:
        a = MergeAutomaton(path)
        _loaded[path] = (a, PieceTable(lambda text: np.array(a.tokens(text), IDS).tobytes(), tuple(a.special), 150_000))
        gc.freeze()  # what is loaded here stays, so the collector need not walk it again
    return _loaded[path]


def encode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``ids`` and ``n_tokens`` added (replacing columns of these names)."""
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("ids", "n_tokens", text)]
    schema = docs.select(text, *rest).schema.add("ids", ArrayType(IntegerType())).add("n_tokens", "long")

    def run(batches):
        a, table = automaton(tokenizer)
        for b in batches:
            ids = [np.frombuffer(x, IDS) for x in values(b.column(0).to_pylist(), table)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(len, ids)), pa.int64())], names=schema.names)

    return docs.select(text, *rest).mapInArrow(run, schema)


def decode(docs: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` with ``decoded`` added; null ids decode to an empty text."""
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("decoded", ids)]
    schema = docs.select(ids, *rest).schema.add("decoded", "string")

    def run(batches):
        a, _ = automaton(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([a.decode(x or ()) for x in b.column(0).to_pylist()], pa.string())], names=schema.names)

    return docs.select(ids, *rest).mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), ids: str | None = None) -> DataFrame:
    """Encode and decode every text in one pass: key, columns ``keep``, counts and digests.

    ``ids`` names a column for the token ids themselves.  Rows are independent: there
    is no shuffle, and a lost task is run again alone.
    """
    ship(docs.sparkSession)
    keep = [c for c in keep if c in docs.columns]
    schema = docs.select(key, *keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if ids:
        schema = schema.add(ids, ArrayType(IntegerType()))

    def run(batches):
        a, pieces = automaton(tokenizer)
        sha, label = hashlib.sha256, a.label.__getitem__
        spelt = np.array([b"%d," % i for i in range(a.size)])  # decimal ids, filled up with zero bytes
        for held in buffered(batches):
            found = iter(values([t for b in held for t in b.column(0).to_pylist()], pieces))
            for b in held:
                n, digest, decoded, arrays = [], [], [], []
                for own in (np.frombuffer(next(found), IDS) for _ in range(b.num_rows)):
                    n.append(len(own))
                    digest.append(sha(spelt[own].tobytes().replace(b"\0", b"")[:-1]).hexdigest())
                    decoded.append(sha(b"".join(map(label, own.tolist())).decode("utf-8", "replace").encode()).hexdigest())
                    if ids:
                        arrays.append(own)
                made = [pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([*b.columns[1:], *made, *([pa.array(arrays, pa.list_(pa.int32()))] if ids else [])], names=schema.names)

    return docs.select(F.col(text), F.col(key), *keep).mapInArrow(run, schema)
