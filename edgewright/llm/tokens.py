"""Encode texts with a public byte-level BPE vocabulary.

Method: tokenization automaton.  A state is the token read last; an arc leads to token s exactly if s
may follow it in a finished encoding.  Each merge (x, y) -> z adds one gadget to the automaton: it
takes away the arcs from tokens t to tokens s where, at the time z is due, t still ends in an open x
and s still begins with an open y.  x is open from its own rank until the rank of the token it was
merged into on t's right edge; y likewise on s's left edge, where an equal rank counts as open, since
the leftmost of equal pairs merges first.  So an arc is decided by the gadgets of the two edges alone;
decisions are kept in a transition table as they are met, instead of spelling out the 50,000 squared
arcs.

Encoding reads a pre-split word from left to right: for each position there is just one token that can
end there, the longest whose arc from the token before it exists.  Decoding emits the labels of the
arcs.  Words come again and again, so each worker keeps a bounded table of encoded words.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The Unicode property White_Space.
SPACE = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Decided arcs kept by a worker; the table is emptied when it is full.
ARCS_KEPT = 2_000_000
WORDS_KEPT = 400_000
_NEVER = 1 << 60
#: Beyond it only private, special and unassigned code points.
LAST_ASSIGNED = 0x38000


def word_pattern(letters: str, numbers: str, space: str) -> re.Pattern:
    """The word pattern of the vocabulary over the given character classes."""
    return re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


def category_ranges(major: str) -> str:
    """Characters of a major Unicode category as ranges of a character class."""
    out, start = [], None
    for c in range(LAST_ASSIGNED + 1):
        inside = c < LAST_ASSIGNED and unicodedata.category(chr(c))[0] == major
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


class Automaton:
    """The tokenization automaton of a byte-level BPE given as ``ranks`` (token bytes to rank)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.labels = {r: b for b, r in ranks.items()}
        self.reach: dict[bytes, int] = {}  # longest token by its first two bytes
        for label in ranks:
            self.reach[label[:2]] = max(self.reach.get(label[:2], 1), len(label))
        self.halves: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        self.arcs: dict[tuple[int, int], bool] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        for label in sorted(ranks, key=ranks.__getitem__):  # successive merges, in the order of their ranks
            if len(label) > 1:
                self._add_merge(label)

    def _add_merge(self, label: bytes) -> None:
        """The merge that makes ``label``: the two earlier tokens of its bytes between which no
        gadget so far lies."""
        z, get = self.ranks[label], self.ranks.get
        for k in range(1, len(label)):
            x, y = get(label[:k], z), get(label[k:], z)
            if x < z and y < z and self._decide(x, y):
                self.halves[z] = (x, y)
                self.merges[x, y] = z
                return

    def _edge(self, t: int, side: int) -> list[tuple[int, int]]:
        """Tokens on an edge of t's merge tree (side 1: right, 0: left), each with the rank until
        which it is open."""
        kept = (self.left, self.right)[side]
        out = kept.get(t)
        if out is None:
            out, until, x = [], _NEVER, t
            while True:
                out.append((x, until))
                half = self.halves.get(x)
                if half is None:
                    break
                until, x = x, half[side]
            kept[t] = out
        return out

    def arc(self, t: int, s: int) -> bool:
        """Whether s may follow t: no gadget takes the arc away."""
        known = self.arcs.get((t, s))
        if known is None:
            if len(self.arcs) >= ARCS_KEPT:
                self.arcs.clear()
            known = self.arcs[t, s] = self._decide(t, s)
        return known

    def _decide(self, t: int, s: int) -> bool:
        get = self.merges.get
        left = self._edge(s, 0)
        for x, open_x in self._edge(t, 1):
            for y, open_y in left:
                z = get((x, y))
                if z is not None and z < open_x and z <= open_y:
                    return False
        return True

    def _walk(self, word: bytes) -> list[int]:
        """Labels along the accepted path of ``word``.

        A prefix has one accepted path only, so a position from which the rest failed once is
        dead, and the longest arc is tried first.
        """
        n, get, arc, reach = len(word), self.ranks.get, self.arc, self.reach
        out: list[int] = []
        starts: list[int] = []
        dead: set[int] = set()
        i, t = 0, -1
        size = min(n, reach.get(word[:2], 1))
        while i < n:
            while size:
                s = get(word[i : i + size])
                if s is not None and i + size not in dead and (t < 0 or arc(t, s)):
                    break
                size -= 1
            if size:
                out.append(s)
                starts.append(i)
                i, t = i + size, s
                size = min(n - i, reach.get(word[i : i + 2], 1))
            else:
                dead.add(i)
                out.pop()
                back = starts.pop()
                size, i = i - back - 1, back
                t = out[-1] if out else -1
        return out

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(word)
        return (whole,) if whole is not None else tuple(self._walk(word))

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes whose encoding ``ids`` is, as labels along the arcs; an unknown id is a KeyError."""
        return b"".join(self.labels[i] for i in ids)


class Words(dict):
    """Encoded words by their text; emptied when it holds ``WORDS_KEPT``."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.automaton.encode_word(word.encode("utf-8", "surrogatepass"))
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Texts to ids.  An empty text has no ids; a null text has null."""

    def __init__(self, raw: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
        self.automaton = Automaton(ranks)
        self.words = Words(self.automaton)
        self.split_ascii = word_pattern("A-Za-z", "0-9", r"\t-\r ").findall
        self.split = word_pattern(category_ranges("L"), category_ranges("N"), SPACE).findall

    def pieces(self, text: str) -> Iterator[tuple[int, ...]]:
        found = self.split_ascii(text) if text.isascii() else self.split(text)
        return map(self.words.__getitem__, found)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.pieces(text)))

    def count(self, text: str) -> int:
        return sum(map(len, self.pieces(text)))

    def decode(self, ids: Iterable[int]) -> str:
        return self.automaton.decode(ids).decode("utf-8", "replace")


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(raw: bytes) -> Encoder:
    """The encoder of a vocabulary file's bytes; built once per worker process."""
    at = hash(raw)
    if at not in _ENCODERS:
        _ENCODERS[at] = Encoder(raw)
    return _ENCODERS[at]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids`` of every document: token ids without special tokens.

    Null text: null ids; empty text: no ids; a null doc_id and repeated rows are kept as they are.
    One pass without a shuffle; each worker builds the automaton once from the vocabulary's bytes,
    which are some 0.8 MB whatever the data.
    """
    spark = documents.sparkSession
    raw = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(raw.value)
        for b in batches:
            flat, ends, valid = array("i"), array("i", [0]), []
            for t in b.column(1).to_pylist():
                if t is not None:
                    flat.extend(chain.from_iterable(enc.pieces(t)))
                valid.append(t is None)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array(valid, pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def counted(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens`` of every document; 0 for null and empty texts."""
    spark = documents.sparkSession
    raw = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(raw.value)
        for b in batches:
            n = array("i", [0 if t is None else enc.count(t) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], ["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_tokens int")


def decoded(ids: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` back from ``doc_id, ids``; null ids give a null text."""
    raw = ids.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(raw.value)
        for b in batches:
            texts = [None if x is None else enc.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, text string")


