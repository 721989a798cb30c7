"""Byte-level BPE over Arrow batches: padded numpy matrices for what is new, a bounded memory for what is not.

A text is cut before spaces into chunks; the split pattern never lets a match reach across such a
cut unless the space has white space on both sides, and texts with such a space are taken whole.
The chunks that the worker has not met are split by the pattern, and their distinct matches are
encoded together: matrices of rows of similar length, where each round looks up the ranks of all
neighbouring pairs in a hash table, merges each row's leftmost pair of least rank, closes the gap,
and drops the rows that are done.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import texts, tune

#: Rows longer than this are merged with a heap of pairs: the same merges, without a quadratic matrix.
LONGEST_ROW = 256
#: Chunks and matches remembered by a worker before it forgets them all: about 250 bytes each.
REMEMBERED = 1_000_000
_NONE = np.int32(2**31 - 1)
#: A space between white space, or after white space at the end.
_INNER_SPACE = re.compile(r"\s(?: \s| $)")


class PairTable:
    """Open-addressing table from a pair of ids to the id (the rank) of their concatenation."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {(ranks[t[:k]] << 32) | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 4))))
        self.mask = (1 << self.bits) - 1
        self.keys, self.found = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        left, value = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        at, self.probes = self._slot(left), 0
        while len(left):
            self.probes += 1
            free = self.keys[at] < 0
            _, first = np.unique(at, return_index=True)
            put = np.zeros(len(at), bool)
            put[first] = True
            put &= free
            self.keys[at[put]], self.found[at[put]] = left[put], value[put]
            left, value, at = left[~put], value[~put], (at[~put] + 1) & self.mask
        self.pairs = pairs

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, key: np.ndarray) -> np.ndarray:
        at = self._slot(key)
        held = self.keys[at]
        out = np.where(held == key, self.found[at], _NONE)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at_ = (at[open_] + 1) & self.mask
            at[open_] = at_
            held, want = self.keys[at_], key[open_]
            hit = held == want
            out[open_[hit]] = self.found[at_[hit]]
            open_ = open_[~hit & (held >= 0)]
        return out


class Encoder:
    """Encodes bytes that the split pattern matched, by a table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.table = ranks, PairTable(ranks)
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.single < 0).any():
            raise ValueError("the ranks lack some single bytes")

    def encode(self, found: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in found]
        sizes = np.array([len(x) for x in found], np.int64)
        for bound in (1, 2, 4, 6, 8, 12, 16, 24, 32, 64, 128, LONGEST_ROW):
            rows = np.flatnonzero((sizes <= bound) & (sizes > 0))
            sizes[rows] = 0
            for k in range(0, len(rows), step := max(1, (1 << 20) // bound)):
                self._matrix(found, rows[k : k + step], bound, out)
        for i in np.flatnonzero(sizes > 0):
            out[i] = self._long(found[i])
        return out

    def _matrix(self, found: list[bytes], rows: np.ndarray, width: int, out: list[list[int]]) -> None:
        flat = np.frombuffer(b"".join([found[i].ljust(width, b"\0") for i in rows]), np.uint8).reshape(len(rows), width)
        size = np.array([len(found[i]) for i in rows])
        ids = np.where(np.arange(width) < size[:, None], self.single[flat], -1).astype(np.int32)
        while ids.shape[1] > 1 and len(ids):
            pair = (ids[:, :-1].astype(np.int64) << 32) | ids[:, 1:].astype(np.int64) & 0xFFFFFFFF
            real = ids[:, 1:] >= 0
            rank = np.full(pair.shape, _NONE, np.int32)
            rank[real] = self.table.ranks(pair[real])
            at = rank.argmin(axis=1)
            least = np.take_along_axis(rank, at[:, None], 1)[:, 0]
            go = least != _NONE
            if not go.all():
                self._give(ids[~go], rows[~go], out)
                ids, rows, at, least = ids[go], rows[go], at[go], least[go]
            cols = np.arange(ids.shape[1] - 1)
            merged = np.where(cols <= at[:, None], ids[:, :-1], ids[:, 1:])
            merged[np.arange(len(at)), at] = least
            ids = merged[:, : max(1, int((merged >= 0).sum(axis=1).max(initial=0)))]
        self._give(ids, rows, out)

    @staticmethod
    def _give(ids: np.ndarray, rows: np.ndarray, out: list[list[int]]) -> None:
        n = (ids >= 0).sum(axis=1).tolist()
        for i, row, k in zip(rows.tolist(), ids.tolist(), n):
            out[i] = row[:k]

    def _long(self, word: bytes) -> list[int]:
        """The same merges for one long row: a heap of (rank, place), stale entries skipped."""
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(ids))) + [-1], list(range(-1, len(ids) - 1))
        pairs = self.table.pairs
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := pairs.get((ids[i] << 32) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (q := pairs.get((r << 32) | ids[k])) is not None:
                    heapq.heappush(heap, (q, i, r, ids[k]))
            if (h := before[i]) >= 0 and (q := pairs.get((ids[h] << 32) | r)) is not None:
                heapq.heappush(heap, (q, h, ids[h], r))
        return [x for x in ids if x >= 0]


def chunks(text: str) -> list[str]:
    """The text cut before each space, if no match of the split pattern can reach across a cut; else whole."""
    if " " not in text or _INNER_SPACE.search(text):
        return [text]
    head, *rest = text.split(" ")
    found = [" " + x for x in rest]
    return [head, *found] if head else found


class Remembering(dict):
    """chunk -> what make() returns for it; make() gets the new chunks of a batch together."""

    def __init__(self, make, most: int = REMEMBERED, most_chars: int = 16 << 20):
        super().__init__()
        self.make, self.most, self.most_chars, self.chars = make, most, most_chars, 0

    def learn(self, found: Iterable[str]) -> None:
        new = list(set(found).difference(self))
        if len(self) and (len(self) + len(new) > self.most or self.chars > self.most_chars):
            self.clear()
            self.chars, new = 0, list(set(found))
        self.chars += sum(map(len, new))
        self.update(zip(new, self.make(new)))


def splitter(pattern: str):
    """A function from a text to its matches; white space is what Unicode calls so, as in the tokenizer libraries."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall


def by_match(split, encode, gather):
    """make() for Remembering: distinct new matches are encoded once, a chunk gathers those of its matches.

    A chunk of letters after one space is one match, and one more if a mark follows: the commonest
    chunks need no pattern.
    """
    known: dict[str, object] = {}

    def matches(chunk: str) -> list[str]:
        if chunk[:1] == " ":
            if chunk[1:].isalpha():
                return [chunk]
            if chunk[-1] in ".,;:!?" and chunk[1:-1].isalpha():
                return [chunk[:-1], chunk[-1]]
        return split(chunk)

    def make(new: list[str]) -> list:
        cut = [matches(x) for x in new]
        fresh = list({m for ms in cut for m in ms if m not in known})
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = list({m for ms in cut for m in ms})
        known.update(zip(fresh, encode(fresh)))
        return [known[ms[0]] if len(ms) == 1 else gather([known[m] for m in ms]) for ms in cut]

    return make


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Remembering:
    """chunk -> (ids as decimal text, bytes that the ids decode to, number of ids); one per worker."""
    encoder = Encoder(load_ranks(path))

    def encode(found: list[str]) -> list[tuple[bytes, bytes, int]]:
        ids = encoder.encode([m.encode("utf-8", "surrogatepass") for m in found])
        return [(" ".join(map(str, x)).encode(), b"".join([encoder.bytes_of[i] for i in x]), len(x)) for x in ids]

    def gather(parts: list[tuple[bytes, bytes, int]]) -> tuple[bytes, bytes, int]:
        return b" ".join([p[0] for p in parts]), b"".join([p[1] for p in parts]), sum([p[2] for p in parts])

    return Remembering(by_match(splitter(pattern), encode, gather))


def _batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    memory = coder(path, pattern)
    for b in batches:
        found = [chunks(x) if x else [] for x in b.column("text").to_pylist()]
        n, ids, decoded = [], [], []
        start = 0
        while start < len(found):  # as many documents together as the memory can hold
            end, size = start, 0
            while end < len(found) and (end == start or size + len(found[end]) <= REMEMBERED):
                size += len(found[end])
                end += 1
            memory.learn([c for cs in found[start:end] for c in cs])
            for cs in found[start:end]:
                said, data, count = zip(*map(memory.__getitem__, cs)) if cs else ((), (), ())
                n.append(sum(count))
                ids.append(hashlib.sha256(b" ".join(said)).hexdigest())
                decoded.append(hashlib.sha256(b"".join(data)).hexdigest())
            start = end
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row's whole text; no shuffle.

    Null and empty texts have no ids: the hashes are those of the empty string. Repeated rows give
    equal rows. Texts of any length are taken whole; a match of the pattern longer than LONGEST_ROW
    bytes is merged with a heap instead of a matrix row, with the same ids.
    """
    tune(docs.sparkSession)
    return texts(docs).mapInArrow(lambda it: _batches(it, path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
