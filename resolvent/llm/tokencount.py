"""Token counts of a word-end BPE vocabulary: rank-synchronous merging of ragged numpy arrays.

No token reaches over white space, so a text's count is the sum of those of its chunks between
white space. Chunks that the worker hasn't met are normalised and cut into pre-tokens by the vocabulary file's own rules; the
distinct new pre-tokens of a batch lie end to end in one array of symbols. Each round looks up the
rank of every pair of neighbours, takes the least of each pre-token, merges all its pairs of that
rank at once (left to right where they overlap), and counts and drops the pre-tokens that have no pair left.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import REMEMBERED, Remembering
from .common import texts, tune

LIMIT = 2048
#: Pre-tokens of more symbols are merged with a heap of pairs: the same merges, without a round for each rank over a long array.
LONGEST_ROW = 512
_NONE = np.int64(2**62)


class RaggedCounter:
    """Numbers of symbols that the merges of a BPE vocabulary file leave of pre-tokens."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("not a plain BPE vocabulary")
        self.vocab = vocab
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        born = {int(m): r for r, m in reversed(list(enumerate(self.made)))}
        #: All pairs of a rank may be merged at once: no symbol takes part in a merge before the one that makes it.
        self.staged = all(born.get(vocab[x], -1) < r for r, m in enumerate(merges) for x in m)
        if not self.staged:
            raise ValueError("merges aren't in the order of their making")
        self.pairs = {int(k): (int(r), int(self.made[r])) for k, r in zip(self.keys, self.order)}

    def symbols(self, word: str) -> list[int]:
        return [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.end]]

    def _ranks(self, ids: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The rank of each symbol with the next of its row."""
        out = np.full(len(ids), _NONE)
        inner = np.flatnonzero(row[1:] == row[:-1])
        key = ids[inner] << 32 | ids[inner + 1]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        out[inner[hit]] = self.order[at[hit]]
        return out

    def count(self, words: list[str]) -> list[int]:
        """The number of symbols left of each word, in order; words aren't empty."""
        out = np.zeros(len(words), np.int64)
        short = [i for i, w in enumerate(words) if len(w) <= LONGEST_ROW]
        for i, w in enumerate(words):
            if len(w) > LONGEST_ROW:
                out[i] = self._long(self.symbols(w))
        size = np.array([len(words[i]) for i in short], np.int64)
        row = np.repeat(np.array(short, np.int64), size)
        ids = np.fromiter((x for i in short for x in self.symbols(words[i])), np.int64, int(size.sum()))
        while len(ids):
            rank = self._ranks(ids, row)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            size = np.diff(np.r_[first, len(row)])
            least = np.minimum.reduceat(rank, first)
            done = least == _NONE
            out[row[first[done]]] = size[done]
            live = np.repeat(~done, size)
            merge = (rank == np.repeat(least, size)) & live
            at = np.flatnonzero(merge)  # of overlapping pairs, every second one
            fresh = np.r_[True, np.diff(at) > 1]
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            ids[at] = self.made[rank[at]]
            live[at + 1] = False
            ids, row = ids[live], row[live]
        return out.tolist()

    def _long(self, ids: list[int]) -> int:
        """The same merges for one long row: a heap of (rank, place), stale entries skipped."""
        n, pairs = len(ids), self.pairs
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(*found, i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := pairs.get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        left = n
        while heap:
            _, made, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            left -= 1
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (found := pairs.get(ids[x] << 32 | ids[y])):
                    heapq.heappush(heap, (*found, x, ids[x], ids[y]))
            if after[i] >= 0:
                before[after[i]] = i
        return left


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Remembering:
    """chunk (bytes without ASCII white space) -> its number of tokens; one per worker."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    rules, ragged, known = Tokenizer.from_file(path), RaggedCounter(spec), {}
    special = [x["content"] for x in spec["added_tokens"]]
    if any(x["single_word"] or x["normalized"] or re.search(r"\s", x["content"]) for x in spec["added_tokens"]):
        raise ValueError("added tokens that depend on what stands around them aren't supported")
    cut = re.compile("|".join(re.escape(x) for x in sorted(special, key=len, reverse=True)) or r"(?!)")

    def make(new: list[bytes]) -> list[int]:
        """Chunks are normalised one by one and cut together, with a space between them."""
        said, owner, out = [], [], [0] * len(new)
        for i, chunk in enumerate(new):
            parts = [chunk.decode()]
            if cut.search(parts[0]):
                out[i] = len(cut.findall(parts[0]))
                parts = cut.split(parts[0])
            for x in parts:
                if x:
                    said.append(x.lower() if x.isascii() else rules.normalizer.normalize_str(x))
                    owner.append(i)
        size = np.array([len(x) + 1 for x in said], np.int64)
        found = rules.pre_tokenizer.pre_tokenize_str(" ".join(said)) if said else []
        at = np.searchsorted(np.cumsum(size), [start for _, (start, _) in found], side="right").tolist()
        fresh = list({w for w, _ in found if w not in known})
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = list({w for w, _ in found})
        known.update(zip(fresh, ragged.count(fresh)))
        for k, (w, _) in zip(at, found):
            out[owner[k]] += known[w]
        return out

    return Remembering(make)


def _batches(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    memory = counter(path)
    for b in batches:
        found = [x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()]
        chunks = [x.split() for x in found]
        memory.learn(set(chain.from_iterable(chunks)))
        n, n_bytes = [sum(map(memory.__getitem__, cs)) for cs in chunks], list(map(len, found))
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) of each row's whole text; no shuffle.

    Counts are those of the tokenizers library without truncation, padding or tokens at begin and
    end; special strings inside a text are one token each. Null, empty and white texts have none.
    Repeated rows give equal rows, and rows without a doc_id keep it null. Pre-tokens over
    LONGEST_ROW symbols are merged with a heap, with the same count.
    """
    tune(docs.sparkSession)
    return texts(docs).mapInArrow(lambda it: _batches(it, path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
