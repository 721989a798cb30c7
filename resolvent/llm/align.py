"""Alignment of two tokenizers' tokens of the same text, and corpus-wide counts of the pairs that end together.

Tokens of both are laid over the text's bytes; where one of each ends at the same byte, the text is
cut into groups and the two tokens are linked. A link is one int64, the second tokenizer's id above the
first's. Each partition counts its links with np.unique; the partial counts are sorted over the
cluster by range, and each range sums the runs of equal keys into one shard: a file of sorted keys
and their counts in the shared folder. Lookups map the shards into memory and search them, so a
worker holds only the pages it touches, and the links themselves are never shuffled.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.written import shared_folder
from .common import discard, materialize, texts, tune
from .packing import _byte_alphabet, _ids

#: Links that a partition gathers before it counts them, and different pairs it holds before it hands them on.
GATHERED, HELD = 2_000_000, 4_000_000
#: Rows of partial counts that a shard gets on average.
SHARD = 4_000_000
_COLUMNS = ["a_ids", "b_ids", "a_sizes", "b_sizes"]
_ALIGNED = "doc_id long, " + ", ".join(f"{c} array<int>" for c in _COLUMNS)
#: The written form: ids as unsigned 32-bit integers, and for each token a byte that is 1 if a group ends with it. Unlike lists, it's read without a level for each token.
_PACKED_COLUMNS = ["a_ids", "b_ids", "a_last", "b_last"]
_PACKED = "doc_id long, " + ", ".join(f"{c} binary" for c in _PACKED_COLUMNS)
_DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Pair:
    """The two tokenizers of a worker: ids of space + text by a byte-level BPE file (A), of text by a piece model with byte fallback (B), and each id's bytes."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, back = _ids(a_path), _byte_alphabet()
        self.slow = Tokenizer.from_file(a_path)
        self.slow.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.a_bytes = self._table({i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        spell = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = self._table({i: spell(i) for i in range(self.b.get_piece_size())})
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    @staticmethod
    def _table(found: dict[int, bytes]) -> list[bytes]:
        return [found.get(i, b"") for i in range(max(found) + 1)]

    def a_ids(self, text: str) -> np.ndarray:
        return self.a.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32) if self.a.fast else np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int32)

    def align(self, text: str | None, b_ids: list[int]) -> tuple[np.ndarray, ...] | None:
        """(a_ids, b_ids, whether each token of A ends a group, of B): None if there is no text or its tokens don't spell it."""
        if not text:
            return None
        a, b, data = self.a_ids(" " + text), np.array(b_ids, np.int32), b" " + text.encode()
        if b"".join([self.b_bytes[i] for i in b_ids]) != data or b"".join([self.a_bytes[i] for i in a.tolist()]) != data:
            return None
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.zeros(len(data) + 1, np.int8)
        ends[a_end] = 1
        b_last = ends[b_end]
        ends[b_end] += 1
        return a, b, (ends[a_end] == 2).astype(np.int8), b_last


@functools.lru_cache(maxsize=2)
def _pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _lists(rows: list[np.ndarray | None]) -> pa.ListArray:
    """A list per row, null where the row is None."""
    offsets = np.r_[0, np.cumsum([0 if r is None else len(r) for r in rows])].astype(np.int32)
    values = np.concatenate([np.zeros(0, np.int32), *[r for r in rows if r is not None]])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)), mask=pa.array([r is None for r in rows], pa.bool_()))


def _sizes(last: np.ndarray | None) -> np.ndarray | None:
    return None if last is None else np.diff(np.flatnonzero(last), prepend=-1)


def _align_batches(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, packed: bool) -> Iterator[pa.RecordBatch]:
    pair = _pair(a_path, b_path)
    for b in batches:
        found = b.column("text").to_pylist()
        ids = pair.b.encode([x or "" for x in found], num_threads=1)
        columns = list(zip(*[pair.align(x, i) or (None,) * 4 for x, i in zip(found, ids)])) or [()] * 4
        if packed:
            columns, names = [pa.array([None if x is None else x.tobytes() for x in c], pa.binary()) for c in columns], _PACKED_COLUMNS
        else:
            columns, names = [_lists(c) for c in (*columns[:2], *[list(map(_sizes, c)) for c in columns[2:]])], _COLUMNS
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *columns], names=["doc_id", *names])


def alignments(docs: DataFrame, a_path: str, b_path: str, packed: bool = False) -> DataFrame:
    """doc_id, a_ids, b_ids, and how many tokens of each every group has (a_sizes, b_sizes); no shuffle.

    A's tokens are of space + text, special strings being plain text; B puts the space there itself.
    Null and empty texts, and texts that either tokenizer's tokens don't spell byte by byte (B reads
    U+2581 as a space), have four nulls. Repeated rows give equal rows, and rows without a doc_id
    keep it null. packed: the four as bytes, for the other functions here.
    """
    tune(docs.sparkSession)
    return texts(docs).mapInArrow(lambda it: _align_batches(it, a_path, b_path, packed), _PACKED if packed else _ALIGNED)


def _unpacked(b: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of a packed batch: the four columns end to end, and where each of its rows begins and the last ends, in tokens."""
    values, offsets = [], []
    for name in _PACKED_COLUMNS:
        column, kind = b.column(name), np.dtype("<i4" if name.endswith("ids") else "i1")
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
        data = column.buffers()[2] if len(column) else None
        values.append(np.frombuffer(data, "u1")[at[0] : at[-1]].view(kind) if data is not None else np.zeros(0, kind))
        offsets.append((at - at[0]) // kind.itemsize)
    return values, offsets


def _links(values: list[np.ndarray]) -> np.ndarray:
    """The links of a batch, document after document: the last tokens of every group."""
    a_ids, b_ids, a_last, b_last = values
    return b_ids[b_last != 0].astype(np.int64) << 32 | a_ids[a_last != 0]


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, np.concatenate(n))
    return found, total


def _partial_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's counts: keys gathered up to GATHERED, counted, and merged into what it holds."""
    held, new, size = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0

    def count() -> tuple[np.ndarray, np.ndarray]:
        keys, n = np.unique(np.concatenate(new), return_counts=True)
        return _summed([held[0], keys], [held[1], n]) if len(held[0]) else (keys, n)

    for b in batches:
        new.append(_links(_unpacked(b)[0]))
        size += len(new[-1])
        if size >= GATHERED:
            held, new, size = count(), [], 0
            if len(held[0]) >= HELD:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, held)), names=["key", "n"])
                held = held[0][:0], held[1][:0]
    if size:
        held = count()
    if len(held[0]):
        yield pa.RecordBatch.from_arrays(list(map(pa.array, held)), names=["key", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Of packed alignments: (key, n), sorted by key within and over the partitions: how many links have the pair of ids b << 32 | a.

    A key has at most a row per partition before the sort, however common it is.
    """
    partial = materialize(aligned.select(*_PACKED_COLUMNS).where("a_ids is not null").mapInArrow(_partial_batches, "key long, n long"), "partial-counts")
    shards = max(1, -(-partial.count() // SHARD))
    return partial.repartitionByRange(shards, "key").sortWithinPartitions("key").mapInArrow(_run_sums, "key long, n long")


def _run_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the runs of equal keys of a sorted partition; the last run of a batch waits for the next."""
    last, total = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        keys, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n"))
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, n = keys[first], np.add.reduceat(n, first)
        if last is not None and keys[0] == last:
            n[0] += total
        elif last is not None:
            keys, n = np.r_[last, keys], np.r_[total, n]
        last, total = int(keys[-1]), int(n[-1])
        if len(keys) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), pa.array(n[:-1])], names=["key", "n"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([total], pa.int64())], names=["key", "n"])


def _local(path: str) -> str | None:
    """The path in the file system of this machine, for shared folders that are mounted; None for other stores."""
    return path.removeprefix("file://").removeprefix("file:") if path.startswith(("/", "file:")) else None


def _write_shards(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes a partition's keys and counts as one file of int64; -> a row per B id: path, first key, rows, B id, its highest count.

    A task that runs twice writes the same bytes under a name of its own first, so what is there is always whole.
    """
    found = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n")] for b in batches if b.num_rows]
    if not found:
        return
    keys, n = map(np.concatenate, zip(*found))
    path, data = f"{folder}/{int(keys[0]):016x}", np.stack([keys, n]).astype("<i8")
    if (local := _local(path)) is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        mine = f"{local}.{uuid.uuid4().hex}"
        data.tofile(mine)
        os.replace(mine, local)
    else:
        store, at = pyarrow.fs.FileSystem.from_uri(path)
        store.create_dir(os.path.dirname(at), recursive=True)
        mine = f"{at}.{uuid.uuid4().hex}"
        with store.open_output_stream(mine) as f:
            f.write(data.tobytes())
        store.move(mine, at)
    first = np.flatnonzero(np.r_[True, keys[1:] >> 32 != keys[:-1] >> 32])
    tops = np.maximum.reduceat(n, first)
    yield pa.RecordBatch.from_arrays([pa.array([path] * len(first)), pa.array([int(keys[0])] * len(first), pa.int64()), pa.array([len(keys)] * len(first), pa.int64()), pa.array(keys[first] >> 32), pa.array(tops)], names=["path", "first", "rows", "b", "top"])


@functools.lru_cache(maxsize=4096)
def _shard(path: str, rows: int) -> np.ndarray:
    """(keys, counts): mapped into memory from a mounted shared folder; from another store read as a whole."""
    if (local := _local(path)) is not None:
        return np.memmap(local, "<i8", "r", shape=(2, rows))
    store, at = pyarrow.fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        return np.frombuffer(f.read_buffer(), "<i8").reshape(2, rows)


class Counts:
    """Counts by pair of ids, in sorted shards: what the driver holds is a row per shard and one per B id, so bounded by the vocabulary."""

    def __init__(self, shards: list[tuple[int, str, int]], tops: dict[int, int]):
        shards = sorted(shards)
        self.first, self.files = np.array([s[0] for s in shards], np.int64), [(p, r) for _, p, r in shards]
        self.tops = np.zeros(max(tops, default=0) + 1, np.int64)
        self.tops[list(tops)] = list(tops.values())

    @classmethod
    def of(cls, counted: DataFrame) -> Counts:
        """Writes the shards of pair_counts() to the shared folder."""
        folder = f"{shared_folder(counted.sparkSession)}/resolvent/pair-shards-{uuid.uuid4().hex}"
        said = materialize(counted.mapInArrow(lambda it: _write_shards(it, folder), "path string, first long, rows long, b long, top long"), "shards")
        found = cls([tuple(r) for r in said.select("first", "path", "rows").distinct().collect()], {r.b: r.top for r in said.groupBy("b").agg(F.max("top").alias("top")).collect()})
        discard(said)
        return found

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key; all keys were counted."""
        found, at = np.unique(keys, return_inverse=True)
        out = np.zeros(len(found), np.int64)
        cuts = [*np.searchsorted(found, self.first).tolist(), len(found)]
        for file, lo, hi in zip(self.files, cuts, cuts[1:]):
            if hi > lo:
                shard = _shard(*file)
                out[lo:hi] = shard[1][np.searchsorted(shard[0], found[lo:hi])]
        return out[at]


def _spell(sizes: tuple[int, int]) -> tuple[list[bytes], int]:
    """The decimal ids of A and B, each with the sign that follows it: `,` or, at a group's end, `|` and `;`."""
    a, b = sizes
    return [x for ends, n in ((b",|", a), (b",;", b)) for i in range(n) for x in (b"%d%c" % (i, ends[0]), b"%d%c" % (i, ends[1]))], 2 * a


def _digest_batches(batches: Iterator[pa.RecordBatch], counts: Counts, sizes: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    signs, offset = _spell(sizes)
    for b in batches:
        values, offsets = _unpacked(b)
        keys = _links(values)
        n = counts.look_up(keys)
        best = n == counts.tops[keys >> 32]
        a_ids, b_ids, a_last, b_last = values
        # 2 * id, + 1 at a group's end; a token comes after all tokens of the groups before its own, B's after A's of its own
        a_code, b_code = 2 * a_ids.astype(np.int64) + a_last, offset + 2 * b_ids.astype(np.int64) + b_last
        out, at = [], 0
        for none, a, z, c, e in zip(b.column("a_ids").is_null().to_pylist(), offsets[0].tolist(), offsets[0][1:].tolist(), offsets[1].tolist(), offsets[1][1:].tolist()):
            if none:
                out.append((0, 0, 0, 0, 0, 0, ""))
                continue
            a_end, b_end = np.flatnonzero(a_last[a:z]) + 1, np.flatnonzero(b_last[c:e]) + 1
            g = len(a_end)
            code = np.empty(z - a + e - c, np.int64)
            code[np.arange(z - a) + np.repeat(np.r_[0, b_end[:-1]], np.diff(a_end, prepend=0))] = a_code[a:z]
            code[np.arange(e - c) + np.repeat(a_end, np.diff(b_end, prepend=0))] = b_code[c:e]
            said = b"".join(map(signs.__getitem__, code.tolist()))[:-1]
            out.append((z - a, e - c, g, g, int(best[at : at + g].sum()), int(n[at : at + g].sum()), hashlib.sha256(said).hexdigest()))
            at += g
        names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        columns = [pa.array(c, pa.string() if name == "groups_sha256" else pa.int64()) for name, c in zip(names, zip(*out) if out else [()] * 7)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", *names])


def digests(aligned: DataFrame, counts: Counts, sizes: tuple[int, int]) -> DataFrame:
    """Of packed alignments: numbers of tokens, groups and links, the links whose count is their B id's highest, the sum of counts, and a hash of the groups.

    sizes: numbers of ids of A and B. Rows of nulls have zeros and an empty string.
    """
    return aligned.mapInArrow(lambda it: _digest_batches(it, counts, sizes), _DIGESTS)


def align(docs: DataFrame, a_path: str, b_path: str, finish: Callable[[DataFrame, Counts, tuple[int, int]], DataFrame] = digests) -> DataFrame:
    """Aligns the texts, counts the pairs over all rows, and returns what finish() makes of both.

    The aligned tokens are written once, so texts are tokenized once. An empty table gives no rows.
    """
    aligned = materialize(alignments(docs, a_path, b_path, packed=True), "aligned")
    pair = _pair(a_path, b_path)
    return finish(aligned, Counts.of(pair_counts(aligned)), (len(pair.a_bytes), len(pair.b_bytes)))
