"""Packs documents into token windows by the online sum-of-squares rule.

Documents are tokenized once. Each is cut every 1024 tokens; whole pieces fill a window of their
own, the rest of a document goes to the open fill level that leaves the least sum of squared counts
of partly filled windows. A piece stays where the rule puts it. Pieces are dealt evenly over shards
of bounded size; a shard's level array has one entry per fill level, whatever the number of pieces.
What stays open at the end of a shard is padded: at most a few windows a level, so the share of
padding falls with the size of a shard.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts, tune

WINDOW, END_ID = 1024, 0
#: Pieces a shard gets on average.
SHARD = 65_536
_PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
_PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary file: printable bytes as themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + n)] = b
            n += 1
    return out


class Ids:
    """The ids that the tokenizers library gives for a byte-level BPE file.

    For speed the file's own vocabulary runs in tiktoken's core, whose ids are the same wherever
    the vocabulary's ids are in merge order (checked here on loading); a text that holds a special
    token of the file goes through tokenizers itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [x["content"] for x in spec["added_tokens"]]
        back = _byte_alphabet()
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ids = [spec["model"]["vocab"]["".join(m)] for m in merges]
        self.tokenizer, self.special, self.pattern = Tokenizer.from_file(path), special, public_tokenizers.PATTERN
        pre = spec.get("pre_tokenizer") or {}
        fast = ids == sorted(ids) and len(ids) + 256 == len(ranks) and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if fast else None
        probe = "It's 12 o'clock,\n\n  naïve   Ωmega!\t"
        if fast and self.fast.encode_ordinary(probe) != self.tokenizer.encode(probe, add_special_tokens=False).ids:
            self.fast = None

    def whole(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


@functools.lru_cache(maxsize=2)
def _ids(path: str) -> Ids:
    return Ids(path)


def _piece_batches(batches: Iterator[pa.RecordBatch], path: str, window: int) -> Iterator[pa.RecordBatch]:
    ids, end = _ids(path), END_ID.to_bytes(4, "little")
    for b in batches:
        out: list[list] = [[] for _ in _PIECE]
        for key, text in zip(b.column("doc_id").cast(pa.int64()).to_pylist(), b.column("text").to_pylist()):
            data = (ids.whole(text) if text else b"") + end
            for at in range(0, len(data), 4 * window):
                piece = data[at : at + 4 * window]
                for column, value in zip(out, (key, at // 4, len(piece) // 4, zlib.crc32(piece), len(data) // 4)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=_PIECE)


def pieces(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Each document's tokens and an end id, cut every `window`: doc_id, start, length, ids_crc32, doc_tokens."""
    tune(docs.sparkSession)
    return texts(docs).mapInArrow(lambda it: _piece_batches(it, path, window), _PIECE_SCHEMA)


def sum_of_squares(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Places lengths in order; -> the window of each, and the fill of each window.

    count[h] windows have fill h. A piece of s on level h changes the sum of squares of the counts
    by 2 (count[h + s] - count[h]) + 2, or by 1 - 2 count[h] where it fills a window, or by
    2 count[s] + 1 for a new window. The least change wins, the fullest level among equals.
    """
    count, members = np.zeros(window + 1, np.int64), [[] for _ in range(window + 1)]
    where, fill = [0] * len(lengths), []
    for i, s in enumerate(lengths):
        if s >= window:
            where[i] = len(fill)
            fill.append(s)
            continue
        top = window - s
        change = 2 * (count[s : window + 1] - count[: top + 1]) + 2
        change[top] = 1 - 2 * count[top]
        change = np.where(count[: top + 1] > 0, change, np.iinfo(np.int64).max)
        change[0] = 2 * count[s] + 1
        h = top - int(change[::-1].argmin())
        if h:
            w = members[h].pop()
            count[h] -= 1
        else:
            w = len(fill)
            fill.append(0)
        where[i] = w
        fill[w] += s
        if fill[w] < window:
            members[fill[w]].append(w)
            count[fill[w]] += 1
    return where, fill


def _pack(window: int):
    def pack(found: pa.Table) -> pa.Table:
        shard = found.column("shard")[0].as_py()
        found = found.select(_PIECE).sort_by([(c, "ascending") for c in _PIECE])
        lengths = found.column("length").to_pylist()
        where, fill = sum_of_squares(lengths, window)
        used, sequence, offset = [0] * len(fill), [], []
        for w, s in zip(where, lengths):
            sequence.append((shard << 32) + w)
            offset.append(used[w])
            used[w] += s
        return found.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return pack


def pack(docs: DataFrame, path: str, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts give one piece of the end id alone. Repeated rows, and rows without a
    doc_id, are packed once each. No row is dropped; sequence ids are unique, not gapless. Rows are
    dealt over shards in turn, so equal rows, however many, don't meet in one.
    """
    cut = materialize(pieces(docs, path, window), "pieces")
    shards = max(1, -(-cut.count() // shard))
    dealt = cut.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_pack(window), f"{_PIECE_SCHEMA}, sequence_id long, offset long")
