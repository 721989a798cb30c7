"""Removes passages that an earlier document has: windows of words, prefiltered by a count-min sketch.

First pass. A window of 13 words is represented by one of its 5-word shingles, the one of least
hash, which every occurrence of the window chooses alike and which neighbouring windows share. Each
partition counts the documents of its chosen shingles in a count-min sketch; the merged sketches never count less
than there are, so they overestimate the count of every window, and one bit a cell (two or more) is
what the second pass needs. The sketch grows with the corpus up to a size that every worker can hold;
beyond that it fills up and lets more through, but loses none.

Second pass. Only runs of windows whose shingle is estimated to be in several documents are written,
one row for each different run of a document.
Equal runs are grouped first; single windows are compared only where one shingle has runs of
different words. A run or window of equal words is found by two independent 64-bit hashes, that of
its shingle and that of all its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, heavy, join_split, materialize, plain, texts, tune

WINDOW, SHINGLE = 13, 5
RUN = WINDOW - SHINGLE + 1
#: The sketch: rows, and the least and most cells in each as a power of two. It takes ROWS * 2**cells / 8 bytes, merged.
ROWS, FEWEST, MOST, PART = 2, 20, 30, 16
#: Bytes of text per cell, where cells aren't at their most: about a third of a shingle.
BYTES_A_CELL = 8


class Runs:
    """The runs of windows of one text that chose the same shingle.

    Shingles are hashed from running sums over the bytes, in numpy; hash() reads the bytes of a
    run or window themselves.
    """

    def __init__(self, text: str | None):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        self.n = len(words)
        self.shingle = self.start = self.count = np.zeros(0, np.int64)
        if self.n < WINDOW:
            return
        self.joined = b" ".join(words)
        b = np.frombuffer(self.joined, np.uint8)
        gap = np.flatnonzero(b == 32)
        self.starts = np.concatenate([[0], gap + 1])
        self.ends = np.append(gap, len(b))
        up, down = _powers(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_OF_BYTE[b] * up[: len(b)], out=sums[1:])
        first, last = self.starts[: self.n - SHINGLE + 1], self.ends[SHINGLE - 1 :]
        h = (sums[last] - sums[first]) * down[first]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        two = np.minimum(key[:-1], key[1:])
        four = np.minimum(two[:-2], two[2:])
        eight = np.minimum(four[:-4], four[4:])
        chosen = np.minimum(eight[:-1], key[RUN - 1 :]) & _PLACE
        self.start = np.flatnonzero(np.diff(chosen.astype(np.int64), prepend=-1))
        self.count = np.diff(self.start, append=len(chosen))
        self.shingle = h[chosen[self.start].astype(np.int64)]

    def hash(self, first: int, windows: int) -> int:
        return xxhash.xxh3_64_intdigest(self.joined[self.starts[first] : self.ends[first + windows + WINDOW - 2]])


_OF_BYTE = np.random.default_rng(13).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 28) - 1)
_BASE = 0x9E3779B97F4A7C15
_HELD: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n of each at least."""
    if not _HELD or len(_HELD[0]) < n:
        size = max(n, 1 << 17)
        _HELD[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, x, np.uint64), dtype=np.uint64)]) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _HELD[0], _HELD[1]


def cells(shingle: np.ndarray, power: int) -> list[np.ndarray]:
    """The cell in each row of a sketch of 2**power cells a row; the rows are numbered through."""
    mixed = (shingle ^ (shingle >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return [(x >> np.uint64(64 - power)) + np.uint64(k << power) for k, x in enumerate((shingle * np.uint64(0x9E3779B97F4A7C15), mixed)[:ROWS])]


def _counted(batches: Iterator[pa.RecordBatch], power: int) -> Iterator[pa.RecordBatch]:
    """A partition's sketch, in parts of 2**PART cells: the cells counted once, and those counted more often."""
    held: list[np.ndarray] = []
    n = 0

    def rows() -> pa.RecordBatch:
        cell, count = np.unique(np.concatenate([c for x in held for c in cells(x, power)]), return_counts=True)
        part = (cell >> np.uint64(PART)).astype(np.int64)
        low, more = cell.astype(np.uint16), count > 1
        names, at = np.unique(part, return_index=True)
        ends = [*at[1:].tolist(), len(part)]
        once, twice = [], []
        for s, e in zip(at.tolist(), ends):
            m = more[s:e]
            once.append(low[s:e][~m].tobytes())
            twice.append(low[s:e][m].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["part", "once", "twice"])

    for b in batches:
        for t in b.column("text").to_pylist():
            if len(s := np.unique(Runs(t).shingle)):  # once a document: a text's own repeats don't count
                held.append(s)
                n += len(s)
        if n > 2_000_000:
            yield rows()
            held, n = [], 0
    if held:
        yield rows()


def _merged(found: pd.DataFrame) -> pd.DataFrame:
    """Adds up the sketches of a few neighbouring parts; of each, a bit a cell is left."""
    out = {}
    for part, rows in found.groupby("part"):
        count = np.zeros(1 << PART, np.uint8)
        for once, twice in zip(rows["once"], rows["twice"]):
            at = np.frombuffer(once, np.uint16)
            count[at] = np.minimum(count[at] + 1, 2)
            count[np.frombuffer(twice, np.uint16)] = 2
        out[part] = np.packbits(count > 1).tobytes()
    return pd.DataFrame({"part": list(out), "bits": list(out.values())})


def sketch(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The merged sketch of docs, a bit for each cell that counts two or more; and its cells a row as a power of two."""
    tune(docs.sparkSession)
    found = texts(docs).where("text is not null")
    size = found.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    power = min(MOST, max(FEWEST, int(size // BYTES_A_CELL).bit_length()))
    parts = found.mapInArrow(lambda it: _counted(it, power), "part long, once binary, twice binary")
    bits = np.zeros(ROWS << (power - 3), np.uint8)
    for r in parts.groupBy(F.shiftright("part", 4)).applyInPandas(_merged, "part long, bits binary").toLocalIterator():
        bits[r.part << (PART - 3) : (r.part + 1) << (PART - 3)] = np.frombuffer(bytes(r.bits), np.uint8)
    return bits, power


def estimated_repeated(bits: np.ndarray, power: int, shingle: np.ndarray) -> np.ndarray:
    out = np.ones(len(shingle), bool)
    for c in cells(shingle, power):
        out &= (bits[(c >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (c & np.uint64(7)).astype(np.uint8))) & 1 > 0
    return out


_WINS = [f"w{k}" for k in range(RUN)]
_RUN_SCHEMA = "shingle long, words long, doc_id long, text_hash long, n int, starts array<int>, " + ", ".join(f"{w} long" for w in _WINS)


def _suspect(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The different runs of each text that may repeat; the hashes of their windows where there is more than one."""
    bits, power = shared.value
    for b in batches:
        found: list[list] = [[] for _ in range(6 + RUN)]
        for key, text_hash, t in zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), b.column("text").to_pylist()):
            r = Runs(t)
            if not len(r.shingle):
                continue
            own: dict[tuple[int, int], list[int]] = {}
            for k in np.flatnonzero(estimated_repeated(bits, power, r.shingle)).tolist():
                s, n = int(r.start[k]), int(r.count[k])
                at = own.setdefault((int(r.shingle[k]), r.hash(s, n)), [])
                if not at:
                    at.append(n)
                at.append(s)
            for (shingle, words), (n, *starts) in own.items():
                wins = [r.hash(starts[0] + i, 1) for i in range(n)] if n > 1 else []
                for column, v in zip(found, [shingle, words, key, text_hash, n, starts, *wins, *[None] * (RUN - len(wins))]):
                    column.append(v)
        kinds = [None, None, pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), *[None] * RUN]
        arrays = [pa.array(c, pa.uint64()).view(pa.int64()) if k is None else pa.array(c, k) for c, k in zip(found, kinds)]
        yield pa.RecordBatch.from_arrays(arrays, names=["shingle", "words", "doc_id", "text_hash", "n", "starts", *_WINS])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the way through the shuffle."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        data = [None if t is None else pack(t.encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(data, pa.binary()), b.column("r_id"), b.column("r_hash")], names=["row", "packed", "r_id", "r_hash"])


def _judged(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    """Applies marks (start << 16 | windows as bits) to texts: counts, and the kept words or their hash."""
    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        n, gone, kept = [], [], []
        for packed, found in zip(b.column("packed").to_pylist(), b.column("marks").to_pylist()):
            data = None if packed is None else unpack(packed)
            words = (data or b"").split()
            n.append(len(words))
            if found:
                m = np.array(found, np.int64)
                delta = np.zeros(len(words) + 1, np.int32)
                for i in range(RUN):
                    at = (m[(m >> i) & 1 > 0] >> 16) + i
                    np.add.at(delta, at, 1)
                    np.add.at(delta, at + WINDOW, -1)
                stay = np.cumsum(delta[:-1]) == 0
                words = [w for w, s in zip(words, stay.tolist()) if s]
            gone.append(n[-1] - len(words))
            kept.append(hashlib.sha256(b" ".join(words)).hexdigest() if digest else b" ".join(words).decode("utf-8", "replace") if gone[-1] else None if data is None else data.decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["row", "n_words", "n_removed", "kept"])


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash) -> marks of the windows that a document of smaller doc_id has."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(sketch(docs))
    rows = texts(docs).where("text is not null and doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    runs = materialize(rows.mapInArrow(lambda it: _suspect(it, shared), _RUN_SCHEMA), "runs")
    kinds = materialize(runs.groupBy("shingle", "words").agg(F.min("doc_id").alias("low"), F.count("*").alias("c"), F.min("n").alias("n"), *[F.max(w).alias(w) for w in _WINS]), "kinds")
    n_runs, n_kinds = kinds.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    common = heavy(kinds, ["shingle", "words"], "c", n_runs)
    mixed = materialize(kinds.groupBy("shingle").agg(F.count("*").alias("k")).where("k > 1"), "mixed")
    wide = heavy(mixed, ["shingle"], "k", n_kinds)
    wins = F.when(F.col("n") == 1, F.array("words")).otherwise(F.array_compact(F.array(*_WINS)))
    single = join_split(kinds, mixed.select("shingle"), ["shingle"], wide).select("shingle", "words", "low", F.posexplode(wins).alias("i", "window"))
    least = single.groupBy("shingle", "window").agg(F.min("low").alias("least"), F.count("*").alias("k"))
    least = least.where("k > 1") if wide is None else materialize(least.where("k > 1"), "least")
    shared_wide = None if wide is None else heavy(least, ["shingle", "window"], "k", RUN * n_kinds)
    later = join_split(single, least.drop("k"), ["shingle", "window"], shared_wide).where("low > least")
    bits = materialize(later.groupBy("shingle", "words").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i"))).alias("bits")), "bits")
    judged = kinds.select("shingle", "words", "low", "c").join(bits, ["shingle", "words"], "left").where("c > 1 or bits is not null").drop("c")
    all_ = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n")) - 1
    mask = F.when(F.col("doc_id") > F.col("low"), all_).otherwise(F.coalesce("bits", F.lit(0)))
    marked = join_split(runs.select("shingle", "words", "doc_id", "text_hash", "n", "starts"), judged, ["shingle", "words"], common).select("doc_id", "text_hash", "starts", mask.alias("mask")).where("mask > 0")
    marked = marked.select("doc_id", "text_hash", F.transform("starts", lambda s: F.call_function("shiftleft", s.cast("long"), F.lit(16)).bitwiseOR(F.col("mask"))).alias("m"))
    # a set: rows that repeat a doc_id and a text say the same
    found = materialize(marked.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("m")).alias("marks")), "marks")
    discard(runs, kinds, common, mixed, wide, bits, shared_wide, least)
    shared.unpersist()
    return found


def without_repeats(docs: DataFrame, carry: list[str], digest: bool = False) -> DataFrame:
    """Each row of docs as row (a struct of the columns in carry), n_words, n_removed and kept.

    kept is the words that stay, joined by a space, or the text itself if it loses none; with digest
    it is the SHA-256 of the words that stay. Null, empty and wordless texts have no words; texts of
    fewer than 13 words lose none. A document loses no word to itself, nor to rows that repeat its
    doc_id; rows without a doc_id are neither cut nor compared.
    """
    tune(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = plain(docs, *carry).select(F.struct(*carry).alias("row"), text.alias("text"), F.col("doc_id").cast("long").alias("r_id"), F.xxhash64(text).alias("r_hash"))
    found = marks(docs)
    row = T.StructField("row", rows.schema["row"].dataType)
    sent = rows.mapInArrow(_packed, T.StructType([row]).add("packed", "binary").add("r_id", "long").add("r_hash", "long"))
    joined = sent.join(found, (F.col("r_id") == F.col("doc_id")) & (F.col("r_hash") == F.col("text_hash")), "left").select("row", "packed", "marks")
    return joined.mapInArrow(lambda it: _judged(it, digest), T.StructType([row]).add("n_words", "long").add("n_removed", "long").add("kept", "string"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row."""
    return without_repeats(docs, ["doc_id"], digest=True).select("row.doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def with_texts_cut(docs: DataFrame) -> DataFrame:
    """docs, where a text that repeats passages of an earlier document has lost them (its words joined by a space).

    Texts that lose nothing stay as they are. n_chars, if there is such a column, follows the text.
    """
    own = plain(docs, "n_chars")
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars") if "n_chars" in own.columns else F.lit(None))}
    kinds = dict(own.dtypes)
    found = without_repeats(own, [c for c in own.columns if c != "text"])
    return found.select(*[(new[c].cast(kinds[c]) if c in new else F.col(f"row.{c}")).alias(c) for c in own.columns]).toDF(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
tok AS (SELECT r, doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
gram AS (SELECT r, doc_id, p, x, CASE WHEN count(*) OVER f = 13 THEN string_agg(x, ' ') OVER f END AS k FROM tok WINDOW f AS (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
first AS (SELECT k, min(doc_id) AS low FROM gram WHERE k IS NOT NULL GROUP BY k),
seen AS (SELECT r, p, x, CASE WHEN low < doc_id THEN 1 ELSE 0 END AS hit FROM gram LEFT JOIN first USING (k)),
cut AS (SELECT r, p, x, max(hit) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM seen),
sums AS (SELECT r, count(*) AS n, sum(gone)::BIGINT AS removed, coalesce(string_agg(x, ' ' ORDER BY p) FILTER (gone = 0), '') AS kept FROM cut GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN sums USING (r)
"""
