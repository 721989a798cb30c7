"""SimHash near-duplicates by multi-index hashing.

A document's 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints at three or
fewer differing bits have a segment at one or fewer, so each fingerprint probes the Hamming ball
of radius one around each of its segments in a table of all segments and checks the complete
distance. Of two segments at one bit, one has the bit set: only set bits are cleared, which halves
the probes. Equal fingerprints are collapsed first, so copies cost one row.

A segment value that many different fingerprints share would pair them all. Such values are
refined instead: the other segment differs in three or fewer bits as well, so one of its 16-bit
halves differs in one or fewer, and the same probing applies inside the value. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, plain, texts, tune
from .graph import components

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: Fingerprints that may share a segment value before the value is refined, and refined values that may be broadcast.
DENSE, BROADCAST_KEYS = 48, 100_000
#: Ids of dropped documents that may be broadcast (8 bytes each), so that texts stay where they are.
BROADCAST_IDS = 2_000_000
_BLOCK = 1 << 15


def shingle_hashes(text: str, words: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of the text, A-Z lower-cased; of the whole word sequence if it is shorter."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = list(accumulate([len(x) + 1 for x in w]))
    starts = [0, *ends[: len(w) - words]]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[s : e - 1], seed) for s, e in zip(starts, ends[words - 1 :])]), ">u8").astype(np.uint64)


def _ones(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int32)


def fingerprints_of(found: list[str | None]) -> np.ndarray:
    """Fingerprints of texts; null, empty and wordless texts have fingerprint zero."""
    ones, total = np.zeros((len(found), 64), np.int64), np.zeros(len(found), np.int64)
    held: list[np.ndarray] = []
    owner: list[int] = []
    n = 0

    def flush() -> None:
        nonlocal n
        if held:
            starts = np.concatenate([[0], np.cumsum([len(x) for x in held])[:-1]])
            np.add.at(ones, owner, _ones(np.concatenate(held), starts))
        held.clear(), owner.clear()
        n = 0

    for i, text in enumerate(found):
        h = shingle_hashes(text) if text else ()
        total[i] = len(h)
        for k in range(0, len(h), _BLOCK):
            held.append(h[k : k + _BLOCK])
            owner.append(i)
            n += len(held[-1])
            if n >= _BLOCK:
                flush()
    flush()
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = fingerprints_of(b.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for each row of docs."""
    tune(docs.sparkSession)
    return texts(docs).mapInArrow(_batches, "doc_id long, fp long")


def _cleared(value: Column, bits: int) -> Column:
    """value and each value with one of its set bits cleared."""
    return F.concat(F.array(value), F.filter(F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), i)))), lambda x: x != value))


def _flipped(value: Column, bits: int) -> Column:
    """value and each value at one bit from it."""
    return F.concat(F.array(value), F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))


def _segments(fp: Column) -> tuple[Column, Column]:
    """The lower segment, and the upper one with bit 32 set as its mark."""
    return fp.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(fp, 32)


_MARK = 1 << 32


def _near(left: str, right: str) -> Column:
    return F.bit_count(F.col(left).bitwiseXOR(F.col(right))) <= MAX_BITS


def links(nodes: DataFrame) -> DataFrame:
    """(fp, node), fp unique -> (u, v) of nodes whose fingerprints differ in MAX_BITS or fewer bits."""
    lo, hi = _segments(F.col("fp"))
    table = nodes.select(F.explode(F.array(lo, hi.bitwiseOR(_MARK))).alias("key"), F.col("fp").alias("t_fp"), F.col("node").alias("t_node"))
    probes = nodes.select(F.explode(F.concat(_cleared(lo, 32), F.transform(_cleared(hi, 32), lambda x: x.bitwiseOR(_MARK)))).alias("key"), "fp", "node")
    dense = materialize(table.groupBy("key").count().where(F.col("count") > DENSE).select("key"), "dense")
    n_dense = dense.count()
    hint = (lambda d: F.broadcast(d)) if n_dense <= BROADCAST_KEYS else (lambda d: d)
    plain_table = table.join(hint(dense), "key", "left_anti") if n_dense else table
    plain = probes.join(plain_table, "key").where((F.col("fp") != F.col("t_fp")) & _near("fp", "t_fp")).select(F.col("node").alias("u"), F.col("t_node").alias("v"))
    if not n_dense:
        return plain
    # inside a dense value: probe the 16-bit halves of the other segment
    other = lambda fp: F.when(F.col("key") >= _MARK, fp.bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned(fp, 32))
    halves = lambda fp, f: F.concat(f(other(fp).bitwiseAND(0xFFFF), 16), F.transform(f(F.shiftrightunsigned(other(fp), 16), 16), lambda x: x.bitwiseOR(1 << 16)))
    sub_table = table.join(hint(dense), "key", "left_semi").select("key", F.explode(halves(F.col("t_fp"), lambda v, _: F.array(v))).alias("sub"), "t_fp", "t_node")
    sub_probes = probes.join(hint(dense), "key", "left_semi").select("key", F.explode(halves(F.col("fp"), _flipped)).alias("sub"), "fp", "node")
    refined = sub_probes.join(sub_table, ["key", "sub"]).where((F.col("fp") != F.col("t_fp")) & _near("fp", "t_fp")).select(F.col("node").alias("u"), F.col("t_node").alias("v"))
    return plain.unionByName(refined)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable by links).

    One row for each row of docs. Null, empty and wordless texts have fingerprint zero and are
    linked like any other. Rows with the same text share a fingerprint and so a component. Rows
    without a doc_id are linked too and may join others; their component_id is null only if no row with an id is in reach.
    """
    fps = materialize(fingerprints(docs), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    most = nodes.agg(F.max("node").alias("top"), F.count_if(F.col("node").isNull()).alias("none")).first()
    if most.none:  # fingerprints of rows without ids alone: numbers above every id (left out where a long has none above)
        nodes = materialize(nodes.withColumn("node", F.coalesce("node", F.try_add(F.lit(-1 if most.top is None else most.top), F.monotonically_increasing_id() + 1))), "nodes")
    found = components(links(nodes.where("node is not null")))
    named = nodes.join(found.select(F.col("u").alias("node"), F.col("v").alias("low")), "node", "left").select(F.col("fp").alias("n_fp"), F.coalesce("low", "node").alias("component_id"))
    if most.none:
        named = named.withColumn("component_id", F.when(F.col("component_id") <= F.lit(most.top).cast("long"), F.col("component_id")))
    return fps.join(named, F.col("fp") == F.col("n_fp"), "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each group: the one with the smallest doc_id. All columns stay.

    Rows that repeat a doc_id are one document: one of them stays. Rows without a doc_id stay.
    """
    own = plain(docs)
    found = materialize(near_duplicates(own).select("doc_id", "component_id"), "groups")
    gone = materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:  # else Spark shuffles the texts
        gone = F.broadcast(gone)
    kept = own.join(gone, "doc_id", "left_anti").select(*own.columns)
    again = materialize(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    discard(found)
    if not again.isEmpty():
        kept = kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*own.columns)
    return kept.toDF(*docs.columns)
