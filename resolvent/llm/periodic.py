"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz on what it leaves.

A run of period q and length L repeats its first L - q words q words later, so each of its words
lies in a k-gram that the document has twice, for every k up to L - q. With k the least L - q of any
run, words outside repeated k-grams can't belong to one. The stretches that remain are halved again and again:
a run across the middle of a stretch has two whole periods on one side of it, so the squares that
begin (or end) at the middle, read off a Z array of a quarter of the stretch, give every period,
and a comparison across the middle gives its extent. A stretch of m words costs O(m log m).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, tune

MIN_LENGTH, EXPONENT = 6, 4
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def overlap(min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> int:
    """The least length - period of any run: at the longest period that min_length decides, or at the next."""
    q = min_length // exponent
    return min(min_length - q, (exponent - 1) * (q + 1)) if q else exponent - 1


def _squares(v: list[int], top: int) -> list[tuple[int, int]]:
    """(p, z) for each p up to top whose square begins v: z, the words that agree with those p later, is at least p.

    Left out are multiples of a shorter such period that holds over both halves of their square: the same run.
    """
    n, z, left, right, found = len(v), [0] * (top + 1), 0, 0, []
    for p in range(1, top + 1):
        k = min(right - p, z[p - left]) if p < right else 0
        if p + k >= right:
            while p + k < n and v[k] == v[p + k]:
                k += 1
            left, right = p, p + k
        z[p] = k
        if k >= p and not any(p % q == 0 and q + y >= 2 * p for q, y in found):
            found.append((p, k))
    return found


def find_runs(w: list[int], min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of at least min_length and exponent periods (4 or more), by start, then period."""
    n, period = len(w), {}
    halves = [(0, n)]
    while halves:
        lo, hi = halves.pop()
        if hi - lo < min_length:
            continue
        mid, top = (lo + hi) // 2, (hi - lo) // exponent
        across = []
        for p, z in _squares(w[mid:hi], min(top, (hi - mid) // 2)):
            s = mid
            while s > lo and w[s - 1] == w[s - 1 + p]:
                s -= 1
            across.append((s, mid + p + z, p))
        for p, z in _squares(w[lo:mid][::-1], min(top, (mid - lo) // 2)):
            e = mid
            while e < hi and w[e] == w[e - p]:
                e += 1
            across.append((mid - p - z, e, p))
        for s, e, p in across:
            cut = s == lo > 0 and w[lo - 1] == w[lo - 1 + p] or e == hi < n and w[hi] == w[hi - p]  # a half above has it whole
            if not cut and e - s >= max(min_length, exponent * p):
                period[s, e] = min(p, period.get((s, e), p))
        halves += [(lo, mid), (mid, hi)]
    return sorted((s, e - s, p) for (s, e), p in period.items())


def segments(ids: np.ndarray, starts: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Maximal stretches of words covered by k-grams that their document has twice; starts: where documents begin, ascending.

    Grams are compared by hash: two that collide add words to a stretch, none is lost.
    """
    n = len(ids)
    if n < k:
        return []
    doc = np.searchsorted(starts, np.arange(n), side="right").astype(np.uint64)
    h = doc[: n - k + 1] * np.uint64(0x9E3779B97F4A7C15)
    for j in range(k):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + ids[j : n - k + 1 + j].astype(np.uint64)
    whole = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    order = whole[np.argsort(h[whole], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    at = order[np.r_[same, False] | np.r_[False, same]] if len(order) else order
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + k, -1)
    covered = np.cumsum(step[:n]) > 0
    first = np.zeros(n + 1, bool)
    first[starts] = True
    begins = np.flatnonzero(covered & (first[:n] | ~np.r_[False, covered[:-1]]))
    ends = np.flatnonzero(covered & (first[1:] | ~np.r_[covered[1:], False])) + 1
    return list(zip(begins.tolist(), ends.tolist()))


def _batches(batches: Iterator[pa.RecordBatch], min_length: int, exponent: int) -> Iterator[pa.RecordBatch]:
    k = overlap(min_length, exponent)
    for b in batches:
        words = [(x or b"").split() for x in b.column("text").cast(pa.binary()).to_pylist()]
        number = defaultdict(count().__next__)
        ids = np.fromiter((number[w] for ws in words for w in ws), np.int64)
        size = np.array([len(ws) for ws in words], np.int64)
        begin = np.cumsum(size) - size
        starts = begin[size > 0]
        row = np.flatnonzero(size > 0)
        runs: list[list[dict]] = [[] for _ in words]
        kept = [None] * len(words)
        for s, e in segments(ids, starts, k):
            if e - s < min_length or not (found := find_runs(ids[s:e].tolist(), min_length, exponent)):
                continue
            i = int(row[np.searchsorted(starts, s, side="right") - 1])
            at = s - int(begin[i])
            if kept[i] is None:
                kept[i] = np.ones(size[i], bool)
            for start, length, period in found:
                runs[i].append({"start": at + start, "length": length, "period": period})
                kept[i][at + start + period : at + start + length] = False
        collapsed = [b" ".join(ws) if m is None else b" ".join([w for w, y in zip(ws, m.tolist()) if y]) for ws, m in zip(words, kept)]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(runs, pa.list_(_RUN)), pa.array(collapsed, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the text with each run cut to one period; no shuffle.

    A run is a maximal stretch of words with smallest period q, of at least min_length words and
    exponent * q; exponent is 4 or more. Words stand with one space between them in `collapsed`.
    Null, empty and wordless texts have no words, no runs and an empty text; repeated rows give
    equal rows, and rows without a doc_id keep it null. A text of any length is searched whole.
    """
    if exponent < 4 or min_length < 2:
        raise ValueError("exponent must be 4 or more, min_length 2 or more")
    tune(docs.sparkSession)
    return texts(docs).mapInArrow(lambda it: _batches(it, min_length, exponent), _SCHEMA)


def plant(docs: DataFrame) -> DataFrame:
    """docs, a tenth of whose rows (crc32 of doc_id as text divisible by 10) go round in circles from some word on.

    With g = crc32 / 10, word a = g % n and after become the words from a repeated every
    p = 1 + floor((n - a) / (3 + g % 8)). Rows without doc_id, words or that remainder stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    staged = texts(docs).withColumn("g", F.floor(h / 10)).withColumn("words", F.when(h % 10 == 0, split)).withColumn("n", F.size("words"))
    staged = staged.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    staged = staged.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    circle = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    again = F.concat_ws(" ", F.slice("words", F.lit(1), F.col("a")), F.slice(circle, F.lit(1), F.col("n") - F.col("a")))
    return staged.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Of the rows of periodic_runs(): n_runs, the run of greatest exponent, and hashes of the runs and of the collapsed text.

    Ties go to the smallest start, then the smallest period; without runs its four columns are null.
    """
    better = lambda a, x: F.when(a.isNull() | (x.length * a.period > a.length * x.period), x).otherwise(a)
    best = F.reduce("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), better)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
