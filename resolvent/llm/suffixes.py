"""Removes strings of 400 bytes that occur anywhere else: suffix arrays of shards by induced sorting.

A 400-byte string that occurs twice chooses, at both places, the same 32-byte gram in it: the one of
least hash. Neighbouring strings mostly share the gram, so a text falls into segments: the strings
that chose one gram, which each start in one segment only. Of segments with the very same bytes, one
stands for all: its strings are known to repeat, and others may still share them. A text that has a
segment at many places has one row for it, with all the places. Segments whose gram
different segments have as well are dealt to shards by gram, so equal strings meet in a shard; one
that has its gram for itself can share no string with another.

A shard concatenates its segments and sorts the suffixes by induction: suffixes are classified,
the leftmost-smaller substrings between them sorted, by several packed characters at a time, and
named, the order of their suffixes found recursively from the string of names, and all suffixes
induced from it. Common prefixes with the predecessor are computed in text order. The induction runs in numpy, many neighbouring
buckets at a time as long as none of them puts a suffix into another of them, else one bucket wave
by wave; the prefixes run over all segments in step.

Grams with very many different segments are dealt over several shards. There, each shard passes on
one representative of each of its different strings, packed by ranges of their hashes, and the
representatives of a range are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, heavy, join_split, materialize, texts, tune

SPAN, GRAM = 400, 32
_REACH = SPAN - GRAM + 1
#: Places of a bucket from which it is induced alone.
ALONE = 2_048
#: Bytes of segments in a shard on average, and different segments of one gram that share a shard.
SHARD_BYTES, SHARED = 1_500_000, 1_000


# ---------------------------------------------------------------- suffix arrays


def _deal(sa: np.ndarray, at: np.ndarray, items: np.ndarray, chars: np.ndarray, down: bool) -> None:
    """Appends items to the buckets of their chars, in order: upwards from at, or downwards."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    new = np.ones(len(c), bool)
    np.not_equal(c[1:], c[:-1], out=new[1:])
    first = np.flatnonzero(new)
    if len(first) == len(c):
        sa[at[c]] = items[order]
        at[c] += -1 if down else 1
        return
    size = np.append(first[1:], len(c)) - first
    rank = np.arange(len(c)) - np.repeat(first, size)
    place = at[c] - rank if down else at[c] + rank
    sa[place] = items[order]
    at[c[first]] += -size if down else size


def _together(sa: np.ndarray, at: np.ndarray, t: np.ndarray, keep: np.ndarray, group: np.ndarray, starts: np.ndarray, sizes: np.ndarray, down: bool) -> int:
    """Induces from as many of the first buckets of a group as put nothing into one another; -> how many.

    starts and sizes: two ranges of places for each bucket, read upwards, or downwards.
    """
    flat = sizes.ravel()
    before = np.cumsum(flat) - flat
    n = int(before[-1] + flat[-1])
    along = np.arange(n)
    items = sa[np.repeat(starts.ravel() + before, flat) - along if down else np.repeat(starts.ravel() - before, flat) + along]
    own = np.repeat(np.arange(len(group)), sizes.sum(axis=1))
    got = np.flatnonzero((items > 0) & keep[items - 1])  # of the end mark's own place, before all, keep says no
    if not len(got):
        return len(group)
    own, put = own[got], items[got] - 1
    to = t[put]
    furthest = (np.maximum if down else np.minimum).accumulate(to)
    last = np.searchsorted(own, np.arange(len(group)), side="right") - 1
    bound = furthest[np.maximum(last, 0)]
    apart = ((bound < group) if down else (bound > group)) | (last < 0)
    n = len(group) if apart.all() else int(apart.argmin())
    end = last[n - 1] + 1 if n else 0
    if end:
        _deal(sa, at, put[:end], to[:end], down)
    return n


def _induce(t: np.ndarray, small: np.ndarray, heads: np.ndarray, tails: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes, from the leftmost-smaller ones, given in their order. small[i]: suffix i is smaller than suffix i + 1.

    heads[c] is the first place of bucket c, tails[c] the one past its last.
    """
    sa = np.full(len(t), -1, np.int64)
    chars = t[lms]
    count = np.bincount(chars, minlength=len(heads))
    seeds = tails - count
    _deal(sa, seeds.copy(), lms, chars, False)
    head = heads.copy()
    used = np.flatnonzero(tails > heads)
    alone = np.append((tails - heads)[used] > ALONE, True)
    large, starts, sizes = ~small, np.stack([heads[used], seeds[used]], 1), np.stack([count[used]] * 2, 1)
    i, width = 0, 8
    while i < len(used):
        group = used[i : i + min(width, int(alone[i : i + width].argmax()) if alone[i : i + width].any() else width)]
        if len(group) > 1:  # larger ones of many buckets
            part = slice(i, i + len(group))
            sizes[part, 0] = head[group] - starts[part, 0]
            if n := _together(sa, head, t, large, group, starts[part], sizes[part], False):
                i += n
                width = min(2 * width, 8192) if n == len(group) else max(4, 2 * n)
                continue
        c = int(used[i])
        i, width = i + 1, 8
        start = heads[c]
        while start < head[c]:  # each wave may put more into this bucket
            wave = sa[start : head[c]]
            start = head[c]
            before = wave[wave > 0] - 1
            before = before[large[before]]
            if len(before):
                _deal(sa, head, before, t[before], False)
        wave = sa[seeds[c] : tails[c]]
        before = wave[wave > 0] - 1
        before = before[large[before]]
        if len(before):
            _deal(sa, head, before, t[before], False)
    tail = tails - 1
    used, alone = used[::-1], np.append(alone[:-1][::-1], True)
    starts, sizes = np.stack([tails[used], head[used]], 1) - 1, np.stack([head[used] - heads[used]] * 2, 1)
    i, width = 0, 8
    while i < len(used):
        group = used[i : i + min(width, int(alone[i : i + width].argmax()) if alone[i : i + width].any() else width)]
        if len(group) > 1:  # smaller ones of many buckets
            part = slice(i, i + len(group))
            sizes[part, 0] = starts[part, 0] - tail[group]
            if n := _together(sa, tail, t, small, group, starts[part], sizes[part], True):
                i += n
                width = min(2 * width, 8192) if n == len(group) else max(4, 2 * n)
                continue
        c = int(used[i])
        i, width = i + 1, 8
        end = tails[c] - 1
        while end > tail[c]:
            wave = sa[tail[c] + 1 : end + 1][::-1]
            end = tail[c]
            before = wave[wave > 0] - 1
            before = before[small[before]]
            if len(before):
                _deal(sa, tail, before, t[before], True)
        wave = sa[heads[c] : head[c]][::-1]
        before = wave[wave > 0] - 1
        before = before[small[before]]
        if len(before):
            _deal(sa, tail, before, t[before], True)
    sa[0] = len(t) - 1  # the end mark, smaller than all, which no suffix puts there
    return sa


def _names(t: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The rank of each substring from one leftmost-smaller place to the next, equal ones alike.

    Compared are characters, the larger type before the smaller; so no substring is the start of
    another. As many of them as fit in 62 bits are packed; only ties go on to the next ones.
    """
    bits = int(2 * k - 1).bit_length()
    step = 62 // bits
    length = np.append(np.diff(lms), 0) + 1
    end = len(t) - 1

    def key(which: np.ndarray, d: int) -> np.ndarray:
        at, left = lms[which] + d, length[which] - d
        out = np.zeros(len(which), np.int64)
        for j in range(step):
            place = np.minimum(at + j, end)
            out = (out << bits) | np.where(j < left, 2 * t[place].astype(np.int64) + small[place], 0)
        return out

    first = key(np.arange(len(lms)), 0)
    order = np.argsort(first, kind="stable")
    first = first[order]
    new = np.ones(len(lms), bool)
    new[1:] = first[1:] != first[:-1]
    d = step
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        at = at[length[order[at]] > d]
        if not len(at):
            break
        group, items = np.cumsum(new)[at], order[at]
        more = key(items, d)
        by = np.lexsort((more, group))
        order[at] = items[by]
        more, group = more[by], group[by]
        new[at[1:]] |= (more[1:] != more[:-1]) & (group[1:] == group[:-1])
        d += step
    names = np.empty(len(lms), np.int64)
    names[order] = np.cumsum(new) - 1
    return names


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """The suffix array of t, whose characters are 0..k-1 and whose last one, 0, occurs nowhere else."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    # a suffix is smaller than the next if its first character that differs from its successor is smaller
    step = np.sign(np.diff(t.astype(np.int64)))
    small = np.ones(n, bool)
    at = np.where(step != 0, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    small[:-1] = step[np.minimum(nxt, n - 2)] > 0
    is_lms = small.copy()
    is_lms[0] = False
    is_lms[1:] &= ~small[:-1]
    lms = np.flatnonzero(is_lms)
    counts = np.bincount(t, minlength=k)
    tails = np.cumsum(counts)
    if len(lms) > 1:
        names = _names(t, small, lms, k)
        kinds = int(names.max()) + 1
        if kinds == len(lms):
            order = np.empty(len(lms), np.int64)
            order[names] = np.arange(len(lms))
        else:
            order = suffix_array(names, kinds)
        lms = lms[order]
    return _induce(t, small, tails - counts, tails, lms)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the stretches: the common prefix with the suffix before it in sa, up to most; and that suffix.

    Text order lets a prefix start from its left neighbour's less one. The stretches run in step.
    """
    before = np.full(len(t), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(len(t), np.int32)
    order = np.argsort(starts - ends, kind="stable")
    i, stop = starts[order].astype(np.int64), ends[order].astype(np.int64)
    size = np.zeros(len(i), np.int64)
    last = len(t) - 1
    while len(i):
        j = before[i]
        more = (j >= 0) & (size < most)
        p, q = np.minimum(i + size, last), np.minimum(j + size, last)
        more &= (t[p] == t[q]) & (p != q) & (i + size < last) & (j + size < last)
        size += more
        done = ~more
        out[i[done]] = size[done]
        i += done
        size = np.where(done, np.maximum(size - 1, 0), size)
        if (i >= stop).any():
            live = i < stop
            i, stop, size = i[live], stop[live], size[live]
    return out, before


def repeated_starts(segments: list[bytes], again: list[bool]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """For each segment, which of its strings of SPAN bytes occur again: all, if it is marked so, else those found among the segments.

    Also the leaders: the segment and place of one string of each class of equal strings, and
    whether it occurs again.
    """
    sizes = np.array([len(s) for s in segments], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    t = np.zeros(int(sizes.sum()) + len(sizes) + 1, np.uint16)
    flat = np.frombuffer(b"\0".join(segments), np.uint8)
    t[: len(flat)] = flat.astype(np.uint16) + 2
    t[starts[1:] - 1] = 1
    t[len(flat)] = 1
    sa = suffix_array(t, 258)
    counts = np.maximum(sizes - SPAN + 1, 0)
    prefix, before = permuted_prefixes(t, sa, starts, starts + counts, SPAN)
    same = prefix >= SPAN
    hit = same.copy()
    hit[before[np.flatnonzero(same)]] = True
    own = np.repeat(np.arange(len(segments)), counts)
    at = starts[own] + np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
    hit[at[np.array(again, bool)[own]]] = True
    leads = ~same[at]
    return [hit[s : s + c] for s, c in zip(starts.tolist(), counts.tolist())], own[leads], (at - starts[own])[leads], hit[at[leads]]


# ---------------------------------------------------------------- segments


def _mixing() -> tuple[np.ndarray, list[np.uint64]]:
    rng = np.random.default_rng(400)
    return rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), [np.uint64(x | 1) for x in rng.integers(0, 2**63, 6).tolist()]


_OF_BYTE, _FACTORS = _mixing()
_AT = np.uint64((1 << 24) - 1)
#: Strings looked at together; a segment may end with them.
_CHUNK = 1 << 22


def segments(data: bytes) -> list[tuple[int, int, int]]:
    """(gram, first start, number of starts) of each segment; every start of a SPAN-byte string is in one."""
    out = []
    for base in range(0, len(data) - SPAN + 1, _CHUNK):
        b = np.frombuffer(data[base : base + _CHUNK + SPAN - 1], np.uint8)
        h, width = _OF_BYTE[b], 1
        for f in _FACTORS[:5]:
            h = h[:-width] * f + h[width:]
            width *= 2
        h ^= h >> np.uint64(29)
        h *= _FACTORS[5]
        key = (h & ~_AT) | np.arange(len(h), dtype=np.uint64)
        n = len(h) - _REACH + 1
        rows = -(-len(key) // _REACH)
        block = np.full(rows * _REACH, np.uint64(2**64 - 1))
        block[: len(key)] = key
        block = block.reshape(rows, _REACH)
        ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
        behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        chosen = np.minimum(behind[:n], ahead[_REACH - 1 : _REACH - 1 + n]) & _AT
        first = np.flatnonzero(np.diff(chosen.astype(np.int64), prepend=-1))
        count = np.diff(first, append=n)
        grams = h[chosen[first].astype(np.int64)].view(np.int64)
        out += list(zip(grams.tolist(), (first + base).tolist(), count.tolist()))
    return out


def _data(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


_SIGN = 1 << 63


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= _SIGN else x


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different segment of a text, with all places where it starts there."""
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32()), pa.int32()]
    names = ["gram", "seg", "doc_id", "text_hash", "starts", "n"]
    for b in batches:
        out: list[list] = [[] for _ in names]
        for key, text_hash, t in zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), b.column("text").to_pylist()):
            data, places = _data(t), {}
            for gram, start, n in segments(data):
                places.setdefault((gram, _signed(xxhash.xxh3_64_intdigest(data[start : start + n + SPAN - 1])), n), []).append(start)
            for (gram, seg, n), starts in places.items():
                for column, v in zip(out, (gram, seg, key, text_hash, starts, n)):
                    column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["shard", "gram", "seg", "again", "parts", "data"], [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
    for b in batches:
        out: list[list] = [[] for _ in names]
        for t, wanted in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist()):
            data = _data(t)
            for w in wanted:
                for column, v in zip(out, (w["shard"], w["gram"], w["seg"], w["again"], w["parts"], data[w["start"] : w["start"] + w["n"] + SPAN - 1])):
                    column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


_FOUND = "gram long, seg long, runs array<int>, range int, leaders binary"
_LEADER = np.dtype([("w1", "<i8"), ("w2", "<i8"), ("seg", "<i8"), ("place", "<i4"), ("again", "<i4")])


def _runs(hit: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0)).tolist()


def _table(rows: list[tuple]) -> pa.Table:
    kinds = {"gram": pa.int64(), "seg": pa.int64(), "runs": pa.list_(pa.int32()), "range": pa.int32(), "leaders": pa.binary()}
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def _shard(found: pa.Table) -> pa.Table:
    """The repeated strings of a shard's segments; of grams dealt over shards, also the leaders of classes, by ranges of their hashes."""
    seen: dict[tuple[int, int], tuple] = {}
    for gram, seg, *rest in zip(*(found.column(c).to_pylist() for c in ("gram", "seg", "again", "parts", "data"))):
        seen.setdefault((gram, seg), tuple(rest))
    keys, (again, parts, data) = list(seen), (list(x) for x in zip(*seen.values()))
    hits, lead, place, known = repeated_starts(data, again)
    rows = [(*k, _runs(hit), None, None) for k, hit in zip(keys, hits) if hit.any()]
    wide = np.array(parts)[lead] > 1
    packed: dict[tuple[int, int], list[tuple]] = {}
    for s, p, m in zip(lead[wide].tolist(), place[wide].tolist(), known[wide].tolist()):
        w = xxhash.xxh3_128_intdigest(data[s][p : p + SPAN])
        gram, seg = keys[s]
        packed.setdefault((gram, (w & 0xFFFFFFFF) % parts[s]), []).append((_signed(w >> 64), _signed(w & (1 << 64) - 1), seg, p, m))
    return _table(rows + [(gram, None, None, k, np.array(x, _LEADER).tobytes()) for (gram, k), x in packed.items()])


def _merge(found: pa.Table) -> pa.Table:
    """Leaders of one gram and range of hashes: those that no string of their own shard repeats, but another shard's leader does."""
    gram = found.column("gram")[0].as_py()
    x = np.concatenate([np.frombuffer(b, _LEADER) for b in found.column("leaders").to_pylist()])
    x = x[np.lexsort((x["w2"], x["w1"]))]
    same = (x["w1"][1:] == x["w1"][:-1]) & (x["w2"][1:] == x["w2"][:-1])
    hit = np.zeros(len(x), bool)
    hit[1:] |= same
    hit[:-1] |= same
    x = x[hit & (x["again"] == 0)]
    x = x[np.lexsort((x["place"], x["seg"]))]
    first = np.flatnonzero(np.diff(x["seg"], prepend=x["seg"][:1] - 1 if len(x) else 0)) if len(x) else []
    rows = []
    for s, e in zip(first, [*first[1:], len(x)]):
        mask = np.zeros(int(x["place"][e - 1]) + 1, bool)
        mask[x["place"][s:e]] = True
        rows.append((gram, int(x["seg"][s]), _runs(mask), None, None))
    return _table(rows)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for b in batches:
        out: list[list] = [[], [], [], []]
        for t, found in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            data = _data(t)
            n, gone, spans = len(data), 0, 0
            if found:
                delta = np.zeros(n + 1, np.int32)
                for f in found:
                    at = np.array(f["starts"], np.int64)[:, None, None] + np.array(f["runs"], np.int64).reshape(-1, 2)
                    np.add.at(delta, at[..., 0], 1)
                    np.add.at(delta, at[..., 1] + SPAN - 1, -1)
                stay = np.cumsum(delta[:-1]) == 0
                gone, spans = int(n - stay.sum()), int((np.diff(stay.astype(np.int8), prepend=1) < 0).sum())
                data = np.frombuffer(data, np.uint8)[stay].tobytes()
            for column, v in zip(out, (n, gone, spans, hashlib.sha256(data).hexdigest())):
                column.append(v)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3])], names=names)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row's whole text as UTF-8.

    Null and empty texts have no bytes; texts of fewer than SPAN bytes lose none. Rows that repeat
    a doc_id or a text are documents of their own: strings of 400 bytes that they share go from
    both. Rows without a doc_id take part like any other.
    """
    tune(docs.sparkSession)
    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    cut = materialize(rows.where("text is not null").mapInArrow(_cut, "gram long, seg long, doc_id long, text_hash long, starts array<int>, n int"), "segments")
    kinds = cut.groupBy("gram", "seg").agg(F.count("*").alias("c"), F.sum(F.size("starts")).alias("places"), F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.first(F.col("starts")[0]).alias("start"), F.first("n").alias("n"))
    kinds = materialize(kinds, "kinds")
    n_cut, n_kinds = kinds.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    common = heavy(kinds, ["gram", "seg"], "c", n_cut)
    grams = materialize(kinds.groupBy("gram").agg(F.sum("places").alias("total"), F.count("*").alias("kinds")).where("total > 1").select("gram", "kinds"), "grams")
    wide = heavy(grams, ["gram"], "kinds", n_kinds)
    wanted = join_split(kinds, grams, ["gram"], wide).withColumn("again", F.col("places") > 1).withColumn("parts", F.ceil(F.col("kinds") / SHARED).cast("int"))
    wanted = materialize(wanted, "wanted")
    own = wanted.where("kinds = 1").select("gram", "seg", F.array(F.lit(0), F.col("n")).alias("runs"))
    mixed = wanted.where("kinds > 1")
    size = mixed.agg(F.sum(F.col("n") + SPAN)).first()[0] or 0
    shards = int(size // SHARD_BYTES) + 1
    salt = F.when(F.col("parts") > 1, F.pmod("seg", F.col("parts"))).otherwise(0)
    entry = F.struct(F.pmod(F.xxhash64("gram", salt), F.lit(shards)).alias("shard"), "gram", "seg", "again", "parts", "start", "n")
    by_doc = mixed.groupBy("doc_id", "text_hash").agg(F.collect_list(entry).alias("wanted"))
    key = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))
    fetched = rows.alias("r").join(by_doc.alias("w"), key("r", "w")).select("text", "wanted").mapInArrow(_fetch, "shard long, gram long, seg long, again boolean, parts int, data binary")
    found = materialize(fetched.groupBy("shard").applyInArrow(_shard, _FOUND), "repeated")
    merged = found.where("leaders is not null").select("gram", "range", "leaders").groupBy("gram", "range").applyInArrow(_merge, _FOUND)
    runs = found.where("runs is not null").select("gram", "seg", "runs").unionByName(merged.select("gram", "seg", "runs")).groupBy("gram", "seg").agg(F.flatten(F.collect_list("runs")).alias("runs")).unionByName(own)
    # a set: rows that repeat a doc_id and a text say the same
    spans = join_split(cut, runs, ["gram", "seg"], common).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("starts", "runs")).alias("spans"))
    spans = materialize(spans, "spans")
    discard(cut, kinds, common, grams, wide, wanted, found)
    return rows.alias("r").join(spans.alias("w"), key("r", "w"), "left").select("r.doc_id", "text", "spans").mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT r, p, sha256(array_slice(b, p, p + 399)) AS k FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS p FROM d WHERE octet_length(b) >= 400)),
hit AS (SELECT r, p FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)),
island AS (SELECT r, p, sum(CASE WHEN p > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS g FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM hit)),
span AS (SELECT r, min(p) AS s, max(p) + 399 AS e FROM island GROUP BY r, g),
piece AS (SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) + 1 AS a, s - 1 AS z FROM span UNION ALL SELECT d.r, coalesce(max(e), 0) + 1, max(octet_length(b)) FROM d LEFT JOIN span USING (r) GROUP BY d.r),
kept AS (SELECT r, string_agg(CASE WHEN z >= a THEN hex(array_slice(b, a, z)) ELSE '' END, '' ORDER BY a) AS h FROM piece JOIN d USING (r) GROUP BY r),
sums AS (SELECT r, sum(e - s + 1)::BIGINT AS gone, count(*) AS n FROM span GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(h)) AS kept_sha256 FROM d JOIN kept USING (r) LEFT JOIN sums USING (r)
"""
