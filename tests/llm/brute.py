"""Plain Python versions of the operators, for small inputs."""

import hashlib
import zlib
from collections import defaultdict

import xxhash


def words(text):
    return (text or "").encode().split()


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_duplicates(rows):
    """[(doc_id, text)] -> {doc_id: (fingerprint, component)}; doc_ids are distinct."""
    fp = {d: fingerprint(t) for d, t in rows}
    parent = {d: d for d in fp}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (f"{fp[d]:016x}", root(d)) for d in ids}


def repeated_windows(rows, size=13):
    """[(doc_id, text)] -> [(doc_id, n_words, n_removed, kept_sha256)]"""
    least = {}
    for d, t in rows:
        w = words(t)
        if d is not None:
            for i in range(len(w) - size + 1):
                k = tuple(w[i : i + size])
                least[k] = min(least.get(k, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        if d is not None:
            for i in range(len(w) - size + 1):
                if least[tuple(w[i : i + size])] < d:
                    gone.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def repeated_bytes(rows, size=400):
    """[(doc_id, text)] -> [(doc_id, n_bytes, n_removed, n_spans, kept_sha256)]"""
    seen = defaultdict(int)
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        for i in range(len(b) - size + 1):
            seen[b[i : i + size]] += 1
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_words(w, size=5):
    count = defaultdict(int)
    for i in range(len(w) - size + 1):
        count[tuple(w[i : i + size])] += 1
    gone = set()
    for i in range(len(w) - size + 1):
        if count[tuple(w[i : i + size])] > 1:
            gone.update(range(i, i + size))
    return len(gone)


def crc(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus
