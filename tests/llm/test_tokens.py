"""Alignment, token counts and periodic runs against brute force and the tokenizer libraries."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from resolvent.llm import align, periodic, tokencount

JSON, MODEL, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
ODD = [
    None, "", " ", " \t\n", "a", "It's they'll WE'RE don't 'S x's", "naïve café ÅNGSTRÖM İstanbul ΣΑΣ ΣΣ ß ﬁ Ǆ", "日本語のテキスト 漢字かな 한국어 ไทย العربية", "x y　z q\x1cr\x85s",
    "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|> <|end<|endoftext|>", "<|endoftext|>́x", "▁ low ▁line", "🙂🙃 👩‍👩‍👧 zwj", "tabs\tand\r\nlines\n\n\n  spaces   ", "1234567890 3.14 1/2 ½ ²", "aaaa" * 700, "xyzzy" * 300, "é" * 700, "\x00\x01\x7f nul",
    "aaa aaaa aaaaa aaaaaa lalalala hahahahaha", "!!!??...---___***", "مرحبا " * 50, "́ lone mark", "ab​cd﻿ef",
]


@pytest.fixture(scope="module")
def odd(spark, texts):
    rng = random.Random(9)
    alphabet = "aabbcde éßΣ漢 \t\n'.,<|>09🙂́ ABC"
    found = [*ODD, *[t for _, t in texts], *["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(150)]]
    rows = [(k, t) for k, t in enumerate(found)] + [(3, "again and again"), (3, "again and again"), (None, "no id here, no id")]
    return rows, spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, n_tokens int, runs string, key int").repartition(5)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---------------------------------------------------------------- token counts


def test_counts_are_the_librarys(odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    rows, docs = odd
    n = [len(t.encode(x or "", add_special_tokens=False).ids) for _, x in rows]
    want = sorted([(d, len((x or "").encode()), k, k > 20) for (d, x), k in zip(rows, n)], key=str)
    assert got(tokencount.count_tokens(docs, WORD, 20)) == want


def test_counts_when_nothing_is_remembered(odd, monkeypatch):
    make = tokencount.counter(WORD).make
    memory = tokencount.Remembering(make, most=3)
    for _, x in odd[0]:
        chunks = (x or "").encode().split()
        memory.learn(set(chunks))
        assert sum(memory[c] for c in chunks) == sum(make(list(chunks)))


def test_ragged_rounds_agree_with_the_heap():
    import json

    ragged = tokencount.RaggedCounter(json.load(open(WORD, encoding="utf-8")))
    rng = random.Random(4)
    words = ["".join(rng.choice("aeilnorst"[: rng.randint(1, 9)]) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    assert ragged.count(words) == [ragged._long(ragged.symbols(w)) for w in words]
    assert ragged.count([]) == []


def test_counts_refuse_merges_out_of_order():
    model = {"type": "BPE", "vocab": {"a": 0, "b": 1, "c": 2, "ab": 3, "abc": 4}, "merges": [["ab", "c"], ["a", "b"]]}
    with pytest.raises(ValueError):
        tokencount.RaggedCounter({"model": model})


# ---------------------------------------------------------------- alignment


def aligned(rows):
    """Plain Python: both tokenizers' own libraries, sets of end offsets, dictionaries."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    a_tok, b_tok = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a_tok.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 400))
    back = {chr(b if b in plain else next(rest)): b for b in range(256)}
    spell_a = {i: bytes(back.get(c, 0) for c in t) for t, i in json.load(open(JSON, encoding="utf-8"))["model"]["vocab"].items()}

    def spell_b(i):
        p = b_tok.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()

    found = []
    for d, text in rows:
        groups, a, b = [], [], []
        if text:
            a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
            data = b" " + text.encode()
            if b"".join(map(spell_a.get, a)) != data or b"".join(map(spell_b, b)) != data:
                a, b = [], []
            a_at, b_at, left_a, left_b, x, y = 0, 0, [], [], list(a), list(b)
            while x or y:
                if a_at <= b_at and x:
                    left_a.append(x.pop(0))
                    a_at += len(spell_a[left_a[-1]])
                else:
                    left_b.append(y.pop(0))
                    b_at += len(spell_b(left_b[-1]))
                if a_at == b_at:
                    groups.append((left_a, left_b))
                    left_a, left_b = [], []
        found.append((d, a, b, groups))
    n = Counter((p[-1], q[-1]) for *_, groups in found for p, q in groups)
    top = {}
    for (_, q), k in n.items():
        top[q] = max(k, top.get(q, 0))
    out = []
    for d, a, b, groups in found:
        counts = [(n[p[-1], q[-1]], top[q[-1]]) for p, q in groups]
        said = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        out.append((d, len(a), len(b), len(groups), len(groups), sum(x == t for x, t in counts), sum(x for x, _ in counts), hashlib.sha256(said.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


def test_alignment(odd):
    rows, docs = odd
    assert got(align.align(docs, JSON, MODEL)) == aligned(rows)


def test_alignment_in_small_partial_counts_and_shards(odd, monkeypatch):
    monkeypatch.setattr(align, "SHARD", 50)
    monkeypatch.setattr(align, "HELD", 5)
    monkeypatch.setattr(align, "GATHERED", 5)
    rows, docs = odd
    assert got(align.align(docs, JSON, MODEL)) == aligned(rows)
    table = align.alignments(docs, JSON, MODEL)
    packed = align.alignments(docs, JSON, MODEL, packed=True)
    counted = [tuple(r) for r in align.pair_counts(packed).collect()]
    assert counted == sorted(counted) and len({k for k, _ in counted}) == len(counted)
    assert sum(n for _, n in counted) == sum(len(r.a_sizes or ()) for r in table.collect())


def test_groups_spell_the_text(odd):
    pair = align._pair(JSON, MODEL)
    for r in align.alignments(odd[1].where("doc_id < 60"), JSON, MODEL).collect():
        if r.a_ids is not None:
            assert sum(r.a_sizes) == len(r.a_ids) and sum(r.b_sizes) == len(r.b_ids) and len(r.a_sizes) == len(r.b_sizes)
            assert b"".join(pair.a_bytes[i] for i in r.a_ids) == b"".join(pair.b_bytes[i] for i in r.b_ids)


def test_run_sums_over_batches():
    import pyarrow as pa

    rng = random.Random(3)
    keys = sorted(rng.randint(0, 12) for _ in range(200))
    cuts = sorted(rng.sample(range(200), 30))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i:j], pa.int64()), pa.array([2] * (j - i), pa.int64())], names=["key", "n"]) for i, j in zip([0, *cuts], [*cuts, 200])]
    out = [(k, n) for b in align._run_sums(iter(batches)) for k, n in zip(b["key"].to_pylist(), b["n"].to_pylist())]
    assert out == sorted((k, 2 * n) for k, n in Counter(keys).items())


# ---------------------------------------------------------------- periodic runs


def brute_runs(w, min_length=6, exponent=4):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_length, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def periodic_words(rng):
    w = []
    for _ in range(rng.randint(1, 5)):
        kind = rng.random()
        unit = [rng.randint(0, 3) for _ in range(rng.randint(1, 7))]
        w += unit * rng.randint(2, 9) + unit[: rng.randint(0, len(unit))] if kind < 0.7 else [rng.randint(0, 30) for _ in range(rng.randint(0, 30))]
    return w


def test_runs_in_random_words():
    rng = random.Random(7)
    for _ in range(1500):
        w = periodic_words(rng)
        assert periodic.find_runs(w) == brute_runs(w)
        assert periodic.find_runs(w, 9, 5) == brute_runs(w, 9, 5)
    for n in range(12):
        for bits in range(2**n):
            w = [bits >> k & 1 for k in range(n)]
            assert periodic.find_runs(w) == brute_runs(w)


def test_masked_words_are_in_no_run():
    rng = random.Random(8)
    assert periodic.overlap() == 5 == min(max(6, 4 * q) - q for q in range(1, 50))
    assert all(periodic.overlap(m, e) == min(max(m, e * q) - q for q in range(1, 50)) for m in range(2, 40) for e in range(4, 9))
    docs = [periodic_words(rng) for _ in range(200)]
    starts = np.cumsum([0, *map(len, docs)])[:-1]
    stretches = periodic.segments(np.array([x for d in docs for x in d]), np.unique(starts[[len(d) > 0 for d in docs]]), 5)
    for at, d in zip(starts.tolist(), docs):
        for s, n, _ in brute_runs(d):
            assert any(lo <= at + s and at + s + n <= hi for lo, hi in stretches)


def planted(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_periodic_runs(odd):
    rows, docs = odd
    rows = rows + [(1000 + k, " ".join(map(str, periodic_words(random.Random(k))))) for k in range(400)]
    more = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(rows[-400:], "doc_id long, text string"))
    want = []
    for d, t in rows:
        w = planted(d, t)
        runs = brute_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = max(runs, key=lambda r: (r[1] * 5040 * 5040 // r[2], -r[0], -r[2]), default=None)
        for r in runs:
            assert (r[1] * best[2], -r[0]) <= (best[1] * r[2], -best[0]) or r[1] * best[2] < best[1] * r[2]
        said = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(said).hexdigest(), hashlib.sha256(kept).hexdigest()))
    found = periodic.digests(periodic.periodic_runs(periodic.plant(more)))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got(found) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 100


def test_periodic_runs_of_extra_columns(odd):
    found = periodic.periodic_runs(odd[1]).where("doc_id < 60").collect()
    assert found and all(" ".join((r.collapsed or "").split()) == r.collapsed for r in found if r.collapsed.isascii())


def test_empty_tables(empty):
    assert align.align(empty, JSON, MODEL).count() == 0
    assert tokencount.count_tokens(empty, WORD).count() == 0
    assert periodic.digests(periodic.periodic_runs(periodic.plant(empty))).count() == 0
