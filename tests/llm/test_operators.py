"""Every operator against brute force, an exact round trip or held-out accuracy; and its edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from resolvent.llm import bpe, common, graph, langid, licenses, media, packing, quality, rules, simhash, suffixes, windows

from . import brute

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


# ---------------------------------------------------------------- SimHash


def test_simhash(docs, texts):
    want = sorted(((d, *v) for d, v in brute.near_duplicates(texts).items()), key=str)
    assert rows(simhash.near_duplicates(docs)) == want


def test_simhash_dense_values(docs, texts, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", 1)
    want = sorted(((d, *v) for d, v in brute.near_duplicates(texts).items()), key=str)
    assert rows(simhash.near_duplicates(docs)) == want


@pytest.mark.parametrize("dense", [48, 0])
def test_links_lose_no_pair(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(12)} | {0, 1, (1 << 64) - 1}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, k) for k, x in enumerate(fps)], "fp long, node long")
    found = {tuple(sorted(r)) for r in simhash.links(nodes).collect()}
    assert found == {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 3}


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200), (200, 201)]
    found = dict(rows(graph.components(spark.createDataFrame(edges, "u long, v long"))))
    assert found == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 130)} | {201: 200}


@pytest.mark.parametrize("data, want", [
    ([(5, "a b c d"), (None, "a b c d")], [(5, 5), (None, 5)]), ([(None, "a b c"), (None, "a b c"), (None, "q r s t")], [(None, None)] * 3), ([((1 << 63) - 1, "x y z w"), (None, "unlike it at all, quite")], [((1 << 63) - 1, (1 << 63) - 1), (None, None)]),
])
def test_simhash_of_rows_without_ids(spark, data, want):
    got = simhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"))
    assert rows(got, "doc_id", "component_id") == sorted(want, key=str)


def test_a_row_without_id_bridges(spark, monkeypatch):
    """Fingerprints 0, 7 and 63: the outer two differ in six bits, and only the row between them has no id."""
    fps = spark.createDataFrame([(9, 0), (4, 63), (None, 7), (None, 0xFF << 50), (30, 0xFF << 20)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: fps)
    got = rows(simhash.near_duplicates(fps), "doc_id", "component_id")
    assert got == sorted([(9, 4), (4, 4), (None, 4), (None, None), (30, 30)], key=str)


def test_simhash_keeps_one_of_each_group(spark, docs, texts):
    twice = docs.unionByName(docs.where("doc_id < 30"))
    kept = simhash.without_near_duplicates(twice)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({c for _, c in brute.near_duplicates(texts).values()})


# ---------------------------------------------------------------- packing


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x in texts}
    windows_, cover = defaultdict(list), defaultdict(list)
    for d, start, n, crc, total, seq, offset in rows(packing.pack(docs, JSON, shard=8)):
        assert total == len(ids[d])
        assert zlib.crc32(np.array(ids[d][start : start + n], "<u4").tobytes()) == crc
        windows_[seq].append((offset, n))
        cover[d] += range(start, start + n)
    assert {d: sorted(c) for d, c in cover.items()} == {d: list(range(len(x))) for d, x in ids.items()}
    for found in windows_.values():
        found.sort()
        assert [o for o, _ in found] == [sum(n for _, n in found[:k]) for k in range(len(found))]
        assert sum(n for _, n in found) <= 1024


def test_sum_of_squares_is_the_rule():
    rng = random.Random(1)
    lengths = [rng.randint(1, 20) for _ in range(400)]
    where, fill = packing.sum_of_squares(lengths, 20)
    level, count = {}, [0] * 21
    for s, w in zip(lengths, where):
        def change(h):
            after = count.copy()
            after[h] -= h > 0
            after[h + s] += h + s < 20
            return sum(x * x for x in after[1:20])

        h = level.get(w, 0)
        allowed = [g for g in range(0, 21 - s) if g == 0 or count[g]]
        if s < 20:
            assert change(h) == min(map(change, allowed))
        count[h] -= h > 0
        level[w] = h + s
        count[h + s] += h + s < 20
    assert [level[k] for k in range(len(fill))] == fill


def test_levels_that_tie():
    """A 2 may go to level 6 or 7 of 10, with the same sum of squares: the fullest level wins."""
    assert packing.sum_of_squares([6, 7, 2], 10) == ([0, 1, 1], [6, 9])
    assert packing.sum_of_squares([1], 1) == ([0], [1]) and packing.sum_of_squares([], 8) == ([], [])


def test_packing_of_repeated_rows_and_null_ids(spark):
    data = [(1, "one two three")] * 40 + [(None, None)] * 40 + [(None, "x y " * 900)] * 3
    found = packing.pack(spark.createDataFrame(data, "doc_id long, text string"), JSON, shard=16)
    got = found.collect()
    assert sum(r.start == 0 for r in got) == len(data) and sum(r.length for r in got if r.doc_id is None and r.doc_tokens == 1) == 40
    shards = defaultdict(int)
    for r in got:
        shards[r.sequence_id >> 32] += 1
    assert max(shards.values()) <= 2 * 16
    fill = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024


def test_ids_are_those_of_tokenizers():
    from tokenizers import Tokenizer

    own, slow, rng = packing.Ids(JSON), Tokenizer.from_file(JSON), random.Random(11)
    alphabet = ["a", "the", "I'll", "'s", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u3000", "\u200b", "é", "e\u0301", "日本", "Ⅷ", "½", "٣", "🙂", "12", "3.5", "#!", "_", "İ", "<|endoftext|>", "\x00"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        assert own.whole(text) == np.array(slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
    for text in (" " * 100_000, " " * 100_000 + "x", "a" * 100_000, "ab\n" * 50_000, "!" * 50_000):
        assert own.whole(text) == np.array(slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_special_tokens_in_texts(spark):
    from tokenizers import Tokenizer

    text = "before <|endoftext|> after"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    n = len(Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids) + 1
    assert [r.length for r in packing.pieces(df, JSON).collect()] == [n]


# ---------------------------------------------------------------- licences


def test_licenses(spark, docs):
    lines = {1: "Licensed under the Apache License, Version 2.0.", 2: "Released under the MIT License.", 3: "This work is licensed under the GNU General Public License, version 3.", 4: "the driver was licensed under another name", 5: "All rights reserved.", 6: None, 7: ""}
    df = spark.createDataFrame([(k, None if v is None else f"first line\n{v}\nlast line") for k, v in lines.items()], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(df.unionByName(docs.select("doc_id", "text").where("doc_id > 50"))).collect()}
    assert [got[k] for k in range(1, 8)] == ["Apache-2.0", "MIT", "GPL", "none", "proprietary", "none", "none"]
    assert {r.license for r in licenses.scan(docs).where("license <> 'none'").collect()} == {"CC-BY-NC"}


def test_licenses_in_wrapped_paragraphs(spark, docs):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met"
    gpl = "This program is free software: you can redistribute it and/or modify\r\nit under the terms of the GNU General Public License"
    filled = " ".join(f"v{k}" for k in range(60)) + "\nAll rights\nreserved. " + " ".join(f"v{k}" for k in range(70, 130))
    parts = {1: mit, 2: bsd, 3: gpl, 4: filled, 5: "v1 v2\n\n" + mit + "\n" + bsd + "\n \nv3", 6: gpl.replace("GNU", "GNU Lesser") + "\nas published by the Free Software Foundation", 7: mit.replace("\n", "\n\n")}
    df = spark.createDataFrame(list(parts.items()), "doc_id long, text string").unionByName(docs.select("doc_id", "text").where("doc_id > 50"))
    got = {r.doc_id: (r.n_paragraphs, r.n_licensed, r.families) for r in licenses.scan(df).where("doc_id < 8").collect()}
    assert got == {1: (1, 1, "MIT"), 2: (1, 1, "BSD"), 3: (1, 1, "GPL"), 4: (1, 1, "proprietary"), 5: (3, 1, "BSD,MIT"), 6: (1, 1, "LGPL"), 7: (2, 0, "")}


def _plain_probabilities(model, words):
    """Of the weights alone, one word and one pair at a time, in exact order."""
    z = list(model.bias)
    grams = [zlib.crc32(w.encode()) & (1 << licenses.BITS) - 1 for w in words]
    for a, b in zip(words, words[1:]):
        h = (zlib.crc32(a.encode()) * 0x9E3779B97F4A7C15 + zlib.crc32(b.encode())) & (1 << 64) - 1
        grams.append((h * 0xD6E8FEB86659FD93 & (1 << 64) - 1) >> (64 - licenses.BITS))
    for g in grams:
        z = [x + y for x, y in zip(z, model.w[model.place[g]])]
    e = np.exp((np.array(z) - max(z)) / model.temperature)
    return e / e.sum()


def test_license_scan_against_a_plain_pass(docs, texts):
    """Every stretch of every paragraph scored by plain sums, every template compared, notice by notice."""
    model = licenses.Model(licenses.learn(docs))
    extra = [(2000, "one two three\n\nLicensed under the MIT\nlicense. And more words\n\n" + "w1 w2 " * 90 + "All rights reserved. " + "w3 w4 " * 60), (2001, "licensed under the old rules of the house")]
    rows_ = [*texts, *extra]
    got = dict(zip([d for d, _ in rows_], licenses.read(model, [t for _, t in rows_])))
    for d, t in rows_:
        paras = [[licenses.tokens(line) for line in p.split("\n")] for p in "\n".join(l if l.strip() else "\0" for l in (t or "").split("\n")).replace("\n\0", "\0").replace("\0\n", "\0").split("\0") if p]
        n, hits, suspects = got[d]
        assert n == len(paras)
        want, suspect = [], set()
        for k, lines in enumerate(paras):
            whole = [w for line in lines for w in line]
            parts = [p for line in lines if line and len(lines) > 1 for p in licenses.stretches(line)] + (licenses.stretches(whole) if whole else [])
            for part in parts:
                likely = 1 - _plain_probabilities(model, part)[-1]
                if likely >= licenses.LEAST:
                    suspect.add(k)
                for run in model.runs(part) if likely >= licenses.SCREEN else []:
                    p = _plain_probabilities(model, run)
                    name = model.classes[int(p.argmax())]
                    ok = name != licenses.UNKNOWN and p.max() >= licenses.LEAST and any(len(licenses.pairs(licenses.tokens(x)) & licenses.pairs(run)) >= licenses.CONFIRMED * len(licenses.pairs(licenses.tokens(x))) for x in licenses.TEMPLATES[name]) and licenses.told(name, run) in {licenses.told(name, licenses.tokens(x)) for x in licenses.TEMPLATES[name]} and run[0] not in licenses.DENIALS
                    want += [(k, name, p.max())] if ok else []
        assert [(k, f) for k, f, _ in hits] == [(k, f) for k, f, _ in want] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(hits, want))
        assert suspects == suspect - {k for k, _, _ in want}
    assert [f for _, f, _ in got[2000][1]] and {f for _, f, _ in got[2000][1]} == {"MIT", "proprietary"} and not got[2001][1]


def test_license_classifier_on_held_out_paragraphs(docs):
    """Notices of every family among words that training never put beside them are told from each other and from none."""
    model, rng = licenses.Model(licenses.learn(docs)), random.Random(12)
    filler = [f"v{k}" for k in range(300)]
    right = total = 0
    for family, notices in licenses.TEMPLATES.items():
        for t in notices:
            words = [*(rng.choice(filler) for _ in range(rng.randint(0, 30))), *licenses.tokens(t), *(rng.choice(filler) for _ in range(rng.randint(0, 30)))]
            p = model.probabilities([words])[0]
            right += model.classes[int(p.argmax())] == family and p[-1] < 0.5
            total += 1
    none = [[rng.choice(filler) for _ in range(60)] for _ in range(60)]
    assert right >= 0.9 * total and (model.probabilities(none)[:, -1] > 0.5).mean() >= 0.95


SIBLINGS = {
    "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL", "Released under the GNU Affero General Public License.": "AGPL", "This library is licensed under the GNU Lesser General Public License.": "LGPL",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License": "AGPL", "This work is licensed under the GNU General Public License, version 3.": "GPL",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA", "Licensed under CC BY-ND 4.0.": "CC-BY-ND", "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Licensed under CC BY 4.0.": "CC-BY",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "CC-BY-ND",
    "SPDX-License-Identifier: GPL-2.0-only": "GPL", "SPDX-License-Identifier: LGPL-3.0-only": "LGPL", "SPDX-License-Identifier: MPL-2.0": "MPL", "SPDX-License-Identifier: ISC": "ISC", "SPDX-License-Identifier: 0BSD": "0BSD",
    "Licensed under the ISC license.": "ISC", "Licensed under the Eclipse Public License.": "EPL", "This is free and unencumbered software released into the public domain.": "Unlicense", "Licensed under the zlib license.": "Zlib",
    "Not licensed under the MIT license.": "none", "This is not licensed under the MIT license.": "none", "It is no longer released under the BSD license.": "none",
}


def test_sibling_families_and_notices_taken_back(spark, docs):
    known = [(k, t) for k, t in enumerate(SIBLINGS)]
    df = spark.createDataFrame(known, "doc_id long, text string").unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    got = {r.doc_id: r.license for r in licenses.scan(df).where("doc_id < 1000").collect()}
    assert {t: got[k] for k, t in known} == SIBLINGS


def test_equal_license_scores_go_to_the_first_family(spark, monkeypatch):
    monkeypatch.setattr(licenses, "read", lambda model, found: [(1, [(0, "MIT", 0.9), (0, "BSD", 0.9), (0, "GPL", 0.8)], set()) for _ in found])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["x"])], names=["doc_id", "text"])
    out = next(licenses._scan(iter([batch]), None)).to_pylist()[0]
    assert (out["license"], out["families"], out["n_licensed"]) == ("BSD", "BSD,GPL,MIT", 1)


# ---------------------------------------------------------------- suffix arrays


def test_suffix_array():
    rng = np.random.default_rng(0)
    for trial in range(120):
        n, k = int(rng.integers(0, 70)), int(rng.integers(2, 6))
        t = np.append(np.tile(rng.integers(1, k, 3), n // 3 + 1) if trial % 4 == 0 else rng.integers(1, k, n), 0).astype(np.uint16)
        assert suffixes.suffix_array(t, k + 1).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


@pytest.mark.parametrize("alone", [1, 4, 2048])
def test_suffix_array_of_many_characters(monkeypatch, alone):
    """Names of any number are sorted by the same recursion; buckets go alone or together."""
    monkeypatch.setattr(suffixes, "ALONE", alone)
    rng = np.random.default_rng(7)
    for trial in range(60):
        n, k = int(rng.integers(2, 400)), int(rng.integers(2, [8, 60, 900][trial % 3]))
        t = np.append(np.tile(rng.integers(1, k + 1, 9), n // 9 + 1) if trial % 5 == 0 else rng.integers(1, k + 1, n), 0)
        assert suffixes.suffix_array(t, k + 1).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    long = np.append(np.tile(rng.integers(1, 5000, 700), 4), 0)
    assert suffixes.suffix_array(long, 5001).tolist() == sorted(range(len(long)), key=lambda i: long[i:].tolist())


def test_segments_hold_every_string_once():
    rng = random.Random(3)
    for data in (bytes(rng.randrange(256) for _ in range(5000)), b"ab" * 1000, b"x" * 399, b"x" * 400, b""):
        starts = [s + k for _, s, n in suffixes.segments(data) for k in range(n)]
        assert sorted(starts) == list(range(max(0, len(data) - 399)))


@pytest.mark.parametrize("shared", [1000, 2])
def test_suffix_dedup(docs, texts, monkeypatch, shared):
    monkeypatch.setattr(suffixes, "SHARED", shared)
    assert rows(suffixes.remove_repeats(docs)) == sorted(brute.repeated_bytes(texts), key=str)


def test_suffix_dedup_of_repeated_rows_and_null_ids(spark):
    long = " ".join(f"n{k}" for k in range(300))
    data = [(1, long), (1, long), (None, long), (None, None), (2, "short")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(suffixes.remove_repeats(df)) == sorted(brute.repeated_bytes(data), key=str)


@pytest.mark.parametrize("light", [1_000, 3])
def test_suffix_dedup_of_a_phrase_all_over_a_text(spark, monkeypatch, light):
    """A segment that a text has at many places is joined as one row of that text, heavy or not."""
    monkeypatch.setattr(common, "LIGHT", light)
    written, write = {}, suffixes.materialize

    def counted(df, name):
        out = write(df, name)
        written[name] = out.groupBy("doc_id", "gram", "seg").count().select(F.max("count")).first()[0] if name == "segments" else None
        return out

    monkeypatch.setattr(suffixes, "materialize", counted)
    data = [(k, f"start {k} " * 9 + "the same words " * 150 + f"end {k}") for k in range(12)] + [(50, "lone phrase " * 90), (51, " ".join(f"n{k}" for k in range(300)))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(suffixes.remove_repeats(df)) == sorted(brute.repeated_bytes(data), key=str)
    assert written["segments"] == 1


# ---------------------------------------------------------------- media


def test_media(docs, texts):
    got = {r.doc_id: r for r in media.text_media(docs).collect()}
    assert len(got) == len(texts)
    for d, t in texts:
        data = (t or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        m = media.to_media(data)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(m), hashlib.sha256(m).hexdigest(), media.feature(payload))
        assert media.from_media(m) == (len(data), payload) and (r.caption, r.position) == (str(d), 1)


def test_media_of_shared_digests(spark, monkeypatch):
    monkeypatch.setattr(common, "LIGHT", 2)
    data = [(k, None if k % 2 else "") for k in range(40)] + [(None, "same"), (None, "same"), (7, "same"), (100, "other")]
    got = media.text_media(spark.createDataFrame(data, "doc_id long, text string"))
    want = [(d, len(t or ""), 64, hashlib.sha256((t or "").encode().ljust(64, b"\0")).hexdigest(), str(d)) for d, t in data]
    assert rows(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "caption") == sorted(want, key=str)


def test_references_are_resolved_in_order(spark):
    m = media.to_media(b"payload")
    d = hashlib.sha256(m).hexdigest()
    pages = [(1, f"<p>one</p><img src='sha256:{d}' alt='a'>two<img src='sha256:{'0' * 64}'><img src='http://x/y.png' alt='c'>"), (2, None), (3, "")]
    store = spark.createDataFrame([(d, m), (d, m)], "digest string, media binary")
    got = media.resolve(media.sequences(spark.createDataFrame(pages, "page_id long, html string")), store)
    assert rows(got, "id", "position", "kind", "text", "caption", "n_bytes") == [(1, 0, "text", "one", None, None), (1, 1, "media", None, "a", 7), (1, 2, "text", "two", None, None), (1, 3, "media", None, None, None), (1, 4, "media", None, "c", None)]
    assert rows(media.page_items(spark.createDataFrame(pages, "page_id long, html string")), "page_id", "position") == [(1, k) for k in range(5)]


def test_sequences(spark):
    page = "<h1>Title &amp; more</h1><script>x<y</script><p>one<p>two <figure><img src='sha256:ab' alt='old'><figcaption>new <b>words</b></figcaption></figure>tail<img src=z alt=last>"
    got = media.sequence(page)
    assert [(x["position"], x["kind"], x["text"] or x["ref"], x["caption"]) for x in got] == [
        (0, "text", "Title & more", None), (1, "text", "one", None), (2, "text", "two", None), (3, "media", "sha256:ab", "new words"), (4, "text", "tail", None), (5, "media", "z", "last"),
    ]
    assert media.sequence(None) == media.sequence("") == []
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert {r.id: len(r.sequence) for r in media.sequences(df).collect()} == {1: 6, 2: 0}


def shown(page):
    return [(x["text"] or x["ref"], x["caption"]) for x in media.sequence(page)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<figure><figcaption>first</figcaption><img src=a alt=old></figure>more", [("a", "first"), ("more", None)]),
        ("<p>x</p><figure><img src=a><figcaption>open <b>one</b></figure><p>kept</p>", [("x", None), ("a", "open one"), ("kept", None)]),
        ("<figure><img src=a><figcaption>open<p>lost text</p><p>more", [("a", "open"), ("lost text", None), ("more", None)]),
        ("<figure><img src=a><figure><img src=b><figcaption>inner</figcaption></figure><figcaption>outer</figcaption></figure>", [("a", "outer"), ("b", "inner")]),
        ("<figure><figure><img src=b alt=t></figure><figcaption>outer</figcaption></figure>", [("b", "outer")]),
        ("<figcaption>alone</figcaption><p>x", [("alone", None), ("x", None)]),
        ("<figure><p>only text</p><figcaption>said</figcaption></figure>", [("only text", None), ("said", None)]),
        ("<figure><img src=a><figcaption>one</figcaption><figcaption>two<p>three</p></figcaption></figure>", [("a", "one two three")]),
        ("<picture><source srcset='b.webp 1x, c.webp 2x'><img data-src=d alt=e></picture><video poster=p src=v></video><img srcset=' '>", [("b.webp", None), ("d", "e"), ("p", None), ("v", None)]),
        ("</figure></figcaption>x<figure>", [("x", None)]),
        ("<figure><figcaption>a<figcaption>b<img src=m>", [("m", "a b")]),
    ],
)
def test_malformed_and_reordered_pages(page, want):
    assert shown(page) == want


# ---------------------------------------------------------------- substring dedup


def test_substring_dedup(docs, texts):
    assert rows(windows.remove_repeats(docs)) == sorted(brute.repeated_windows(texts), key=str)


def test_substring_dedup_of_repeated_rows_and_null_ids(spark):
    w = [f"n{k}" for k in range(60)]
    data = [(5, " ".join(w)), (5, " ".join(w)), (9, " ".join(["z", *w[10:40]])), (None, " ".join(w)), (7, " ".join(w[:13])), (8, " ".join(w[:12]))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(windows.remove_repeats(df)) == sorted(brute.repeated_windows(data), key=str)


def test_full_sketch_loses_nothing(docs, texts, monkeypatch):
    monkeypatch.setattr(windows, "sketch", lambda docs: (np.full(windows.ROWS << (windows.FEWEST - 3), 255, np.uint8), windows.FEWEST))
    assert rows(windows.remove_repeats(docs)) == sorted(brute.repeated_windows(texts), key=str)


def test_substring_dedup_with_heavy_keys(docs, texts, monkeypatch):
    monkeypatch.setattr(common, "LIGHT", 1)
    monkeypatch.setattr(common, "HEAVY", 1_000_000)
    assert rows(windows.remove_repeats(docs)) == sorted(brute.repeated_windows(texts), key=str)
    assert rows(suffixes.remove_repeats(docs)) == sorted(brute.repeated_bytes(texts), key=str)


@pytest.mark.parametrize("power", [20, 22])
def test_the_sketch_never_counts_less(docs, texts, power, monkeypatch):
    monkeypatch.setattr(windows, "FEWEST", power)
    bits, got = windows.sketch(docs)
    assert got == power
    holders = defaultdict(set)
    for d, t in texts:
        for h in windows.Runs(t).shingle.tolist():
            holders[h].add(d)
    twice = np.array([h for h, ids in holders.items() if len(ids) > 1], np.uint64)
    once = np.array([h for h, ids in holders.items() if len(ids) == 1], np.uint64)
    assert len(twice) and windows.estimated_repeated(bits, power, twice).all()
    assert windows.estimated_repeated(bits, power, once).mean() < 0.01


def test_texts_are_cut(docs, texts):
    got = windows.with_texts_cut(docs)
    assert got.columns == docs.columns and dict(got.dtypes) == dict(docs.dtypes)
    want = {d: (n, h) for d, _, n, h in brute.repeated_windows(texts)}
    for r in got.collect():
        n, h = want[r.doc_id]
        before = dict(texts)[r.doc_id]
        assert (r.text == before and r.n_chars == len(before or "")) if not n else (hashlib.sha256(r.text.encode()).hexdigest() == h and r.n_chars == len(r.text))
        assert (r.fp, r.key, r.marks) == (7, "k", "m")


# ---------------------------------------------------------------- quality


def _labelled(spark, n=400):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "ko", "ri", "te") for b in ("n", "l", "s", "m") for c in ("a", "o", "et")]
    data, labels = [], []
    for k in range(n):
        bad = k % 5 == 0
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 90))]
        data.append((k, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."))
        if k % 2 == 0:
            labels.append((k, 0 if bad else 1, 0))
    return spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = _labelled(spark)
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    held = [r for r in labels.collect() if got[r.doc_id].held_out]
    assert all(r.held_out == (brute.crc(d, 4) == 2) for d, r in got.items())
    assert sum(got[r.doc_id].predicted == r.quality for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert quality.with_quality(docs, labels).columns == docs.columns


def test_quality_never_learns_from_held_out_labels(spark):
    docs, labels = _labelled(spark)
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) == 2
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows(quality.score_quality(docs, labels)) == rows(quality.score_quality(docs, flipped))


def test_quality_where_every_document_is_labelled(spark):
    docs, _ = _labelled(spark)
    labels = spark.createDataFrame([(k, 0 if k % 5 == 0 else 1, 0) for k in range(400)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.with_quality(docs, labels).collect()}
    assert sum((k in kept) == (k % 5 != 0) for k in range(400)) >= 0.95 * 400


def test_prior_is_that_of_the_mixture():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.9):
        p, n = rng.normal(2, 1, (2000, 2)), rng.normal(-2, 1, (4000, 2))
        u = np.concatenate([rng.normal(2, 1, (int(4000 * share), 2)), n[: 4000 - int(4000 * share)]])
        assert abs(quality.estimated_prior(p, u) - share) < 0.06
    p, u, z = [3.0, 2.0, 1.0, 1.0], [3.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0], []
    room = np.sqrt(np.log(20) / 16) + np.sqrt(np.log(20) / 8)
    for t in sorted(set(p)):
        a, b = sum(x >= t for x in p) / 4, sum(x >= t for x in u) / 8
        z.append(((b + room) / a, b / a))
    assert quality.least_ratio(np.array(p), np.array(u)) == pytest.approx(min(z)[1])


def test_fit_lowers_the_non_negative_risk():
    """On one measurement: the fitted network's risk, by its formula, is near the least that any threshold has."""
    rng = np.random.default_rng(9)
    p, u = rng.normal(1.5, 1, (800, 1)), np.concatenate([rng.normal(1.5, 1, (480, 1)), rng.normal(-1.5, 1, (320, 1))])
    model = quality.Model(quality.fit(p, u, 0.6))

    def risk(sp, su):
        return 0.6 * (1 - sp).mean() + max(0.0, su.mean() - 0.6 * sp.mean())

    found = risk(*(1 / (1 + np.exp(-model.margin(x))) for x in (p, u)))
    least = min(risk((p > t).astype(float), (u > t).astype(float)) for t in np.linspace(-4, 4, 161))
    assert found <= least + 0.05  # the loss is soft, a threshold is not


def test_quality_of_repeated_rows_and_null_ids(spark):
    docs, labels = _labelled(spark)
    more = docs.unionByName(docs.where("doc_id < 50")).unionByName(spark.createDataFrame([(None, "x y z"), (None, None), (None, "x y z")], docs.schema))
    got = quality.score_quality(more, labels.unionByName(labels)).collect()
    assert len(got) == 453 and all((r.held_out is None) == (r.doc_id is None) for r in got)
    assert len({(r.doc_id, r.score) for r in got if r.doc_id is not None}) == 400 and len({r.score for r in got if r.doc_id is None}) == 2


def test_quality_without_labels_and_edge_texts(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.with_quality(docs, none).count() == docs.count()
    assert quality.score_quality(empty, none).count() == 0


# ---------------------------------------------------------------- language


def _languages(spark):
    rng = random.Random(6)
    kinds = {"aa": "bado keli suma torin vesta", "bb": "zwerg höhle müde straße groß", "cc": "qu'il était façon noël où"}
    data = []
    for k in range(180):
        lang = list(kinds)[k % 3]
        data.append((k, " ".join(rng.choice(kinds[lang].split()) for _ in range(rng.randint(8, 60))), lang if k % 4 else None))
    return data, spark.createDataFrame(data, "doc_id long, text string, lang string")


def test_language_on_held_out_rows(spark):
    data, df = _languages(spark)
    got = {r.doc_id: r for r in langid.predict_languages(df).collect()}
    assert all(r.held_out == (brute.crc(d, 3) == 1) for d, r in got.items())
    assert all(got[d].lang_pred == ["aa", "bb", "cc"][d % 3] for d, _, _ in data)


def test_language_edge_texts(spark, docs, empty):
    odd = spark.createDataFrame([(1000, None, "en"), (1001, "", "en"), (1002, "123 !?", "en"), (1003, "x", "en"), (1004, "ok " * 5000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict_languages(docs.select("doc_id", "text", "lang").unionByName(odd)).collect()}
    assert [got[k] for k in (1000, 1001, 1002)] == [("und", 0.0)] * 3 and got[1003][0] == got[1004][0] == "en"
    assert langid.predict_languages(empty).count() == 0
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.predict_languages(none).collect()} == {"und"} and langid.with_language(none).count() == 0


def test_a_rare_language_is_learned_beside_a_huge_one(spark):
    one = next(k for k in range(100, 200) if brute.crc(k, 3) != 1)
    data = [(one, "bado keli suma torin vesta " * 3, "aa")] * 5000 + [(k, "zwerg höhle müde straße groß " * 3, "zz") for k in range(90)]
    got = langid.predict_languages(spark.createDataFrame(data, "doc_id long, text string, lang string")).groupBy("lang_pred").count()
    assert dict(rows(got)) == {"aa": 5000, "zz": 90}


def test_stage_goes_by_the_predicted_language(spark):
    data, df = _languages(spark)
    odd = [(1000, None, "aa"), (1001, "12 %", "aa"), (1002, "xq zjv qkx wqzz vxj jqw zkq xvv " * 20, None), (1003, "keli suma " * 9, None), (None, "zwerg höhle", None)]
    more = df.unionByName(spark.createDataFrame(odd, df.schema))
    kept = langid.with_language(more)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns and sorted(ids, key=str) == sorted([*range(180), 1003, None], key=str)
    some = {r.doc_id for r in langid.with_language(more, ["bb"]).collect()}
    assert some == {None, *[d for d, _, _ in data if d % 3 == 1]}


def test_equal_rates_go_to_the_first_language(spark):
    data = [(k, "one same text " * 5, lang) for k, lang in enumerate(["bb", "aa"] * 30)] + [(None, "same text", "aa"), (5, "one same text " * 5, "aa")]
    got = langid.predict_languages(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == {"aa"} and len(got) == len(data) and all((r.held_out is None) == (r.doc_id is None) for r in got)


SCRIPTS = {
    "en": "the stone by the river was quiet and the lantern hung over amber water in winter",
    "ru": "тихий камень у реки и фонарь над янтарной водой зимой в старой гавани",
    "el": "η ήσυχη πέτρα δίπλα στο ποτάμι και το φανάρι πάνω από το νερό τον χειμώνα",
    "zh": "河边的石头很安静冬天灯笼挂在琥珀色的水面上旧港口里纸信号慢慢地亮着人们说着话走过桥去买米和茶",
    "ja": "川辺の石は静かで冬には琥珀色の水の上にランタンが吊るされ古い港では紙の信号がゆっくりと光っていた",
    "ko": "강가의 돌은 조용했고 겨울에는 호박빛 물 위에 등불이 걸려 있었다 오래된 항구에서",
}


def test_scripts_beside_one_another(spark):
    """Each language has an alphabet of its own: one script's letters don't crowd out another's."""
    rng = random.Random(3)
    cut = lambda t, n: "".join(t[i : i + 6] for i in (rng.randrange(max(1, len(t) - 6)) for _ in range(n)))
    data = [(100 * k + j, cut(t, 40), lang) for k, (lang, t) in enumerate(SCRIPTS.items()) for j in range(60)]
    got = {r.doc_id: r for r in langid.predict_languages(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert all(got[d].lang_pred == lang for d, _, lang in data if got[d].held_out) and sum(r.held_out for r in got.values()) > 80


def test_letters_beyond_the_own_classes_share_some():
    c = langid.Classes("".join(chr(0x4E00 + k) for k in range(900)))
    codes = np.arange(0x4E00, 0x4E00 + 1000)
    assert c.width <= 256 and set(c(codes[900:])) == {1} and min(c(codes[:900])) == 2 and len(set(c(codes[: langid.OWN]))) == langid.OWN


def test_cross_parsing_counts_greedy_phrases():
    rng = random.Random(8)
    sample = [rng.randint(0, 3) for _ in range(300)]
    table = langid.suffix_automaton(sample, 5)
    known = {tuple(sample[i:j]) for i in range(len(sample)) for j in range(i + 1, min(len(sample), i + 40) + 1)}
    for _ in range(20):
        text = [rng.randint(0, 4) for _ in range(rng.randint(1, 60))]
        n, i = 0, 0
        while i < len(text):
            j = i + 1
            while j < len(text) and tuple(text[i : j + 1]) in known:
                j += 1
            n, i = n + 1, j
        steps = np.array(text, np.uint8)[:, None]
        got = int(langid._phrases(table, 5, steps, np.ones(len(text), np.int64))[0]) + (tuple(text[:1]) in known)
        # a class that the sample lacks ends a phrase of its own
        lost = sum(c == 4 for c in text)
        assert n <= got + lost and got <= n + lost + 1


# ---------------------------------------------------------------- rules


def test_rules(docs, texts):
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    for d, t in texts:
        w = [x.decode() for x in brute.words(t)]
        lines = [x for x in (t or "").split("\n") if brute.words(x)]
        r = got[d]
        rep = brute.repeat_words(w)
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), rep, len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.base_failed == (len(w) < 10 or 100 * rep > 20 * len(w)) and r.kept == (r.failures == 0)


def test_rules_agree_with_the_sql(docs, texts):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(x) for x in texts])
    found = rules.judge(docs)
    assert rows(found) == sorted(con.execute(f"SELECT {', '.join(found.columns)} FROM ({rules.ORACLE})").fetchall(), key=str)


def test_ablation(docs):
    found = rules.ledger(docs)
    bits = [r.failures for r in found.collect()]
    for r in rules.ablation(found).collect():
        bit, mask = 1 << list(rules.RULES).index(r.rule), rules.mask(r.policy)
        assert (r.n_failed, r.n_only) == (sum(b & bit > 0 for b in bits), sum(b & mask == bit for b in bits))


# ---------------------------------------------------------------- BPE


def test_bpe(docs, texts):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    want = []
    for d, t in texts:
        ids = own.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows(bpe.encode_and_decode(docs, RANKS, public_tokenizers.PATTERN)) == sorted(want, key=str)


@pytest.mark.parametrize("text", ["", " ", "a\n \nb", "x  y", "x   y ", "\n ", "'s 't's   ", "ab" * 700, "日本語 テキスト　 x", "A \t B", "12 345 Ⅷ ½", "\x1c \x1d a", "<|endoftext|> x"])
def test_bpe_matches(text):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    memory = bpe.coder(RANKS, public_tokenizers.PATTERN)
    cut = bpe.chunks(text)
    memory.learn(cut)
    assert " ".join(memory[c][0].decode() for c in cut if memory[c][2]) == " ".join(map(str, own.encode_ordinary(text)))
    assert b"".join(memory[c][1] for c in cut) == text.encode()


# ---------------------------------------------------------------- all of them


ODD = ["my-col", "my col", "a.b", "back`tick", "TEXT", "Doc_Id", "row", "fp", "marks"]


@pytest.fixture(scope="module")
def odd(spark, texts):
    """The texts, some rows twice and without an id, with columns whose names need quotes or differ from others in case alone."""
    data = [*texts, *texts[5:9], *[(None, t) for _, t in texts[:12]]]
    one = spark.createDataFrame([(d, t, *["x"] * len(ODD)) for d, t in data], "doc_id long, text string, " + ", ".join(f"c{k} string" for k in range(len(ODD))))
    return one.toDF("doc_id", "text", *ODD)


def test_stages_with_odd_columns(spark, odd):
    labels = spark.createDataFrame([(3 * k + 1, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    tagged = odd.toDF("doc_id", "text", *ODD[:-1], "lang")
    for before, after in ((odd, simhash.without_near_duplicates(odd)), (odd, windows.with_texts_cut(odd)), (tagged, langid.with_language(tagged)), (odd, quality.with_quality(odd, labels))):
        assert after.columns == before.columns and 0 < after.count() <= before.count()
        assert {r[2] for r in after.collect()} == {"x"}


def test_queries_with_odd_columns_repeated_rows_and_null_ids(spark, odd, texts):
    labels = spark.createDataFrame([(3 * k + 1, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    tagged = odd.toDF("doc_id", "text", *ODD[:-1], "lang")
    n = len(texts) + 16
    found = [simhash.near_duplicates(odd), licenses.scan(odd), suffixes.remove_repeats(odd), media.text_media(odd), windows.remove_repeats(odd), quality.score_quality(odd, labels), langid.predict_languages(tagged), rules.judge(odd), bpe.encode_and_decode(odd, RANKS, public_tokenizers.PATTERN)]
    assert [df.count() for df in found] == [n] * len(found)
    for df in found[1:]:  # equal texts, equal values, whatever the id
        if "caption" in df.columns:
            df = df.drop("caption")
        by_id = defaultdict(set)
        for r in df.collect():
            by_id[r.doc_id].add(tuple(r))
        assert all(len(v) == 1 for d, v in by_id.items() if d is not None)
    assert packing.pack(odd, JSON).where("start = 0").count() == n


def test_empty_tables(spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = [simhash.near_duplicates(empty), packing.pack(empty, JSON), licenses.scan(empty), suffixes.remove_repeats(empty), media.text_media(empty), windows.remove_repeats(empty), rules.judge(empty), bpe.encode_and_decode(empty, RANKS, public_tokenizers.PATTERN)]
    assert [df.count() for df in found] == [0] * len(found)
    for kept in (simhash.without_near_duplicates(empty), windows.with_texts_cut(empty), langid.with_language(empty), quality.with_quality(empty, none)):
        assert kept.columns == empty.columns and kept.count() == 0
