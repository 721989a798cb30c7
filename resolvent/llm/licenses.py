"""License scans: a trained paragraph classifier whose predictions are confirmed against templates.

A paragraph is a run of lines that aren't blank, so a notice may be wrapped at any word. Its lines
are read one by one, and its words, across lines, in overlapping stretches of LONGEST. Every line and stretch is scored: its word unigrams and bigrams,
hashed into slots, feed a multinomial logistic regression over licence families and an unknown
class. It is trained here, on variations of the templates among words of the corpus, on scraps of
templates, and on a bounded sample of the corpus's own paragraphs as unknown; its temperature is
fitted on examples that it was not trained on. Where the families together reach SCREEN, templates
are compared: the shortest run of words with CONFIRMED of a template's bigrams is scored
on its own, runs that overlap as one, and its family counts if one of the family's own templates is
confirmed in it. Siblings (the GNU and the Creative Commons licences) differ in single words, which a template alone
would tolerate: a family doesn't count if such a word of another stands in the run, nor if a word like "not" stands before it. A paragraph with a line or stretch that is likelier licensed than not but confirms
no template is suspect, and counted as that.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, tune

UNKNOWN, NONE = "unknown", "none"
#: Sampled documents whose paragraphs teach the unknown class, characters of each; words per stretch and from one to the next: a notice of LONGEST - STRIDE words is whole in one; confirmation; least probability, and that from which templates are compared.
SAMPLE_DOCS, ROW_CHARS, LONGEST, STRIDE, CONFIRMED, LEAST, SCREEN = 300, 2_000, 48, 16, 0.8, 0.5, 0.0005
#: Slots of hashed n-grams as a power of two; variations of a template, and examples of no licence, that are trained on.
BITS, VARIATIONS, OTHERS, STEPS = 18, 24, 900, 160
_MASK = (1 << BITS) - 1
#: Words whose codes a worker remembers.
REMEMBERED = 500_000



def _spdx(*names: str) -> tuple[str, ...]:
    return tuple(f"SPDX-License-Identifier: {n}" for n in names)


def _creative(short: str, long: str) -> tuple[str, ...]:
    return (f"Licensed under CC {short} 4.0.", f"This work is licensed under a Creative Commons Attribution{long} 4.0 International License.", *_spdx(f"CC-{short}-4.0"))


def _gnu(kind: str, short: str, *versions: str) -> tuple[str, ...]:
    said = f"GNU {kind}General Public License"
    return (
        f"This work is licensed under the {said}, version 3.", f"This library is licensed under the {said}.", f"Released under the {said}.", f"under the terms of the {said} as published by the Free Software Foundation",
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {said}", *_spdx(*[f"{short}-{v}-{end}" for v in versions for end in ("only", "or-later")]),
    )


#: Short notices by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "0BSD": ("Licensed under the Zero-Clause BSD license.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", *_spdx("0BSD")),
    "AGPL": _gnu("Affero ", "AGPL", "3.0"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", *_spdx("Apache-2.0"),
    ),
    "BSD": (
        "Released under the BSD license.", "Licensed under the BSD license.", "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", *_spdx("BSD-3-Clause", "BSD-2-Clause"),
    ),
    "CC-BY": _creative("BY", ""),
    "CC-BY-NC": _creative("BY-NC", "-NonCommercial"),
    "CC-BY-NC-ND": _creative("BY-NC-ND", "-NonCommercial-NoDerivatives"),
    "CC-BY-NC-SA": _creative("BY-NC-SA", "-NonCommercial-ShareAlike"),
    "CC-BY-ND": _creative("BY-ND", "-NoDerivatives"),
    "CC-BY-SA": _creative("BY-SA", "-ShareAlike"),
    "EPL": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License.", *_spdx("EPL-2.0")),
    "GPL": _gnu("", "GPL", "2.0", "3.0"),
    "ISC": ("Licensed under the ISC license.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", *_spdx("ISC")),
    "LGPL": _gnu("Lesser ", "LGPL", "2.1", "3.0"),
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", *_spdx("MIT"),
    ),
    "MPL": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", *_spdx("MPL-2.0")),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", *_spdx("Unlicense")),
    "Zlib": ("Licensed under the zlib license.", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", *_spdx("Zlib")),
    "proprietary": ("All rights reserved.", "Copyright, all rights reserved. No part of this work may be reproduced without permission."),
}
#: Words that tell the families of a kind apart wherever they stand in a notice, each with what it means.
TELLING = {
    "GPL": {"affero": "affero", "lesser": "lesser", "agpl": "affero", "lgpl": "lesser"},
    "CC": {"sa": "sharealike", "sharealike": "sharealike", "nc": "noncommercial", "noncommercial": "noncommercial", "nd": "noderivatives", "noderivatives": "noderivatives", "noderivs": "noderivatives"},
}
#: Words that take a notice back, if one of the BEFORE words before it is among them.
DENIALS, BEFORE = {"not", "never", "nor", "longer", "isn", "aren", "wasn", "weren", "without"}, 3
_TOKEN = re.compile(r"[a-z0-9]+")


def tokens(line: str) -> list[str]:
    return _TOKEN.findall(line.lower())


def pairs(found: list[str]) -> set[tuple[str, str]]:
    return set(zip(found, found[1:]))


def kind(family: str) -> str | None:
    """Of a family with siblings, whose kind it is."""
    return "CC" if family.startswith("CC-") else "GPL" if family.endswith("GPL") else None


def told(family: str, found: list[str]) -> frozenset[str]:
    """What the telling words of a family's kind say, of the words of a notice."""
    words = TELLING.get(kind(family) or "", {})
    return frozenset(words[w] for w in found if w in words)


def blocks(text: str | None) -> list[list[list[str]]]:
    """The paragraphs of a text, each the words of its lines."""
    out: list[list[list[str]]] = [[]]
    for line in (text or "").split("\n"):
        if line.strip():
            out[-1].append(tokens(line))
        elif out[-1]:
            out.append([])
    return out if out[-1] else out[:-1]


def stretches(found: list[str]) -> list[list[str]]:
    """The words in stretches of at most LONGEST, each STRIDE words after the one before it."""
    return [found[s : s + LONGEST] for s in range(0, max(1, len(found) - LONGEST + STRIDE), STRIDE)] if len(found) > LONGEST else [found]


def shortest_run(found: list[str], wanted: set[tuple[str, str]]) -> tuple[int, int]:
    """Start and end of the shortest run of the words that has all of the wanted bigrams that they have."""
    places = [(k, p) for k, p in enumerate(zip(found, found[1:])) if p in wanted]
    n, had, first, best = len({p for _, p in places}), Counter(), 0, (len(found), 0)
    for k, p in places:
        had[p] += 1
        while len(had) == n:
            start, q = places[first]
            best = min(best, (k + 2 - start, start))
            had[q] -= 1
            if not had[q]:
                del had[q]
            first += 1
    return best[1], best[1] + best[0]


class Codes(dict):
    """A word's 32-bit code, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[word] = zlib.crc32(word.encode())
        return out


_CODES = Codes()
#: Word lists whose weights are added up together.
_ADDED = 4_000


def slots(found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The slots of the unigrams and bigrams of word lists, and the list that each belongs to."""
    sizes = [len(t) for t in found]
    codes = np.array([_CODES[w] for t in found for w in t], np.uint64)
    owner = np.repeat(np.arange(len(found)), sizes)
    both = owner[1:] == owner[:-1]
    pair = ((codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:]) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)
    return np.concatenate([codes & np.uint64(_MASK), pair[both]]).astype(np.int64), np.concatenate([owner, owner[1:][both]])


class Model:
    """Weights by slot and class; slots that training did not meet weigh nothing."""

    def __init__(self, background: list[list[str]], seed: int = 3):
        self.templates = {k: [pairs(tokens(t)) for t in ts] for k, ts in TEMPLATES.items()}
        self.bigrams = set().union(*[p for ts in self.templates.values() for p in ts])
        self.told = {k: {told(k, tokens(t)) for t in ts} for k, ts in TEMPLATES.items()}
        self.classes = [*sorted(TEMPLATES), UNKNOWN]
        rng = np.random.default_rng(seed)
        words = [w for b in background for w in b] or ["lorem"]
        pick = lambda n: [words[i] for i in rng.integers(0, len(words), n)]

        def among(t: list[str], most: int) -> list[str]:
            room = int(rng.integers(0, max(1, most - len(t))))
            before = int(rng.integers(0, room + 1))
            return [*pick(before), *t, *pick(room - before)]

        found, truth = [], []
        for k, family in enumerate(self.classes[:-1]):
            for t in map(tokens, TEMPLATES[family]):
                for n in range(VARIATIONS):
                    kept = [w for w in t if rng.random() > 0.06] or t
                    found.append(among(kept, LONGEST if n % 2 else len(kept) + 6))
                    truth.append(k)
        every = [tokens(t) for ts in TEMPLATES.values() for t in ts]
        for n in range(OTHERS):  # no licence: corpus paragraphs, scraps of templates among corpus words, notices taken back
            if n % 3 and background:
                one = background[int(rng.integers(0, len(background)))][:LONGEST]
            elif n % 2:  # a notice that is taken back
                denial = sorted(DENIALS)[int(rng.integers(0, len(DENIALS)))]
                one = [denial, *pick(int(rng.integers(0, BEFORE))), *every[int(rng.integers(0, len(every)))]][:LONGEST]
            else:
                t = every[int(rng.integers(0, len(every)))]
                s = int(rng.integers(0, len(t)))
                one = among(t[s : s + int(rng.integers(1, 3))], LONGEST)
            found.append(one)
            truth.append(len(self.classes) - 1)
        held = np.arange(len(found)) % 4 == 3
        self._fit([t for t, h in zip(found, held) if not h], np.array(truth)[~held])
        self.temperature = 1.0
        z, own = self.margins([t for t, h in zip(found, held) if h]), np.array(truth)[held]
        loss = lambda t: -np.log(self._softmax(z / t)[np.arange(len(own)), own] + 1e-12).mean()
        self.temperature = float(min(np.geomspace(0.25, 4, 25), key=loss))

    def _fit(self, found: list[list[str]], truth: np.ndarray) -> None:
        """Gradient descent with momentum on the mean log loss, over the slots that occur."""
        slot, owner = slots(found)
        seen, at = np.unique(slot, return_inverse=True)
        n, classes = len(found), len(self.classes)
        w, bias = np.zeros((len(seen), classes)), np.zeros(classes)
        speed, bias_speed, target = np.zeros_like(w), np.zeros_like(bias), np.eye(classes)[truth]
        order = np.argsort(owner, kind="stable")
        by_owner, starts = at[order], np.searchsorted(owner[order], np.arange(n))
        by_slot = np.argsort(at, kind="stable")
        slot_owner, slot_starts = owner[by_slot], np.searchsorted(at[by_slot], np.arange(len(seen)))
        for _ in range(STEPS):
            p = self._softmax(np.add.reduceat(w[by_owner], starts, axis=0) + bias)
            error = (p - target) / n
            speed = 0.9 * speed - 0.3 * (np.add.reduceat(error[slot_owner], slot_starts, axis=0) + 1e-5 * w)
            bias_speed = 0.9 * bias_speed - 0.3 * error.sum(axis=0)
            w += speed
            bias += bias_speed
        self.place = np.zeros(1 << BITS, np.int32)
        self.place[seen] = np.arange(1, len(seen) + 1)
        self.w, self.bias = np.concatenate([np.zeros((1, classes)), w]), bias

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def margins(self, found: list[list[str]]) -> np.ndarray:
        z = np.tile(self.bias, (len(found), 1))
        slot, owner = slots(found)
        n_words = sum(map(len, found))
        for part in (slice(0, n_words), slice(n_words, None)):  # words, then pairs: each in the order of their lists
            at = self.place[slot[part]]
            met = np.flatnonzero(at)
            at, own = at[met], owner[part][met]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else met
            for k in range(0, len(first), _ADDED):
                lo, hi = first[k], first[k + _ADDED] if k + _ADDED < len(first) else len(at)
                z[own[first[k : k + _ADDED]]] += np.add.reduceat(self.w[at[lo:hi]], first[k : k + _ADDED] - lo, axis=0)
        return z

    def probabilities(self, found: list[list[str]]) -> np.ndarray:
        """Of each list of words, the calibrated probability of each class."""
        return self._softmax(self.margins(found) / self.temperature) if found else np.zeros((0, len(self.classes)))

    def predict(self, found: list[list[str]]) -> list[tuple[str, float]]:
        """Family and probability of each list of words; UNKNOWN unless likely, confirmed by a template, without a word that tells a sibling's notice, and not taken back by its first word."""
        p = self.probabilities(found)
        out = []
        for t, k, row in zip(found, p.argmax(axis=1).tolist(), p):
            name, had = self.classes[k], pairs(t)
            sure = name != UNKNOWN and row[k] >= LEAST and any(len(q & had) >= CONFIRMED * len(q) for q in self.templates[name]) and told(name, t) in self.told[name] and t[0] not in DENIALS
            out.append((name, float(row[k])) if sure else (UNKNOWN, float(row[-1])))
        return out

    def confirmed(self, found: list[str]) -> list[set[tuple[str, str]]]:
        """The templates of which the words have CONFIRMED of the bigrams."""
        had = self.bigrams.intersection(zip(found, found[1:]))
        return [q for ts in self.templates.values() for q in ts if len(q & had) >= CONFIRMED * len(q)] if had else []

    def runs(self, found: list[str]) -> list[list[str]]:
        """The runs of the confirmed templates, from the word on that takes one back; those that overlap are one, so that their families compete."""
        out: list[tuple[int, int]] = []
        for a, b in sorted(shortest_run(found, q) for q in self.confirmed(found)):
            a = next((k for k in range(max(0, a - BEFORE), a) if found[k] in DENIALS), a)
            if out and a < out[-1][1]:
                out[-1] = out[-1][0], max(b, out[-1][1])
            else:
                out.append((a, b))
        return [found[a:b] for a, b in out]


def readings(lines: list[list[str]]) -> list[list[str]]:
    """What is read of a paragraph: its words in stretches, and each of its lines."""
    whole = [w for t in lines for w in t]
    single = [p for t in lines if t for p in stretches(t)] if len(lines) > 1 else []
    return [*single, *(stretches(whole) if whole else [])]


def confirmed_nowhere(found: list[str]) -> bool:
    had = pairs(found)
    return all(len(q & had) < CONFIRMED * len(q) for ts in TEMPLATES.values() for q in (pairs(tokens(t)) for t in ts))


def learn(docs: DataFrame, rows: int = SAMPLE_DOCS, chars: int = ROW_CHARS) -> list[list[str]]:
    """Words of paragraphs that hold no licence notice, of at most `rows` documents, those of least hash of doc_id.

    Of each, at most `chars` characters from a hashed place of its text are read; of rows that repeat
    a doc_id, the one of least text.
    """
    place = F.xxhash64("doc_id", F.lit("license sample"))
    own = texts(docs).where("doc_id is not null and text is not null")
    ids = [r.doc_id for r in own.select("doc_id").distinct().orderBy(place, "doc_id").limit(rows).collect()]
    start = F.pmod(place, F.greatest(F.length("text") - chars + 1, F.lit(1))).cast("int") + 1
    part = own.where(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min(F.col("text").substr(start, F.lit(chars))).alias("text"))
    words = sorted({tuple(p) for r in (part.collect() if ids else ()) for b in blocks(r.text) for p in readings(b)})
    return [list(t) for t in words if len(t) > 2 and confirmed_nowhere(list(t))]


#: Words that are scored together.
_TOGETHER = 400_000


def _groups(found: list[str | None]) -> Iterator[list[list[list[list[str]]]]]:
    """The paragraphs of texts, of as many together as have about _TOGETHER words."""
    held, size = [], 0
    for t in found:
        held.append(blocks(t))
        size += sum(len(line) for b in held[-1] for line in b)
        if size >= _TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def read(model: Model, found: list[str | None]) -> list[tuple[int, list[tuple[int, str, float]], set[int]]]:
    """Of each text: the number of paragraphs, (paragraph, family, probability) of its confirmed notices, and the suspect paragraphs without one."""
    out = []
    for group in _groups(found):
        parts = [(i, k, p) for i, own in enumerate(group) for k, lines in enumerate(own) for p in readings(lines)]
        likely = 1 - model.probabilities([p for _, _, p in parts])[:, -1]
        runs = [(*parts[j][:2], r) for j in np.flatnonzero(likely >= SCREEN).tolist() for r in model.runs(parts[j][2])]
        hits: list[list[tuple[int, str, float]]] = [[] for _ in group]
        for (i, k, _), (name, p) in zip(runs, model.predict([r for _, _, r in runs])):
            if name != UNKNOWN:
                hits[i].append((k, name, p))
        suspects: list[set[int]] = [set() for _ in group]
        for j in np.flatnonzero(likely >= LEAST).tolist():
            suspects[parts[j][0]].add(parts[j][1])
        out += [(len(own), h, s - {k for k, _, _ in h}) for own, h, s in zip(group, hits, suspects)]
    return out


def _scan(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_paragraphs", "n_licensed", "license", "score", "families", "n_suspect"]
    for b in batches:
        n, licensed, name, score, families, suspect = [], [], [], [], [], []
        for count, hits, suspects in read(model, b.column("text").to_pylist()):
            p, best = min(((-p, f) for _, f, p in hits), default=(0.0, NONE))
            for column, v in zip((n, licensed, name, score, families, suspect), (count, len({k for k, _, _ in hits}), best, abs(p), ",".join(sorted({f for _, f, _ in hits})), len(suspects))):
                column.append(v)
        columns = [pa.array(n, pa.int64()), pa.array(licensed, pa.int64()), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(families, pa.string()), pa.array(suspect, pa.int64())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *columns], names=names)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed, license (the surest family, or `none`), score, families and n_suspect of each whole text.

    Null, empty and wordless texts have no licence. Equal scores go to the family first in the
    alphabet. Repeated rows give equal rows.
    """
    tune(docs.sparkSession)
    model = Model(learn(docs))  # some MB, sent with the tasks
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return texts(docs).mapInArrow(lambda it: _scan(it, shared.value), "doc_id long, n_paragraphs long, n_licensed long, license string, score double, families string, n_suspect long")
