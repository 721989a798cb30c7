"""Language identification by cross-parsing entropy over suffix automata.

Per language, labelled text becomes a suffix automaton. A text is parsed greedily into the longest
phrases that occur in that text; the fewer phrases per character, relative to what the language's
own held-back text needs, the closer the text is to the language. The language needing fewest wins.

Parsing runs in numpy over many blocks of text in step: one table lookup per character and
language, whatever the length of the text. Texts are cut into blocks of BLOCK characters (a phrase
ends with its block), so long texts take no longer per character than short ones.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket, plain, texts, tune

#: Training bounds per language: rows fetched, characters of a row's text, characters in the automaton, characters that set its own rate.
SAMPLE_ROWS, ROW_CHARS, AUTOMATON_CHARS, RATE_CHARS = 60, 4_000, 16_000, 16_000
BLOCK, LANES, UNKNOWN = 1024, 4096, "und"
#: Letters of a language with a class of their own, and classes that its other letters share by a hash.
OWN, SHARED = 126, 126
#: How much a phrase rate above the best counts in the score.
SHARPNESS = 12.0
#: Phrases that a text of any language may need beyond what its length explains, and the excess over which it is in no learned language.
FREE, STRANGE = 6, 2.5


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


class Classes:
    """Characters as small numbers, for one language: 0 is no letter, 1 a letter that its text doesn't have; then its commonest letters, and the others by a hash."""

    def __init__(self, sample: str):
        count = Counter(c for c in sample.lower() if c.isalpha())
        self.table = np.where(_letters(), 1, 0).astype(np.uint8)
        for k, (c, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))):
            self.table[ord(c)] = 2 + (k if k < OWN else OWN + (ord(c) * 2_654_435_761 >> 12) % SHARED)
        self.width = int(self.table.max()) + 1

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        return self.table[codes]


def _squeezed(text: str) -> np.ndarray:
    """Code points of the text in lower case; of each run of what is no letter only the first stays, if a letter comes before it."""
    c = _codes(text)
    keep = _letters()[c]
    keep[1:] |= keep[:-1].copy()
    return c[keep]


def suffix_automaton(s: list[int], width: int) -> np.ndarray:
    """Transitions of the automaton of all substrings of s, as a flat table of state * width + class, for classes below width.

    Entries are premultiplied by width; the start is 0 and no transition leads there, so 0 means none.
    """
    go, link, length, last = [{}], [-1], [0], 0
    for c in s:
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(go)
                go.append(go[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.zeros(len(go) * width, np.int32)
    order = np.argsort(np.array(length), kind="stable")  # states of short matches, the commonest, side by side
    place = np.empty(len(go), np.int64)
    place[order] = np.arange(len(go))
    for state, moves in enumerate(go):
        for c, to in moves.items():
            table[place[state] * width + c] = place[to] * width
    return table


def _phrases(table: np.ndarray, width: int, steps: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Phrases of each lane: steps[t, lane] is its t-th class, active[t] lanes (the first ones) have one."""
    n = steps.shape[1]
    state, count, root = np.zeros(n, np.int32), np.zeros(n, np.int32), table[:width].copy()
    for t, k in enumerate(active.tolist()):
        c = steps[t, :k]
        s = state[:k]
        to = table.take(s + c)
        ended = to == 0
        count[:k] += ended
        state[:k] = np.where(ended, root.take(c), to)
    return count  # the first class of a lane starts from the root: it ends no phrase but counts its first one below


class Model:
    """Automata and rates per language, built from text alone."""

    def __init__(self, names: list[str], automaton: list[str], rate: list[str]):
        self.names = names
        self.classes = [Classes(t) for t in automaton]
        self.tables = [suffix_automaton(c(_squeezed(t)).tolist(), c.width) for c, t in zip(self.classes, automaton)]
        self.rates = np.ones(len(names))
        for k, t in enumerate(rate):
            n, chars = self.parse([t or automaton[k]])
            self.rates[k] = max(n[0, k], 1) / max(chars[0], 1)

    def parse(self, found: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by text and language, and the characters parsed."""
        phrases = np.zeros((len(found), len(self.names)), np.int64)
        squeezed = [_squeezed(t) if t else np.zeros(0, np.uint32) for t in found]
        chars = np.array([len(c) for c in squeezed], np.int64)
        if not chars.sum():
            return phrases, chars
        flat = np.concatenate(squeezed)
        del squeezed
        ends = np.cumsum(chars)
        lanes = [(i, s, min(s + BLOCK, e)) for i, (s, e) in enumerate(zip((ends - chars).tolist(), ends.tolist())) for s in range(s, e, BLOCK)]
        for at in range(0, len(lanes), LANES):
            own, start, end = np.array(lanes[at : at + LANES]).T
            order = np.argsort(start - end, kind="stable")
            own, start, size = own[order], start[order], (end - start)[order]
            steps = np.zeros((len(own), size[0]), np.uint32)
            for row, first, n in zip(steps, start.tolist(), size.tolist()):
                row[:n] = flat[first : first + n]
            steps = np.ascontiguousarray(steps.T)
            active = np.searchsorted(-size, -np.arange(size[0]), side="left")
            for k, (classes, table) in enumerate(zip(self.classes, self.tables)):
                np.add.at(phrases[:, k], own, _phrases(table, classes.width, classes(steps), active) + 1)
        return phrases, chars

    def predict(self, found: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and excess of each text: the phrases beyond FREE that it needs, as a multiple of its language's own rate."""
        phrases, chars = self.parse(found)
        letters = np.array([bool(t) and any(map(str.isalpha, t)) for t in found], bool)
        rel = phrases / np.maximum(chars, 1)[:, None] / self.rates
        best = rel.argmin(axis=1)
        near = np.exp(-SHARPNESS * (rel - rel.min(axis=1, keepdims=True)))
        score = np.where(letters, near.max(axis=1) / near.sum(axis=1), 0.0)
        fewest = np.take_along_axis(phrases, best[:, None], 1)[:, 0]
        excess = np.maximum(fewest - FREE, 0) / np.maximum(chars, 1) / self.rates[best]
        return [self.names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())], score, excess


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = ROW_CHARS) -> tuple[list[str], list[str], list[str]]:
    """Names and bounded labelled text of the languages of docs: for the automaton, and for its rate.

    Only rows whose crc32 of doc_id modulo 3 is not 1, with a language and text, are read; rows without
    a doc_id are not. Of each language, however rare beside others, at most `rows` come to the driver,
    those of least hash of doc_id, each with at most `chars` characters from a hashed place of its text.
    A language is learned if it has a single row.
    """
    found = texts(docs, "lang").where("lang is not null and text is not null").where(bucket("doc_id", 3) != 1)
    place = F.xxhash64("doc_id", F.lit("language sample"))
    start = F.pmod(place, F.greatest(F.length("text") - chars + 1, F.lit(1))).cast("int") + 1
    found = found.select(F.col("lang").cast("string").alias("lang"), "doc_id", place.alias("place"), F.col("text").substr(start, F.lit(chars)).alias("text"))
    order = Window.partitionBy("lang").orderBy("place", "doc_id", "text")
    got: dict[str, list] = {}
    for r in found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows).orderBy("lang", "k").select("lang", "text").collect():
        got.setdefault(r.lang, []).append(r.text)
    names, automaton, rate = [], [], []
    for name, found in sorted(got.items()):
        half = found[::2], found[1::2] or found
        names.append(name)
        automaton.append(" ".join(t[: max(400, AUTOMATON_CHARS // len(half[0]))] for t in half[0])[:AUTOMATON_CHARS])
        rate.append(" ".join(t[: max(400, RATE_CHARS // len(half[1]))] for t in half[1])[:RATE_CHARS])
    return names, automaton, rate


@functools.lru_cache(maxsize=2)
def _model(learned: tuple) -> Model:
    return Model(*map(list, learned))


def predictor(spark: SparkSession, learned: tuple[list[str], list[str], list[str]]):
    """A column function text -> struct(lang_pred, score, excess). What is learned is a few kB per language."""
    tune(spark)
    held = tuple(map(tuple, learned))

    @F.pandas_udf("lang_pred string, score double, excess double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in batches:
            if held[0]:
                names, score, excess = _model(held).predict(text.tolist())
            else:
                names, score, excess = [UNKNOWN] * len(text), np.zeros(len(text)), np.zeros(len(text))
            yield pd.DataFrame({"lang_pred": names, "score": score, "excess": excess})

    return predict


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and excess of each row's whole text.

    Null texts and texts without a letter are `und` with score 0. If docs has no labelled row to
    learn from, every text is `und`. Equal rates go to the language first in the alphabet. Repeated
    rows give equal rows. A row without a doc_id has no fold: held_out is null. Scores need no shuffle.
    """
    predict = predictor(docs.sparkSession, learn(docs))
    return texts(docs).select("doc_id", (bucket("doc_id", 3) == 1).alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.excess")


def with_language(docs: DataFrame, languages: list[str] | None = None, strange: float = STRANGE) -> DataFrame:
    """docs in one of the given languages (all learned ones by default). All columns stay.

    Rejected are null texts, texts with no letter, texts predicted to be in another language, and
    texts that need over `strange` times the phrases that text of the predicted language does: they
    are in no learned language. Without a labelled row there is no language, and no row stays.
    """
    own = plain(docs, "lang")
    predict = predictor(docs.sparkSession, learn(own))
    kept = own.withColumn("predicted", predict(F.col("text").cast("string"))).where((F.col("predicted.lang_pred") != UNKNOWN) & (F.col("predicted.excess") <= strange))
    if languages is not None:
        kept = kept.where(F.col("predicted.lang_pred").isin(languages))
    return kept.drop("predicted").toDF(*docs.columns)
