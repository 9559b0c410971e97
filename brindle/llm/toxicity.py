"""Toxicity by a weighted lexicon: folded text, Aho-Corasick, exception phrases, length.

Texts are lower-cased and folded: letters of other scripts that look like Latin ones and
digits and marks that stand for letters become those letters. Terms are whole words
(" word ") or beginnings of words (" word"). Their weights are log-ratios learnt from
labelled documents, where each context of a term (the word before it) counts once, so
that copies of one document don't vote again. Phrases that contain a term but are mostly
clean are exceptions: a term inside one doesn't count. The sum of weights is normalised
by the number of words and mapped to 0..1 by a logistic curve.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .labelled import sample
from .quality import logistic
from .util import ship

#: Characters that look like a Latin letter, by that letter.
LOOKALIKES = {"a": "аαɑ", "b": "вЬ", "c": "сϲ", "d": "ԁ", "e": "еεё", "g": "ɡ", "h": "һн", "i": "іιı", "j": "ј", "k": "кκ", "m": "м", "n": "п", "o": "оοσ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υ", "v": "ν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ"}
#: Digits and marks in place of a letter.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class Settings:
    """rows, clean_rows: the most labelled documents, toxic and clean, that are learnt from. support: contexts a term needs.

    A term's share of toxic contexts, as if both classes were of one size, is purity at
    least; and evidence bounds the log of how unlikely its few clean contexts are by chance.
    """

    rows: int = 3000
    clean_rows: int = 12000
    support: int = 6
    purity: float = 0.97
    evidence: float = 16.0
    exceptions: tuple[str, ...] = ()


class _Fold(dict):
    """A character's folded form, found when it is first seen."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c).lower()
        plain = "".join(x for x in plain if unicodedata.category(x) not in ("Mn", "Cf"))
        out = "".join(_STRAIGHT.get(x, x if x.isalnum() else " ") for x in plain)
        self[code] = out
        return out


_STRAIGHT = {c: letter for letter, alike in LOOKALIKES.items() for c in alike} | STAND_INS
_FOLD = _Fold()


def fold(text: str) -> str:
    """Folded words between single blanks, with a blank at either end."""
    # marks that only end a word aren't letters: cut them before they are read as such
    words = (w.rstrip("!|$@.,;:?") for w in text.split())
    return f" {' '.join(' '.join(words).translate(_FOLD).split())} "


def _terms(words: list[str]):
    """(term, context) of each word: the word before it."""
    before = ""
    for w in words:
        if len(w) > 2:
            yield f" {w} ", before
            for k in PREFIXES:
                if len(w) > k:
                    yield f" {w[:k]}", before
        before = w


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]
    exceptions: frozenset[str]
    slope: float
    offset: float

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            a.add_word(term, (len(term), w))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(a):
            a.make_automaton()
        return a

    @staticmethod
    def hits(automaton, folded: str) -> tuple[float, int]:
        """(sum of weights outside exceptions, hits); the longest term that begins at a place counts."""
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        if len(automaton):
            for end, (n, w) in automaton.iter(folded):
                begin = end - n + 1
                if w is None:
                    spared.append((begin, end))
                elif best.get(begin, (0, 0.0))[0] < n:
                    best[begin] = (n, w)
        if spared:
            best = {b: x for b, x in best.items() if not any(s <= b and b + x[0] - 1 <= e for s, e in spared)}
        return sum(w for _, w in best.values()), len(best)

    @staticmethod
    def normalised(total: float, folded: str) -> float:
        words = max(1, folded.count(" ") - 1)
        return math.log1p(1000 * total / words) if total > 0 else 0.0

    def score(self, automaton, folded: str) -> float:
        x = self.slope * self.normalised(self.hits(automaton, folded)[0], folded) + self.offset
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, x))))


def learn(df: DataFrame, labels: DataFrame, label: str = "toxic", s: Settings = Settings()) -> Lexicon:
    """Learns terms, weights and exceptions from labelled documents, as many as s bounds.

    Without toxic rows the lexicon is empty, and every score is low. Null keys and labels are
    left out, a null text is an empty one; rows that repeat add no contexts.
    """
    ship(df.sparkSession)
    least = s.support

    def found(batches, wanted=None):
        for batch in batches:
            rows: set[tuple[str, str, int]] = set()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.update((t, c, y) for t, c in _terms(fold(text).split()) if wanted is None or t in wanted)
            t, c, y = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(c, pa.string()), pa.array(y, pa.int32())], names=["term", "context", "y"])

    kind = "term string, context string, y int"
    rows = sample(df, labels, label, s.rows, s.clean_rows)
    toxic = rows.where("y = 1").mapInArrow(tk.tidy(found), kind).distinct()
    pos = Counter({r.term: r.n for r in toxic.groupBy("term").agg(F.count("*").alias("n")).where(f"n >= {least}").collect()})
    wanted = frozenset(pos)
    clean = rows.where("y = 0").mapInArrow(tk.tidy(lambda it: found(it, wanted)), kind).distinct()
    neg = Counter({r.term: r.n for r in clean.groupBy("term").agg(F.count("*").alias("n")).collect()})
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1:
        return Lexicon({}, frozenset(), 1.0, -4.0)
    # a share of toxic contexts as if both classes were of one size
    share = {t: (pos[t] / n1) / (pos[t] / n1 + neg[t] / max(1, n0)) for t in pos}
    weights: dict[str, float] = {}
    for t in sorted(pos, key=lambda t: (len(t.rstrip()), t)):  # a beginning of a word stands for all that go on from it
        by_chance = pos[t] * n0 / n1
        evidence = by_chance - neg[t] + (neg[t] * math.log(neg[t] / by_chance) if neg[t] else 0.0)
        if share[t] >= s.purity and evidence >= s.evidence and not any(t[:k] in weights for k in range(3, len(t))):
            weights[t] = math.log((pos[t] + 0.5) / (n1 + 1)) - math.log((neg[t] + 0.5) / (n0 + 1))
    weights = {t: w for t, w in weights.items() if w > 0}
    around: Counter = Counter()
    for part in (toxic, clean):
        for r in part.where(F.col("term").isin(*[t for t in weights if t.endswith(" ")]) & (F.col("context") != "")).groupBy("term", "context").agg(F.sum("y").alias("p"), F.count("*").alias("n")).where(f"n >= {least}").collect():
            around[f"{r.context} {r.term.strip()}"] += r.n - 2 * r.p
    exceptions = frozenset(p for p, n in around.items() if n > 0) | frozenset(fold(p).strip() for p in s.exceptions)
    model = Lexicon(weights, exceptions, 1.0, 0.0)

    def measured(batches):
        automaton = model.automaton()
        for batch in batches:
            x = [Lexicon.normalised(Lexicon.hits(automaton, f)[0], f) for f in map(fold, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)], names=["x", "y"])

    points = sorted((r.x, r.y) for r in rows.mapInArrow(tk.tidy(measured), "x double, y int").collect())
    x, y = np.array([p[0] for p in points]), np.array([p[1] for p in points])
    if len(set(y.tolist())) < 2:
        return Lexicon(weights, exceptions, 1.0, -2.0)
    slope, offset = logistic(x[:, None], y)
    return Lexicon(weights, exceptions, float(max(slope[0], 0.0)), offset)


def score(df: DataFrame, model: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score double, hits int) of each row of df: 0 to 1, higher for more toxic.

    A null text scores as an empty one, whose score is the lowest; other columns are
    ignored; repeated rows are each scored, alike; an empty df gives no rows.
    """
    ship(df.sparkSession)

    def run(batches):
        automaton = model.automaton()
        for batch in batches:
            scores, hits = [], []
            for text in batch.column(1):
                folded = fold(text.as_py() or "")
                total, n = Lexicon.hits(automaton, folded)
                z = model.slope * Lexicon.normalised(total, folded) + model.offset
                scores.append(1 / (1 + math.exp(-min(30.0, max(-30.0, z)))))
                hits.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(hits, pa.int32())], names=[key, "score", "hits"])

    return df.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(tk.tidy(run), f"`{key}` {df.schema[key].dataType.simpleString()}, score double, hits int")
