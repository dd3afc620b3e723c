"""Toxicity by a weighted lexicon.

Texts are folded (case, homoglyphs, digits that stand for letters, so that ``1d10t`` and ``idiot``
agree), and an Aho-Corasick automaton finds the lexicon's terms at word starts.  A word counts
once, with its heaviest term.  Terms inside an exception phrase do not count.  The weights are
summed, and a logistic curve over the sum and the sum per word gives a score from 0 to 1.

The lexicon is learned from labelled rows: whole words and word beginnings that toxic texts
have far more often than others.  Labels are read for that only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from trajmill import scratch
from trajmill.llm.arrow import map_rows, values

#: At most so many labelled rows are read for the fit, those with the smallest hashes.
FIT_ROWS = 20_000
LEXICON_SIZE = 2000
LEAST_TEXTS = 5
LEAST_LOG_ODDS = 2.0
PREFIXES = range(4, 9)
DENSITY_SCALE = 200
THRESHOLD = 0.7

#: Look-alikes, and digits and signs used for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ո": "n", "ӏ": "i",
    "м": "m", "т": "t", "в": "b", "н": "h", "к": "k", "α": "a", "ο": "o", "ρ": "p", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u",
    "ı": "i", "ſ": "s", "ß": "s",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "|": "i"}
SIGNS = {"@": "a", "$": "s", "!": "i"}
#: ``l`` is folded with ``i``, as the digit 1 stands for either.
_FOLD = str.maketrans(HOMOGLYPHS | DIGITS | {"l": "i"} | {chr(c): chr(c - 0xFEE0) for c in range(0xFF21, 0xFF5B)})
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_SIGN = re.compile(r"(?<=\w)[@$!](?=\w)|(?<!\S)[@$](?=\w)")
_GAP = re.compile(r"[\W_]+")
#: Phrases in which a lexicon term is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "sore loser", "class clown", "pond scum")


def fold(text: str) -> str:
    """Folded words, each with a space before and the last also with one behind."""
    low = _HIDDEN.sub("", text).lower()
    if "@" in low or "$" in low or "!" in low:
        low = _SIGN.sub(lambda m: SIGNS[m[0]], low)
    return " " + _GAP.sub(" ", low.translate(_FOLD)).strip() + " "


@dataclass(frozen=True)
class Lexicon:
    """Folded terms with their weights; a term that ends in a space is a whole word."""

    weights: dict[str, float]
    curve: tuple[float, ...] = (-2.0, 0.5, 0.5)
    exceptions: tuple[str, ...] = field(default=EXCEPTIONS)

    def matcher(self) -> Matcher:
        return _matcher(tuple(sorted(self.weights.items())), self.curve, self.exceptions)


class Matcher:
    def __init__(self, weights: tuple[tuple[str, float], ...], curve: tuple[float, ...], exceptions: tuple[str, ...]) -> None:
        self.curve, self.machine = curve, ahocorasick.Automaton()
        for term, weight in weights:
            self.machine.add_word(" " + term, (len(term) + 1, weight))
        for phrase in exceptions:
            self.machine.add_word(fold(phrase), (len(fold(phrase)), None))
        self.machine.make_automaton() if len(self.machine) else None

    def features(self, text: str | None) -> tuple[float, int]:
        """The sum of the weights of all matched words, and the number of words."""
        folded = fold(text or "")
        words = folded.count(" ") - 1 if len(folded) > 2 else 0
        if not len(self.machine):
            return 0.0, words
        heaviest: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (length, weight) in self.machine.iter(folded):
            start = end + 1 - length
            if weight is None:
                excused.append((start, end))
            elif weight > heaviest.get(start, 0.0):
                heaviest[start] = weight
        if excused:
            return sum(w for s, w in heaviest.items() if not any(a <= s < b for a, b in excused)), words
        return sum(heaviest.values()), words

    def score(self, text: str | None) -> float:
        return float(_curve(self.curve, *map(np.array, ([x] for x in self.features(text))))[0])


@lru_cache(maxsize=2)
def _matcher(*args) -> Matcher:
    return Matcher(*args)


def _inputs(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(DENSITY_SCALE * total / np.maximum(words, 1))], axis=1)


def _curve(curve: tuple[float, ...], total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_inputs(total, words) @ np.array(curve), -30, 30)))


def _fit_curve(total: np.ndarray, words: np.ndarray, label: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge."""
    x, w = _inputs(total, words), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (label - p) - 0.01 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(3), slope)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


class _TermCounter:
    """Counts, for a task, in how many toxic and other texts each term occurs."""

    def __init__(self) -> None:
        self.counts: dict[str, list[int]] = {}
        self.texts = [0, 0]

    def __call__(self, row: tuple) -> Iterator[tuple]:
        text, toxic = row
        words = set(fold(text or "").split())
        terms = {w + " " for w in words if len(w) > 2}
        terms.update(w[:n] for w in words for n in PREFIXES if len(w) > n)
        self.texts[toxic] += 1
        for term in terms:
            self.counts.setdefault(term, [0, 0])[toxic] += 1
        if len(self.counts) > 400_000:
            yield from self.rest()

    def rest(self) -> Iterator[tuple]:
        yield "", self.texts[1], self.texts[0]
        for term, (clean, toxic) in self.counts.items():
            yield term, toxic, clean
        self.counts, self.texts = {}, [0, 0]


def learn(sample: DataFrame, rows: int = FIT_ROWS, size: int = LEXICON_SIZE) -> Lexicon:
    """A lexicon from ``text, toxic`` (0 or 1), which should be a bounded sample (``training_rows``).

    A table without toxic rows gives an empty lexicon, whose scores are all low.
    """
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("toxic", T.LongType()), T.StructField("clean", T.LongType())])
    counts = map_rows(sample.select("text", "toxic"), _TermCounter, schema, "rest").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # A term of so few toxic texts is never chosen; the row for all texts has the empty term.
    frequent = scratch.materialize(counts.filter((F.col("toxic") >= LEAST_TEXTS) | (F.col("term") == "")), "terms")
    texts = frequent.filter("term = ''").first()
    if texts is None or not texts.toxic:
        return Lexicon({}, (-5.0, 0.0, 0.0))
    odds = F.log((F.col("toxic") + 0.5) / F.lit(texts.toxic + 1)) - F.log((F.col("clean") + 0.5) / F.lit(texts.clean + 1))
    chosen = frequent.filter("term <> ''").withColumn("odds", odds).filter(F.col("odds") >= LEAST_LOG_ODDS)
    best = chosen.orderBy((F.col("odds") * F.col("toxic")).desc(), "term").limit(size).collect()  # at most ``size`` rows
    lexicon = Lexicon({r.term: float(r.odds) for r in best})
    features = sample.select(_feature_column(lexicon)("text").alias("f"), "toxic").select("f.*", "toxic").limit(rows).toArrow()
    total, words, label = (features.column(n).to_numpy() for n in ("total", "words", "toxic"))
    return Lexicon(lexicon.weights, _fit_curve(total, words, label))


def _feature_column(lexicon: Lexicon):
    kind = T.StructType([T.StructField("total", T.DoubleType()), T.StructField("words", T.LongType())])

    @F.arrow_udf(kind)
    def features(texts: pa.Array) -> pa.Array:
        found = lexicon.matcher().features
        pairs = [found(t) for t in values(texts)]
        return pa.StructArray.from_arrays([pa.array([a for a, _ in pairs], pa.float64()), pa.array([b for _, b in pairs], pa.int64())], ["total", "words"])

    return features


def toxicity(lexicon: Lexicon):
    """A column function: the score of a text, from 0 to 1.  Null texts score as empty ones."""

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        found = lexicon.matcher().features
        pairs = np.array([found(t) for t in values(texts)], dtype=float).reshape(-1, 2)
        return pa.array(_curve(lexicon.curve, pairs[:, 0], pairs[:, 1]), pa.float64())

    return score


def fold_number(doc_id: str | Column, folds: int) -> Column:
    """The fold of a row by the CRC-32 of its id as text; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(folds))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, folds: int = 3, held_out: int = 1) -> DataFrame:
    """``text, toxic`` of at most ``rows`` labelled ids outside the held-out fold, those with the smallest hashes.

    Labels other than 0 and 1 and null ids are left out; an id that is labelled more than once is
    toxic if any label says so.  The ids are chosen before any text is read.
    """
    marked = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(fold_number("doc_id", folds) != held_out)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return scratch.materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxicity-sample")


def score_documents(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` for every row of ``docs``, null and empty texts and repeated rows too."""
    return docs.select(F.col(doc_id).alias("doc_id"), toxicity(lexicon)(F.col(text)).alias("score"))


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold."""
    scored = docs.select(F.struct("*").alias("row"), toxicity(lexicon)(F.col(text)).alias("score"))
    return scored.filter(F.col("score") < threshold).select("row.*")
