"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, turns look-alike letters of other scripts and full-width
forms into Latin ones, reads digits and marks inside words as the letters they
stand for (1d10t, tra$h) and joins words by single spaces. The lexicon holds
whole words and word beginnings with weights, and exception phrases: a match
with its two neighbours that labelled texts show to be harmless. A text's weight
is the sum of its matches outside exception phrases; the score is a logistic
function of that weight and of the weight for each hundred words.

Lexicon, phrases and function are fitted on at most ``max_rows`` labelled rows,
those with the smallest hash of the id; labels are used for nothing else. Null
and empty texts have no match and get the score of no weight. Labels that are
null, or have no document, are left out; an id labelled twice counts as toxic if
any label says so. Without any toxic or any other label every score is 0.
Documents that repeat are each scored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import documents

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = dict(
    zip(
        "абвеёзікмнорсстухуѕјԁһӏԛԝαβγεικνορτυχωηℓıɑɡᴀʙᴄᴅᴇ",
        "abbee3ikmhopcctyxysjdhlqwabyeikvoptuxwnliagabcde",
    )
)
# Digits and marks read as letters inside a word.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}

_TABLE = str.maketrans(LOOK_ALIKES | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {c: None for c in "­​‌‍⁠﻿"})
_STANDS = str.maketrans(STAND_INS)
_MIXED = re.compile(r"(?=[\d@$!]*[^\W\d_])[^\W_]*(?:\d|(?<=[^\W_])[@$!](?=[^\W_]))(?:[^\W_]|(?<=[^\W_])[@$!](?=[^\W_]))*")
_HAS = re.compile(r"[0-9@$]|!\w")
_GAPS = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Folded words, each with a space on either side."""
    text = text.lower()
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.translate(_TABLE)
    if _HAS.search(text):
        text = _MIXED.sub(lambda m: m[0].translate(_STANDS), text)
    return f" {_GAPS.sub(' ', text).strip()} "


@dataclass
class Model:
    #: ' word ' or ' beginning', with weights
    weights: dict[str, float] = field(default_factory=dict)
    #: ' before match after '
    exceptions: list[str] = field(default_factory=list)
    #: of 1, log of 1 + weight, log of 1 + weight for each hundred words
    factors: tuple[float, float, float] | None = None

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for p, w in self.weights.items():
            a.add_word(p, (len(p), w, p))
        for p in self.exceptions:
            a.add_word(p, (len(p), None, p))
        if len(a):
            a.make_automaton()
        return a

    def score(self, weight: float, words: int) -> float:
        if self.factors is None:
            return 0.0
        z = sum(a * b for a, b in zip(self.factors, features(weight, words)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(weight: float, words: int) -> tuple[float, float, float]:
    return 1.0, math.log1p(weight), math.log1p(100 * weight / max(words, 20))


def matches(folded: str, automaton) -> list[tuple[int, float, str]]:
    """Start, weight and entry of the matches outside exception phrases."""
    if not len(automaton):
        return []
    found, spared = [], []
    for end, (n, w, p) in automaton.iter(folded):
        if w is None:
            spared.append((end - n + 1, end))
        else:
            found.append((end - n + 1, w, p))
    if not spared:
        return found
    spared.sort()
    starts, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
    return [(s, w, p) for s, w, p in found if not (k := bisect_right(starts, s)) or reach[k - 1] < s]


MOST = 5


def _terms(folded: str, longest: int) -> Counter:
    out: Counter = Counter()
    for w, n in Counter(folded.split()).items():
        out[f" {w} "] += n
        for k in range(3, min(len(w), longest) + 1):
            out[f" {w[:k]}"] += n
    return out


def _count(longest: int):
    """Sums over a batch, by term: documents with two uses or more, and uses of at most MOST a document, apart for toxic and other ones."""

    def run(batches):
        total: dict[str, list[int]] = {}
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                for t, n in _terms(fold(text or ""), longest).items():
                    n = min(n, MOST)
                    s = total.setdefault(t, [0] * 4)
                    s[2 * y] += n > 1
                    s[2 * y + 1] += n
            if len(total) > 500_000:
                yield _sums(total)
                total = {}
        yield _sums(total)

    return run


SUMS = ["n0", "s0", "n1", "s1"]


def _sums(total: dict[str, list[int]]) -> pa.RecordBatch:
    cols = [pa.array([v[k] for v in total.values()], pa.int64()) for k in range(4)]
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *cols], ["term", *SUMS])


def _contexts(model: Model):
    """Each distinct phrase of a match and its neighbours, by label."""

    def run(batches):
        a = model.automaton()
        for b in batches:
            out: Counter = Counter()
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                f = fold(text or "")
                seen = set()
                for s, _, _ in matches(f, a):
                    left = f.rfind(" ", 0, s) if s else 0
                    right = f.find(" ", f.find(" ", s + 1) + 1)
                    if s and right > 0:
                        seen.add(f[max(left, 0) : right + 1])
                out.update((p, y) for p in seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in out], pa.string()), pa.array([n if y else 0 for (_, y), n in out.items()], pa.int64()), pa.array([0 if y else n for (_, y), n in out.items()], pa.int64())],
                ["phrase", "n1", "n0"],
            )

    return run


def labelled(df: DataFrame, labels: DataFrame, train: F.Column, max_rows: int) -> DataFrame:
    """id, text and toxic of the labelled rows to fit on."""
    rows = labels.filter(train & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return df.join(F.broadcast(rows), "doc_id").select("doc_id", "text", "toxic")  # max_rows bounds it


def evidence(a1: int, n1: int, a0: int, n0: int) -> float:
    """Likelihood ratio statistic of a1 of n1 against a0 of n0."""
    p = (a1 + a0) / (n1 + n0)

    def part(k: int, n: int, q: float) -> float:
        return k * math.log(k / (n * q)) if k else 0.0

    return 2 * (part(a1, n1, p) + part(n1 - a1, n1, 1 - p) + part(a0, n0, p) + part(n0 - a0, n0, 1 - p))


def choose(rows: list, n1: int, n0: int, least: float, most: int) -> dict[str, float]:
    """Terms that toxic documents use more, no two of which match the same word."""
    scored = []
    for t, a0, s0, a1, s1 in rows:
        ratio = math.log((s1 + 0.5) / (n1 + 1) / ((s0 + 0.5) / (n0 + 1)))
        gain = evidence(a1, n1, a0, n0)
        if gain >= least and ratio >= 1.2:
            scored.append((round(gain * min(ratio, 6.0)), len(t), t, ratio))
    out: dict[str, float] = {}
    for _, _, t, ratio in sorted(scored, reverse=True):
        if not any(t.startswith(p.rstrip()) or p.startswith(t) for p in out):
            out[t] = round(min(ratio, 6.0), 4)
            if len(out) == most:
                break
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    b = np.zeros(x.shape[1])
    pen = ridge * np.eye(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pen, x.T @ (y - p) - pen @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(df: DataFrame, labels: DataFrame, train: F.Column, max_rows: int = 20_000, max_terms: int = 400, longest: int = 8, least: float = 15.0) -> Model:
    """A model from the labelled rows for which ``train`` holds (a condition on the labels' columns)."""
    from ._util import cut

    sample = cut(labelled(documents(df), labels, train, max_rows))
    y = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = y.get(1, 0), y.get(0, 0)
    model = Model()
    if not n1 or not n0:
        return model
    counts = sample.select("text", "toxic").mapInArrow(_count(longest), "term string, " + ", ".join(f"{c} long" for c in SUMS))
    terms = counts.groupBy("term").agg(*(F.sum(c).alias(c) for c in SUMS)).filter((F.col("n1") >= 2) & (F.col("n1") * n0 > 2 * F.col("n0") * n1))
    ranked = terms.orderBy(F.desc(F.col("n1") * n0 - F.col("n0") * n1), "term").limit(20 * max_terms)
    model.weights = choose([tuple(r) for r in ranked.collect()], n1, n0, least, max_terms)
    if model.weights:
        phrases = sample.select("text", "toxic").mapInArrow(_contexts(model), "phrase string, n1 long, n0 long").groupBy("phrase").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        harmless = phrases.filter((F.col("n1") == 0) & (F.col("n0") >= 3)).orderBy(F.desc("n0"), "phrase").limit(max_terms)
        model.exceptions = [r[0] for r in harmless.collect()]
    seen = sample.select("doc_id", "text", "toxic").mapInArrow(_weigh(model, ["toxic"]), "toxic int, weight double, n_words long").collect()
    x = np.array([features(r.weight, r.n_words) for r in seen])
    model.factors = tuple(logistic(x, np.array([r.toxic for r in seen], dtype=float)).tolist())
    return model


def _weigh(model: Model, keep: list[str], full: bool = False):
    def run(batches):
        a = model.automaton()
        for b in batches:
            weight, words, terms = [], [], []
            for text in b.column("text").to_pylist():
                f = fold(text) if text else "  "
                found = matches(f, a)
                weight.append(sum(w for _, w, _ in found))
                words.append(len(f.split()))
                terms.append(sorted({p.strip() for _, _, p in found}))
            cols = [b.column(k) for k in keep] + [pa.array(weight, pa.float64()), pa.array(words, pa.int64())]
            names = [*keep, "weight", "n_words"]
            if full:
                cols += [pa.array([model.score(w, n) for w, n in zip(weight, words)], pa.float64()), pa.array(terms, pa.list_(pa.string()))]
                names += ["score", "terms"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, weight, n_words, score (0 to 1) and the lexicon's entries that matched."""
    d = documents(df, id_col, text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_weigh(model, ["doc_id"], full=True), f"doc_id {kind}, weight double, n_words long, score double, terms array<string>")
