"""Toxicity by maximum-scoring segments.

A token's score is its log-odds between toxic and clean labelled texts (counted
once a text), moved towards zero by its uncertainty, with Dirichlet priors: the
prior of a word is its prefix's rate, whose own prior is the rate over both
classes, so unseen forms of a toxic stem are known.  One
linear scan over a text (Ruzzo and Tompa's algorithm) finds all its maximal
scoring segments.  Under clean text the best score follows an extreme-value
law (Karlin and Altschul): a segment of score S among n tokens is significant
when lambda * S - log(K * n) exceeds -log of the level.  The excess of the
significant segments is turned into a probability by logistic regression.

The model is fitted on the driver on a bounded, documented sample of labelled
rows of the training folds (``rows_per_class``, texts of at most ``max_chars``):
one half gives the counts, the other half the calibration.  The drift taken
off every token and the weight of its uncertainty are chosen from CHOICES by an
inner split: calibrated on a quarter of the sample, judged on another quarter.
Scoring reads every text whole.

Defined cases: null and empty texts, and texts without word characters, have no
segment and get the probability of that; equal texts have equal scores;
without labels of both classes every score is the labels' share.  Every row
gets a score, also rows that repeat an id or have none (a null id counts as the
empty text for the fold, and is never learned from); an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_cnn import fit_combine, sigmoid
from .common import bucket_mod, keep_texts, map_batches, slices
from .labelled import labelled_sample

TOKEN = re.compile(r"\w+")
PREFIX = 5
WORD_PRIOR, PREFIX_PRIOR = 1e5, 1e4
#: (drift, standard deviations) that a fit chooses from, by its inner split; the first wins ties.
CHOICES = tuple((drift, deviations) for deviations in (1.0, 0.5) for drift in (0.7, 0.4, 1.0))
EULER = 0.5772156649015329
SCORES = "doc_id long, score double"
PASSAGES = "doc_id long, begin long, end long, segment_score double, p_value double, passage string"


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [begin, end) with their scores, in linear time."""
    found: list[list] = []  # begin, end, sum before it, sum through it, index of the nearest candidate with a smaller sum before it
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        begin, left = i, before
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            begin, left = found[j][0], found[j][2]
            del found[j:]
            j -= 1
        found.append([begin, i + 1, left, total, j])
    return [(b, e, t - x) for b, e, x, t, _ in found]


@dataclass
class ToxicityModel:
    words: dict[str, float]
    prefixes: dict[str, float]
    drift: float = CHOICES[0][0]
    rate: float = 1.0
    log_k: float = 0.0
    combine: np.ndarray | None = None
    level: float = 0.05

    def token_score(self, token: str) -> float:
        s = self.words.get(token)
        return (self.prefixes.get(token[:PREFIX], 0.0) if s is None else s) - self.drift

    def scan(self, tokens: list[str]) -> list[tuple[int, int, float, float]]:
        """Significant segments: begin, end, score, excess over the extreme-value law's location.

        Runs of tokens that score at most zero only separate candidates, so they are summed first.
        """
        words, prefixes = self.words, self.prefixes
        scores = [s if (s := words.get(t)) is not None else prefixes.get(t[:PREFIX], 0.0) for t in tokens]
        values = np.array(scores) - self.drift
        hits = np.flatnonzero(values > 0)
        if not len(hits):
            return []
        sums = np.concatenate([[0.0], np.cumsum(values)])
        packed, place = [], []
        last = int(hits[0])
        for h in hits.tolist():
            packed += [float(sums[h] - sums[last]), float(values[h])]
            place += [last, h]
            last = h + 1
        location = self.log_k + math.log(len(tokens))
        return [(place[b], place[e - 1] + 1, s, x) for b, e, s in segments(packed) if (x := self.rate * s - location) > -math.log(self.level)]

    def features(self, tokens: list[str]) -> np.ndarray:
        excess = [x for *_, x in self.scan(tokens)]
        return np.array([min(max(excess, default=0.0), 20.0), math.log1p(sum(excess)), 1.0])

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.features(tokens_of(text)) @ self.combine))


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def log_odds(
    toxic: Counter, clean: Counter, prior: dict[str, tuple[float, float]] | None, strength: float, deviations: float
) -> tuple[dict[str, float], dict[str, tuple[float, float]]]:
    """Per item the log-odds, moved so many standard deviations towards 0, and its smoothed rates in both classes.

    Without a prior by item, the pooled rate is the prior.
    """
    n_toxic, n_clean = max(1, toxic.total()), max(1, clean.total())
    odds, rates = {}, {}
    for item in toxic.keys() | clean.keys():
        pooled = (toxic[item] + clean[item]) / (n_toxic + n_clean)
        p_toxic, p_clean = prior[item[:PREFIX]] if prior else (pooled, pooled)
        a, b = (toxic[item] + strength * p_toxic) / (n_toxic + strength), (clean[item] + strength * p_clean) / (n_clean + strength)
        deviation = math.sqrt(1 / max(toxic[item] + strength * p_toxic, 1e-9) + 1 / max(clean[item] + strength * p_clean, 1e-9))
        delta = math.log(a / b)
        odds[item], rates[item] = math.copysign(max(0.0, abs(delta) - deviations * deviation), delta), (a, b)
    return odds, rates


def count_model(texts: list[list[str]], labels: np.ndarray, drift: float = CHOICES[0][0], deviations: float = CHOICES[0][1]) -> ToxicityModel:
    """Scores of words and of prefixes; a word that its prefix speaks for within 0.05 only adds to the model's size and is left out."""
    counts = [Counter(), Counter()]
    for tokens, label in zip(texts, labels, strict=True):
        counts[int(label)].update(set(tokens))
    stems = [Counter(), Counter()]
    for c, s in zip(counts, stems, strict=True):
        for word, n in c.items():
            s[word[:PREFIX]] += n
    prefixes, rates = log_odds(stems[1], stems[0], None, PREFIX_PRIOR, deviations)
    words, _ = log_odds(counts[1], counts[0], rates, WORD_PRIOR, deviations)
    return ToxicityModel({w: s for w, s in words.items() if abs(s - prefixes[w[:PREFIX]]) > 0.05}, prefixes, drift)


def rate_of(scores: np.ndarray) -> float:
    """lambda > 0 with mean(exp(lambda * score)) = 1; scores have a negative mean."""
    if scores.mean() >= 0 or scores.max() <= 0:
        return 1.0
    low, high = 0.0, 1.0
    while np.exp(np.minimum(high * scores, 700)).mean() < 1 and high < 64:
        low, high = high, high * 2
    low = low or 1e-6
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if np.exp(np.minimum(middle * scores, 700)).mean() < 1 else (low, middle)
    return (low + high) / 2


def calibrate(model: ToxicityModel, texts: list[list[str]], labels: np.ndarray, share: float) -> np.ndarray:
    """Fits the extreme-value law on the clean texts and then the combination on all; returns the features."""
    clean = [t for t, label in zip(texts, labels, strict=True) if not label and t]
    if clean:
        model.rate = rate_of(np.array([model.token_score(w) for t in clean for w in t]))
        best = [model.rate * max((s for *_, s in segments([model.token_score(w) for w in t])), default=0.0) - math.log(len(t)) for t in clean]
        model.log_k = float(np.mean(best)) - EULER
    features = np.array([model.features(t) for t in texts])
    model.combine = fit_combine(features, labels.astype(float), share)
    return features


def log_loss(scores: np.ndarray, labels: np.ndarray, share: float) -> float:
    """Of both classes, weighed so that label 1 has the given share."""
    own = np.where(labels == 1, scores, 1 - scores).clip(1e-9, 1)
    return float(-(share * np.log(own[labels == 1]).mean() + (1 - share) * np.log(own[labels == 0]).mean()))


def fit(texts: list[str], labels: list[int], share: float, choices: tuple = CHOICES) -> ToxicityModel | float:
    """A fitted model, or the constant score where one class is missing."""
    y, place = np.array(labels), np.zeros(len(labels), int)
    for label in (0, 1):  # every class is dealt to the four quarters in turn
        place[y == label] = np.arange((y == label).sum()) % 4
    both = lambda part: len(set(y[part].tolist())) == 2
    count, rest = place % 2 == 0, place % 2 == 1
    if not len(y) or not both(count) or not both(rest):
        return share
    tokens, share = [tokens_of(t) for t in texts], min(max(share, 0.01), 0.99)
    take = lambda part: ([tokens[i] for i in np.flatnonzero(part)], y[part])
    inner, judge = place == 1, place == 3
    if both(inner) and both(judge) and len(choices) > 1:
        losses = []
        for choice in choices:
            model = count_model(*take(count), *choice)
            calibrate(model, *take(inner), share)
            held, truth = take(judge)
            losses.append(log_loss(sigmoid(np.array([model.features(t) for t in held]) @ model.combine), truth, share))
        choices = (choices[int(np.argmin(losses))],)
    model = count_model(*take(count), *choices[0])
    calibrate(model, *take(rest), share)
    return model


def fit_toxicity(documents: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, rows_per_class: int = 3000, max_chars: int = 20_000) -> ToxicityModel | float:
    return fit(*labelled_sample(documents, labels, "toxic", folds, held_out, rows_per_class, max_chars))


def score_toxicity(documents: DataFrame, model: ToxicityModel | float) -> DataFrame:
    """doc_id, score of every document."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterable) -> Iterator:
        import pyarrow as pa

        model = held.value
        for batch in batches:
            for part in slices(batch, 1):
                scores = [model if isinstance(model, float) else model.score(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return map_batches(documents.select("doc_id", "text"), scored, SCORES)


def toxic_passages(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """Every significant passage: doc_id, begin, end (code points), segment_score, p_value, passage."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def found(batches: Iterable) -> Iterator:
        import pyarrow as pa

        model = held.value
        kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
        schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in PASSAGES.split(", "))])
        for batch in batches:
            for part in slices(batch, 1, 256):
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    places = list(TOKEN.finditer(text or ""))
                    for b, e, s, x in model.scan([m[0].lower() for m in places]):
                        begin, end = places[b].start(), places[e - 1].end()
                        rows.append({"doc_id": doc_id, "begin": begin, "end": end, "segment_score": s, "p_value": -math.expm1(-math.exp(-x)), "passage": text[begin:end]})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return map_batches(documents.select("doc_id", "text"), found, PASSAGES)


def classify_toxicity(
    documents: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held_out: int = 2, rows_per_class: int = 3000, max_chars: int = 20_000
) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit_toxicity(documents, labels, folds, held_out, rows_per_class, max_chars)
    scores = score_toxicity(documents, model)
    return scores.select("doc_id", (bucket_mod("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, model: ToxicityModel | float, threshold: float = 0.3) -> DataFrame:
    """The documents, all columns, whose score stays under the threshold."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    score = lambda t: held.value if isinstance(held.value, float) else held.value.score(t)
    return keep_texts(documents, lambda t: score(t) < threshold)
