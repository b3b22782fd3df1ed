"""Quality rules with line sequence labelling.

Base rules count words, symbols, repeated lines and repeated 5-word windows of
a whole text.  Texts that pass them are labelled line by line as content or
boilerplate by Viterbi decoding of a linear-chain conditional random field;
the share of words in content lines decides.

No table labels lines, so the field learns them from document labels, as a
multiple-instance problem: lines of good documents are content; of a bad
document at least half of the words are boilerplate, but which lines these are
is hidden.  They begin as all lines and are then decoded by the field itself, a
few rounds long (hard expectation maximisation).  The features of a line are
measured shares of its characters and words and its place; no rule or list of
signs labels anything.  Fitting runs on the driver on a bounded, documented
sample of labelled texts (``rows_per_class``, at most ``max_chars`` each,
chosen by crc32 of the id) outside the fold with crc32 mod 5 = 0.  Labels are
never an input of a verdict, and scoring reads every text whole.

Defined cases: a null or empty text has no words and fails the base rules;
lines without words are skipped; equal texts get equal results; without labels
of both classes every line is content.  Every row gets a verdict, also rows that
repeat an id or have none; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from string import ascii_lowercase, ascii_uppercase, digits

import numpy as np
from pyspark.sql import DataFrame

from .common import keep_texts, map_batches, slices
from .labelled import labelled_sample

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
STOPS = (".", "!", "?", "…", ":", ";", '"', "'", ")", "»", "”")
NO_CAPITALS, NO_SMALL, NO_DIGITS = (str.maketrans("", "", chars) for chars in (ascii_uppercase, ascii_lowercase, digits))
WINDOW = 5
NAMES = (
    "bias", "words", "word_length", "long_words", "capitals", "digits", "symbols", "marks", "marked_words", "upper_words",
    "different_words", "commonest_word", "stop", "repeated", "first", "last",
)
RULES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, content_words long"
)


def words_of(text: str) -> list[str]:
    return WORD.findall(text)


def repeat_words(words: list[str]) -> int:
    """Words inside a window of WINDOW words that the text has at least twice."""
    if len(words) <= WINDOW:
        return 0
    number: dict[str, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    if len(number) == len(words):
        return 0
    windows = list(zip(*(ids[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, until = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + WINDOW - max(i, until)
            until = i + WINDOW
    return covered


def lines_of(text: str) -> tuple[list[str], list[bool], int]:
    """(lines with a word, whether each equals an earlier one, how many do)."""
    seen: set[str] = set()
    lines, again = [], []
    for line in text.split("\n"):
        if not WORD.search(line):
            continue
        lines.append(line)
        again.append(line in seen)
        seen.add(line)
    return lines, again, sum(again)


def letters_capitals_digits(line: str) -> tuple[int, int, int]:
    """How many characters of the whole line are letters, upper-case letters and digits."""
    if line.isascii():
        n = len(line)
        capitals = n - len(line.translate(NO_CAPITALS))
        return capitals + n - len(line.translate(NO_SMALL)), capitals, n - len(line.translate(NO_DIGITS))
    letters = capitals = numerals = 0
    for c, n in Counter(line).items():
        if c.isalpha():
            letters += n
            capitals += n * c.isupper()
        elif c.isdigit():
            numerals += n
    return letters, capitals, numerals


def line_features(line: str, repeated: bool, first: bool = False, last: bool = False) -> list[float]:
    """Measures of a line with a word, in the order of NAMES, each about 0 to 1."""
    words = words_of(line)
    n, chars = len(words), len(line)
    size = sum(map(len, words))
    letters, capitals, numerals = letters_capitals_digits(line)
    spaces = chars - size
    others = chars - spaces - letters - numerals
    counts = Counter(words)
    return [
        1.0,
        min(math.log1p(n) / 6, 2.0),
        min(size / n / 12, 2.0),
        sum(len(w) > 20 for w in words) / n,
        capitals / max(1, letters),
        numerals / size,
        len(SYMBOLS.findall(line)) / size,
        min(others / n, 2.0),
        sum(not w[-1].isalnum() for w in words) / n,
        sum(w.isupper() for w in words) / n,
        len(counts) / n,
        max(counts.values()) / n,
        float(words[-1].endswith(STOPS)),
        float(repeated),
        float(first),
        float(last),
    ]


def text_features(text: str) -> tuple[list[str], list[list[float]], int]:
    """(lines with a word, their features, how many equal an earlier one)."""
    lines, again, dups = lines_of(text)
    end = len(lines) - 1
    return lines, [line_features(x, r, i == 0, i == end) for i, (x, r) in enumerate(zip(lines, again, strict=True))], dups


class LineField:
    """weights: (2, features) for labels content 0 and boilerplate 1; steps: (2, 2) scores of label pairs."""

    def __init__(self, weights: np.ndarray | None = None, steps: np.ndarray | None = None):
        self.weights = np.zeros((2, len(NAMES))) if weights is None else weights
        self.steps = np.zeros((2, 2)) if steps is None else steps

    def viterbi(self, features: list[list[float]]) -> list[int]:
        """The best label sequence; content wins ties."""
        emit = np.array(features) @ self.weights.T
        steps, back = self.steps.tolist(), []
        a, b = emit[0]
        for x, y in emit[1:].tolist():
            from_a, from_b = a + steps[0][0] >= b + steps[1][0], a + steps[0][1] >= b + steps[1][1]
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = max(a + steps[0][0], b + steps[1][0]) + x, max(a + steps[0][1], b + steps[1][1]) + y
        label = 0 if a >= b else 1
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]

    def gradient(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log likelihood of padded sequences (sequence, line, feature), by the forward and backward recursions."""
        emit = x @ self.weights.T
        n, length = mask.shape
        log_sum = lambda v, axis: np.logaddexp.reduce(v, axis=axis)
        forward, backward = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        forward[:, 0] = emit[:, 0]
        for t in range(1, length):
            step = log_sum(forward[:, t - 1, :, None] + self.steps, 1) + emit[:, t]
            forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
        for t in range(length - 2, -1, -1):
            step = log_sum(self.steps + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], step, 0)
        whole = log_sum(forward[:, -1], 1)
        single = np.exp(forward + backward - whole[:, None, None]) * mask[:, :, None]
        truth = np.eye(2)[y] * mask[:, :, None]
        pair = np.exp(forward[:, :-1, :, None] + self.steps + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - whole[:, None, None, None]) * mask[:, 1:, None, None]
        both = truth[:, :-1, :, None] * truth[:, 1:, None, :]
        return np.einsum("nlk,nlf->kf", truth - single, x), (both - pair).sum((0, 1))

    def train(self, runs: list[list[list[float]]], labels: list[list[int]], chain: bool = True, steps: int = 80, ridge: float = 1e-3) -> LineField:
        """Gradient ascent with momentum on the likelihood of labelled runs of lines; without the chain, lines count alone."""
        length = max(map(len, runs))
        x, y, mask = np.zeros((len(runs), length, len(NAMES))), np.zeros((len(runs), length), int), np.zeros((len(runs), length), bool)
        for i, (run, known) in enumerate(zip(runs, labels, strict=True)):
            x[i, : len(run)], y[i, : len(run)], mask[i, : len(run)] = run, known, True
        speed = [0.0, 0.0]
        for _ in range(steps):
            by_weight, by_step = self.gradient(x, y, mask)
            speed = [0.9 * s + g / mask.sum() for s, g in zip(speed, (by_weight, by_step), strict=True)]
            self.weights, self.steps = self.weights * (1 - ridge) + speed[0], self.steps * (1 - ridge) + chain * speed[1]
        return self

    def margins(self, features: list[list[float]]) -> np.ndarray:
        """How much better boilerplate fits each line by itself."""
        emit = np.array(features) @ self.weights.T
        return emit[:, 1] - emit[:, 0]

    def fit(self, texts: list[str], good: list[int], rounds: int = 3, max_lines: int = 64) -> LineField:
        """Learns hidden line labels from document labels; a text's lines go in runs of max_lines."""
        found = [(text_features(t), g) for t, g in zip(texts, good, strict=True)]
        found = [(lines, features, g) for (lines, features, _), g in found if lines]
        if len({g for *_, g in found}) < 2:
            return self
        labels = [[1 - g] * len(lines) for lines, _, g in found]
        cut = lambda rows: [rows[i : i + max_lines] for i in range(0, len(rows), max_lines)]
        runs = [run for _, features, _ in found for run in cut(features)]
        for step in range(rounds):
            # All lines of a document begin alike, which says nothing about neighbours.
            self.train(runs, [run for known in labels for run in cut(known)], chain=step > 0)
            if step < rounds - 1:
                labels = [known if g else self.hidden(lines, features) for known, (lines, features, g) in zip(labels, found, strict=True)]
        return self

    def hidden(self, lines: list[str], features: list[list[float]]) -> list[int]:
        """Labels of a bad document's lines: as decoded, and beyond that its most likely lines until half of the words are boilerplate."""
        known, sizes = self.viterbi(features), [len(words_of(x)) for x in lines]
        lacking = sum(sizes) / 2 - sum(s for s, k in zip(sizes, known, strict=True) if k)
        for i in np.argsort(-self.margins(features), kind="stable").tolist():
            if lacking <= 0:
                break
            if not known[i]:
                known[i], lacking = 1, lacking - sizes[i]
        return known


def judge(text: str | None, field: LineField, min_words: int = 10, repeat_percent: int = 20, content_percent: int = 50) -> tuple:
    """The columns of RULES after doc_id."""
    text = text or ""
    words = words_of(text)
    lines, features, dups = text_features(text)
    n, repeats = len(words), repeat_words(words)
    failed = n < min_words or 100 * repeats > repeat_percent * n
    content = 0
    if lines:
        labels = field.viterbi(features)
        content = sum(len(words_of(line)) for line, label in zip(lines, labels, strict=True) if not label)
    kept = not failed and 100 * content >= content_percent * n
    return n, sum(map(len, words)), len(SYMBOLS.findall(text)), dups, repeats, failed, kept, len(lines), content


def labelled_lines(text: str | None, field: LineField) -> list[tuple[str, bool]]:
    """Each line with a word, and whether it is content."""
    lines, features, _ = text_features(text or "")
    return [(x, not label) for x, label in zip(lines, field.viterbi(features), strict=True)] if lines else []


def fit_field(documents: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, rows_per_class: int = 400, max_chars: int = 20_000) -> LineField:
    """A field fitted on a bounded sample of ``labels.quality``, the same on every run."""
    texts, good, _ = labelled_sample(documents, labels, "quality", folds, held_out, rows_per_class, max_chars)
    return LineField().fit(texts, good)


def apply_rules(documents: DataFrame, field: LineField) -> DataFrame:
    """One row (schema RULES) per document."""

    def judged(batches: Iterable) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([(n, pa.bool_() if t == "boolean" else pa.int64()) for n, t in (c.split() for c in RULES.split(", "))])
        for batch in batches:
            for part in slices(batch, 1):
                rows = [(d, *judge(t, field)) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return map_batches(documents.select("doc_id", "text"), judged, RULES)


def with_quality(documents: DataFrame, field: LineField) -> DataFrame:
    """The documents, all columns, that pass the base rules and hold enough content."""
    return keep_texts(documents, lambda t: judge(t, field)[6])
