"""Correction of questions against a plain loop over all words."""

import random
import re

from lakeleaf.functions.udfs import ratio_of
from lakeleaf.operators import spelling

WORDS = r"[a-zA-Z]+"


def safe(a, b):
    return abs(len(a) - len(b)) <= 2 and a[:3] == b[:3] and len(a) >= 3


def best(token, words):
    some = [(-ratio_of(token, w), w) for w in words if len(w) >= 4 and safe(token, w) and ratio_of(token, w) >= 0.88]
    return min(some)[1] if some else None


def plain(question, known, titles, authors, headings):
    if question is None:
        return None
    split = lambda texts: {w for t in texts if t for w in re.findall(WORDS, t)}
    sure, out = split(known), question
    for token in re.findall(WORDS, question):
        if len(token) >= 4 and token not in sure and (word := best(token, sure)):
            out = out.replace(token, word, 1)
    texts = [t.lower() for t in titles + headings if t]
    for token in re.findall(WORDS, out):
        if len(token) < 4 or token in sure or any(token.lower() in t for t in texts):
            continue
        if word := best(token, split(titles) | split(authors) | split(headings)):
            out = out.replace(token, word, 1)
    return out


def test_equals_a_plain_loop(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randrange(3, 14))) for _ in range(120)]

    def typo(w):
        i = rng.randrange(len(w))
        return rng.choice([w, w, w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + w[i + 1 : i + 2] + w[i] + w[i + 2 :], w[2:], w.upper()])

    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    known = base[:20] + [None, ""]
    titles = [text(base[15:70], 3) for _ in range(40)] + [None]
    authors = [text(base[60:90], 2) for _ in range(20)]
    headings = [text(base[85:], 1) for _ in range(30)]
    asked = [", ".join(typo(rng.choice(base)) for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    asked += [asked[0], "", None, "  ?", "abc", base[5] + base[5], " ".join([base[3][:-1] + "x"] * 3)]
    one = lambda rows, name="text": spark.createDataFrame([(r,) for r in rows], f"{name} string")
    got = spelling.corrected_questions(one(asked, "question"), one(known), one(titles), one(authors), one(headings), WORDS)
    rows = [tuple(r) for r in got.collect()]
    want = {q: plain(q, known, titles, authors, headings) for q in asked}
    assert len(rows) == len(want) and dict(rows) == want
    assert sum(q != c for q, c in want.items()) > 60


def test_empty_tables(spark):
    none, asked = spark.createDataFrame([], "text string"), spark.createDataFrame([("some words",)], "question string")
    assert [tuple(r) for r in spelling.corrected_questions(asked, none, none, none, none).collect()] == [("some words", "some words")]
    assert spelling.corrected_questions(asked.limit(0), none, none, none, none).collect() == []
