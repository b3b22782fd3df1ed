import random

import pytest

from lakeleaf.functions.udfs import ratio_of
from lakeleaf.operators import catalog


def edited(rng, word, n):
    out = list(word)
    for _ in range(n):
        at = rng.randrange(3, len(out) + 1)
        out[at : at + rng.randrange(2)] = rng.choice(["", "a", "b", "é", "é"])
    return "".join(out)


@pytest.mark.parametrize("least", [0.7, 0.88])
def test_alike_pairs_lose_no_correction(spark, least):
    rng = random.Random(4)
    words = ["".join(rng.choice("xyXé") for _ in range(3)) + "".join(rng.choice("abcdE") for _ in range(rng.randrange(0, 14))) for _ in range(250)] + ["étábcdef", "abΣ", "abΣcdefgh", "ab", "", None]
    tokens = [edited(rng, w, rng.randrange(4)) for w in words if w and len(w) > 4] + ["abΣcdefg", "étábcdeg", "abc", None]
    df = lambda rows, c: spark.createDataFrame([(r,) for r in set(rows)], f"{c} string")
    safe = lambda a, b: abs(len(a) - len(b)) <= 2 and a[:3] == b[:3] and len(b) >= 3
    want = {}
    for t in set(tokens) - set(words) - {None}:
        scored = [(-r, w) for w in set(words) - {None} if len(t) >= 4 and safe(t, w) and (r := ratio_of(t, w)) >= least]
        if scored:
            want[t] = min(scored)[1]
    got = {r["token"]: r["word"] for r in catalog.corrections(df(tokens, "token"), df(words, "word"), least).collect()}
    assert want and got == want


def test_a_block_is_not_compared_whole(spark):
    rng = random.Random(5)
    texts = [["str" + "".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(300)] for _ in range(2)]
    tokens, words = (spark.createDataFrame([(x,) for x in t], f"{c} string") for t, c in zip(texts, ("token", "word"), strict=True))
    assert catalog.alike(tokens, words, 0.88).count() < 300 * 300 / 10
