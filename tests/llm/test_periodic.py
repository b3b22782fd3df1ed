import hashlib
import random
import re
import zlib

import numpy as np

from lakeleaf.llm import periodic
from lakeleaf.llm.queries import QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    """All runs, by trying every period and every stretch of equal words at that distance."""
    n, out = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                stretch = words[i : j + q]
                if not any(all(stretch[x] == stretch[x + p] for x in range(len(stretch) - p)) for p in range(1, q)):
                    out.add((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(seed):
    rng = random.Random(seed)
    alphabet = "ab" if rng.random() < 0.5 else "abcd"
    words = [rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 13, 40]))]
    for _ in range(rng.randrange(4)):
        root = [rng.choice(alphabet + "xyz") for _ in range(rng.choice([1, 2, 3, 7, 20]))]
        words += (root * 12)[: rng.randrange(1, 6) * len(root) + rng.randrange(len(root))]
        words += [rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5]))]
    return words


def test_runs_equal_all_periods():
    for seed in range(400):
        texts = [[w.encode() for w in words_of(1000 * seed + i)] for i in range(3)]
        keys, begins = periodic.keyed(texts)
        for least in (2, 12):
            got = list(zip(*(x.tolist() for x in periodic.runs_of(keys, least)), strict=True))
            want = [(s + int(begins[i]), length, q) for i, t in enumerate(texts) for s, length, q in brute(t, least)]
            assert got == sorted(want, key=lambda r: (r[0], r[2])), (seed, least)


def test_fibonacci_word_and_one_word():
    a, b = [b"a"], [b"a", b"b"]
    for _ in range(10):
        a, b = b, b + a
    for words in (b, [b"x"] * 300, [b"x"]):
        keys, _ = periodic.keyed([words])
        assert list(zip(*(x.tolist() for x in periodic.runs_of(keys, 2)), strict=True)) == brute(words, 2)


def test_next_smaller():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 400):
        v = rng.permutation(n) if n < 400 else np.arange(n)[:: rng.choice([-1, 1])]
        assert periodic.next_smaller(v).tolist() == [next((j for j in range(i + 1, n) if v[j] < v[i]), n) for i in range(n)]


def expected(doc_id, text):
    words = WORDS.findall(text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def check(df):
    got = sorted(map(tuple, periodic.digests(periodic.find_runs(periodic.with_repeats(df))).collect()), key=repr)
    assert got == sorted((expected(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=repr)
    return got


def test_texts_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(words_of(i)) + rng.choice(["", " ", " "])) for i in range(600)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(r[1] > 0 for r in got) > 100


def test_odd_rows(spark, odd, none):
    rows = odd.filter("doc_id is null or doc_id <> 6")
    check(rows)
    (long,) = periodic.find_runs(odd.filter("doc_id = 6")).collect()
    assert long["n_words"] == 30_001 and [tuple(r) for r in long["runs"]] == [(0, 30_000, 1)] and long["collapsed"] == "word end."
    assert periodic.find_runs(none).count() == 0


def test_query_on_the_small_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = QUERIES["op12_runs"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    short = [r for r in rows if len(docs[r["doc_id"]]) < 6000]
    assert len(short) > 100
    for r in short:
        assert tuple(r) == expected(r["doc_id"], docs[r["doc_id"]])
