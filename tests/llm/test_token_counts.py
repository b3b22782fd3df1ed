import itertools
import math

from hypothesis import given, settings
from hypothesis import strategies as st

from lakeleaf.llm import token_counts as tc
from lakeleaf.llm.queries import tokenizer_file

PIECES = {"▁": -3.0, "▁a": -2.0, "a": -2.5, "b": -2.5, "ab": -4.9, "▁ab": -4.0, "ba": -4.0, "bab": -6.5}


def brute(word, pieces):
    """Best (score, fewest tokens) over all ways to cut a word."""
    best = (-math.inf, 0)
    for cut in itertools.product((0, 1), repeat=len(word) - 1):
        parts, start = [], 0
        for i, c in enumerate(cut, 1):
            if c:
                parts.append(word[start:i])
                start = i
        parts.append(word[start:])
        score, count = 0.0, 0
        for p in parts:
            if p in pieces:
                score, count = score + pieces[p], count + 1
            elif len(p) == 1:
                score, count = score + len(p.encode()) * tc.BYTE_SCORE, count + len(p.encode())
            else:
                break
        else:
            best = max(best, (score, -count))
    return -best[1], best[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab▁é", min_size=1, max_size=8), min_size=1, max_size=6))
def test_trie_equals_all_segmentations(words):
    got = tc.trie_counts(words, PIECES, 3)
    for w in words:
        count, score = brute(w, PIECES)
        assert got[w][0] == count and math.isclose(got[w][1], score, abs_tol=1e-9)


def test_documents_equal_single_words(spark, small, odd, none):
    path = tokenizer_file(tc.VOCABULARY)
    pieces, longest = tc.unigram(path)
    alone = {}
    for df in (small.limit(40), odd):
        got = sorted(((r["doc_id"], r["n_pretokens"], r["n_tokens"]) for r in tc.token_counts(df, path).collect()), key=repr)
        want = []
        for r in df.select("doc_id", "text").collect():
            words = (r["text"] or "").split()
            alone |= tc.trie_counts([tc.SPACE + w for w in words if tc.SPACE + w not in alone], pieces, longest)
            want.append((r["doc_id"], len(words), sum(alone[tc.SPACE + w][0] for w in words)))
        assert got == sorted(want, key=repr)
    assert tc.token_counts(none, path).count() == 0


def test_a_full_cache_changes_nothing(spark, small):
    path = tokenizer_file(tc.VOCABULARY)
    some = lambda **k: sorted(tuple(r) for r in tc.token_counts(small, path, **k).collect())
    assert some() == some(cache_bytes=5000)


def test_the_trie_shares_prefixes_and_starts_anew_when_full():
    trie = tc.PrefixTrie(PIECES, 3)
    steps, grow = [], trie.grow
    trie.grow = lambda word, end, *rest: steps.append(word[:end]) or grow(word, end, *rest)
    words = ["abab", "abba", "ab", "abab"]
    first = [trie.insert(w) for w in words]
    assert sorted(steps) == ["a", "ab", "aba", "abab", "abb", "abba"]
    small = tc.PrefixTrie(PIECES, 3, most_nodes=1)
    assert [small.insert(w) for w in words] == first and len(small.scores) <= 1 + 1 + 4


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab▁é", min_size=1, max_size=60), min_size=1, max_size=6), st.integers(1, 9))
def test_runs_beyond_the_shared_prefix_count_alike(words, shared):
    whole = tc.trie_counts(words, PIECES, 3)
    before, tc.SHARED = tc.SHARED, shared
    try:
        assert tc.trie_counts(words, PIECES, 3) == whole
    finally:
        tc.SHARED = before


def test_a_long_run_takes_no_memory_but_its_own():
    import tracemalloc

    pieces, longest = tc.unigram(tokenizer_file(tc.VOCABULARY))
    word = tc.SPACE + "QmFzZTY0LW" * 40_000
    tracemalloc.start()
    trie = tc.PrefixTrie(pieces, longest)
    tokens, score = trie.insert(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(trie.scores) == 1 + tc.SHARED and peak < 4 << 20
    short, longer = (trie.insert(tc.SPACE + "QmFzZTY0LW" * n) for n in (1000, 2000))
    assert tokens == short[0] + 39 * (longer[0] - short[0])
    assert math.isclose(score, short[1] + 39 * (longer[1] - short[1]), rel_tol=1e-9)


def test_ends_that_are_no_pieces_are_not_tried_anew_at_every_character():
    import sys

    pieces = {"b" + "a" * 400: -9.0, "a": -2.0, "x": -3.0}
    trie, gets = tc.PrefixTrie(pieces, 401), 0

    def count(frame, event, what):
        nonlocal gets
        gets += event == "c_call" and what.__name__ == "get"

    words = [f"{'x' * i}{'a' * 900}" for i in range(1, 6)]
    sys.setprofile(count)
    try:
        got = [trie.insert(w) for w in words]
    finally:
        sys.setprofile(None)
    assert [n for n, _ in got] == [len(w) for w in words]
    assert gets < 5 * 5 * 900, gets
    tokens, score = trie.insert("xb" + "a" * 401)
    assert tokens == 3 and score == -3.0 - 9.0 - 2.0
