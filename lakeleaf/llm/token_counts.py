"""Token counts under a unigram language model, by dynamic programming over a trie.

The distinct pre-tokens of a worker are inserted in a trie.  A node holds the
forward score of its prefix, computed once, however many pre-tokens share it;
the node where a pre-token ends holds the token count and score of its best
segmentation.  A document sums its own.

The vocabulary is a public one, never trained here.  Its file has an order of
pieces but no probabilities; the unigram model takes log p = -log(rank + OFFSET)
(Zipf and Mandelbrot's law).  A character that no piece covers costs its UTF-8
bytes, as byte fallback does.  Among equal scores fewer tokens win.

No shuffle.  Memory: a slice of a batch, a trie of at most ``most_nodes`` nodes
(and one more pre-token), which is begun anew beyond that, and a cache of
results bounded in bytes.  Of a run of characters without white space the first
SHARED are nodes of the trie, shared as any prefix; the rest is folded with the
scores of the last ``longest`` prefixes alone, as no piece reaches further back,
so a run takes no memory beyond its own text.

Defined cases: a null or empty text has 0 pre-tokens and tokens and score 0;
repeated rows are counted each; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import RecentCache, map_batches, slices

VOCABULARY = "piece_bpe_32k.model"
OFFSET = 2.7
BYTE_SCORE = -14.0
SPACE = "▁"
SHARED = 1024
COUNTS = "doc_id long, n_pretokens long, n_tokens long, score double"


@lru_cache(maxsize=2)
def unigram(path: str) -> tuple[dict[str, float], int]:
    """(log probability by piece, length of the longest piece) of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {p: -math.log(rank + OFFSET) for rank, p in enumerate(pieces, 1)}, max(map(len, pieces), default=1)


class PrefixTrie:
    """Pre-tokens as a trie whose nodes hold the forward score and token count of their prefix.

    A node is made once, however many pre-tokens share it, and so is its step of
    the dynamic programme: the best last piece over the scores of the nodes above
    it.  The pieces that end there, by growing length, are those of its state: the longest
    end of the prefix that begins a piece (Aho and Corasick's automaton, its moves found
    when first asked for, ``most_moves`` of them kept).  A pre-token's last node holds its
    result; beyond SHARED characters ``rest`` goes on from the last node.
    """

    def __init__(self, pieces: dict[str, float], longest: int, most_nodes: int = 200_000, most_moves: int = 400_000):
        self.pieces, self.longest, self.most_nodes, self.most_moves = pieces, longest, most_nodes, most_moves
        self.begins = {p[:i] for p in ["", *pieces] for i in range(len(p) or 1) if p[:i] not in pieces}  # without the pieces themselves
        self.moves: dict[tuple[str, str], str] = {}
        self.found: dict[str, tuple[tuple[int, float], ...]] = {}
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.scores, self.tokens, self.states = [0.0], [0], [""]

    def insert(self, word: str) -> tuple[int, float]:
        """(tokens, score) of the best segmentation."""
        if len(self.scores) > self.most_nodes:
            self.clear()
        children, scores, tokens, states, node, path = self.children, self.scores, self.tokens, self.states, 0, [0]
        for end, char in enumerate(word[:SHARED], 1):
            child = children[node].get(char)
            if child is None:
                states.append(self.grow(word, end, states[node], path, scores, tokens))
                child = children[node][char] = len(children)
                children.append({})
            path.append(child)
            node = child
        return (tokens[node], scores[node]) if len(word) <= SHARED else self.rest(word, path)

    def move(self, state: str, char: str) -> str:
        """The state after one more character."""
        to = state + char
        while to not in self.begins and to not in self.pieces:
            to = to[1:]
        if to not in self.found:
            self.found[to] = tuple((n, self.pieces[to[-n:]]) for n in range(1, len(to) + 1) if to[-n:] in self.pieces)
        if len(self.moves) < self.most_moves:
            self.moves[state, char] = to
        return to

    def grow(self, word: str, end: int, state: str, path: Sequence[int], scores: list[float], tokens: list[int]) -> str:
        """Append the score and token count of word[:end]; those of its shorter prefix word[:i] stand at path[i].  Its state."""
        char = word[end - 1]
        to = self.moves.get((state, char))
        if to is None:
            to = self.move(state, char)
        found = self.found[to]
        best, count = -math.inf, 0
        for n, p in found:
            before = path[end - n]
            score = scores[before] + p
            if score > best or score == best and tokens[before] + 1 < count:
                best, count = score, tokens[before] + 1
        if not found or found[0][0] > 1:
            n, before = len(char.encode("utf-8", "surrogatepass")), path[end - 1]
            score = scores[before] + n * BYTE_SCORE
            if score > best or score == best and tokens[before] + n < count:
                best, count = score, tokens[before] + n
        scores.append(best)
        tokens.append(count)
        return to

    def rest(self, word: str, path: list[int]) -> tuple[int, float]:
        """(tokens, score) of a word longer than its path in the trie."""
        near, state = path[-self.longest :], self.states[path[-1]]
        scores, tokens = [self.scores[i] for i in near], [self.tokens[i] for i in near]
        for end in range(len(path), len(word) + 1):
            state = self.grow(word, end, state, range(len(scores) - end, len(scores)), scores, tokens)
            if len(scores) > 2 * self.longest + SHARED:
                del scores[: -self.longest], tokens[: -self.longest]
        return tokens[-1], scores[-1]


def trie_counts(pretokens: Iterable[str], pieces: dict[str, float], longest: int) -> dict[str, tuple[int, float]]:
    """(tokens, score) of the best segmentation of each distinct pre-token, by one trie."""
    trie = PrefixTrie(pieces, longest)
    return {word: trie.insert(word) for word in set(pretokens)}


def token_counts(documents: DataFrame, vocabulary: str, cache_bytes: int = 128 << 20) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, score of every document; ``vocabulary`` is a file every executor has."""

    def counted(batches: Iterable) -> Iterator:
        import pyarrow as pa

        trie, known = PrefixTrie(*unigram(vocabulary)), RecentCache(cache_bytes)
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and the collector would walk the trie's dictionaries again and again
        try:
            for batch in batches:
                for part in slices(batch, 1):
                    texts = [(t or "").split() for t in part.column(1).to_pylist()]
                    # Sorted, so that neighbours share their path while it is at hand.
                    get = known.lookup(set().union(*texts), lambda new: {w: trie.insert(SPACE + w) for w in sorted(new)}).__getitem__
                    values = [tuple(zip(*map(get, words), strict=True)) or ((), ()) for words in texts]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).cast(pa.int64()),
                            pa.array([len(tokens) for tokens, _ in values], pa.int64()),
                            pa.array([sum(tokens) for tokens, _ in values], pa.int64()),
                            pa.array([math.fsum(scores) for _, scores in values], pa.float64()),
                        ],
                        ["doc_id", "n_pretokens", "n_tokens", "score"],
                    )
        finally:
            if collects:
                gc.enable()

    return map_batches(documents.select("doc_id", "text"), counted, COUNTS)
