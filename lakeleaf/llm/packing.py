"""Harmonic packing of tokenised documents into fixed-length sequences.

A piece of length l is of class k when capacity / (k + 1) < l <= capacity / k;
the bins of class k take exactly k pieces.  Every worker fills its own bins, so
packing needs no shuffle.  Documents may be cut: whole sequences come off
first, and a rest that would leave its slot emptier than ``slack`` allows is
cut to the next class's exact slot.  The few pieces that a worker still holds
at its end fill plain sequences, the last of which are cut to powers of two,
which need no padding.

Defined cases: a null or empty text is a document of the end id alone; equal
documents are packed each; a null doc_id stays null; other columns are ignored.
Memory: one slice of a batch, caches of token ids bounded in bytes and, per
class k, fewer than k pieces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import RecentCache, map_batches, slices

END_ID = 1
#: Of token ids by chunk, per Python worker, where packing has the executors for itself.
CACHE_BYTES = 400 << 20
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_length long"


class CachedTokenizer:
    """Token ids (as little-endian uint32 bytes) by the tokenizers library.

    Byte-level BPE never merges across a single space between two characters
    that are no white space, so the ids of a text are those of its chunks, each
    with its leading space.  A chunk that begins or ends with white space, or is
    empty, has no ids of its own; texts that hold one are encoded as a whole.
    Letters with one mark after them are two pre-tokens and share the letters'
    ids.  Unknown chunks of a slice are encoded in one call.  Caches are bounded
    in bytes, and long chunks (texts without spaces) are not kept.
    """

    MARKS = ".,"

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer, self.np = Tokenizer.from_file(path), np
        self.known, self.heads = RecentCache(cache_bytes), RecentCache(cache_bytes // 32)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.leads = np.array([n[:1] == "Ġ" for n in names])
        self.marks = {m: self.whole(m) for m in self.MARKS}

    def whole(self, text: str) -> bytes:
        return self.np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def learn(self, chunks: set[str]) -> dict[str, bytes | None]:
        """Encode chunks joined, and cut the ids where a token leads with a space."""
        found, marked, plain, marks = {}, [], [], self.marks
        for c in chunks:
            end = c[-1:]
            if end in marks and c[:-1].isalpha():
                marked.append(c)
            elif end.isspace() or c[:1].isspace() or not c:
                found[c] = None
            else:
                plain.append(c)
        young, old, held = self.known.young, self.known.old, {}
        for c in marked:
            bare = c[:-1]
            ids = young.get(bare) or old.get(bare)
            if ids is None:
                plain.append(bare)
            else:
                held[bare] = ids
        plain = list(set(plain))
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            ids = self.np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            starts = self.np.flatnonzero(self.leads[ids])
            if len(starts) != len(some) or starts[0]:
                found.update((c, self.whole(" " + c)) for c in some)
                continue
            data, bounds = ids.tobytes(), [*(starts * 4).tolist(), len(ids) * 4]
            found.update(zip(some, map(data.__getitem__, map(slice, bounds, bounds[1:])), strict=True))
        for c in marked:
            found[c] = (found.get(c[:-1]) or held[c[:-1]]) + marks[c[-1]]
        return found

    def encode(self, texts) -> list[bytes]:
        """Ids of the texts of an Arrow array or a list.

        Arrow splits the texts and numbers their chunks, so that a chunk is a
        Python string and asked for once a slice, and numpy gathers its ids.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        np = self.np
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts):
            return []
        parts = pc.split_pattern(texts, " ")
        bounds = parts.offsets.to_numpy()
        bounds, coded = bounds - bounds[0], parts.flatten().dictionary_encode()
        codes, chunks, firsts = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False), bounds[:-1]
        heads, rest = chunks[codes[firsts]].tolist(), codes.copy()
        rest[firsts] = len(chunks)
        used = np.flatnonzero(np.bincount(rest, minlength=len(chunks) + 1)[:-1])
        names = chunks[used].tolist()
        pooled = list(map(self.known.lookup(set(names), self.learn).__getitem__, names))
        alone = np.zeros(len(names) + len(heads), bool)
        alone[len(names) :] = [not h or h[-1].isspace() for h in heads]
        if None in pooled:
            alone[: len(names)] = [ids is None for ids in pooled]
            pooled = [ids or b"" for ids in pooled]
        pooled += map(self.heads.lookup(set(heads), lambda new: {f: self.whole(f) for f in new}).__getitem__, heads)
        # The place of every chunk in the pool of ids, where each text's head has its own after the chunks in use.
        place = np.zeros(len(chunks) + 1, np.int64)
        place[used] = np.arange(len(used))
        at = place[rest]
        at[firsts] = len(used) + np.arange(len(heads))
        pool, sizes = np.frombuffer(b"".join(pooled), "<u4"), np.fromiter(map(len, pooled), np.int64, len(pooled)) // 4
        lengths = sizes[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1])
        data = pool[np.arange(total) + np.repeat((np.cumsum(sizes) - sizes)[at] - ends + lengths, lengths)].tobytes()
        cuts = [0, *(ends[bounds[1:] - 1] * 4).tolist()]
        whole = np.logical_or.reduceat(alone[at], firsts).tolist()
        return [self.whole(texts[i].as_py()) if w else data[cuts[i] : cuts[i + 1]] for i, w in enumerate(whole)]


@lru_cache(maxsize=1)
def tokenizer_of(path: str, cache_bytes: int = CACHE_BYTES) -> CachedTokenizer:
    return CachedTokenizer(path, cache_bytes)


@lru_cache(maxsize=4096)
def cuts(rest: int, capacity: int, slack: float, smallest: int) -> tuple[int, ...]:
    """Lengths of the pieces of a rest shorter than the capacity."""
    out = []
    while rest:
        k = capacity // rest
        slot = capacity // (k + 1)
        if k * rest >= capacity * (1 - slack) or slot < smallest:
            out.append(rest)
            break
        out.append(slot)
        rest -= slot
    return tuple(out)


def powers(total: int) -> list[int]:
    """Powers of two, descending, that add up to the total."""
    return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


class HarmonicPacker:
    """Takes documents, gives finished sequences: (sequence number, [piece, ...]), a piece being (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int = 2048, slack: float = 0.03, smallest: int = 32):
        self.capacity, self.slack, self.smallest = capacity, slack, smallest
        self.open: dict[int, list] = {}
        self.made = 0

    def number(self, pieces: list) -> tuple[int, list]:
        self.made += 1
        return self.made - 1, pieces

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple[int, list]]:
        total, at = len(ids) // 4, 0
        for length in [self.capacity] * (total // self.capacity) + list(cuts(total % self.capacity, self.capacity, self.slack, self.smallest)):
            piece = doc_id, at, ids[4 * at : 4 * (at + length)], total
            at += length
            k = self.capacity // length
            held = self.open.setdefault(k, [])
            held.append(piece)
            if len(held) == k:
                yield self.number(self.open.pop(k))

    def finish(self) -> Iterator[tuple[int, list]]:
        """The pieces of unfilled bins, cut into full sequences and then powers of two."""
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open.clear()
        tokens = sum(len(p[2]) // 4 for p in rest)
        for room in [self.capacity] * (tokens // self.capacity) + powers(tokens % self.capacity):
            pieces = []
            while room:
                doc_id, start, ids, total = rest.pop(0)
                if len(ids) > 4 * room:
                    rest.insert(0, (doc_id, start + room, ids[4 * room :], total))
                    ids = ids[: 4 * room]
                pieces.append((doc_id, start, ids, total))
                room -= len(ids) // 4
            yield self.number(pieces)


def pack(documents: DataFrame, tokenizer: str, capacity: int = 2048, slack: float = 0.03, smallest: int = 32, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Pieces of all documents (schema PIECES; ids as little-endian uint32), each document ending with END_ID.

    Workers keep their cache from task to task; beside other stages it wants a smaller bound.

    ``sequence_id`` is the task's partition number in the upper bits and its own count below.
    """

    def packed(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        def rows(sequences: Iterable[tuple[int, list]]) -> None:
            for number, pieces in sequences:
                filled, offset = sum(len(p[2]) // 4 for p in pieces), 0
                padded = filled if filled & (filled - 1) == 0 else capacity
                for doc_id, start, ids, total in pieces:
                    length = len(ids) // 4
                    out.append((doc_id, start, length, ids, total, base + number, offset, filled, padded))
                    offset += length

        def taken() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in (c.split()[0] for c in PIECES.split(", "))])
        base, end = TaskContext.get().partitionId() << 40, END_ID.to_bytes(4, "little")
        packer, encoder = HarmonicPacker(capacity, slack, smallest), tokenizer_of(tokenizer, cache_bytes)
        out: list[tuple] = []
        for batch in batches:
            for part in slices(batch, 1, 4096, 4 << 20):
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                    rows(packer.add(doc_id, ids + end))
                if out:
                    yield taken()
        rows(packer.finish())
        if out:
            yield taken()

    return map_batches(documents.select("doc_id", "text"), packed, PIECES)
