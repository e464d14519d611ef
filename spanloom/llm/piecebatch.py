"""Byte-level BPE over length-bucketed matrices, and its inverse.

A vocabulary is a list of byte strings with ranks. Two neighbours may merge if their bytes together are in it; the pair's rank
is that of the whole. A piece merges its leftmost pair of the least rank until none is left.

Distinct new pieces of a stretch of texts are dealt into buckets by length (4, 8, 16, ... bytes) and padded to a matrix of
tokens with a matrix of their neighbours' ranks beside it. In each round every row of the matrix merges at its first place of
least rank: what stands to the right moves one place to the left, and the ranks of the two pairs that changed are looked up in
a hash table of pairs. Rows that have nothing left to merge leave the matrix, and columns that no row reaches any more are cut off
(compaction). Rounds cost a bucket's rows times its length, so pieces beyond the longest bucket (``LONGEST`` bytes) are merged one
by one with a heap of their pairs: the same merges in the same order, in n log n.

A task remembers the ids of pieces up to ``REMEMBERED`` bytes, ``CACHE`` of them at most before it forgets all. Texts longer
than a chunk are split in chunks, between characters that no piece of the pattern spans, so memory is that of a chunk and the
row that Arrow delivers, not of a text's pieces.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import map_rows

#: Characters of a chunk and of texts looked at together; longest piece of the matrices and longest one remembered, in bytes; pieces remembered; rows of a matrix.
CHUNK, STRETCH, LONGEST, REMEMBERED, CACHE, ROWS = 1 << 18, 1 << 19, 1024, 64, 400_000, 4096
#: Between these characters a piece always ends: text and blank, a letter and anything else, a digit and anything else.
SEAM = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})")
#: A rank that no pair has.
NONE = np.int32(2**31 - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Pairs:
    """A hash table from pairs of tokens to the rank of what they make: open addressing, looked up for whole arrays."""

    def __init__(self, tokens: list[bytes]):
        ids = {t: i for i, t in enumerate(tokens) if t}
        found = [(ids[a], ids[b], i) for t, i in ids.items() for k in range(1, len(t)) if (a := t[:k]) in ids and (b := t[k:]) in ids]
        left, right, made = np.array(found, np.int64).reshape(-1, 3).T
        names = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.bits = max(4, (2 * len(names)).bit_length())
        self.names, self.made = np.full(1 << self.bits, ~np.uint64(0)), np.full(1 << self.bits, NONE)
        at, rest = self._slot(names), np.arange(len(names))
        while len(rest):
            free = rest[self.names[at[rest]] == ~np.uint64(0)]
            self.names[at[free]] = names[free]  # of several that want a slot the last has it
            own = self.names[at[rest]] == names[rest]
            self.made[at[rest[own]]] = made[rest[own]]
            rest = rest[~own]
            at[rest] = at[rest] + 1 & (1 << self.bits) - 1

    def _slot(self, names: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (names * _ODD >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where the two make no token; a negative token pairs with nothing."""
        names = left.astype(np.int64).astype(np.uint64) << np.uint64(32) | right.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)
        at, out = self._slot(names), np.full(names.shape, NONE)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        while len(todo):
            slots = at[todo]
            seen = self.names[slots]
            hit = seen == names[todo]
            out[todo[hit]] = self.made[slots[hit]]
            todo = todo[~hit & (seen != ~np.uint64(0))]
            at[todo] = at[todo] + 1 & (1 << self.bits) - 1
        return out


class Vocabulary:
    """Byte strings by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes_of[i] = t
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.ranks, self.pairs = ranks, Pairs(self.bytes_of)
        self.names = [str(i) for i in range(len(self.bytes_of))]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Tokens of each piece."""
        out: list[list[int]] = [[] for _ in pieces]
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            buckets.setdefault(max(2, (len(piece) - 1).bit_length()), []).append(i)
        for power, rows in buckets.items():
            if 1 << power > LONGEST:
                for i in rows:
                    out[i] = self.merge_long(pieces[i])
                continue
            for at in range(0, len(rows), ROWS):
                part = rows[at : at + ROWS]
                for i, ids in zip(part, self.merge_matrix([pieces[i] for i in part], 1 << power), strict=True):
                    out[i] = ids
        return out

    def merge_matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """The rounds over one bucket: pieces of ``width`` bytes at most."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < size[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        # The last column pairs with nothing.
        ranks = np.full(ids.shape, NONE)
        ranks[:, :-1] = self.pairs.ranks(ids[:, :-1].reshape(-1), ids[:, 1:].reshape(-1)).reshape(len(pieces), -1)
        own = np.arange(len(pieces))
        out: list[list[int]] = [[]] * len(pieces)
        while len(own):
            place = ranks.argmin(axis=1)  # the first of the least
            rows = np.arange(len(own))
            least = ranks[rows, place]
            if (done := least == NONE).any():
                for i, row, n in zip(own[done], ids[done].tolist(), size[done], strict=True):
                    out[i] = row[:n]
                own, ids, ranks, size, place, least = own[~done], ids[~done], ranks[~done], size[~done], place[~done], least[~done]
                if not len(own):
                    break
                rows, cut = np.arange(len(own)), max(2, int(size.max()))
                ids, ranks = ids[:, :cut], ranks[:, :cut]
            # Everything to the right of the merged pair moves up by one.
            last = ids.shape[1] - 1
            source = np.minimum(np.arange(last + 1) + (np.arange(last + 1) > place[:, None]), last)
            ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
            ids[rows, place], ids[:, last], ranks[:, last] = least, -1, NONE
            size = size - 1
            right = np.where(place < last, ids[rows, np.minimum(place + 1, last)], -1)
            ranks[rows, place] = self.pairs.ranks(least, right)
            inner = np.flatnonzero(place > 0)
            before = place[inner] - 1
            ranks[inner, before] = self.pairs.ranks(ids[inner, before], least[inner])
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """One long piece: a heap of (rank, place) in one integer over linked places."""
        n, get, texts = len(piece), self.ranks.get, self.bytes_of
        ids = array("i", self.single[np.frombuffer(piece, np.uint8)].tolist())
        first = self.pairs.ranks(np.frombuffer(ids, np.int32)[:-1], np.frombuffer(ids, np.int32)[1:])
        rank = array("i", [*first.tolist(), NONE])
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        some = np.flatnonzero(first != NONE)
        heap = (first[some].astype(np.int64) << 32 | some).tolist() if n < 1 << 32 else [int(first[i]) << 32 | int(i) for i in some]
        heapq.heapify(heap)
        while heap:
            item = heapq.heappop(heap)
            r, i = item >> 32, item & 0xFFFFFFFF
            if rank[i] != r:
                continue
            j = after[i]
            ids[i], k = r, after[j]
            ids[j], rank[j], after[i] = -1, NONE, k
            if k < n:
                before[k] = i
                rank[i] = new = get(texts[r] + texts[ids[k]], NONE)
                if new != NONE:
                    heapq.heappush(heap, new << 32 | i)
            else:
                rank[i] = NONE
            if (h := before[i]) >= 0:
                rank[h] = new = get(texts[ids[h]] + texts[r], NONE)
                if new != NONE:
                    heapq.heappush(heap, new << 32 | h)
        return [x for x in ids if x >= 0]


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Parts of a text that split into the same pieces as the whole."""
    at = 0
    while len(text) - at > size:
        seam = SEAM.search(text, at + size)
        if seam is None:
            break
        yield text[at : seam.start()]
        at = seam.start()
    yield text[at:]


class Encoder:
    """Texts to ids, stretch by stretch."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str]) -> list[Iterator[int]]:
        """Ids of each of some texts, whose new pieces are merged together."""
        found = [self.find(t) for t in texts]
        new = [*set().union(*found).difference(self.known)]
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = [*set().union(*found)]
        merged = dict(zip(new, map(tuple, self.vocabulary.merge([p.encode() for p in new])), strict=True))
        self.known.update(item for item in merged.items() if len(item[0]) <= REMEMBERED)
        get = self.known.get if all(len(p) <= REMEMBERED for p in new) else lambda p: self.known.get(p) or merged[p]
        return [chain.from_iterable(map(get, pieces)) for pieces in found]

    def each(self, texts: Iterable[str]) -> Iterator[tuple[int, bool, list[int]]]:
        """(text's number, whether its last, ids): texts of up to a stretch together, longer ones chunk by chunk."""
        held: list[tuple[int, bool, str]] = []
        size = 0
        for i, text in enumerate(texts):
            parts = chunks(text)
            part = next(parts)
            while part is not None:
                following = next(parts, None)
                held.append((i, following is None, part))
                size += len(part)
                if size >= STRETCH or len(held) >= 4 * ROWS:
                    yield from self._flush(held)
                    held, size = [], 0
                part = following
        yield from self._flush(held)

    def _flush(self, held: list[tuple[int, bool, str]]) -> Iterator[tuple[int, bool, list[int]]]:
        for (i, last, _), ids in zip(held, self.encode([t for *_, t in held]), strict=True):
            yield i, last, [*ids]


def _rows(batch: pa.RecordBatch) -> Iterator[str]:
    return (v.as_py() or "" for v in batch.column(1))


def _source(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(column).alias(name))


def encode(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of each whole text; null and empty texts have no ids. Repeated rows give repeated rows."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary.load(vocabulary), pattern)
        for batch in batches:
            out: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for i, _, ids in encoder.each(_rows(batch)):
                out[i] += ids
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["key", "ids"])

    return map_rows(_source(docs, key, text, "text"), run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(ids: DataFrame, vocabulary: str, key: str = "doc_id", column: str = "ids") -> DataFrame:
    """(key, bytes): the inverse of ``encode``, before any reading as text; null ids give no bytes."""
    kind = ids.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Vocabulary.load(vocabulary).bytes_of
        for batch in batches:
            raw = pa.array([b"".join(map(table.__getitem__, v.as_py() or [])) for v in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), raw], names=["key", "bytes"])

    return map_rows(_source(ids, key, column, "ids"), run, f"key {kind}, bytes binary").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, n_bytes): each whole text encoded and its ids decoded, in digests.

    One pass without a shuffle; ids go into their digest and through the table of bytes into the other and are dropped. Null
    and empty texts have no tokens; repeated rows give repeated rows; an empty table gives an empty one.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary.load(vocabulary)
        encoder, table, digits = Encoder(own, pattern), own.bytes_of, own.names
        for batch in batches:
            out: list[tuple[int, str, str, int]] = []
            n, size, listed, decoded = 0, 0, hashlib.sha256(), hashlib.sha256()
            for _, last, ids in encoder.each(_rows(batch)):
                if ids:
                    listed.update(("," * (n > 0) + ",".join(map(digits.__getitem__, ids))).encode())
                    raw = b"".join(map(table.__getitem__, ids))
                    decoded.update(raw)
                    n, size = n + len(ids), size + len(raw)
                if last:
                    out.append((n, listed.hexdigest(), decoded.hexdigest(), size))
                    n, size, listed, decoded = 0, 0, hashlib.sha256(), hashlib.sha256()
            cols = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True))], names=names)

    return map_rows(_source(docs, key, text, "text"), run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long").withColumnRenamed("key", key)
