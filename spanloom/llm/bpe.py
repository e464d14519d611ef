"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse as a byte-to-text state machine.

Encoding a piece left to right, a token is stable once enough bytes beyond it have been seen. Enough is a property of the
merge list. Whether a symbol is still there when a merge of rank r looks for it depends on what stands to its right only
through merges of lower rank, whose own right symbols depend on merges of lower rank again. Taking the merges by rising
rank, the reach of such a chain is summed up once:

    reach[x] = max over merges (x, y) so far of  len(y) + max(reach[y], built[y])
    built[x y] = max(reach[y], built[y])   at the time of the merge that makes it

The largest value, with one token more for the token under way, is the merge list's sufficient lookahead. The transducer
never holds more than that and one block of bytes, however long the piece is.

A text passes in chunks. The splitter holds back what a chunk's end leaves open (the last two pieces, the beginning of a
special token) and hands a run that outgrows a chunk to the transducer bit by bit; tokens go to digests and to the decoder
as they come. So beyond the row itself, which Arrow delivers, memory does not grow with the text.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import map_rows

#: Fixed value: the split of text before merging, as the vocabulary's own format defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that a transducer takes at once, length up to which a list is quicker than a heap (the merges are the same), pieces remembered by a task, characters of a chunk, characters from which an open run is streamed.
BLOCK, SHORT, CACHE, CHUNK, LONG = 1024, 48, 200_000, 1 << 16, 2048
#: What goes on a run of each class of characters.
RUNS = {k: regex.compile(p) for k, p in {"letter": r"\p{L}*", "number": r"\p{N}*", "blank": r"\s*", "other": r"[^\s\p{L}\p{N}]*"}.items()}


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself if visible Latin-1, else the next code point from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """A vocabulary: byte strings of ids, merge ranks and the sufficient lookahead."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int]):
        self.ids, self.special = tokens, special
        self.bytes_of = {i: t for t, i in tokens.items()} | {i: t.encode() for t, i in special.items()}
        self.single = [tokens.get(bytes([b])) for b in range(256)]
        self.rank = {(tokens[a], tokens[b]): r for r, (a, b) in reversed([*enumerate(merges)])}
        self.made, self.none = [tokens[a + b] for a, b in merges], len(merges)
        self.lookahead = sufficient_lookahead(merges)

    @classmethod
    def from_json(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        pairs = [p if isinstance(p, list) else p.split(" ", 1) for p in file["model"]["merges"]]
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        return cls({raw(t): i for t, i in file["model"]["vocab"].items() if t not in special}, [(raw(a), raw(b)) for a, b in pairs], special)

    def merge(self, piece: bytes) -> list[int]:
        """All merges of a whole piece: lowest rank first, leftmost first among equals."""
        return self._merge_short(piece) if len(piece) <= SHORT else self._merge_long(piece)

    def _merge_short(self, piece: bytes) -> list[int]:
        """Ranks of all neighbours in a list; the least one is merged and its neighbours ranked anew."""
        ids = [self.single[b] for b in piece]
        get, none = self.rank.get, self.none
        ranks = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (r := min(ranks)) < none:
            i = ranks.index(r)
            ids[i : i + 2] = [new] = [self.made[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], new), none)
            if i < len(ranks):
                ranks[i] = get((new, ids[i + 1]), none)
        return ids

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap over a linked list, in n log n."""
        ids = [self.single[b] for b in piece]
        n, rank, made = len(ids), self.rank, self.made
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := rank.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (q, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (q := rank.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (q, h, ids[h], ids[i]))
        return [x for x in ids if x != -1]

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one piece that arrives in chunks."""
        transducer = Transducer(self)
        for chunk in chunks:
            yield from transducer.push(chunk)
        yield from transducer.end()


class Transducer:
    """One piece in, tokens out as soon as they are stable; memory holds twice the lookahead and one block."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, b""

    def push(self, chunk: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(chunk), BLOCK):
            self.held += chunk[at : at + BLOCK]
            if len(self.held) <= 2 * self.merges.lookahead:
                continue
            end, stable = 0, len(self.held) - self.merges.lookahead
            for token in self.merges.merge(self.held):
                if end + len(self.merges.bytes_of[token]) > stable:
                    break
                end += len(self.merges.bytes_of[token])
                out.append(token)
            self.held = self.held[end:]
        return out

    def end(self) -> list[int]:
        rest, self.held = self.held, b""
        return self.merges.merge(rest) if rest else []


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    reach: dict[bytes, int] = {}
    built: dict[bytes, int] = {}
    for a, b in merges:
        beyond = max(reach.get(b, 0), built.get(b, 0))
        built[a + b] = max(built.get(a + b, 0), beyond)
        reach[a] = max(reach.get(a, 0), len(b) + beyond)
    longest = max((len(a) + len(b) for a, b in merges), default=1)
    return max([0, *reach.values(), *built.values()]) + longest


class Encoder:
    """Text to ids, chunk by chunk. Pieces seen before come from a bounded memory, which is emptied when full."""

    def __init__(self, merges: Merges, pattern: str = PATTERN):
        self.merges, self.find = merges, regex.compile(pattern).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        names = sorted(merges.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.begins = {n[:k] for n in names for k in range(1, len(n))}
        self.longest = max(map(len, self.begins), default=0)
        self.run: tuple[str, Transducer] | None = None

    def piece(self, piece: str) -> tuple[int, ...]:
        if len(self.pieces) >= CACHE:
            self.pieces.clear()
        ids = tuple(self.merges.stream([piece.encode()]))
        if len(piece) <= SHORT:
            self.pieces[piece] = ids
        return ids

    def whole(self, found: list[str]) -> Iterator[int]:
        got = [*map(self.pieces.get, found)]
        if None in got:
            got = [ids or self.pieces.get(p) or self.piece(p) for ids, p in zip(got, found, strict=True)]
        return chain.from_iterable(got)

    def ids(self, text: str, chunk: int = CHUNK) -> Iterator[list[int]]:
        """Ids of a whole text in lists, one for each chunk; strings of special tokens become their ids, as the tokenizers
        library does by default."""
        held, self.run = "", None
        for at in range(0, len(text), chunk):
            out: list[int] = []
            held = self._take(held + text[at : at + chunk], at + chunk >= len(text), out)
            yield out

    def encode(self, text: str) -> list[int]:
        return [*chain.from_iterable(self.ids(text))]

    def _take(self, text: str, final: bool, out: list[int]) -> str:
        """Put what is settled into ``out``; what is not comes back."""
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.merges.special) else [text]
        for part in parts[:-1]:
            if part in self.merges.special:
                out.append(self.merges.special[part])
            else:
                self._split(part, True, out)
        last, kept = parts[-1], ""
        if not final:
            n = next((n for n in range(min(self.longest, len(last)), 0, -1) if last[-n:] in self.begins), 0)
            last, kept = last[: len(last) - n], last[len(last) - n :]
        return self._split(last, final, out) + kept

    def _split(self, text: str, final: bool, out: list[int]) -> str:
        if self.run is not None:
            kind, transducer = self.run
            n = RUNS[kind].match(text).end()
            going_on = n == len(text) and not final
            # A run's last blank may belong to what follows.
            take = n - 1 if kind == "blank" and n and (going_on or n < len(text)) else n
            out.extend(transducer.push(text[:take].encode()))
            text = text[take:]
            if going_on:
                return text
            out.extend(transducer.end())
            self.run = None
        found = self.find(text)
        if final or not found:
            out.extend(self.whole(found))
            return ""
        # The last piece may go on, and with the one before it may turn out to be a contraction.
        settled, open_ = found[:-2], found[-2:]
        out.extend(self.whole(settled))
        if len(last := open_[-1]) <= LONG:
            return "".join(open_)
        out.extend(self.whole(open_[:-1]))
        kind = next(k for k, r in RUNS.items() if r.match(last[-1]).end())
        self.run = kind, Transducer(self.merges)
        take = len(last) - (kind == "blank")
        out.extend(self.run[1].push(last[:take].encode()))
        return last[take:]


class Decoder:
    """Ids to text: a UTF-8 state machine that holds at most three bytes of an unfinished character; bad bytes become U+FFFD."""

    def __init__(self, merges: Merges):
        self.bytes_of, self.state = merges.bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)), final)

    def decode(self, lists: Iterable[list[int]]) -> Iterator[str]:
        """The text of lists of ids, in parts."""
        self.state.reset()
        for ids in lists:
            yield self.feed(ids)
        yield self.feed((), True)


def _machine(path: str) -> tuple[Encoder, Decoder]:
    """A task's own, so that its worker, which lives on for other work, is left with nothing of it."""
    merges = Merges.from_json(path)
    return Encoder(merges), Decoder(merges)


def _digests(encoder: Encoder, decoder: Decoder, text: str) -> tuple[int, str, str, int]:
    n, size, listed, decoded = 0, 0, hashlib.sha256(), hashlib.sha256()

    def passed() -> Iterator[list[int]]:
        nonlocal n
        for ids in encoder.ids(text):
            if ids:
                listed.update(("," * (n > 0) + ",".join(map(str, ids))).encode())
                n += len(ids)
            yield ids

    for part in decoder.decode(passed()):
        raw = part.encode()
        decoded.update(raw)
        size += len(raw)
    return n, listed.hexdigest(), decoded.hexdigest(), size


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of each whole text; null and empty texts have no ids. Repeated rows give repeated rows."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = _machine(vocabulary)
        for batch in batches:
            ids = pa.array([encoder.encode(v.as_py() or "") for v in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", "ids"])

    return map_rows(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(ids: DataFrame, vocabulary: str, key: str = "doc_id", column: str = "ids") -> DataFrame:
    """(key, text): the inverse of ``encode``; null ids give an empty text."""
    kind = ids.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = _machine(vocabulary)
        for batch in batches:
            texts = pa.array(["".join(decoder.decode([v.as_py() or []])) for v in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["key", "text"])

    return map_rows(ids.select(F.col(key).alias("key"), F.col(column).alias("ids")), run, f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, n_bytes): each whole text encoded and decoded again in one pass, in digests.

    Each chunk's ids go into their digest and through the decoder into the other and are dropped, so nothing of the corpus
    is shuffled or kept. Null and empty texts have no tokens; repeated rows give repeated rows.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _machine(vocabulary)
        for batch in batches:
            rows = [_digests(encoder, decoder, value.as_py() or "") for value in batch.column(1)]
            n, a, b, size = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(size, pa.int64())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"
    return map_rows(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, schema).withColumnRenamed("key", key)
