"""Language-model scoring by online logistic context mixing.

A text is its lower-cased words and one end. A word is its bytes and a blank, the end is a blank alone, and every byte is
coded as eight binary decisions. Five predictors, each with bit counts under a hashed context within the word (the last one,
two, three or four bytes, the whole prefix), give log-odds. A gate, chosen by how much has been seen under the longest
contexts, selects the weights that mix them; an adaptive probability map refines the mix. A text's score is the log10
probability of all its bits, a proper distribution over token sequences.

Counts of contexts of up to four bytes are dense tables, sized by the number of distinct words up to ``MOST_BITS`` and
broadcast. Whole prefixes grow with the corpus without bound, so they are never gathered: words are dealt out by their first
five bytes and sorted, and each task keeps exact counts, under 64-bit names, of the stretch of prefixes it is at (a prefix
of four bytes or less is a context of the fourth predictor already).

Each task then runs online over all its distinct words: predict a small batch with one occurrence of itself taken out of the
counts, correct the weights by the coding error, and after a third of the way let the map adapt too. Tasks' weights are
averaged and maps summed. With these every distinct word of the corpus is scored once, and texts look their words up: the
commonest in a broadcast, all others by a join. What is broadcast only saves work; no score depends on it.

Texts of different languages share few words, so all contexts are kept apart by class, and a text is a mixture: the class
is drawn by its share of the training texts, then all words under it. Classes are the training rows' values of ``group``
(the commonest, and one for all others); a scored text's own value is never looked at. Given the class no context reaches
beyond its word.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import repeat
from math import log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Sorted, discard, map_rows, materialize, remainder, words

#: log2 of the slots of the tables of contexts of one to four bytes: at least, and at most.
LEAST_BITS, MOST_BITS = (16, 16, 16, 16), (18, 20, 21, 21)
#: Bytes by which words are dealt out; prefixes of so many or more are counted where their words are.
SHARED = 5
GATES, BUCKETS = 72, 49
#: Distinct words to a task that fills dense tables, to one that learns and scores, to a batch of learning, and to a stretch whose prefixes are counted together; least batches of a task's learning.
TABLE_WORDS, TASK_WORDS, BATCH, STRETCH, LEAST_BATCHES = 250_000, 60_000, 512, 20_000, 30
#: Distinct words held by a task; words whose figures are broadcast.
HELD, COMMON = 200_000, 1 << 17
#: Most classes.
CLASSES = 8
DELTA, SEGMENT = 0.1, 1 << 16
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Stream:
    """The bytes of a batch of words, each followed by a blank, with the hash of each predictor's context."""

    def __init__(self, batch: list[bytes], classes: np.ndarray):
        size = np.fromiter(map(len, batch), np.int64, len(batch)) + 1
        self.starts = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(batch) else np.zeros(0, np.int64)
        self.bytes = np.frombuffer(b" ".join([*batch, b""]), np.uint8)
        n = len(self.bytes)
        self.owner = np.repeat(np.arange(len(batch)), size)
        self.place = np.arange(n) - np.repeat(self.starts, size)
        before = []
        for back in range(1, 5):
            b = np.zeros(n, np.uint64)
            b[back:] = self.bytes[:-back]
            before.append(np.where(self.place >= back, b, np.uint64(0)))
        one, two = before[0], before[0] | before[1] << np.uint64(8)
        three = two | before[2] << np.uint64(16)
        # The prefix's hash is a sum of powers of an odd multiplier, so it comes from one running sum over all words.
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(int(_M1), -1, 1 << 64))
            power = np.cumprod(np.full(n, inverse, np.uint64)) if n else np.zeros(0, np.uint64)
            total = np.concatenate([[np.uint64(0)], np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * power)]).astype(np.uint64)
            back = np.cumprod(np.full(n, _M1, np.uint64)) if n else np.zeros(0, np.uint64)
            first = np.repeat(self.starts, size)
            prefix = (total[:-1] - total[first]) * back[np.maximum(first - 1, 0)] * np.where(first > 0, np.uint64(1), inverse) if n else np.zeros(0, np.uint64)
            own = classes.astype(np.uint64)[self.owner] * _M1 if n else np.zeros(0, np.uint64)
            self.contexts = [one * _M3 + own, two * _M2 + own, three * _M2 + _M3 + own, (three | before[3] << np.uint64(24)) * _M3 + _M2 + own, (prefix + own) * _M2 + _M1]

    def take(self, at: np.ndarray) -> Stream:
        """The chosen bytes alone, with their contexts."""
        part = object.__new__(Stream)
        part.bytes, part.place, part.contexts = np.take(self.bytes, at), np.take(self.place, at), [np.take(c, at) for c in self.contexts]
        return part

    @cached_property
    def high(self) -> list[np.ndarray]:
        """What the eight decisions of a byte share in their slots."""
        return [c >> np.uint64(29) for c in self.contexts[:4]]

    def slots(self, node: np.ndarray, bits: tuple[int, ...]) -> list[np.ndarray]:
        """Slots in the dense tables."""
        with np.errstate(over="ignore"):
            turned = node * _M1
            return [(((c ^ turned) * _M2 ^ h) * _M3 >> np.uint64(64 - t)).view(np.int64) for c, h, t in zip(self.contexts[:4], self.high, bits, strict=True)]

    def names(self, node: np.ndarray) -> np.ndarray:
        """64-bit names of the whole prefixes and the bits so far."""
        return _names(self.contexts[4], node)

    def bits(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(node, bit) of each byte, for its eight decisions in turn; node is the bits so far under a leading one."""
        for shift in range(7, -1, -1):
            yield ((1 << 7 - shift) | self.bytes.astype(np.uint64) >> np.uint64(shift + 1)).astype(np.uint64), (self.bytes >> shift & 1).astype(np.int64)


def _names(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        name = (context ^ node * _M1) * _M2
        return (name ^ name >> np.uint64(29)) * _M3


def table_bits(words: int) -> tuple[int, ...]:
    """log2 of the tables' slots for so many distinct words."""
    return tuple(min(most, max(least, (max(words, 1) - 1).bit_length() - 1)) for least, most in zip(LEAST_BITS, MOST_BITS, strict=True))


def new_tables(bits: tuple[int, ...]) -> list[np.ndarray]:
    return [np.zeros((1 << t, 2), np.float32) for t in bits]


def add_counts(tables: list[np.ndarray], bits: tuple[int, ...], batch: list[bytes], classes: np.ndarray, counts: np.ndarray) -> None:
    stream = Stream(batch, classes)
    n = counts.astype(np.float32)[stream.owner]
    for node, bit in stream.bits():
        for table, slots in zip(tables, stream.slots(node, bits), strict=True):
            np.add.at(table.reshape(-1), slots * 2 + bit, n)


class Prefixes:
    """Exact bit counts of the whole prefixes of ``SHARED`` bytes or more of a stretch of words; of those words' own bytes the rows of counts are known."""

    def __init__(self, batch: list[bytes], classes: np.ndarray, counts: np.ndarray):
        stream = Stream(batch, classes)
        at = np.flatnonzero(stream.place >= SHARED)
        part, n = stream.take(at), counts[stream.owner[at]]
        names, bits = [], []
        for node, bit in part.bits():
            names.append(part.names(node))
            bits.append(bit)
        every = np.concatenate(names) if names else np.zeros(0, np.uint64)
        distinct, back = np.unique(every, return_inverse=True)
        self.stream, self.times = stream, counts
        self.rows, self.column = back.astype(np.int32).reshape(8, len(at)), np.cumsum(stream.place >= SHARED) - 1
        size, bit, n = len(distinct), np.concatenate(bits), np.tile(n, 8)
        self.counts = np.zeros((size + 1, 2), np.float32)
        if size:
            self.counts[:size] = np.column_stack([np.bincount(back[bit == b], n[bit == b], size) for b in (0, 1)])
        self.distinct = distinct

    @cached_property
    def index(self) -> Sorted:
        # Names are in order already, so a name's place is its row of counts; the last row is of none.
        return Sorted(self.distinct)

    def words(self, part: np.ndarray) -> tuple[Stream, np.ndarray, np.ndarray]:
        """The stream of some of the words, in that order, with their times at each byte, and for the eight decisions the rows of the bytes that have one."""
        every = self.stream
        size = np.diff(np.append(every.starts, len(every.bytes)))[part]
        at = np.repeat(every.starts[part] - np.cumsum(size) + size, size) + np.arange(size.sum())
        stream = every.take(at)
        return stream, np.repeat(self.times[part], size), np.take(self.rows, self.column[at[stream.place >= SHARED]], axis=1)

    def find(self, names: np.ndarray) -> np.ndarray:
        found, at = self.index.find(names)
        return np.where(found[:, None], _pairs(self.counts, at), np.float32(0))


def _pairs(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``table[at]`` of pairs of float32, each fetched as one word of eight bytes."""
    return np.take(table.reshape(-1).view(np.uint64), at).view(np.float32).reshape(-1, 2)


def _levels(prefix: np.ndarray, four: np.ndarray) -> np.ndarray:
    """How much has been seen under the whole prefix (six steps) and under four bytes (four steps)."""
    whole = (prefix > 0).astype(np.uint8) + (prefix > 1) + (prefix > 3) + (prefix > 15) + (prefix > 255)
    return whole * np.uint8(4) + (four > 0) + (four > 3) + (four > 31)


def _odds(n: np.ndarray) -> np.ndarray:
    return np.log((n[..., 1] + DELTA) / (n[..., 0] + DELTA))


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -18, 18)))


def _map_place(node: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Place in the adaptive map: the bits so far and the bucket of the mixed log-odds."""
    return node.astype(np.int64) * BUCKETS + np.clip(np.rint(z * 2 + BUCKETS // 2), 0, BUCKETS - 1).astype(np.int64)


def start_weights() -> np.ndarray:
    w = np.full((GATES, 6), 0.2)
    w[:, -1] = 0
    return w


def chosen(weights: np.ndarray, loss: np.ndarray) -> np.ndarray:
    """The learned weights of the gates that coded better with them than with the start weights; those for all others."""
    return np.where((loss[:, 0] < loss[:, 1])[:, None], weights, start_weights())


class Learner:
    """Weights and map of one online way over batches of training words.

    Each event is predicted with one occurrence of itself taken out of the counts. A gate's weights move by its coding error
    times the inverse of the curvature it has gathered so far, this batch's included, so they settle within few batches and a
    batch of very frequent words cannot throw them. Curvature is the larger of p(1 - p) and the squared error, so it does not
    vanish where p saturates; its mean is taken from every fourth batch and stands for all. On the same batches the coding loss
    is kept for each gate beside that of the start weights: a gate that did not gain keeps those (``chosen``). The map starts
    after ``LEAST_BATCHES`` batches, or after a third of the way if that is sooner.
    """

    def __init__(self, tables: list[np.ndarray], bits: tuple[int, ...]):
        self.tables, self.bits, self.start = tables, bits, start_weights()[0]
        self.weights, self.map, self.seen = start_weights(), np.zeros((256, BUCKETS, 2)), 0.0
        size = self.weights.shape[1]
        self.first, self.curve, self.bent, self.total = np.eye(size) * 50.0, np.zeros((GATES, size, size)), np.zeros(GATES), np.zeros(GATES)
        self.loss = np.zeros((GATES, 2))

    def step(self, prefixes: Prefixes, part: np.ndarray, mapped: bool, curved: bool) -> None:
        w, size = self.weights, self.weights.shape[1]
        stream, weight, rows = prefixes.words(part)
        slope, bend = np.zeros_like(w), np.zeros_like(self.curve)
        every, place, long = np.arange(len(weight)) * 2, np.minimum(stream.place, 2), np.flatnonzero(stream.place >= SHARED)
        for (node, bit), row in zip(stream.bits(), rows, strict=True):
            x = np.ones((size, len(weight)))
            found = [_pairs(table, slots) for table, slots in zip(self.tables, stream.slots(node, self.bits), strict=True)]
            whole = found[3].copy()
            whole[long] = _pairs(prefixes.counts, row)
            own = every + bit
            for k, n in enumerate([*found, whole]):
                flat = n.reshape(-1)
                flat[own] = np.maximum(flat[own] - 1, 0)
                x[k] = _odds(n)
            gate = place * 24 + _levels(whole[:, 0] + whole[:, 1], found[3][:, 0] + found[3][:, 1])
            z = np.einsum("kj,jk->j", x, np.take(w, gate, axis=0))
            p = _squash(z)
            off = bit - p
            error = weight * off
            self.total += np.bincount(gate, weight, GATES)
            for k in range(size):
                slope[:, k] += np.bincount(gate, error * x[k], GATES)
            if curved:
                self.bent += np.bincount(gate, weight, GATES)
                heavy = weight * np.maximum(p * (1 - p), off * off)
                for k in range(size):
                    for m in range(k, size):
                        bend[:, k, m] += np.bincount(gate, heavy * x[k] * x[m], GATES)
                start = _squash(np.einsum("kj,k->j", x, self.start))
                for k, q in enumerate((p, start)):
                    self.loss[:, k] -= np.bincount(gate, weight * np.log(np.where(bit == 1, q, 1 - q)), GATES)
            if mapped:
                self.map += np.bincount(_map_place(node, z) * 2 + bit, weight, self.map.size).reshape(self.map.shape)
        self.curve += bend + np.transpose(np.triu(bend, 1), (0, 2, 1))
        curve = self.first + self.curve * (self.total / np.maximum(self.bent, 1))[:, None, None]
        # A gate that has no curvature yet stays where it is.
        self.weights = np.where((self.bent > 0)[:, None], np.clip(w + np.linalg.solve(curve, slope[:, :, None])[:, :, 0], -2.0, 3.0), w)
        self.seen += float(prefixes.times[part].sum())

    def run(self, stretches: Iterator[tuple[list[bytes], np.ndarray]]) -> None:
        """Once over all stretches, (words, counts by class). A first stretch of few batches is gone over until it has had ``LEAST_BATCHES``."""
        steps = 0
        for words_, counts in stretches:
            batch, classes, n = trained(words_, counts)
            if not batch:
                continue
            prefixes, order = Prefixes(batch, classes, n), np.random.default_rng(7).permutation(len(batch))
            parts = [order[at : at + BATCH] for at in range(0, len(order), BATCH)]
            while True:
                for part in parts:
                    self.step(prefixes, part, 3 * steps > min(LEAST_BATCHES, len(parts)), steps % 4 == 0)
                    steps += 1
                if steps >= LEAST_BATCHES:
                    break


def trained(words_: list[bytes], counts: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(word, class, count) of the training words of a stretch."""
    rows, classes = np.nonzero(counts)
    return [words_[i] for i in rows], classes, counts[rows, classes]


@dataclass
class Model:
    """What scoring needs besides the prefixes: log-odds of each slot, levels of four bytes, weights and the map's probabilities."""

    bits: tuple[int, ...]
    odds: list[np.ndarray]
    four: np.ndarray
    whole: np.ndarray
    weights: np.ndarray
    map: np.ndarray
    trust: np.ndarray

    @classmethod
    def of(cls, tables: list[np.ndarray], bits: tuple[int, ...], weights: np.ndarray, map_: np.ndarray) -> Model:
        n, seen = map_.reshape(-1, 2).sum(axis=1), tables[3].sum(axis=1)
        none = np.zeros(1, np.float32)
        odds = [_odds(t).astype(np.float32) for t in tables]
        return cls(bits, odds, _levels(none, seen), _levels(seen, none), weights.astype(np.float32), (map_.reshape(-1, 2)[:, 1] / np.maximum(n, 1)).astype(np.float32), (n / (n + 64) / 2).astype(np.float32))

    def log10_bytes(self, stream: Stream, chosen: np.ndarray, prefixes: Prefixes) -> np.ndarray:
        """log10 probability of the chosen bytes of a stream."""
        part = stream.take(chosen)
        total = np.ones(len(chosen))
        place, long = np.minimum(part.place, 2) * 24, np.flatnonzero(part.place >= SHARED)
        # A prefix that was not seen with the bits so far is not seen with more of them: it has no counts and is looked up no more.
        alive, context = long, part.contexts[4][long]
        for node, bit in part.bits():
            slots = part.slots(node, self.bits)
            four = np.take(self.odds[3], slots[3])
            odds, level = four.copy(), np.take(self.whole, slots[3])
            odds[long] = level[long] = 0
            seen, at = prefixes.index.find(_names(context, node[alive]))
            alive, context, own = alive[seen], context[seen], _pairs(prefixes.counts, at[seen])
            odds[alive], level[alive] = _odds(own), _levels(own[:, 0] + own[:, 1], np.zeros(1, np.float32))
            gate = place + level + np.take(self.four, slots[3])
            w = np.take(self.weights, gate, axis=0)
            z = w[:, -1] + w[:, 4] * odds
            for k in range(3):
                z += w[:, k] * np.take(self.odds[k], slots[k])
            z += w[:, 3] * four
            p = _squash(z)
            at = _map_place(node, z)
            p += np.take(self.trust, at) * (np.take(self.map, at) - p)
            total *= np.clip(np.where(bit == 1, p, 1 - p), 1e-9, 1)
        return np.log10(total)


def log10_words(model: Model, batch: list[bytes], classes: list[int], prefixes: Prefixes) -> list[np.ndarray]:
    """log10 probability of each word, its blank included, under each class; the empty word is the end.

    Words that share a prefix share its bytes' figures: each distinct prefix is worked out once for each class.
    """
    if not batch:
        return [np.zeros(0) for _ in classes]
    out, first, back = [], None, None
    for of in classes:
        stream = Stream(batch, np.full(len(batch), of))
        if first is None:
            with np.errstate(over="ignore"):
                name = (stream.contexts[4] + stream.bytes.astype(np.uint64)) * _M3
            _, first, back = np.unique(name, return_index=True, return_inverse=True)
        out.append(np.add.reduceat(model.log10_bytes(stream, first, prefixes)[back], stream.starts))
    return out


def word_counts(docs: DataFrame, text: str, of: str) -> DataFrame:
    """(word binary, of, n): counts of all words by class, the empty word standing for ends; summed within each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter[bytes]] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for k, counter in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([*counter.keys()], pa.binary()), pa.array([k] * len(counter), pa.int32()), pa.array([*counter.values()], pa.int64())], names=["word", "of", "n"])
            seen.clear()

        for batch in batches:
            for value, k in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counter = seen[k]
                counter.update(words(value.as_py()))
                counter[b""] += 1
                if sum(map(len, seen.values())) > HELD:
                    yield from flush()
        yield from flush()

    rows = map_rows(docs.select(F.col(text).cast("binary").alias("text"), F.col(of).alias("of")), run, "word binary, of int, n long")
    return rows.groupBy("word", "of").agg(F.sum("n").alias("n"))


def word_table(rows: DataFrame, classes: int) -> DataFrame:
    """(word, n0, n1, ...): each distinct word with its training count in each class; class -1 (not for training) counts nothing."""
    return rows.groupBy("word").agg(*(F.coalesce(F.sum(F.when(F.col("of") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(classes)))


def _in_stretches(rows: Iterator[pa.RecordBatch], size: int = STRETCH) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(words, counts by class) of sorted rows, cut where the first ``SHARED`` bytes change."""
    words_: list[bytes] = []
    held: list[np.ndarray] = []
    for batch in rows:
        if not batch.num_rows:
            continue
        words_ += batch.column(0).to_pylist()
        held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[1:]]))
        if len(words_) >= size:
            cut = len(words_)
            while cut and words_[cut - 1][:SHARED] == words_[-1][:SHARED]:
                cut -= 1
            if cut:
                counts = np.concatenate(held)
                yield words_[:cut], counts[:cut]
                words_, held = words_[cut:], [counts[cut:]]
    if words_:
        yield words_, np.concatenate(held)


def _dealt(table: DataFrame, tasks: int) -> DataFrame:
    """Words dealt out by their first bytes and sorted."""
    return table.repartition(tasks, F.substring("word", 1, SHARED)).sortWithinPartitions("word")


def low_tables(table: DataFrame, bits: tuple[int, ...], tasks: int) -> list[np.ndarray]:
    """The dense tables: each task fills its own, segments are summed by shuffle. What reaches the driver has a bounded size."""

    def build(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = new_tables(bits)
        for words_, counts in _in_stretches(rows):
            batch, classes, n = trained(words_, counts)
            if batch:
                add_counts(tables, bits, batch, classes, n)
        for k, part in enumerate(tables):
            for at in range(0, len(part), SEGMENT):
                if (segment := part[at : at + SEGMENT]).any():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([at]), pa.array([zlib.compress(segment.tobytes(), 1)], pa.binary())], names=["k", "at", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = reduce(np.add, (np.frombuffer(zlib.decompress(c.as_py()), np.float32) for c in group["counts"]))
        return pa.table({"k": group["k"][:1], "at": group["at"][:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    out = new_tables(bits)
    parts = map_rows(table.repartition(tasks), build, "k long, at long, counts binary")
    for row in parts.groupBy("k", "at").applyInArrow(add, "k long, at long, counts binary").collect():
        part = np.frombuffer(zlib.decompress(row.counts), np.float32).reshape(-1, 2)
        out[row.k][row.at : row.at + len(part)] = part
    return out


def fit(table: DataFrame, bits: tuple[int, ...], tasks: int) -> Model:
    """The model of a word table, its whole prefixes aside."""
    tables = low_tables(table, bits, -(-tasks * TASK_WORDS // TABLE_WORDS))
    shared = table.sparkSession.sparkContext.broadcast(tables)

    def train(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(shared.value, bits)
        learner.run(_in_stretches(rows))
        if learner.seen:
            flat = np.concatenate([[learner.seen], (learner.weights * learner.seen).reshape(-1), learner.loss.reshape(-1), learner.map.reshape(-1)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "value"])

    sums = map_rows(_dealt(table, tasks), train, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").toArrow()["value"].to_numpy()
    shared.destroy()
    start = start_weights()
    if not len(sums):
        return Model.of(tables, bits, start, np.zeros((256, BUCKETS, 2)))
    weights, loss, map_ = np.split(sums[1:], [start.size, start.size + 2 * GATES])
    return Model.of(tables, bits, chosen((weights / sums[0]).reshape(start.shape), loss.reshape(GATES, 2)), map_.reshape(256, BUCKETS, 2))


def word_figures(table: DataFrame, model: Model, live: list[int], tasks: int) -> DataFrame:
    """(word, n, l0, l1, ...): the training count of every distinct word and its log10 probability under each live class."""
    sent = table.sparkSession.sparkContext.broadcast(model)
    names = [f"l{k}" for k in range(len(live))]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words_, counts in _in_stretches(rows):
            prefixes = Prefixes(*trained(words_, counts))
            logs = log10_words(sent.value, words_, live, prefixes)
            yield pa.RecordBatch.from_arrays([pa.array(words_, pa.binary()), pa.array(counts.sum(axis=1).astype(np.int64)), *map(pa.array, logs)], names=["word", "n", *names])

    return materialize(map_rows(_dealt(table, tasks), run, "word binary, n long, " + ", ".join(f"{c} double" for c in names)), "figures")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", group: str | None = "lang", folds: int = 5, held_out: int = 1) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every whole text.

    The model and the base learn from the rows whose crc32(key) modulo ``folds`` is not ``held_out``. Null texts are empty
    and have their end alone; null keys count as empty text for the remainder; null groups are a class. Repeated rows give
    repeated rows. Without training rows all counts are zero and the model is uninformed.

    The commonest words' figures are broadcast, a fixed number; every other word is looked up by a join of (row, word, times)
    with the table of figures. None of those words is common, so no key of that join is hot.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    named = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), named.alias("named"))
    learned = source.where(remainder("key", folds) != held_out)
    names = [r.named for r in learned.groupBy("named").count().orderBy(F.desc("count"), "named").limit(CLASSES - 1).collect()]
    of = F.lit(len(names))
    for k, name in enumerate(names):
        of = F.when(F.col("named") == name, k).otherwise(of)
    classes = len(names) + 1
    # Words of texts that are not for training are scored too, but counted for no class.
    counted = word_counts(source.withColumn("of", F.when(remainder("key", folds) != held_out, of).otherwise(-1).cast("int")), "text", "of")
    table = materialize(word_table(counted, classes), "words")
    seen = F.expr(" + ".join(f"n{k}" for k in range(classes)))
    sums = table.agg(F.coalesce(F.sum(seen), F.lit(0)).alias("n"), F.count_if(seen > 0).alias("v"), F.count("*").alias("words")).first()
    ends = table.where(F.length("word") == 0).first()
    share = np.array([ends[f"n{k}"] for k in range(classes)], np.float64) if ends else np.zeros(classes)
    n_ends = int(share.sum())
    live = np.flatnonzero(share).tolist() if n_ends else [0]
    weight = np.log10(share[live] / n_ends) if n_ends else np.zeros(1)
    tasks = -(-max(sums.words, 1) // TASK_WORDS)
    bits = table_bits(sums.v)
    figures = word_figures(table, fit(table, bits, tasks), live, tasks)
    discard(table)
    logs = [f"l{k}" for k in range(len(live))]
    common = figures.orderBy(F.desc("n"), "word").limit(COMMON).toArrow()
    listed = common["word"].to_pylist()
    sent = spark.sparkContext.broadcast((listed, np.column_stack([common["n"].to_numpy() > 0, np.log10(common["n"].to_numpy() + 0.5), *(common[c].to_numpy() for c in logs)])))
    least = int(common["n"].to_numpy().min()) if len(listed) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, table = sent.value
        at = {w: i for i, w in enumerate(held)}
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo in range(0, batch.num_rows, 2500):
                part, out = batch.slice(lo, 2500), []
                for value in part.column(1):
                    tokens = words(value.as_py())
                    tokens.append(b"")
                    i = np.fromiter(map(at.get, tokens, repeat(-1)), np.int64, len(tokens))
                    others = Counter(tokens[j] for j in np.flatnonzero(i < 0).tolist())
                    out.append((row, len(tokens), sum(map(len, tokens)) + len(tokens), *table[i[i >= 0]].sum(axis=0).tolist(), [*others], [*others.values()]))
                    row += 1
                kinds = (*[pa.int64()] * 3, *[pa.float64()] * (2 + len(logs)), pa.list_(pa.binary()), pa.list_(pa.int64()))
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["key", "row", "tokens", "size", "known", "base", *logs, "words", "times"])

    schema = f"key {kind}, row long, tokens long, size long, known double, base double, {', '.join(f'{c} double' for c in logs)}, words array<binary>, times array<long>"
    drafts = materialize(map_rows(source.select("key", F.col("text").cast("binary").alias("text")), run, schema), "drafts")
    rare = drafts.select("row", F.explode(F.arrays_zip("words", "times")).alias("z")).select("row", F.col("z.words").alias("word"), F.col("z.times").alias("times"))
    # Words up to the broadcast ones' least count hold all that were not broadcast.
    values = {"known": F.when(F.col("n") > 0, 1).otherwise(0), "base": F.log10(F.col("n") + 0.5)} | {c: F.col(c) for c in logs}
    found = rare.join(figures.where(F.col("n") <= least), "word").groupBy("row").agg(*(F.sum(F.col("times") * v).alias(f"o_{c}") for c, v in values.items()))
    whole = drafts.drop("words", "times").join(found, "row", "left").withColumns({c: F.col(c) + F.coalesce(f"o_{c}", F.lit(0.0)) for c in values})
    # Log10 of the sum over classes.
    parts = F.array(*(F.col(c) + float(w) for c, w in zip(logs, weight, strict=True)))
    top = F.array_max(parts)
    mixed = top + F.log10(F.aggregate(F.transform(parts, lambda x: F.pow(F.lit(10.0), x - top)), F.lit(0.0), lambda a, x: a + x))
    size = float(np.log10(max(sums.n + 0.5 * (sums.v + 1), 0.5)))
    return whole.select(
        F.col("key").alias(key),
        (remainder("key", folds) == held_out).alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        F.col("known").cast("long").alias("n_known"),
        F.lit(int(sums.n)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("tokens") * size).alias("base_score"),
        mixed.alias("score"),
        (-mixed * log2(10) / F.col("size")).alias("bits_per_byte"),
    )
