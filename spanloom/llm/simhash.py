"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last one padded with zeros). The binary Golay code
(23, 12, 7) is perfect: each 23-bit word lies within three bits of just one of 4,096 codewords. Decoding a word and its
23 neighbours gives one codeword index, or six if the word is three bits off; two words at most two bits apart have a
neighbour in common and so share an index. These indices are the fuzzy keys of a segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from math import ceil
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import discard, map_rows, materialize, words
from spanloom.llm.graph import components

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
SEGMENTS = ((0, 23), (23, 23), (46, 18))


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low and the high bits, and the error pattern of each syndrome."""
    low, high = np.arange(1 << 11, dtype=np.uint32), np.arange(1 << 12, dtype=np.uint32) << np.uint32(11)
    for bit in range(22, 10, -1):
        high = np.where(high >> np.uint32(bit) & np.uint32(1), high ^ np.uint32(GENERATOR << (bit - 11)), high)
    one = [int(low[1 << i]) if i < 11 else int(high[1 << (i - 11)]) for i in range(23)]
    errors = np.zeros(1 << 11, dtype=np.uint32)
    for a in range(23):
        errors[one[a]] = 1 << a
        for b in range(a):
            errors[one[a] ^ one[b]] = 1 << a | 1 << b
            for c in range(b):
                errors[one[a] ^ one[b] ^ one[c]] = 1 << a | 1 << b | 1 << c
    return low, high, errors


def golay_index(word: np.ndarray) -> np.ndarray:
    """Index of the codeword nearest to each 23-bit word."""
    low, high, errors = _golay()
    syndrome = low[word & np.uint32(0x7FF)] ^ high[word >> np.uint32(11)]
    return (word ^ errors[syndrome]) >> np.uint32(11)


def golay_keys(word: np.ndarray) -> np.ndarray:
    """(n, 6) sorted codeword indices of each word and its neighbours; spare places are -1."""
    around = np.concatenate([word[:, None], word[:, None] ^ (np.uint32(1) << np.arange(23, dtype=np.uint32))], axis=1)
    found = np.sort(golay_index(around).astype(np.int64), axis=1)
    new = np.ones(found.shape, dtype=bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    out = np.full((len(word), 6), -1, dtype=np.int64)
    rank = np.cumsum(new, axis=1) - 1
    rows, cols = np.nonzero(new)
    out[rows, rank[rows, cols]] = found[rows, cols]
    return out


def simhash(hashes: np.ndarray) -> int:
    """Bits set in over half of the 64-bit hashes; zero for none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(tokens: list[bytes], width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``width`` words joined by one space, repeats included; of the whole sequence if it is shorter."""
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    if width == 1:
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in tokens), np.uint64, len(tokens))
    joined = b" ".join(tokens)
    if len(tokens) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(tokens) - width] + 1])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprints(docs: DataFrame, key: str, text: str, width: int = 3, distinct: bool = False) -> DataFrame:
    """(key, fp long): the SimHash of each whole text over shingles of ``width`` words (each once if ``distinct``).

    Null and blank texts get 0. Rows pass one by one; a batch is bounded by Arrow's batch limits.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=np.uint64)
            for i, value in enumerate(batch.column(1)):
                hashes = shingle_hashes(words(value.as_py()), width)
                out[i] = simhash(np.unique(hashes) if distinct else hashes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["key", "fp"])

    return map_rows(docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")), run, f"key {kind}, fp long").withColumnRenamed("key", key)


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    return [((fp >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.uint32) for at, size in SEGMENTS]


def exact_and_fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs such that fingerprints within two bits share a key.

    By the pigeonhole one of three segments has no error, and any other has two at most: a key is an exact segment with a
    Golay index of another one.
    """
    parts, rows, keys = _segments(fp), [], []
    fuzzy = [golay_keys(parts[0]), golay_keys(parts[1])]
    for exact, other in ((0, 1), (1, 0), (2, 0)):
        r, c = np.nonzero(fuzzy[other] >= 0)
        rows.append(r)
        keys.append(np.int64(exact) << np.int64(40) | parts[exact][r].astype(np.int64) << np.int64(12) | fuzzy[other][r, c])
    return np.concatenate(rows), np.concatenate(keys)


def fuzzy_pair_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs such that fingerprints share a key if two of the three segments have two errors at most (always so up to five bits in all)."""
    parts, rows, keys = _segments(fp), [], []
    fuzzy = [golay_keys(p) for p in parts]
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        both = fuzzy[i][:, :, None] << np.int64(12) | np.where(fuzzy[j] < 0, 0, fuzzy[j])[:, None, :]
        r, a, b = np.nonzero((fuzzy[i] >= 0)[:, :, None] & (fuzzy[j] >= 0)[:, None, :])
        rows.append(r)
        keys.append(np.int64(k) << np.int64(40) | both[r, a, b])
    return np.concatenate(rows), np.concatenate(keys)


def keyed(prints: DataFrame, maker) -> DataFrame:
    """(fp) to (key, fp) rows by one of the key functions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                rows, keys = maker(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows].view(np.int64))], names=["key", "fp"])

    return map_rows(prints.select("fp"), run, "key long, fp long")


def close_links(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints at two bits or fewer, and no others.

    Fingerprints meet in Golay keys. A key of two is verified as it stands. In keys of more, each member names the 65 words
    within one bit of it: members that name the same word are within two bits by the triangle inequality, and any two
    within two bits name a common word. Each names its word's smallest member, so links stay linear however many copies meet.
    """
    keys = materialize(keyed(prints, exact_and_fuzzy_keys), "golay")
    met = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    pairs = met.where("n = 2 AND bit_count(a ^ b) <= 2").select("a", "b")
    crowd = keys.join(met.where("n > 2").select("key"), "key", "left_semi").select("fp").distinct()
    near = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    named = materialize(crowd.select("fp", F.explode(near).alias("word")), "words")
    least = named.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("word", "a")
    return pairs.union(named.join(least, "word").where("fp <> a").select("a", F.col("fp").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fingerprint, component_id): documents linked by fingerprints at two or fewer differing bits.

    component_id is the smallest key reachable, itself included. Exact copies meet in their fingerprint before any link is
    sought, so a group of copies costs one fingerprint. Null or blank texts have fingerprint zero and link like any other.
    Null keys are kept; a component of null keys only has a null id. Repeated rows give repeated rows.
    """
    prints = materialize(fingerprints(docs, key, text, width), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    label = components(close_links(distinct)).withColumnRenamed("v", "fp")
    named = distinct.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    root = named.groupBy("label").agg(F.min("least").alias("component_id"))
    known = named.join(root, "label").select("fp", "component_id")
    return prints.join(known, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Bits within which the Golay rounds compare fingerprints of distinct words and of word pairs (they only save work: what lies beyond meets by shingles), least shingle similarity of a link.
RADIUS, PAIR_RADIUS, SIMILARITY = 9, 13, 0.8
#: Rows of a bucket up to which members without a close mate are taken out before anything is joined.
BUCKET = 4096
#: Rows of (hash, key) that may be broadcast (about 80 MB); longer lists are joined by shuffle.
MAX_BROADCAST = 2_000_000


def small(df: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """Marked for broadcast if it has no more than ``most`` rows (it should be a written table)."""
    return F.broadcast(df) if df.count() <= most else df


#: Longs of a text's parities. They tell sets apart up to about as many shingles as they have bits; beyond that only sizes and places do.
PARITIES = 16


def parities(hashes: np.ndarray) -> np.ndarray:
    """Of each of 64 * ``PARITIES`` classes of distinct hashes, by their leading bits: whether it has an odd number of them.

    A hash that only one of two sets has changes one parity, so no more parities differ than hashes do.
    """
    size = 64 * PARITIES
    odd = np.bincount((hashes >> np.uint64(64 - (size - 1).bit_length())).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _node(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def text_sets(docs: DataFrame, text: str, width: int) -> DataFrame:
    """(node, fp, pairs, odd, hashes): of each distinct text its hash, fingerprints over distinct words and over word pairs, and its
    distinct shingle hashes in order, with their parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                one, two, odd, sets = [], [], [], []
                for value in batch.column(1).slice(at, 256):
                    tokens = words(value.as_py())
                    one.append(simhash(np.unique(shingle_hashes(tokens, 1))))
                    two.append(simhash(shingle_hashes(tokens, 2)))
                    hashes = _filled(np.unique(shingle_hashes(tokens, width)))
                    odd.append(parities(hashes))
                    sets.append(hashes.view(np.int64))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                prints = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)]
                lists = [pa.ListArray.from_arrays(pa.array(e), pa.array(np.concatenate(x))) for e, x in ((np.arange(len(odd) + 1, dtype=np.int32) * PARITIES, odd), (ends, sets))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), *prints, *lists], names=["node", "fp", "pairs", "odd", "hashes"])

    rows = map_rows(docs.select(_node(text).alias("node"), F.col(text).cast("binary").alias("text")), run, "node long, fp long, pairs long, odd array<long>, hashes array<long>")
    # Equal texts have equal sets: one of each is enough.
    return rows.groupBy("node").agg(*(F.any_value(c).alias(c) for c in ("fp", "pairs", "odd", "hashes")))


def keyed_nodes(nodes: DataFrame) -> DataFrame:
    """(node, fp, pairs) to (key, node, fp, pairs) rows, a key for each pair of segments' Golay indices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            for at in range(0, batch.num_rows, 2048):
                part = [c[at : at + 2048] for c in columns]
                rows, keys = fuzzy_pair_keys(part[1].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(c[rows]) for c in part)], names=["key", "node", "fp", "pairs"])

    return map_rows(nodes.select("node", "fp", "pairs"), run, "key long, node long, fp long, pairs long")


def _companions(key: np.ndarray, fp: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Of rows sorted by key: which have another of their key within both radii."""
    found, step = np.zeros(len(key), dtype=bool), 1
    fp, pairs = fp.view(np.uint64), pairs.view(np.uint64)  # of signed numbers numpy counts the bits of the absolute value
    while len(at := np.flatnonzero(key[step:] == key[:-step])) if step < len(key) else False:
        near = at[(np.bitwise_count(fp[at] ^ fp[at + step]) <= RADIUS) & (np.bitwise_count(pairs[at] ^ pairs[at + step]) <= PAIR_RADIUS)]
        found[near] = found[near + step] = True
        step += 1
    return found


def with_companions(keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` that a bucket-mate is close to; buckets that only chance has filled go. Buckets of over ``BUCKET`` rows pass whole.

    Keys are dealt out and sorted once; buckets pass one by one, so memory is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None
        schema = None

        def emit(columns: list[np.ndarray], passing: int | None) -> pa.RecordBatch:
            keep = _companions(columns[0], columns[2], columns[3])
            if passing is not None:
                keep |= columns[0] == passing
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=schema)

        for batch in batches:
            schema = batch.schema.names
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(columns[0]):
                continue
            if held is not None:
                columns = [np.concatenate([a, b]) for a, b in zip(held, columns, strict=True)]
            # The last key may go on in the next batch.
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            tail = len(columns[0]) - cut
            if cut:
                yield emit([c[:cut] for c in columns], large)
                large = None
            held = [c[cut:] for c in columns]
            if tail > BUCKET:
                large = int(columns[0][-1])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=schema)
                held = [c[:0] for c in held]
        if held is not None and len(held[0]):
            yield emit(held, large)

    return map_rows(keys.repartition("key").sortWithinPartitions("key"), run, "key long, node long, fp long, pairs long")


#: How many of a text's earlier shingles a row of the last join carries, so a text of any length takes room in proportion. Where
#: two texts have none in common among so many, a pair is made once more; repeated pairs are dropped before they are compared.
EARLIER = 64


def _least(size: int, similarity: float) -> int:
    """Shingles that a set of ``size`` has at least in common with any set of that similarity."""
    return max(1, ceil(similarity * size - 1e-9))


def prefix_keys(docs: DataFrame, text: str, width: int, similarity: float) -> DataFrame:
    """(key, node, need): the first shingle hashes in ascending order of each text, and how many of them a text with a near copy shares.

    Two sets of ``similarity`` have ``_least`` shingles in common, so the k-th common one is among the first size - least + k
    of each. An eighth of the set more than the least prefix is listed, and an eighth of the least is needed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, 256):
                part, keys, needs = nodes[at : at + 256], [], []
                for value in batch.column(1).slice(at, 256):
                    hashes = _filled(np.unique(shingle_hashes(words(value.as_py()), width)))
                    least = _least(len(hashes), similarity)
                    keys.append(hashes[: len(hashes) - least + max(1, len(hashes) // 8)])
                    needs.append(max(1, least // 8))
                sizes = [len(k) for k in keys]
                flat = np.concatenate(keys).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(part, sizes)), pa.array(np.repeat(np.array(needs, np.int32), sizes))], names=["key", "node", "need"])

    return map_rows(docs.select(_node(text).alias("node"), F.col(text).cast("binary").alias("text")), run, "key long, node long, need int")


def _filled(hashes: np.ndarray) -> np.ndarray:
    """Texts without words are copies of each other: their sets hold one zero."""
    return hashes if len(hashes) else np.zeros(1, dtype=np.uint64)


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs of text hashes whose shingle sets' Jaccard similarity is ``similarity`` or more, exactly."""
    a, b = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    sizes = F.least(F.size("x"), F.size("y")) >= similarity * F.greatest(F.size("x"), F.size("y"))
    return pairs.join(a, "a").join(b, "b").where(sizes & (common >= similarity * union)).select(*pairs.columns)


def similar_groups(docs: DataFrame, text: str = "text", width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """(node, label): each distinct text's hash and its group's, groups being joined by all links of ``similarity`` over ``width``-word shingles.

    A text that shares too few of its first shingles with any other has no link and is left out at once. The others meet
    three times. Golay keys of fingerprints come first and join most copies cheaply: a bucket's members meet one leader, and
    what links joins a component. Then texts meet in every shingle of their prefix, rarest first: two sets of that similarity
    have one there in common, so no link is missed. Of a shingle's texts each meets one leader, and at last those outside its
    largest component meet all others of another component, if sizes, places in the prefix and parities leave room for the
    similarity: of edited copies of one text nearly all pairs below it go by their parities, before they are rows.
    So every pair is compared or already joined, while a group of copies of any size costs a bucket one row a member.
    """
    every = Window.partitionBy("key")
    shared = prefix_keys(docs, text, width, similarity).withColumn("shared", F.min("node").over(every) < F.max("node").over(every)).where("shared")
    near = materialize(shared.groupBy("node").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need").select("node"), "near")
    texts = docs.select(_node(text).alias("node"), F.col(text).alias("text")).join(small(near), "node", "left_semi").select("text")
    sets = materialize(text_sets(texts, "text", width), "sets")
    label = sets.select("node", F.col("node").alias("label"))

    def close(a: str, b: str):
        bits = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
        return (bits(f"{a}fp", f"{b}fp") <= RADIUS) & (bits(f"{a}pairs", f"{b}pairs") <= PAIR_RADIUS)

    def room(a: str, b: str):
        # At the first common shingle no more than what is left of either set can be in common.
        x, y = F.col(f"{a}size"), F.col(f"{b}size")
        most = 1 + F.least(x - F.col(f"{a}place"), y - F.col(f"{b}place"))
        return (F.least(x, y) >= similarity * F.greatest(x, y)) & ((1 + similarity) * most >= similarity * (x + y) - 1e-6)

    def alike(a: str, b: str):
        # Sets of the similarity differ in no more hashes than this, and parities in no more than hashes.
        differ = reduce(add, (F.bit_count(F.col(f"{a}odd")[i].bitwiseXOR(F.col(f"{b}odd")[i])) for i in range(PARITIES)))
        return (1 + similarity) * differ <= (1 - similarity) * (F.col(f"{a}size") + F.col(f"{b}size")) + 1e-6

    def verify(pairs: DataFrame, label: DataFrame) -> DataFrame:
        """The labels once the links among ``pairs`` (a, b, label_a, label_b) have joined their components."""
        pairs = materialize(pairs.distinct(), "pairs")
        links = materialize(_similar(pairs, sets, similarity), "links")
        joined = components(links.select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))).select(F.col("v").alias("label"), F.col("label").alias("root"))
        after = materialize(label.join(joined, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        discard(pairs, links)
        return after

    def with_leaders(now: DataFrame, fits, *held: str) -> DataFrame:
        leader = now.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", *held, "label")).alias("l"))
        pairs = now.join(leader, "key").where((F.col("label") != F.col("l.label")) & fits("", "l."))
        return pairs.select(F.col("node").alias("a"), F.col("l.node").alias("b"), F.col("label").alias("label_a"), F.col("l.label").alias("label_b"))

    crowd = materialize(with_companions(keyed_nodes(sets)), "crowd")
    label = verify(with_leaders(crowd.withColumn("label", F.col("node")), close, "fp", "pairs"), label)
    listed = sets.select("node", F.size("hashes").alias("size"), F.explode("hashes").alias("key")).withColumn("n", F.count("*").over(every))
    placed = listed.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("n", "key")))
    prefix = F.col("size") - F.greatest(F.ceil(similarity * F.col("size") - 1e-9), F.lit(1)) + 1
    met = materialize(placed.where((F.col("place") <= prefix) & (F.col("n") > 1)).select("key", "node", "size", "place"), "met")
    label = verify(with_leaders(met.join(label, "node"), room, "size", "place"), label)
    now = met.join(label, "node")
    sizes = now.groupBy("key", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").select("key", F.col("top.label").alias("top"))
    # A pair is made in the first shingle that both have; later ones see that in the few that came before them, or make it again.
    earlier = F.collect_list("key").over(Window.partitionBy("node").orderBy("place").rowsBetween(-EARLIER, -1))
    open_ = materialize(now.join(largest, "key").withColumn("earlier", earlier).join(sets.select("node", "odd"), "node"), "open")
    rest = open_.where("label <> top").select("key", *(F.col(c).alias(f"o_{c}") for c in ("node", "size", "place", "label", "earlier", "odd")))
    once = ((F.col("label") == F.col("top")) | (F.col("node") < F.col("o_node"))) & ~F.arrays_overlap("earlier", "o_earlier")
    left = open_.join(rest, "key").where((F.col("label") != F.col("o_label")) & room("", "o_") & alike("", "o_") & once)
    label = verify(left.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b"), *(F.when((F.col("node") < F.col("o_node")) == first, F.col("label")).otherwise(F.col("o_label")).alias(c) for first, c in ((True, "label_a"), (False, "label_b")))), label)
    whole = materialize(docs.select(_node(text).alias("node")).distinct().join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "groups")
    discard(near, sets, crowd, met, open_)
    return whole


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: of each group the row with the smallest key stays (null keys last).

    Null texts count as empty; texts without words are copies of each other. Of repeated rows one stays.
    """
    label = similar_groups(docs, text, width, similarity)
    order = F.struct(F.col("key").isNull().alias("null"), "key", "node")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("key"), _node(text).alias("node"))
    kept = rows.select("key", "node").join(label, "node").groupBy("label").agg(F.min(order).alias("k")).select("k.*")
    kept = materialize(kept.select(F.col("node").alias("kept_node"), F.col("key").alias("kept_key")), "kept")
    alone = rows.join(small(kept), (F.col("node") == F.col("kept_node")) & F.col("key").eqNullSafe(F.col("kept_key")), "left_semi")
    repeated = rows.groupBy("key", "node").count().where("count > 1").limit(1).count()
    return (alone.dropDuplicates(["key", "node"]) if repeated else alone).select("row.*")
