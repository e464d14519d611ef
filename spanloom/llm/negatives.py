"""Hard negatives by a norm-bucketed search.

Vectors are quantised to integers (each component x becomes floor(256 x)), so every score is an exact inner product. Candidates
are sorted by falling norm and cut in buckets of ``BUCKET`` rows, each a row of its own: keys, labels and a matrix. Buckets are
numbered within ``CLASSES`` ranges of their largest norms. Anchors travel in blocks of ``BLOCK`` with what they still look for: a
lower limit of scores, and the kth score that they have already found. By Cauchy-Schwarz no row of a bucket scores more than
its largest norm times the anchor's, so

* a block is sent only to the ranges where that product reaches the least of its anchors' limits,
* within a block, an anchor is dropped from a bucket under the same rule,
* after each wave of ranges (the largest norms first: a sixteenth of the buckets, a quarter, the rest) the limits rise to the kth
  scores found so far.

This is done twice: for an anchor's best rows of its own label, then for its windows, in which a row of another label must lie.
A block meets a bucket in a join on the bucket's number, so each bucket is a small matrix product in some task, memory is that
of one block and one bucket, and nothing depends on how many rows share a norm, a label or a vector. What leaves a task are an
anchor's few best rows of one bucket.

Scores are worked out in 32-bit floats where norms show them to be exact (products of norms under 2^24), in 64-bit ones under
2^53, else in whole numbers of any size up to ``MOST``; in the result a score beyond 64 bits is given as the nearest such number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import discard, map_rows, materialize

#: Rows of a bucket, anchors of a block, ranges of norms; shares of the buckets that the waves reach.
BUCKET, BLOCK, CLASSES = 4096, 256, 256
WAVES = (1 / 16, 1 / 4, 1.0)
#: A bound is taken so much higher, for its own rounding.
SLACK = 1 + 1e-9
SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: Most tasks of a wave; scores beyond MOST count as MOST; a limit that all, or none, can meet.
TASKS, MOST, ENDLESS = 20_000, 10**30, 10**31
_WHOLE = "decimal(38,0)"


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label") -> DataFrame:
    """(key, label, v array<double>, norm) of the rows that take part: key, label and vector there, every component there and
    finite. Rows equal in key, label and quantised vector count once."""
    of = F.col(label) if isinstance(label, str) else label
    raw = F.transform(F.col(vector), lambda x: x.cast("double") * SCALE)
    there = rows.select(F.col(key).cast("long").alias("key"), of.cast("long").alias("label"), raw.alias("raw")).where("key IS NOT NULL AND label IS NOT NULL AND raw IS NOT NULL")
    fine = there.where(~F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    # A double of 2^53 or more is whole.
    whole = F.transform("raw", lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    return fine.select("key", "label", whole.alias("v")).dropDuplicates().withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Rows that arrive in order, cut in pieces of so many."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size - n)
            held.append(part)
            n, at = n + part.num_rows, at + part.num_rows
            if n == size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


_PACKED = [("keys", pa.binary()), ("labels", pa.binary()), ("norms", pa.binary()), ("matrix", pa.binary()), ("narrow", pa.bool_()), ("width", pa.int32()), ("top", pa.float64())]
_PACKED_SQL = "keys binary, labels binary, norms binary, matrix binary, narrow boolean, width int, top double"


def _floats(values: list) -> np.ndarray:
    return np.array([float(x) for x in values])


def _one(row: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row], schema=schema)


def _pack(piece: pa.Table) -> tuple[dict, np.ndarray]:
    """Keys (rising), labels, norms and matrix of some rows as bytes, and the rows' order; shorter vectors are padded with
    zeros, and 32-bit floats serve where they hold all components."""
    order = np.argsort(piece["key"].to_numpy(), kind="stable")
    listed = piece["v"].combine_chunks()
    size = listed.value_lengths().to_numpy(zero_copy_only=False)
    v = np.zeros((len(size), max(int(size.max(initial=0)), 1)))
    v[np.arange(v.shape[1]) < size[:, None]] = listed.flatten().to_numpy(zero_copy_only=False)
    narrow = bool(np.abs(v).max(initial=0) < 1 << 24)
    key, label, norm = (piece[c].to_numpy()[order] for c in ("key", "label", "norm"))
    return {"keys": key.tobytes(), "labels": label.tobytes(), "norms": norm.tobytes(), "matrix": v[order].astype(np.float32 if narrow else np.float64).tobytes(), "narrow": narrow, "width": v.shape[1], "top": float(norm.max(initial=0))}, order


def _unpack(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    of = lambda name: row[prefix + name]
    matrix = np.frombuffer(of("matrix"), np.float32 if of("narrow") else np.float64).reshape(-1, of("width"))
    return np.frombuffer(of("keys"), np.int64), np.frombuffer(of("labels"), np.int64), np.frombuffer(of("norms"), np.float64), matrix


def _sorted(rows: DataFrame) -> DataFrame:
    """Sorted by falling norm; a hash parts equal norms, so that no partition is larger than others."""
    return rows.repartitionByRange(F.desc("norm"), F.xxhash64("key", "v")).sortWithinPartitions(F.desc("norm"))


def buckets(candidates: DataFrame) -> DataFrame:
    """One row for each bucket of candidates sorted by falling norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, BUCKET):
            yield _one(_pack(piece)[0], pa.schema(_PACKED))

    return map_rows(_sorted(candidates.select("key", "label", "norm", "v")), run, _PACKED_SQL)


class Index:
    """Buckets, numbered within ranges of their largest norms: (range, slot). Only the ranges' bounds and numbers of slots are
    gathered, at most ``CLASSES`` of each."""

    def __init__(self, candidates: DataFrame):
        found = materialize(buckets(candidates), "buckets")
        shares = [i / CLASSES for i in range(1, CLASSES)]
        cuts = sorted(set(found.agg(F.percentile_approx("top", shares).alias("c")).first().c or []), reverse=True)
        # The number of cuts above a norm.
        above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col("top") < c)) if cuts else F.lit(0)
        classed = found.withColumn("range", above)
        sums = classed.groupBy("range").agg(F.count("*").alias("n"), F.max("top").alias("top")).collect()
        self.slots, self.tops = {r["range"]: r.n for r in sums}, {r["range"]: r.top for r in sums}
        slots = F.coalesce(*(F.when(F.col("range") == k, n) for k, n in self.slots.items()), F.lit(1))
        self.rows = classed.withColumn("slot", F.pmod(F.xxhash64("keys"), slots).cast("int"))

    def waves(self) -> list[list[int]]:
        """Ranges, the largest norms first, in waves that reach the shares of buckets."""
        total, seen, out, reached = sum(self.slots.values()), 0, [[] for _ in WAVES], 0
        for k in sorted(self.slots):
            while reached < len(WAVES) - 1 and seen >= WAVES[reached] * total:
                reached += 1
            out[reached].append(k)
            seen += self.slots[k]
        return [w for w in out if w]


class Search:
    """What anchors look for: each has ``windows`` windows of scores, lo to hi, and wants the ``best`` rows in each, of its own
    label or of others."""

    def __init__(self, windows: int, best: int, same: bool):
        self.windows, self.best, self.same = windows, best, same

    def blocks(self, anchors: DataFrame) -> DataFrame:
        """Anchors, with arrays lo, hi and kth of their windows, in blocks by falling norm. ``reach`` is the least norm of a
        candidate that any of a block's anchors can use."""
        n, limits = self.windows, ("lo", "hi", "kth")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches, BLOCK):
                packed, order = _pack(piece)
                each = {c: [x for i in order for x in piece[c][int(i)].as_py()] for c in limits}
                need = np.maximum(_floats(each["lo"]), _floats(each["kth"])).reshape(-1, n).min(axis=1)
                reach = np.where(need <= 0, 0.0, need / np.maximum(np.frombuffer(packed["norms"], np.float64), 1e-300)).min()
                yield _one(packed | each | {"reach": float(reach)}, pa.schema([*_PACKED, *((c, pa.list_(pa.decimal128(38, 0))) for c in limits), ("reach", pa.float64())]))

        return map_rows(_sorted(anchors.select("key", "label", "norm", "v", *limits)), run, f"{_PACKED_SQL}, {', '.join(f'{c} array<{_WHOLE}>' for c in limits)}, reach double")

    def wave(self, blocks: DataFrame, index: Index, ranges: list[int]) -> DataFrame:
        """(key, w, score, other): each anchor's best rows of each bucket that it can use."""
        tasks = min(TASKS, sum(index.slots[k] for k in ranges))
        every = F.array(*(F.struct(F.lit(k).alias("range"), F.lit(index.slots[k]).alias("n"), F.lit(float(index.tops[k])).alias("top")) for k in ranges))
        used = F.filter(every, lambda r: r["top"] * SLACK >= F.col("reach"))
        places = F.flatten(F.transform(used, lambda r: F.transform(F.sequence(F.lit(0), r["n"].cast("int") - 1), lambda s: F.struct(r["range"].alias("range"), s.alias("slot")))))
        sent = blocks.withColumn("to", F.explode(places)).select("to.range", "to.slot", *(F.col(c).alias(f"a_{c}") for c in blocks.columns if c not in ("top", "reach")))
        # Numbered partitions stay as many, however small the tables are: the work lies in the products.
        kept = index.rows.where(F.col("range").isin(ranges)).drop("top")
        pairs = sent.repartition(tasks, "range", "slot").join(kept.repartition(tasks, "range", "slot"), ["range", "slot"]).drop("range", "slot")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    found = self.meet({k: c[i].as_py() for k, c in zip(batch.schema.names, batch.columns, strict=True)})
                    if found:
                        key, w, score, other = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(w, pa.int32()), pa.array(score, pa.decimal128(38, 0)), pa.array(other, pa.int64())], names=["key", "w", "score", "other"])

        return map_rows(pairs, run, f"key long, w int, score {_WHOLE}, other long")

    def meet(self, row: dict) -> list[tuple[int, int, int, int]]:
        """(key, window, score, other) of a block and a bucket."""
        key, label, norm, a = _unpack(row, "a_")
        other, other_label, other_norm, b = _unpack(row, "")
        lo, hi, kth = ([int(x) for x in row[f"a_{c}"]] for c in ("lo", "hi", "kth"))
        low = [*map(max, lo, kth)]
        least, most = (_floats(x).reshape(-1, self.windows) for x in (low, hi))
        bound = norm * float(other_norm.max(initial=0)) * SLACK
        live = np.flatnonzero((least <= bound[:, None]).any(axis=1))
        if not len(live):
            return []
        scores = products(a[live], b, norm[live], other_norm)
        unfit = (other_label[None, :] != label[live, None]) if self.same else (other_label[None, :] == label[live, None])
        unfit |= other[None, :] == key[live, None]
        out: list[tuple[int, int, int, int]] = []
        if scores.dtype == object:
            for i, at in enumerate(live):
                fit = [(-max(-MOST, min(MOST, scores[i, j])), int(other[j])) for j in np.flatnonzero(~unfit[i])]
                for w in range(self.windows):
                    k = at * self.windows + w
                    out += [(int(key[at]), w, -s, o) for s, o in sorted(x for x in fit if low[k] <= -x[0] <= hi[k])[: self.best]]
            return out
        # One number orders a row's candidates by score, then by smaller key: keys rise with their place.
        n = len(other)
        ranked = scores.astype(np.float64) * n + (n - 1 - np.arange(n))
        ranked[unfit] = -np.inf
        ranked.sort(axis=1)
        for own, at in zip(ranked, live, strict=True):
            for w in np.flatnonzero(least[at] <= bound[at]).tolist():
                end = int(np.searchsorted(own, (most[at, w] + 1) * n, "left"))
                for r in own[max(0, end - self.best) : end][::-1].tolist():
                    if r < least[at, w] * n:
                        break
                    score, place = divmod(int(r), n)
                    out.append((int(key[at]), w, score, int(other[n - 1 - place])))
        return out


def products(a: np.ndarray, b: np.ndarray, norm_a: np.ndarray, norm_b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows. Every partial sum is bounded by the product of the norms."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = float(norm_a.max(initial=0)) * float(norm_b.max(initial=0)) * SLACK
    if most < 1 << 24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if most * len(b) < 2**53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    whole = lambda m: np.array([[int(x) for x in row] for row in m.astype(np.float64).tolist()], dtype=object).reshape(m.shape)
    return whole(a) @ whole(b).T


def _search(anchors: DataFrame, index: Index, search: Search) -> DataFrame:
    """(key, w, top) after waves over the ranges; anchors hold lo and hi."""
    found, spent = None, []
    for ranges in index.waves():
        if found is None:
            limited = anchors.withColumn("kth", _limits(search.windows, -ENDLESS))
        else:
            kth = F.when(F.size("top") >= search.best, -F.get("top", F.lit(search.best - 1))["minus"])
            held = found.select("key", "w", kth.alias("k")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("w", "k"))).alias("held"))
            each = F.transform(F.sequence(F.lit(0), F.lit(search.windows - 1)), lambda w: F.coalesce(F.col("held")[w], _whole(-ENDLESS)))
            limited = anchors.join(held, "key", "left").withColumn("kth", each).drop("held")
        new = search.wave(search.blocks(limited), index, ranges)
        if found is not None:
            new = new.unionByName(found.select("key", "w", F.explode("top").alias("t")).select("key", "w", (-F.col("t.minus")).cast(_WHOLE).alias("score"), "t.other"))
        # Best first; ties by smaller key.
        order = F.array_sort(F.collect_list(F.struct((-F.col("score")).cast(_WHOLE).alias("minus"), "other")))
        found = materialize(new.groupBy("key", "w").agg(F.slice(order, 1, search.best).alias("top")), "best")
        spent.append(found)
    if not spent:
        return anchors.sparkSession.createDataFrame([], f"key long, w int, top array<struct<minus {_WHOLE}, other long>>")
    discard(*spent[:-1])
    return found


def _whole(value: int) -> Column:
    return F.lit(str(value)).cast(_WHOLE)


def _limits(n: int, value: int) -> Column:
    return F.array(*[_whole(value)] * n)


def mine(rows: DataFrame, anchors: Column, low: int = 50, high: int = 95, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``usable`` rows.

    ``anchors`` picks the rows to mine for, by their ``key``. An anchor's positives are its best ``positives`` other rows of its
    label; for each, the best ``negatives`` rows of other labels whose score lies from ``low`` to ``high`` hundredths of the
    positive's, both included. Better means a higher score, then a smaller key. An anchor without positives gives no row, nor
    does a positive without negatives (always so if its score is negative). Different rows of one key are different candidates,
    never an anchor's own, and the least of them (label, then vector) is the anchor. Vectors of fewer components than others
    count as if zeros followed. An empty table gives an empty one.
    """
    every = materialize(rows, "vectors")
    index = Index(every)
    chosen = every.where(anchors).groupBy("key").agg(F.min(F.struct("label", "v", "norm")).alias("r")).select("key", "r.*")
    near = _search(chosen.withColumns({"lo": _limits(1, -ENDLESS), "hi": _limits(1, ENDLESS)}), index, Search(1, positives, True))
    found = near.select("key", F.posexplode("top").alias("w", "t")).select("key", "w", (-F.col("t.minus")).cast(_WHOLE).alias("score"), F.col("t.other").alias("positive"))
    of = found.where("score >= 0").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("p"))
    # Whole ends of low * positive <= 100 * negative <= high * positive; a window that is none has its ends crossed.
    part = lambda w, hundredths, more: F.floor((F.col("p")[w] * F.lit(hundredths) + F.lit(more)).cast(_WHOLE) / F.lit(100)).cast(_WHOLE)
    each = lambda fn: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), fn)
    ends = {"lo": each(lambda w: F.coalesce(part(w, low, 99), _whole(ENDLESS))), "hi": each(lambda w: F.coalesce(part(w, high, 0), _whole(-ENDLESS)))}
    far = _search(chosen.join(of, "key").withColumns(ends).drop("p"), index, Search(positives, negatives, False))
    as_long = lambda c: F.least(F.greatest(c, _whole(-(2**63))), _whole(2**63 - 1)).cast("long")
    out = far.select("key", "w", F.posexplode("top").alias("place", "t")).join(found, ["key", "w"])
    return out.select(
        F.col("key").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        (F.col("place") + 1).cast("int").alias("rank"),
        F.col("t.other").alias("negative_id"),
        as_long(F.col("score")).alias("positive_score"),
        as_long((-F.col("t.minus")).cast(_WHOLE)).alias("negative_score"),
    )


def oracle() -> str:
    """SQL of the query over ``embeddings``."""
    return """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""
