"""Toxicity by two class-conditional Kneser-Ney models over the characters of words.

Each class has its own counts of the longest n-grams (a character with up to seven before it, the word's start included).
Everything below is shared: Kneser-Ney continuation counts pooled over both classes, interpolated level by level. So

    p_class(c | context) = (max(n_class(context c) - D, 0) + D * kinds_class(context) * shared(c | shorter)) / n_class(context)

and a class that has never seen a context goes over to ``shared`` whole. Where neither class has seen the n-gram, ``shared``
cancels in the ratio of the classes and only the two back-off masses are left. A model is therefore two tables: the log ratio
of each n-gram seen, and of each context's back-off masses. Rare expressions cost both classes alike.

A text's evidence is length-normalised: the classes' log-likelihood ratio per character, the same per word if a toxic text
is ordinary but for one word in thirty, and the mean of its three most toxic words. A logistic curve, fitted on labelled
rows that the counts have not seen, turns it into a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from spanloom.llm.common import Sorted, discard, map_rows, materialize, remainder, words

ORDER = 8
START, END = "\x02", "\x03"
DISCOUNT = 0.9
#: The documented bound of the classifier's sample: about so many labelled rows, drawn by the hash of their keys, and of them so many for the curve.
MAX_LABELLED, MAX_CALIBRATION = 40_000, 8_000
#: Table rows up to which a model is broadcast (12 bytes each; beyond, it stays in tables), words remembered by a task.
MAX_GRAMS, MAX_WORDS = 6_000_000, 100_000
#: Words whose ratios are broadcast where the model is kept in tables.
COMMON = 100_000
#: Share of toxic words in a toxic text; bound of one word's log ratio.
SHARE, MOST = 1 / 30, 20.0
#: Where the curve starts from; labelled rows move it.
PRIOR = np.array([5.0, 5.0, 0.5, -4.0])
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def grams(word: str, order: int = ORDER) -> Iterator[str]:
    """Each character of a word and its end with up to ``order - 1`` characters before it, the start mark included."""
    marked = START + word + END
    for i in range(1, len(marked)):
        yield marked[max(0, i - order + 1) : i + 1]


def _mixed(text: str) -> np.ndarray:
    with np.errstate(over="ignore"):
        one = (np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)) * _MIX
    return one ^ one >> np.uint64(29)


class Stream:
    """The characters of marked words in one array, with the hash of the n-gram that ends at each and of its context."""

    def __init__(self, batch: list[str]):
        one = _mixed("".join([START + w + END for w in batch]))
        size = np.fromiter(map(len, batch), np.int64, len(batch)) + 2
        self.starts = np.cumsum(size) - size
        place = np.arange(len(one)) - np.repeat(self.starts, size)
        self.scored = place > 0
        length = np.minimum(place + 1, ORDER)
        with np.errstate(over="ignore"):
            run = one.copy()
            self.gram, self.context = run.copy(), np.zeros_like(run)
            for k in range(2, ORDER + 1):
                shorter = run
                run = one.copy()
                run[1:] += shorter[:-1] * _STEP
                at = length == k
                self.gram[at] = run[at]
                self.context[1:][at[1:]] = shorter[:-1][at[1:]]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over each word's scored characters."""
        return np.add.reduceat(np.where(self.scored, values, 0.0), self.starts) if len(self.starts) else np.zeros(0)


def gram_hashes(batch: list[str]) -> np.ndarray:
    """The hashes that a stream has for n-grams and contexts."""
    out = np.zeros(len(batch), np.uint64)
    size = np.fromiter(map(len, batch), np.int64, len(batch))
    one, first = _mixed("".join(batch)), np.cumsum(size) - size
    with np.errstate(over="ignore"):
        for k in range(ORDER):
            at = np.flatnonzero(size > k)
            out[at] = out[at] * _STEP + one[first[at] + k]
    return out


class Shared:
    """Continuation counts as they travel: of each shorter n-gram the discounted share and the mass that goes to the next shorter one."""

    def __init__(self, rows: pa.Table, uniform: float):
        self.rows, self.uniform = Sorted(rows["hash"].to_numpy().view(np.uint64), rows["share"].to_numpy(), rows["mass"].to_numpy()), uniform

    def chances(self, batch: list[str]) -> np.ndarray:
        """Interpolated probability of each n-gram's last character after the others."""
        p, size = np.full(len(batch), self.uniform), np.fromiter(map(len, batch), np.int64, len(batch))
        one, ends = _mixed("".join(batch)), np.cumsum(size) - 1
        run = np.zeros(len(batch), np.uint64)
        for k in range(int(size.max(initial=0))):
            # The hash of the last k + 1 characters, from the first of them on.
            at = np.flatnonzero(size > k)
            run[at] = 0
            with np.errstate(over="ignore"):
                for back in range(k, -1, -1):
                    run[at] = run[at] * _STEP + one[ends[at] - back]
            found, place = self.rows.find(run[at])
            p[at] = np.where(found, self.rows.values[0][place] + self.rows.values[1][place] * p[at], p[at])
        return p


class Compact:
    """A model as it travels: log ratios of n-grams and of contexts by their hashes."""

    def __init__(self, rows: pa.Table):
        kind, hashes, ratios = rows["kind"].to_numpy(), rows["hash"].to_numpy().view(np.uint64), rows["ratio"].to_numpy()
        self.tables = [Sorted(hashes[kind == k], ratios[kind == k]) for k in (0, 1)]

    def _found(self, k: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, place = self.tables[k].find(hashes)
        return found, self.tables[k].values[0][place]

    def word_ratios(self, batch: list[str], chars: int = 400_000) -> np.ndarray:
        """log of toxic over ordinary probability of whole words."""
        out, at = [], 0
        while at < len(batch):
            end, size = at, 0
            while end < len(batch) and (end == at or size + len(batch[end]) <= chars):
                size += len(batch[end])
                end += 1
            stream = Stream(batch[at:end])
            seen, own = self._found(0, stream.gram)
            held, back = self._found(1, stream.context)
            out.append(stream.sums(np.where(seen, own, np.where(held, back, 0.0))))
            at = end
        return np.concatenate(out) if out else np.zeros(0)


def features(ratios: np.ndarray, times: np.ndarray, chars: int) -> tuple[float, float, float]:
    """From distinct words' log ratios and how often each occurs: the three figures of a text; zeros for no words."""
    if not len(ratios):
        return 0.0, 0.0, 0.0
    n = times.sum()
    mixed = np.log1p(SHARE * np.expm1(np.minimum(ratios, MOST)))
    return float((ratios * times).sum() / chars), float((mixed * times).sum() / n), _top(ratios, times)


def _top(ratios: np.ndarray, times: np.ndarray) -> float:
    most = np.argsort(-ratios)[:3]
    three = np.repeat(np.clip(ratios[most], 0.0, MOST), np.minimum(times[most], 3).astype(np.int64))[:3]
    return float(three.sum() / 3)


class Tables:
    """A model for any number of n-grams: its rows stay in a written table, and distinct words' n-grams are joined with it."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def word_ratios(self, docs: DataFrame, text: str) -> DataFrame:
        """(word, n, ratio) of all distinct words of ``docs``."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter[bytes] = Counter()

            def flush() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array([*seen], pa.binary()).cast(pa.string()), pa.array([*seen.values()], pa.int64())], names=["word", "n"])
                seen.clear()
                return out

            for batch in batches:
                for value in batch.column(0):
                    seen.update(words(value.as_py()))
                    if len(seen) > MAX_WORDS:
                        yield flush()
            yield flush()

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Words go by number: a long one has as many n-grams as characters.
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    stream = Stream(part.column(1).to_pylist())
                    owner = np.repeat(part.column(0).to_numpy(zero_copy_only=False), np.diff([*stream.starts, len(stream.gram)]))
                    arrays = (owner[stream.scored], stream.gram[stream.scored].view(np.int64), stream.context[stream.scored].view(np.int64))
                    for lo in range(0, len(arrays[0]), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(a[lo : lo + 100_000]) for a in arrays], names=["id", "gram", "context"])

        found = materialize(map_rows(docs.select(F.col(text).cast("binary").alias("text")), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).withColumn("id", F.monotonically_increasing_id()), "words")
        pieces = map_rows(found.select("id", "word"), cut, "id long, gram long, context long")
        # Many words share n-grams: equal ones of a task are one row, and each model row is dealt over sixteen salts.
        pieces = pieces.groupBy("id", "gram", "context").agg(F.count("*").alias("times")).withColumn("salt", F.pmod("id", F.lit(16)).cast("int"))
        salted = self.rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        own = salted.where("kind = 0").select(F.col("hash").alias("gram"), "salt", F.col("ratio").alias("own"))
        back = salted.where("kind = 1").select(F.col("hash").alias("context"), "salt", F.col("ratio").alias("back"))
        ratio = F.coalesce("own", "back", F.lit(0.0)) * F.col("times")
        sums = pieces.join(own, ["gram", "salt"], "left").join(back, ["context", "salt"], "left").groupBy("id").agg(F.sum(ratio).alias("ratio"))
        return materialize(found.join(sums, "id", "left").select("word", "n", F.coalesce("ratio", F.lit(0.0)).alias("ratio")), "ratios")

    def featured(self, docs: DataFrame, key: str, text: str, more: dict[str, str]) -> DataFrame:
        """As ``featured``: the commonest words' ratios are broadcast, all others are looked up by a join in which no word is hot."""
        ratios = self.word_ratios(docs, text)
        common = ratios.orderBy(F.desc("n"), "word").limit(COMMON).toArrow()
        known = docs.sparkSession.sparkContext.broadcast(dict(zip((w.encode() for w in common["word"].to_pylist()), common["ratio"].to_pylist(), strict=True)))
        least = min(common["n"].to_pylist(), default=0)
        fields = [StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate((key, *more))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, row = known.value, TaskContext.get().partitionId() << 33
            for batch in batches:
                out = []
                for value in batch.column(0):
                    counts = Counter(words(value.as_py()))
                    out.append((row, [w.decode() for w in counts], [*counts.values()], [held.get(w) for w in counts]))
                    row += 1
                types = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.float64()))
                cols = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], names=[*(f.name for f in fields), "row", "words", "times", "known"])

        picked = docs.select(F.col(text).cast("binary").alias("text"), *(F.col(c).alias(f"c{k}") for k, c in enumerate((key, *more))))
        tail = StructType.fromDDL("row long, words array<string>, times array<long>, known array<double>")
        drafts = materialize(map_rows(picked, run, StructType([*fields, *tail.fields])), "drafts")
        each = drafts.select("row", F.explode(F.arrays_zip("words", "times", "known")).alias("z")).select("row", F.col("z.words").alias("word"), F.col("z.times").alias("times"), F.col("z.known").alias("known"))
        rare = each.where("known IS NULL").join(ratios.where(F.col("n") <= least).select("word", "ratio"), "word")
        every = each.where("known IS NOT NULL").select("row", "word", "times", F.col("known").alias("ratio")).unionByName(rare.select("row", "word", "times", "ratio"))
        mixed = F.log1p(SHARE * F.expm1(F.least("ratio", F.lit(MOST))))
        # A text's three most toxic words, repeats counted: of each word three at most matter.
        ranked = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("ratio", "times")))), 1, 3)
        three = F.slice(F.flatten(F.transform(ranked, lambda w: F.array_repeat(F.greatest(F.least(w["ratio"], F.lit(MOST)), F.lit(0.0)), F.least(w["times"], F.lit(3)).cast("int")))), 1, 3)
        chars = F.sum((F.length("word") + 1) * F.col("times"))
        sums = every.groupBy("row").agg((F.sum(F.col("ratio") * F.col("times")) / chars).alias("x0"), (F.sum(mixed * F.col("times")) / F.sum("times")).alias("x1"), (F.aggregate(three, F.lit(0.0), lambda a, x: a + x) / 3).alias("x2"))
        names = [F.col(f"c{k}").alias(c) for k, c in enumerate((key, *more))]
        return drafts.join(sums, "row", "left").select(*names, *(F.coalesce(f"x{k}", F.lit(0.0)).alias(f"x{k}") for k in range(3)))


def count_grams(joined: DataFrame, text: str, label: str) -> DataFrame:
    """(gram, toxic, ordinary) over labelled rows, summed within each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            for k, counter in enumerate(seen):
                sums: Counter[str] = Counter()
                for w, n in counter.items():
                    for g in grams(w.decode()):
                        sums[g] += n
                counter.clear()
                values, none = pa.array([*sums.values()], pa.int64()), pa.array(np.zeros(len(sums), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.string()), *((none, values) if k else (values, none))], names=["gram", "toxic", "ordinary"])

        for batch in batches:
            for value, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen[0 if y else 1].update(words(value.as_py()))
                if len(seen[0]) + len(seen[1]) > MAX_WORDS // 4:
                    yield from flush()
        yield from flush()

    rows = map_rows(joined.select(F.col(text).cast("binary").alias("text"), F.col(label).cast("int").alias("label")), run, "gram string, toxic long, ordinary long")
    return rows.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _head(c: str):
    return F.expr(f"left({c}, length({c}) - 1)")


def model_rows(counts: DataFrame, max_grams: int) -> DataFrame:
    """(kind, hash, ratio), written: the log ratio of each n-gram (kind 0) and of each context's back-off masses (kind 1).

    Continuation counts come from the distinct n-grams. Up to ``max_grams`` shorter n-grams they are broadcast and every task
    interpolates its own; beyond, level is joined with level. Joins are on n-grams and contexts, whose rows an alphabet bounds;
    none is hot.
    """
    each = counts.groupBy(_head("gram").alias("context")).agg(F.sum("toxic").alias("n_a"), F.sum("ordinary").alias("n_b"), F.count_if(F.col("toxic") > 0).alias("kinds_a"), F.count_if(F.col("ordinary") > 0).alias("kinds_b"))
    heads = materialize(each, "heads")
    suffixes = F.transform(F.sequence(F.lit(1), F.length("gram") - 1), lambda m: F.expr("gram").substr(F.length("gram") - m + 1, m))
    endings = counts.where("length(gram) > 1").select(F.explode(suffixes).alias("x")).distinct()
    # Pooled: in how many one longer contexts a shorter n-gram occurs.
    lower = materialize(counts.select("gram").union(endings.where("length(x) > 1")).where("length(gram) > 1").groupBy(F.expr("substring(gram, 2)").alias("x")).agg(F.count("*").alias("n")), "lower")
    lower_heads = lower.groupBy(_head("x").alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    share, mass = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total"), DISCOUNT * F.col("kinds") / F.col("total")
    steps = materialize(lower.withColumn("context", _head("x")).join(lower_heads, "context").select("x", share.alias("share"), mass.alias("mass")), "steps")
    seen = counts.withColumns({"context": _head("gram"), "x": F.expr("substring(gram, 2)")}).join(heads, "context")
    uniform = 1.0 / (steps.where("length(x) = 1").count() + 1)
    spread = None
    if steps.count() <= max_grams:
        packed = map_rows(steps, lambda batches: (pa.RecordBatch.from_arrays([pa.array(gram_hashes(b.column(0).to_pylist()).view(np.int64)), *(c.cast(pa.float32()) for c in b.columns[1:])], names=["hash", "share", "mass"]) for b in batches), "hash long, share float, mass float")
        spread = counts.sparkSession.sparkContext.broadcast(Shared(packed.toArrow(), uniform))
        seen = seen.withColumn("p", F.lit(0.0))
    else:
        seen = seen.join(_interpolated(steps, uniform), "x")
    columns = ["toxic", "ordinary", "n_a", "n_b", "kinds_a", "kinds_b"]
    rows = seen.select(F.lit(0).alias("kind"), F.col("gram").alias("name"), "p", *columns).unionByName(heads.select(F.lit(1).alias("kind"), F.col("context").alias("name"), F.lit(0.0).alias("p"), F.lit(0).cast("long").alias("toxic"), F.lit(0).cast("long").alias("ordinary"), *columns[2:]))

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, kind = batch.column(1).to_pylist(), batch.column(0).to_numpy(zero_copy_only=False)
            p, a, b, n_a, n_b, kinds_a, kinds_b = (c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[2:])
            if spread is not None:
                p = np.where(kind == 0, spread.value.chances([x[1:] if k == 0 else "" for x, k in zip(names, kind, strict=True)]), 0.0)
            # A context's own row has back-off mass alone: nothing seen, and a lower probability of one.
            p = np.where(kind == 0, p, 1.0)
            chance = lambda c, n, kinds: np.where(n > 0, (np.maximum(c - DISCOUNT, 0) + DISCOUNT * kinds * p) / np.maximum(n, 1), p)
            ratio = np.log(chance(a, n_a, kinds_a) / chance(b, n_b, kinds_b))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int8()), pa.array(gram_hashes(names).view(np.int64)), pa.array(ratio.astype(np.float32))], names=["kind", "hash", "ratio"])

    written = materialize(map_rows(rows, rated, "kind byte, hash long, ratio float"), "model")
    if spread is not None:
        spread.destroy()
    discard(heads, lower, steps)
    return written


def _interpolated(steps: DataFrame, uniform: float) -> DataFrame:
    """(x, p): shared probabilities, level joined with the level below."""
    shared = None
    for m in range(1, ORDER):
        x = steps.where(f"length(x) = {m}")
        if m == 1:
            x = x.withColumn("below", F.lit(uniform))
        else:
            x = x.withColumn("tail", F.expr("substring(x, 2)")).join(level.select(F.col("x").alias("tail"), F.col("p").alias("below")), "tail")
        level = materialize(x.select("x", (F.col("share") + F.col("mass") * F.col("below")).alias("p")), "shared")
        shared = level if shared is None else shared.union(level)
    return shared


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 60) -> np.ndarray:
    """Logistic weights (the last is the intercept) by Newton's steps; ``ridge`` draws them to ``PRIOR``, so few rows or one class change little."""
    a = np.column_stack([x, np.ones(len(x))])
    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), a.T @ (p - y) + ridge * (w - PRIOR))
        w -= step * min(1.0, 4.0 / max(float(np.abs(step).max()), 1e-9))
        if np.abs(step).max() < 1e-9:
            break
    return w


class Scorer:
    """A task's use of a compact model: texts to evidence, with a bounded memory of the words seen last."""

    def __init__(self, model: Compact):
        self.model, self.known = model, {}

    def evidence(self, texts: pa.Array, step: int = 256) -> np.ndarray:
        """(n, 3) of a column of UTF-8 texts."""
        out = []
        for at in range(0, len(texts), step):
            split = [words(v.as_py()) for v in texts.slice(at, step)]
            counted = [Counter(t) for t in split]
            new = [*{w for c in counted for w in c if w not in self.known}]
            if len(self.known) + len(new) > MAX_WORDS:
                self.known.clear()
                new = [*{w for c in counted for w in c}]
            self.known.update(zip(new, self.model.word_ratios([w.decode() for w in new]).tolist(), strict=True))
            for tokens, c in zip(split, counted, strict=True):
                r, n = np.fromiter(map(self.known.__getitem__, c), np.float64, len(c)), np.fromiter(c.values(), np.float64, len(c))
                out.append(features(r, n, len(b" ".join(tokens).decode()) + 1))
        return np.array(out, dtype=np.float64).reshape(-1, 3)


def featured(docs: DataFrame, model: Broadcast | Tables, key: str, text: str, more: dict[str, str]) -> DataFrame:
    """(key, *more, x0, x1, x2): the evidence of each whole text; a compact model is broadcast."""
    if isinstance(model, Tables):
        return model.featured(docs, key, text, more)
    kinds = [(c, docs.schema[c].dataType.simpleString()) for c in (key, *more)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            x = scorer.evidence(batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(x[:, k]) for k in range(3))], names=[*(f"c{k}" for k in range(len(kinds))), "x0", "x1", "x2"])

    picked = docs.select(F.col(text).cast("binary").alias("text"), *(F.col(c).alias(f"c{k}") for k, (c, _) in enumerate(kinds)))
    out = map_rows(picked, run, ", ".join([*(f"c{k} {kind}" for k, (_, kind) in enumerate(kinds)), "x0 double, x1 double, x2 double"]))
    return out.withColumnsRenamed({f"c{k}": c for k, (c, _) in enumerate(kinds)})


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3, held_out: int = 1) -> tuple[Broadcast | Tables, np.ndarray] | None:
    """A model and its curve from the labelled rows whose crc32(key) modulo ``folds`` is not ``held_out``; None without both labels.

    Counts cover all n-grams of all these rows but the calibration folds (of the ``5 * folds`` remainders the two that are 4
    modulo 5 and not held out). Rows are a sample by hash of about ``MAX_LABELLED``, which bounds what is broadcast of labels,
    and at most ``MAX_CALIBRATION`` for the curve. The model is broadcast up to ``MAX_GRAMS`` rows and kept in tables beyond.
    A key with several labels counts as toxic if one of them is; null labels and keys are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (remainder(key, folds) != held_out)).groupBy(F.col(key).alias("label_key")).agg(F.max(label).alias("label"))
    # Shares of a million: all of them up to MAX_LABELLED rows.
    known = known.where(F.pmod(F.xxhash64("label_key", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, MAX_LABELLED / max(known.count(), 1))))
    known = F.broadcast(known)
    joined = docs.select(F.col(key).alias("label_key"), F.col(text).alias("text")).join(known, "label_key")
    calibrates = remainder("label_key", 5 * folds).isin(*(k for k in range(5 * folds) if k % 5 == 4 and k % folds != held_out))
    counts = materialize(count_grams(joined.where(~calibrates), "text", "label"), "grams")
    sums = counts.agg(F.sum("toxic").alias("a"), F.sum("ordinary").alias("b")).first()
    if not (sums.a and sums.b):
        return None
    rows = model_rows(counts, MAX_GRAMS)
    # Once sent, the driver holds nothing of it.
    model = docs.sparkSession.sparkContext.broadcast(Compact(rows.toArrow())) if rows.count() <= MAX_GRAMS else Tables(rows)
    sample = featured(joined.where(calibrates), model, "label_key", "text", {"label": ""})
    seen = sample.orderBy(F.xxhash64("label_key"), "label_key").limit(MAX_CALIBRATION).collect()
    return model, fit_curve(np.array([(r.x0, r.x1, r.x2) for r in seen]).reshape(-1, 3), np.array([float(r.label > 0) for r in seen]))


def score(docs: DataFrame, fitted: tuple[Broadcast | Tables, np.ndarray] | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): each whole text's probability of label 1. Null and empty texts have no evidence and get the curve's
    value there; without a model every score is 0. Repeated rows give repeated rows."""
    if fitted is None:
        return docs.select(key, F.lit(0.0).alias("score"))
    model, w = fitted
    rows = featured(docs, model, key, text, {})
    z = sum((F.col(f"x{k}") * float(w[k]) for k in range(3)), F.lit(float(w[3])))
    return rows.select(key, (1 / (1 + F.exp(-z))).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted): fit on the labels outside the held-out third, score every document.

    Null keys count as the empty text for the remainder and are never labelled. Empty tables give empty results.
    """
    scored = score(docs, fit(docs, labels, key, text), key, text)
    return scored.select(key, (remainder(key, 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under ``threshold``; with a broadcast model rows pass through the
    scorer, nothing is shuffled. Null and empty texts stay or go by the curve's value there; repeated rows go together;
    without both labels all rows stay."""
    fitted = fit(docs, labels, key, text)
    if fitted is None:
        return docs
    if isinstance(fitted[0], Tables):
        packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
        return score(packed, fitted, "_row", "_text").where(F.col("score") < threshold).select("_row.*")
    model, w = fitted
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            x = scorer.evidence(batch.column(place).cast(pa.binary()))
            p = 1 / (1 + np.exp(-(x @ w[:3] + w[3])))
            yield batch.filter(pa.array(p < threshold))

    return map_rows(docs, run, docs.schema)
