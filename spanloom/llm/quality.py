"""Quality rules with adaptive thresholds from mergeable quantile sketches, in DataFrame functions only.

Four ratios and three sizes are measured per text. KLL sketches summarise each per language and source, and merge into
sketches per language and over all rows. A limit is a fence around the group's median:

    median + 8 * (the narrower of the distances from the median to the 5th and 95th percentile) + slack

Bad texts lie on one side, so the narrower distance stays put as long as less than half of a group is bad, and a poor source
does not loosen its own limits. The slack is what a few chance events (``CHANCE``: eight symbols, a line and a half, thirty
words of one repeated passage, sixty characters of a long address) make of a text as short as the group's lower quartile, so
it follows the group's own sizes. Limits of thin groups are drawn to their language's, and those to the limits of all rows,
as if ``PSEUDO`` rows of the wider group were among theirs: there is no size from which a group counts.

A sketch is exact up to about ``SKETCH_K`` rows; beyond, it draws at random, and a text just at a limit may fall either way
between runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import materialize

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Weight, in rows, of the wider group in a group's limits; k of the sketches.
PSEUDO, SKETCH_K = 50, 1024
#: ratio -> (size, events by which a text of the group's lower-quartile size may exceed the fence).
CHANCE = {"symbol_ratio": ("word_chars", 8.0), "dup_line_ratio": ("n_lines", 1.5), "repeat_ratio": ("n_words", 30.0), "word_length": ("n_words", 60.0)}
SIZES = ("word_chars", "n_lines", "n_words")
TIMES, SIDE = 8.0, 0.05
#: Limits: upper ones for all ratios, a lower one for the length of words.
LIMITS = (*(f"{r}_max" for r in CHANCE), "word_length_min")


def word_array(text: str) -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BLANK), "")


def repeated_words(words: str, low: str) -> Column:
    """Words of an array within three-word windows that occur twice or more, each place once.

    A window's hash and its place share one long: the place in as many low bits as the length needs (column ``low`` masks
    them), the hash in the others, so one sort of primitive longs brings equal windows together. Windows that agree in the
    hash are then compared word by word, so chance never counts.
    """
    n, low = F.size(words), F.col(low)
    at = lambda i: F.get(words, i)
    coded = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))

    def beside(s: Column, same) -> Column:
        """The elements that equal the one before or behind."""
        return F.filter(s, lambda x, i: F.when(i > 0, same(s[i], s[F.greatest(i - 1, F.lit(0))])).otherwise(False) | F.when(i < F.size(s) - 1, same(s[i], s[F.least(i + 1, F.size(s) - 1)])).otherwise(False))

    def spelled(place: Column) -> Column:
        i = place.cast("int")
        return F.struct(at(i).alias("a"), at(i + 1).alias("b"), at(i + 2).alias("c"), i.alias("i"))

    def places(s: Column) -> Column:
        alike = beside(s, lambda x, y: x.bitwiseXOR(y).bitwiseAND(F.bitwise_not(low)) == 0)
        windows = F.sort_array(F.transform(alike, lambda x: spelled(x.bitwiseAND(low))))
        equal = F.transform(F.array(windows), lambda w: beside(w, lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])))[0]
        return F.sort_array(F.transform(equal, lambda x: x["i"].cast("long")))

    def covered(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end")), lambda a, x: F.struct((a["n"] + x + 3 - F.greatest(a["end"], x)).alias("n"), (x + 3).alias("end")), lambda a: a["n"])

    once = F.transform(F.array(F.sort_array(coded)), lambda s: F.when(F.size(F.array_distinct(F.transform(s, lambda x: x.bitwiseAND(F.bitwise_not(low))))) == F.size(s), F.lit(0).cast("long")).otherwise(covered(places(s))))
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(once[0])


def measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of each whole text; null counts as empty."""
    value = F.coalesce(F.col(text), F.lit(""))
    first = docs.select(*keep, value.alias("_text"), word_array(text).alias("_words"), F.filter(F.split(value, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    bits = F.ceil(F.log2(F.size("_words") + F.lit(1))).cast("int")
    first = first.select("*", (F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).alias("_low"))
    return first.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        repeated_words("_words", "_low").alias("n_repeat_words"),
    )


def with_ratios(measured: DataFrame) -> DataFrame:
    one = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return measured.withColumns({
        "symbol_ratio": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_ratio": F.col("n_repeat_words") / one,
        "word_length": F.col("word_chars") / one,
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    })


def thresholds(rated: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(g_lang, g_source, level, n, LIMITS): a row per group (level 0), per language (1, null source) and over all (2).

    Texts that fail the base rules are no sample of a group's usual ones and stay out of its sketches. Rows are salted by
    their hash into sixteen partial sketches, so a hot group is summed by many tasks before its sketches merge.
    """
    measured = (*CHANCE, *SIZES)
    salt = F.pmod(F.xxhash64("n_words", "word_chars"), F.lit(16))
    parts = rated.where("NOT base_failed").groupBy(F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), salt.alias("salt")).agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(F.col(r).cast("double"), F.lit(SKETCH_K)).alias(r) for r in measured))
    merged = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(r, F.lit(SKETCH_K)).alias(r) for r in measured)]
    fine = parts.groupBy("g_lang", "g_source").agg(*merged)
    language = fine.groupBy("g_lang").agg(*merged)
    whole = language.groupBy().agg(*merged).where("n > 0")
    null = F.lit(None).cast("string")
    levels = fine.withColumn("level", F.lit(0)).unionByName(language.withColumns({"g_source": null, "level": F.lit(1)})).unionByName(whole.withColumns({"g_lang": null, "g_source": null, "level": F.lit(2)}))
    at = lambda c, q: F.kll_sketch_get_quantile_double(c, F.lit(q))

    def room(ratio: str) -> Column:
        size, events = CHANCE[ratio]
        middle = at(ratio, 0.5)
        return TIMES * F.least(middle - at(ratio, SIDE), at(ratio, 1 - SIDE) - middle) + events / F.greatest(at(size, 0.25), F.lit(1.0))

    return levels.select("g_lang", "g_source", "level", "n", *((at(r, 0.5) + room(r)).alias(f"{r}_max") for r in CHANCE), (at("word_length", 0.5) - room("word_length")).alias("word_length_min"))


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the measures, base_failed, kept, the ratios and the limits that held for every row.

    Null texts have no words and fail; null languages and sources form groups of their own; repeated rows count as often as
    they occur. A text is kept if it passes the base rules and lies within its group's limits. Limits are joined as a
    broadcast only where Spark's own size check allows it.
    """
    held = tuple(dict.fromkeys((*keep, lang, source)))
    rated = with_ratios(materialize(measures(docs, text, held), "measures"))
    limits = materialize(thresholds(rated, lang, source), "limits")
    level = lambda k, tag, *drop: limits.where(F.col("level") == k).drop("level", *drop).withColumnsRenamed({c: f"{tag}_{c}" for c in limits.columns})
    joined = (
        rated.join(level(0, "o"), F.col(lang).eqNullSafe(F.col("o_g_lang")) & F.col(source).eqNullSafe(F.col("o_g_source")), "left")
        .join(level(1, "l", "g_source"), F.col(lang).eqNullSafe(F.col("l_g_lang")), "left")
        .join(F.broadcast(level(2, "w", "g_lang", "g_source")), F.lit(True), "left")
    )

    def drawn(own: Column, n: Column, wider: Column) -> Column:
        """A limit drawn to the wider group's; the wider group's where there is none."""
        return F.coalesce((n * own + PSEUDO * wider) / (n + PSEUDO), wider)

    limited = joined.withColumns({c: drawn(F.col(f"o_{c}"), F.col("o_n"), drawn(F.col(f"l_{c}"), F.col("l_n"), F.col(f"w_{c}"))) for c in LIMITS})
    bad = F.col("word_length") < F.col("word_length_min")
    for r in CHANCE:
        bad = bad | (F.col(r) > F.col(f"{r}_max"))
    return limited.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.coalesce(bad, F.lit(False))).alias("kept"), *CHANCE, *LIMITS)


def accept(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, that are kept. Rows are written once with their measures, so texts are read once and
    not shuffled. Null and empty texts go; repeated rows stay or go together; an empty table stays empty."""
    packed = docs.select(F.col(text).alias("_t"), F.col(lang).alias("_lang"), F.col(source).alias("_source"), F.struct(*docs.columns).alias("_row"))
    return judged(packed, "_t", "_lang", "_source", ("_row",)).where("kept").select("_row.*")
