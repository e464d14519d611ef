"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of ``width`` words (the whole item if it is shorter). A document must hold a window whole,
so with the window's words ordered by rarity over all documents the necessary prefix is one word, its rarest: documents
are joined on these anchors alone. The anchor's place in the window and the window's length bound where it can start
(positions) and whether it fits (length); what is left is compared word by word at its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import materialize

WIDTH = 10
#: Fixed value: what separates words once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most windows that are broadcast (about 60 MB at 20 bytes a word); with more, anchors and windows are joined by shuffle.
MAX_BROADCAST = 200_000
#: Stands behind each document's words; never a word itself.
SENTINEL = "\x00"


def ascii_lower(text: Column) -> Column:
    """A-Z only; the quick function does where all is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_array(text: str) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), SEPARATORS), "")


def windows(items: DataFrame, item: str, text: str, width: int) -> DataFrame:
    """(win array<string>, items array): the distinct windows of all items, with the items that hold each."""
    split = items.select(F.col(item).alias("item"), word_array(text).alias("words")).where(F.size("words") > 0)
    each = split.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0))), lambda i: F.slice("words", i + 1, F.lit(width)))).alias("win"))
    return each.groupBy("win").agg(F.collect_set("item").alias("items"))


def anchors(found: DataFrame, docs: DataFrame, text: str, broadcast: bool) -> DataFrame:
    """(win, items, word, offset, size): each window with its rarest word over all documents.

    A window with a word that no document has can occur nowhere and is dropped.
    """
    each = found.select("win", F.posexplode("win").alias("offset", "word"))
    vocabulary = each.select("word").distinct()
    tokens = docs.select(F.explode(word_array(text)).alias("word"))
    counts = tokens.join(F.broadcast(vocabulary) if broadcast else vocabulary, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    counts = materialize(counts, "rarity")
    rarest = each.join(F.broadcast(counts) if broadcast else counts, "word", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("r"))
    return found.join(rarest.where("r.n > 0"), "win").select("win", "items", F.col("r.word").alias("word"), F.col("r.offset").alias("offset"), F.size("win").alias("size"))


def _fits(start: Column, words: str) -> Column:
    return (start >= 0) & (start + F.col("size") <= F.size(words)) & (F.slice(words, F.greatest(start, F.lit(0)) + 1, F.col("size")) == F.col("win"))


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(key, mark, n_words, copies, spans, items): for each distinct document its hit word spans and the items found.

    ``mark`` is the text's hash and ``copies`` the number of equal rows. spans holds (start, end) of every occurrence.
    """
    found = materialize(windows(items, item, item_text, width), "windows")
    small = found.count() <= max_broadcast
    placed = materialize(anchors(found, docs, text, small), "anchors")
    doc = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), word_array(text).alias("words"))
    span = F.struct(F.col("start"), (F.col("start") + F.col("size")).alias("end"))
    gathered = [F.collect_set(F.when(F.col("size") > 0, span)).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")]
    if small:
        end = docs.sparkSession.range(1).select(F.array().cast("array<string>").alias("win"), F.lit(None).cast(placed.schema["items"].dataType).alias("items"), F.lit(SENTINEL).alias("word"), F.lit(0).alias("offset"), F.lit(0).alias("size"))
        each = doc.select("*", F.posexplode(F.concat("words", F.array(F.lit(SENTINEL)))).alias("pos", "word"))
        start = F.col("pos") - F.col("offset")
        hits = each.join(F.broadcast(placed.unionByName(end)), "word").where(_fits(start, "words"))
        rows = hits.select("key", "mark", F.size("words").cast("long").alias("n_words"), start.alias("start"), "size", "items")
        return rows.groupBy("key", "mark", "n_words").agg(F.count(F.when(F.col("size") == 0, 1)).alias("copies"), *gathered)
    each = doc.select("key", "mark", F.size("words").alias("n_words"), F.posexplode("words").alias("pos", "word"))
    start = F.col("pos") - F.col("offset")
    near = each.join(placed.select("word", "offset", "size", F.xxhash64("win").alias("window")), "word").where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
    near = near.select("key", "mark", start.alias("start"), "window").distinct()
    texts = doc.groupBy("key", "mark").agg(F.first("words").alias("words"), F.count("*").alias("copies"))
    full = near.withColumnsRenamed({"key": "k", "mark": "m"}).join(texts, F.col("k").eqNullSafe(F.col("key")) & (F.col("m") == F.col("mark")))
    hits = full.join(placed.withColumn("window", F.xxhash64("win")), "window").where(_fits(F.col("start"), "words"))
    some = hits.groupBy(F.col("key").alias("k"), F.col("mark").alias("m")).agg(*gathered)
    none = F.array().cast(some.schema["spans"].dataType), F.array().cast(some.schema["items"].dataType)
    joined = texts.join(some, F.col("k").eqNullSafe(F.col("key")) & (F.col("m") == F.col("mark")), "left")
    return joined.select("key", "mark", F.size("words").cast("long").alias("n_words"), "copies", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))


def covered(spans: str) -> Column:
    """Words within any of the spans, each once."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n"), F.greatest(a["end"], s["end"]).alias("end"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated), one row for each document row.

    Null texts have no words. Items without words are ignored. Null items ids are left out of the lists. A row repeated
    with the same key and text is matched once and returned as often as it occurs.
    """
    found = matches(docs, items, key, text, **options)
    ids = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    rows = found.select(
        F.col("key").alias(key), "n_words", covered("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")
    )
    return rows.drop("copy").withColumn("contaminated", F.col("n_hit") > 0)


def oracle(width: int = WIDTH) -> str:
    """The same result by comparing every window of every document, in SQL for a second engine."""
    split = lambda text: f"list_filter(string_split_regex(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {split("text")} AS w FROM documents),
i AS (SELECT item_id, {split("text")} AS w FROM benchmark),
win AS (SELECT item_id, list_slice(w, s + 1, s + least(len(w), {width})) AS win FROM (SELECT item_id, w, unnest(range(greatest(len(w) - {width}, 0) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM win),
places AS (SELECT rid, s, n, list_slice(w, s + 1, s + n) AS win FROM (SELECT rid, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT rid, s, n, item_id FROM places JOIN win USING (win)),
spots AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT rid, s, n FROM hits)) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (rid) LEFT JOIN named USING (rid)"""


def accept(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", max_broadcast: int = 2_000_000) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of any item.

    Null texts have no words and stay; repeated rows stay or go together; with no items all rows stay. The list of the others
    is broadcast up to ``max_broadcast`` rows and joined by shuffle beyond.
    """
    hit = materialize(matches(docs, items, key, text).where(F.size("spans") > 0).select(F.col("key").alias("hit_key"), F.col("mark").alias("hit_mark")), "hit")
    hit = F.broadcast(hit) if hit.count() <= max_broadcast else hit
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("key"), F.xxhash64(text).alias("mark"))
    return rows.join(hit, F.col("key").eqNullSafe(F.col("hit_key")) & (F.col("mark") == F.col("hit_mark")), "left_anti").select("row.*")
