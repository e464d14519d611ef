"""Span-set algebra: folds over a document's spans, islands of neighbouring spans, splicing, placing.

Spans are rows with ``start`` and ``end`` (half-open, code points). A document's spans are folded in one sorted array, so the
only shuffle is the one that brings them together, and a document's spans are bounded by its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy(ranked: Column) -> Column:
    """Of spans in order of rank, those that overlap none kept before: a span beaten by a dropped one survives."""
    empty = F.slice(ranked, 1, 0)
    clear = lambda kept, s: ~F.exists(kept, lambda k: (s["start"] < k["end"]) & (k["start"] < s["end"]))
    return F.aggregate(ranked, empty, lambda kept, s: F.when(clear(kept, s), F.concat(kept, F.array(s))).otherwise(kept))


def _fold(spans: DataFrame, by: list[str], rank: list[Column]) -> DataFrame:
    rest = [c for c in spans.columns if c not in by]
    keys = [r.alias(f"_r{i}") for i, r in enumerate(rank)]
    packed = F.struct(*keys, *(F.col(c) for c in rest))
    kept = spans.groupBy(*by).agg(greedy(F.array_sort(F.collect_list(packed))).alias("_kept"))
    return kept.select(*by, F.explode("_kept").alias("_s")).select(*by, *(F.col(f"_s.{c}").alias(c) for c in rest))


def resolve_overlaps(spans: DataFrame, by: list[str], confidence: str | None = "confidence") -> DataFrame:
    """Longest first, then most confident (if given), then leftmost; the rest of a span's columns break ties."""
    rank = [F.col("start") - F.col("end"), *([-F.col(confidence)] if confidence else []), F.col("start")]
    return _fold(spans, by, rank)


def claim_coverage(spans: DataFrame, by: list[str], priority: str = "priority") -> DataFrame:
    """Text goes to the first claimant: by class, then start, then the longer span; numbered in text order from 1."""
    kept = _fold(spans, by, [F.col(priority), F.col("start"), -F.col("end")])
    return kept.withColumn("no", F.row_number().over(Window.partitionBy(*by).orderBy("start", "end")))


def merge_adjacent(spans: DataFrame, by: list[str], label: str = "label", score: str = "score", gap: int = 1) -> DataFrame:
    """Neighbours of one label with at most ``gap`` characters between them become one span with their lowest score."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    joined = (F.lag(label).over(order) == F.col(label)) & (F.col("start") - F.lag("end").over(order) <= gap)
    island = F.sum(F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("_island", island).groupBy(*by, "_island").agg(F.first(label).alias(label), F.min("start").alias("start"), F.max("end").alias("end"), F.min(score).alias(score)).drop("_island")


def dedupe_windows(spans: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """The best-scored of equal spans, without those inside a longer one of the same label."""
    best = spans.groupBy(*by, "start", "end").agg(F.max_by(label, score).alias(label), F.max(score).alias(score))
    # A span is inside another just if an earlier-starting or equally starting longer one reaches its end.
    order = Window.partitionBy(*by, label).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("_reach", F.max("end").over(order)).where(F.col("_reach").isNull() | (F.col("_reach") < F.col("end"))).drop("_reach")


def splice(text: Column, edits: Column) -> Column:
    """Text with its edits (array of start, end, replacement) put in, left to right; an edit that overlaps the one before is left out."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, e: Column) -> Column:
        piece = F.concat(a["out"], F.substring(text, a["at"] + 1, e["start"] - a["at"]), e["replacement"])
        return F.when(e["start"] < a["at"], a).otherwise(F.struct(piece.alias("out"), e["end"].cast("int").alias("at")))

    return F.aggregate(F.array_sort(edits), zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def apply_edits(units: DataFrame, edits: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Units with ``text`` edited; units without edits pass unchanged."""
    packed = edits.groupBy(*by).agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "replacement")).alias("_edits"))
    joined = units.join(packed, by, "left")
    return joined.withColumn(text, F.when(F.col("_edits").isNull(), F.col(text)).otherwise(splice(F.col(text), F.col("_edits")))).drop("_edits")


def first_container(edits: DataFrame, spans: DataFrame, by: list[str], span_id: str = "span_id") -> DataFrame:
    """Each edit with the first source span that contains it (null if none): an edit meets its document's spans as one array, so no
    row is made for a pair of an edit and a span."""
    inside = spans.groupBy(*by).agg(F.collect_list(F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col(span_id).alias("id"))).alias("_spans"))
    first = F.array_min(F.filter("_spans", lambda x: (x["s"] <= F.col("start")) & (F.col("end") <= x["e"])))
    return edits.join(inside, by, "left").select(*edits.columns, first["id"].alias(span_id))


def unit_offsets(units: DataFrame, doc: str, no: str, text: str = "text") -> DataFrame:
    """Where each unit starts in the document's text, units being joined by an empty line."""
    before = Window.partitionBy(doc).orderBy(no).rowsBetween(Window.unboundedPreceding, -1)
    return units.withColumn("offset", F.coalesce(F.sum(F.length(F.coalesce(text, F.lit(""))) + 2).over(before), F.lit(0)).cast("long"))


def full_text(units: DataFrame, doc: str, no: str, text: str = "text") -> DataFrame:
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(no).alias("no"), F.coalesce(text, F.lit("")).alias("t")))), lambda u: u["t"]), "\n\n")
    return units.groupBy(doc).agg(whole.alias("text"))


def discourse_boost(hits: DataFrame, by: list[str], entity: str = "entity_id", threshold: int = 80, boost: int = 35) -> DataFrame:
    """A short form after its entity was introduced by a strong full form gains confidence (in hundredths).

    ``introduces`` and ``shorthand`` tell the kinds of form; ambiguous hits gain nothing.
    """
    before = Window.partitionBy(*by, entity).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = F.coalesce(F.max(F.when(F.col("introduces") & (F.col("confidence") >= threshold), 1)).over(before), F.lit(0)) == 1
    gains = F.col("shorthand") & known & ~F.col("ambiguous")
    return hits.withColumns({"boosted": gains & (F.col("confidence") < 100), "confidence": F.when(gains, F.least(F.lit(100), F.col("confidence") + boost)).otherwise(F.col("confidence"))})
