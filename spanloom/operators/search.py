"""Search texts: words that a line's end breaks are made whole, and what is found in them has its places in the original.

All of it is Columns. A search text travels with its shifts, one for each break: from which place on how many characters have
been left out, so a map is as long as a text has breaks and not as long as the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import LETTERS

#: A hyphen or a soft hyphen at a line's end, with the blanks around the line's end.
LINE_END = r"[-­][ \t]*\r?\n[ \t]*"


def search_text(text: Column) -> Column:
    """struct<text, shifts array<struct<at int, by int>>>: null for null. A shift holds for places from ``at`` on."""
    pieces = F.transform(F.split(text, LINE_END, -1), lambda p: F.length(p))
    breaks = F.transform(F.regexp_extract_all(text, F.lit(LINE_END), F.lit(0)), lambda b: F.length(b))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("by"), F.array().cast("array<struct<at:int,by:int>>").alias("shifts"))

    def add(so_far: Column, pair: Column) -> Column:
        at, by = so_far["at"] + pair["piece"], so_far["by"] + pair["left_out"]
        return F.struct(at.alias("at"), by.alias("by"), F.concat(so_far["shifts"], F.array(F.struct(at.alias("at"), by.alias("by")))).alias("shifts"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(breaks)), breaks, lambda p, b: F.struct(p.alias("piece"), b.alias("left_out")))
    shifts = F.aggregate(pairs, start, add, lambda s: s["shifts"])
    return F.when(text.isNotNull(), F.struct(F.regexp_replace(text, LINE_END, "").alias("text"), shifts.alias("shifts")))


def original(place: Column, shifts: Column, end: bool = False) -> Column:
    """A place of the search text in the original. An end lies before a break that stands there, a start behind it."""
    passed = F.filter(shifts, lambda s: (s["at"] < place) if end else (s["at"] <= place))
    return place + F.coalesce(F.array_max(F.transform(passed, lambda s: s["by"])), F.lit(0))


def occurrences(units: DataFrame, needles: DataFrame, by: str, text: str = "text", needle: str = "needle") -> DataFrame:
    """(by, needle, start, end, surface): each place of each needle of a unit (needles has the unit's key), places and surfaces
    as in the original. No letter or digit may stand before, no letter behind. A null or empty needle or text has none; needles
    that are named twice are looked for once."""
    sought = needles.where(F.length(needle) > 0).select(by, F.col(needle).alias("needle")).distinct()
    made = units.select(by, F.col(text).alias("_text"), search_text(F.col(text)).alias("_search")).join(sought, by)
    quoted = F.concat(F.lit(f"(?<![{LETTERS}0-9])\\Q"), F.replace(F.col("needle"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(f"\\E(?![{LETTERS}])"))
    between = F.transform(F.split(F.col("_search.text"), quoted, -1), lambda p: F.length(p))
    # The k-th piece ends where the k-th hit begins.
    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("places"))
    step = lambda a, n: F.struct((a["at"] + n + F.length("needle")).alias("at"), F.concat(a["places"], F.array(a["at"] + n)).alias("places"))
    ends = F.aggregate(F.slice(between, 1, F.size(between) - 1), begun, step, lambda a: a["places"])
    hits = made.where(F.contains("_search.text", F.col("needle"))).select(by, "needle", "_text", "_search", F.explode(ends).alias("_at"))
    shifts = F.col("_search.shifts")
    placed = hits.select(by, "needle", "_text", original(F.col("_at"), shifts).alias("start"), original(F.col("_at") + F.length("needle"), shifts, end=True).alias("end"))
    return placed.select(by, "needle", "start", "end", F.substring(F.col("_text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("surface"))
