"""The leak gate: what of the originals is left in an output, and what looks as if it might be.

Targeted: known originals (names in any form, numbers whatever their grouping) make a leak, and a leak closes the gate.
Sweep: capitalised words inside sentences and number-shaped identifiers that nothing accounts for are residual.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.hungarian import paradigm
from spanloom.functions.text import LETTERS, LOWER, UPPER
from spanloom.operators.names import Entity, Matcher

#: Number shapes with their labels, abbreviations that end no sentence, words that are capitalised by rule.
SHAPES = (
    ("IBAN", r"HU\d{2}(?:[ \xa0]?\d{4}){6}"), ("bankszámlaszám", r"\d{8}-\d{8}(?:-\d{8})?"), ("adószám", r"\d{8}-[1-5]-\d{2}"),
    ("cégjegyzékszám", r"\d{2}-\d{2}-\d{6}"), ("adóazonosító jel", r"8\d{9}"), ("TAJ-szám", r"\d{3}[ -]\d{3}[ -]\d{3}|\d{9}"),
)
ABBREVIATIONS = {"dr", "ifj", "id", "özv", "stb", "ill", "pl", "prof"}
SAFE = {
    "törvényszék", "járásbíróság", "ítélőtábla", "kúria", "alkotmánybíróság", "ügyészség", "bíróság", "magyarország", "magyar", "budapest", "ptk", "pp", "btk", "be", "ft", "kft", "zrt", "nyrt", "bt", "kkt",
    "január", "február", "március", "április", "május", "június", "július", "augusztus", "szeptember", "október", "november", "december",
}
LIMIT, MONEY = 40, re.compile(r"[ \xa0]*(?:Ft|forint|HUF|EUR|euró|USD)")
_CAPITAL = re.compile(f"(?<![{LETTERS}0-9])[{UPPER}][{LETTERS}]*(?:-[{LETTERS}]+)*")
_LABEL = re.compile(r"\[[^\]\n]{1,40}\](?:-[a-záéíóöőúüű]+)?")


def _spread(digits: str) -> re.Pattern:
    """A known number, whatever stands between its characters."""
    return re.compile(r"(?<!\d)" + r"[ \xa0.\-/]*".join(map(re.escape, re.sub("[^0-9A-Za-z]", "", digits))) + r"(?!\d)")


def _forms(names: Iterable[str]) -> set[str]:
    """Each word of the names, and each word's case forms, in lower case."""
    words = {w for n in names for w in re.findall(f"[{LETTERS}]+", n)}
    return {f.lower() for w in words for f in (w, *paradigm(w).values())}


@cache
def _safe_forms() -> frozenset[str]:
    """``SAFE`` and its case forms: the same for every text."""
    return frozenset(SAFE | {f.lower() for w in SAFE for f in paradigm(w).values()})


@cache
def _shapes() -> tuple[tuple[str, re.Pattern], ...]:
    return tuple((label, re.compile(rf"(?<![\d\-])(?:{p})(?![\d\-]*\d)")) for label, p in SHAPES)


def numbers(text: str, patterns: Iterable[tuple[str, re.Pattern | str]] = (), builtin: bool = True) -> list[tuple[int, int, str, str]]:
    """(start, end, surface, label) of number-shaped identifiers, the first shape first, none inside a longer run of digits; amounts are none."""
    found: list[tuple[int, int, str, str]] = []
    own = [(label, re.compile(p) if isinstance(p, str) else p) for label, p in patterns]
    shapes = [*own, *(_shapes() if builtin else ())]
    for label, p in shapes:
        for m in p.finditer(text):
            if m.end() > m.start() and not MONEY.match(text, m.end()) and all(m.end() <= a or b <= m.start() for a, b, _, _ in found):
                found.append((m.start(), m.end(), m[0], label))
    return sorted(found)


def sentence_start(text: str, at: int) -> bool:
    before = text[:at].rstrip(" \t\xa0")
    if not before or before[-1] in "\n!?:":
        return True
    if before[-1] != ".":
        return False
    word = re.search(f"([{LETTERS}]+)\\.$", before)
    return not (word and word[1].lower() in ABBREVIATIONS)


def verify(text: str, entities: list[Entity], pseudonyms: Iterable[str] = (), keep: Iterable[str] = (), safe: Iterable[str] = (), literals: Iterable[str] = (), keep_numbers: Iterable[str] = (), patterns: Iterable = (), builtin: bool = True, limit: int = LIMIT) -> dict:
    """``ok``, ``leaks`` and ``residual`` as (surface, label, start), and ``residual_total`` before the limit; numbers come first in the list."""
    leaks = [(h["surface"], "name", h["start"]) for h in Matcher(entities).find(text)] if entities else []
    taken = [(m.start(), m.end()) for lit in literals if re.sub("[^0-9A-Za-z]", "", lit) for m in _spread(lit).finditer(text)]
    leaks += [(text[a:b], "number", a) for a, b in taken]
    kept = {re.sub("[^0-9A-Za-z]", "", k) for k in keep_numbers}
    open_numbers = [(s, label, a) for a, b, s, label in numbers(text, patterns, builtin) if re.sub("[^0-9A-Za-z]", "", s) not in kept and all(b <= x or y <= a for x, y in taken)]
    known, ruled = _forms([*pseudonyms, *keep, *safe]) | {s.lower() for s in safe}, _safe_forms()
    blank = _LABEL.sub(lambda m: " " * len(m[0]), text)
    names = {(a, s) for s, _, a in leaks}
    words = [(m[0], "", m.start()) for m in _CAPITAL.finditer(blank) if len(m[0]) > 1 and m[0] != m[0].upper() and m[0].lower() not in known and m[0].lower() not in ruled and not sentence_start(blank, m.start()) and not any(a <= m.start() < a + len(s) for a, s in names)]
    residual = [*open_numbers, *words]
    return {"ok": not leaks, "leaks": leaks, "residual": residual[:limit], "residual_total": len(residual)}


REPORT = "ok boolean, leaks array<string>, residual array<string>, residual_total int"


def report(outputs: DataFrame, by: list[str], text: str = "text", pseudonyms: str | None = None, literals: str | None = None, entities: str | None = None) -> DataFrame:
    """(*by, REPORT) for each output; the named array columns hold its pseudonyms, original numbers and entities."""
    kinds = [(c, outputs.schema[c].dataType.simpleString()) for c in by]
    extra = [c for c in (pseudonyms, literals, entities)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                *keys, value, names, known, people = row
                found = verify(value or "", [Entity(**{k: v or "" for k, v in p.items()}) for p in (people if people is not None else ())], names if names is not None else (), literals=known if known is not None else ())
                rows.append((*keys, found["ok"], [x[0] for x in found["leaks"]], [x[0] for x in found["residual"]], found["residual_total"]))
            yield pd.DataFrame(rows, columns=[*by, "ok", "leaks", "residual", "residual_total"])

    picked = outputs.select(*by, F.col(text).alias("_text"), *(F.col(c).alias(f"_x{i}") if c else F.lit(None).cast("array<string>").alias(f"_x{i}") for i, c in enumerate(extra)))
    return picked.mapInPandas(run, ", ".join([*(f"`{c}` {k}" for c, k in kinds), REPORT]))


def gate(outputs: DataFrame, reports: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantined): only outputs without a leak may be written."""
    joined = outputs.join(reports.select(*by, "ok"), by)
    return joined.where("ok").drop("ok"), joined.where("NOT ok").drop("ok")


def count_leaks(outputs: DataFrame, literals: DataFrame, by: list[str], text: str = "text", key: str = "literal") -> DataFrame:
    """(*by, literal, found): how often each known original of six characters or more is left in its document; a join on the document.

    Grouping is aside: any blanks, dots, dashes or slashes may stand between its characters. What is part of a longer number
    or word is none.
    """
    sign = "[ \\xa0.\\-/]"
    wanted = literals.select(*by, F.col(key), F.regexp_replace(F.lower(key), sign, "").alias("_k")).where(F.length("_k") >= 6)
    spelled = F.transform(F.split("_k", ""), lambda c: F.regexp_replace(c, r"([^\p{L}\p{N}])", r"\\$1"))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])"), F.array_join(spelled, f"{sign}*"), F.lit(r"(?![\p{L}\p{N}])"))
    joined = outputs.select(*by, F.lower(text).alias("_t")).join(wanted.withColumn("_p", pattern), by)
    return joined.select(*by, F.col(key), F.regexp_count("_t", F.col("_p")).cast("long").alias("found")).where("found > 0")


def within_budget(leaks: DataFrame, kept: DataFrame, by: list[str]) -> DataFrame:
    """Leaks beyond what a reviewer kept, occurrence by occurrence."""
    return leaks.join(kept.withColumnRenamed("n", "_kept"), by, "left").withColumn("excess", F.col("found") - F.coalesce("_kept", F.lit(0))).where("excess > 0").drop("_kept")
