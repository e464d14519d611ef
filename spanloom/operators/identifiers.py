"""Fourteen kinds of identifiers: a table function that finds them, and Column arithmetic that scores them.

Finding needs positions and look-around, so texts pass through one Arrow function that yields raw hits with their label
context; check digits, confidence, disposition and reason are Columns over the hits. Confidence is in whole hundredths: sums
that land on a threshold compare exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import checksums
from spanloom.functions.text import LETTERS, LOWER, UPPER
from spanloom.operators.places import addresses, plots
from spanloom.operators.spans import resolve_overlaps

AUTO = 80
#: Base confidence in hundredths and display name of each kind.
BASE = {
    "ado_azonosito_jel": 55, "taj": 55, "adoszam": 55, "cegjegyzekszam": 60, "bankszamlaszam": 55, "iban": 60, "helyrajzi_szam": 60,
    "iranyitoszam": 35, "telefonszam": 75, "szemelyazonosito_igazolvany": 55, "birosagi_ugyszam": 80, "email": 85, "rendszam": 55, "cim": 70,
}
NAMES = {
    "ado_azonosito_jel": "adóazonosító jel", "taj": "TAJ-szám", "adoszam": "adószám", "cegjegyzekszam": "cégjegyzékszám", "bankszamlaszam": "bankszámlaszám",
    "iban": "IBAN", "helyrajzi_szam": "helyrajzi szám", "iranyitoszam": "irányítószám", "telefonszam": "telefonszám",
    "szemelyazonosito_igazolvany": "személyazonosító igazolvány", "birosagi_ugyszam": "bírósági ügyszám", "email": "e-mail-cím", "rendszam": "rendszám", "cim": "lakcím",
}
LABEL, VALID, INVALID, BAD_STRUCTURE = 25, 20, -15, -15
PLACES = ("helyrajzi_szam", "cim", "iranyitoszam")
#: Words that name a kind near its number, as expressions.
LABEL_WORDS = {
    "ado_azonosito_jel": r"adó ?azonosító\w*( jel\w*)?",
    "taj": r"TAJ|T\.A\.J\.|társadalombiztosítási\w*",
    "adoszam": r"adószám\w*",
    "cegjegyzekszam": r"cégjegyzék\w*",
    "bankszamlaszam": r"bankszámla\w*|bankszámlá\w*|pénzforgalmi jelzőszám\w*|számlaszám\w*|számlászám\w*",
    "iban": r"IBAN",
    "telefonszam": r"telefonszám\w*|telefon|mobilszám\w*|mobil|tel\.",
    "szemelyazonosito_igazolvany": r"személyazonosító igazolvány\w*|személyi igazolvány\w*|szig\.",
    "birosagi_ugyszam": r"ügy ?szám\w*",
    "email": r"e-?mail\w*|villámposta\w*",
    "rendszam": r"forgalmi rendszám\w*|rendszám\w*|frsz\.",
    "cim": r"lakcím\w*|lakóhely\w*|székhely\w*|tartózkodási hely\w*|telephely\w*|cím\w*",
}
#: Formats that a number must have whole.
FORMATS = {
    "ado_azonosito_jel": r"8[0-9]{9}",
    "taj": r"(?<![0-9][ \-])[0-9]{3}[ \-]?[0-9]{3}[ \-]?[0-9]{3}",
    "adoszam": r"[0-9]{8}-[1-5]-[0-9]{2}",
    "cegjegyzekszam": r"[0-9]{2}-[0-9]{2}-[0-9]{6}",
    "bankszamlaszam": r"[0-9]{8}-[0-9]{8}(-[0-9]{8})?",
    "iban": r"HU[0-9]{2}([ \xa0]?[0-9]{4}){6}",
    "szemelyazonosito_igazolvany": f"[0-9]{{6}} ?[{UPPER}]{{2}}|[{UPPER}]{{2}}[0-9]{{6}}",
    "birosagi_ugyszam": f"([0-9]{{1,3}}\\.)?[{UPPER}][{LOWER}]{{0,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,4}}/[0-9]{{4}}(/[0-9]{{1,3}})?",
    "rendszam": r"[A-Z]{3,4}-[0-9]{3}|[A-Z]{2}-[A-Z]{2}-[0-9]{3}",
}


@cache
def patterns() -> list[tuple[str, re.Pattern]]:
    """Kind and format, with no letter or digit beside it."""
    return [(kind, re.compile(f"(?<![{LETTERS}0-9])(?:{p})(?![{LETTERS}0-9])")) for kind, p in FORMATS.items()]


_DIALLED = re.compile(f"(?<![{LETTERS}0-9+])(?:\\+36|06)")
_SUBSCRIBER = ((3, 2, 2), (3, 3))


def phones(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of phone numbers: the country's or the trunk's prefix, an area of one or two digits that may stand in
    brackets, and a subscriber's digits in groups, with at most one blank, hyphen or stroke between."""

    def groups(at: int, sizes: tuple[int, ...]) -> int | None:
        for size in sizes:
            at += text[at : at + 1] in tuple(" -/")
            part = text[at : at + size]
            if len(part) < size or not (part.isascii() and part.isdigit()):
                return None
            at += size
        return at

    for m in _DIALLED.finditer(text):
        at = m.end() + (text[m.end() : m.end() + 1] in tuple(" -/"))
        at += text.startswith("(", at)
        at = groups(at, (1 if text.startswith("1", at) else 2,)) if text[at : at + 1] in tuple("123456789") else None
        if at is not None:
            at += text.startswith(")", at)
            ends = (groups(at, sizes) for sizes in _SUBSCRIBER)
            end = next((e for e in ends if e and not re.match(f"[{LETTERS}0-9]", text[e : e + 1])), None)
            if end:
                yield m.start(), end


@cache
def labels() -> dict[str, re.Pattern]:
    """What may stand near a number to name its kind; its words may be further apart than one blank."""
    blanks = lambda ways: re.sub(r" (\??)", lambda m: r"[ \t]*" if m[1] else r"[ \t]+", ways)
    return {k: re.compile(f"(?<![{LETTERS}])(?:{blanks(ways)})(?![{LETTERS}])", re.I) for k, ways in LABEL_WORDS.items()}


#: Characters looked at for a label before and, for kinds that may be named afterwards, behind.
BEFORE, BEHIND, NAMED_BEHIND = 40, 80, {"bankszamlaszam", "adoszam", "cegjegyzekszam", "rendszam"}
TOKEN = re.compile(r"[A-Za-z0-9._%+\-ÁÉÍÓÖŐÚÜŰáéíóöőúüű]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}|(?:https?://|www\.)[^\s,;)]+")
#: The same for the engine's own regular expressions, where only the token's text is wanted.
TOKEN_SQL = r"[A-Za-z0-9._%+\-ÁÉÍÓÖŐÚÜŰáéíóöőúüű]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}|(?:https?://|www\.)[^\s,;)]+"


def tokens(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, text, kind) of e-mail addresses and urls."""
    return [(m.start(), m.end(), m[0], "email" if "@" in m[0] else "url") for m in TOKEN.finditer(text)]


def near_label(text: str, kind: str, start: int, end: int) -> str | None:
    if kind == "helyrajzi_szam":
        return "hrsz."
    if (named := labels().get(kind)) is None:
        return None
    found = named.search(text[max(0, start - BEFORE) : start])
    if found is None and kind in NAMED_BEHIND:
        found = named.search(text[end : end + BEHIND])
    return found and found[0]


def raw_hits(text: str) -> list[tuple[int, int, str, str, str | None]]:
    """(start, end, text, kind, label), each span of a kind once."""
    spans = {(kind, m.start(), m.end()) for kind, p in patterns() for m in p.finditer(text)}
    spans |= {("email", a, b) for a, b, _, kind in tokens(text) if kind == "email"}
    spans |= {("telefonszam", a, b) for a, b in phones(text)} | {("helyrajzi_szam", a, b) for a, b in plots(text)}
    spans |= {(kind, a, b) for a, b, kind in addresses(text)}
    return [(a, b, text[a:b], kind, near_label(text, kind, a, b)) for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0]))]


def scan(units: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(*by, start, end, surface, kind, label): raw hits of each unit; null texts have none."""
    kinds = [(c, units.schema[c].dataType.simpleString()) for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for i, value in enumerate(batch.column(len(by)).to_pylist()):
                found = raw_hits(value or "")
                rows += found
                at += [i] * len(found)
            picked = [c.take(pa.array(at, pa.int64())) for c in batch.columns[: len(by)]]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([*picked, *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True))], names=[*by, "start", "end", "surface", "kind", "label"])

    schema = ", ".join([*(f"`{c}` {k}" for c, k in kinds), "start int, end int, surface string, kind string, label string"])
    return units.select(*by, F.col(text)).mapInArrow(run, schema)


def checksum(kind: Column, surface: Column) -> Column:
    """``valid``, ``invalid`` or ``not_applicable``."""
    digits = F.regexp_replace(surface, "[^0-9]", "")
    ok = (
        F.when(kind == "ado_azonosito_jel", checksums.tax_id_ok(surface))
        .when(kind == "taj", checksums.social_ok(digits))
        .when(kind == "adoszam", checksums.block_ok(F.substring(surface, 1, 8)))
        .when(kind == "bankszamlaszam", checksums.blocks_ok(surface))
        .when(kind == "iban", checksums.iban_ok(surface))
    )
    return F.when(ok.isNull(), "not_applicable").when(ok, "valid").otherwise("invalid")


def structure_ok(kind: Column, surface: Column) -> Column:
    """County codes in their range: 1 to 51 in tax numbers, 1 to 20 in company numbers."""
    county = F.when(kind == "adoszam", F.substring(surface, 12, 2).cast("int")).when(kind == "cegjegyzekszam", F.substring(surface, 1, 2).cast("int"))
    return F.coalesce((county >= 1) & (county <= F.when(kind == "adoszam", 51).otherwise(20)), F.lit(True))


def base_confidence(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, value in BASE.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def score(hits: DataFrame) -> DataFrame:
    """Hits with checksum, confidence (hundredths), disposition and reason."""
    kind, surface = F.col("kind"), F.col("surface")
    checked = hits.withColumns({"checksum": checksum(kind, surface), "structure_ok": structure_ok(kind, surface)})
    total = (
        base_confidence(kind)
        + F.when(F.col("label").isNotNull(), LABEL).otherwise(0)
        + F.when(F.col("checksum") == "valid", VALID).when(F.col("checksum") == "invalid", INVALID).otherwise(0)
        + F.when(F.col("structure_ok"), 0).otherwise(BAD_STRUCTURE)
    )
    shown = F.lit(None).cast("string")
    for name, value in NAMES.items():
        shown = F.when(kind == name, value).otherwise(shown)
    parts = F.array(
        F.concat(shown, F.lit(" mintája illeszkedik")),
        F.when(F.col("label").isNotNull(), F.concat(F.lit("címke a szövegben: „"), "label", F.lit("”"))),
        F.when(F.col("checksum") == "valid", "az ellenőrzőszám érvényes").when(F.col("checksum") == "invalid", "az ellenőrzőszám hibás"),
        F.when(~F.col("structure_ok"), "a megyekód a szokásos tartományon kívül esik"),
    )
    scored = checked.withColumn("confidence", F.least(F.lit(100), F.greatest(F.lit(0), total)))
    return scored.withColumns({"disposition": F.when(F.col("confidence") >= AUTO, "auto").otherwise("review"), "reason": F.array_join(F.filter(parts, lambda p: p.isNotNull()), "; ")})


def find(units: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """All scored hits, overlapping ones too."""
    return score(scan(units, by, text))


def resolved(units: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    return resolve_overlaps(find(units, by, text), by)


def rollup(spans: DataFrame, by: list[str]) -> DataFrame:
    """(*by, kind, key, surface, confidence, occurrences): one row for each identifier of a document, with its most confident (then first) hit."""
    key = F.lower(F.trim(F.regexp_replace("surface", r"\s+", " ")))
    best = F.struct(F.col("confidence").alias("c"), (-F.col("start")).alias("s"))
    return spans.groupBy(*by, "kind", key.alias("key")).agg(F.max_by("surface", best).alias("surface"), F.max("confidence").alias("confidence"), F.count("*").alias("occurrences"))


def guess_kind(spans: DataFrame, by: list[str]) -> DataFrame:
    """The kind of each text's longest hit, the first of equals."""
    return spans.groupBy(*by).agg(F.max_by("kind", F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("kind"))


def coverage_priority(kind: Column) -> Column:
    """Identifiers that hold place names claim their text first."""
    return F.when(kind.isin(*PLACES), 0).otherwise(1)


def as_entities(spans: DataFrame) -> DataFrame:
    """Spans in the shape of model output."""
    return spans.withColumns({"label": F.when(F.col("kind").isin(*PLACES), "place").otherwise("other"), "raw_label": F.concat(F.lit("AZONOSITO:"), "kind"), "score": F.col("confidence") / 100})
