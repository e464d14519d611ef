"""Dates: eight recognizers, years taken over from neighbours, days set by an earlier month, and a uniform shift."""

from __future__ import annotations

import datetime as dt
import re
from calendar import monthrange
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.hungarian import CASES, inflect, number_words
from spanloom.functions.text import LETTERS, LOWER
from spanloom.operators.amounts import ENDING_CASE

#: Names of months and ordinals of days.
MONTHS = ("január", "február", "március", "április", "május", "június", "július", "augusztus", "szeptember", "október", "november", "december")
SHORT = (("jan",), ("febr", "feb"), ("márc", "marc"), ("ápr", "apr"), ("máj", "maj"), ("jún", "jun"), ("júl", "jul"), ("aug",), ("szept", "szep"), ("okt",), ("nov",), ("dec",))
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")
POSSESSED = ("januárja", "februárja", "márciusa", "áprilisa", "májusa", "júniusa", "júliusa", "augusztusa", "szeptembere", "októbere", "novembere", "decembere")
DAYS = (
    "elseje", "másodika", "harmadika", "negyedike", "ötödike", "hatodika", "hetedike", "nyolcadika", "kilencedike", "tizedike", "tizenegyedike",
    "tizenkettedike", "tizenharmadika", "tizennegyedike", "tizenötödike", "tizenhatodika", "tizenhetedike", "tizennyolcadika", "tizenkilencedike",
    "huszadika", "huszonegyedike", "huszonkettedike", "huszonharmadika", "huszonnegyedike", "huszonötödike", "huszonhatodika", "huszonhetedike",
    "huszonnyolcadika", "huszonkilencedike", "harmincadika", "harmincegyedike",
)
YEAR_CASES = {"INE", "ILL", "ELA", "SUB", "DEL", "ADE", "ALL", "ABL", "TER", "DAT", "CAU"}
CONFIDENCE = {"teljes_datum": 92, "honap_ev": 82, "nap": 55, "ev": 50}
NO_SUCH_DAY, UNKNOWN_ENDING, NO_YEAR, AUTO = 20, 20, 10, 80
REACH, MONTH_ANCHOR, YEAR_ANCHOR = 60, 15, (7, 1)


def day_ending(surface: str) -> tuple[str, str | None, bool] | None:
    """(kind, case, linked) of what follows a day's hyphen: plain, derived (-i) or a case, perhaps with its linking vowel."""
    t = surface.lower().removeprefix("j")
    if t in ("i", "ei"):
        return "derived", None, t == "ei"
    if t in ("a", "e"):
        return "plain", None, True
    linked = t[:1] in ("á", "é")
    case = ENDING_CASE.get(t[1:] if linked else t)
    return ("case", case, linked) if case else None


def write_day_ending(day: int, ending: tuple[str, str | None, bool]) -> str:
    kind, case, linked = ending
    name, j = DAYS[day - 1], "j" if day == 1 else ""
    if kind == "plain":
        return f"-{j}{name[-1]}"
    if kind == "derived":
        return "-jei" if day == 1 else "-i"
    if case == "TER" and not linked and day != 1:
        return "-ig"
    return f"-{j}{inflect(name, case)[len(name) - 1 :]}"


def write_year_ending(year: int, case: str) -> str:
    said = number_words(year)
    return inflect(said, case)[len(said) :] if case in YEAR_CASES else ""


def possessed_case(month: int, surface: str) -> str | None:
    base = POSSESSED[month - 1]
    return next((c for c in CASES if c != "WIFE" and inflect(base, c).lower() == surface.lower()), None)


def month_of(surface: str) -> tuple[int, str] | None:
    """(month, style) of a name, a short name or a Roman number."""
    s = surface.lower().removesuffix(".")
    for style, names in (("nev", [(m,) for m in MONTHS]), ("rovid", SHORT), ("romai", [(r.lower(),) for r in ROMAN])):
        for i, spellings in enumerate(names):
            if s in spellings:
                return i + 1, style
    return None


@cache
def patterns() -> list[tuple[str, re.Pattern]]:
    free, ends, blank = f"(?<![{LETTERS}0-9])", f"(?![{LETTERS}])", "[ \\t\xa0]"
    longest = lambda words: "|".join(sorted(words, key=len, reverse=True))
    month = longest([*MONTHS, *(f"{s}\\." for v in SHORT for s in v)])
    year, day, number = "(?P<y>19[0-9]{2}|20[0-9]{2})", "(?P<d>0?[1-9]|[12][0-9]|3[01])(?![0-9])", "(?P<m>0?[1-9]|1[0-2])"
    closed, no_law = f"(?:(?P<dot>\\.)|-(?P<end>[{LOWER}]{{1,6}}))?", f"(?!{blank}*évi{ends})"
    when = "óta|nyarán|telén|tavaszán|őszén|folyamán|során|végén|elején|közepén|karácsonyán|évben|évtől|évig"
    cases = "ban|ben|tól|től|ig|ra|re|hoz|hez|ból|ből|ról|ről|nál|nél|nak|nek"
    shapes = [
        ("full", f"{free}{year}(?P<a>\\.?{no_law}{blank}*)(?P<m>{month})(?P<b>{blank}+){day}{closed}{ends}", re.I),
        ("digits", f"{free}{year}(?P<a>\\.{blank}*|-){number}(?P<b>\\.{blank}*|-){day}(?P<dot>\\.)?{ends}", 0),
        ("roman", f"{free}{year}(?P<a>\\.{blank}*)(?P<m>{longest(ROMAN)})(?P<b>\\.{blank}*){day}{closed}{ends}", 0),
        ("day", f"{free}(?P<m>{month})(?P<b>{blank}+){day}{closed}{ends}", re.I),
        ("month", f"{free}{year}(?P<a>\\.?{no_law}{blank}*)(?P<m>{month}){ends}", re.I),
        ("possessed", f"{free}(?:{year}(?P<a>{blank}+))?(?P<m>(?:{longest(p[:-1] for p in POSSESSED)})[aáeé][{LOWER}]*){ends}", 0),
        ("year", f"{free}{year}(?P<dot>\\.)?{no_law}(?={blank}+(?:{when}){ends}|-(?:{cases}){ends})(?:-(?P<end>[{LOWER}]{{1,4}}))?", 0),
    ]
    return [(name, re.compile(p, flags)) for name, p, flags in shapes]


_LONE_DAY = re.compile(f"(?<![{LETTERS}0-9])(0?[1-9]|[12][0-9]|3[01])-([{LOWER}]{{1,6}})(?![{LETTERS}])")


def _disjoint(hits: list[dict]) -> list[dict]:
    kept: list[dict] = []
    for h in sorted(hits, key=lambda h: (h["start"] - h["end"], h["start"])):
        if all(h["end"] <= k["start"] or k["end"] <= h["start"] for k in kept):
            kept.append(h)
    return sorted(kept, key=lambda h: h["start"])


def _read(name: str, m: re.Match) -> dict | None:
    g = m.groupdict()
    h = {"start": m.start(), "end": m.end(), "surface": m[0], "year": int(g["y"]) if g.get("y") else None, "month": None, "day": int(g["d"]) if g.get("d") else None, "has_year": bool(g.get("y")), "after_year": g.get("a") or "", "after_month": g.get("b") or "", "style": "nincs", "padded_month": False, "padded_day": (g.get("d") or "").startswith("0"), "dot": bool(g.get("dot")), "ending": None, "case": None, "unknown": False, "inherited": False}
    if name in ("full", "month") and not h["after_year"]:
        return None
    if name == "digits":
        h |= {"month": int(g["m"]), "style": "szam", "padded_month": g["m"].startswith("0")}
    elif name == "possessed":
        month = next(i for i, p in enumerate(POSSESSED, 1) if g["m"].startswith(p[:-1]))
        case = possessed_case(month, g["m"])
        h |= {"month": month, "style": "birtokos", "case": case, "unknown": case is None}
    elif name != "year":
        h["month"], h["style"] = month_of(g["m"])
    if g.get("end"):
        if name == "year":
            h["case"] = ENDING_CASE.get(g["end"].lower())
            if h["case"] not in YEAR_CASES:
                return None
        elif (e := day_ending(g["end"])) is None:
            return None
        else:
            h["ending"] = e
    h["kind"] = {"month": "honap_ev", "possessed": "honap_ev", "year": "ev"}.get(name, "teljes_datum")
    return h


def find_dates(text: str) -> list[dict]:
    """A text's dates in order, none overlapping: full, month, year, and days whose month an earlier date gives."""
    hits = _disjoint([h for name, p in patterns() for m in p.finditer(text) if (h := _read(name, m))])
    for order in (hits, hits[::-1]):
        last = None
        for h in order:
            if h["year"] is not None and not h["inherited"]:
                last = h["year"]
            elif h["year"] is None and last is not None:
                h |= {"year": last, "inherited": True}
            elif order is hits and h["year"] is not None:
                last = h["year"]
    months = [h for h in hits if h["month"]]
    for m in _LONE_DAY.finditer(text):
        before = [h for h in months if h["end"] <= m.start() <= h["end"] + REACH]
        if (e := day_ending(m[2])) and before and all(m.end() <= h["start"] or h["end"] <= m.start() for h in hits):
            near = max(before, key=lambda h: h["end"])
            hits = [*hits, near | {"start": m.start(), "end": m.end(), "surface": m[0], "kind": "nap", "day": int(m[1]), "has_year": False, "after_year": "", "after_month": "", "style": "nincs", "padded_day": m[1].startswith("0"), "dot": False, "ending": e, "case": None, "unknown": False, "inherited": False}]
    for h in (hits := _disjoint(hits)):
        no_day = h["kind"] == "teljes_datum" and h["has_year"] and h["day"] > monthrange(h["year"], h["month"])[1]
        h["confidence"] = CONFIDENCE[h["kind"]] - no_day * NO_SUCH_DAY - h["unknown"] * UNKNOWN_ENDING - (h["kind"] == "teljes_datum" and not h["has_year"]) * NO_YEAR
    return hits


def shifted(h: dict, days: int, run_year: int) -> tuple[int, int, int]:
    """A date moved: days past the month's end count as its last; months move with their middle, years with the first of July."""
    year = h["year"] or run_year
    month, day = YEAR_ANCHOR if h["kind"] == "ev" else (h["month"], MONTH_ANCHOR if h["day"] is None else min(h["day"], monthrange(year, h["month"])[1]))
    d = dt.date(year, month, day) + dt.timedelta(days)
    return d.year, d.month, d.day


def render(h: dict, year: int, month: int, day: int) -> str | None:
    """A date in the shape of the one it replaces; None where its ending is unknown and the text must stay."""
    if h["kind"] == "ev":
        return f"{year}-{write_year_ending(year, h['case'])}" if h["case"] else f"{year}{'.' * h['dot']}"
    number = f"{day:02d}" if h["padded_day"] else str(day)
    number += write_day_ending(day, h["ending"]) if h["ending"] else "." * h["dot"]
    if h["kind"] == "nap":
        return number
    if h["unknown"]:
        return None
    name = {"nev": MONTHS[month - 1], "rovid": SHORT[month - 1][0] + ".", "romai": ROMAN[month - 1], "szam": f"{month:02d}" if h["padded_month"] else str(month)}.get(h["style"]) or inflect(POSSESSED[month - 1], h["case"])
    if not h["has_year"] and h["surface"][:1].isupper():
        name = name[0].upper() + name[1:]
    return f"{year}{h['after_year']}" * h["has_year"] + name + (h["after_month"] + number if h["kind"] == "teljes_datum" else "")


def shift_dates(text: str, days: int, run_year: int) -> list[tuple[int, int, str | None]]:
    """(start, end, replacement) for a text's dates."""
    return [(h["start"], h["end"], render(h, *shifted(h, days, run_year))) for h in find_dates(text)]


SCHEMA = "start int, end int, surface string, kind string, confidence int, disposition string, year int, month int, day int, inherited boolean, replacement string"


def scan(units: DataFrame, by: list[str], text: str = "text", days: int | None = None, run_year: int = 2025) -> DataFrame:
    """(*by, SCHEMA): each unit's dates, with their replacement if ``days`` is given. ``run_year`` stands for years nowhere written."""
    kinds = [(c, units.schema[c].dataType.simpleString()) for c in by]
    types = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for i, value in enumerate(batch.column(len(by)).to_pylist()):
                for h in find_dates(value or ""):
                    new = render(h, *shifted(h, days, run_year)) if days is not None else None
                    rows.append((h["start"], h["end"], h["surface"], h["kind"], h["confidence"], "auto" if h["confidence"] >= AUTO else "review", h["year"], h["month"], h["day"], h["inherited"], new))
                    at.append(i)
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns[: len(by)]), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*by, *(f.split()[0] for f in SCHEMA.split(", "))])

    return units.select(*by, F.col(text)).mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in kinds), SCHEMA]))


def inherit_years(hits: DataFrame, by: list[str], year: str = "year") -> DataFrame:
    """Years over rows: missing ones from the last date before, leading ones from the first written one after."""
    order = Window.partitionBy(*by).orderBy("start")
    before = F.last(year, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(year, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return hits.withColumns({"inherited": F.col(year).isNull() & F.coalesce(before, after).isNotNull(), year: F.coalesce(before, after)})


def contextual_days(events: DataFrame, by: list[str], reach: int = REACH) -> DataFrame:
    """Each lone day (null month) with the month and year of the latest date that ends before it, within ``reach``: an as-of join.

    Dates and days are one stream ordered by place, so the join is a window's last value and needs no pairing.
    """
    order = Window.partitionBy(*by).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = F.last(F.when(F.col("month").isNotNull(), F.struct("end", "month", "year")), ignorenulls=True).over(order)
    found = events.withColumn("_known", known).where(F.col("month").isNull())
    near = F.when((F.col("_known.end") <= F.col("start")) & (F.col("start") - F.col("_known.end") <= reach), F.col("_known"))
    return found.withColumns({"month": near["month"], "year": near["year"]}).drop("_known")


def shift_column(date: Column, days: Column | int) -> Column:
    return F.date_add(date, days)


#: Days of the week, as they begin.
WEEKDAYS = ("hétfő", "kedd", "szerda", "szerdá", "csütörtök", "péntek", "szombat", "vasárnap")


def warnings(hits: DataFrame, units: DataFrame, by: list[str], days: int, text: str = "text") -> DataFrame:
    """(*by, warning, n): what a reader must know of each unit's shifted dates, from ``scan`` with the same ``days``.

    shifted: replaced dates (deadlines no longer fit the calendar); kept: dates whose ending is unknown and which stay;
    unchanged: bare years that the shift leaves as they were; weekday: a day of the week is named and the shift is no number of
    weeks; coarse: dates to the month or year; inherited: years taken from neighbours; no_year: years nowhere written; review:
    dates that a person must see. Null texts have none.
    """
    seen = {
        "shifted": F.col("replacement").isNotNull(),
        "kept": F.col("replacement").isNull(),
        "unchanged": (F.col("kind") == "ev") & (F.col("replacement") == F.col("surface")),
        "coarse": (F.col("kind") == "ev") | F.col("day").isNull(),
        "inherited": F.col("inherited"),
        "no_year": F.col("year").isNull(),
        "review": F.col("disposition") == "review",
    }
    counts = hits.groupBy(*by).agg(*(F.count_if(c).alias(w) for w, c in seen.items()))
    rows = counts.select(*by, F.explode(F.map_from_arrays(F.array(*map(F.lit, seen)), F.array(*seen))).alias("warning", "n")).where("n > 0")
    if days % 7 == 0:
        return rows
    named = units.where(F.col(text).rlike(f"(?iu)(?<![{LETTERS}])(?:{'|'.join(WEEKDAYS)})"))
    return rows.unionByName(named.select(*by, F.lit("weekday").alias("warning"), F.lit(1).cast("long").alias("n")))
