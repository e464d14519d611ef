"""Hungarian morphology: vowel harmony, case endings of names, numerals in words.

Plain Python over short words. It serves to build dimension tables (paradigms, day and year endings), which are then joined;
``paradigms`` does so for a DataFrame of names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The language's sounds and endings.
BACK, ROUNDED, NEUTRAL = "aáoóuú", "öőüű", "iíé"
VOWELS = BACK + ROUNDED + NEUTRAL + "e"
DIGRAPHS = ("dzs", "cs", "dz", "gy", "ly", "ny", "sz", "ty", "zs")
OLD_FINALS = {"th": "t", "gh": "g", "cz": "c", "tz": "c", "ts": "cs", "x": "sz"}
BARE_T = {"j", "l", "ly", "n", "ny", "r", "s", "sz", "z", "zs"}
CASES = ("NOM", "ACC", "DAT", "INS", "INE", "ILL", "ELA", "SUP", "SUB", "DEL", "ADE", "ALL", "ABL", "TER", "CAU", "FOR", "TRANS", "POSS", "FAM", "PL", "WIFE")
#: back, front unrounded, front rounded
ENDINGS = {
    "DAT": ("nak", "nek", "nek"), "INE": ("ban", "ben", "ben"), "ILL": ("ba", "be", "be"), "ELA": ("ból", "ből", "ből"),
    "SUB": ("ra", "re", "re"), "DEL": ("ról", "ről", "ről"), "ADE": ("nál", "nél", "nél"), "ALL": ("hoz", "hez", "höz"),
    "ABL": ("tól", "től", "től"), "TER": ("ig",) * 3, "CAU": ("ért",) * 3, "FOR": ("ként",) * 3, "POSS": ("é",) * 3,
    "FAM": ("ék",) * 3, "WIFE": ("né",) * 3,
}
ABBREVIATIONS = {"kft.", "zrt.", "nyrt.", "bt.", "kkt.", "kht.", "ec.", "rt.", "kv."}
ONES = ("", "egy", "kettő", "három", "négy", "öt", "hat", "hét", "nyolc", "kilenc")
TENS = ("", "tíz", "húsz", "harminc", "negyven", "ötven", "hatvan", "hetven", "nyolcvan", "kilencven")
BEFORE_ONES = {1: "tizen", 2: "huszon"}
GROUPS = ((10**12, "billió"), (10**9, "milliárd"), (10**6, "millió"), (10**3, "ezer"))


def harmony(word: str) -> str:
    """``back``, ``front`` or ``rounded``: by the last vowel that is not neutral, rounding by the very last."""
    vowels = [c for c in word.lower() if c in VOWELS]
    strong = [c for c in vowels if c not in NEUTRAL]
    if strong and strong[-1] in BACK:
        return "back"
    return "rounded" if vowels and vowels[-1] in ROUNDED else "front"


def _column(h: str) -> int:
    return ("back", "front", "rounded").index(h)


def final_consonant(word: str) -> tuple[str, bool] | None:
    """The last consonant as written and whether it is written double; None after a vowel or in an empty word."""
    w = word.lower()
    if not w or w[-1] in VOWELS:
        return None
    sound = next((d for d in DIGRAPHS if w.endswith(d)), w[-1])
    return sound, w.endswith(sound[0] + sound) if len(sound) > 1 else w[-2:-1] == sound


def long_vowel(stem: str) -> str:
    """A final short a or e made long, as before most endings."""
    return stem[:-1] + {"a": "á", "e": "é", "A": "Á", "E": "É"}.get(stem[-1:], stem[-1:])


def _shout(model: str, made: str) -> str:
    return made.upper() if len(model) >= 2 and model == model.upper() and re.search("[A-ZÁÉÍÓÖŐÚÜŰ]", model) else made


def _collides(stem: str, ending: str) -> bool:
    """Would the ending make three equal consonants?"""
    a = stem[-2:].lower()
    return len(a) == 2 and a[0] == a[1] and a[0] not in VOWELS and ending[:1].lower() == a[0]


def _assimilating(stem: str, h: str, ov: dict, vowel: tuple[str, str], whole: tuple[str, str]) -> str:
    """Endings in v, which takes on the stem's last consonant."""
    k = 0 if h == "back" else 1
    if ov.get("hyphenate"):
        return f"{stem}-{whole[k]}"
    last = final_consonant(stem)
    if last is None:
        return long_vowel(stem) + whole[k]
    for written, sound in OLD_FINALS.items():
        if stem.lower().endswith(written):
            return _shout(stem, stem + sound + vowel[k])
    sound, double = last
    if double:
        return f"{stem}-{sound}{vowel[k]}"
    return _shout(stem, stem[: len(stem) - len(sound)] + sound[0] + sound + vowel[k])


def inflect(word: str, case: str, ov: dict | None = None) -> str:
    """A word in a case. ``ov``: harmony, link, stem_alt, hyphenate, ready forms ins, acc, pl, and forms by case."""
    ov = ov or {}
    if ready := (ov.get("forms") or {}).get(case):
        return ready
    if case == "NOM":
        return word
    h = ov.get("harmony") or harmony(word)
    link = {"back": "o", "front": "e", "rounded": "ö"}[h]
    chosen, open_stem = ov.get("link") or link, final_consonant(word) is None
    stem_alt = ov.get("stem_alt") or word
    if case in ("INS", "TRANS"):
        if ready := ov.get("ins"):
            if case == "INS":
                return ready
            if ready[-2:] in ("al", "el"):
                return ready[:-2] + ("á" if ready[-2] == "a" else "é")
        return _assimilating(word, h, ov, ("al", "el"), ("val", "vel")) if case == "INS" else _assimilating(word, h, ov, ("á", "é"), ("vá", "vé"))
    if case == "ACC":
        if ov.get("acc"):
            return ov["acc"]
        if ov.get("hyphenate"):
            return f"{word}-t"
        if open_stem:
            return long_vowel(word) + "t"
        if final_consonant(word)[0] in BARE_T and sum(c in VOWELS for c in word.lower()) >= 2:
            return word + ("-t" if _collides(word, "t") else "t")
        return f"{stem_alt}{chosen}t"
    if case == "SUP":
        if ov.get("hyphenate"):
            return f"{word}-{chosen}n"
        return long_vowel(word) + "n" if open_stem else f"{stem_alt}{chosen}n"
    if case == "PL":
        if ov.get("pl"):
            return ov["pl"]
        if ov.get("hyphenate"):
            return f"{word}-{link}k"
        if open_stem:
            return long_vowel(word) + "k"
        adjectival = h == "back" and re.search("[^aáeéiíoóöőuúüűglnt]y$", word, re.I)
        return word + ("ak" if adjectival else f"{link}k")
    ending = ENDINGS[case][_column(h)]
    if ov.get("hyphenate"):
        return f"{word}-{ending}"
    base = word if case == "FOR" else long_vowel(word)
    return f"{base}-{ending}" if _collides(base, ending) else base + ending


def inflect_name(name: str, case: str, ov: dict | None = None) -> str:
    """Only a name's last word bends."""
    if ready := ((ov or {}).get("forms") or {}).get(case):
        return ready
    if case == "NOM" or not name.strip():
        return name
    *head, last = name.split()
    return " ".join([*head, inflect(last, case, ov)])


def inflect_organisation(name: str, case: str, ov: dict | None = None) -> str:
    """A company form at the end takes its ending behind a hyphen and is read with front vowels."""
    if ready := ((ov or {}).get("forms") or {}).get(case):
        return ready
    if case == "NOM":
        return name
    if not name.split() or name.split()[-1].lower() not in ABBREVIATIONS:
        return inflect_name(name, case, ov)
    ending = {"INS": "vel", "TRANS": "vé", "ACC": "t", "SUP": "en", "PL": "ek"}.get(case) or ENDINGS[case][1]
    return f"{name}-{ending}"


def paradigm(name: str, ov: dict | None = None) -> dict[str, str]:
    return {case: inflect_name(name, case, ov) for case in CASES}


def _three_digits(n: int) -> str:
    hundreds, tens, ones = n // 100, n // 10 % 10, n % 10
    out = "" if not hundreds else "száz" if hundreds == 1 else _joined(ONES[hundreds]) + "száz"
    return out + (ONES[ones] if not tens else TENS[tens] if not ones else BEFORE_ONES.get(tens, TENS[tens]) + ONES[ones])


def _joined(numeral: str) -> str:
    """Two is két before another word."""
    return numeral[:-5] + "két" if numeral.endswith("kettő") else numeral


def number_words(n: int) -> str:
    """A whole number in words: groups of three digits, hyphened above two thousand."""
    if n != int(n):
        raise ValueError("only whole numbers are written in words")
    n = int(n)
    if n <= 0:
        return "nulla" if n == 0 else f"mínusz {number_words(-n)}"
    parts, rest = [], n
    for size, name in GROUPS:
        count, rest = divmod(rest, size)
        if count:
            parts.append(("" if count == 1 and name == "ezer" else _joined(_three_digits(count))) + name)
    parts += [_three_digits(rest)] if rest else []
    return ("-" if n > 2000 else "").join(parts)


_VALUES = {name: size for size, name in GROUPS} | {w: 10 * i for i, w in enumerate(TENS) if w} | {w: i for i, w in enumerate(ONES) if w} | {"száz": 100, "huszon": 20, "tizen": 10, "két": 2, "nulla": 0}
_NUMERAL = re.compile("|".join(sorted(_VALUES, key=len, reverse=True)))


def read_number_words(text: str, at: int, target: int) -> int | None:
    """Where a numeral that starts at ``at`` and has the value ``target`` ends at the latest; None if none does, or if letters follow."""
    low, whole, part, best = text.lower(), 0, 0, None
    while found := _NUMERAL.match(low, at):
        value, at = _VALUES[found[0]], found.end()
        if value >= 1000:
            whole, part = whole + max(part, 1) * value, 0
        elif value == 100:
            part = max(part, 1) * 100
        else:
            part += value
        if whole + part == target:
            best = at
        if low[at : at + 1] in ("-", " ", "\xa0") and low[at : at + 1] and _NUMERAL.match(low, at + 1):
            at += 1
    if best is not None and re.match("[A-Za-zÁÉÍÓÖŐÚÜŰáéíóöőúüű]", text[best : best + 1]):
        return None
    return best


def paradigms(names: DataFrame, column: str = "name", organisation: str | None = None) -> DataFrame:
    """(name, case, form): all case forms of the distinct names of a column, a dimension table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, c, (inflect_organisation if o else inflect_name)(n, c)) for n, o in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if n is not None for c in CASES]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["name", "case", "form"])

    is_org = F.col(organisation) if organisation else F.lit(False)
    return names.select(F.col(column).alias("name"), is_org.alias("o")).distinct().mapInArrow(run, "name string, case string, form string")


def numerals(rows: DataFrame, number: str, after: str = "") -> DataFrame:
    """``rows`` with in_words, and read_to: how far the words reach when they are read back from a text in which ``after`` follows.

    Both are worked out once for each distinct number, a dimension table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [n for n in batch.column(0).to_pylist() if n is not None]
            said = [number_words(n) for n in numbers]
            reached = [read_number_words(w + after, 0, n) for w, n in zip(said, numbers, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(said, pa.string()), pa.array(reached, pa.int32())], names=[number, "in_words", "read_to"])

    each = rows.select(F.col(number).cast("long").alias(number)).distinct().mapInArrow(run, f"`{number}` long, in_words string, read_to int")
    return rows.join(each, number, "left")


def words_of(number: Column) -> Column:
    """A whole number in words, in columns alone: as ``number_words``, for numbers below 10^15."""
    pick = lambda words, i: F.get(F.array(*map(F.lit, words)), i.cast("int"))

    def three(n: Column) -> Column:
        hundreds, tens, ones = F.floor(n / 100), F.floor(n / 10) % 10, n % 10
        high = F.when(hundreds == 0, "").when(hundreds == 1, "száz").otherwise(F.concat(pick([_joined(w) for w in ONES], hundreds), F.lit("száz")))
        low = F.when(tens == 0, pick(ONES, ones)).when(ones == 0, pick(TENS, tens)).otherwise(F.concat(pick([BEFORE_ONES.get(i, w) for i, w in enumerate(TENS)], tens), pick(ONES, ones)))
        return F.concat(high, low)

    n = F.abs(number).cast("long")
    rest, parts = n, []
    for size, name in GROUPS:
        count, rest = F.floor(rest / size), rest % size
        said = F.when(count == 1, "").otherwise(three(count)) if name == "ezer" else three(count)
        parts.append(F.when(count > 0, F.concat(F.regexp_replace(said, "kettő$", "két"), F.lit(name))))
    parts.append(F.when(rest > 0, three(rest)))
    joined = F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), "-")
    words = F.when(n > 2000, joined).otherwise(F.replace(joined, F.lit("-"), F.lit("")))
    return F.when(number == 0, "nulla").when(number < 0, F.concat(F.lit("mínusz "), words)).otherwise(words)
