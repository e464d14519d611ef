"""Scalar text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hungarian letters, their accent-free counterparts, and name titles.
ACCENTED, PLAIN = "áÁéÉíÍóÓöÖőŐúÚüÜűŰ", "aAeEiIoOoOoOuUuUuU"
LETTERS = "A-Za-zÁÉÍÓÖŐÚÜŰáéíóöőúüű"
UPPER, LOWER = "A-ZÁÉÍÓÖŐÚÜŰ", "a-záéíóöőúüű"
TITLE_RUN = r"(?iu)^((?:prof\.\s*)?(?:dr\.|ifj\.|id\.|özv\.|néhai)\s*)+"
COMPANY_FORM = r"(?i)\s+(Nonprofit\s+)?(Kft\.|Zrt\.|Nyrt\.|Bt\.|Kkt\.|Kht\.|Ec\.|Rt\.)$"
VOWEL_NAMED = "aáeéfiíllmnoóöőrsuúüűxy"
VOWELS = "aáeéiíoóöőuúüű"


def strip_accents(c: Column) -> Column:
    """Length-preserving: one letter for each accented one."""
    return F.translate(c, ACCENTED, PLAIN)


def fold(c: Column) -> Column:
    return F.lower(strip_accents(c))


def undo_hyphenation(c: Column) -> Column:
    """Words divided at line ends joined again (the text alone; see operators.names for the index map)."""
    return F.regexp_replace(c, "[-­][ \\t]*\\r?\\n[ \\t]*", "")


def normalise_name(c: Column) -> Column:
    """Without titles, lower case, single blanks, no closing punctuation."""
    bare = F.lower(F.regexp_replace(c, TITLE_RUN, ""))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"[.,;:]+$", ""))


def identifier_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^0-9a-záéíóöőúüű@.]", "")


def residue_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^0-9a-záéíóöőúüű]", "")


def normalise_role(c: Column) -> Column:
    """One spelling for the usual role words; numbered defendants become ``I. r. alperes`` and so on."""
    r = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", " "), "rendű", "r."), r"\s*:\s*$", ""))
    numbered = F.regexp_extract(r, r"^(i{1,3})\. r", 1)
    return F.when(numbered != "", F.concat(F.upper(numbered), F.lit(". r. alperes"))).otherwise(r)


def split_words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def cluster_key(name: Column, person: Column) -> Column:
    """What forms of one name share: six letters of the first two words of a person, seven of an organisation's first."""
    w = split_words(F.lower(F.regexp_replace(name, TITLE_RUN, "")))
    two = F.array_join(F.transform(F.slice(w, 1, 2), lambda x: F.substring(x, 1, 6)), " ")
    return F.when(person, two).otherwise(F.substring(F.get(w, F.lit(0)), 1, 7))


def sentence_initial(text: Column, start: Column) -> Column:
    """Does what begins at 0-based ``start`` begin a sentence? Four characters before it decide."""
    before = F.substring(text, F.greatest(start - 3, F.lit(1)), F.least(start, F.lit(4)))
    return F.when(start <= 0, True).otherwise(before.rlike(r"(?s)(^\s*$|[.!?:;]\s*$|\n\s*$)"))


def context_around(text: Column, start: Column, end: Column, width: int = 45) -> Column:
    """The span in brackets with ``width`` characters on both sides and dots where text was cut."""
    lo = F.greatest(start - width, F.lit(0))
    left, right = F.substring(text, lo + 1, start - lo), F.substring(text, end + 1, F.lit(width))
    more = F.when(F.length(text) > end + width, "…").otherwise("")
    out = F.concat(F.when(lo > 0, "…").otherwise(""), left, F.lit("⟦"), F.substring(text, start + 1, end - start), F.lit("⟧"), right, more)
    return F.regexp_replace(out, r"\s+", " ")


def company_form(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, COMPANY_FORM, 0))


def strip_company_form(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, COMPANY_FORM, ""))


def initials(c: Column) -> Column:
    return F.array_join(F.transform(split_words(c), lambda w: F.upper(F.substring(w, 1, 1))), "")


def word_root(c: Column) -> Column:
    """Lower case without one common derivational ending."""
    return F.regexp_replace(F.lower(c), "(os|es|ös|ás|és|i|ó|ő|s|a|e)$", "")


def same_root(a: Column, b: Column) -> Column:
    ra, rb = word_root(a), word_root(b)
    near = lambda x, y: F.startswith(y, x) & (F.length(y) - F.length(x) <= 2)
    return (ra == rb) | ((F.length(ra) > 0) & near(ra, rb)) | ((F.length(rb) > 0) & near(rb, ra))


def needs_az(c: Column) -> Column:
    """Does the definite article take its form before a vowel? All-capital words are spelled out, letter by letter."""
    word = F.trim(c)
    bare = F.regexp_replace(word, f"[^{LETTERS}]", "")
    first = F.lower(F.substring(word, 1, 1))
    spelled = (F.length(bare) >= 2) & (bare == F.upper(bare))
    return F.when(word == "", False).when(spelled, F.instr(F.lit(VOWEL_NAMED), first) > 0).otherwise(F.instr(F.lit(VOWELS), first) > 0)


def fix_article(before: Column, replacement: Column) -> Column:
    """Text that ends in a definite article, with the article's form set for what follows; its capital is kept."""
    found = F.regexp_extract(before, r"(?iu)(?<![" + LETTERS + r"])(az?)([ \t ]+)$", 1)
    gap = F.regexp_extract(before, r"(?iu)(?<![" + LETTERS + r"])(az?)([ \t ]+)$", 2)
    a = F.when(F.substring(found, 1, 1) == "A", "A").otherwise("a")
    right = F.concat(a, F.when(needs_az(replacement), "z").otherwise(""))
    stem = F.substring(before, F.lit(1), F.length(before) - F.length(found) - F.length(gap))
    return F.when(found == "", before).otherwise(F.concat(stem, right, gap))


def match_case(source: Column, produced: Column) -> Column:
    shout = (F.length(source) >= 2) & (source == F.upper(source)) & source.rlike(f"[{UPPER}]")
    return F.when(shout, F.upper(produced)).otherwise(produced)


def capital_like(source: Column, produced: Column) -> Column:
    first = F.substring(source, 1, 1)
    return F.when((first == F.upper(first)) & (first != F.lower(first)), F.concat(F.upper(F.substring(produced, 1, 1)), F.expr("''"), F.substring(produced, F.lit(2), F.length(produced)))).otherwise(produced)


def token_surface(c: Column) -> Column:
    """Sub-word marks of the three usual tokenizer families made plain."""
    return F.regexp_replace(F.translate(c, "▁ĠĊ", "  \n"), "^##", "")
