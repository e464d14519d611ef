"""Spans and names into entities: trimming, BIO groups, label maps, keys of identifiers, names read apart, texts cleaned. Columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import TITLE_RUN, identifier_key, split_words
from spanloom.operators.identifiers import NAMES

#: What does not belong to a name at its ends, what takes no blank before and behind, and the models' types.
EDGES = r"\s.,;:()\"„”»«\-–—"
CLOSING, OPENING = r".,;:!?%)\]}»”\"", r"(\[{«„"
TYPES = {
    "PER": "person", "ORG": "org", "LOC": "place", "MISC": "other", "PERSON_NAME": "person", "PERSON_ALIAS": "person", "PROPER_NAME": "person",
    "ORGANIZATION_NAME": "org", "LOCATION": "place", "GEO_LOCATION": "place", "POSTAL_ADDRESS": "place",
}


def trim_span(text: Column, start: Column, end: Column) -> Column:
    """(start, end) without blanks and punctuation at the ends; an empty span stays where trimming met."""
    inside = F.substring(text, start + 1, end - start)
    left = F.length(inside) - F.length(F.regexp_replace(inside, f"^[{EDGES}]+", ""))
    rest = F.substring(inside, left + 1, F.length(inside))
    return F.struct((start + left).cast("int").alias("start"), (start + left + F.length(F.regexp_replace(rest, f"[{EDGES}]+$", ""))).cast("int").alias("end"))


def map_labels(spans: DataFrame, column: str = "label", types: dict[str, str] = TYPES) -> DataFrame:
    """Spans with ``kind`` by their model's type; types without a kind get null and can be counted."""
    return spans.withColumn("kind", F.create_map(*(F.lit(x) for pair in types.items() for x in pair))[F.regexp_replace(column, "^[BIES]-", "")])


def softmax_best(logits: Column, labels: list[str]) -> Column:
    """(label, score): the likeliest label and its softmax probability; the first of equals."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    return F.struct(F.get(F.array(*map(F.lit, labels)), (F.array_position(logits, top) - 1).cast("int")).alias("label"), (1.0 / total).alias("score"))


def group_bio(tokens: DataFrame, by: list[str], order: str = "no") -> DataFrame:
    """(*by, label, start, end, score): runs of tokens (label, score, start, end) of one type with their average score.

    ``O`` and empty labels close a run, ``B-`` begins one unless it touches a run of its type (at most one character between).
    """
    lines = Window.partitionBy(*by).orderBy(order)
    typed = tokens.withColumn("_type", F.when((F.col("label") == "O") | (F.coalesce("label", F.lit("")) == ""), None).otherwise(F.regexp_replace("label", "^[BIES]-", "")))
    goes_on = (F.lag("_type").over(lines) == F.col("_type")) & (~F.startswith("label", F.lit("B-")) | (F.col("start") <= F.lag("end").over(lines) + 1))
    run = F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(lines.rowsBetween(Window.unboundedPreceding, 0))
    return typed.withColumn("_run", run).where("_type IS NOT NULL").groupBy(*by, "_run").agg(F.first("_type").alias("label"), F.min("start").alias("start"), F.max("end").alias("end"), F.avg("score").alias("score")).drop("_run")


def clean_spaces(text: Column) -> Column:
    """Blanks collapsed, none at the ends, before closing or behind opening punctuation."""
    one = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), f" (?=[{CLOSING}])", "")
    return F.regexp_replace(one, f"(?<=[{OPENING}]) ", "")


def cleaned_places(text: Column) -> Column:
    """Where each character of a text (and its end) is once it is cleaned: the length of what its prefix leaves.

    A blank that stays counts for the character behind it, so a place is the cleaned length of all before it, with the blank
    that the character itself makes visible.
    """

    def place(i: Column) -> Column:
        head = F.substring(text, F.lit(1), i)
        blank = (i < F.length(text)) & F.substring(text, i + 1, F.lit(1)).rlike(r"\s")
        # Up to a blank only what stands before it counts.
        bare = F.regexp_replace(head, r"\s+$", "")
        return F.when(blank | (i == F.length(text)), F.length(clean_spaces(bare))).otherwise(F.length(clean_spaces(F.concat(head, F.substring(text, i + 1, F.lit(1))))) - 1).cast("int")

    return F.transform(F.sequence(F.lit(0), F.length(text)), place)


def matched_identifiers(hits: DataFrame, entities: DataFrame, case: str) -> DataFrame:
    """Hits (kind, surface) with entity_id: the case's first identifier entity (id, identifier_kind, name) of the same kind and key, null if none."""
    known = entities.where("kind = 'identifier'").groupBy(case, F.col("identifier_kind").alias("kind"), identifier_key(F.col("name")).alias("_key")).agg(F.min("id").alias("entity_id"))
    return hits.withColumn("_key", identifier_key(F.col("surface"))).join(known, [case, "kind", "_key"], "left").drop("_key")


def found_identifiers(hits: DataFrame, entities: DataFrame, case: str, order: list[str]) -> DataFrame:
    """(case, id, kind, name, gender, role, identifier_kind): identifiers of a case's hits that no entity stands for, numbered ``#az1`` on by their first place."""
    known = entities.where("kind = 'identifier'").select(case, F.col("identifier_kind"), identifier_key(F.col("name")).alias("_key")).distinct()
    first = hits.select(case, F.col("kind").alias("identifier_kind"), identifier_key(F.col("surface")).alias("_key"), F.struct(*order, "surface").alias("_at"))
    first = first.groupBy(case, "identifier_kind", "_key").agg(F.min("_at").alias("_at")).join(known, [case, "identifier_kind", "_key"], "left_anti")
    number = F.row_number().over(Window.partitionBy(case).orderBy("_at", "identifier_kind"))
    role = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))[F.col("identifier_kind")]
    return first.select(case, F.concat(F.lit("#az"), number.cast("string")).alias("id"), F.lit("identifier").alias("kind"), F.col("_at.surface").alias("name"), F.lit("N").alias("gender"), role.alias("role"), "identifier_kind")


def read_name(full: Column, gender: Column) -> Column:
    """(surname, given, maiden, wife_of) of a person's full name.

    ``Baloghné Fehér Ilona`` has a husband's surname, a maiden name and a given name; ``Kovács Jánosné`` a husband's whole
    name; any other is surname and given names. Titles are left out.
    """
    bare = F.trim(F.regexp_replace(F.trim(full), TITLE_RUN, ""))
    parts = split_words(bare)
    n, woman = F.size(parts), gender == "F"
    first, rest = F.get(parts, F.lit(0)), lambda w, at, size: F.array_join(F.slice(w, at, size), " ")
    maiden = woman & (n >= 3) & first.rlike("^.+né$")
    husband = F.regexp_replace(bare, "né$", "")
    wife = woman & (n >= 2) & bare.rlike("né$")
    names = split_words(husband)
    many = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    none = F.lit(None).cast("string")
    person = lambda s, g, m, w: F.struct(s.alias("surname"), g.alias("given"), m.alias("maiden"), w.alias("wife_of"))
    return (
        F.when(maiden, person(F.regexp_replace(first, "né$", ""), F.element_at(parts, -1), rest(parts, 2, F.greatest(n - 2, F.lit(0))), F.regexp_replace(first, "né$", "")))
        .when(wife, person(F.get(names, F.lit(0)), rest(names, 2, many(names)), none, husband))
        .otherwise(person(first, rest(parts, 2, many(parts)), none, none))
    )


def locative_case(core: Column, case_tag: Column, locative: Column) -> Column:
    """A place's case as its new name takes it: on (SUP, SUB, DEL) or in (INE, ILL, ELA)."""
    inside = F.coalesce(locative, F.lit("sup")) == "ine"
    out = case_tag
    for on, within in (("SUP", "INE"), ("SUB", "ILL"), ("DEL", "ELA")):
        out = F.when((core == "place") & case_tag.isin(on, within), F.when(inside, within).otherwise(on)).otherwise(out)
    return out


def auto_accepted(hits: DataFrame) -> DataFrame:
    """What was accepted without a person: hits decided by the program, with ``common_word`` if they read like a common noun."""
    return hits.where(F.col("by_program") & (F.col("decision") == "accept")).withColumn("common_word", F.coalesce("ambiguous", F.lit(False)))


#: Which part of a person's name a core is; other cores hold a second part that tells a name from a word.
PART_OF_CORE = {"surname": "surname", "family": "surname", "wife_surname": "surname", "maiden_surname": "maiden", "given": "given"}


def with_common_words(hits: DataFrame, entities: DataFrame, words: DataFrame, case: str, word: str = "word") -> DataFrame:
    """``hits`` (case, entity_id, core, surface, ...) with ``common_word``: the surface, or the part of a person's name that its
    core stands for, is a word of the language, in any case of letters.

    ``entities`` has (case, id, kind, surname, given, maiden); ``words`` is a dimension of any size that rows meet by two joins.
    Hits of unknown or null entities are judged by their surface alone; null surfaces and parts are no words.
    """
    known = words.where(F.col(word).isNotNull()).select(F.lower(word).alias("_word")).distinct()
    parts = entities.where("kind = 'person'").select(F.col(case).alias("_case"), F.col("id").alias("_id"), "surname", "given", "maiden").dropDuplicates(["_case", "_id"])
    parts = parts.select("_case", "_id", F.struct("surname", "given", "maiden").alias("_parts"))
    part = F.lit(None).cast("string")
    for core, field in PART_OF_CORE.items():
        part = F.when(F.col("core") == core, F.col(f"_parts.{field}")).otherwise(part)
    joined = hits.join(parts, (F.col(case) == F.col("_case")) & (F.col("entity_id") == F.col("_id")), "left")
    joined = joined.withColumns({"_surface": F.lower("surface"), "_part": F.lower(part)}).drop("_case", "_id", "_parts")
    for key in ("_surface", "_part"):
        joined = joined.join(known.select(F.col("_word").alias(f"{key}_word")), F.col(key) == F.col(f"{key}_word"), "left")
    common = F.col("_surface_word").isNotNull() | F.col("_part_word").isNotNull()
    return joined.withColumn("common_word", common).drop("_surface", "_part", "_surface_word", "_part_word")


def export_name(path: Column, mode: Column | str) -> Column:
    """A document's name in an export: its stem, ``-obh`` for role labels or ``-alnevesitett``, its extension."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
    by_role = F.lit(mode) == "role" if isinstance(mode, str) else F.coalesce(mode == "role", F.lit(False))
    return F.concat(F.substring(name, F.lit(1), F.length(name) - F.length(ext)), F.when(by_role, "-obh").otherwise("-alnevesitett"), ext)
