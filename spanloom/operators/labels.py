"""Labels in place of names: by role, by type or numbered, in Hungarian and in English, with their endings; and putting replacements in.

Labels come from closed tables, so nothing of a text or an entry field gets into an output. All of it is joins on small
dimensions: a label's words give its body, and its last word in a grammatical case gives the ending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.hungarian import CASES, inflect, inflect_name
from spanloom.functions.text import fix_article

#: Type labels, numbered labels and labels of identifiers, in both languages.
TYPES = {"hu": {"person": "név", "org": "szervezet", "place": "helység", "identifier": "azonosító"}, "en": {"person": "name", "org": "organisation", "place": "place", "identifier": "identifier"}}
NUMBERED = {"hu": {"person": "NÉV", "org": "SZERVEZET", "place": "HELY", "identifier": "AZONOSÍTÓ"}, "en": {"person": "NAME", "org": "ORG", "place": "PLACE", "identifier": "ID"}}
IDENTIFIERS = {
    "hu": {
        "ado_azonosito_jel": "adóazonosító jel", "taj": "TAJ-szám", "adoszam": "adószám", "cegjegyzekszam": "cégjegyzékszám", "bankszamlaszam": "bankszámlaszám",
        "iban": "bankszámlaszám", "helyrajzi_szam": "helyrajzi szám", "iranyitoszam": "irányítószám", "telefonszam": "telefonszám",
        "szemelyazonosito_igazolvany": "igazolványszám", "birosagi_ugyszam": "ügyszám", "email": "e-mail cím", "rendszam": "rendszám", "cim": "lakcím",
    },
    "en": {
        "ado_azonosito_jel": "tax ID", "taj": "social security number", "adoszam": "tax number", "cegjegyzekszam": "company registration number",
        "bankszamlaszam": "bank account number", "iban": "bank account number", "helyrajzi_szam": "land registry number", "iranyitoszam": "postcode",
        "telefonszam": "phone number", "szemelyazonosito_igazolvany": "ID card number", "birosagi_ugyszam": "case number", "email": "e-mail address",
        "rendszam": "registration plate", "cim": "address",
    },
}
#: The closed vocabulary of roles with the English word for each, words that stand for no role, English ordinals.
ROLES = {
    "felperes": "the plaintiff", "alperes": "the defendant", "beavatkozó": "the intervener", "kérelmező": "the applicant", "kérelmezett": "the respondent",
    "indítványozó": "the petitioner", "tanú": "the witness", "szakértő": "the expert", "tolmács": "the interpreter", "jogi képviselő": "the legal representative",
    "képviselő": "the representative", "meghatalmazott": "the authorised agent", "törvényes képviselő": "the legal guardian", "gyám": "the guardian",
    "ügygondnok": "the guardian ad litem", "vádlott": "the accused", "terhelt": "the defendant", "gyanúsított": "the suspect", "sértett": "the injured party",
    "magánvádló": "the private prosecutor", "pótmagánvádló": "the substitute private prosecutor", "feljelentő": "the complainant", "magánfél": "the civil claimant",
    "adós": "the debtor", "hitelező": "the creditor", "kezes": "the surety", "készfizető kezes": "the joint and several surety", "jogosult": "the entitled party",
    "kötelezett": "the obligor", "végrehajtást kérő": "the enforcement claimant", "végrehajtást szenvedő": "the enforcement debtor", "zálogkötelezett": "the pledgor",
    "eladó": "the seller", "vevő": "the buyer", "bérlő": "the tenant", "bérbeadó": "the landlord", "megbízó": "the principal", "megbízott": "the agent",
    "kölcsönadó": "the lender", "kölcsönvevő": "the borrower", "ajándékozó": "the donor", "megajándékozott": "the donee", "haszonélvező": "the beneficial owner",
    "szerződő fél": "the contracting party", "szerződő": "the contracting party", "örökös": "the heir", "hagyatéki hitelező": "the estate creditor", "ügyvéd": "the attorney",
}
NO_ROLE = ("", "egyéb", "ismeretlen", "szervezet", "anyja neve")
ORDINALS = {"I": "1st", "II": "2nd", "III": "3rd", "IV": "4th", "V": "5th"}
#: Last words of English labels that a Hungarian ear takes for back vowels; all others are front.
BACK = {"accused", "party", "prosecutor", "debtor", "creditor", "surety", "obligor", "pledgor", "landlord", "borrower", "donor", "donee", "owner", "organisation", "org", "number", "postcode"}
MODES = ("role", "type", "numbered")


def role_key(role: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(role), r"\s+", " "), "[.,;:]+$", ""))


def known_role(role: Column) -> Column:
    """A role's spelling in the vocabulary, its ordinal as ``I. r.`` before it; null for any other text."""
    key, ordinal = role_key(role), r"^([ivxlcdm]+)\.[ \t]*(?:r\.?|rend[űu])[ \t]+(.+)$"
    base = role_key(F.regexp_extract(key, ordinal, 2))
    numbered = F.when(base.isin(*ROLES), F.concat(F.upper(F.regexp_extract(key, ordinal, 1)), F.lit(". r. "), base))
    return F.when(key.isin(*ROLES), key).otherwise(numbered)


def sanitize_role(role: Column) -> Column:
    """The role that may be written into an output: the text's own if the vocabulary has it, else that before a bracket; null otherwise."""
    return F.coalesce(known_role(role), F.when(~role_key(role).isin(*NO_ROLE), known_role(F.element_at(F.split(role, r"\("), 1))))


def role_warning(role: Column) -> Column:
    """``shortened`` if a bracket was cut off a role, ``unknown`` if it can't be used, null if all is well or no role was given."""
    cut = known_role(F.element_at(F.split(role, r"\("), 1)).isNotNull()
    return F.when(known_role(role).isNotNull() | role_key(role).isin(*NO_ROLE), None).when(cut, "shortened").otherwise("unknown")


def endings(spark: SparkSession) -> DataFrame:
    """(language, word, case_tag, ending): what each label's last word takes in each case, nothing if its stem would change."""
    rows = []
    for language in ("hu", "en"):
        labels = [*TYPES[language].values(), *NUMBERED[language].values(), *IDENTIFIERS[language].values(), *(w.upper() for w in IDENTIFIERS[language].values()), *(ROLES.values() if language == "en" else ())]
        for word in sorted({label.split()[-1] for label in labels}):
            given = {"harmony": "back" if word.lower() in BACK else "front"} if language == "en" else None
            for case in CASES:
                form = word if case == "NOM" else inflect(word, case, given)
                rows.append((language, word, case, form[len(word) :].lstrip("-") if len(form) > len(word) else ""))
    return spark.createDataFrame(rows, "language string, word string, case_tag string, ending string")


def role_forms(spark: SparkSession) -> DataFrame:
    """(role, case_tag, form): the Hungarian roles in all cases; the last word takes the ending."""
    return spark.createDataFrame([(r, c, r if c == "NOM" else inflect_name(r, c)) for r in ROLES for c in CASES], "role string, case_tag string, form string")


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def render(hits: DataFrame, mode: str, language: str = "hu") -> DataFrame:
    """``hits`` with replacement. Columns read: kind, identifier_kind, role, number, case_tag, upper, manual (each may be null).

    Identifiers get their own label in every mode, a manual replacement wins in every mode, and who has no usable role gets
    the type's label. Endings follow a hyphen, but Hungarian roles, which are words of the sentence. ``numbered`` keeps the
    kind in capitals. The tables are constants, so they are broadcast.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spark, tag = hits.sparkSession, F.coalesce("case_tag", F.lit("NOM"))
    number = F.coalesce(F.col("number"), F.lit(1)).cast("string")
    own = F.coalesce(_table(IDENTIFIERS[language])[F.col("identifier_kind")], F.lit(TYPES[language]["identifier"]))
    numbered = F.concat(F.lit("["), F.when(F.col("kind") == "identifier", F.upper(own)).otherwise(_table(NUMBERED[language])[F.col("kind")]), F.lit("-"), number, F.lit("]"))
    typed = F.concat(F.lit("["), F.when(F.col("kind") == "identifier", own).otherwise(_table(TYPES[language])[F.col("kind")]), F.lit("]"))
    role = sanitize_role(F.coalesce("role", F.lit("")))
    has_role = F.lit(mode == "role") & F.col("kind").isin("person", "org") & role.isNotNull()
    base = F.regexp_replace(role, r"^[IVXLCDM]+\. r\. ", "")
    english = _table(ROLES)[base]
    ordinal = _table(ORDINALS)[F.regexp_extract(role, r"^([IVXLCDM]+)\. r\. ", 1)]
    english = F.when(ordinal.isNotNull(), F.concat(F.lit("the "), ordinal, F.lit(" "), F.substring(english, F.lit(5), F.length(english)))).otherwise(english)
    rows = hits.withColumns({"_tag": tag, "_role": F.when(has_role, base), "_ordinal": F.when(has_role & (base != role), F.regexp_extract(role, r"^[IVXLCDM]+\. r\. ", 0)).otherwise("")})
    bracketed = numbered if mode == "numbered" else typed
    rows = rows.withColumn("_label", F.coalesce("manual", F.when(has_role, english if language == "en" else role), bracketed))
    rows = rows.withColumn("_word", F.element_at(F.split(F.regexp_replace(F.regexp_replace("_label", r"[\[\]]", ""), r"-\d+$", ""), r"\s+"), -1))
    forms = role_forms(spark).withColumnsRenamed({"role": "_role", "case_tag": "_tag", "form": "_form"})
    ends = endings(spark).where(F.col("language") == language).select(F.col("word").alias("_word"), F.col("case_tag").alias("_tag"), F.col("ending").alias("_ending"))
    joined = rows.join(F.broadcast(forms), ["_role", "_tag"], "left").join(F.broadcast(ends), ["_word", "_tag"], "left")
    hyphened = F.concat("_label", F.when(F.coalesce("_ending", F.lit("")) != "", F.concat(F.lit("-"), "_ending")).otherwise(""))
    shown = F.when(F.col("manual").isNull() & F.lit(language == "hu") & F.col("_form").isNotNull(), F.concat("_ordinal", "_form")).otherwise(hyphened)
    return joined.withColumn("replacement", F.when(F.coalesce("upper", F.lit(False)), F.upper(shown)).otherwise(shown)).select(*hits.columns, "replacement")


def allowed(disposition: Column, approved: Column, approve_all: bool = False) -> Column:
    """May a hit be replaced: on its own, or by a reviewer; approving all never covers what was rejected."""
    return (disposition == "auto") | (F.lit(approve_all) & (disposition != "reject")) | F.coalesce(approved, F.lit(False))


def substitute(units: DataFrame, hits: DataFrame, by: list[str], text: str = "text", approve_all: bool = False) -> DataFrame:
    """(*by, text, replaced, pending, articles_fixed): each unit with its allowed hits (start, end, disposition, approved,
    replacement) put in and the definite article before each set for what now follows.

    Hits without a replacement stay pending; of overlapping ones the first counts. A fold over one unit's few hits; texts are
    joined once. Null texts stay null.
    """
    hit = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "replacement", (allowed(F.col("disposition"), F.col("approved"), approve_all) & F.col("replacement").isNotNull()).alias("use"))
    packed = hits.groupBy(*by).agg(F.collect_list(hit).alias("_hits"))
    whole = F.col(text)
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("fixed"))

    def step(a: Column, h: Column) -> Column:
        before = F.substring(whole, a["at"] + 1, h["start"] - a["at"])
        right = fix_article(before, h["replacement"])
        done = F.struct(F.concat(a["out"], right, h["replacement"]).alias("out"), h["end"].alias("at"), (a["n"] + 1).alias("n"), (a["fixed"] + (right != before).cast("int")).alias("fixed"))
        return F.when(h["use"] & (h["start"] >= a["at"]), done).otherwise(a)

    folded = units.join(packed, by, "left").withColumn("_hits", F.coalesce("_hits", F.array().cast(packed.schema["_hits"].dataType)))
    folded = folded.withColumn("_all", F.aggregate(F.array_sort("_hits"), zero, step))
    out = F.concat(F.col("_all.out"), F.substring(whole, F.col("_all.at") + 1, F.length(whole)))
    return folded.select(*by, F.when(F.size("_hits") == 0, whole).otherwise(out).alias(text), F.col("_all.n").alias("replaced"), (F.size("_hits") - F.col("_all.n")).alias("pending"), F.col("_all.fixed").alias("articles_fixed"))
