"""Sets of replacement names: reading proposals, judging them, and assembling a set whose order is kept."""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.text import LOWER, UPPER, VOWELS

#: Groups by how they may be called, bounds of a name's length, least sizes of a set.
GROUPS = {"given": ("given", "utó", "uto", "kereszt"), "surname": ("sur", "family", "vezet", "csal"), "org": ("org", "ceg", "cég"), "place": ("place", "hely", "telep")}
SHORTEST, LONGEST, LONGEST_PLACE = 3, 20, 24
NEEDED = {("given", "M"): 8, ("given", "F"): 8, ("surname", None): 12}
ADVISED = {("org", None): 6, ("place", None): 4}
FOREIGN_ENDS = ("eau", "eux", "oux", "ough", "oo", "ee", "ow", "ew")


def group_of(said: str | None) -> str | None:
    return next((g for g, starts in GROUPS.items() if (said or "").lower().startswith(starts)), None)


def gender_of(said: str | None) -> str | None:
    s = (said or "").lower()
    return "M" if s == "m" or s.startswith(("férfi", "ferfi", "male")) else "F" if s == "f" or s.startswith(("nő", "no", "female")) else "N" if s == "n" or s.startswith("semleges") else None


def read_proposals(answer: str, group: str | None = None, gender: str | None = None) -> list[dict]:
    """Proposals in a model's answer: its first JSON array, else every JSON object on a line; thoughts in tags are cut away."""
    text = re.sub(r"<think>.*?(</think>|\Z)", "", answer, flags=re.S)
    items, decoder = None, json.JSONDecoder()
    for m in re.finditer(r"\[", text):
        try:
            items, _ = decoder.raw_decode(text, m.start())
            break
        except ValueError:
            continue
    if items is None:
        items = []
        for line in text.splitlines():
            try:
                items.append(json.loads(line.strip().rstrip(",")))
            except ValueError:
                continue
    out = []
    for item in items:
        record = {"form": item} if isinstance(item, str) else item if isinstance(item, dict) else {}
        first = lambda *keys, r=record: next((r[k].strip() for k in keys if isinstance(r.get(k), str) and r[k].strip()), None)
        if form := first("form", "name", "nev", "név", "alak"):
            out.append({"form": form, "group": group_of(first("group", "type", "csoport", "kind")) or group, "gender": gender_of(first("gender", "nem", "sex")) or gender})
    return out


def shape_fault(form: Column, group: Column) -> Column:
    """What is wrong with a name's shape, or null; the first fault counts."""
    name = f"^[{UPPER}][{LOWER}]+(?:-[{UPPER}]?[{LOWER}]+)*$"
    return (
        F.when(F.coalesce(form, F.lit("")) == "", "empty")
        .when(~form.rlike(name), "letters")
        .when(~F.lower(form).rlike(f"[{VOWELS}]"), "no vowel")
        .when(F.length(form) < SHORTEST, "short")
        .when(F.length(form) > F.when(group == "place", LONGEST_PLACE).otherwise(LONGEST), "long")
    )


def judge(proposals: DataFrame, real_names: DataFrame, no: str = "no") -> DataFrame:
    """Proposals (no, form, group, gender) with ``reject``, null for the accepted: shape, real name, gender, repetition, other list, in this order.

    What came first decides, so names are compared with the sound ones before them.
    """
    keyed = proposals.withColumn("form", F.trim("form")).withColumn("key", F.lower("form"))
    real = real_names.select(F.lower("name").alias("_real")).distinct()
    parts = F.array_distinct(F.concat(F.array("key"), F.split("key", "-")))
    found = keyed.select(no, F.explode(parts).alias("_real")).join(real, "_real", "left_semi").select(no).distinct().withColumn("_is_real", F.lit(True))
    early = keyed.join(found, no, "left").withColumn("_early", F.coalesce(shape_fault(F.col("form"), F.col("group")), F.when(F.col("_is_real"), "real name"), F.when((F.col("group") == "given") & ~F.coalesce(F.col("gender").isin("M", "F"), F.lit(False)), "no gender")))
    sound = F.col("_early").isNull()
    before = lambda *cols: Window.partitionBy(*cols).orderBy(no).rowsBetween(Window.unboundedPreceding, -1)
    first_gender = F.first(F.when(sound & (F.col("group") == "given"), F.col("gender")), ignorenulls=True).over(before("key"))
    repeated = F.max(F.when(sound, 1)).over(before("group", "key"))
    other = F.max(F.when(sound & F.col("group").isin("given", "surname"), F.col("group"))).over(before("key"))
    late = F.when((F.col("group") == "given") & (first_gender != F.col("gender")), "two genders").when(repeated == 1, "repeated").when(F.col("group").isin("given", "surname") & other.isNotNull() & (other != F.col("group")), "other list")
    return early.withColumn("reject", F.coalesce("_early", late)).drop("_early", "_is_real", "key")


def notes(form: Column, harmony: Column) -> Column:
    """What a reader should check: endings that depend on how a name is said."""
    low = F.lower(form)
    vowels = F.regexp_replace(low, f"[^{VOWELS}]", "")
    return F.filter(
        F.array(
            F.when((harmony == "back") & F.endswith(vowels, F.lit("é")), "mixed harmony"),
            F.when(low.rlike("[qwx]") | low.rlike("(^|[^glnt])y"), "foreign letter"),
            F.when(F.contains(low, F.lit("ch")), "ch"),
            F.when(low.rlike("(" + "|".join(FOREIGN_ENDS) + ")$"), "foreign ending"),
            F.when((harmony == "rounded") & ~low.rlike(f"[{VOWELS}]$"), "link vowel"),
        ),
        lambda n: n.isNotNull(),
    )


def shortages(accepted: DataFrame) -> list[tuple[str, str | None, int, int, bool]]:
    """(group, gender, there, wanted, must) for what a set lacks; counts of a few groups, all that reaches the driver."""
    counts = {(r.group, r.gender): r.n for r in accepted.groupBy("group", "gender").agg(F.count("*").alias("n")).collect()}
    have = lambda g, s: sum(n for (a, b), n in counts.items() if a == g and s in (None, b))
    return [(g, s, have(g, s), n, must) for wanted, must in ((NEEDED, True), (ADVISED, False)) for (g, s), n in wanted.items() if have(g, s) < n]


def load(spark: SparkSession, path: str) -> DataFrame:
    """Sets from JSON files of a folder; those without names are left out, and of an id the first by path."""
    raw = spark.read.option("multiLine", "true").json(path).withColumn("_path", F.input_file_name())
    full = raw.where((F.size("given_names") > 0) & (F.size("surnames") > 0))
    return full.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("_path"))).where("_n = 1").drop("_n", "_path")


def slug(title: str) -> str:
    plain = unicodedata.normalize("NFKD", title).encode("ascii", "ignore").decode().lower()
    return re.sub("[^a-z0-9]+", "_", plain).strip("_")
