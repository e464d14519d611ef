"""Cases out: the gate, names, a certificate for each document, the key, all in one commit.

An export run is one folder that appears whole: documents that passed the gate, their certificates, the sealed key of each case
that wants one, and a list of what was held back and why. A document with a leak is in none of them but that list, without its
text. If anything fails, a weak passphrase included, there is no folder. What a person is called is in no certificate: that is
in the key alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.text import fold
from spanloom.operators.decisions import accepted, undecided
from spanloom.operators.labels import IDENTIFIERS
from spanloom.operators.shaping import export_name
from spanloom.sources import keyfile
from spanloom.sources.staged import Staged, held

#: The certificate's lines. Readers of the format look for them by their words.
HEADER, SUFFIX, MOST_NAMES = "ANONIMIZÁLÁSI JEGYZŐKÖNYV", "-jegyzokonyv", 999
MODES = {"theme": "témás álnevek", "role": "eljárási szerep (OBH)", "type": "adatfajta neve", "numbered": "számozott címke"}
KINDS = {"person": "személy", "org": "szervezet", "place": "helység", "identifier": "azonosító"}
KEY_LINE = {True: "készült (álnevesítés — a kimenet továbbra is személyes adat)", False: "nem készült (visszafordíthatatlan)"}
CLEAN, LEAKING = "a KÉSZ FÁJL visszaolvasva tiszta — eredeti név nem maradt benne", " BENNMARADT NÉV — a fájl NEM készült el"
NO_RUN = "NEM FUTOTT — {}; csak a szerkezeti felismerés dolgozott"
MODEL_STATES = {"missing": "nincs telepítve", "off": "kikapcsolva", "failed": "HIBA: "}
TITLES = {"replaced": "MIT CSERÉLTÜNK (fajtánként)", "automatic": "AMIRŐL A PROGRAM DÖNTÖTT EMBER HELYETT", "warnings": "FIGYELMEZTETÉSEK"}
CLOSING = (
    "A ki-kicsoda megfeleltetést ez a jegyzőkönyv SZÁNDÉKOSAN nem tartalmazza: az a",
    "titkosított kulcsfájlba (.szkulcs) kerül, jelszóval védve. Enélkül a tábla",
    "titkosítatlanul feküdne az anonimizált irat mellett, és a mappa kiküldésével",
    "minden kiküldve lenne.",
    "",
    "A kimenet álnevesített, nem anonimizált, amennyiben a kulcsfájl fennmarad.",
    "A kulcsfájl önmagában is személyes adat: külön, titkosítva kell tárolni.",
)
WIDTH = 34


def _choose(column: Column, values: dict) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(column == F.lit(k), F.lit(v)).otherwise(out)
    return out


def _join(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def cast_lines(documents: DataFrame, parties: DataFrame, hits: DataFrame, case: str = "case_id", document: str = "document_no") -> DataFrame:
    """(case, document, lines array<string>): for each kind how many of the case's parties there are and how often the document
    has them; then amounts and dates.

    ``hits`` (case, document, entity_id, kind, disposition, decision): accepted ones count. Parties that are skipped don't.
    """
    by = [case, document]
    taken = hits.where(accepted(F.col("decision"), F.col("disposition")))
    label = F.when((F.col("kind") == "identifier") & F.col("identifier_kind").isNotNull(), _join("azonosító — ", _choose(F.col("identifier_kind"), IDENTIFIERS["hu"]))).otherwise(_choose(F.col("kind"), KINDS))
    named = parties.where("NOT coalesce(skipped, false)").select(case, F.col("id").alias("entity_id"), label.alias("label"))
    size = named.groupBy(case, "label").agg(F.count("*").alias("parties"))
    seen = taken.groupBy(*by, "entity_id").agg(F.count("*").alias("n")).join(named, [case, "entity_id"]).groupBy(*by, "label").agg(F.sum("n").alias("n"))
    rows = documents.select(*by).join(size, case).join(seen, [*by, "label"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    padded = lambda c: F.rpad(c, F.greatest(F.length(c), F.lit(WIDTH)), " ")
    line = _join(padded(F.col("label")), " ", F.col("parties"), " fél, ", F.col("n"), " előfordulás")
    listed = rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.lower(fold(F.col("label"))).alias("s"), F.col("label").alias("t"), line.alias("line")))), lambda x: x["line"]).alias("named"))
    other = taken.groupBy(*by).agg(F.count_if(F.col("kind") == "amount").alias("amounts"), F.count_if(F.col("kind") == "date").alias("dates"))
    more = lambda c, what, done: F.when(F.col(c) > 0, F.array(_join(padded(F.lit(what)), " ", F.col(c), f" előfordulás {done}"))).otherwise(F.array().cast("array<string>"))
    both = documents.select(*by).join(listed, by, "left").join(other, by, "left")
    return both.select(*by, F.concat(F.coalesce("named", F.array().cast("array<string>")), more("amounts", "pénzösszeg", "átírva"), more("dates", "dátum", "eltolva")).alias("lines"))


def ledger(documents: DataFrame, hits: DataFrame, parties: DataFrame, reports: DataFrame, case: str = "case_id", document: str = "document_no") -> DataFrame:
    """Documents with what their certificate says: counts over their hits, lines by kind, the program's own decisions, the gate's report.

    ``hits`` have unit_no, start, surface, replacement, reason, context, common_word, disposition, decision, by_program too;
    ``reports`` (case, document, leaks array<string>, residual_total, checked_chars). A document without hits or report has none.
    """
    by = [case, document]
    decision, disposition = F.col("decision"), F.col("disposition")
    item = F.struct("unit_no", "start", "surface", "replacement", "common_word", "reason", "context")
    counted = hits.groupBy(*by).agg(
        F.count_if(accepted(decision, disposition)).alias("replaced"),
        F.count_if(undecided(decision, disposition)).alias("pending"),
        F.count_if(F.col("by_program") & (decision == "skip")).alias("kept_by_program"),
        F.array_sort(F.collect_list(F.when(F.col("by_program") & (decision == "accept"), item))).alias("automatic"),
    )
    whole = documents.join(counted, by, "left").join(cast_lines(documents, parties, hits, case, document), by, "left").join(reports, by, "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("replaced", "pending", "kept_by_program", "residual_total", "checked_chars")}
    return whole.withColumns(zero | {"leaks": F.coalesce("leaks", F.array().cast("array<string>"))})


def model_line(state: Column, found: Column, unread: Column, message: Column) -> Column:
    """How the language model did: it ran and found so many, or why it did not; and how many of its findings could not be read."""
    why = F.when(state == "failed", _join(MODEL_STATES["failed"], F.coalesce(message, F.lit("")))).otherwise(_choose(state, MODEL_STATES))
    ran = _join("futott (", F.coalesce(found, F.lit(0)), " találat)")
    start, end = NO_RUN.split("{}")
    tail = F.when(unread > 0, _join("; ", unread, " találatát nem tudtuk értelmezni")).otherwise("")
    return F.concat(F.when(state == "ok", ran).otherwise(_join(start, F.coalesce(why, F.lit("")), end)), tail)


def certificate(made_at: Column) -> Column:
    """The certificate of a ``ledger`` row (with source_name, format, pages, chars, mode, keep_key, model, warnings)."""
    c = F.col
    leaks, automatic = F.size("leaks"), c("automatic")
    none = F.array().cast("array<string>")
    head = F.array(
        F.lit(HEADER),
        F.lit(""),
        _join("Forrásfájl:            ", c("source_name")),
        _join("Formátum:              ", F.upper("format"), ", ", c("pages"), " oldal, ", c("chars"), " karakter"),
        _join("Csere módja:           ", F.coalesce(_choose(c("mode"), MODES), F.lit(""))),
        _join("Kulcsfájl:             ", F.coalesce(_choose(c("keep_key"), KEY_LINE), F.lit(KEY_LINE[False]))),
        _join("Nyelvi modell:         ", F.coalesce("model", F.lit(""))),
        F.lit(""),
        _join("Lecserélt előfordulás: ", c("replaced")),
        _join("Eldöntetlen találat:   ", c("pending")),
        _join("Program döntötte el:   ", F.coalesce(F.size(automatic), F.lit(0)), " bizonytalan találat (ember helyett)"),
        _join("Program bent hagyta:   ", c("kept_by_program"), " elutasított találat (a szövegkörnyezet szerint köznév)"),
        _join("Ellenőrzött karakter:  ", c("checked_chars")),
        _join("Gyanús maradvány:      ", c("residual_total"), " (emberi átnézésre)"),
        _join("Ellenőrző kör:         ", F.when(leaks == 0, CLEAN).otherwise(_join(leaks, LEAKING))),
        F.lit(""),
        F.lit(TITLES["replaced"]),
    )
    common = F.size(F.filter(automatic, lambda a: F.coalesce(a["common_word"], F.lit(False))))
    summary = _join("  ", F.size(automatic), " bizonytalan találatot a program fogadott el emberi döntés nélkül", F.when(common > 0, _join(", ebből ", common, " köznévvel azonos alakú (valószínűleg fölösleges csere)")).otherwise(""), ".")

    def item(a: Column) -> Column:
        what = _join('  - "', a["surface"], '" → ', F.coalesce(a["replacement"], F.lit("(nincs csere)")), F.when(F.coalesce(a["common_word"], F.lit(False)), " [köznév is]").otherwise(""))
        return F.array(_join(what, " — ", a["unit_no"] + 1, ". oldal, ", F.coalesce(a["reason"], F.lit(""))), _join("      ", F.coalesce(a["context"], F.lit(""))))

    own = F.when(F.size(automatic) > 0, F.concat(F.array(F.lit(""), F.lit(TITLES["automatic"]), summary), F.flatten(F.transform(automatic, item)))).otherwise(none)
    warned = F.when(F.size("warnings") > 0, F.concat(F.array(F.lit(""), F.lit(TITLES["warnings"])), F.transform("warnings", lambda w: _join("  - ", w)))).otherwise(none)
    end = F.array(F.lit(""), *map(F.lit, CLOSING), F.lit(""), _join("Készült: ", F.date_format(made_at, "yyyy-MM-dd HH:mm:ss")))
    lines = F.concat(head, F.transform(F.coalesce("lines", none), lambda x: _join("  ", x)), own, warned, end)
    return F.array_join(lines, "\n")


def certificate_names(documents: DataFrame, taken: DataFrame | None = None, case: str = "case_id", name: str = "file_name", source: str = "source_name", order: str = "document_no") -> DataFrame:
    """Documents with ``certificate_name``: the output's stem and ``-jegyzokonyv.txt``, numbered from 2 where the name has another owner.

    ``taken`` (case, file_name, source): what lies in the case's folder, with the source file of certificates (null for other
    files). A certificate of the same source is replaced, anything else stays. Documents that share a stem are taken in order; a
    fold over one stem's documents, of which there may be ``MOST_NAMES``.
    """
    stem = F.regexp_replace(F.col(name), r"\.[^.]+$", "")
    rows = documents.withColumn("_stem", stem)
    here = rows.groupBy(case, "_stem").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("no"), F.coalesce(source, F.lit("")).alias("source")))).alias("docs"))
    if taken is not None:
        pattern = rf"^(.*){SUFFIX}(?:-([1-9]\d*))?\.txt$"
        known = taken.select(case, F.regexp_extract("file_name", pattern, 1).alias("_stem"), F.coalesce(F.expr("try_cast(nullif(regexp_extract(file_name, '" + pattern.replace("\\", "\\\\") + "', 2), '') AS int)"), F.lit(1)).alias("n"), F.col("source").alias("owner")).where("_stem <> ''")
        here = here.join(known.groupBy(case, "_stem").agg(F.collect_set(F.struct("n", "owner")).alias("used")), [case, "_stem"], "left")
    else:
        here = here.withColumn("used", F.lit(None))
    kind = "array<struct<n:int,owner:string>>"
    start = F.struct(F.coalesce(F.col("used").cast(kind), F.array().cast(kind)).alias("used"), F.array().cast("array<struct<no:bigint,n:int>>").alias("given"))

    def step(state: Column, doc: Column) -> Column:
        free = F.filter(F.sequence(F.lit(1), F.size(state["used"]) + 1), lambda n: ~F.exists(state["used"], lambda u: (u["n"] == n) & ~u["owner"].eqNullSafe(doc["source"])))
        n = F.element_at(free, 1)
        return F.struct(F.array_append(state["used"], F.struct(n.alias("n"), doc["source"].alias("owner"))).alias("used"), F.array_append(state["given"], F.struct(doc["no"].cast("long").alias("no"), n.alias("n"))).alias("given"))

    numbered = here.select(case, "_stem", F.explode(F.aggregate("docs", start, step)["given"]).alias("g")).select(case, "_stem", F.col("g.no").alias(order), F.col("g.n").alias("_n"))
    shown = _join(F.col("_stem"), SUFFIX, F.when(F.col("_n") > 1, _join("-", F.col("_n"))).otherwise(""), ".txt")
    too_many = F.raise_error(F.lit("no free name for a certificate"))
    return rows.join(numbered, [case, "_stem", order]).withColumn("certificate_name", F.when(F.col("_n") <= MOST_NAMES, shown).otherwise(too_many)).drop("_stem", "_n")


class Exports:
    """Export runs in a folder that all executors share: ``run=<n>/{documents,certificates,keys,held_back}``."""

    TABLES = ("documents", "certificates", "keys", "held_back")

    def __init__(self, spark: SparkSession, path: str, case: str = "case_id"):
        self.spark, self.folders, self.case = spark, Staged(spark, path, "run"), case

    def read(self, table: str, run: int | None = None) -> DataFrame | None:
        """A table of one run, or of all with their number in ``run``; none if there is no run."""
        chosen = [n for n in self.folders.numbers() if run in (None, n)]
        if not chosen:
            return None
        return self.spark.read.option("basePath", self.folders.root).parquet(*(f"{self.folders.path(n)}/{table}" for n in chosen))

    def latest(self, table: str = "documents") -> DataFrame | None:
        """Each name's file in the latest run that has it."""
        rows = self.read(table)
        if rows is None:
            return None
        return rows.withColumn("_r", F.row_number().over(Window.partitionBy(self.case, "file_name").orderBy(F.desc("run")))).where("_r = 1").drop("_r")

    def taken(self) -> DataFrame | None:
        rows = self.latest("certificates")
        return None if rows is None else rows.select(self.case, "file_name", "source")

    def export(self, ledger: DataFrame, run: int, made_at: Column, mapping: DataFrame | None = None, passphrase: str = "", salt: bytes | None = None, taken: DataFrame | None = None) -> bool:
        """One run over ``ledger`` rows (with path, content); ``mapping`` (case, entity_id, original, replacement) goes into the keys of
        cases that keep one and have a document that passed. False if the run is there already.

        All four tables and the certificates' names are read off the ledger, so it is worked out once and held until they are written."""
        if run in self.folders.numbers():
            return False
        if mapping is not None:
            salt = salt or keyfile.new_salt()
            keyfile.key(passphrase, salt)
        named = ledger.withColumns({"file_name": export_name(F.col("path"), F.col("mode")), "source_name": F.element_at(F.split("path", "/"), -1)})
        with held(named, "ledger") as rows:
            return self.folders.commit(run, lambda folder: self._write(folder, rows, made_at, mapping, passphrase, salt, taken))

    def _write(self, folder: str, named: DataFrame, made_at: Column, mapping: DataFrame | None, passphrase: str, salt: bytes | None, taken: DataFrame | None) -> None:
        case = self.case
        clean = named.where(F.size("leaks") == 0)
        ours = self.taken()
        used = ours if taken is None else taken if ours is None else ours.unionByName(taken)
        written = certificate_names(clean, used, case).withColumn("certificate", certificate(made_at))
        sealed = None
        if mapping is not None:
            kept = clean.where("keep_key").select(case).distinct()
            sealed = keyfile.seal(mapping.join(kept, case, "left_semi"), passphrase, salt, keep=(case,))
        out = {
            "documents": clean.select(case, "document_no", "file_name", "content"),
            "certificates": written.select(case, "document_no", F.col("certificate_name").alias("file_name"), F.col("source_name").alias("source"), F.col("certificate").alias("content")),
            "keys": sealed if sealed is not None else named.select(case, F.lit(None).cast("binary").alias("salt"), F.lit(None).cast("binary").alias("sealed")).where("false"),
            "held_back": named.where(F.size("leaks") > 0).select(case, "document_no", F.col("source_name").alias("source"), "leaks"),
        }
        for table, rows in out.items():
            rows.write.parquet(f"{folder}/{table}")
