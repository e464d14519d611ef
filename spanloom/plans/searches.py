"""Queries over search texts, words that are names, and carriers of text in packages; texts and files vary by row."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.batches import batched, each
from spanloom.operators import names, search, shaping
from spanloom.plans.carrier import people, people_sql
from spanloom.sources import carriers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


#: A given name broken at a line's end, by a hyphen or a soft one, with up to two blanks before what follows.
_BROKEN = "substr(given, 1, 2) || CASE WHEN k % 2 = 0 THEN '-' ELSE chr(173) END || chr(10) || repeat(' ', CAST(k % 3 AS INT)) || substr(given, 3)"
_ONE = f"surname || ' ' || {_BROKEN} || ' tanú.'"
_TWO = f"surname || ' ' || {_BROKEN} || ' tanú, ' || given || 'val és ' || given || '.'"
_BREAK = "(2 + k % 3)"


@query(f"""WITH {people_sql()}, t AS (SELECT k, surname, given, {_BROKEN} AS broken, length(surname) AS ls, length(given) AS lg, {_BREAK} AS lb FROM people)
SELECT k, given AS needle, CAST(ls + 1 AS INT) AS start, CAST(ls + 1 + lg + lb AS INT) AS "end", broken AS surface FROM t
UNION ALL SELECT k, given, CAST(ls + 15 + 2 * lg + lb AS INT), CAST(ls + 15 + 3 * lg + lb AS INT), given FROM t
UNION ALL SELECT k, surname, 0, CAST(ls AS INT), surname FROM t WHERE k % 4 = 0""")
def search_offsets(spark, sf_dir):
    rows = people(spark, sf_dir)
    needles = rows.select("k", F.col("given").alias("needle")).unionByName(rows.where("k % 4 = 0").select("k", F.col("surname").alias("needle")))
    return search.occurrences(rows.selectExpr("k", f"{_TWO} AS text"), needles, "k")


@query(f"""WITH {people_sql()} SELECT k, 0 AS start, CAST(length(surname) + 1 + length(given) + {_BREAK} AS INT) AS "end", surname || ' ' || {_BROKEN} AS surface, 'full' AS core, 'NOM' AS case_tag FROM people""")
def hyphenated_mentions(spark, sf_dir):
    rows = people(spark, sf_dir)
    persons = rows.select("k", F.lit("p").alias("id"), F.lit("person").alias("kind"), F.lit("").alias("name"), "surname", "given")
    return names.match(rows.selectExpr("k", f"{_ONE} AS text"), persons, "k", []).select("k", "start", "end", "surface", "core", "case_tag")


#: Words of the language: some surnames and given names, a few of them in capitals.
_WORDS = "SELECT CASE WHEN k % 3 = 0 THEN upper(surname) ELSE surname END AS word FROM people WHERE k % 10 < 4 UNION ALL SELECT given FROM people WHERE (k * 7) % 11 < 3"
_CORE = "CASE k % 7 WHEN 0 THEN 'surname' WHEN 1 THEN 'family' WHEN 2 THEN 'wife_surname' WHEN 3 THEN 'maiden_surname' WHEN 4 THEN 'given' WHEN 5 THEN 'full' ELSE 'identifier' END"
_SURFACE = "CASE k % 5 WHEN 0 THEN surname WHEN 1 THEN upper(given) WHEN 2 THEN surname || 'val' ELSE given || 'nak' END"


@query(f"""WITH {people_sql()}, w AS (SELECT DISTINCT lower(word) AS word FROM ({_WORDS})),
h AS (SELECT k, {_CORE} AS core, {_SURFACE} AS surface, surname, given, k % 9 <> 0 AS person FROM people)
SELECT k, core, surface, lower(surface) IN (SELECT word FROM w) OR (person AND CASE WHEN core IN ('surname', 'family', 'wife_surname') THEN lower(surname) IN (SELECT word FROM w)
WHEN core IN ('maiden_surname', 'given') THEN lower(given) IN (SELECT word FROM w) ELSE false END) AS common_word FROM h""")
def common_word_hits(spark, sf_dir):
    rows = people(spark, sf_dir)
    hits = rows.selectExpr("k", "'e' AS entity_id", f"{_CORE} AS core", f"{_SURFACE} AS surface")
    entities = rows.selectExpr("k", "'e' AS id", "CASE WHEN k % 9 = 0 THEN 'org' ELSE 'person' END AS kind", "surname", "given", "given AS maiden")
    words = rows.where("k % 10 < 4").selectExpr("CASE WHEN k % 3 = 0 THEN upper(surname) ELSE surname END AS word").unionByName(rows.where("(k * 7) % 11 < 3").selectExpr("given AS word"))
    return shaping.with_common_words(hits, entities, words, "k").drop("entity_id")


_SPACES = " ".join(f'xmlns:{prefix}="{uri}"' for uri, prefix in carriers.PREFIXES.items())


def _package(k: int, surname: str, given: str) -> bytes:
    """A package of one customer with a name in each sort of part; what it carries is told by ``_CARRIED``."""
    removed = f"<w:p><w:del><w:r><w:delText>{given}</w:delText></w:r></w:del></w:p>" * (k % 2)
    body = f'<w:p><w:bookmarkStart w:id="0" w:name="{surname if k % 3 else "_GoBack"}"/><w:r><w:t>{surname}</w:t><w:tab/><w:t>{given}</w:t></w:r></w:p><w:p><w:r><w:instrText>MERGEFIELD {given}</w:instrText></w:r></w:p>{removed}'
    parts = {
        "word/document.xml": f"<w:document {_SPACES}><w:body>{body}</w:body></w:document>",
        "word/people.xml": f'<w15:people {_SPACES}><w15:person w15:author="{surname} {given}"/></w15:people>',
        "word/_rels/document.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="mailto:{k}@x.hu"/></Relationships>',
        "customXml/item1.xml": f"<a><b>{given}</b><c>{surname}</c></a>",
        "docProps/core.xml": f"<cp:coreProperties {_SPACES}><dc:creator>{surname}</dc:creator><dc:language>hu</dc:language></cp:coreProperties>",
        "word/charts/chart1.xml": f"<c:chart {_SPACES}><c:pt><c:v>{surname}</c:v></c:pt><c:pt><c:v>{k}</c:v></c:pt></c:chart>",
        "word/media/image1.png": surname,
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def named_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a package for each customer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(((str(k), _package(k, surname, given)) for k, surname, given in each(batches)), ["path", "content"], [pa.string(), pa.binary()])

    return people(spark, sf_dir).select("k", "surname", "given").mapInArrow(run, "path string, content binary")


#: (part, profile, no, kind, element, attribute, start, content, when)
_DOC = "word/document.xml", "words"
_CARRIED = (
    (*_DOC, "0", "text", "w:t", None, "0", "surname", "true"),
    (*_DOC, "1", "text", "w:t", None, "ls + 1", "given", "true"),
    (*_DOC, "2", "instr", "w:instrText", None, "ls + lg + 2", "'MERGEFIELD ' || given", "true"),
    (*_DOC, "3", "del", "w:delText", None, "ls + 2 * lg + 15", "given", "k % 2 = 1"),
    (*_DOC, "3 + k % 2", "attr", "w:bookmarkStart", "w:name", "ls + 2 * lg + 15 + (k % 2) * (lg + 2)", "surname", "k % 3 <> 0"),
    ("word/people.xml", "people", "0", "attr", "w15:person", "w15:author", "0", "surname || ' ' || given", "true"),
    ("word/_rels/document.xml.rels", "links", "0", "attr", "Relationship", "Target", "0", "'mailto:' || k || '@x.hu'", "true"),
    ("customXml/item1.xml", "data", "0", "text", "b", None, "0", "given", "true"),
    ("customXml/item1.xml", "data", "1", "text", "c", None, "lg + 1", "surname", "true"),
    ("docProps/core.xml", "properties", "0", "text", "dc:creator", None, "0", "surname", "true"),
    ("word/charts/chart1.xml", "chart", "0", "text", "c:v", None, "0", "surname", "true"),
    ("word/charts/chart1.xml", "chart", "1", "text", "c:v", None, "ls + 1", "CAST(k AS VARCHAR)", "true"),
)
_LONG = "l AS (SELECT *, length(surname) AS ls, length(given) AS lg FROM people)"
_ROWS = " UNION ALL ".join(
    f"SELECT k, surname, '{part}' AS part, '{profile}' AS profile, CAST({no} AS INT) AS no, '{kind}' AS kind, '{element}' AS element, {f"'{attribute}'" if attribute else 'CAST(NULL AS VARCHAR)'} AS attribute, CAST({start} AS INT) AS start, {content} AS content FROM l WHERE {when}"
    for part, profile, no, kind, element, attribute, start, content, when in _CARRIED
)


@query(f'WITH {people_sql()}, {_LONG} SELECT CAST(k AS VARCHAR) AS path, part, profile, no, kind, element, attribute, start, CAST(start + length(content) AS INT) AS "end", content FROM ({_ROWS})')
def carrier_rows(spark, sf_dir):
    return carriers.rows(named_packages(spark, sf_dir))


@query(f"WITH {people_sql()}, {_LONG} SELECT CAST(k AS VARCHAR) AS path, part, no, kind, CASE WHEN content = surname THEN 'N' || k ELSE content END AS content FROM ({_ROWS})")
def carrier_edits(spark, sf_dir):
    files = named_packages(spark, sf_dir)
    named = people(spark, sf_dir).select(F.col("k").cast("string").alias("path"), "surname")
    edits = carriers.rows(files).join(named.hint("merge"), "path").where("content = surname").select("path", "part", "start", "end", F.concat(F.lit("N"), "path").alias("replacement"))
    return carriers.rows(carriers.edited(files, edits)).select("path", "part", "no", "kind", "content")
