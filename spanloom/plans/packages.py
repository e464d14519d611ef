"""Queries over files whose content Spark makes from the given tables: PDF streams, Office packages, search texts."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.batches import batched, each
from spanloom.plans.carrier import people, people_sql, table
from spanloom.sources import docx, pdfstate, structure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


#: The letters of the carrier's names. A second font has no table for one of them.
LETTERS = "".join(sorted(set("KovácsSzabóNagyTóthKissNémethFarkasBaloghPappMolnárJánosAnnaPéterTündeJózsefMáriaÖdönErzsébetBalázsIlonaGábor")))
LOST = "á"


def pdf_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(pages, streams, objects, fonts): two pages for each customer. The page draws its surname and calls a header, under a moved
    matrix; the header shows the given name in two fonts, calls itself, a scaled inner form (even keys) or a name that stands for
    nothing (odd keys), and an image. Every third inner form uses a font that nobody knows."""
    rows = people(spark, sf_dir).select("k", "surname", "given")
    hexed = lambda c: F.hex(F.encode(F.col(c), "UTF-16BE"))
    said = lambda *parts: F.encode(F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), "UTF-8")
    k = F.col("k")
    page = said("q BT /F1 11 Tf 1 0 0 1 72 600 Tm <", hexed("surname"), "> Tj ET Q q 1 0 0 1 ", k % 50, " 20 cm /Header Do Q BT /F1 9 Tf 72 ", k % 30, " Td (", F.lit("\\000x"), ") Tj [<", hexed("given"), "> -120] TJ ET")
    header = said("BT /F1 12 Tf 14 TL 1 0 0 1 5 5 Tm <", hexed("given"), "> Tj T* <", hexed("surname"), "> Tj /F2 8 Tf 0 -6 Td <", hexed("given"), "> Tj ET /Self Do /Inner Do /Picture Do")
    inner = said("BT /", F.when(k % 3 == 0, "F9").otherwise("F1"), " 10 Tf 3 4 Td <", hexed("surname"), "> ' ET")
    streams = [("page", page, None), ("header", header, (1, 0, 0, 1, 50, 700)), ("inner", inner, (2, 0, 0, 2, 0, 0))]
    shaped = [rows.select(k.alias("file"), F.lit(i).alias("stream_id"), c.alias("content"), (F.array(*(F.lit(float(x)) for x in m)) if m else F.lit(None).cast("array<double>")).alias("matrix")) for i, c, m in streams]
    named = [("page", "Header", "form", "header", "true"), ("header", "Self", "form", "header", "true"), ("header", "Inner", "form", "inner", "k % 2 = 0"), ("header", "Picture", "image", None, "true")]
    objects = [rows.where(w).select(k.alias("file"), F.lit(s).alias("stream_id"), F.lit(n).alias("name"), F.lit(kind).alias("kind"), F.lit(t).cast("string").alias("target")) for s, n, kind, t, w in named]
    whole = F.create_map(*(F.lit(x) for c in LETTERS for x in (ord(c), c)))
    holed = F.create_map(*(F.lit(x) for c in LETTERS if c != LOST for x in (ord(c), c)))
    fonts = [rows.select(k.alias("file"), F.lit(s).alias("stream_id"), F.lit(f).alias("name"), F.lit(f"AAAAAA+{f}").alias("base_font"), F.lit(2).alias("width"), m.alias("chars")) for s in ("page", "header", "inner") for f, m in (("F1", whole), ("F2", holed))]
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    pages = rows.select(k.alias("file"), F.explode(F.array(F.lit(0), F.lit(1))).alias("page"), F.lit("page").alias("stream_id"))
    return pages, union(shaped), union(objects), union(fonts)


_PAGES = "p AS (SELECT k, surname, given, page FROM people, (VALUES (0), (1)) AS v(page))"


@query(f"""WITH {people_sql()}, {_PAGES}, s AS (
SELECT k, page, 1 AS o, 'page' AS stream_id, 72 AS x, 600 AS y, 11 AS size, surname AS text FROM p
UNION ALL SELECT k, page, 2, 'header', 55 + k % 50, 725, 12, given FROM p
UNION ALL SELECT k, page, 3, 'header', 55 + k % 50, 711, 12, surname FROM p
UNION ALL SELECT k, page, 4, 'header', 55 + k % 50, 705, 8, replace(given, '{LOST}', '') FROM p
UNION ALL SELECT k, page, 5, 'inner', 50 + k % 50 + 6, 720 + 8, 20, surname FROM p WHERE k % 2 = 0 AND k % 3 <> 0
UNION ALL SELECT k, page, 6, 'page', 72, k % 30, 9, given FROM p)
SELECT k AS file, page, CAST(row_number() OVER (PARTITION BY k, page ORDER BY o) AS INT) AS no, stream_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(size AS DOUBLE) AS size, text FROM s""")
def pdf_segments(spark, sf_dir):
    return pdfstate.extract(*pdf_pages(spark, sf_dir))[0].drop("at", "end")


_WARNED = f"""w AS (SELECT k AS file, page, 'skipped' AS kind, 'header' AS name, 1 AS n FROM p UNION ALL SELECT k, page, 'unopened', 'Inner', 1 FROM p WHERE k % 2 = 1
UNION ALL SELECT k, page, 'partial', 'AAAAAA+F2', length(given) - length(replace(given, '{LOST}', '')) FROM p WHERE contains(given, '{LOST}')
UNION ALL SELECT k, page, 'blind', 'F9', length(surname) FROM p WHERE k % 6 = 0
UNION ALL SELECT k, page, 'partial', 'AAAAAA+F1', 1 FROM p)"""


@query(f"WITH {people_sql()}, {_PAGES}, {_WARNED} SELECT file, page, kind, name, CAST(n AS BIGINT) AS n FROM w")
def pdf_warnings(spark, sf_dir):
    return pdfstate.extract(*pdf_pages(spark, sf_dir))[1]


def _sentence(kind: str, text: str) -> str:
    return f"CASE WHEN n_{kind} > 0 THEN 'A 1. és 2. oldalon ' || n_{kind} || '{text}' || chr(10) ELSE '' END"


@query(f"""WITH {people_sql()}, {_PAGES}, {_WARNED}, s AS (SELECT file, {", ".join(f"coalesce(sum(n) FILTER (WHERE kind = '{k}'), 0) AS n_{k}" for k in ("blind", "partial", "skipped", "unopened"))} FROM w GROUP BY file)
SELECT file, rtrim(CASE WHEN n_blind > 0 THEN 'A 1. és 2. oldalon 1{pdfstate.BLIND.split("{}")[0]}' || n_blind || '{pdfstate.BLIND.split("{}")[1]}F9.' || chr(10) ELSE '' END || {_sentence("partial", pdfstate.PARTIAL)} || {_sentence("skipped", pdfstate.SKIPPED)} || {_sentence("unopened", pdfstate.UNOPENED)}, chr(10)) AS messages FROM s""")
def pdf_messages(spark, sf_dir):
    return pdfstate.messages(pdfstate.extract(*pdf_pages(spark, sf_dir))[1]).withColumn("messages", F.array_join("messages", "\n"))


_NO = "CAST(l_orderkey AS BIGINT) * 1000000000000 + (CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT)"
_X = "72 + CAST(l_partkey % 7 AS DOUBLE) * 5.3"


@query(f"""WITH l AS (SELECT o_custkey AS doc, l_orderkey AS paragraph, {_NO} AS no, {_X} AS x, CAST(l_quantity AS BIGINT) AS start FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT doc, paragraph, floor(arg_min(x, no) + 0.5) AS x, arg_min(start, no) AS start, count(*) AS n, min(no) AS first FROM l GROUP BY ALL),
m AS (SELECT doc, x AS margin FROM (SELECT doc, x, sum(n) AS n, min(first) AS first FROM p GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, first) = 1)
SELECT doc, paragraph, start, n = 1 AND x - margin > {pdfstate.INDENT} AS center FROM p JOIN m USING (doc)""")
def preview_paragraphs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    placed = lines.selectExpr("o_custkey AS doc", "l_orderkey AS paragraph", f"{_NO} AS no", f"{_X} AS x", "CAST(l_quantity AS BIGINT) AS start")
    return pdfstate.preview_paragraphs(placed, ["doc"])


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _package(k: int, surname: str, given: str) -> bytes:
    """A package of one customer: its faults are those of ``_FAULTS``, its names stand where ``package_residues`` says."""
    link = lambda *targets: "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="{t}"/>' for i, t in enumerate(targets)) + '<Relationship Id="x" Target="https://example.org/a" TargetMode="External"/></Relationships>'
    types = '<Types><Default Extension="XML" ContentType="x"/><Default Extension="rels" ContentType="r"/>' + '<Default Extension="bin" ContentType="b"/>' * (k % 5 > 0)
    types += '<Override PartName="/word/document.xml" ContentType="d"/>' + '<Override PartName="/word/gone.xml" ContentType="g"/>' * (k % 7 == 0) + "</Types>"
    runs = "".join(f"<w:r>{'<w:rPr><w:b/></w:rPr>' * (i < k % 4)}<w:t>{c}</w:t></w:r>" for i, c in enumerate(surname))
    said = f'<w:p>{runs}<w:r><w:t xml:space="preserve"> {given[:2]}</w:t></w:r></w:p>' + f"<w:p><w:r><w:t>{surname}</w:t></w:r></w:p>" * (k % 4 + 1)
    parts = {
        structure.TYPES: types if k % 17 else None,
        "_rels/.rels": link(*["word/document.xml"] * (k % 19 > 0)),
        "word/document.xml": f"<w:document {_W}><w:body>{said}</w:body></w:document>" if k % 11 else None,
        "word/_rels/document.xml.rels": link("header1.xml", "../customXml/item1.xml", "/word/embeddings/o.bin" if k % 6 == 0 else "./header1.xml", "media/none.png" if k % 3 == 0 else "header1.xml"),
        "word/header1.xml": f"<w:hdr {_W}>{given}" + "</w:hdr>" * (k % 13 > 0),
        "customXml/item1.xml": f"<a>{given * (k % 2)}</a>",
        "word/extra.bin": surname.encode("utf-16-le") if k % 4 == 0 else None,
        "word/embeddings/o.bin": b"o" if k % 6 == 0 else None,
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            if data is not None:
                z.writestr(name, data)
    return out.getvalue()


def office_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a package for each customer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(((str(k), _package(k, surname, given)) for k, surname, given in each(batches)), ["path", "content"], [pa.string(), pa.binary()])

    return people(spark, sf_dir).select("k", "surname", "given").mapInArrow(run, "path string, content binary")


#: (fault, part, target, when): what ``_package`` does to a package that has its content types.
_REACHED = "(k % 11 <> 0 AND k % 19 <> 0)"
_FAULTS = (
    ("no document", None, None, "k % 11 = 0"),
    ("malformed", "word/header1.xml", None, "k % 13 = 0"),
    ("dead type", "word/gone.xml", None, "k % 7 = 0"),
    ("dead type", "word/document.xml", None, "k % 11 = 0"),
    ("untyped", "word/extra.bin", None, "k % 20 = 0"),
    ("untyped", "word/embeddings/o.bin", None, "k % 30 = 0"),
    ("dead link", "word/_rels/document.xml.rels", "word/media/none.png", "k % 3 = 0"),
    ("dead link", "_rels/.rels", "word/document.xml", "k % 11 = 0 AND k % 19 <> 0"),
    ("unreachable", "word/document.xml", None, "k % 11 <> 0 AND k % 19 = 0"),
    *(("unreachable", part, None, f"NOT {_REACHED}") for part in ("word/_rels/document.xml.rels", "word/header1.xml", "customXml/item1.xml")),
    ("unreachable", "word/embeddings/o.bin", None, f"k % 6 = 0 AND NOT {_REACHED}"),
    ("unreachable", "word/extra.bin", None, "k % 4 = 0"),
    ("unclassified", "word/extra.bin", None, "k % 4 = 0"),
    ("embedded", "word/embeddings/o.bin", None, "k % 6 = 0"),
)
_quoted = lambda x: "CAST(NULL AS VARCHAR)" if x is None else f"'{x}'"
_PATH = "CAST(k AS VARCHAR) AS path"


@query(f"WITH {people_sql()} SELECT {_PATH}, 'no types' AS fault, CAST(NULL AS VARCHAR) AS part, CAST(NULL AS VARCHAR) AS target FROM people WHERE k % 17 = 0 UNION ALL " + " UNION ALL ".join(f"SELECT {_PATH}, '{f}', {_quoted(p)}, {_quoted(t)} FROM people WHERE k % 17 <> 0 AND {when}" for f, p, t, when in _FAULTS))
def package_faults(spark, sf_dir):
    return structure.faults(structure.relation(office_packages(spark, sf_dir)))


@query(f"""WITH {people_sql()}, n AS (
SELECT k, 'word/document.xml' AS part, surname AS needle, k % 4 + 1 - k % 3 AS excess FROM people WHERE k % 11 <> 0
UNION ALL SELECT k, 'word/extra.bin', surname, 1 - k % 3 FROM people WHERE k % 4 = 0
UNION ALL SELECT k, 'word/header1.xml', given, 1 FROM people UNION ALL SELECT k, 'customXml/item1.xml', given, k % 2 FROM people)
SELECT {_PATH}, part, needle, CAST(excess AS BIGINT) AS excess FROM n WHERE excess > 0""")
def package_residues(spark, sf_dir):
    rows = people(spark, sf_dir).withColumn("path", F.col("k").cast("string"))
    needles = rows.select("path", F.col("surname").alias("needle"), (F.col("k") % 3).alias("allowed")).unionByName(rows.select("path", F.col("given").alias("needle"), F.lit(None).cast("long").alias("allowed")))
    return docx.residues(office_packages(spark, sf_dir), needles)


@query(f"""WITH {people_sql()} SELECT {_PATH}, CAST(length(surname) + 2 + k % 4 AS INT) AS runs_before, CAST(CASE WHEN k % 4 > 0 THEN 2 ELSE 1 END + 1 + k % 4 AS INT) AS runs_after,
surname || ' ' || substr(given, 1, 2) || repeat(chr(10) || surname, CAST(k % 4 + 1 AS INT)) AS text FROM people WHERE k % 11 <> 0""")
def merged_runs(spark, sf_dir):
    return docx.merged(office_packages(spark, sf_dir)).where("part = 'word/document.xml'").select("path", "runs_before", "runs_after", "text")
