"""Documents from files: a content gate on their first bytes, then text units."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The Office namespace, kinds of parts by name (the first that fits), parts that hold text.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARTS = (
    ("document", r"^word/document\d*\.xml$"), ("header", r"^word/header\d*\.xml$"), ("footer", r"^word/footer\d*\.xml$"), ("footnotes", r"^word/footnotes\.xml$"),
    ("endnotes", r"^word/endnotes\.xml$"), ("comments", r"^word/comments\w*\.xml$"), ("people", r"^word/people\.xml$"), ("settings", r"^word/settings\.xml$"),
    ("styles", r"^word/styles\w*\.xml$"), ("numbering", r"^word/numbering\.xml$"), ("fonts", r"^word/fontTable\.xml$"), ("theme", r"^word/theme/"), ("media", r"^word/media/"),
    ("embedding", r"^word/embeddings/"), ("chart", r"^word/charts/"), ("diagram", r"^word/diagrams/"), ("glossary", r"^word/glossary/"), ("custom_xml", r"^customXml/"),
    ("core_properties", r"^docProps/core\.xml$"), ("app_properties", r"^docProps/app\.xml$"), ("custom_properties", r"^docProps/custom\.xml$"), ("thumbnail", r"^docProps/thumbnail"),
    ("relationships", r"\.rels$"), ("content_types", r"^\[Content_Types\]\.xml$"),
)
TEXT_PARTS = ("document", "header", "footer", "footnotes", "endnotes", "comments")


def part_kind(name: Column) -> Column:
    out = F.lit("other")
    for kind, pattern in reversed(PARTS):
        out = F.when(name.rlike(pattern), kind).otherwise(out)
    return out


def gate(content: Column, extension: Column) -> Column:
    """Null if the bytes may be read as their extension says, else what is wrong."""
    head, four_kb, eight_kb = F.hex(F.substring(content, 1, 8)), F.substring(content, 1, 4096), F.hex(F.substring(content, 1, 8192))
    is_zip, word = F.startswith(head, F.lit("504B0304")), F.contains(F.hex(four_kb), F.lit("776F72642F"))
    utf16 = F.startswith(head, F.lit("FFFE")) | F.startswith(head, F.lit("FEFF"))
    zeros = F.regexp_like(eight_kb, F.lit("^(?:..)*?00"))
    return (
        F.when(F.length(content) == 0, "empty")
        .when(F.startswith(head, F.lit("D0CF11E0A1B11AE1")), "old binary office file")
        .when(F.startswith(head, F.lit("7B5C727466")), "rich text")
        .when(F.startswith(head, F.lit("25504446")), F.when(extension == "pdf", None).otherwise("a pdf by another name"))
        .when(is_zip & word, None)
        .when(is_zip & F.contains(F.hex(four_kb), F.lit("6F70656E646F63756D656E74")), "open document")
        .when(is_zip & F.contains(F.hex(four_kb), F.lit("786C2F")), "spreadsheet")
        .when(is_zip & F.contains(F.hex(four_kb), F.lit("7070742F")), "presentation")
        .when(is_zip, "unknown archive")
        .when(extension.isin("pdf", "docx"), "not what its name says")
        .when(zeros & ~utf16, "binary")
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, extension, content, error) of all files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("extension", extension).withColumn("error", gate(F.col("content"), F.col("extension")))


def _paragraphs(xml: bytes) -> str:
    """Text of a part: runs joined, breaks and tabs as such, a line for each paragraph; deleted runs are left out."""
    out: list[str] = []

    def walk(node, deleted: bool) -> None:
        tag = node.tag.removeprefix(W)
        if tag == "t" and not deleted:
            out.append(node.text or "")
        elif tag in ("tab", "br", "cr"):
            out.append("\t" if tag == "tab" else "\n")
        for child in node:
            if child.tag != "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback":
                walk(child, deleted or tag in ("del", "moveFrom"))
        if tag == "p":
            out.append("\n")

    walk(ElementTree.fromstring(xml), False)
    return "".join(out).rstrip("\n")


def docx_units(content: bytes) -> list[tuple[int, str, str, str]]:
    """(unit_no, part, kind, text) of a package's text-bearing parts that are not blank, and nothing for a broken package."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            named = [(n, next((k for k, p in PARTS if re.search(p, n)), "other")) for n in z.namelist()]
            parts = sorted(((TEXT_PARTS.index(k), n) for n, k in named if k in TEXT_PARTS))
            texts = [(n, TEXT_PARTS[k], _paragraphs(z.read(n))) for k, n in parts]
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
        return []
    return [(i, n, k, t) for i, (n, k, t) in enumerate(x for x in texts if x[2].strip())]


def revisions(content: bytes) -> int:
    """Tracked changes that are still open."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return sum(len(re.findall(rb"<w:(?:ins|del|moveFrom|moveTo)\b", z.read(n))) for n in z.namelist() if re.search(r"^word/(document|header|footer|footnotes|endnotes)\d*\.xml$", n))


def units(files: DataFrame) -> DataFrame:
    """(path, unit_no, part, kind, text): text units of files that pass the gate; a text file is one unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *u) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for u in docx_units(c)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names=["path", "unit_no", "part", "kind", "text"])

    good = files.where("error IS NULL")
    plain = good.where(~F.col("extension").isin("pdf", "docx")).select("path", F.lit(0).alias("unit_no"), F.lit("").alias("part"), F.lit("text").alias("kind"), F.decode("content", "UTF-8").alias("text"))
    return good.where("extension = 'docx'").select("path", "content").mapInArrow(run, "path string, unit_no int, part string, kind string, text string").unionByName(plain)


def looks_scanned(docs: DataFrame) -> DataFrame:
    """(path, scanned) from (path, format, pages, chars): a pdf with under forty characters a page."""
    return docs.select("path", ((F.col("format") == "pdf") & (F.col("chars") < 40 * F.col("pages"))).alias("scanned"))
