"""Gold queries over file contents: gates, office packages, page streams and theme files. Answers are fixed values."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import themes
from spanloom.plans.carrier import GIVEN, people, pick, table
from spanloom.plans.golds import QUERIES, SQL, gold, inputs
from spanloom.sources import documents, docx, pdf
from spanloom.sources.staged import written

__all__ = ["QUERIES", "SQL"]
NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(body: str, **more: str) -> bytearray:
    """A small office package; file names have double underscores for slashes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        for name, data in more.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), data)
    return bytearray(out.getvalue())


def line(*runs: str) -> str:
    return "<w:p>" + "".join(f'<w:r w:rsidR="00A1"><w:t>{t}</w:t></w:r>' for t in runs) + "</w:p>"


#: (content, extension, what is wrong)
CONTENTS = (
    (bytearray("szöveg".encode()), "txt", None), (bytearray(b""), "txt", "empty"), (bytearray(b"%PDF-1.7"), "pdf", None), (bytearray(b"%PDF-1.7"), "txt", "a pdf by another name"),
    (bytearray(bytes.fromhex("D0CF11E0A1B11AE1")), "doc", "old binary office file"), (bytearray(b"ab\\0cd".replace(b"\\0", bytes(1))), "txt", "binary"), (package(line("a")), "docx", None),
    (bytearray(b"no zip"), "docx", "not what its name says"), (bytearray(b"{\\rtf1"), "rtf", "rich text"),
)


@gold("file_gate", len(CONTENTS), ["extension VARCHAR", "error VARCHAR"], [(i, *r[1:]) for i, r in enumerate(CONTENTS)])
def file_gate(spark, sf_dir):
    rows = inputs(spark, sf_dir, "content binary, extension string", [r[:2] for r in CONTENTS])
    return rows.select("k", "extension", documents.gate(F.col("content"), F.col("extension")).alias("error"))


#: content and edits of its text, revisions, then the text before and after, and an original that must be gone
PACKAGES = (
    (package(line("Ko", "vács Já", "nos úr") + line("vége")), [(0, 12, "Gránit Ottó"), (16, 20, "kész")], None, "Kovács János úr\nvége", "Gránit Ottó úr\nkész", "Kovács"),
    (package('<w:p><w:ins w:author="A"><w:r><w:t>új</w:t></w:r></w:ins><w:del w:author="A"><w:r><w:delText>régi</w:delText></w:r></w:del></w:p>', word__people_xml="<p>Kovács</p>"), [], "accept", "új", "új", "Kovács"),
    (package(line("Anna ", "itt")), [(0, 4, "Frida")], None, "Anna itt", "Frida itt", "Anna"),
)


@gold("package_texts", len(PACKAGES), ["before VARCHAR", "after VARCHAR", "left_over BIGINT"], [(i, r[3], r[4], 0) for i, r in enumerate(PACKAGES)])
def package_texts(spark, sf_dir):
    """Texts of office packages before and after they are rewritten, and what is left of an original in any part."""
    rows = inputs(spark, sf_dir, "content binary", [r[:1] for r in PACKAGES])
    files = rows.withColumn("path", F.concat_ws("/", F.col("k").cast("string"), F.col("case_no").cast("string"))).withColumns({"extension": F.lit("docx"), "error": F.lit(None).cast("string")})
    plans = [({"word/document.xml": r[1]} if r[1] else {}, r[2] or "accept") for r in PACKAGES]
    made = docx.rewrite_all(files, lambda path, _: plans[int(path.rsplit("/", 1)[1])][0], "accept")
    # Rewritten once, although three readers follow.
    made = written(made.where("error IS NULL").select("path", "content"), "packages")
    texts = lambda df, name: documents.units(df).where("kind = 'document'").select("path", F.col("text").alias(name))
    after = made.withColumns({"extension": F.lit("docx"), "error": F.lit(None).cast("string")})
    gone = F.element_at(F.array(*(F.lit(r[5]) for r in PACKAGES)), F.element_at(F.split("path", "/"), 2).cast("int") + 1)
    left = after.select("path", docx.residue_count(F.col("content"), gone).alias("left_over"))
    return texts(files, "before").join(texts(after, "after"), "path").join(left, "path").select(F.element_at(F.split("path", "/"), 1).cast("long").alias("k"), "before", "after", "left_over")


#: (part, kind)
PARTS = (("word/document.xml", "document"), ("word/header2.xml", "header"), ("word/footnotes.xml", "footnotes"), ("word/media/image1.png", "media"), ("docProps/core.xml", "core_properties"), ("_rels/.rels", "relationships"), ("[Content_Types].xml", "content_types"), ("word/vbaProject.bin", "other"))


@gold("part_kinds", len(PARTS), ["part VARCHAR", "kind VARCHAR"], [(i, *r) for i, r in enumerate(PARTS)])
def part_kinds(spark, sf_dir):
    return inputs(spark, sf_dir, "part string", [r[:1] for r in PARTS]).select("k", "part", documents.part_kind(F.col("part")).alias("kind"))


#: (format, pages, chars, scanned)
SCANS = (("pdf", 10, 399, True), ("pdf", 10, 400, False), ("docx", 10, 0, False))


@gold("scanned_files", len(SCANS), ["scanned BOOLEAN"], [(i, r[3]) for i, r in enumerate(SCANS)])
def scanned_files(spark, sf_dir):
    rows = inputs(spark, sf_dir, "format string, pages int, chars int", [r[:3] for r in SCANS]).withColumn("path", F.col("k").cast("string"))
    return documents.looks_scanned(rows).select(F.col("path").cast("long").alias("k"), "scanned")


#: (content stream, text)
STREAMS = ((bytearray(b"BT /F 1 Tf <1011> Tj ET"), "AB"), (bytearray(b"BT /F 1 Tf [<10> -20 <11>] TJ ET % no"), "AB"), (bytearray(b"q Q"), ""))


@gold("page_streams", len(STREAMS), ["text VARCHAR"], [(i, r[1]) for i, r in enumerate(STREAMS)])
def page_streams(spark, sf_dir):
    maps = {"F": pdf.CharacterMap.parse(b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfrange <10> <12> <0041> endbfrange")}
    return pdf.streams(inputs(spark, sf_dir, "content binary", [r[:1] for r in STREAMS]), ["k"], maps)


#: lines (x, y, width, size, stream) of a page with their paragraph and whether it is justified
LINES = (
    [(50.0, 700.0, 400.0, 11.0, "s", 0, True), (50.0, 686.0, 400.0, 11.0, "s", 0, True), (50.0, 672.0, 300.0, 11.0, "s", 0, True), (50.0, 620.0, 100.0, 11.0, "s", 1, False), (80.0, 606.0, 100.0, 11.0, "s", 2, False)],
    [(50.0, 700.0, 400.0, 11.0, "s", 0, False), (50.0, 686.0, 400.0, 11.0, "t", 1, False)],
)


@gold("page_paragraphs", len(LINES), ["no INT", "paragraph INT", "justified BOOLEAN"], [(i, no, *x[5:]) for i, r in enumerate(LINES) for no, x in enumerate(r)])
def page_paragraphs(spark, sf_dir):
    rows = inputs(spark, sf_dir, "n int", [(len(r),) for r in LINES]).select("k", "case_no")
    placed = spark.createDataFrame([(i, no, *x[:5]) for i, r in enumerate(LINES) for no, x in enumerate(r)], "case_no int, no int, x double, y double, width double, size double, stream string")
    return pdf.paragraphs(rows.join(F.broadcast(placed), "case_no").drop("case_no"), ["k"])


#: segments of a page, then (start, end) of each in its text
SEGMENTS = ((("ab", "c", "def"), ((0, 2), (3, 4), (5, 8))), (("x",), ((0, 1),)))


@gold("page_places", len(SEGMENTS), ["no INT", "start INT", "end INT"], [(i, no, *p) for i, r in enumerate(SEGMENTS) for no, p in enumerate(r[1])])
def page_places(spark, sf_dir):
    rows = inputs(spark, sf_dir, "segments array<string>", [(list(r[0]),) for r in SEGMENTS]).select("k", F.posexplode("segments").alias("no", "text"))
    return pdf.page_text(rows, ["k"]).select("k", "no", "start", "end")


#: (text, identifier key, residue key, token's surface)
KEYS = (("HU42 1177-3016", "hu4211773016", "hu4211773016", "HU42 1177-3016"), ("A.B@x.hu", "a.b@x.hu", "abxhu", "A.B@x.hu"), ("##vács", "vács", "vács", "vács"), ("▁Kov", "kov", "kov", " Kov"))


@gold("surface_keys", len(KEYS), ["identifier_key VARCHAR", "residue_key VARCHAR", "surface VARCHAR"], [(i, *r[1:]) for i, r in enumerate(KEYS)])
def surface_keys(spark, sf_dir):
    t = F.col("t")
    return inputs(spark, sf_dir, "t string", [r[:1] for r in KEYS]).select("k", text.identifier_key(t).alias("identifier_key"), text.residue_key(t).alias("residue_key"), text.token_surface(t).alias("surface"))


#: Two customers in turn propose one form, spelled from their number or, for every fifth pair, a real name: the second repeats the
#: first, gives it the other gender, or puts it on the other list; every sixteenth customer names no gender.
_PAIRS = "SELECT CAST(c_custkey AS BIGINT) AS k, CAST(c_custkey - c_custkey % 2 AS BIGINT) AS j FROM customer"
_FORM = f"CASE WHEN j % 10 = 0 THEN {pick(GIVEN, '(j * 7)')} ELSE 'T' || translate(CAST(j AS STRING), '0123456789', 'aeioubdgkl') END"
_GROUP = "CASE WHEN j % 6 = 2 OR (j % 6 = 4 AND k % 2 = 1) THEN 'given' ELSE 'surname' END"
_GENDER = "CASE WHEN k % 16 = 3 OR k % 16 = 13 THEN NULL WHEN k % 2 = 1 AND j % 4 = 2 THEN 'F' ELSE 'M' END"
_THEME_SQL = f"""WITH p AS ({_PAIRS}), f AS (SELECT k, j, {_FORM} AS form, {_GROUP} AS list, {_GENDER} AS gender, k % 2 = 1 AND count(*) OVER (PARTITION BY j) = 2 AS second FROM p)
SELECT k AS no, form, CASE WHEN j % 10 <> 0 AND NOT regexp_matches(form, '[aeiou]') THEN 'no vowel' WHEN length(form) < {themes.SHORTEST} THEN 'short' WHEN j % 10 = 0 THEN 'real name'
WHEN list = 'given' AND gender IS NULL THEN 'no gender' WHEN NOT second THEN NULL WHEN j % 6 = 4 THEN 'other list' WHEN list = 'given' AND gender = 'F' THEN 'two genders' ELSE 'repeated' END AS reject FROM f"""


def theme_rejects(spark, sf_dir):
    """Proposals of all customers judged in order against all given names."""
    pairs = table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS BIGINT) AS no", "CAST(c_custkey - c_custkey % 2 AS BIGINT) AS j").withColumn("k", F.col("no"))
    rows = pairs.selectExpr("no", f"{_FORM} AS form", f"{_GROUP} AS `group`", f"{_GENDER} AS gender")
    return themes.judge(rows, people(spark, sf_dir).select(F.col("given").alias("name"))).select("no", "form", "reject")


QUERIES["theme_rejects"], SQL["theme_rejects"] = theme_rejects, _THEME_SQL
