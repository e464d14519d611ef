import io
import random
import zipfile

import pytest

from spanloom.sources import docx as X
from spanloom.sources import structure as S

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def links(*targets):
    return "<Relationships>" + "".join(f'<Relationship Target="{t}"/>' for t in targets) + "</Relationships>"


TYPES = '<Types><Default Extension="xml" ContentType="x"/><Default Extension="rels" ContentType="r"/></Types>'
MAIN = f"<w:document {NS}/>"


@pytest.mark.parametrize(
    ("source", "target", "part"),
    [("_rels/.rels", "word/a.xml", "word/a.xml"), ("word/_rels/a.xml.rels", "../b.xml", "b.xml"), ("word/_rels/a.xml.rels", "/c/d.xml", "c/d.xml"), ("_rels/.rels", "../../e.xml", "e.xml"), ("word/_rels/a.xml.rels", "./x//y.xml", "word/x/y.xml")],
)
def test_targets(source, target, part):
    assert S.resolve(source, target) == part


def faults(spark, *contents):
    files = spark.createDataFrame([(str(i), bytearray(c) if c is not None else None) for i, c in enumerate(contents)], "path string, content binary")
    return {(r.path, r.fault, r.part, r.target) for r in S.faults(S.relation(files)).collect()}


def test_a_cycle_of_links_and_an_island(spark):
    whole = {S.TYPES: TYPES, "_rels/.rels": links("word/document.xml"), "word/document.xml": MAIN, "word/_rels/document.xml.rels": links("header1.xml"), "word/header1.xml": MAIN, "word/_rels/header1.xml.rels": links("document.xml")}
    island = whole | {"word/footer1.xml": MAIN, "word/_rels/footer1.xml.rels": links("footer1.xml")}
    assert faults(spark, package(**whole)) == set()
    assert faults(spark, package(**island)) == {("0", "unreachable", "word/footer1.xml", None), ("0", "unreachable", "word/_rels/footer1.xml.rels", None)}


def test_what_cannot_be_opened(spark):
    assert faults(spark, b"no", None, b"", package(a="x")) == {*((i, "unreadable", None, None) for i in "012"), ("3", "no types", None, None)}


def test_no_packages(spark):
    assert S.faults(S.relation(spark.createDataFrame([], "path string, content binary"))).collect() == []


def test_residue_equals_counting_each_needle():
    draw = random.Random(3)
    for _ in range(200):
        text = "".join(draw.choice("aáb") for _ in range(draw.randrange(60)))
        data = text.encode() + text[: draw.randrange(20)].encode("utf-16-le")
        needles = ["".join(draw.choice("aáb") for _ in range(draw.randrange(3, 7))) for _ in range(20)]
        got = X.count_needles(data, X.automaton(needles))
        assert dict(got) == {n: c for n in set(needles) if len(n) >= 4 and (c := data.count(n.encode()) + data.count(n.encode("utf-16-le")))}
    assert X.count_needles(b"abc", X.automaton(["abc"])) == {}


def test_residues_over_rows(spark):
    files = spark.createDataFrame([("a", bytearray(package(x="Anna Anna", y="Anna"))), ("b", bytearray(b"no")), ("c", bytearray(package(x="Anna")))], "path string, content binary")
    needles = spark.createDataFrame([("a", "Anna", 1), ("a", "Anna", None), ("a", None, 3), ("b", "Anna", 0), ("d", "Anna", 0)], "path string, needle string, allowed int")
    assert {tuple(r) for r in X.residues(files, needles).collect()} == {("a", "x", "Anna", 1), ("b", None, None, None)}
    assert X.residues(files, needles.limit(0)).collect() == []


def body(*runs):
    return f"<w:document {NS}><w:body><w:p>{''.join(runs)}</w:p></w:body></w:document>".encode()


def run(text, look="", **more):
    return f'<w:r w:rsidR="{len(text)}">{look}<w:t xml:space="preserve">{text}</w:t>{"".join(more.values())}</w:r>'


def test_runs_of_one_look_become_one():
    bold = "<w:rPr><w:b/></w:rPr>"
    xml = X.merge_runs(body(run("Ko"), run("vács "), run("Já", bold), run("nos", bold, tab="<w:tab/>"), run("vége", bold), run("!")))
    text, places = X.flat(X._parse(xml))
    assert text == "Kovács János\tvége!\n" and [n.text for _, _, n in places] == ["Kovács ", "János", "vége", "!"] and xml.count(b"<w:r ") == 3 and b"_plain" not in xml


def test_fields_and_deleted_runs_stay():
    field = '<w:r><w:fldChar w:fldCharType="begin"/></w:r>'
    gone = "<w:del><w:r><w:delText>b</w:delText></w:r></w:del>"
    for between in (field, gone):
        xml = X.merge_runs(body(run("a"), between, run("c")))
        assert X.flat(X._parse(xml))[0] == "ac\n" and len(X.flat(X._parse(xml))[1]) == 2
