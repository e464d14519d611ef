import io
import re
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from spanloom.functions.text import LETTERS
from spanloom.operators import names, search, shaping, themes
from spanloom.sources import carriers

TEXTS = ["Kovács Já-\nnos és János", "Já-\r\n  nos", "a-\nb-\n\tc d", "no break - here", "-\nJános-\n", "", "𝒜é-\nJános János.", "János-\n\nJános", None]


def test_search_texts_and_places_equal_the_matcher_s(spark):
    rows = spark.createDataFrame([*enumerate(TEXTS)], "k long, text string")
    made = rows.select("k", search.search_text(F.col("text")).alias("s"))
    for r in made.collect():
        text = TEXTS[r.k]
        if text is None:
            assert r.s is None
            continue
        want, places = names.search_text(text)
        assert r.s.text == want
        for at in range(len(want)):
            assert at + max([s.by for s in r.s.shifts if s["at"] <= at], default=0) == places[at]


def test_occurrences_equal_brute_force(spark):
    needles = ["János", "d", "J", "a.b", "x\\Ey", "", None, "János"]
    texts = [*TEXTS, "x\\Ey és x\\E-\ny, a.b axb", "JánosJános János3 3János"]
    rows = spark.createDataFrame([*enumerate(texts)], "k long, text string")
    pairs = spark.createDataFrame([(k, n) for k in range(len(texts)) for n in needles], "k long, needle string")
    got = sorted((r.k, r.needle, r.start, r.end, r.surface) for r in search.occurrences(rows, pairs, "k").collect())
    want = []
    for k, text in enumerate(texts):
        found, places = names.search_text(text or "")
        for n in {n for n in needles if n}:
            for m in re.finditer(f"(?<![{LETTERS}0-9]){re.escape(n)}(?![{LETTERS}])", found):
                start, end = places[m.start()], places[m.end() - 1] + 1
                want.append((k, n, start, end, text[start:end]))
    assert got == sorted(want) and len(got) > 8
    assert search.occurrences(rows.limit(0), pairs, "k").count() == 0


def test_common_words(spark):
    hits = spark.createDataFrame([(1, "a", "surname", "Szabóval"), (1, "a", "full", "Szabó Anna"), (1, "b", "surname", "Szabóval"), (2, "a", "given", "Szabóval"), (1, None, None, "szabó"), (1, "a", "given", None), (1, "a", "surname", "Szabóval")], "case long, entity_id string, core string, surface string")
    entities = spark.createDataFrame([(1, "a", "person", "Szabó", None, None), (1, "b", "org", "Szabó", "x", "y"), (2, "a", "person", "Szabó", "Anna", "Kis")], "case long, id string, kind string, surname string, given string, maiden string")
    words = spark.createDataFrame([("SZABÓ",), ("szabó",), (None,)], "word string")
    out = shaping.with_common_words(hits, entities, words, "case")
    assert out.columns == [*hits.columns, "common_word"]
    got = sorted((r["case"], r.entity_id or "", r.core or "", r.surface or "", r.common_word) for r in out.collect())
    assert got == sorted([(1, "a", "surname", "Szabóval", True), (1, "a", "full", "Szabó Anna", False), (1, "b", "surname", "Szabóval", False), (2, "a", "given", "Szabóval", False), (1, "", "", "szabó", True), (1, "a", "given", "", False), (1, "a", "surname", "Szabóval", True)])
    assert not any(r.common_word for r in shaping.with_common_words(hits, entities, words.limit(0), "case").collect())


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), data)
    return out.getvalue()


def test_texts_of_profiles():
    def read(xml, profile):
        text, found = carriers.carriers(ElementTree.fromstring(xml), carriers.PROFILES[profile])
        assert all(text[c.start : c.end] == c.content for c in found)
        return text

    # An attribute in the middle of a word does not cut it.
    assert read(f'<w:p {W}><w:r><w:t>Kov</w:t></w:r><w:bookmarkStart w:name="Ács"/><w:r><w:t>ács</w:t><w:br/><w:t/></w:r></w:p>', "words") == "Kovács\n\nÁcs\n"
    assert read(f'<w:p {W}><w:bookmarkStart w:name="_Toc12"/><w:r><w:instrText>X</w:instrText><w:noBreakHyphen/></w:r></w:p>', "words") == "X\n-\n"
    assert read("<a>\n<b>x</b>\n<c><d>y</d></c></a>", "data") == "x\ny\n"
    assert read("<p><property name='n'/></p>", "properties") == "n\n"
    deep = "<a>" * 5000 + "x" + "</a>" * 5000
    assert read(deep, "data") == "x\n"
    assert carriers.profile_of("word/_rels/document.xml.rels") == "links" and carriers.profile_of("word/media/a.png") == "none" == carriers.profile_of("odd.bin")


def test_edits_go_to_the_first_carrier(spark):
    doc = f'<w:document {W}><w:p><w:r><w:t>Kov</w:t></w:r><w:r><w:t>ács Pál</w:t></w:r></w:p><w:bookmarkStart w:name="Kovács"/></w:document>'
    files = spark.createDataFrame([("a", package(word__document_xml=doc)), ("b", b"no package"), ("c", b"left alone"), ("d", None), ("e", package(word__document_xml=doc)), ("f", package(word__document_xml="<w:p"))], "path string, content binary")
    edits = spark.createDataFrame([("a", "word/document.xml", 0, 6, "Kő"), ("a", "word/document.xml", 11, 17, None), ("b", "word/document.xml", 0, 1, "x"), ("e", "word/document.xml", 0, 3, "x"), ("e", "word/document.xml", 2, 4, "y"), ("f", "word/document.xml", 0, 3, "x")], "path string, part string, start int, end int, replacement string")
    out = {r.path: r for r in carriers.edited(files, edits).collect()}
    assert [out[p].error is None for p in "abcdef"] == [True, False, True, True, False, False] and bytes(out["c"].content) == b"left alone"
    after = carriers.rows(carriers.edited(files, edits).where("path = 'a'")).orderBy("no").collect()
    assert [(r.content, r.start) for r in after] == [("Kő", 0), (" Pál", 2)]
    assert carriers.rows(files.where("path IN ('b', 'c', 'd', 'f')")).count() == 0


@pytest.mark.parametrize("empty", ["files", "edits"])
def test_empty_tables(spark, empty):
    files = spark.createDataFrame([("a", package(word__document_xml=f"<w:p {W}/>"))], "path string, content binary")
    edits = spark.createDataFrame([("a", "word/document.xml", 0, 1, "x")], "path string, part string, start int, end int, replacement string")
    out = carriers.edited(files.limit(0) if empty == "files" else files, edits.limit(0) if empty == "edits" else edits)
    assert out.count() == (0 if empty == "files" else 1)


#: (form, group, gender, why rejected), judged in this order.
THEME_FORMS = (
    ("Kavics", "surname", None, None), ("kavics", "surname", None, "letters"), ("Ab", "surname", None, "short"), ("Brrr", "surname", None, "no vowel"), ("János", "given", "M", "real name"),
    ("Opálka", "given", None, "no gender"), ("Kvarcka", "given", "F", None), ("Kvarcka", "given", "M", "two genders"), ("Kvarcka", "given", "F", "repeated"), ("Kavics", "given", "M", "other list"), ("", "org", None, "empty"),
)


def test_theme_proposals(spark):
    rows = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(THEME_FORMS)], "no int, form string, group string, gender string")
    judged = themes.judge(rows, spark.createDataFrame([("János",)], "name string")).orderBy("no").collect()
    assert [r.reject for r in judged] == [r[3] for r in THEME_FORMS]
