from spanloom.operators import themes as T
from spanloom.sources import pdf as P


def test_operations():
    data = b"BT /F1 12 Tf % note\n[(a\\(b\\051\\101) -20 <48 65 6>] TJ (x(y)z\\\n!) Tj /P <</MCID 0 /A <<>> >> BDC ET BI /W 1 ID \x00\xff( EI Q true null gs"
    ops = P.operations(data)
    assert [o.operator for o in ops] == ["BT", "Tf", "TJ", "Tj", "BDC", "ET", "BI", "EI", "Q", "gs"]
    assert ops[1].operands == ["F1", 12.0] and ops[2].operands == [[b"a(b)A", -20.0, b"He`"]] and ops[3].operands == [b"x(y)z!"]
    assert data[ops[3].start : ops[3].end].startswith(b"(x(y)") and ops[9].operands == [True, None]


def test_character_maps():
    m = P.CharacterMap.parse(b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <01> <00660069> endbfchar 2 beginbfrange <10> <12> <0041> <20> <21> [<0150> <0171>] endbfrange")
    assert m.width == 1 and m.decode(bytes([1, 0x10, 0x12, 0x20, 0x21, 0x99])) == "fiACŐű"
    assert P.shown_text(b"/F 1 Tf <1011> Tj /G 1 Tf <10> Tj", {"F": m}) == "AB"


def test_paragraphs(spark):
    lines = [(1, i, 50.0, 700.0 - 14 * i, 400.0, 11.0, "s") for i in range(3)] + [(1, 3, 50.0, 620.0, 100.0, 11.0, "s"), (1, 4, 80.0, 606.0, 100.0, 11.0, "s")]
    rows = P.paragraphs(spark.createDataFrame(lines, "page long, no int, x double, y double, width double, size double, stream string"), ["page"]).orderBy("no").collect()
    assert [r.paragraph for r in rows] == [0, 0, 0, 1, 2] and rows[0].justified and not rows[3].justified
    assert P.segment_edits([(0, 5), (6, 10)], [(3, 8, "X")]) == {0: [(3, 5, "X")], 1: [(0, 2, "")]}


def test_proposals():
    answer = '<think>[1]</think> Here: [{"name": "Kavicska", "nem": "nő", "csoport": "utónév"}, "Bazalt", 7]'
    assert T.read_proposals(answer, "surname") == [{"form": "Kavicska", "group": "given", "gender": "F"}, {"form": "Bazalt", "group": "surname", "gender": None}]
    assert [p["form"] for p in T.read_proposals('{"form": "Opál"},\nno\n{"form": "Kvarc"}', "surname")] == ["Opál", "Kvarc"]


def test_reject_reasons_in_order(spark):
    rows = [("Kavics", "surname", None), ("kavics", "surname", None), ("Ab", "surname", None), ("Brrr", "surname", None), ("János", "given", "M"), ("Opálka", "given", None), ("Kvarcka", "given", "F"), ("Kvarcka", "given", "M"), ("Kvarcka", "given", "F"), ("Kavics", "given", "M"), ("", "org", None), ("Kő-János", "surname", None)]
    judged = T.judge(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "no int, form string, group string, gender string"), spark.createDataFrame([("János",)], "name string"))
    assert [r.reject for r in judged.orderBy("no").collect()] == [None, "letters", "short", "no vowel", "real name", "no gender", None, "two genders", "repeated", "other list", "empty", "real name"]
    assert T.shortages(judged.where("reject IS NULL"))[0] == ("given", "M", 0, 8, True)
