"""PDF text with its place: matrices, nested and circular forms, fonts without tables, messages."""

import pytest

from spanloom.sources import pdfstate as P

TEXT = "Dr. Kővári Ágnes"
MAP = {ord(c): c for c in TEXT}
PAGE, STREAMS = "file long, page int, stream_id string", "file long, stream_id string, content binary, matrix array<double>"
OBJECTS, FONTS = "file long, stream_id string, name string, kind string, target string", "file long, stream_id string, name string, base_font string, width int, chars map<int,string>"


def hexed(text):
    return text.encode("utf-16-be").hex().encode()


def extract(spark, streams, objects=(), fonts=(("F1", "AAAAAA+Times", MAP),), pages=((1, 0, "page"),)):
    listed = [(1, s, c, m) for s, c, m in streams]
    known = [(1, s, f, b, 2, m) for s, *_ in streams for f, b, m in fonts]
    found, warned = P.extract(spark.createDataFrame([*pages], PAGE), spark.createDataFrame(listed, STREAMS), spark.createDataFrame([(1, *o) for o in objects], OBJECTS), spark.createDataFrame(known, FONTS))
    return found.orderBy("file", "page", "no").collect(), {(r.page, r.kind, r.name): r.n for r in warned.collect()}


def test_a_forms_matrix_and_the_place_of_its_call_count(spark):
    form = b"BT /F1 12 Tf 1 0 0 1 5 5 Tm <" + hexed(TEXT) + b"> Tj ET\nBT /F1 12 Tf 1 0 0 1 5 -15 Tm <" + hexed("Kov") + b"> Tj ET\n"
    page = b"BT /F1 11 Tf 1 0 0 1 72 600 Tm <" + hexed("Dr") + b"> Tj ET\nq 1 0 0 1 10 20 cm /Head Do Q\n"
    rows, warned = extract(spark, [("page", page, None), ("7 0 R", form, [1.0, 0.0, 0.0, 1.0, 50.0, 700.0])], [("page", "Head", "form", "7 0 R")], [("F1", "T", {**MAP, **{ord(c): c for c in "Dr.Kov"}})])
    assert [(r.stream_id, r.text, r.x, r.y) for r in rows] == [("page", "Dr", 72, 600), ("7 0 R", TEXT, 65, 725), ("7 0 R", "Kov", 65, 705)] and warned == {}
    assert form[rows[1]["at"] : rows[1]["end"]] == b"<" + hexed(TEXT) + b"> Tj"
    # The same form drawn twice is read once and placed twice, in the page's order.
    rows, _ = extract(spark, [("page", b"/Head Do 2 0 0 2 0 0 cm /Head Do", None), ("f", form, None)], [("page", "Head", "form", "f")])
    assert [(r.no, r.x, r.y, r.size) for r in rows] == [(1, 5, 5, 12), (2, 5, -15, 12), (3, 10, 10, 24), (4, 10, -30, 24)]


def test_names_that_stand_for_nothing(spark):
    rows, warned = extract(spark, [("page", b"/Head Do /Pic Do /Gone Do", None)], [("page", "Pic", "image", None), ("page", "Gone", "form", "lost"), ("page", "Head", "missing", None)])
    assert rows == [] and warned == {(0, "unopened", "Head"): 1, (0, "unopened", "Gone"): 1}


def test_circles_and_depth(spark, monkeypatch):
    itself = b"BT /F1 12 Tf 1 0 0 1 0 0 Tm <" + hexed("Ágnes") + b"> Tj ET\n/Own Do\n"
    rows, warned = extract(spark, [("page", b"/A Do", None), ("9 0 R", itself, None)], [("page", "A", "form", "9 0 R"), ("9 0 R", "Own", "form", "9 0 R")])
    assert [r.text for r in rows] == ["Ágnes"] and warned == {(0, "skipped", "9 0 R"): 1}
    two = [("page", b"/A Do", None), ("a", itself, None), ("b", itself, None)]
    rows, warned = extract(spark, two, [("page", "A", "form", "a"), ("a", "Own", "form", "b"), ("b", "Own", "form", "a")])
    assert len(rows) == 2 and warned == {(0, "skipped", "a"): 1}
    monkeypatch.setattr(P, "DEPTH", 3)
    chain = [("page", b"/Own Do", None), *((str(i), itself, None) for i in range(6))]
    rows, warned = extract(spark, chain, [("page", "Own", "form", "0"), *((str(i), "Own", "form", str(i + 1)) for i in range(5))])
    assert len(rows) == 3 and warned == {(0, "skipped", "3"): 1}
    monkeypatch.setattr(P, "PLACES", 2)
    rows, warned = extract(spark, [("page", b"/A Do " * 5, None), ("a", itself, None)], [("page", "A", "form", "a"), ("a", "Own", "image", None)])
    assert len(rows) == 2 and warned == {(0, "skipped", "a"): 3}


@pytest.mark.parametrize(("fonts", "texts", "warned"), [
    ([("F1", "BAAAAA+Times", None)], [], {(0, "blind", "BAAAAA+Times"): 16}),
    ([("F9", "X", MAP)], [], {(0, "blind", "F1"): 16}),
    ([("F1", "T", {k: v for k, v in MAP.items() if v != "ő"})], [TEXT.replace("ő", "")], {(0, "partial", "T"): 1}),
    ([("F1", None, {})], [], {(0, "partial", "F1"): 16}),
])
def test_unreadable_codes_are_counted(spark, fonts, texts, warned):
    page = b"BT /F1 12 Tf 1 0 0 1 72 700 Tm <" + hexed(TEXT) + b"> Tj ET\n"
    rows, got = extract(spark, [("page", page, None)], fonts=fonts)
    assert [r.text for r in rows] == texts and got == warned


@pytest.mark.parametrize(("stream", "shown"), [
    (b"BT /F1 10 Tf 5 7 Td (\\000K) Tj (\\000o) Tj [(\\000v) -20 <0041>] TJ ET", [(5, 7, b"\0K\0o\0v\0A")]),
    (b"BT /F1 10 Tf 12 TL 1 2 Td (a) ' (b) ' 3 4 (c) \" T* (d) Tj ET", [(1, -10, b"a"), (1, -22, b"b"), (1, -34, b"c"), (1, -46, b"d")]),
    (b"BT 10 20 TD (a) Tj T* (b) Tj 5 Ts 1 0 Td (c) Tj ET BT (d) Tj ET", [(10, 20, b"a"), (10, 40, b"b"), (11, 45, b"c"), (0, 5, b"d")]),
    (b"q 2 0 0 2 1 1 cm q 1 0 0 1 3 3 cm BT (a) Tj ET Q BT (b) Tj ET Q Q Q BT (c) Tj ET", [(7, 7, b"a"), (1, 1, b"b"), (0, 0, b"c")]),
    (b"q /F1 9 Tf Q BT 0 1 -1 0 8 9 Tm (a) Tj 1 0 Td 0.5 Tc (b) Tj ET", [(8, 9, b"a"), (8, 10, b"b")]),
    (b"Td Tm cm Tf Do TL (x Tj", []), (b"BT /F1 Tf (a) Tj 7 Tj ET", [(0, 0, b"a")]), (b"", []),
])
def test_operators_move_the_text(stream, shown):
    assert [(r[5][4], r[5][5], r[3]) for r in P.interpret(stream)] == shown


def test_nulls_repeats_and_nothing(spark):
    rows, warned = extract(spark, [("page", None, None), ("other", b"BT (a) Tj ET", None), ("other", b"BT (a) Tj ET", None)], pages=((1, 0, "page"), (1, 1, "other"), (1, 2, "none")))
    assert rows == [] and warned == {}
    assert extract(spark, [], pages=()) == ([], {})


def test_messages_name_pages(spark):
    rows = [(1, p, k, n, c) for p, k, n, c in ((1, "blind", "A", 3), (4, "blind", "B", 4), (0, "partial", "C", 2), (2, "skipped", "7", 1), (2, "unopened", "X", 1), (3, "unopened", "Y", 1))] + [(2, p, "partial", "C", 1) for p in range(7)]
    got = {r.file: r.messages for r in P.messages(spark.createDataFrame(rows, "file long, page int, kind string, name string, n long")).collect()}
    assert got[1][0].startswith("A 2. és 5. oldalon 2 betűkészlethez") and "7 karaktert" in got[1][0] and "NEM LÁTJA" in got[1][0] and got[1][0].endswith("betűkészlet: A, B.")
    assert [m[:22] for m in got[1][1:]] == ["A 1. oldalon 2 karakte", "A 3. oldalon 1 beágyaz", "A 3. és 4. oldalon 2 h"]
    assert got[2] == ["7 oldalon 7" + P.PARTIAL]


def test_paragraphs_of_a_preview(spark):
    lines = [(1, 1, 0, 200.4, 0), (1, 2, 1, 72.0, 10), (1, 3, 1, 90.0, 20), (1, 4, 2, 150.0, 30), (1, 5, 2, 72.0, 40), (1, 6, 3, 92.4, 50), (1, 7, 4, 92.6, 60), (2, 1, 0, 300.0, 0)]
    rows = P.preview_paragraphs(spark.createDataFrame(lines, "page int, no int, paragraph int, x double, start int"), ["page"]).collect()
    assert {(r.page, r.paragraph): (r.start, r.center) for r in rows} == {(1, 0): (0, True), (1, 1): (10, False), (1, 2): (30, False), (1, 3): (50, False), (1, 4): (60, True), (2, 0): (0, False)}
