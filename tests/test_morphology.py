import pytest

from spanloom.functions import hungarian as H


@pytest.mark.parametrize(
    ("word", "case", "form"),
    [
        ("Kovács", "DAT", "Kovácsnak"), ("Németh", "DAT", "Némethnek"), ("Ödön", "ALL", "Ödönhöz"), ("Gránit", "DAT", "Gránitnak"), ("Kis", "DAT", "Kisnek"),
        ("Kovács", "INS", "Kováccsal"), ("Nagy", "INS", "Naggyal"), ("Kiss", "INS", "Kiss-sel"), ("Papp", "INS", "Papp-pal"), ("Anna", "INS", "Annával"),
        ("Szabó", "INS", "Szabóval"), ("Anna", "ACC", "Annát"), ("Tünde", "ALL", "Tündéhez"), ("Anna", "FOR", "Annaként"), ("Farkas", "ACC", "Farkast"),
        ("Fréd", "ACC", "Frédet"), ("Nagy", "ACC", "Nagyot"), ("Kovács", "SUP", "Kovácson"), ("Kovács", "FAM", "Kovácsék"), ("Kovács", "PL", "Kovácsok"),
        ("Kovács János", "WIFE", "Kovács Jánosné"), ("Kovács Jánosné", "INS", "Kovács Jánosnéval"),
    ],
)
def test_case_forms(word, case, form):
    assert H.inflect_name(word, case) == form


def test_overrides_and_organisations():
    assert H.inflect_name("Balzac", "INS", {"ins": "Balzackal", "harmony": "back"}) == "Balzackal"
    assert H.inflect_organisation("Aranykalász Kft.", "DAT") == "Aranykalász Kft.-nek"
    assert H.inflect_organisation("Kovakő Zrt.", "ACC") == "Kovakő Zrt.-t"


@pytest.mark.parametrize(("n", "words"), [(0, "nulla"), (22, "huszonkettő"), (200, "kétszáz"), (1999, "ezerkilencszázkilencvenkilenc"), (2000, "kétezer"), (2001, "kétezer-egy"), (-5, "mínusz öt")])
def test_numerals(n, words):
    assert H.number_words(n) == words


def test_numerals_read_back():
    for n in [*range(0, 2500, 7), 10**6, 123456789]:
        said = H.number_words(n)
        assert H.read_number_words(said + " forint", 0, n) == len(said)
    assert H.read_number_words("huszonöten", 0, 25) is None


def test_paradigms_as_rows(spark):
    rows = H.paradigms(spark.createDataFrame([("Anna",), ("Anna",), (None,)], "name string")).collect()
    assert len(rows) == len(H.CASES)
