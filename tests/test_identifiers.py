import pytest

from spanloom.operators import identifiers as I

TEXTS = {
    "adóazonosító jele: 8442130976, igen": ("8442130976", "ado_azonosito_jel"),
    "TAJ száma 111 111 110 volt": ("111 111 110", "taj"),
    "adószáma: 24817350-2-13.": ("24817350-2-13", "adoszam"),
    "cégjegyzékszáma: 13-09-184627": ("13-09-184627", "cegjegyzekszam"),
    "a 10402142-49575354-56561008 számlára": ("10402142-49575354-56561008", "bankszamlaszam"),
    "IBAN: HU42 1040 2142 4957 5354 5656 1008": ("HU42 1040 2142 4957 5354 5656 1008", "iban"),
    "a Szentendre belterület 4127/8. hrsz.": ("Szentendre belterület 4127/8. hrsz.", "helyrajzi_szam"),
    "lakcíme 2011 Budakalász, Szentendrei út 78/B. II. em. 5.": ("2011 Budakalász, Szentendrei út 78/B. II. em. 5.", "cim"),
    "telefon: +36 30 412 7758": ("+36 30 412 7758", "telefonszam"),
    "a 12.P.20.845/2026/8. számú ügyben": ("12.P.20.845/2026/8", "birosagi_ugyszam"),
    "levele a kovacs.janos58@freemail.hu címre": ("kovacs.janos58@freemail.hu", "email"),
    "rendszáma ABC-123 volt": ("ABC-123", "rendszam"),
    "száma 123456AB lett": ("123456AB", "szemelyazonosito_igazolvany"),
}


@pytest.mark.parametrize("text", TEXTS)
def test_kinds(text):
    surface, kind = TEXTS[text]
    assert (surface, kind) in [(h[2], h[3]) for h in I.raw_hits(text)]


@pytest.mark.parametrize("text", ["4263982640269299", "a 2016. évi CXXX. törvény 170. §-a", "15 napon belül", ""])
def test_no_hits(text):
    assert not [h for h in I.raw_hits(text) if h[3] != "iranyitoszam"]


def test_scores_and_overlaps(spark):
    rows = [(1, "adószáma: 24817350-2-13, címe 2011 Budakalász, Malom köz 6."), (2, None), (3, "")]
    found = I.resolved(spark.createDataFrame(rows, "doc long, text string"), ["doc"]).orderBy("start").collect()
    assert [(r.doc, r.kind) for r in found] == [(1, "adoszam"), (1, "cim")]
    assert found[0].checksum in ("valid", "invalid") and found[0].confidence == 80 + (20 if found[0].checksum == "valid" else -15)
    assert found[1].confidence == 95 and found[1].disposition == "auto"


def test_bad_check_digit_goes_to_review(spark):
    bad = I.find(spark.createDataFrame([(1, "8442130970 szám")], "doc long, text string"), ["doc"]).where("kind = 'ado_azonosito_jel'").first()
    assert bad.checksum == "invalid" and bad.confidence == 40 and bad.disposition == "review"


@pytest.mark.parametrize(
    "text, surface, kind",
    [
        ("1051 Budapest , Kis u. 5 III/12. lakos", "1051 Budapest , Kis u. 5 III/12.", "cim"),
        ("1051 Budapest, Kis Péter krt. 5/12 2. emelet, ott", "1051 Budapest, Kis Péter krt. 5/12 2. emelet", "cim"),
        ("8000 Székesfehérvár-Kisfalud, Ady Endre utca 1. földszint", "8000 Székesfehérvár-Kisfalud, Ady Endre utca 1. földszint", "cim"),
        ("1051 Budapest, Kis utca 5 3/B ajtó", "1051 Budapest, Kis utca 5 3/B ajtó", "cim"),
        ("1051 Budapest, Kis utca 5 IV. 12 felett", "1051 Budapest, Kis utca 5 IV. 12", "cim"),
        ("Szentendre, 4127/8/A hrsz. alatt", "Szentendre, 4127/8/A hrsz.", "helyrajzi_szam"),
        ("helyrajzi számú: 123/4 telek", "helyrajzi számú: 123/4", "helyrajzi_szam"),
        ("a 12 hrsz-ú telek", "12 hrsz", "helyrajzi_szam"),
        ("06 (20) 123 45 67 hívható", "06 (20) 123 45 67", "telefonszam"),
        ("06-1-234-567", "06-1-234-567", "telefonszam"),
    ],
)
def test_whole_surfaces(text, surface, kind):
    assert (surface, kind) in [(h[2], h[3]) for h in I.raw_hits(text)]


@pytest.mark.parametrize("text", ["0123 Pest", "1051 budapest, Kis utca 5", "1051 Budapest, kis utca 5", "1051 Budapest, Kis utca 12345", "+36 1 234 5678x", "hrsz. nélkül", "x06201234567"])
def test_what_is_no_address_plot_or_phone(text):
    assert not [h for h in I.raw_hits(text) if h[3] in ("cim", "helyrajzi_szam", "telefonszam")]
