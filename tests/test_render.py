import pytest
from pyspark.sql import Row

from spanloom.operators import assign, names, render

THEME = {
    "surnames": [{"form": "Halom", "overrides": {"acc": "Halmot"}}], "given_names": [{"form": "Ottó", "gender": "M"}, {"form": "Tücsök", "gender": "F", "overrides": {"acc": "Tücsköt"}}],
    "org_parts": ["Hegyi"], "place_names": [{"form": "Kővár", "locative": "ine"}],
}
CAST = [
    Row(c=1, id="1", kind="person", name="", surname="Kovács", given="János", gender="M", wife_of="", maiden="", abbreviation="", no=1),
    Row(c=1, id="2", kind="person", name="", surname="Fehér", given="Ilona", gender="F", wife_of="", maiden="", abbreviation="", no=2),
    Row(c=1, id="3", kind="org", name="Aranykalász Agrár Kft.", surname="", given="", gender="", wife_of="", maiden="", abbreviation="AA", no=3),
    Row(c=1, id="4", kind="place", name="Szolnok", surname="", given="", gender="", wife_of="", maiden="", abbreviation="", no=4),
    Row(c=1, id="5", kind="person", name="", surname="", given="", gender="F", wife_of="Kovács János", maiden="", abbreviation="", no=5),
]
#: (text, what its hits become)
TEXTS = [
    ("dr. Kovács Jánossal", ["dr. Halom Ottóval"]),
    ("Kovács úrnak", ["Halom úrnak"]),
    ("DR. KOVÁCS JÁNOSSAL", ["DR. HALOM OTTÓVAL"]),
    ("KOVÁCS ÚRNAK", ["HALOM ÚRNAK"]),
    ("dr. Kovacs Janossal", ["dr. Halom Ottóval"]),
    ("Szolnokon, Szolnokról", ["Kővárban", "Kővárból"]),
    ("kovacs.janos@aranykalasz.hu", ["halom.otto@hegyi.hu"]),
    ("Kovácsostul", [None]),
    ("Fehér Ilonának, Ilonát, Fehérnek, Fehérrel, a Kovácsot", ["Halom 2 Tücsöknek", "Tücsköt", "Halom 2-nek", "Halom 2-vel", "Halmot"]),
    ("Kovács Jánosnénak", ["Halom Ottónénak"]),
    ("Aranykalász Agrár Kft.-vel, az AA-nak", ["Hegyi Agrár Kft.-vel", "HA-nak"]),
]


@pytest.fixture(scope="module")
def rendered(spark):
    cast = spark.createDataFrame(CAST)
    units = spark.createDataFrame([(1, i, text) for i, (text, _) in enumerate(TEXTS)], "c int, k int, text string")
    manual = spark.createDataFrame([(1, "1", "Réti Béla"), (1, "4", " ")], "c int, entity_id string, replacement string")
    hits, new = names.match(units, cast, "c", ["k"]).localCheckpoint(), assign.replacements(cast, "c", THEME, "titok")
    ours = lambda df: {(r.k, r.start): r.replacement for r in df.collect()}
    return [[x[at] for at in sorted(x) if at[0] == k] for x in (ours(render.render_theme(hits, new, "c")),) for k in range(len(TEXTS))], ours(render.render_theme(hits, new, "c", manual))


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_titles_honorifics_places_addresses_and_exceptions(rendered, k):
    assert rendered[0][k] == TEXTS[k][1]


def test_manual_names_bend_and_unknown_suffixes_stay(rendered):
    found = rendered[1]
    assert [found[k, 0] for k in (0, 1, 2, 6, 7, 5)] == ["dr. Réti Bélával", "Réti úrnak", "DR. RÉTI BÉLÁVAL", "reti.bela@hegyi.hu", None, "Kővárban"]


def test_kept_wives_keep_their_parts(spark):
    wives = [names.Entity("1", "person", surname="Kovács", given="X", wife_of="Kovács János"), names.Entity("2", "person", surname="Kovács", given="Anna", wife_of="Kovács János", maiden="Szabó")]
    assert assign.apart(wives[0], {"sticky": True, "shown": "Halom Ottóné", "surname": "Halom", "given": "Ottóné"}) == ("Halom", "Ottó", "Halom Ottó", "")
    assert assign.apart(wives[1], {"sticky": True, "shown": "Halomné Opál Frida", "surname": "Halomné", "given": "Opál Frida"}) == ("Halom", "Frida", "Halom", "Opál")
