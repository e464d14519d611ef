from spanloom.operators import assign as A
from spanloom.operators import names as N
from spanloom.operators import ner as R
from spanloom.operators import parties as P
from spanloom.operators import verify as V
from spanloom.plans.catalog import THEME

CAST = [
    N.Entity("1", "person", surname="Kovács", given="János", gender="M"),
    N.Entity("2", "person", surname="Kovács", given="Jánosné", gender="F", wife_of="Kovács János"),
    N.Entity("3", "org", name="Aranykalász Agrár Kft.", abbreviation="AA"),
]


def surfaces(found):
    return [x[0] for x in found["residual"]]


def test_matcher():
    hits = N.Matcher(CAST).find("Kovács János felperes. Kovácsnak az Aranykalász Kft.-vel volt pere. KOVÁCS JÁNOSNÉ is. kovacs.janos@x.hu Kovácsostul, kovacs janosnak")
    assert [(h["surface"], h["core"], h["case_tag"]) for h in hits] == [
        ("Kovács János", "full", "NOM"), ("Kovácsnak", "surname", "DAT"), ("Aranykalász Kft.-vel", "org_short", "INS"), ("KOVÁCS JÁNOSNÉ", "wife_full", "NOM"),
        ("kovacs.janos@x.hu", "identifier", "NOM"), ("Kovácsostul", None, None), ("kovacs janosnak", "full", "DAT"),
    ]
    assert [h["disposition"] for h in hits] == ["auto"] * 5 + ["review"] * 2


def test_hyphenated_line_ends_keep_places():
    text = "a Kovács Já-\nnos nevű"
    (hit,) = N.Matcher(CAST[:1]).find(text)
    assert text[hit["start"] : hit["end"]] == "Kovács Já-\nnos"


def test_addresses_are_rewritten():
    assert N.rewrite_identifier("kovacs.janos@x.hu", [("kovacs", "surname"), ("janos", "given")], {"surname": "Gránit", "given": "Ottó"}) == "granit.otto@x.hu"


def test_wife_takes_the_new_surname_and_runs_are_stable():
    first, again = (A.assign_case(CAST, THEME, "titok") for _ in range(2))
    assert first == again and first["2"]["surname"] == first["1"]["surname"] and first["2"]["shown"].endswith("né")
    assert first["3"]["shown"].endswith("Agrár Kft.")
    kept = A.assign_case(CAST, THEME, "masik", {"1": ("person", "Kovács János", "Opál Edvin")})
    assert kept["1"]["shown"] == "Opál Edvin" and kept["2"]["surname"] == "Opál"


def test_exhausted_pools_number_names():
    many = [N.Entity(str(i), "person", surname=f"V{i}", given=f"G{i}") for i in range(30)]
    shown = [x["surname"] for x in A.assign_case(many, THEME, "s").values()]
    assert len(set(shown)) == 30


def test_gate():
    s = lambda t, **k: V.verify(t, [], **k)
    assert s("A felperes adóazonosító jele: 8442130976, igen.")["residual"][0][1] == "adóazonosító jel"
    assert s("A kártya száma 4263982640269299, ez nem azonosító jel.")["residual_total"] == 0
    assert s("A kártérítés összege 123 456 789 Ft, amit meg kell fizetni.")["residual_total"] == 0
    spread = s("a nyilvántartott adóazonosító: 8442 130 976.", literals=["8442130976"])
    assert not spread["ok"] and spread["residual_total"] == 0
    assert s("A bíróság ügyszáma: 10402142-49575354-56561008.", keep_numbers=["10402142-49575354-56561008"])["residual_total"] == 0
    assert s("A tárgyaláson dr. Sárközivel és Illés Katalinnal egyeztetett.", keep=["dr. Sárközi Tamás", "dr. Illés Katalin"])["residual_total"] == 0
    assert s("A Kőszikla Ottónak fizetendő összeget a Kőszikla nem vette át.", pseudonyms=["Kőszikla Ottó"])["residual_total"] == 0
    assert not V.verify("A szerződést Kovács János írta alá.", CAST)["ok"]
    assert "Zsombor" in surfaces(s("A tanú ifj. Zsombor nevű személy volt.")) and "Zsombor" not in surfaces(s("Elutasította. Zsombor tanú volt."))
    many = s(", ".join(["a per során Zsombor tanú"] * 12) + ", adóazonosító jel: 8442130976", limit=3)
    assert many["residual_total"] == 13 and len(many["residual"]) == 3 and many["residual"][0][1] == "adóazonosító jel"
    assert s("A felperes lakcíme [lakcím], a neve [NÉV-1] a szerződésben.")["residual_total"] == 0


def test_structure_rules(spark):
    text = "Felperes: Kovács János\nAz Aranykalász Agrár Kft. ellen. Nagy Péter tanú és Kovács Jánosnak írt. Az eljáró bíró: dr. Vasvári Anikó. Szentendrei Járásbíróság"
    found, keep = P.detect(spark.createDataFrame([(1, text), (2, None)], "doc long, text string"), "doc")
    assert {(r.name, r.kind) for r in found.collect()} >= {("Kovács János", "person"), ("Aranykalász Agrár Kft.", "org"), ("Nagy Péter", "person")}
    assert any("Vasvári" in r.name for r in keep.collect())


def test_inflected_names_merge_but_wives_do_not():
    hosts = P.merge_inflected(["Kovács János", "Kovács Jánosnak", "Kovács Jánosné"])
    assert hosts["Kovács Jánosnak"] == "Kovács János" and hosts["Kovács Jánosné"] == "Kovács Jánosné"


def test_wordpiece_and_windows(spark):
    t = R.WordPiece({"[UNK]": 0, "ko": 1, "##vács": 2, ".": 3})
    assert [(x[2], x[3], x[4]) for x in t.tokenize("kovács.")] == [("ko", 0, 2), ("##vács", 2, 6), (".", 6, 7)]
    docs = spark.createDataFrame([(1, [*range(1000)]), (2, []), (3, [1])], "doc long, t array<int>")
    rows = R.token_windows(docs, "t", ["doc"]).orderBy("doc", "window_no").collect()
    assert [(r.doc, r.first, len(r.tokens)) for r in rows] == [(1, 0, 510), (1, 382, 510), (1, 764, 236), (3, 0, 1)]
