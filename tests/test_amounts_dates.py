import datetime as dt
import itertools

import pytest

from spanloom.functions import keyed
from spanloom.operators import amounts as A
from spanloom.operators import dates as D


@pytest.mark.parametrize(
    ("text", "value", "surface"),
    [
        ("1 250 000 Ft", 1250000, "1 250 000 Ft"), ("1.250.000,- Ft", 1250000, "1.250.000,- Ft"), ("1250000 forint", 1250000, "1250000 forint"),
        ("12 500 EUR", 12500, "12 500 EUR"), ("havi 85.000 Ft", 85000, "85.000 Ft"), ("12,50 EUR", 12.5, "12,50 EUR"),
        ("1 250 000 (egymillió-kétszázötvenezer) forint", 1250000, "1 250 000 (egymillió-kétszázötvenezer) forint"),
        ("4 800 000 Ft, azaz négymillió-nyolcszázezer forint", 4800000, "4 800 000 Ft, azaz négymillió-nyolcszázezer forint"),
    ],
)
def test_amounts(text, value, surface):
    (found,) = A.find_amounts(text)
    assert found[2] == surface and found[6] == value


@pytest.mark.parametrize("text", ["a Ptk. 6:383. §-a alapján", "2016. évi CXXX. törvény 170. §-a", "12.P.20.845/2026/8.", "TAJ szám: 111 111 110", "15 napon belül"])
def test_no_amounts(text):
    assert A.find_amounts(text) == []


def test_sums_survive_rescaling():
    values = [("HUF", v, s) for v, s in ((3000000.0, 100000.0), (1800000.0, 100000.0), (4800000.0, 100000.0), (85000.0, 1000.0))]
    new, report = A.plan_case(values, 1.137, [("HUF", 1800000.0, 3000000.0, 4800000.0)])
    assert new["HUF", 1800000.0] + new["HUF", 3000000.0] == new["HUF", 4800000.0] and report[0][-2]
    assert all(0.75 < x / v < 1.3 for (_, v), x in new.items())


def test_factor_and_shift_are_stable_and_in_range():
    for secret in ("a", "b", "per-1", "x" * 100):
        assert keyed.amount_factor(secret) == keyed.amount_factor(secret)
        assert 0.8 <= keyed.amount_factor(secret) <= 1.25 and not 0.97 < keyed.amount_factor(secret) < 1.03
        assert 30 <= abs(keyed.date_shift(secret)) <= 400


@pytest.mark.parametrize(
    ("text", "surface", "ymd"),
    [
        ("2026. június 24.", "2026. június 24.", (2026, 6, 24)), ("2026.06.24.", "2026.06.24.", (2026, 6, 24)), ("2026. VI. 24.", "2026. VI. 24.", (2026, 6, 24)),
        ("június 24-én", "június 24-én", (None, 6, 24)), ("a 2026. június 24-i szerződés", "2026. június 24-i", (2026, 6, 24)),
        ("2025 februárjában", "2025 februárjában", (2025, 2, None)), ("júniusában", "júniusában", (None, 6, None)),
    ],
)
def test_dates(text, surface, ymd):
    (h,) = D.find_dates(text)
    assert h["surface"] == surface and (h["year"], h["month"], h["day"]) == ymd
    if h["year"]:
        assert D.render(h, *D.shifted(h, 0, 2025)) == surface


@pytest.mark.parametrize("text", ["2016. évi CXXX. törvény 170. §-a", "12.P.20.845/2026/8.", "2000 Szentendre, Bükkös part 14.", "cégjegyzékszám: 13-09-184627"])
def test_no_dates(text):
    assert D.find_dates(text) == []


def test_neighbours_give_month_and_year():
    a, b = D.find_dates("2025. június 20-ától 24-éig")
    assert (b["kind"], b["year"], b["month"], b["day"]) == ("nap", 2025, 6, 24)
    _, second = D.find_dates("2025 júniusa és szeptembere között")
    assert second["year"] == 2025 and second["inherited"]


def test_intervals_survive_the_shift():
    text = "Kelt 2025. március 14. napján, esedékes 2025. december 31-én."
    first, last = D.find_dates(text)
    moved = [dt.date(*D.shifted(h, -77, 2025)) for h in (first, last)]
    assert (moved[1] - moved[0]).days == (dt.date(2025, 12, 31) - dt.date(2025, 3, 14)).days


def _brute(targets, step, relations):
    """The first solution by plain trial."""
    order = sorted(targets, key=targets.get)
    near = [[x for d in range(-2, 3) if (x := round((int(targets[v] / step + 0.5) + d) * step, 6)) > 0] for v in order]
    near = [sorted(xs, key=lambda x, v=v: abs(x - targets[v])) for xs, v in zip(near, order, strict=True)]
    fits = lambda found: len(set(found.values())) == len(found) and all(round(found[a] + found[b], 6) == found[c] for a, b, c in relations)
    return next((found for xs in itertools.product(*near) if fits(found := dict(zip(order, xs, strict=True)))), None)


@pytest.mark.parametrize("own", [(1, 2, 3, 4, 5), (10, 20, 30, 50, 70), (7, 9, 16, 25, 41), (0.1, 0.2, 0.3, 0.7, 1.0), (3, 6, 12, 24, 48)])
@pytest.mark.parametrize("factor", [0.8, 0.8437, 1.0619, 1.25])
def test_the_solution_is_the_first_by_trial(own, factor):
    own, step = [float(x) for x in own], 0.1 if 0.1 in own else 1.0
    relations = list(A.case_sums(own))
    targets = {v: v * factor for v in own}
    assert relations and A.solve(targets, step, relations) == _brute(targets, step, relations)


def test_sums_of_more_than_nine_amounts_are_solved_together():
    parts = [1234.0, 2345.0, 3456.0, 4567.0, 5678.0, 6789.0, 7891.0, 8912.0]
    totals = list(itertools.accumulate(parts))
    own = sorted({*parts, *totals})
    relations = [("HUF", *r) for r in A.case_sums(own)]
    assert len(own) == 15 and len(relations) == 7
    for factor in (0.8123, 0.9377, 1.0619, 1.2344):
        new, report = A.plan_case([("HUF", v, 1.0) for v in own], factor, relations)
        assert all(r[-2] for r in report) and len(set(new.values())) == 15
        assert all(abs(x - v * factor) <= 2.5 for (_, v), x in new.items())


def test_crowded_amounts_have_no_solution_and_none_is_made_up():
    # A hundred neighbours times 0.8 have 85 places within two steps.
    own = [1000.0 + i for i in range(100)] + [2000.0 + i for i in range(0, 199, 3)]
    assert A.solve({v: v * 0.8 for v in own}, 1.0, list(A.case_sums(own))) is None


def test_a_case_of_more_than_two_hundred_amounts_keeps_its_sums(spark):
    parts = [(10_007 + 37 * i * i, 5_000_011 + 911 * i * i) for i in range(120)]
    own = sorted({float(x) for a, b in parts for x in (a, b, a + b)})
    sums = [(float(a), float(b), float(a + b)) for a, b in parts]
    assert len(own) > 300
    values = spark.createDataFrame([(1, "HUF", v, 1.0, 0.8437) for v in own], "c int, currency string, value double, step double, factor double")
    new = {r["value"]: r["new_value"] for r in A.rescale(values, "c", "factor").collect()}
    assert len(new) == len(own) and all(new[a] + new[b] == new[c] for a, b, c in sums)
