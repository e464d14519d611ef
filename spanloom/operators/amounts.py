"""Money amounts: finding them, and rescaling a case's amounts so that sums still hold.

Amounts found in a unit are rows. Rescaling is planned per case: new values are Column arithmetic; sums a + b = c between a
case's values come from a join; values bound by sums are solved together in one small search per component.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from fractions import Fraction
from functools import reduce
from heapq import heappop, heappush
from itertools import islice
from math import lcm
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.hungarian import inflect, number_words, read_number_words, words_of
from spanloom.functions.text import LETTERS, LOWER

#: Currency spellings, words that announce an amount in words, base confidence in hundredths.
CURRENCY = {"ft": "HUF", "huf": "HUF", "forint": "HUF", "eur": "EUR", "euro": "EUR", "euró": "EUR", "usd": "USD", "dollár": "USD", "chf": "CHF", "frank": "CHF", "gbp": "GBP"}
CONFIDENCE = {"osszeg": 85, "osszeg_betuvel": 97}
#: The sentences of a plan's warnings.
WARNINGS = {
    "broken": "Elromlott végösszeg: az iratban %s + %s = %s %s, a csere után %s + %s = %s, de a végösszeg helyén %s áll. Ezt egy ügyvéd észreveszi — nézd át kézzel, vagy válts címkés módra.",
    "merged": "Összeolvadt összegek: %s egyaránt %s lett a kerekítés után, így az iratban két különböző tétel azonosnak látszik.",
    "unchanged": "Nem változott: a %s %s összeg a szorzás és kerekítés után önmaga maradt, tehát ez az adat NEM lett anonimizálva.",
    "unspellable": "A betűs alak („%s”) nem írható át: az új érték (%s) nem egész szám.",
}
UNGROUPED, UNGROUPED_FROM, AUTO = 8, 10_000, 80
ENDING_CASE = {
    "ot": "ACC", "at": "ACC", "et": "ACC", "öt": "ACC", "t": "ACC", "ra": "SUB", "re": "SUB", "ban": "INE", "ben": "INE", "ba": "ILL", "be": "ILL",
    "ból": "ELA", "ből": "ELA", "ról": "DEL", "ről": "DEL", "tól": "ABL", "től": "ABL", "nak": "DAT", "nek": "DAT", "nál": "ADE", "nél": "ADE",
    "hoz": "ALL", "hez": "ALL", "höz": "ALL", "ig": "TER", "ért": "CAU", "ként": "FOR", "on": "SUP", "en": "SUP", "ön": "SUP", "n": "SUP", "val": "INS", "vel": "INS",
}
_NUMBER = re.compile(r"(?<![0-9.,\-])([0-9]{1,3}(?:[ \xa0\u202f][0-9]{3})+|[0-9]{1,3}(?:\.[0-9]{3})+|[0-9]+)(,[0-9]{1,2}|,-)?")
_CURRENCY = re.compile(rf"(?:(Ft|FT|HUF|EURO|EUR|USD|CHF|GBP)(?:-([{LOWER}]{{1,5}}))?|(forint|euró|euro|dollár|frank)([{LOWER}]{{0,6}}))(?![{LETTERS}0-9])")
_BLANKS = re.compile(r"[ \xa0\t]*")
_SPELLED = re.compile(r"[ \xa0\t]*[,;]?[ \xa0\t]*\(?[ \xa0\t]*(?:azaz|szóval|betűvel|betűkkel)[ \xa0\t]*:?[ \xa0\t]+")
SCHEMA = "start int, end int, surface string, kind string, confidence int, disposition string, value double, currency string, number_start int, number_end int, separator string, decimals int, dash boolean, words_start int, words_end int, currency_suffix string"
_TYPES = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string())


def _skip(text: str, at: int) -> int:
    return _BLANKS.match(text, at).end()


def _spelled(text: str, at: int, value: float) -> tuple[int, int] | None:
    """The numeral in words at ``at`` if it has the value."""
    end = read_number_words(text, at, int(value)) if value == int(value) else None
    return end and (at, end)


def find_amounts(text: str) -> list[tuple]:
    """Rows of ``SCHEMA``: a number with a currency, with the same number in words if it is there; no two overlap."""
    out = []
    for m in _NUMBER.finditer(text):
        whole, rest = m[1], m[2] or ""
        separator = next((c for c in whole if not c.isdigit()), None)
        fraction = rest[1:] if rest not in ("", ",-") else ""
        value = int(re.sub("[^0-9]", "", whole)) + (int(fraction) / 10 ** len(fraction) if fraction else 0.0)
        at, in_words = _skip(text, m.end()), None
        if text[at : at + 1] == "(" and (found := _spelled(text, _skip(text, at + 1), value)) and text[(shut := _skip(text, found[1])) : shut + 1] == ")":
            in_words, at = found, _skip(text, shut + 1)
        money = _CURRENCY.match(text, at)
        if not money:
            continue
        end = money.end()
        if in_words is None and (said := _SPELLED.match(text, end)) and (found := _spelled(text, said.end(), value)):
            in_words, end = found, found[1]
            if again := _CURRENCY.match(text, _skip(text, end)):
                end = again.end()
            shut = _skip(text, end)
            if text[shut : shut + 1] == ")" and "(" in text[m.end() : found[0]]:
                end = shut + 1
        kind = "osszeg_betuvel" if in_words else "osszeg"
        confidence = CONFIDENCE[kind] - (UNGROUPED if separator is None and value >= UNGROUPED_FROM else 0)
        name, suffix = (money[1], money[2]) if money[1] else (money[3], money[4] or None)
        out.append((m.start(), end, text[m.start() : end], kind, confidence, "auto" if confidence >= AUTO else "review", float(value), CURRENCY[name.lower()], m.start(), m.end(), separator, len(fraction), rest == ",-", *(in_words or (None, None)), suffix))
    kept: list[tuple] = []
    for a in sorted(out, key=lambda a: (a[0] - a[1], -a[4], a[0])):
        if all(a[1] <= k[0] or k[1] <= a[0] for k in kept):
            kept.append(a)
    return sorted(kept)


def scan(units: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(*by, SCHEMA): each unit's amounts; null texts have none."""
    kinds = [(c, units.schema[c].dataType.simpleString()) for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for i, value in enumerate(batch.column(len(by)).to_pylist()):
                found = find_amounts(value or "")
                rows += found
                at += [i] * len(found)
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(_TYPES)
            names = [*by, *(f.split()[0] for f in SCHEMA.split(", "))]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns[: len(by)]), *(pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True))], names=names)

    return units.select(*by, F.col(text)).mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in kinds), SCHEMA]))


def rounding_step(value: Column, decimals: Column) -> Column:
    """The unit an amount is rounded to: its last decimal, else its trailing zeros, two leading digits always staying."""
    digits = F.abs(F.floor(value + 0.5)).cast("long").cast("string")
    zeros = F.length(digits) - F.length(F.regexp_replace(digits, "0+$", ""))
    power = F.least(zeros, F.greatest(F.lit(0), F.length(digits) - 2))
    return F.when(decimals > 0, F.pow(F.lit(10.0), -decimals)).when(digits == "0", 1.0).otherwise(F.pow(F.lit(10.0), power))


def round_to(value: Column, step: Column) -> Column:
    """Halves go up; six decimals are kept."""
    return F.round(F.floor(value / step + 0.5) * step, 6)


def format_number(value: Column, separator: Column, decimals: Column, dash: Column) -> Column:
    """A number in the shape of the one it replaces."""
    whole = F.floor(F.round(F.abs(value), 2)).cast("long").cast("string")
    grouped = F.reverse(F.regexp_replace(F.reverse(whole), "([0-9]{3})(?=[0-9])", "$1~"))
    body = F.when(separator.isNull(), whole).otherwise(F.replace(grouped, F.lit("~"), separator))
    cents = F.lpad(F.pmod(F.round(F.abs(value) * F.pow(F.lit(10.0), decimals)).cast("long"), F.pow(F.lit(10.0), decimals).cast("long")).cast("string"), 2, "0")
    tail = F.when(decimals > 0, F.concat(F.lit(","), F.substring(cents, F.lit(3) - decimals, decimals))).when(dash, ",-").otherwise("")
    return F.concat(F.when(value < 0, "-").otherwise(""), body, tail)


def distinct_values(amounts: DataFrame, case: str) -> DataFrame:
    """(case, currency, value, step): a case's values with their coarsest step."""
    return amounts.groupBy(case, "currency", "value").agg(F.max(rounding_step(F.col("value"), F.col("decimals"))).alias("step"))


def sums(values: DataFrame, case: str, most: int = 200) -> DataFrame:
    """(case, currency, a, b, c) with a <= b and a + b = c among a case's positive values. Currencies of over ``most`` values have none.

    The sum is an equi-join on its result, so only pairs within a currency of a case are formed.
    """
    keys = [case, "currency"]
    few = values.join(values.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") <= most), keys)
    a, b, c = (few.where("value > 0").select(*keys, F.col("value").alias(x)) for x in "abc")
    added = a.join(b, keys).where("a <= b").withColumn("c", F.round(F.col("a") + F.col("b"), 6)).where("c <> a AND c <> b")
    return added.join(c, [*keys, "c"], "left_semi").select(*keys, "a", "b", "c")


def independent(relations: Iterable[tuple[int, int, int]], n: int) -> tuple[list[tuple[int, int, int]], dict[int, dict[int, Fraction]]]:
    """The relations (places a, b, c of ``n`` values, a + b = c) that no others imply, and each place that they settle as shares of earlier ones.

    All sums hold for the old values, so one place at least stays open; relations behind that are implied.
    """
    kept: list[tuple[int, int, int]] = []
    settled: dict[int, dict[int, Fraction]] = {}
    within: dict[int, set[int]] = {}
    for r in relations:
        if len(settled) >= n - 1:
            break
        row: dict[int, Fraction] = {}
        for at, sign in zip(r, (1, 1, -1), strict=True):
            for p, x in settled[at].items() if at in settled else ((at, 1),):
                row[p] = row.get(p, Fraction(0)) + sign * x
        row = {p: x for p, x in row.items() if x}
        if not row:
            continue
        kept.append(r)
        last = max(row)
        share = -row.pop(last)
        settled[last] = {p: x / share for p, x in row.items()}
        for other in within.pop(last, ()):
            x = settled[other].pop(last)
            for p, y in settled[last].items():
                if z := settled[other].get(p, 0) + x * y:
                    settled[other][p] = z
                    within.setdefault(p, set()).add(other)
                else:
                    del settled[other][p]
                    within[p].discard(other)
        for p in settled[last]:
            within.setdefault(p, set()).add(last)
    return kept, settled


class Grid:
    """Bounds of values on a common grid, narrowed by sums and by all values being different. Each bound knows, as bits, which decisions it rests on."""

    #: Rows of more terms than this rule out too little to be read; the sums that they come from are read all the same.
    TERMS = 16

    def __init__(self, near: list[int], reach: int, relations: list[tuple[int, int, int]]):
        n = len(near)
        self.low, self.high = [max(1, x - reach) for x in near], [x + reach for x in near]
        self.for_low, self.for_high, self.weight = [0] * n, [0] * n, [1] * n
        self.trail: list[tuple[int, int, int, int, int]] = []
        kept, settled = independent(relations, n)
        rows = {tuple(sorted(({a: 1, b: 1} | ({a: 2} if a == b else {}) | {c: -1}).items())) for a, b, c in kept}
        for at, shares in settled.items():
            if len(shares) < self.TERMS:
                whole = lcm(*(x.denominator for x in shares.values()))
                rows.add(tuple(sorted([(at, -whole), *((p, int(x * whole)) for p, x in shares.items())])))
        self.rows = sorted(rows)
        self.touching: list[list[int]] = [[] for _ in near]
        for i, row in enumerate(self.rows):
            for p, _ in row:
                self.touching[p].append(i)
        # Values that may meet stand in a run of the ascending order.
        self.run, self.runs = [0] * n, [[0]]
        for p in range(1, n):
            if near[p] - near[p - 1] > 2 * reach:
                self.runs.append([])
            self.run[p] = len(self.runs) - 1
            self.runs[-1].append(p)

    def bound(self, p: int, low: int, high: int, why_low: int, why_high: int) -> None:
        self.trail.append((p, self.low[p], self.high[p], self.for_low[p], self.for_high[p]))
        self.low[p], self.high[p], self.for_low[p], self.for_high[p] = low, high, why_low, why_high

    def undo(self, to: int) -> None:
        while len(self.trail) > to:
            p, self.low[p], self.high[p], self.for_low[p], self.for_high[p] = self.trail.pop()

    def narrow(self, changed: Iterable[int]) -> int | None:
        """Bounds that follow from changed ones; the decisions that a contradiction rests on (0: none, there is no solution), else None."""
        low, high = self.low, self.high
        due, runs = dict.fromkeys(i for p in changed for i in self.touching[p]), {self.run[p] for p in changed}
        while due:
            row = self.rows[i := next(iter(due))]
            del due[i]
            least = sum(c * (low[p] if c > 0 else high[p]) for p, c in row)
            most = sum(c * (high[p] if c > 0 else low[p]) for p, c in row)
            for p, c in row:
                small, big = (c * low[p], c * high[p]) if c > 0 else (c * high[p], c * low[p])
                # The others' most bounds c * p from below, their least from above.
                floor, ceiling = big - most, small - least
                new_low, new_high = (-(-floor // c), ceiling // c) if c > 0 else (-(-ceiling // c), floor // c)
                if new_low <= low[p] and new_high >= high[p]:
                    continue
                why_most = why_least = 0
                for q, d in row:
                    if q != p:
                        why_most |= self.for_high[q] if d > 0 else self.for_low[q]
                        why_least |= self.for_low[q] if d > 0 else self.for_high[q]
                why_low, why_high = (why_most, why_least) if c > 0 else (why_least, why_most)
                if new_low <= low[p]:
                    new_low, why_low = low[p], self.for_low[p]
                if new_high >= high[p]:
                    new_high, why_high = high[p], self.for_high[p]
                if new_low > new_high:
                    for q, _ in row:
                        self.weight[q] += 1
                    return why_low | why_high
                self.bound(p, new_low, new_high, why_low, why_high)
                least += c * (new_low if c > 0 else new_high) - small
                most += c * (new_high if c > 0 else new_low) - big
                due |= dict.fromkeys(self.touching[p])
                runs.add(self.run[p])
        return next((why for r in sorted(runs) if (why := self.crowded(self.runs[r])) is not None), None)

    def crowded(self, members: list[int]) -> int | None:
        """Why values of a run cannot all be different, None if they can: each place of the grid goes to the value that must be placed soonest."""
        if len(members) < 2:
            return None
        low, high = self.low, self.high
        coming, waiting, placed = sorted(members, key=lambda p: -low[p]), [], {}
        at = low[coming[-1]]
        while coming or waiting:
            if not waiting:
                at = max(at, low[coming[-1]])
            while coming and low[coming[-1]] <= at:
                heappush(waiting, high[coming.pop()])
            last = heappop(waiting)
            if last < at:
                while placed.get(at - 1, last + 1) <= last:
                    at -= 1
                full = [p for p in members if low[p] >= at and high[p] <= last]
                for p in full:
                    self.weight[p] += 1
                return reduce(or_, (self.for_low[p] | self.for_high[p] for p in full))
            placed[at] = last
            at += 1
        return None

    def solution(self, like: list[int]) -> list[int] | None:
        """Any values within the bounds that keep all sums and are all different, alike if they may be; None if there are none. Bounds are left as they were.

        Values that took part in most contradictions are decided first; from a contradiction it goes back to the last decision that it rests on.
        """
        start, low, high = len(self.trail), self.low, self.high
        decisions: list[list] = []
        met, patience = 0, 50
        while (p := max((i for i in range(len(low)) if low[i] < high[i]), key=lambda i: self.weight[i] / (high[i] - low[i]), default=None)) is not None:
            choices = sorted(range(low[p], high[p] + 1), key=lambda m: abs(m - like[p]))
            decisions.append([p, iter(choices), len(self.trail), self.for_low[p] | self.for_high[p]])
            why: int | None = 0
            while why is not None:
                p, choices, before, blamed = decisions[-1]
                self.undo(before)
                bit = 1 << (len(decisions) - 1)
                if (m := next(choices, None)) is not None:
                    self.bound(p, m, m, bit, bit)
                    why = self.narrow([p])
                else:
                    why = blamed
                    decisions.pop()
                while why is not None and decisions and not why >> (len(decisions) - 1) & 1:
                    self.undo(decisions.pop()[2])
                if not decisions:
                    self.undo(start)
                    return None
                if why is not None:
                    decisions[-1][3] |= why & ~(1 << (len(decisions) - 1))
                    met += 1
            if met > patience:
                # It begins again with what the weights tell by now, ever later, so the search stays complete.
                met, patience = 0, patience * 3 // 2
                self.undo(start)
                decisions.clear()
        found = [*low]
        self.undo(start)
        return found


def solve(targets: dict[float, float], step: float, relations: list[tuple[float, float, float]], reach: int = 2) -> dict[float, float] | None:
    """New values for a component's old ones on a grid of ``step``, within ``reach`` steps of their targets, all different, all sums kept; None if there are none.

    ``relations`` hold for the old values. Of all solutions it is the first by ascending targets, the nearest choices coming first.
    Components may be of any size, the search is complete: each value in turn gets its nearest choice that some solution has, and
    the last solution found answers for most. ``reach`` says what counts as a solution: beyond it an amount is no longer in proportion.
    """
    order = sorted(targets, key=targets.get)
    place = {v: i for i, v in enumerate(order)}
    grid = Grid([int(targets[v] / step + 0.5) for v in order], reach, [tuple(place[x] for x in r) for r in relations])
    distance = lambda p: lambda m: abs(round(m * step, 6) - targets[order[p]])
    known = [min(range(a, b + 1), key=distance(p), default=0) for p, (a, b) in enumerate(zip(grid.low, grid.high, strict=True))]
    if not order or 0 in known or grid.narrow(range(len(order))) is not None or (known := grid.solution(known)) is None:
        return None
    for p in range(len(order)):
        for m in sorted(range(grid.low[p], grid.high[p] + 1), key=distance(p)):
            before = len(grid.trail)
            grid.bound(p, m, m, 0, 0)
            if grid.narrow([p]) is None and (m == known[p] or (other := grid.solution(known)) is not None):
                known = known if m == known[p] else other
                break
            grid.undo(before)
    return {v: round(x * step, 6) for v, x in zip(order, known, strict=True)}


def plan_case(values: list[tuple[str, float, float]], factor: float, relations: list[tuple[str, float, float, float]]) -> tuple[dict, list[tuple]]:
    """((currency, old) -> new, relation report): scaled and rounded values, sums solved together where they can be."""
    steps = {(c, v): s for c, v, s in values}
    root = {k: k for k in steps}

    def top(k):
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for cur, *r in relations:
        for other in r[1:]:
            root[top((cur, other))] = top((cur, r[0]))
    groups: dict[tuple, dict[tuple, None]] = {}
    bound: dict[tuple, list[tuple]] = {}
    for cur, *r in relations:
        groups.setdefault(top((cur, r[0])), {}).update(dict.fromkeys((cur, v) for v in r))
        bound.setdefault(top((cur, r[0])), []).append(tuple(r))
    for members in groups.values():
        least = min(steps[k] for k in members)
        steps |= dict.fromkeys(members, least)
    new = {k: round(int(k[1] * factor / steps[k] + 0.5) * steps[k], 6) for k in steps}
    for head, members in groups.items():
        if found := solve({v: v * factor for _, v in members}, steps[head], bound[head]):
            new |= {(head[0], v): x for v, x in found.items()}
    mended = set()
    for cur, a, b, c in relations:
        total = round(new[cur, a] + new[cur, b], 6)
        if total != new[cur, c] and abs(total - new[cur, c]) <= steps[cur, c]:
            new[cur, c] = total
            mended.add((cur, a, b, c))
    report = [(*r, new[r[0], r[1]], new[r[0], r[2]], new[r[0], r[3]], round(new[r[0], r[1]] + new[r[0], r[2]], 6) == new[r[0], r[3]], r in mended) for r in relations]
    return new, report


def case_sums(values: Iterable[float]) -> Iterator[tuple[float, float, float]]:
    """(a, b, c) with a <= b and a + b = c among the positive ones of a currency's values, however many they are."""
    own = sorted(v for v in set(values) if v > 0)
    there = set(own)
    for i, a in enumerate(own):
        for b in islice(own, i, None):
            if (c := round(a + b, 6)) > own[-1]:
                break
            if c in there and c not in (a, b):
                yield a, b, c


def rescale(values: DataFrame, case: str, factor: str) -> DataFrame:
    """(case, currency, value, new_value): the plan of each case; ``factor`` names the column of its factor. A case's distinct amounts fit one task."""

    def plan(vs: list[tuple[str, float, float]], by: float) -> list[dict]:
        found = [(cur, *r) for cur in sorted({c for c, _, _ in vs}) for r in case_sums(v for c, v, _ in vs if c == cur)]
        return [{"currency": c, "value": v, "new_value": x} for (c, v), x in plan_case(vs, by, found)[0].items()]

    @F.pandas_udf("array<struct<currency:string,value:double,new_value:double>>")
    def planned(cases: pd.Series, factors: pd.Series) -> pd.Series:
        return pd.Series([plan([(v["currency"], v["value"], v["step"]) for v in vs], by) for vs, by in zip(cases, factors, strict=True)])

    # A case's values travel in one row, so thousands of cases share a batch.
    packed = values.groupBy(case).agg(F.array_sort(F.collect_list(F.struct("currency", "value", "step"))).alias("_values"), F.min(factor).cast("double").alias("_factor"))
    return packed.select(case, F.explode(planned("_values", "_factor")).alias("_v")).select(case, "_v.*")


def number_text(value: Column) -> Column:
    """A number as warnings show it: whole, or with the decimals that it has (six at most)."""
    return F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(value.cast("decimal(38,6)").cast("string"), "0+$", ""))


def relation_report(plan: DataFrame, relations: DataFrame, case: str) -> DataFrame:
    """(case, currency, a, b, c, new_a, new_b, new_c, kept) of relations a + b = c under a plan (case, currency, value, new_value).

    The final values are measured, so a repair that broke another sum shows. A relation with a value that the plan lacks has no row.
    """
    out = relations.select(case, "currency", "a", "b", "c")
    for x in "abc":
        out = out.join(plan.select(case, "currency", F.col("value").alias(x), F.col("new_value").alias(f"new_{x}")), [case, "currency", x])
    return out.select(case, "currency", "a", "b", "c", "new_a", "new_b", "new_c", (F.round(F.col("new_a") + F.col("new_b"), 6) == F.col("new_c")).alias("kept"))


def plan_warnings(plan: DataFrame, relations: DataFrame, case: str, here: DataFrame | None = None, spelled: DataFrame | None = None) -> DataFrame:
    """(case, kind, currency, value, message) of a plan, each once.

    ``broken`` sums (value: the old total), different values ``merged`` into one new value (value: the new one; the old ones
    ascending), values left ``unchanged`` among those that stand ``here`` (case, currency, value; all where it is not given: values
    brought in from a case's other documents shape the grid only), and ``unspellable`` words (``spelled``: case, currency, value,
    words) whose new value is not whole.
    """
    shown = lambda c: number_text(F.col(c))
    fill = lambda kind, *parts: F.format_string(WARNINGS[kind], *parts)
    row = lambda df, kind, value, *parts: df.select(case, F.lit(kind).alias("kind"), "currency", F.col(value).alias("value"), fill(kind, *parts).alias("message"))
    broken = relation_report(plan, relations, case).where("NOT kept").withColumn("total", F.round(F.col("new_a") + F.col("new_b"), 6))
    out = row(broken, "broken", "c", *map(shown, "abc"), F.col("currency"), shown("new_a"), shown("new_b"), shown("total"), shown("new_c"))
    one = plan.groupBy(case, "currency", "new_value").agg(F.sort_array(F.collect_set("value")).alias("old")).where(F.size("old") > 1)
    out = out.unionByName(row(one, "merged", "new_value", F.array_join(F.transform("old", number_text), " és "), shown("new_value")))
    same = plan.where("new_value = value")
    if here is not None:
        same = same.join(here.select(case, "currency", "value"), [case, "currency", "value"], "left_semi")
    out = out.unionByName(row(same, "unchanged", "value", shown("value"), F.col("currency")))
    if spelled is not None:
        lost = spelled.select(case, "currency", "value", "words").join(plan.where("new_value <> floor(new_value)"), [case, "currency", "value"])
        out = out.unionByName(row(lost, "unspellable", "value", F.col("words"), shown("new_value")))
    return out.distinct()


def plan_edits(found: DataFrame, plan: DataFrame, case: str) -> DataFrame:
    """``found`` (rows of ``scan`` with their case) with (edit_start, edit_end, replacement) for each change in their text: the number
    in its own shape, and the same number in words, capital where it was. Words of a value that is not whole stay as they are."""
    new = F.col("new_value")
    was = F.substring("surface", F.col("words_start") - F.col("start") + 1, F.lit(1))
    capital = (was == F.upper(was)) & (was != F.lower(was))
    words = F.when(capital, F.concat(F.upper(F.substring("_words", 1, 1)), F.expr("substring(_words, 2)"))).otherwise(F.col("_words"))
    number = F.struct(F.col("number_start").alias("edit_start"), F.col("number_end").alias("edit_end"), format_number(new, F.col("separator"), F.col("decimals"), F.col("dash")).alias("replacement"))
    spelled = F.when(F.col("words_start").isNotNull() & (new == F.floor(new)), F.struct(F.col("words_start").alias("edit_start"), F.col("words_end").alias("edit_end"), words.alias("replacement")))
    planned = found.join(plan.select(case, "currency", "value", "new_value"), [case, "currency", "value"]).withColumn("_words", words_of(new.cast("long")))
    return planned.withColumn("_edit", F.explode(F.array_compact(F.array(number, spelled)))).select(*found.columns, "_edit.*")


def label_text(suffix: str | None) -> str:
    """``[összeg]`` with the currency's case ending."""
    case = ENDING_CASE.get((suffix or "").lower())
    return f"[{inflect('összeg', case) if case else 'összeg'}]"


def spelled_like(old: str, value: int) -> str:
    words = number_words(value)
    return words[0].upper() + words[1:] if old[:1].isupper() else words
