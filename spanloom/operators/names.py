"""Name variants and the seed matcher.

A case's entities unfold into a dictionary of surface forms (cores, cases, titles, honorifics). Texts are matched against the
case's dictionary in one walk: at each boundary the longest form wins. The dictionary travels to the texts by a join on
the case, so it is as large as a case, not as the corpus.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.hungarian import CASES, inflect, inflect_name, inflect_organisation
from spanloom.functions.text import ACCENTED, LETTERS, PLAIN
from spanloom.operators.identifiers import tokens

#: Titles, honorifics, the kinds of forms that introduce an entity or stand for it, and context words.
TITLES = ("dr.", "Dr.", "DR.", "ifj.", "id.", "özv.", "néhai", "prof. dr.", "Prof. Dr.")
HONORIFICS = {"úr": "M", "asszony": "F", "kisasszony": "F"}
INTRODUCING = {"full", "reversed", "wife_full", "wife_maiden", "org", "org_short", "place"}
SHORTHAND = {"surname", "given", "family", "wife_surname", "org_stem", "org_abbrev", "initials_both", "initials_both_tight", "initials_surname", "initials_given"}
ROLE_WORDS = {
    "felperes", "alperes", "vádlott", "tanú", "sértett", "kérelmező", "kérelmezett", "beavatkozó", "adós", "hitelező", "kezes", "eladó", "vevő",
    "bérlő", "bérbeadó", "megbízó", "megbízott", "ügyvéd", "képviselő", "örökös", "indítványozó",
}
MATCHED_CASES = tuple(c for c in CASES if c not in ("WIFE", "FAM"))
STRONG, REJECT, EMBEDDED, UNKNOWN_SUFFIX, BARE_ACCENTS, BOOST = 92, 25, 90, 50, 70, 35
_COMPANY = re.compile(r"\s+(Nonprofit\s+)?(Kft\.|Zrt\.|Nyrt\.|Bt\.|Kkt\.|Kht\.|Ec\.|Rt\.)$", re.I)
_BEFORE, _AFTER = re.compile(f"[{LETTERS}0-9]"), re.compile(f"[{LETTERS}]")
_PLAIN = str.maketrans(ACCENTED, PLAIN)
_PLAIN_BEFORE, _PLAIN_AFTER = re.compile("[a-z0-9]"), re.compile("[a-z]")
_LINE_END = re.compile("[-\xad][ \t]*\r?\n[ \t]*")


@dataclass
class Entity:
    id: str
    kind: str  # person, org, place
    name: str = ""  # organisations and places
    surname: str = ""
    given: str = ""
    gender: str = "N"
    wife_of: str = ""
    maiden: str = ""
    abbreviation: str = ""
    overrides: dict = field(default_factory=dict)


@dataclass(slots=True)
class Form:
    text: str
    entity: str
    core: str
    case: str
    confidence: int
    prefix: str = ""
    tail: str = ""
    upper: bool = False


def strip_company_form(name: str) -> str:
    return _COMPANY.sub("", name).strip()


def company_form(name: str) -> str:
    found = _COMPANY.search(name)
    return found[0].strip() if found else ""


def cores(e: Entity, homonyms: frozenset = frozenset(), shared_given: frozenset = frozenset()) -> Iterator[tuple]:
    """(core, case -> form, confidence, takes titles, takes honorifics, bends)."""
    ov, common = e.overrides, lambda w: w.lower() in homonyms
    bent = lambda name, o=ov: (lambda case: inflect_name(name, case, o))
    if e.kind == "place":
        yield "place", bent(e.name), 100, False, False, True
        return
    if e.kind == "org":
        stem, form = strip_company_form(e.name), company_form(e.name)
        yield "org", lambda case: inflect_organisation(e.name, case, ov), 100, False, False, True
        if stem and stem != e.name:
            yield "org_stem", bent(stem), 70, False, False, True
        first = stem.split()[0] if stem.split() else ""
        if form and first and first != stem:
            yield "org_short", lambda case: inflect_organisation(f"{first} {form}", case, ov), 95, False, False, True
        if e.abbreviation:
            yield "org_abbrev", bent(e.abbreviation, ov | {"hyphenate": True}), 90, False, False, True
        return
    own = bool(e.given.strip()) and not (e.wife_of and not e.maiden)
    if own:
        yield "full", bent(f"{e.surname} {e.given}".strip()), 100, True, True, True
        yield "reversed", bent(f"{e.given} {e.surname}".strip()), 100, True, False, True
        yield "given", bent(e.given), 40 if e.given.lower() in shared_given or common(e.given) else 75, False, False, True
    yield "surname", bent(e.surname), 40 if common(e.surname) else 85, True, True, True
    yield "family", bent(inflect(e.surname, "FAM", ov), {}), 80, False, False, True
    if e.wife_of:
        yield "wife_full", bent(inflect_name(e.wife_of, "WIFE", ov), {}), 100, True, True, True
        husband = inflect(e.wife_of.split()[0], "WIFE")
        yield "wife_surname", bent(husband, {}), 90, False, True, True
        if e.maiden:
            yield "wife_maiden", bent(f"{husband} {e.maiden} {e.given}".strip()), 100, True, False, True
            yield "maiden_full", bent(f"{e.maiden} {e.given}".strip()), 100, True, True, True
            yield "maiden_surname", bent(e.maiden), 40 if common(e.maiden) else 80, False, True, True
    if own and e.surname.strip():
        s, g = e.surname.strip()[0].upper(), e.given.strip()[0].upper()
        yield "initials_both", lambda _: f"{s}. {g}.", 60, False, False, False
        yield "initials_both_tight", lambda _: f"{s}.{g}.", 60, False, False, False
        yield "initials_surname", lambda case: f"{s}. {inflect_name(e.given, case, ov)}", 80, False, False, True
        yield "initials_given", lambda _: f"{e.surname} {g}.", 85, False, False, False


@cache
def _honorific(word: str) -> dict[str, str]:
    return {case: f" {inflect(word, case)}" for case in MATCHED_CASES}


def forms(e: Entity, homonyms: frozenset = frozenset(), shared_given: frozenset = frozenset()) -> list[Form]:
    """All forms of an entity, of equal texts the most confident, of equals the first."""
    best: dict[str, Form] = {}

    def put(f: Form) -> None:
        if f.text.strip() and (f.text not in best or f.confidence > best[f.text].confidence):
            best[f.text] = f

    for core, form, confidence, titled, honoured, bends in cores(e, homonyms, shared_given):
        bent = {case: form(case) for case in (MATCHED_CASES if bends else ("NOM",))}
        for case, name in bent.items():
            put(Form(name, e.id, core, case, confidence))
        for title in TITLES if titled else ():
            for case, name in bent.items():
                put(Form(f"{title} {name}", e.id, core, case, max(confidence, STRONG), prefix=f"{title} "))
        for word, gender in HONORIFICS.items() if honoured else ():
            if e.gender in ("N", gender):
                for case, tail in _honorific(word).items():
                    put(Form(bent["NOM"] + tail, e.id, core, case, max(confidence, STRONG), tail=tail))
    return [*best.values()]


def unfolded(e: Entity, homonyms: frozenset, shared_given: frozenset) -> Iterable[tuple]:
    """(text, in capitals, without accents, core, case, confidence, prefix, tail) of an entity's forms; null where a spelling adds
    nothing. Names recur with other ids, so what a name unfolds into is kept."""
    if e.overrides:
        return _unfold(e, homonyms, shared_given)
    given = e.given.lower()
    return _kept_unfolding(e.kind, e.name, e.surname, e.given, e.gender, e.wife_of, e.maiden, e.abbreviation, homonyms, frozenset({given} & shared_given))


def _unfold(e: Entity, homonyms: frozenset, shared_given: frozenset) -> tuple[tuple, ...]:
    out = []
    for f in forms(e, homonyms, shared_given):
        shout, plain = f.text.upper(), f.text.translate(_PLAIN)
        bare = plain.lower() if plain != f.text and f.confidence >= 90 and " " in f.text else None
        out.append((f.text, shout if shout != f.text else None, bare, f.core, f.case, f.confidence, f.prefix, f.tail))
    return tuple(out)


@lru_cache(maxsize=256)
def _kept_unfolding(kind: str, name: str, surname: str, given: str, gender: str, wife_of: str, maiden: str, abbreviation: str, homonyms: frozenset, shared_given: frozenset) -> tuple[tuple, ...]:
    return _unfold(Entity("", kind, name, surname, given, gender, wife_of, maiden, abbreviation), homonyms, shared_given)


def shared_given_names(entities: Iterable[Entity]) -> frozenset:
    seen = Counter(e.given.lower() for e in entities if e.kind == "person" and e.given)
    return frozenset(g for g, n in seen.items() if n > 1)


def search_text(text: str) -> tuple[str, list[int]]:
    """Text without line-end hyphenation, and each character's place in the original."""
    out, places, at = [], [], 0
    for m in _LINE_END.finditer(text):
        out.append(text[at : m.start()])
        places += range(at, m.start())
        at = m.end()
    out.append(text[at:])
    return "".join(out), [*places, *range(at, len(text) + 1)]


class Words:
    """Words by their first characters. A walk over a text looks a place's stretches up, the longest first, so a dictionary costs
    no node for each of its characters."""

    def __init__(self, words: Iterable[str]):
        self.words = frozenset(words)
        sizes: dict[str, set[int]] = defaultdict(set)
        for word in self.words:
            sizes[word[:3]].add(len(word))
        #: The lengths of the words that begin alike, descending.
        self.sizes = {head: sorted(n, reverse=True) for head, n in sizes.items()}
        self.heads = sorted({len(head) for head in self.sizes}, reverse=True)

    def longest(self, text: str, at: int, after: re.Pattern) -> str | None:
        """The longest word at a place that no letter follows. Heads are of three characters but for shorter words, so a longer
        head has the longer words."""
        for n in self.heads:
            for size in self.sizes.get(text[at : at + n], ()):
                if text[at : at + size] in self.words and not after.match(text, at + size):
                    return text[at : at + size]
        return None


class Matcher:
    """All forms of a case's entities in one dictionary."""

    def __init__(self, entities: list[Entity], homonyms: frozenset = frozenset(), threshold: int = 80):
        self.threshold, self.homonyms = min(100, max(50, threshold)), homonyms
        self.given = {e.given.lower() for e in entities if e.kind == "person"}
        self.surname = {e.id: e.surname.lower() for e in entities if e.kind == "person"}
        shared = shared_given_names(entities)
        self.by_text: dict[str, list[Form]] = {}
        self.bare: dict[str, Form] = {}
        self.stems: list[tuple[str, str]] = []
        self.fragments: list[tuple[str, str, str]] = []
        for e in entities:
            for text, shout, plain, *rest in unfolded(e, homonyms, shared):
                f = Form(text, e.id, *rest)
                self.by_text.setdefault(text, []).append(f)
                if shout:
                    self.by_text.setdefault(shout, []).append(Form(shout, e.id, *rest, True))
                if plain:
                    self.bare[plain] = f
            if e.kind == "person":
                stems = [e.surname, e.given, f"{e.surname} {e.given}", *([e.wife_of, inflect_name(e.wife_of, "WIFE")] if e.wife_of else []), *([e.maiden] if e.maiden else [])]
                parts = {"surname": e.surname, "given": e.given, "maiden": e.maiden}
            else:
                stems = [e.name, *([strip_company_form(e.name), e.abbreviation] if e.kind == "org" else [])]
                parts = {"org": strip_company_form(e.name) if e.kind == "org" else e.name}
            self.stems += [(e.id, s) for s in stems if s.strip()]
            self.fragments += [(e.id, w.translate(_PLAIN).lower(), part) for part, value in parts.items() for w in value.split() if len(w) >= 3]
        self.words, self.bare_words = Words(self.by_text), Words(self.bare)
        self.owner: dict[str, str] = {}
        for entity, stem in self.stems:
            self.owner.setdefault(stem, entity)
        stems = "|".join(map(re.escape, sorted(self.owner, key=len, reverse=True)))
        self.suffixed = re.compile(f"(?<![{LETTERS}0-9])({stems})([{LETTERS}]{{1,14}})(?![{LETTERS}])") if stems else None

    def _context(self, text: str, start: int, end: int, f: Form) -> int:
        """What surrounds a weak form adds to its confidence; the first rule that holds counts."""
        before, after = text[max(0, start - 40) : start], text[end : end + 60]
        following = re.match(r"[\s,]*([^\s,.;:()]+)", after)
        word = following[1] if following else ""
        if re.search(r"(dr\.|Dr\.|DR\.|ifj\.|id\.|özv\.|néhai|prof\.)\s*$", before) or word.lower() in self.given:
            return 35
        if re.match("(úr|asszony|kisasszony)", word.lower()) or re.sub("[^a-záéíóöőúüű]", "", word.lower()) in ROLE_WORDS:
            return 30
        if re.match(r"\s*\(", after) and re.search("szül|anyja neve|lakcím|lakos|adóazonosító", after, re.I):
            return 30
        if not re.search(r"(^|[.!?]\s+|\n\s*)$", before):
            return 0
        bare = f.core == "surname" and not f.prefix and not f.tail and text[start:end].lower() in self.homonyms
        return -30 if bare and word and word[0] == word[0].lower() else -10

    def _disposition(self, confidence: int, ambiguous: bool) -> str:
        return "reject" if confidence < REJECT else "auto" if confidence >= self.threshold and not ambiguous else "review"

    def find(self, original: str) -> list[dict]:
        """Hits in text order: exact forms, forms without accents, fragments in addresses, unknown suffixes; then the discourse rule."""
        text, places = search_text(original)
        taken, hits = bytearray(len(text)), []

        def put(start: int, end: int, entity: str, core: str | None, case: str | None, confidence: int, ambiguous: bool = False, upper: bool = False, candidates: tuple = (), prefix: str = "", tail: str = "") -> None:
            taken[start:end] = b"\1" * (end - start)
            confidence = max(0, min(100, confidence))
            hits.append({"start": places[start], "end": places[end], "surface": original[places[start] : places[end]], "entity_id": entity, "core": core, "case_tag": case, "confidence": confidence, "ambiguous": ambiguous, "upper": upper, "candidates": list(candidates or (entity,)), "disposition": self._disposition(confidence, ambiguous), "prefix": prefix, "tail": tail})

        at = 0
        while at < len(text):
            found = None if at and _BEFORE.match(text, at - 1) else self.words.longest(text, at, _AFTER)
            if found is None:
                at += 1
                continue
            entries = self.by_text[found]
            ids = [*dict.fromkeys(f.entity for f in entries)]
            best = max(entries, key=lambda f: f.confidence)
            one_family = best.core in ("surname", "family") and len({self.surname.get(i) for i in ids}) == 1
            ambiguous = len(ids) > 1 and not one_family
            confidence = min(best.confidence, 40) if ambiguous else best.confidence
            if confidence < 90:
                confidence += self._context(text, at, at + len(found), best)
            put(at, at + len(found), best.entity, best.core, best.case, confidence, ambiguous, best.upper, tuple(ids), best.prefix, best.tail)
            at += len(found)
        folded = text.translate(_PLAIN).lower()
        for at in range(len(folded) if self.bare else 0):
            if (at == 0 or not _PLAIN_BEFORE.match(folded, at - 1)) and (needle := self.bare_words.longest(folded, at, _PLAIN_AFTER)):
                end, f = at + len(needle), self.bare[needle]
                if not any(taken[at:end]) and text[at:end] != f.text:
                    put(at, end, f.entity, f.core, f.case, BARE_ACCENTS, prefix=text[at : at + len(f.prefix)], tail=f.tail)
        for start, end, token, _ in tokens(text):
            low = token.translate(_PLAIN).lower()
            owner = next((i for i, needle, _ in self.fragments if fragment_places(low, needle)), None)
            if owner is not None and not any(taken[start:end]):
                put(start, end, owner, "identifier", "NOM", EMBEDDED)
        for m in self.suffixed.finditer(text) if self.suffixed else ():
            if m[2] == m[2].lower() and not any(taken[m.start() : m.end()]):
                put(m.start(), m.end(), self.owner[m[1]], None, None, UNKNOWN_SUFFIX)
        hits.sort(key=lambda h: h["start"])
        known: set[str] = set()
        for h in hits:
            if h["core"] in INTRODUCING and h["confidence"] >= self.threshold:
                known.add(h["entity_id"])
            elif h["core"] in SHORTHAND and h["entity_id"] in known and not h["ambiguous"] and h["confidence"] < 100:
                h["confidence"] = min(100, h["confidence"] + BOOST)
                h["disposition"] = self._disposition(h["confidence"], False)
        return hits


def fragment_places(token: str, needle: str) -> list[int]:
    """Where a name fragment stands in an address; three letters must stand alone."""
    edge = (f"(?<![{LETTERS}])", f"(?![{LETTERS}])") if len(needle) < 4 else ("", "")
    return [m.start() for m in re.finditer(f"{edge[0]}(?={re.escape(needle)}{edge[1]})", token)]


def rewrite_identifier(token: str, fragments: list[tuple[str, str]], replacement: dict[str, str]) -> str:
    """An address with its name fragments (needle, part) replaced, longest first, without accents and in lower case."""
    low, taken, pieces = token.translate(_PLAIN).lower(), set(), []
    for needle, part in sorted(fragments, key=lambda f: -len(f[0])):
        new = replacement.get(part)
        for at in fragment_places(low, needle) if new else ():
            span = range(at, at + len(needle))
            if taken.isdisjoint(span):
                taken.update(span)
                pieces.append((at, at + len(needle), new.translate(_PLAIN).lower()))
    out, at = "", 0
    for start, end, new in sorted(pieces):
        out, at = out + token[at:start] + new, end
    return out + token[at:]


#: Shares of a case's units, each of which may meet the case's entities in another task.
SHARES = 16
#: Forms that a task's matchers have before they are dropped and built again as needed.
HELD_FORMS = 200_000
ENTITY_COLUMNS = ("id", "kind", "name", "surname", "given", "gender", "wife_of", "maiden", "abbreviation")
HIT_SCHEMA = "start int, end int, surface string, entity_id string, core string, case_tag string, confidence int, ambiguous boolean, upper boolean, candidates array<string>, disposition string, prefix string, tail string"


class Held(dict):
    """Matchers by what their entities are: names recur from case to case, so cases with equal entities share one."""

    def __init__(self, make: Callable[[tuple], Matcher]):
        super().__init__()
        self.make, self.forms = make, 0

    def __missing__(self, cast: tuple) -> Matcher:
        if self.forms > HELD_FORMS:
            self.clear()
            self.forms = 0
        made = self[cast] = self.make(cast)
        self.forms += len(made.by_text)
        return made


def match(units: DataFrame, entities: DataFrame, case: str, by: list[str], text: str = "text", homonyms: Iterable[str] = (), threshold: int = 80) -> DataFrame:
    """(case, *by, HIT_SCHEMA): each unit's hits of its case's entities (``ENTITY_COLUMNS``; nulls count as empty).

    A case's entities are gathered into one row and joined to its units; a case with many units is dealt over ``SHARES`` tasks. A task builds one matcher for equal entities and holds some ``HELD_FORMS`` forms.
    """
    packed = entities.groupBy(case).agg(F.array_sort(F.collect_list(F.struct(*(F.coalesce(F.col(c), F.lit("")).alias(c) if c in entities.columns else F.lit("").alias(c) for c in ENTITY_COLUMNS)))).alias("_entities"))
    kinds = [(c, units.schema[c].dataType.simpleString()) for c in (case, *by)]
    common = frozenset(h.lower() for h in homonyms)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built = Held(lambda cast: Matcher([Entity(**dict(zip(ENTITY_COLUMNS, e, strict=True))) for e in cast], common, threshold))
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                *keys, value, found = row
                cast = tuple(tuple(e[c] for c in ENTITY_COLUMNS) for e in found)
                rows += [(*keys, *h.values()) for h in built[cast].find(value or "")]
            names = ["start", "end", "surface", "entity_id", "core", "case_tag", "confidence", "ambiguous", "upper", "candidates", "disposition", "prefix", "tail"]
            yield pd.DataFrame(rows, columns=[*(c for c, _ in kinds), *names])

    # A number that is said outright keeps small shuffles in many tasks: what follows costs far more than their bytes tell.
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64(*by, F.col(text)), F.lit(SHARES)).cast("int")
    dealt = units.select(case, *by, F.col(text).alias("_text"), share.alias("_share"))
    shares = dealt.select(case, "_share").distinct().join(packed.hint("merge"), case)
    joined = dealt.repartition(tasks, case, "_share").join(shares.repartition(tasks, case, "_share").hint("merge"), [case, "_share"]).drop("_share")
    return joined.mapInPandas(run, ", ".join([*(f"`{c}` {k}" for c, k in kinds), HIT_SCHEMA]))


def rewrite_addresses(hits: DataFrame, fragments: DataFrame, case: str) -> DataFrame:
    """``hits`` (surface) with replacement: e-mail addresses and urls with every name part of the case's entities replaced, null if
    none is in them. Where hits have a ``core``, those of core ``identifier`` are the addresses.

    ``fragments`` has (case, fragment, replacement) for all of a case's entities: an address may hold a person's name before
    the sign and a company's behind it. A case's fragments are gathered into one row; longer ones go first, of equal ones that of
    the first entity if they have its place ``no``.
    """
    first = ["no"] if "no" in fragments.columns else []
    packed = fragments.groupBy(case).agg(F.array_sort(F.collect_set(F.struct((-F.length("fragment")).alias("size"), "fragment", *first, "replacement"))).alias("_fragments"))
    by = [case]
    if "core" in hits.columns:
        by, packed = [case, "core"], packed.withColumn("core", F.lit("identifier"))

    @F.pandas_udf("string")
    def rewritten(surfaces: pd.Series, listed: pd.Series) -> pd.Series:
        out = []
        for surface, rows in zip(surfaces, listed, strict=True):
            rows = [] if rows is None else list(rows)
            new = rewrite_identifier(surface, [(r["fragment"], str(i)) for i, r in enumerate(rows)], {str(i): r["replacement"] for i, r in enumerate(rows)})
            out.append(None if new == surface else new)
        return pd.Series(out, dtype=object)

    return hits.join(packed, by, "left").withColumn("replacement", rewritten("surface", "_fragments")).drop("_fragments")
