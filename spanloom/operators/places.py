"""Addresses and plots of land, read word by word from a place in a text that may begin or hold one."""

from __future__ import annotations

import re
from collections.abc import Iterator

from spanloom.functions.text import LETTERS, LOWER, UPPER

#: What may follow a street's name, whole or shortened; words for levels, doors and plots.
STREETS = frozenset("körútja körút sugárútja sugárút rakpart part utcája utca útja út fasor sétány lakótelep liget park köz tér sor dűlő lejtő domb kert udvar árok".split())
SHORT_STREETS = frozenset(("krt", "ltp", "u"))
LEVELS, GROUND, DOOR = frozenset(("emelet", "em")), frozenset(("fszt", "mfszt", "földszint", "magasföldszint")), "ajtó"
AREAS = ("belterület", "külterület", "zártkert")

_POSTCODE = re.compile(f"(?<![{LETTERS}0-9])[1-9][0-9]{{3}}(?![0-9])")
_PLOT_LABEL = re.compile(f"(?<![{LETTERS}])(?:hrsz(?![{LETTERS}0-9])|helyrajzi[ \t]+szám[{LOWER}]*)")
_NUMBER_BEFORE = re.compile(f"(?<![{LETTERS}0-9/])[0-9]{{1,5}}(?:/[0-9]{{1,3}})?(?:/[{UPPER}])?$")
_TOWN_BEFORE = re.compile(f"(?<![{LETTERS}0-9])[{UPPER}][{LOWER}]+(?:-[{UPPER}][{LOWER}]+)?$")
_NAME, _CAPITAL = re.compile(f"[{UPPER}][{LOWER}]+"), re.compile(f"[{UPPER}]")
_RUNS = {"word": re.compile(f"[{LETTERS}]+"), "number": re.compile("[0-9]+"), "blank": re.compile("[ \t]+"), "space": re.compile("[ \xa0]+"), "mixed": re.compile(f"[{UPPER}0-9]+")}


def capitalised(word: str) -> bool:
    return _NAME.fullmatch(word) is not None


def roman(word: str, letters: str = "IVXLC") -> bool:
    return bool(word) and all(c in letters for c in word)


class Reader:
    """A place in a text; what is asked for is stepped over if it is there, and empty if it is not."""

    def __init__(self, text: str, at: int):
        self.text, self.at = text, at

    def run(self, what: str, most: int | None = None) -> str:
        """A whole run of one sort, of so many characters at most."""
        found = _RUNS[what].match(self.text, self.at)
        if found is None or (most and len(found[0]) > most):
            return ""
        self.at = found.end()
        return found[0]

    def mark(self, c: str) -> bool:
        there = self.text.startswith(c, self.at)
        self.at += there
        return there

    def tried(self, *parts) -> bool:
        """All of the parts in turn, or none."""
        start = self.at
        if all(part() for part in parts):
            return True
        self.at = start
        return False

    # Parts of an address.

    def name(self) -> bool:
        start, word = self.at, self.run("word")
        if capitalised(word):
            return True
        self.at = start
        return False

    def town(self) -> bool:
        if not self.name():
            return False
        self.tried(lambda: self.mark("-"), self.name)
        return True

    def postal(self) -> bool:
        """Postcode and town."""
        return self.tried(lambda: self.run("number", 4), lambda: self.run("space"), self.town)

    def kind_of_street(self) -> bool:
        word = self.run("word")
        return word in STREETS or (word in SHORT_STREETS and self.mark("."))

    def street(self) -> bool:
        """One to three names and what kind of street it is."""
        names = 0
        while names < 3 and self.tried(self.name, lambda: self.run("blank")):
            names += 1
        return names > 0 and self.kind_of_street()

    def house(self) -> bool:
        if not self.run("number", 4):
            return False
        self.tried(lambda: self.mark("/"), lambda: self.run("mixed", 3))
        self.mark(".")
        return True

    def comma(self) -> bool:
        self.run("blank")
        found = self.mark(",")
        self.run("blank")
        return found

    def door_number(self, letters: bool = False) -> bool:
        if not self.run("number", 3):
            if not letters or not _CAPITAL.match(self.text, self.at):
                return False
            self.at += 1
        self.mark(".")
        self.tried(lambda: (self.run("blank"), True)[1], lambda: self.run("word") == DOOR)
        return True

    def storey(self) -> str:
        """A level's number, in Roman or in at most two plain digits."""
        start, word = self.at, self.run("word")
        if roman(word):
            return word
        self.at = start
        return self.run("number", 2)

    def named_level(self) -> bool:
        self.run("blank")
        if self.tried(lambda: self.run("word") in GROUND):
            return True
        if not (self.storey() and self.mark(".")):
            return False
        self.run("blank")
        return self.run("word") in LEVELS

    def level(self) -> bool:
        """A named level with or without a door, a level and a door with a stroke between, or a Roman level and a door."""

        def short() -> str:
            self.run("blank")
            found = self.storey()
            return found if len(found) <= 4 and (found.isdigit() or roman(found, "IVX")) else ""

        if self.tried(self.named_level):
            self.mark(".")
            self.tried(lambda: (self.run("blank"), True)[1], self.door_number)
            return True
        if self.tried(short, lambda: self.mark("/"), lambda: self.door_number(letters=True)):
            return True
        return self.tried(lambda: not short().isdigit(), lambda: self.mark("."), lambda: (self.run("blank"), True)[1], self.door_number)

    def address(self) -> bool:
        if not self.tried(self.postal, self.comma, self.street, lambda: self.run("blank"), self.house):
            return False
        self.level()
        return True


def _alone(text: str, end: int) -> bool:
    return not (_RUNS["word"].match(text, end) or _RUNS["number"].match(text, end))


def addresses(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of postcodes with their towns and, where a street and a house follow, of whole addresses."""
    for m in _POSTCODE.finditer(text):
        reader = Reader(text, m.start())
        if reader.postal() and not _RUNS["word"].match(text, reader.at):
            yield m.start(), reader.at, "iranyitoszam"
        reader = Reader(text, m.start())
        if reader.address():
            yield m.start(), reader.at, "cim"


def _before(text: str, end: int) -> int | None:
    """Where a plot's number begins that ends here, with the town and the area named before it."""
    stop = len(text[:end].rstrip(" \t"))
    for last in (stop - 1, stop) if text[stop - 1 : stop] == "." else (stop,):
        found = _NUMBER_BEFORE.search(text[:last], max(0, last - 16))
        if found:
            break
    else:
        return None
    start = found.start()
    bare = text[:start].rstrip(" \t")
    if len(bare) == start and not bare.endswith(","):
        return start
    head = bare.removesuffix(",").rstrip(" \t")
    word = re.search(f"[{LOWER}]+$", head[-40:])
    if head == bare and word and word[0].startswith(AREAS):
        head = head[: -len(word[0])].rstrip(" \t")
    town = _TOWN_BEFORE.search(head, max(0, len(head) - 60))
    return town.start() if town and len(bare) < start else start


def plots(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of plot numbers with their label behind or before."""
    done = 0
    for m in _PLOT_LABEL.finditer(text):
        end = m.end() + (text.startswith(".", m.end()) and _alone(text, m.end() + 1) and m[0] == "hrsz")
        start = _before(text, m.start())
        if start is not None and start >= done and _alone(text, end):
            yield start, end
            done = end
            continue
        reader = Reader(text, m.end())
        reader.mark(".")
        reader.run("blank")
        reader.mark(":")
        reader.run("blank")
        if m.start() and text[m.start() - 1].isdigit() or not reader.run("number", 5):
            continue
        reader.tried(lambda: reader.mark("/"), lambda: reader.run("number", 3))
        reader.tried(lambda: reader.mark("/"), lambda: len(reader.run("mixed", 1)) == 1)
        if _alone(text, reader.at):
            yield m.start(), reader.at
            done = reader.at
