"""Units and scales as they stand in texts: a lexicon, unit entries, and the numbers of a sentence with what is written around them."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

#: Number words.
NUMBER_WORDS = {
    w: i
    for i, w in enumerate(
        "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
    )
} | {"thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100}
_MONTHS = "january february march april may june july august september october november december".split()
_MARKS = re.compile(r"[\s_\-\xa0]+|[\[\]()\"“”*]")
_END_MARKS = re.compile(r"[.,;:!?]+(?=\s|$)")
MISSING, FOREIGN = -2, -1


@dataclass
class Number:
    """A number in a sentence: its value, the scale beside it (1 if none) and the unit beside it (FOREIGN if none)."""

    value: float
    scale: float
    unit: int
    dated: bool


@dataclass
class Lexicon:
    """Units by number, their forms and factors, and the scale words; built from rows like those of ``unit_ref``."""

    names: list[str] = field(default_factory=list)
    base: list[str] = field(default_factory=list)
    factor: list[float] = field(default_factory=list)
    shift: list[float] = field(default_factory=list)
    forms: dict[str, int] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)
    currency: set[int] = field(default_factory=set)

    @staticmethod
    def of(rows: Iterable) -> Lexicon:
        lex = Lexicon()
        for r in sorted(rows, key=lambda r: r["unit"]):
            forms = [f.lower() for f in [r["unit"], *(r["forms"] or [])] if f]
            if r["unit_type"] == "scale":
                lex.scales |= {f: float(r["factor"]) for f in forms}
                continue
            k = len(lex.names)
            lex.names.append(r["unit"])
            lex.base.append(r["base_unit"])
            lex.factor.append(float(r["factor"]))
            lex.shift.append(float(r["shift"] or 0.0))
            for f in forms:
                lex.forms.setdefault(f, k)
            if (r["unit_type"] or "").startswith("currency"):
                lex.currency.add(k)
        lex._prepare()
        return lex

    def _prepare(self) -> None:
        alternatives = lambda ws: "|".join(re.escape(w).replace(r"\ ", " ") for w in sorted(ws, key=lambda w: (-len(w), w)))
        unit, scale = alternatives(self.forms), alternatives(self.scales)
        signs = [f for f, k in self.forms.items() if k in self.currency]
        words = "|".join(sorted(NUMBER_WORDS, key=lambda w: -len(w)))
        self.numbers = re.compile(
            rf"(?:(?P<sign>(?<![a-z]){alternatives(signs)}) ?)?"
            r"(?:(?<![\w.,'])(?<![a-z]-)|(?<=[$€£₹¥]))"
            rf"(?P<n>\d{{1,3}}(?:[, ]\d{{3}})+(?:\.\d+)?(?!\d)|\d+(?:\.\d+)?|(?:{words})(?=[^a-z]|(?:{unit})(?![a-z])))"
            rf"(?:[ -]?(?P<scale>{scale})(?![a-z0-9]))?"
            rf"(?: ?-?(?:of )?(?P<unit>{unit})(?![a-z]))?"
        )
        self.heading = re.compile(
            rf"(?:(?<![a-z])(?:in|figures|amounts|values)(?: in)?|\() ?(?:(?P<s1>{scale})(?: of)? (?P<u1>{unit})|(?P<u2>{unit}),? \(?(?P<s2>{scale})\)?) ?(?:[:)–-]|$)"
        )
        self.dates = re.compile(rf" (?:{'|'.join(_MONTHS)})(?![a-z])")
        self.near: dict[str, set[int]] = {}
        for f, k in self.forms.items():
            for d in _deletes(f.replace(" ", "")):
                self.near.setdefault(d, set()).add(k)
        self.solid = {f.replace(" ", ""): k for f, k in self.forms.items()}
        self._seen: dict[str, tuple[int, float]] = {}

    def entry(self, text: str | None) -> tuple[int, float]:
        """(unit, scale) that a unit entry means: MISSING for null, empty or ``-``, FOREIGN for what is no unit; scale 1 if it has none.
        Case, brackets, marks, a leading ``in`` and one wrong, missing, added or exchanged letter are allowed."""
        if text is None:
            return MISSING, 1.0
        if (known := self._seen.get(text)) is None:
            if len(self._seen) > 200_000:
                self._seen.clear()
            known = self._seen[text] = self._entry(text)
        return known

    def _entry(self, text: str) -> tuple[int, float]:
        if text.strip() in ("", "-"):
            return MISSING, 1.0
        s = _END_MARKS.sub(" ", _MARKS.sub(" ", text.lower())).strip()
        w = s.split()
        if len(w) > 1 and w[0] == "in":
            w = w[1:]
        scale = 1.0
        kept = [x for x in w if x not in self.scales]
        if len(kept) < len(w):
            scale = next(self.scales[x] for x in w if x in self.scales)
            kept = [x for x in kept if x != "of"]
        s = " ".join(kept)
        if s in self.forms:
            return self.forms[s], scale
        s = s.replace(" ", "")
        if s in self.solid:
            return self.solid[s], scale
        found = set().union(*(self.near.get(d, set()) for d in _deletes(s)))
        if len(found) > 1:
            found = {k for f, k in self.forms.items() if k in found and _one_slip(s, f.replace(" ", ""))}
        return (min(found), scale) if found else (FOREIGN, 1.0)

    def read(self, sentence: str | None) -> tuple[list[Number], tuple[int, float] | None]:
        """(numbers of a lower-cased sentence in order, unit and scale given for the whole sentence)."""
        if not sentence:
            return [], None
        s = " ".join(sentence.split())
        head = self.heading.search(s)
        whole = (self.forms[head["u1"] or head["u2"]], self.scales[head["s1"] or head["s2"]]) if head else None
        found = []
        for m in self.numbers.finditer(s):
            n = m["n"]
            value = float(NUMBER_WORDS[n]) if n in NUMBER_WORDS else float(n.replace(",", "").replace(" ", ""))
            unit = self.forms[m["unit"]] if m["unit"] else self.forms[m["sign"]] if m["sign"] else FOREIGN
            if m["sign"] and m["unit"] and self.forms[m["unit"]] not in self.currency:
                unit = self.forms[m["sign"]]
            found.append(Number(value, self.scales[m["scale"]] if m["scale"] else 1.0, unit, bool(self.dates.match(s, m.end()))))
            if " " in n:  # a blank may also stand between two numbers
                for part in n.split(" "):
                    found.append(Number(float(part.replace(",", "")), found[-1].scale if part == n.split(" ")[-1] else 1.0, unit if part == n.split(" ")[-1] else FOREIGN, False))
        return found, whole


def _deletes(s: str) -> set[str]:
    """A form of at least four letters without each of its letters, and itself."""
    return {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))} if len(s) >= 4 else {s}


def _one_slip(a: str, b: str) -> bool:
    """Whether one letter changed, added, left out or exchanged with the next makes b of a."""
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) <= 1 or len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@dataclass
class Stated:
    """What a sentence says of one quantity: the unit with the number (FOREIGN if none), the factor that the recorded value
    lacks, and whether the number was found."""

    unit: int
    missing_scale: float
    found: bool


def align(read: tuple[list[Number], tuple[int, float] | None], values: list, entries: list[tuple[int, float]]) -> list[Stated]:
    """Find every value among the numbers of the sentence (``read``, from ``Lexicon.read``), in order, and read off its unit and size.

    The number is the value itself, or the value without the scale that stands with the number or for the sentence. Among
    numbers that fit, one with the unit of the entry is taken first, then one with any unit (for an entry that is no unit: one
    with none), then the next in order; the number of a date comes last.
    """
    numbers, whole = read
    out, at = [], 0
    used: set[int] = set()
    for v, (unit, entry_scale) in zip(values, entries):
        best = None
        for i, n in enumerate(numbers):
            if v is None or i in used:
                continue
            scale = n.scale if n.scale != 1.0 else whole[1] if whole and n.unit in (FOREIGN, whole[0]) else 1.0
            fits = _same(n.value, v), scale != 1.0 and _same(n.value * scale, v)
            if not any(fits):
                continue
            stated = n.unit if n.unit != FOREIGN else whole[0] if whole else FOREIGN
            order = (n.dated, not (stated == unit and unit >= 0), (stated == FOREIGN) != (unit == FOREIGN), i < at, i)
            if best is None or order < best[0]:
                best = (order, i, stated, 1.0 if fits[1] else scale)
        if best is None:
            out.append(Stated(FOREIGN, entry_scale, False))
            continue
        _, i, stated, lacks = best
        used.add(i)
        at = i
        n = numbers[i]
        has_scale = n.scale != 1.0 or (whole is not None and n.unit in (FOREIGN, whole[0]))
        out.append(Stated(stated, lacks if has_scale else entry_scale, True))
    return out


def _same(a: float, b: float) -> bool:
    return abs(a - b) <= 1e-9 * max(abs(a), abs(b))
