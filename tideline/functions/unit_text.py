"""Units in text: a multi-pattern automaton over unit aliases, longest match first, next to a given number.

A unit is written as family:scale:currency, for example money:million:USD, share:unit:GBP, share:hundredth:EUR,
percent:unit:, percent:hundredth: (basis points), percent:ratio: (fractions of one) or, of a physical quantity,
mass:tonne:. An alias may mean several things (m is a million or a metre); the metric's family decides.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Aliases by what they say.
CURRENCIES = {"$": "USD", "usd": "USD", "us$": "USD", "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP", "¥": "JPY", "jpy": "JPY", "chf": "CHF", "cad": "CAD", "aud": "AUD", "cny": "CNY", "rmb": "CNY", "inr": "INR", "₹": "INR", "sek": "SEK", "nok": "NOK", "dkk": "DKK"}
SCALES = {
    "trillion": ("tn", "trillion", "trillions"),
    "billion": ("bn", "billion", "billions", "b"),
    "million": ("m", "mn", "mio", "million", "millions"),
    "thousand": ("k", "thousand", "thousands", "'000", "’000", "000"),
    "unit": ("(units)", "single", "units"),
}
PERCENT = {
    "unit": ("%", "percent", "per cent", "pct", "pp", "ppt", "percentage point", "percentage points", "% points"),
    "hundredth": ("bps", "bp", "basis point", "basis points"),
    "ratio": ("fraction", "as a fraction of one", "fraction of one", "expressed as a ratio", "as a ratio", "ratio", "decimal", "as a decimal", "x of 1", "of one"),
}
SHARE = ("per share", "a share", "/ share", "/share", "each share")
HUNDREDTHS = {"cents": "", "cent": "", "c": "", "¢": "", "pence": "GBP", "penny": "GBP", "p": "GBP"}

#: What conversion gives for a value of 1: the factor to the family's plain unit (percent points, currency units).
FACTORS = {
    "percent:unit": 1.0, "percent:hundredth": 0.01, "percent:ratio": 100.0,
    "money:trillion": 1e12, "money:unit": 1.0, "money:thousand": 1e3, "money:million": 1e6, "money:billion": 1e9,
    "share:unit": 1.0, "share:hundredth": 0.01,
}

#: Physical quantities: unit, its factor to the dimension's plain unit, its aliases.
QUANTITIES = {
    "mass": (("kilogram", 1.0, ("kg", "kgs", "kilogram", "kilograms")), ("gram", 1e-3, ("g", "gram", "grams")), ("tonne", 1e3, ("t", "tonne", "tonnes", "metric ton", "metric tons")), ("pound", 0.45359237, ("lb", "lbs", "pound", "pounds"))),
    "length": (("metre", 1.0, ("m", "metre", "metres", "meter", "meters")), ("kilometre", 1e3, ("km", "kilometre", "kilometres", "kilometer", "kilometers")), ("foot", 0.3048, ("ft", "foot", "feet")), ("mile", 1609.344, ("mi", "mile", "miles"))),
    "volume": (("litre", 1.0, ("l", "litre", "litres", "liter", "liters")), ("cubic metre", 1e3, ("m3", "m³", "cubic metre", "cubic metres")), ("barrel", 158.987294928, ("bbl", "bbls", "barrel", "barrels"))),
    "energy": (("kilowatt-hour", 1.0, ("kwh", "kilowatt-hour", "kilowatt-hours")), ("megawatt-hour", 1e3, ("mwh", "megawatt-hour", "megawatt-hours")), ("gigawatt-hour", 1e6, ("gwh", "gigawatt-hour", "gigawatt-hours")), ("gigajoule", 277.777777778, ("gj", "gigajoule", "gigajoules"))),
}
FACTORS |= {f"{dimension}:{unit}": factor for dimension, units in QUANTITIES.items() for unit, factor, _ in units}

NUMBER = re.compile(r"\d[\d,]*(?:\.\d+)?|\.\d+")
_SPACES = re.compile(r"[\s\u00a0]+")


@lru_cache(1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    say: dict[str, tuple[str, str]] = {}
    for alias, code in CURRENCIES.items():
        say[alias] = ("currency", code)
    for scale, aliases in SCALES.items():
        say |= {x: ("scale", scale) for x in aliases}
    for scale, aliases in PERCENT.items():
        say |= {x: ("percent", scale) for x in aliases}
    say |= {x: ("share", "") for x in SHARE}
    say |= {x: ("hundredth", code) for x, code in HUNDREDTHS.items()}
    # a currency code and a scale may be written as one word
    for alias, code in CURRENCIES.items():
        for scale, aliases in SCALES.items():
            say |= {alias + x: ("both", f"{scale}:{code}") for x in aliases if alias.isalpha() and x.isalpha() and len(x) <= 2}
    meanings = {alias: [meaning] for alias, meaning in say.items()}
    for dimension, units in QUANTITIES.items():
        for unit, _, names in units:
            for x in names:
                meanings.setdefault(x, []).append(("quantity", f"{dimension}:{unit}"))
    for alias, several in meanings.items():
        a.add_word(alias, (alias, several))
    a.make_automaton()
    return a


def clean(text: str) -> str:
    return _SPACES.sub(" ", text.replace("−", "-").replace("–", "-")).strip().lower()


def aliases(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, what) of the aliases in cleaned text: whole words, the longest at each place, none inside another."""
    found = []
    for last, (alias, several) in automaton().iter(text):
        start, end = last - len(alias) + 1, last + 1
        if alias[0].isalpha() and start and text[start - 1].isalpha():
            continue
        if alias[0].isdigit() and start and (text[start - 1].isdigit() or text[start - 1] in ".,"):
            continue
        if alias[-1].isalnum() and end < len(text) and text[end].isalnum():
            continue
        found += [(start, -end, i, *m) for i, m in enumerate(several)]
    out, reached, place = [], 0, None
    for start, end, _, kind, what in sorted(found):
        if start >= reached or (start, end) == place:
            out.append((start, -end, kind, what))
            reached, place = -end, (start, end)
    return out


def compose(found: list[tuple[str, str]], family: str) -> str | None:
    """The unit that a set of aliases states for a metric of the given family, or None if they don't state one."""
    if family in QUANTITIES:
        return next((f"{what}:" for kind, what in found if kind == "quantity" and what.split(":")[0] == family), None)
    currency = scale = pct = None
    share = hundredth = False
    for kind, what in found:
        if kind == "currency":
            currency = currency or what
        elif kind == "both":
            scale, currency = scale or what.split(":")[0], currency or what.split(":")[1]
        elif kind == "scale":
            scale = scale or what
        elif kind == "percent":
            pct = pct or what
        elif kind == "share":
            share = True
        elif kind == "hundredth":
            hundredth, currency = True, currency or what or None
    if family == "percent":
        return f"percent:{pct}:" if pct else None
    if pct:
        return None
    if family == "share":
        if hundredth:
            return f"share:hundredth:{currency or ''}"
        return f"share:unit:{currency or ''}" if share or currency else None
    if scale or currency:
        return f"money:{scale or 'unit'}:{currency or ''}"
    return None


def of_units(units: str | None, family: str) -> str | None:
    """The unit a units field states. GBp, so written, is pence."""
    if units is None or not units.strip():
        return None
    if units.strip() == "GBp" or (family == "share" and units.strip() in ("GBX", "gbx", "GBp / share")):
        return "share:hundredth:GBP" if family == "share" else None
    return compose([(k, w) for _, _, k, w in aliases(clean(units))], family)


def _chain(text: str, start: int, end: int, found: list) -> list[tuple[str, str]]:
    """The aliases that stand directly before and after the number text[start:end], nothing but blanks and signs between."""
    out = []
    after = end
    for s, e, kind, what in found:
        if s >= after or e == after:
            if text[after:s].strip(" )-/"):
                break
            out.append((kind, what))
            after = e
    before = start
    for s, e, kind, what in reversed(found):
        if e <= before:
            if text[e:before].strip(" (-+") not in ("", "minus"):
                break
            if kind not in ("currency", "both"):
                break
            out.append((kind, what))
            before = s
    return out


def near_number(text: str | None, value: float, family: str) -> str | None:
    """The unit next to the number in text that equals value up to its sign; of several, the first with a unit."""
    if text is None or value is None:
        return None
    t = clean(text)
    found = None
    for m in NUMBER.finditer(t):
        try:
            number = float(m[0].rstrip(",").replace(",", ""))
        except ValueError:
            continue
        if abs(number - abs(value)) > 1e-9 * max(1.0, abs(value)):
            continue
        if found is None:
            found = aliases(t)
        if unit := compose(_chain(t, m.start(), m.end(), found), family):
            return unit
    return None


_DECLARED = re.compile(r"\(in ([^)]*)\)|(?:amounts|figures|values|numbers)(?: are)?(?: stated| given| shown)? in ([^.|;]*)|\(([^()|]*)\)|^([^.|;]{0,40}) (?:unless|except)")


def declared(text: str | None, family: str) -> str | None:
    """The unit a context declares for its table or list, such as `(in thousands of USD)` or `All amounts in USD millions.`"""
    if text is None:
        return None
    t = clean(text)
    for m in _DECLARED.finditer(t):
        part = next(g for g in m.groups() if g is not None)
        if NUMBER.search(part.replace("'000", "").replace("’000", "")):
            continue
        if unit := compose([(k, w) for _, _, k, w in aliases(part)], family):
            return unit
    return None
