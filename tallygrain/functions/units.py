"""An algebra of units: what a written unit measures, and how much of it.

A unit is a vector of exponents over base dimensions and a factor. Prefixes scale it, powers, products and quotients combine it:
"kWh", "milliampere-hours", "cm³", "cubic centimetres" and "MB/s" are worked out, none of them is listed. A word is read as a
symbol as it is written, or as a name in any case, with a plural and either spelling of litre and metre.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

#: Base dimensions, in the order of the exponents. Apparent power is told from power, as its unit is never written watt.
DIMENSIONS = ("length", "mass", "time", "current", "information", "apparent")


@dataclass(frozen=True)
class Unit:
    dims: tuple[int, ...]
    factor: float

    def __mul__(self, other: Unit) -> Unit:
        return Unit(tuple(a + b for a, b in zip(self.dims, other.dims)), self.factor * other.factor)

    def __pow__(self, n: int) -> Unit:
        return Unit(tuple(a * n for a in self.dims), self.factor**n)

    def __truediv__(self, other: Unit) -> Unit:
        return self * other**-1

    def same(self, other: Unit) -> bool:
        """Of equal dimensions and size, but for the digits that written factors leave out."""
        return self.dims == other.dims and abs(self.factor - other.factor) <= 1e-5 * other.factor


def base(dimension: str) -> Unit:
    return Unit(tuple(int(d == dimension) for d in DIMENSIONS), 1.0)


METRE, KILOGRAM, SECOND, AMPERE, BYTE = (base(d) for d in DIMENSIONS[:5])
GRAM, HOUR = KILOGRAM * Unit((0,) * 6, 1e-3), SECOND * Unit((0,) * 6, 3600.0)
NEWTON = KILOGRAM * METRE / SECOND**2
JOULE = NEWTON * METRE
WATT = JOULE / SECOND
VOLT = WATT / AMPERE


def times(x: float, unit: Unit) -> Unit:
    return Unit(unit.dims, unit.factor * x)


# Prefixes by symbol and by name.
PREFIXES = {"k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "d": 1e-1, "c": 1e-2, "m": 1e-3, "µ": 1e-6, "μ": 1e-6, "u": 1e-6, "n": 1e-9}
PREFIX_NAMES = {"kilo": 1e3, "mega": 1e6, "giga": 1e9, "tera": 1e12, "deci": 1e-1, "centi": 1e-2, "milli": 1e-3, "micro": 1e-6, "nano": 1e-9}
# Units that take prefixes: symbol, names, what they are.
SCALED = [
    ("m", ("metre", "meter"), METRE), ("g", ("gram",), GRAM), ("l", ("litre", "liter"), times(1e-3, METRE**3)), ("L", (), times(1e-3, METRE**3)),
    ("s", ("second",), SECOND), ("A", ("ampere", "amp"), AMPERE), ("V", ("volt",), VOLT), ("W", ("watt",), WATT), ("N", ("newton",), NEWTON),
    ("J", ("joule",), JOULE), ("B", ("byte",), BYTE), ("bit", ("bit",), times(1 / 8, BYTE)), ("Hz", ("hertz",), SECOND**-1), ("VA", (), base("apparent")),
    ("Pa", ("pascal",), NEWTON / METRE**2),
]
# Units that take none, by every way to write them.
PLAIN = {
    ("h", "hr", "hrs", "hour"): HOUR, ("min", "minute"): times(60, SECOND), ("sec",): SECOND, ("oz", "ounce"): times(28.3495, GRAM),
    ("lb", "lbs", "pound"): times(453.592, GRAM), ("ft", "foot", "feet"): times(0.3048, METRE), ("inch", "inches"): times(0.0254, METRE),
    ("pint", "pt"): times(568.261e-6, METRE**3), ("gallon", "gal"): times(4.54609e-3, METRE**3), ("cc",): times(1e-6, METRE**3),
    ("bps",): times(1 / 8, BYTE / SECOND), ("rpm",): times(1 / 60, SECOND**-1),
}
#: Names of two words.
PAIRS = {("fluid", "ounce"): times(29.5735e-6, METRE**3), ("fl", "oz"): times(29.5735e-6, METRE**3), ("pound", "mass"): times(453.592, GRAM)}
#: Words that raise the unit after them.
RAISING = {"square": 2, "sq": 2, "cubic": 3, "cu": 3}
#: What may stand first and last in a symbol of two units without a sign between them.
FIRST, LAST = "WAVN", {"h": HOUR, "s": SECOND, "m": METRE}

SYMBOLS = {s: u for s, _, u in SCALED}
NAMES = {n: u for _, names, u in SCALED for n in names}
WHOLE = {w: u for words, u in PLAIN.items() for w in words}


@lru_cache(maxsize=1 << 16)
def symbol(text: str) -> Unit | None:
    """A symbol as it is written, with or without a prefix, or two of them in a row ("kWh")."""
    if text in WHOLE:
        return WHOLE[text]
    for prefix, scale in (("", 1.0), *PREFIXES.items()):
        rest = text[len(prefix) :]
        if text.startswith(prefix) and rest:
            if rest in SYMBOLS:
                return times(scale, SYMBOLS[rest])
            if rest[:-1] in SYMBOLS and rest[:-1] in FIRST and rest[-1] in LAST:
                return times(scale, SYMBOLS[rest[:-1]] * LAST[rest[-1]])
            if prefix in ("k", "M", "G") and rest == "bps":
                return times(scale, WHOLE["bps"])
    return None


@lru_cache(maxsize=1 << 16)
def name(text: str) -> Unit | None:
    """A name in any case, one or many, with or without a prefix."""
    low = text.lower()
    for word in (low, low.removesuffix("s")):
        if len(word) > 2 and word in WHOLE:
            return WHOLE[word]
        for prefix, scale in (("", 1.0), *PREFIX_NAMES.items()):
            if word.startswith(prefix) and word[len(prefix) :] in NAMES:
                return times(scale, NAMES[word[len(prefix) :]])
    return None


def pair(first: str, second: str) -> Unit | None:
    second = second.lower()
    return PAIRS.get((first.lower(), second)) or PAIRS.get((first.lower(), second.removesuffix("s")))
