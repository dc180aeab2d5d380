"""Units written as text: which unit they name and which marks of h and a they bear."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

#: Spellings of the named units (fixed values), in lower case; values come from the unit table.
SPELLINGS = {
    "m": "m", "metre": "m", "meter": "m", "metres": "m", "meters": "m",
    "cm": "cm", "centimetre": "cm", "centimeter": "cm", "centimetres": "cm", "centimeters": "cm",
    "km": "km", "kilometre": "km", "kilometer": "km", "kilometres": "km", "kilometers": "km",
    "pc": "pc", "parsec": "pc", "parsecs": "pc",
    "kpc": "kpc", "kiloparsec": "kpc", "kiloparsecs": "kpc",
    "mpc": "Mpc", "megaparsec": "Mpc", "megaparsecs": "Mpc",
    "g": "g", "gram": "g", "grams": "g", "gramme": "g",
    "kg": "kg", "kilogram": "kg", "kilograms": "kg",
    "msun": "Msun", "m_sun": "Msun", "msol": "Msun", "m_sol": "Msun", "solarmass": "Msun", "solar_mass": "Msun",
    "s": "s", "sec": "s", "second": "s", "seconds": "s",
    "yr": "yr", "year": "yr", "years": "yr",
    "gyr": "Gyr", "gigayear": "Gyr", "gigayears": "Gyr",
}
LENGTHS = {"m", "cm", "km", "pc", "kpc", "Mpc"}
_GLUED = {"kms": ("km", "s"), "cms": ("cm", "s"), "ms": ("m", "s"), "kpcgyr": ("kpc", "gyr")}
_TOKEN = re.compile(r"(?P<slash>/)|(?P<pow10>10\^[+-]?\d+)|(?P<word>[a-z_☉⊙]+)\s*(?P<exp>\^?[+-]?\d+(?:\.\d+)?(?:/\d+)?)?|(?P<num>[+-]?\d+(?:\.\d+)?(?:e[+-]?\d+)?)|(?P<other>\S)")
_NUMBER = re.compile(r"^\s*([+-]?(?:\d[\d.,]*|[.,]\d+)(?:[eE][+-]?\d+)?)(.*)$", re.S)


class Unit(NamedTuple):
    base: float | None  # SI value, or None where no unit is named
    h: float
    a: float
    marked: bool


def _exponent(text: str | None) -> float:
    if not text:
        return 1.0
    top, _, bottom = text.lstrip("^").partition("/")
    return float(top) / (float(bottom) if bottom else 1.0)


def parse_unit(text: str | None, si: dict[str, float]) -> Unit:
    """The unit a text names. Any unknown word (code, internal, dimensionless ...) names none; marks count anyway."""
    if text is None:
        return Unit(None, 0.0, 0.0, False)
    return _parse(text, tuple(sorted(si.items())))


@lru_cache(maxsize=20_000)
def _parse(text: str, si_items: tuple) -> Unit:
    si = dict(si_items)
    t = re.sub(r"[\[\]{}]", "", text.strip().lower())
    t = re.sub(r"sqrt\s*\(\s*a\s*\)", " a^0.5 ", t)
    t = re.sub(r"solar[\s_]+mass(es)?", "msun", t)
    t = re.sub(r"[*·×()]", " ", t).replace("m☉", "msun").replace("m⊙", "msun").replace("**", "^")
    base, h, a, named, unknown, sign = 1.0, 0.0, 0.0, False, False, 1.0
    for m in _TOKEN.finditer(t):
        if m["slash"]:
            sign = -1.0
            continue
        if m["pow10"]:
            base *= 10.0 ** (sign * float(m["pow10"][3:]))
        elif m["num"]:
            base *= float(m["num"]) ** sign
        elif m["word"]:
            word, power = m["word"], sign * _exponent(m["exp"])
            if word == "h":
                h += power
            elif word == "a":
                a += power
            elif word in ("comoving", "cmv"):
                a += 1.0
            elif word in ("physical", "proper"):
                pass
            elif word in _GLUED and m["exp"]:
                first, second = _GLUED[word]
                base *= si[SPELLINGS[first]] * si[SPELLINGS[second]] ** power
                named = True
            elif word in SPELLINGS and SPELLINGS[word] in si:
                base *= si[SPELLINGS[word]] ** power
                named = True
            elif word[0] == "c" and SPELLINGS.get(word[1:]) in LENGTHS and SPELLINGS[word[1:]] in si:
                base *= si[SPELLINGS[word[1:]]] ** power
                a += power
                named = True
            else:
                unknown = True
        else:
            unknown = unknown or m["other"] not in ".,;"
        sign = 1.0
    return Unit(base if named and not unknown else None, h, a, h != 0 or a != 0)


@lru_cache(maxsize=20_000)
def split_number(text: str | None) -> tuple[float | None, str]:
    """Number and rest of a text. A comma is the decimal mark unless a point follows it (then it groups digits)."""
    m = _NUMBER.match(text or "")
    if not m:
        return None, (text or "").strip()
    digits = m[1]
    if "," in digits:
        digits = digits.replace(",", "") if digits.rfind(".") > digits.rfind(",") or digits.count(",") > 1 and "." not in digits else digits.replace(".", "").replace(",", ".")
    try:
        return float(digits), m[2].strip()
    except ValueError:
        return None, m[2].strip()
