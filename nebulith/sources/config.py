"""Run configuration: sections and ``key = value`` lines, frozen into typed values with a canonical text and a hash."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from nebulith.runtime import ship


class ConfigError(ValueError):
    pass


class Assignment(Enum):
    NGP, CIC, TSC = "ngp", "cic", "tsc"


class Boundary(Enum):
    PERIODIC, OPEN, REFLECTIVE = "periodic", "open", "reflective"


class FillStatus(Enum):
    FILLED, STALE, UNFILLED = "filled", "stale", "unfilled_physical_boundary"


def enum_column(kind: type[Enum], text: Column) -> Column:
    """``parse_enum`` of a column: the canonical text; null stays null and an unknown one is an error at run time."""
    clean = F.lower(F.trim(text))
    return F.when(clean.isin([m.value for m in kind]) | text.isNull(), clean).otherwise(F.raise_error(F.concat(text, F.lit(f" is none of {', '.join(m.value for m in kind)}"))).cast("string"))


def parse_enum(kind: type[Enum], text: str) -> Enum:
    """An enum by its text, whatever the case; an unknown one is an error that names the choices."""
    for member in kind:
        if member.value == text.strip().lower():
            return member
    raise ConfigError(f"{text!r} is none of {', '.join(m.value for m in kind)}")


def strip_comment(line: str) -> str:
    """Without a comment begun by # or ; outside quotes."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "#;":
            return line[:i]
    return line


def parse(text: str) -> dict[str, str]:
    """section.key -> value. ``key value`` without an equals sign is allowed if there is a value; a key given twice is an error."""
    out: dict[str, str] = {}
    section = ""
    for n, raw in enumerate(text.splitlines(), 1):
        line = strip_comment(raw).strip()
        if not line:
            continue
        if line.startswith("[") and line.endswith("]"):
            section = line[1:-1].strip().lower()
            if not section:
                raise ConfigError(f"line {n}: section without a name")
            continue
        key, eq, value = line.partition("=")
        if not eq:
            key, _, value = line.partition(" ")
        key, value = key.strip().lower(), value.strip()
        if not key or not (value or eq):
            raise ConfigError(f"line {n}: a key and a value are needed")
        name = f"{section}.{key}" if section and "." not in key else key
        if name in out:
            raise ConfigError(f"line {n}: {name} was given before")
        out[name] = value
    return out


def magnitude_and_unit(text: str) -> tuple[float, str]:
    """``3.5 kpc`` -> (3.5, "kpc"); without a unit the second part is empty."""
    number, _, unit = text.strip().partition(" ")
    return float(number), unit.strip()


def fnv1a(text: str) -> int:
    """64-bit FNV-1a (published constants)."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h


def fnv1a_column(text: Column) -> Column:
    """``fnv1a`` of a column as decimal text, in Arrow batches: the engine has no unsigned 64-bit product."""
    ship()
    return F.pandas_udf(_fnv1a_batch, "string")(text)


def _fnv1a_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else str(fnv1a(t)))


def escape_column(text: Column) -> Column:
    for plain, coded in (("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape_column(text: Column) -> Column:
    """The inverse of ``escape_column`` for texts it made: doubled backslashes are set aside while the marks are turned back."""
    aside = "\ue000"
    out = F.replace(text, F.lit("\\\\"), F.lit(aside))
    for plain, coded in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ("\\", aside)):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r")


def unescape(text: str) -> str:
    """The inverse; an unknown or unfinished escape is an error."""
    out, i = [], 0
    while i < len(text):
        if text[i] != "\\":
            out.append(text[i])
            i += 1
            continue
        if i + 1 == len(text) or text[i + 1] not in "\\ntr":
            raise ConfigError(f"bad escape at {i}")
        out.append({"\\": "\\", "n": "\n", "t": "\t", "r": "\r"}[text[i + 1]])
        i += 2
    return "".join(out)


@dataclass(frozen=True)
class Option:
    """A known key: its type, default, older names, and the bounds of numbers."""

    kind: type = str
    default: object = None
    aliases: tuple[str, ...] = ()
    least: float | None = None
    most: float | None = None


OPTIONS: dict[str, Option] = {
    "mode.mode": Option(str, None),
    "mode.ic_file": Option(str, ""),
    "numerics.treepm_pm_grid": Option(int, 64, ("numerics.pm_grid",), 2, 4096),
    "numerics.treepm_asmth_cells": Option(float, 1.25, (), 0.0),
    "numerics.treepm_rcut_cells": Option(float, 6.25, (), 0.0),
    "numerics.treepm_assignment_scheme": Option(Assignment, Assignment.CIC),
    "numerics.treepm_update_cadence_steps": Option(int, 1, (), 1),
    "numerics.hierarchical_max_rung": Option(int, 0, (), 0, 62),
    "output.run_name": Option(str, "run"),
    "output.output_stem": Option(str, "snapshot"),
    "output.restart_stem": Option(str, "restart"),
    "analysis.run_health_interval_steps": Option(int, 1, (), 1),
    "analysis.light_interval_steps": Option(int, 8, (), 1),
    "analysis.heavy_interval_steps": Option(int, 64, (), 1),
    "analysis.retention": Option(int, 16, (), 1),
    "schema_version": Option(int, 1),
}


@dataclass(frozen=True)
class Frozen:
    values: dict[str, object]
    used_aliases: tuple[str, ...] = ()
    canonical: str = field(default="", compare=False)

    @property
    def hash(self) -> str:
        return f"{fnv1a(self.canonical):016x}"

    def __getitem__(self, key: str):
        return self.values[key]


def _typed(key: str, opt: Option, text: str) -> object:
    if issubclass(opt.kind, Enum):
        return parse_enum(opt.kind, text)
    if opt.kind is bool:
        if text.lower() not in ("true", "false", "1", "0", "yes", "no", "on", "off"):
            raise ConfigError(f"{key}: {text!r} is no truth value")
        return text.lower() in ("true", "1", "yes", "on")
    try:
        value = opt.kind(text)
    except ValueError as e:
        raise ConfigError(f"{key}: {text!r} is no {opt.kind.__name__}") from e
    if opt.kind in (int, float) and (value != value or opt.least is not None and value < opt.least or opt.most is not None and value > opt.most):
        raise ConfigError(f"{key}: {value} is out of bounds")
    return value


def freeze(text: str, options: dict[str, Option] | None = None, allow_unknown: bool = True) -> Frozen:
    """Typed values with defaults. An old name may stand for a key; both with different values are an error."""
    options = OPTIONS if options is None else options
    given = parse(text)
    if "mode" in given and "mode.mode" not in given:
        given["mode.mode"] = given.pop("mode")
    values: dict[str, object] = {}
    used = []
    for key, opt in options.items():
        found = {k: given[k] for k in (key, *opt.aliases) if k in given}
        if len(set(found.values())) > 1:
            raise ConfigError(f"{key} and its older names differ: {found}")
        used += [k for k in found if k != key]
        values[key] = _typed(key, opt, next(iter(found.values()))) if found else opt.default
        if values[key] is None:
            raise ConfigError(f"{key} is missing")
    known = {k for key, o in options.items() for k in (key, *o.aliases)}
    unknown = {k: v for k, v in given.items() if k not in known}
    if unknown and not allow_unknown:
        raise ConfigError(f"unknown keys: {sorted(unknown)}")
    values |= unknown
    show = lambda v: v.value if isinstance(v, Enum) else repr(v) if isinstance(v, float) else str(v)
    canonical = "\n".join(f"{k} = {escape(show(v))}" for k, v in sorted(values.items()))
    return Frozen(values, tuple(used), canonical)


def load(path: str) -> Frozen:
    with open(path, encoding="utf-8") as f:
        return freeze(f.read())
