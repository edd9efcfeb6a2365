"""Numbers with unit suffixes, as Column expressions and plain functions, and log levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of frequencies.
FACTORS = {"": 1.0, "k": 1e3, "m": 1e6, "g": 1e9}


def parse_frequency(text: str) -> float:
    """100k, 2_0M, 1.5G or plain numbers; underscores are ignored."""
    plain = text.replace("_", "").strip().lower()
    suffix = plain[-1:] if plain[-1:] in "kmg" else ""
    return float(plain.removesuffix(suffix) if suffix else plain) * FACTORS[suffix]


# Log levels in order.
LEVELS = ("error", "warn", "info", "debug", "trace")


def parse_verbosity(text: str) -> int:
    """0 for error to 4 for trace."""
    if text.lower() not in LEVELS:
        raise ValueError(f"no log level: {text!r}; valid values are {', '.join(LEVELS)}")
    return LEVELS.index(text.lower())


def frequency(text: Column) -> Column:
    """The same over a string column; null for other texts."""
    plain = F.lower(F.replace(F.trim(text), F.lit("_"), F.lit("")))
    number = F.regexp_extract(plain, r"^([-+]?[0-9]*\.?[0-9]+(?:e[-+]?[0-9]+)?)[kmg]?$", 1)
    suffix = F.regexp_extract(plain, "([kmg])$", 1)
    factor = F.create_map(*(F.lit(x) for pair in FACTORS.items() for x in pair))
    return F.when(number != "", number.cast("double") * F.element_at(factor, suffix))
