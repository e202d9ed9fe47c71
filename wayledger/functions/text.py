"""Display formatters: localised digits and relative age."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .plates import ascii_to_deva


def number_label(value: Column, lang: str = "en") -> Column:
    """Thousands-grouped number, in Devanagari digits for ``ne``."""
    text = F.format_number(value, 0)
    return ascii_to_deva(text) if lang == "ne" else text


def _rounded(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("bigint")


def relative_age(then: Column, as_of: Column, lang: str = "en") -> Column:
    """Age label in seconds, minutes, hours or days, rounded half up."""
    micros = F.unix_micros(as_of) - F.unix_micros(then)
    secs = F.greatest(F.lit(0).cast("bigint"), _rounded(micros / F.lit(1_000_000.0)))
    # Unit suffixes in both languages.
    unit = {"en": ("s", "m", "h", "d"), "ne": (" से", " मि", " घ", " दिन")}[lang]

    def label(divisor: int, suffix: str) -> Column:
        n = _rounded(secs / F.lit(float(divisor))) if divisor > 1 else secs
        text = number_label(n, lang) if lang == "ne" else n.cast("string")
        return F.concat(text, F.lit(suffix))

    return (
        F.when(secs < 60, label(1, unit[0]))
        .when(secs < 3600, label(60, unit[1]))
        .when(secs < 86400, label(3600, unit[2]))
        .otherwise(label(86400, unit[3]))
    )
