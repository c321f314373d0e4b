"""Column functions over recognised text and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^[\s\x{85}\x{a0}]+|[\s\x{85}\x{a0}]+$", "")


def normalize(c: Column) -> Column:
    """Lower case, letters and digits only; other signs vanish, white space becomes one space."""
    kept = F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length of the normalised texts, in code points; 0 if both are empty."""
    x, y = normalize(a), normalize(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 0.0).otherwise(1 - F.levenshtein(x, y) / longest)


def label(kind: Column, n: Column) -> Column:
    """A class name and its number: person_01."""
    return F.format_string("%s_%02d", F.regexp_replace(F.lower(trimmed(kind)), " ", "_"), n.cast("int"))


def rescale(ticks: Column, source: Column, target: Column, symmetric: bool = False) -> Column:
    """Ticks of one time scale in another, halves up; symmetric: halves away from zero."""
    up = lambda t: F.floor((t * target * 2 + source).cast("decimal(38,0)") / (source * 2).cast("decimal(38,0)")).cast("long")
    return F.when(ticks < 0, -up(-ticks)).otherwise(up(ticks)) if symmetric else up(ticks)


def fraction(c: Column) -> tuple[Column, Column]:
    """(numerator, denominator) of a text like 30000/1001; 0 for a part that is no number, and for both without a slash."""
    part = lambda i: F.coalesce(F.get(F.split(c, "/", 2), F.lit(i - 1)).try_cast("int"), F.lit(0))
    both = c.contains("/")
    return F.when(both, part(1)).otherwise(0), F.when(both, part(2)).otherwise(0)


def share(c: Column) -> Column:
    """A confidence held within 0..1, in single precision; null stays."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))).cast("float")
