"""Package-name folding, edit distance and similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-alike digits, dropped separators, two-letter look-alikes,
# and the typosquat thresholds.
LOOKALIKE_DIGITS = ("01345789", "oleastbg")
SEPARATORS = "-_."
LOOKALIKE_PAIRS = (("rn", "m"), ("vv", "w"))
MAX_DISTANCE = 2
POPULAR_DOWNLOADS = 1_000_000


def fold(name: Column) -> Column:
    digits, letters = LOOKALIKE_DIGITS
    folded = F.translate(F.lower(name), digits + SEPARATORS, letters)
    for pair, single in LOOKALIKE_PAIRS:
        folded = F.replace(folded, F.lit(pair), F.lit(single))
    return folded


def scope(name: Column) -> Column:
    """``@x`` of ``@x/y``; null for unscoped names."""
    return F.nullif(F.regexp_extract(name, r"^(@[^/]*)/", 1), F.lit(""))


def similarity(distance: Column, left: Column, right: Column) -> Column:
    longest = F.greatest(F.length(left), F.length(right), F.lit(1))
    return F.round(F.lit(1.0) - distance / longest, 4)


def without_up_to_two(text: Column) -> Column:
    """The string and every form of it with one or two characters removed."""

    whole = F.length(text)

    def between(low: Column, high: Column) -> Column:
        """The positions from ``low`` to ``high``, none if they are crossed."""
        return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

    def without(i: Column) -> Column:
        return F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, whole))

    def without_both(i: Column, j: Column) -> Column:
        return F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, j - i - 1), F.substring(text, j + 1, whole))

    places = between(F.lit(1), whole)
    once = F.transform(places, without)
    # each pair of places once
    twice = F.flatten(F.transform(places, lambda i: F.transform(between(i + 1, whole), lambda j: without_both(i, j))))
    return F.array_distinct(F.concat(F.array(text), once, twice))
