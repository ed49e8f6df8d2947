"""Semantic versions and npm ranges as Column expressions.

A version becomes a text key that sorts in version order, a range becomes key
intervals, and ``satisfies`` compares the two. Callers evaluate the parsers once per
*distinct* string and join the result back.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits and grammar of the public npm / SemVer 2.0.0 definitions.
MAX_COMPONENT = 2**53 - 1
MAX_LENGTH = 256
NUMBER = r"(?:0|[1-9][0-9]*)"
IDENTIFIER = rf"(?:{NUMBER}|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
PRERELEASE = rf"(?:{IDENTIFIER}(?:\.{IDENTIFIER})*)"
BUILD = r"\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*"
STRICT = rf"^v?({NUMBER})\.({NUMBER})\.({NUMBER})(?:-({PRERELEASE}))?(?:{BUILD})?$"
LENIENT = (
    r"^\s*[v=]?\s*([0-9]+)\.([0-9]+)\.([0-9]+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\s*$"
)
PART = rf"(?:{NUMBER}|x|X|\*)"
PLAIN = rf"[v=\s]*{PART}(?:\.{PART}(?:\.{PART}(?:-{PRERELEASE})?)?)?"
HYPHEN = rf"^({PLAIN}) - ({PLAIN})$"
TOKEN = (
    rf"^(\^|~>?|[<>]=?|=)?([v=\s]*)({PART})(?:\.({PART})(?:\.({PART})(?:-({PRERELEASE}))?)?)?$"
)
OPERATOR_GAP = r"([<>]=?|=|~>?|\^)\s+"
EDGE_SPACE = r"^\s+|\s+$"

# Marks inside a key: a prerelease sorts below its release, the end of an
# identifier below any character of one, and AFTER right behind a whole key.
IS_RELEASE, IS_PRERELEASE, END, AFTER = "~", "-", " ", "!"


def _number(digits: Column) -> Column:
    """Digits without leading zeros, in a form whose text order is numeric order."""
    return F.concat(F.lpad(F.length(digits).cast("string"), 3, "0"), digits)


def _identifiers(pre: Column, strip_zeros: bool) -> Column:
    def one(part: Column) -> Column:
        digits = F.regexp_replace(part, "^0+(?=[0-9])", "") if strip_zeros else part
        return F.when(part.rlike("^[0-9]+$"), F.concat(F.lit("1"), _number(digits), F.lit(END))).otherwise(
            F.concat(F.lit("2"), part, F.lit(END))
        )

    return F.array_join(F.transform(F.split(pre, r"\."), one), "")


def _key(numbers: list[Column], pre: Column, strip_zeros: bool = False) -> Column:
    """Version order as text order: numbers, then release or prerelease identifiers."""
    return F.concat(
        *[_number(n) for n in numbers],
        F.when(pre == "", F.lit(IS_RELEASE)).otherwise(
            F.concat(F.lit(IS_PRERELEASE), _identifiers(pre, strip_zeros))
        ),
    )


def is_release(key: Column) -> Column:
    return key.endswith(IS_RELEASE)


def same_core(key: Column) -> Column:
    """The part of a prerelease key it shares with its release."""
    return F.substring_index(key, IS_PRERELEASE, 1)


def component(version: Column, which: int) -> Column:
    """Major (1), minor (2) or patch (3) of a version text."""
    return F.regexp_extract(version, LENIENT, which).try_cast("bigint")


def strict_key(version: Column) -> Column:
    """Sortable key of an npm version; null when it is not one."""
    text = F.regexp_replace(version, EDGE_SPACE, "")
    numbers = [F.regexp_extract(text, STRICT, i) for i in (1, 2, 3)]
    usable = (F.length(version) <= MAX_LENGTH) & text.rlike(STRICT)
    for number in numbers:
        usable = usable & F.coalesce(number.try_cast("bigint") <= MAX_COMPONENT, F.lit(False))
    return F.when(usable, _key(numbers, F.regexp_extract(text, STRICT, 4)))


def lenient_key(version: Column) -> Column:
    """Sortable key that also accepts ``=`` prefixes and leading zeros."""
    numbers = [
        F.regexp_replace(F.regexp_extract(version, LENIENT, i), "^0+(?=[0-9])", "") for i in (1, 2, 3)
    ]
    return F.when(
        version.rlike(LENIENT), _key(numbers, F.regexp_extract(version, LENIENT, 4), strip_zeros=True)
    )


def _comparator(op, major, minor, patch, pre) -> Column:
    as_long = [F.lit(x).cast("bigint") if isinstance(x, int) else x for x in (major, minor, patch)]
    text = F.lit(pre) if isinstance(pre, str) else pre
    return F.struct(
        (F.lit(op) if isinstance(op, str) else op).alias("op"),
        as_long[0].alias("major"),
        as_long[1].alias("minor"),
        as_long[2].alias("patch"),
        text.alias("pre"),
    )


_NONE = "array<struct<op:string,major:bigint,minor:bigint,patch:bigint,pre:string>>"


def _bounds(t: Column) -> Column:
    """Comparators of one parsed token; null when the token is malformed."""
    zero = F.lit(0).cast("bigint")
    any_major, any_minor = t["x1"], t["x1"] | t["x2"]
    partial = any_minor | t["x3"]
    major = t["n1"]
    minor = F.when(any_minor, zero).otherwise(t["n2"])
    patch = F.when(partial, zero).otherwise(t["n3"])
    pre = F.when(partial, F.lit("")).otherwise(t["pre"])
    none = F.array().cast(_NONE)

    def floor_(op) -> Column:
        return _comparator(op, major, minor, patch, pre)

    def next_series(op: str, tag: str) -> Column:
        """First version past the written major, or past the written minor."""
        return _comparator(
            op,
            F.when(any_minor, major + 1).otherwise(major),
            F.when(any_minor, zero).otherwise(minor + 1),
            0,
            tag,
        )

    caret_top = (
        F.when(any_minor | (major > 0), _comparator("<", major + 1, 0, 0, "0"))
        .when(t["x3"] | (minor > 0), _comparator("<", major, minor + 1, 0, "0"))
        .otherwise(_comparator("<", major, minor, patch + 1, "0"))
    )
    op = t["op"]
    misordered = (t["x1"] & ~t["x2"]) | (t["x2"] & ~t["x3"])
    plain = (
        F.when(misordered, F.lit(None).cast(_NONE))
        .when(any_major & op.isin("<", ">"), F.array(_comparator("<", 0, 0, 0, "0")))
        .when(any_major, none)
        .when(partial & op.isin("", "="), F.array(floor_(">="), next_series("<", "0")))
        .when(partial & (op == ">"), F.array(next_series(">=", "")))
        .when(partial & (op == ">="), F.array(floor_(">=")))
        .when(partial & (op == "<="), F.array(next_series("<", "0")))
        .when(partial, F.array(_comparator("<", major, minor, 0, "0")))
        .when(t["noise"].isin("", "v"), F.array(floor_(F.when(op == "=", "").otherwise(op))))
    )
    return (
        F.when(~t["ok"], F.lit(None).cast(_NONE))
        .when(t["role"] == "from", F.when(any_major, none).otherwise(F.array(floor_(">="))))
        .when(
            t["role"] == "to",
            F.when(any_major, none)
            .when(partial, F.array(next_series("<", "0")))
            .otherwise(F.array(floor_("<="))),
        )
        .when(op == "^", F.when(any_major, none).otherwise(F.array(floor_(">="), caret_top)))
        .when(
            op.startswith("~"),
            F.when(any_major, none).otherwise(F.array(floor_(">="), next_series("<", "0"))),
        )
        .otherwise(plain)
    )


def _pieces(alternative: Column) -> Column:
    """(role, text) of the tokens in one ``||`` alternative."""

    def piece(role: str, text: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), text.alias("text"))

    tokens = F.filter(
        F.split(F.regexp_replace(alternative, OPERATOR_GAP, "$1"), " "), lambda x: x != ""
    )
    return F.when(
        alternative.rlike(HYPHEN),
        F.array(
            piece("from", F.regexp_extract(alternative, HYPHEN, 1)),
            piece("to", F.regexp_extract(alternative, HYPHEN, 2)),
        ),
    ).otherwise(F.transform(tokens, lambda x: piece("token", x)))


def _fields(p: Column) -> Column:
    raw = {name: F.regexp_extract(p["text"], TOKEN, i) for i, name in
           enumerate(("op", "noise", "p1", "p2", "p3", "pre"), start=1)}
    columns = [p["role"].alias("role"), p["text"].rlike(TOKEN).alias("ok")]
    columns += [raw[n].alias(n) for n in ("op", "noise", "pre")]
    for i in (1, 2, 3):
        columns.append(raw[f"p{i}"].isin("", "x", "X", "*").alias(f"x{i}"))
        columns.append(raw[f"p{i}"].try_cast("bigint").alias(f"n{i}"))
    return F.struct(*columns)


def _representable(c: Column) -> Column:
    inside = F.lit(True)
    length = F.length(c["pre"]) + F.when(c["pre"] == "", 2).otherwise(3)
    for name in ("major", "minor", "patch"):
        inside = inside & F.coalesce(c[name] <= MAX_COMPONENT, F.lit(False))
        length = length + F.length(c[name].cast("string"))
    return inside & (length <= MAX_LENGTH)


def range_sets(constraint: Column) -> Column:
    """Comparator sets of an npm range, one per alternative; null when invalid."""
    cleaned = F.transform(
        F.split(constraint, r"\|\|"),
        lambda a: F.regexp_replace(
            F.regexp_replace(F.regexp_replace(a, EDGE_SPACE, ""), r"\s+", " "), BUILD, ""
        ),
    )
    parsed = F.transform(
        F.transform(cleaned, _pieces), lambda pieces: F.transform(pieces, _fields)
    )
    bounds = F.transform(parsed, lambda tokens: F.transform(tokens, _bounds))
    valid = F.forall(
        bounds,
        lambda tokens: F.forall(
            tokens, lambda cmps: cmps.isNotNull() & F.forall(F.coalesce(cmps, F.array().cast(_NONE)), _representable)
        ),
    )
    return F.when(valid, F.transform(bounds, lambda tokens: _interval(F.flatten(tokens))))


def _interval(comparators: Column) -> Column:
    """Half-open key interval of a comparator set, the prereleases it admits, its text.

    The comparators of a set all have to hold, so the set is one interval.
    """
    keyed = F.transform(
        comparators,
        lambda c: F.struct(
            c["op"].alias("op"),
            _key([c[n].cast("string") for n in ("major", "minor", "patch")], c["pre"]).alias("key"),
        ),
    )

    def past(c: Column) -> Column:
        return F.concat(c["key"], F.lit(AFTER))

    lows = F.transform(
        F.filter(keyed, lambda c: c["op"].isin(">", ">=", "")),
        lambda c: F.when(c["op"] == ">", past(c)).otherwise(c["key"]),
    )
    highs = F.transform(
        F.filter(keyed, lambda c: c["op"].isin("<", "<=", "")),
        lambda c: F.when(c["op"] == "<", c["key"]).otherwise(past(c)),
    )
    prereleases = F.filter(keyed, lambda c: ~is_release(c["key"]))
    written = F.transform(
        comparators,
        lambda c: F.concat(
            F.when(c["op"] == "", "=").otherwise(c["op"]),
            F.concat_ws(".", *[c[n].cast("string") for n in ("major", "minor", "patch")]),
            F.when(c["pre"] == "", "").otherwise(F.concat(F.lit("-"), c["pre"])),
        ),
    )
    return F.struct(
        F.coalesce(F.array_max(lows), F.lit("")).alias("low"),
        F.coalesce(F.array_min(highs), F.lit(IS_RELEASE)).alias("high"),
        F.transform(prereleases, lambda c: same_core(c["key"])).alias("admits"),
        F.array_join(written, " ").alias("text"),
    )


def range_is_evidence(constraint: Column, sets: Column) -> Column:
    """A constraint may narrow exposure only when it provably parses and is not blank."""
    blank = F.regexp_replace(F.coalesce(constraint, F.lit("")), EDGE_SPACE, "") == ""
    return sets.isNotNull() & ~blank


def inside(key: Column, interval: Column) -> Column:
    """Whether a version key lies in one comparator set."""
    return (
        (key >= interval["low"])
        & (key < interval["high"])
        & (is_release(key) | F.array_contains(interval["admits"], same_core(key)))
    )


def satisfies(key: Column, sets: Column) -> Column:
    """Whether a version key lies in a parsed range; false when either is null."""
    return F.coalesce(F.exists(sets, lambda s: inside(key, s)), F.lit(False))


def sets_text(sets: Column) -> Column:
    """Readable canonical form, e.g. ``>=1.2.0 <2.0.0-0 || =3.0.0``."""
    return F.array_join(F.transform(sets, lambda s: s["text"]), " || ")


@lru_cache(maxsize=256)
def _named(parser, column: str, gateway) -> Column:
    return parser(F.col(column))


def of_column(parser, column: str) -> Column:
    """``parser(F.col(column))``, composed once: these expressions are large."""
    return _named(parser, column, SparkContext._gateway)
