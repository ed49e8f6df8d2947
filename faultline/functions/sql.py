"""The version and name functions under SQL names, for queries written as text.

They are SQL functions, so Catalyst puts their bodies in place of the calls: version keys and
folded names stay plain expressions, and ``satisfies`` becomes a join with the parsed ranges of
the distinct constraints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.functions import names as N
from faultline.functions import semver as V
from faultline.operators.versions import ranges_of
from faultline.session import Scratch

RANGES = "constraint_ranges"


def _literal(pattern: str) -> str:
    """A raw SQL string."""
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _number(digits: str) -> str:
    return f"concat(lpad(cast(length({digits}) AS STRING), 3, '0'), {digits})"


def _identifiers(pre: str, digits: str) -> str:
    one = f"CASE WHEN p RLIKE '^[0-9]+$' THEN concat('1', {_number(digits)}, '{V.END}') ELSE concat('2', p, '{V.END}') END"
    return f"array_join(transform(split({pre}, r'\\.'), p -> {one}), '')"


def _key(text: str, pattern: str, number: str, identifiers: str) -> str:
    part = lambda i: f"regexp_extract({text}, {_literal(pattern)}, {i})"
    numbers = ", ".join(_number(number.format(part(i))) for i in (1, 2, 3))
    tail = f"CASE WHEN {part(4)} = '' THEN '{V.IS_RELEASE}' ELSE concat('{V.IS_PRERELEASE}', {_identifiers(part(4), identifiers)}) END"
    return f"concat({numbers}, {tail})"


def _statements() -> dict[str, str]:
    trimmed = f"regexp_replace(version, {_literal(V.EDGE_SPACE)}, '')"
    part = lambda i: f"regexp_extract({trimmed}, {_literal(V.STRICT)}, {i})"
    small = " AND ".join(f"coalesce(try_cast({part(i)} AS BIGINT) <= {V.MAX_COMPONENT}, false)" for i in (1, 2, 3))
    bare = r"regexp_replace({}, r'^0+(?=[0-9])', '')"
    digits, letters = N.LOOKALIKE_DIGITS
    folded = f"translate(lower(name), '{digits}{N.SEPARATORS}', '{letters}')"
    for pair, single in N.LOOKALIKE_PAIRS:
        folded = f"replace({folded}, '{pair}', '{single}')"
    core = f"substring_index(version_key, '{V.IS_PRERELEASE}', 1)"
    held = f"version_key >= s.low AND version_key < s.high AND (endswith(version_key, '{V.IS_RELEASE}') OR array_contains(s.admits, {core}))"
    sets = "ARRAY<STRUCT<low: STRING, high: STRING, admits: ARRAY<STRING>, text: STRING>>"
    return {
        "semver_key(version STRING) RETURNS STRING": (
            f"CASE WHEN length(version) <= {V.MAX_LENGTH} AND {trimmed} RLIKE {_literal(V.STRICT)} AND {small} THEN {_key(trimmed, V.STRICT, '{}', 'p')} END"
        ),
        "semver_lenient_key(version STRING) RETURNS STRING": (
            f"CASE WHEN version RLIKE {_literal(V.LENIENT)} THEN {_key('version', V.LENIENT, bare, bare.format('p'))} END"
        ),
        "normalize_name(name STRING) RETURNS STRING": folded,
        f"semver_inside(version_key STRING, sets {sets}) RETURNS BOOLEAN": f"coalesce(exists(sets, s -> {held}), false)",
        "satisfies(version STRING, wanted STRING) RETURNS BOOLEAN": (
            f"semver_inside(semver_key(version), (SELECT any_value(c.sets) FROM {RANGES} c WHERE c.constraint_ = wanted))"
        ),
    }


def register(spark: SparkSession, constraints: DataFrame, scratch: Scratch, column: str = "constraint_") -> None:
    """Make ``semver_key``, ``semver_lenient_key``, ``semver_inside``, ``normalize_name`` and ``satisfies`` known to the session.

    ``satisfies`` knows the distinct texts in ``column`` of ``constraints``; others satisfy nothing.
    """
    parsed = ranges_of(constraints.select(constraints[column].alias("constraint_"))).where("sets IS NOT NULL")
    scratch.keep(parsed, "constraint-ranges").createOrReplaceTempView(RANGES)
    for head, body in _statements().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
