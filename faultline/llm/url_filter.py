"""Allow and block rules for URLs, found by hashed host and path expressions.

A URL is expanded into host suffixes x path prefixes (one prefix for each length that some rule
has), each expression is joined to the rules on a short prefix of its digest, and what meets is
confirmed by the full digest before precedence picks one rule.

Defined results: a URL that is null or has no ``://`` has empty host and path and fits no rule.
Rows without a fitting rule get a null ``rule`` and the default verdict. The longest rule wins
(characters of host and path together), then the longer host; of one rule given with both
verdicts, ``block`` wins. Rules with a null host, path or verdict, or an empty host, are ignored.
Every input row gives one output row, repeated ids and repeated rows included; columns of
``pages`` other than the two read are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import LOWER, UPPER, table

#: The production rules (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DEFAULT_VERDICT = "allow"
SALTS = 16


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """A literal relation, so Spark knows its exact size."""
    rows = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("host", "path", "verdict"), r))) for r in rules))
    return spark.range(1).select(F.inline(rows))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _suffixes(host: Column) -> Column:
    """The host and every shorter suffix that begins at a label."""
    labels = F.split(host, r"\.", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
    )


def _prefixes(path: Column, lengths: Column) -> Column:
    return F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))


def _expression(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def _expressions(suffixes: Column, prefixes: Column) -> Column:
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: _expression(s, p))))


def _digest(expression: Column) -> Column:
    return F.unhex(F.sha2(expression, 256))


def _short(digest: Column) -> Column:
    return F.substring(F.hex(digest), 1, 8)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    default: str = DEFAULT_VERDICT,
    salts: int = SALTS,
) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``.

    The join key of a common host is spread over ``salts`` copies of the rules, so one host with
    a large share of the rows does not fill one task.
    """
    url = F.coalesce(F.col(url_column), F.lit(""))
    rows = pages.select(F.col(id_column), host_of(url).alias("host"), _path(url).alias("path"))

    known = (
        rules.select("host", "path", "verdict")
        .where("host IS NOT NULL AND host <> '' AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # "block" sorts after "allow"
    )
    keyed = known.select(
        F.concat("host", "path").alias("_rule"),
        F.col("verdict").alias("_verdict"),
        F.length("host").alias("_host_length"),
        _digest(_expression(F.col("host"), F.col("path"))).alias("_rule_digest"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_rule_salt"),
    ).withColumn("_rule_short", _short(F.col("_rule_digest")))
    # one value: the distinct lengths of rule paths
    lengths = known.agg(F.array_sort(F.collect_set(F.length("path")))).scalar()

    expressions = (
        rows.where("host <> ''")
        .select("host", "path")
        .distinct()
        .withColumn("_lengths", lengths)
        .withColumn("_prefixes", _prefixes(F.col("path"), F.col("_lengths")))
        .withColumn("_expression", F.explode(_expressions(_suffixes(F.col("host")), F.col("_prefixes"))))
        .select(
            "host",
            "path",
            _digest(F.col("_expression")).alias("_digest"),
            F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int").alias("_salt"),
        )
        .withColumn("_short", _short(F.col("_digest")))
    )
    meets = (F.col("_short") == F.col("_rule_short")) & (F.col("_salt") == F.col("_rule_salt"))
    best = (
        expressions.join(keyed, meets)
        .where(F.col("_digest") == F.col("_rule_digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("_rule"), "_host_length", "_rule", "_verdict")).alias("_best"))
    )
    return rows.join(best, ["host", "path"], "left").select(
        id_column,
        "host",
        "path",
        F.col("_best._rule").alias("rule"),
        F.coalesce(F.col("_best._verdict"), F.lit(default)).alias("verdict"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark))


ORACLE = """
WITH rule(host_, path_, verdict_) AS (VALUES
    ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
part AS (
    SELECT row_number() OVER () AS n, page_id, coalesce(substr(url, nullif(instr(url, '://'), 0) + 3), '') AS rest FROM pages),
split AS (
    SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM part),
fit AS (
    SELECT n, host_ || path_ AS rule, verdict_, row_number() OVER (PARTITION BY n ORDER BY length(host_ || path_) DESC, length(host_) DESC) AS k
    FROM split JOIN rule ON (host = host_ OR ends_with(host, '.' || host_)) AND starts_with(path, path_))
SELECT page_id, host, path, rule, coalesce(verdict_, 'allow') AS verdict
FROM split LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (n)
"""
