"""Look-alike names within two edits of a popular name.

Two strings are at most two edits apart only if deleting at most two characters
from each can make them equal, so an equality join on those shortened forms
finds every pair without comparing all names with all popular names. Work is
done on distinct folded names, and the distance decides in the end. Few forms of
all names are forms of a popular one as well: a bitmap of bounded size holds the
popular ones, and what it does not know stays out of the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import names as N


WORD_BITS = 21  # the bitmap has at most 2^21 words of 64 bits, whatever the number of names


def _bit(form: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), form.bitwiseAND(F.lit(63)).cast("int"))


def _word(form: Column) -> Column:
    return F.shiftright(form, 6).bitwiseAND(F.lit((1 << WORD_BITS) - 1))


def _met(forms: DataFrame, others: DataFrame) -> DataFrame:
    """The rows of ``forms`` whose form may be one of ``others``; those that are stay, of the rest few do."""
    words = others.groupBy(_word(F.col("form")).alias("_word")).agg(F.bit_or(_bit(F.col("form"))).alias("_bits"))
    return (
        forms.withColumn("_word", _word(F.col("form")))
        .join(F.broadcast(words), "_word")
        .where(F.col("_bits").bitwiseAND(_bit(F.col("form"))) != 0)
        .drop("_word", "_bits")
    )


def look_alikes(candidates: DataFrame, popular: DataFrame) -> DataFrame:
    """(folded_candidate, folded_target, edit_distance) over distinct folded names."""

    tasks = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def forms(df: DataFrame, column: str) -> DataFrame:
        # a name becomes some hundred forms, so few names are much work: they are spread before
        # their number says so, by a hash of their own, as Spark would take the spread that the
        # distinct names have already and put small partitions together. A form is its hash; the
        # distance decides on what meets by chance
        names = df.select(column).distinct().repartition(tasks, F.xxhash64(F.col(column), F.lit("form")))
        return names.select(column, F.explode(F.transform(N.without_up_to_two(F.col(column)), lambda f: F.xxhash64(f))).alias("form"))

    right = forms(popular, "folded_target")
    left = _met(forms(candidates, "folded_candidate"), right)
    distance = F.levenshtein("folded_candidate", "folded_target", N.MAX_DISTANCE)
    near = F.abs(F.length("folded_candidate") - F.length("folded_target")) <= N.MAX_DISTANCE
    return (
        left.join(right, "form")
        .where(near)
        .select("folded_candidate", "folded_target")
        .distinct()
        .withColumn("edit_distance", distance)
        .where("edit_distance >= 0")
    )


def typosquat_edges(packages: DataFrame, ingested: DataFrame | None = None) -> DataFrame:
    """Edges from a look-alike to the popular package it resembles.

    ``packages`` has (id, name, downloads_weekly). ``ingested`` optionally limits
    the candidate side to some names. A candidate must have fewer downloads than
    the target (unknown counts qualify) and must not share its scope.
    """
    folded = packages.select("id", "name", "downloads_weekly", N.fold(F.col("name")).alias("folded"))
    pool = folded if ingested is None else folded.join(ingested.select("name").distinct(), "name", "left_semi")
    left = pool.select(
        F.col("id").alias("src"), F.col("name").alias("c_name"), F.col("downloads_weekly").alias("c_dl"),
        F.col("folded").alias("folded_candidate"),
    )
    right = folded.where(F.col("downloads_weekly") >= N.POPULAR_DOWNLOADS).select(
        F.col("id").alias("dst"), F.col("name").alias("t_name"), F.col("downloads_weekly").alias("t_dl"),
        F.col("folded").alias("folded_target"),
    )
    same_scope = F.coalesce(N.scope(F.col("c_name")) == N.scope(F.col("t_name")), F.lit(False))
    quieter = F.col("c_dl").isNull() | (F.col("c_dl") < F.col("t_dl"))
    return (
        look_alikes(left, right)
        .join(left, "folded_candidate")
        .join(right, "folded_target")
        .where((F.col("c_name") != F.col("t_name")) & ~same_scope & quieter)
        .select(
            "src",
            "dst",
            F.col("edit_distance").cast("bigint").alias("edit_distance"),
            N.similarity(F.col("edit_distance"), F.col("folded_candidate"), F.col("folded_target")).alias(
                "similarity_score"
            ),
        )
    )
