"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import Scratch

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Runs of characters that end a word: ASCII other than digits and lower-case letters.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python can import it.

    The driver serves the archive from its own temporary folder; no executor reads that folder.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(prefix="faultline-code-"), "faultline_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> Scratch:
    """A folder of written tables below ``spark.checkpoint.dir``."""
    return Scratch(spark, label)


def set_aside(frame: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``frame`` with all columns but ``used`` under numbers, and the way back to its own columns.

    Helper columns begin with an underscore or are named by an operator, so no column of the
    caller's can meet them meanwhile.
    """
    held = {c: c if c in used else f"kept_{i}" for i, c in enumerate(frame.columns)}

    def back(out: DataFrame) -> DataFrame:
        return out.select(*(F.col(h).alias(c) for c, h in held.items()))

    return frame.select(*(F.col(f"`{c}`").alias(h) for c, h in held.items())), back


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; the fast built-in serves texts that are all ASCII."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Lower-cased words of letters, digits and non-ASCII characters; null has none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS)
    return F.filter(parts, lambda w: w != "")


def text_key(text: Column) -> Column:
    """Tells apart rows of one id that hold different texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def same(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    """Null-safe equality on all ``keys``."""
    out = F.lit(True)
    for key in keys:
        out = out & left[key].eqNullSafe(right[key])
    return out
