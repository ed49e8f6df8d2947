"""Package registry documents, downloads and repository addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = (
    "name string, maintainers array<struct<name:string,email:string>>, time map<string,string>, "
    "`dist-tags` struct<latest:string>"
)
NOT_RELEASES = ("created", "modified")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).json(path)


def latest_tags(documents: DataFrame) -> DataFrame:
    return documents.groupBy("name").agg(F.max("dist-tags.latest").alias("latest"))


def owners(documents: DataFrame) -> DataFrame:
    """(name, username, email); entries without a user name are left out."""
    return (
        documents.select("name", F.explode("maintainers").alias("m"))
        .where("m.name IS NOT NULL AND m.name <> ''")
        .groupBy("name", F.col("m.name").alias("username"))
        .agg(F.max("m.email").alias("email"))
    )


def publications(documents: DataFrame) -> DataFrame:
    """(name, semver, published_at) of every release in the time map."""
    releases = F.map_filter("time", lambda version, _: ~version.isin(*NOT_RELEASES))
    return (
        documents.select("name", F.explode(releases).alias("semver", "stamp"))
        .groupBy("name", "semver")
        .agg(F.max(iso_time(F.col("stamp"))).alias("published_at"))
    )


def iso_time(text: Column) -> Column:
    """UTC time of an ISO-8601 text; null when it is not one."""
    at = F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d\d-\d\d"), text))
    return F.to_utc_timestamp(at, F.current_timezone()).cast("timestamp_ntz")


def iso_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def with_downloads(packages: DataFrame, downloads: DataFrame) -> DataFrame:
    """Attach weekly downloads; a package the feed does not know stays null."""
    return packages.join(downloads.select("name", "downloads_weekly"), "name", "left")


def https_address(remote: Column) -> Column:
    """Plain https address of any git remote spelling; null when not recognised."""
    bare = F.regexp_replace(F.trim(remote), r"\.git$", "")
    scp = r"^git@([^:]+):(.+)$"
    ssh = r"^ssh://(?:git@)?([^/]+)/(.+)$"
    return (
        F.when(bare.rlike(scp), F.regexp_replace(bare, scp, "https://$1/$2"))
        .when(bare.rlike(ssh), F.regexp_replace(bare, ssh, "https://$1/$2"))
        .when(bare.rlike("^https?://"), bare)
        .when(bare.startswith("git://"), F.regexp_replace(bare, "^git://", "https://"))
    )


def repository_name(remote: Column) -> Column:
    """``org/repo`` of any git remote spelling."""
    text = F.trim(remote)
    path = F.when(text.startswith("git@"), F.regexp_replace(text, r"^[^:]*:", "")).otherwise(
        F.regexp_replace(F.regexp_replace(text, r"^[a-z+]+://(git@)?", ""), r"^[^/]*/", "")
    )
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(path, r"^/+|/+$", ""), r"\.git$", ""), "/"), lambda p: p != "")
    return F.when(F.size(parts) == 0, remote).otherwise(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/"))
