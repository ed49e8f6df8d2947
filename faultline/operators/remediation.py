"""Which lockfiles to change, to what, and what stays uncovered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schema as X
from faultline.functions import semver as V

# Package manager and override field by lockfile name.
MANAGERS = {
    "package-lock.json": ("npm", "overrides"),
    "npm-shrinkwrap.json": ("npm", "overrides"),
    "pnpm-lock.yaml": ("pnpm", "pnpm.overrides"),
    "yarn.lock": ("yarn", "resolutions"),
}


def _by_filename(filename: Column, which: int, default: str) -> Column:
    pairs = [F.lit(x) for name, values in MANAGERS.items() for x in (name, values[which])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), filename), F.lit(default))


def manager(filename: Column) -> Column:
    return _by_filename(filename, 0, "npm")


def override_field(filename: Column) -> Column:
    return _by_filename(filename, 1, "overrides")


def manifest_range(constraint: Column) -> Column:
    """``=x.y.z`` becomes the range a manifest would hold, ``^x.y.0``."""
    pinned = F.substr(constraint, F.lit(2))
    return F.when(
        constraint.startswith("=") & pinned.rlike(V.LENIENT),
        F.concat(F.lit("^"), V.component(pinned, 1).cast("string"), F.lit("."), V.component(pinned, 2).cast("string"), F.lit(".0")),
    ).otherwise(constraint)


def pinned_constraints(depends_on: DataFrame, roots: DataFrame, ids: X.IdSpace) -> DataFrame:
    """(root, lockfile_id, constraint_) of lockfiles that depend on a root."""
    return (
        depends_on.where(ids.is_label(F.col("src"), X.LOCKFILE))
        .join(roots.select(F.col("root").alias("dst")), "dst", "left_semi")
        .groupBy(F.col("dst").alias("root"), F.col("src").alias("lockfile_id"))
        .agg(F.max("constraint_").alias("constraint_"))
    )


def plan(
    lockfiles: DataFrame,
    services: DataFrame,
    constraints: DataFrame,
    windowed_pins: DataFrame,
    safe: DataFrame,
    exposed: DataFrame,
) -> DataFrame:
    """One row per root and lockfile to patch.

    ``windowed_pins`` (root, lockfile_id) adds lockfiles whose resolution is inside
    the window without a dependency edge; ``safe`` has (root, bad_version,
    safe_version); ``exposed`` (root, service_id) limits the services, and a root
    without any exposed service is not limited.
    """
    pinned = constraints.unionByName(windowed_pins.select("root", "lockfile_id"), allowMissingColumns=True).groupBy(
        "root", "lockfile_id"
    ).agg(F.max("constraint_").alias("constraint_"))
    limited = exposed.select("root").distinct().withColumn("_limited", F.lit(True))
    wanted = exposed.select("root", "service_id").distinct().withColumn("_wanted", F.lit(True))
    filename = F.element_at(F.split("lockfile", "/"), -1)
    stated = F.coalesce("constraint_", F.concat(F.lit("="), F.col("bad_version")))
    return (
        pinned.join(safe.where("safe_version IS NOT NULL"), "root")
        .join(lockfiles.select(F.col("id").alias("lockfile_id"), F.col("name").alias("lockfile"), "service_id"), "lockfile_id")
        .join(limited, "root", "left")
        .join(wanted, ["root", "service_id"], "left")
        .where(F.col("_limited").isNull() | F.col("_wanted").isNotNull())
        .join(services.select(F.col("id").alias("service_id"), F.col("name").alias("service")), "service_id", "left")
        .select(
            "root", "service_id",
            F.coalesce("service", F.concat(F.lit("service-"), F.col("service_id").cast("string"))).alias("service"),
            "lockfile_id",
            "lockfile",
            manager(filename).alias("manager"),
            override_field(filename).alias("override_field"),
            manifest_range(stated).alias("constraint_"),
            "bad_version",
            "safe_version",
        )
    )


def unpatched(exposed: DataFrame, planned: DataFrame) -> DataFrame:
    return exposed.select("root", "service_id").distinct().join(
        planned.select("root", "service_id"), ["root", "service_id"], "left_anti"
    )


def merge_override_rows(declared: DataFrame, current: DataFrame, pins: DataFrame) -> DataFrame:
    """Override rows of every manifest after pinning; other overrides are kept.

    ``declared`` has (service_id, package, spec), ``current`` (service_id, package,
    override), ``pins`` (service_id, package, safe_version). A directly declared
    package asks for the pinned version too.
    """
    key = ["service_id", "package"]
    merged = current.join(pins, key, "full_outer").select(*key, F.coalesce("safe_version", "override").alias("override"), "safe_version")
    return merged.join(declared.select(*key, "spec"), key, "left").select(
        *key,
        "override",
        F.when(F.col("spec").isNotNull(), F.coalesce("safe_version", "spec")).alias("direct_spec"),
        F.col("spec").isNotNull().alias("declared"),
    )


SECTIONS = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")
MANIFEST = "struct<name:string,overrides:map<string,string>," + ",".join(f"{s}:map<string,string>" for s in SECTIONS) + ">"


def merge_overrides(manifest: Column, pins: Column) -> Column:
    """The manifest's overrides with the pinned keys set and all others kept.

    ``manifest`` is a parsed struct; nested override objects stay raw JSON text.
    """
    empty = F.create_map().cast("map<string,string>")
    current = F.coalesce(manifest["overrides"], empty)
    return F.map_concat(F.map_filter(current, lambda k, _: ~F.map_contains_key(pins, k)), pins)


def pin_direct(manifest: Column, section: str, pins: Column) -> Column:
    """A dependency section whose pinned packages ask for the pinned version."""
    return F.transform_values(manifest[section], lambda k, v: F.coalesce(F.try_element_at(pins, k), v))


def declares(manifest: Column, package: Column) -> Column:
    found = F.lit(False)
    for section in SECTIONS:
        found = found | F.coalesce(F.map_contains_key(manifest[section], package), F.lit(False))
    return found
