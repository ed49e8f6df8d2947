"""Labels, edge types and the partitioned id space."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label names, in id-block order, and edge types.
PACKAGE, VERSION, MAINTAINER, SERVICE, LOCKFILE = LABELS = (
    "Package", "Version", "Maintainer", "Service", "Lockfile",
)
DEPENDS_ON, MAINTAINED_BY, RESOLVED_IN, TYPOSQUAT_OF = PUBLIC_EDGES = (
    "DEPENDS_ON", "MAINTAINED_BY", "RESOLVED_IN", "TYPOSQUAT_OF",
)
DEPENDED_ON_BY, MAINTAINS = "DEPENDED_ON_BY", "MAINTAINS"
DEFAULT_ECOSYSTEM = "npm"
TIER1 = ("tier-1", "tier1", "tier_1", "critical")
MAX_DEPTH = 8
DEFAULT_DEPTH = 6
ROUTE_CAP = 400
SPAN = 10**12  # ids of one label; the same for every data set, so that ids and edge ids stay put


@dataclass(frozen=True)
class IdSpace:
    """Block ``k`` of width ``span`` (k = 1..5) holds the ids of one label."""

    span: int = SPAN

    def base(self, label: str) -> int:
        return (LABELS.index(label) + 1) * self.span

    def label_of(self, node: Column) -> Column:
        """Label of an id; null outside every block."""
        out = F.lit(None).cast("string")
        for label in LABELS:
            out = F.when(self.is_label(node, label), label).otherwise(out)
        return out

    def is_label(self, node: Column, label: str) -> Column:
        low = self.base(label)
        return (node >= low) & (node < low + self.span)


def is_tier1(criticality: Column) -> Column:
    return F.lower(F.coalesce(criticality, F.lit(""))).isin(*TIER1)


def natural_key(label: str, *parts: Column) -> Column:
    """The string that identifies a node across ingests."""
    if label == PACKAGE:
        return F.concat_ws(":", *parts)
    if label == VERSION:
        ecosystem, name, semver = parts
        return F.concat(ecosystem, F.lit(":"), name, F.lit("@"), semver)
    if label == LOCKFILE:
        return F.concat(F.lit("lockfile:"), F.concat_ws("/", *parts))
    return F.concat(F.lit(label.lower() + ":"), *parts)


def edge_id(edge_type: str, src: Column, dst: Column) -> Column:
    """Upper 62 bits of sha1("type|src|dst")."""
    digest = F.sha1(F.concat_ws("|", F.lit(edge_type), src.cast("string"), dst.cast("string")).cast("binary"))
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 30).bitwiseOR(F.shiftright(low, 2))
