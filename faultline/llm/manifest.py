"""Merkle manifest of a table: one leaf a row, one tree a group, one tree over the groups' roots.

Trees grow by self-joins. On every level each node meets the other nodes of its run by their
computed indices (index XOR 1 in a binary tree, slot offsets within the run otherwise), and the
node in slot zero of a run, which then holds the whole run, emits the parent. Keys of these joins
are (tree, index) and so unique: a group with a third of all rows is dealt out like any other.
Going down again, every node puts its own siblings before the path of its parent, so a proof is
built by one join a level and no node's path is computed twice.

Leaves take their index from a range-partitioned sort, never from a window over a group. Levels
are written to the shared folder, each half as large as the one before.

Defined results: every row is a leaf, equal rows and rows of one id too; rows of one id ascend by
their digests. A null id stands before all others and is never tampered with; null languages
are one group, ordered first. Null fields have their own mark, so null and empty text differ. A
tree of one leaf has that leaf as its root and no siblings; the proof of a sole row is the digest
of the empty string. Columns other than the five read are ignored, whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import scratch, table
from faultline.operators.ordering import number_rows
from faultline.session import Scratch

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, TAMPER_STEP = 2, 7
#: Levels joined in one job on the way down before they are written.
LEVELS_AT_ONCE = 4


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(frame: DataFrame, **changed: Column) -> Column:
    """Digest of a row's fields; ``changed`` has other values for some of them."""
    return digest(*(field(changed.get(name, frame[name])) for name in FIELDS))


def _steps(nodes: DataFrame, fan: int) -> DataFrame:
    """Each node with the digests of its run that stand left and right of it."""
    slot = F.col("_at") % fan
    out = nodes
    for offset in range(1, fan):
        # what a node finds at `offset` slots after its own, around the end of the run
        index = F.col("_at").bitwiseXOR(F.lit(1)) if fan == 2 else F.col("_at") - slot + (slot + fan - offset) % fan
        other = nodes.select("_tree", index.alias("_at"), F.col("_digest").alias(f"_other{offset}"))
        out = out.join(other, ["_tree", "_at"], "left")
    # slots ascend from the run's first: those around the end of the run stand to the left
    others = [(F.coalesce(f"_other{offset}", F.lit("")), offset) for offset in range(1, fan)]
    left = F.concat(F.lit(""), *(F.when(slot + offset >= fan, other).otherwise("") for other, offset in others))
    right = F.concat(F.lit(""), *(F.when(slot + offset < fan, other).otherwise("") for other, offset in others))
    return out.select("_tree", "_at", "_size", "_digest", left.alias("_left"), right.alias("_right"))


def _rise(nodes: DataFrame, size: int, fan: int, work: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """(levels with siblings, tops by level) of trees (_tree, _at, _size, _digest) with at most ``size`` leaves."""
    levels, tops = [], []
    while True:
        tops.append(nodes.where("_size = 1").select("_tree", "_at", "_digest"))
        if size <= 1:
            return levels, tops
        level = work.keep(_steps(nodes.where("_size > 1"), fan), "level")
        levels.append(level)
        nodes = level.where(F.col("_at") % fan == 0).select(
            "_tree", F.floor(F.col("_at") / fan).alias("_at"), F.ceil(F.col("_size") / fan).alias("_size"), digest("_digest", "_right").alias("_digest")
        )
        size = -(-size // fan)


def _descend(levels: list[DataFrame], tops: list[DataFrame], told: DataFrame, fan: int, work: Scratch) -> DataFrame:
    """(_tree, _at, _path, ...told) of the leaves; a path lists (left, right) from the leaf on, then what ``told`` has for the tree."""
    rest = [c for c in told.columns if c not in ("_tree", "_path")]
    paths = tops[-1].join(told, "_tree").select("_tree", "_at", "_path", *rest)
    for k in range(len(levels) - 1, -1, -1):
        own = levels[k].select("_tree", "_at", F.floor(F.col("_at") / fan).alias("_up"), F.struct(F.col("_left").alias("left"), F.col("_right").alias("right")).alias("_step"))
        above = paths.withColumnRenamed("_at", "_up")
        longer = own.join(above, ["_tree", "_up"]).select("_tree", "_at", F.concat(F.array("_step"), "_path").alias("_path"), *rest)
        ended = tops[k].join(told, "_tree").select("_tree", "_at", "_path", *rest)
        paths = longer.unionByName(ended)
        if k and k % LEVELS_AT_ONCE == 0:
            paths = work.keep(paths, "paths")
    return paths


def _fold(start: Column) -> Column:
    return F.aggregate("_path", start, lambda at, step: digest(step["left"], at, step["right"]))


def manifest(documents: DataFrame, tampered: Column | None = None, fan: int = FAN) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root, verified), one row for each row.

    ``proof`` is the list of (left, right) sibling digests from the leaf to the root. ``tampered``
    chooses rows whose leaf is taken anew with ``n_chars`` one higher before it is folded.
    """
    work = scratch(documents.sparkSession, "manifest")
    docs = documents.select(*FIELDS)
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    changed = F.coalesce(F.lit(False) if tampered is None else tampered, F.lit(False)) & F.col("n_chars").isNotNull()
    original = leaf(docs)
    leaves = docs.select("doc_id", "lang", original.alias("_digest"), F.when(changed, leaf(docs, n_chars=more)).alias("_other"))
    placed = work.keep(number_rows(leaves, [F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), F.col("_digest")], work, "_position"), "leaves")
    groups = work.keep(placed.groupBy("lang").agg(F.min("_position").alias("_first"), F.count(F.lit(1)).alias("_size")), "groups")
    trees = work.keep(number_rows(groups, [F.asc_nulls_first("lang")], work, "_tree"), "trees")
    bounds = trees.agg(F.max("_size").alias("size"), F.count(F.lit(1)).alias("trees")).first()

    mine = trees.select(F.col("lang").alias("_lang"), "_tree", "_first", "_size")
    rows = work.keep(
        placed.join(mine, F.col("lang").eqNullSafe(F.col("_lang")))
        .select("doc_id", "_tree", (F.col("_position") - F.col("_first")).alias("_at"), "_size", "_digest", "_other"),
        "rows",
    )
    levels, tops = _rise(rows.select("_tree", "_at", "_size", "_digest"), bounds.size or 0, fan, work)
    subroots = work.keep(reduce(DataFrame.unionByName, tops), "subroots")

    # the tree over the groups: one tree, whose leaves are the subroots
    heads = subroots.select(F.lit(0).cast("long").alias("_tree"), F.col("_tree").alias("_at"), F.lit(bounds.trees).cast("long").alias("_size"), "_digest")
    upper, top = _rise(heads, bounds.trees, fan, work)
    root = top[-1].select("_tree", F.col("_digest").alias("root"), F.expr("cast(array() as array<struct<left: string, right: string>>)").alias("_path"))
    told = _descend(upper, [t.limit(0) for t in top[:-1]] + [top[-1]], root, fan, work)
    told = work.keep(
        told.select(F.col("_at").alias("_tree"), "_path", "root").join(subroots.select("_tree", F.col("_digest").alias("subroot")), "_tree"), "told"
    )

    found = rows.join(_descend(levels, tops, told, fan, work), ["_tree", "_at"])
    folded = found.withColumn("folded_root", _fold(F.coalesce("_other", "_digest")))
    return folded.select(
        "doc_id", F.col("_digest").alias("leaf"), "subroot", "root", F.col("_path").alias("proof"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def proof_text(proof: Column) -> Column:
    """The siblings' digests, level by level and left to right within a run."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPER_STEP == 0
    made = manifest(table(spark, sf_dir, "documents"), tampered)
    return made.select("doc_id", "leaf", "subroot", "root", digest(proof_text(F.col("proof"))).alias("proof_sha256"), "folded_root", "verified")


def _sql_field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR END"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_sql_field({"n_chars": n_chars}.get(name, name)) for name in FIELDS) + ")"


ORACLE = f"""
WITH RECURSIVE crc AS (
    SELECT doc_id, xor(list_reduce(
        list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
        lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda i: 0::UBIGINT)),
            lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)), 4294967295::UBIGINT) AS crc
    FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
leaves AS (
    SELECT d.doc_id, lang, {_sql_leaf("n_chars")} AS leaf,
        CASE WHEN c.crc % 7 = 0 AND n_chars IS NOT NULL THEN {_sql_leaf("n_chars::HUGEINT + 1")} ELSE {_sql_leaf("n_chars")} END AS start
    FROM (SELECT * FROM documents) d LEFT JOIN (SELECT doc_id AS _id, crc FROM crc) c ON d.doc_id = c._id),
placed AS (
    SELECT *, row_number() OVER () AS line, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS n,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
    FROM leaves),
lower_nodes AS (
    SELECT tree, 0 AS level, pos, n, leaf AS h FROM placed
    UNION ALL
    SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM lower_nodes WHERE n > 1 GROUP BY tree, level, pos // 2, n),
subroots AS (SELECT tree, h FROM lower_nodes WHERE n = 1),
upper_nodes AS (
    SELECT 0 AS level, tree AS pos, count(*) OVER () AS n, h FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM upper_nodes WHERE n > 1 GROUP BY level, pos // 2, n),
up AS (
    SELECT line, tree, 0 AS level, pos, n, '' AS proof, start AS h FROM placed
    UNION ALL
    SELECT u.line, u.tree, u.level + 1, u.pos // 2, (u.n + 1) // 2, u.proof || coalesce(s.h, ''),
        sha256(CASE WHEN u.pos % 2 = 1 THEN coalesce(s.h, '') || u.h ELSE u.h || coalesce(s.h, '') END)
    FROM up u LEFT JOIN lower_nodes s ON s.tree = u.tree AND s.level = u.level AND s.pos = xor(u.pos, 1) WHERE u.n > 1),
over AS (
    SELECT line, 0 AS level, tree AS pos, (SELECT count(*) FROM subroots) AS n, proof, h FROM up WHERE n = 1
    UNION ALL
    SELECT u.line, u.level + 1, u.pos // 2, (u.n + 1) // 2, u.proof || coalesce(s.h, ''),
        sha256(CASE WHEN u.pos % 2 = 1 THEN coalesce(s.h, '') || u.h ELSE u.h || coalesce(s.h, '') END)
    FROM over u LEFT JOIN upper_nodes s ON s.level = u.level AND s.pos = xor(u.pos, 1) WHERE u.n > 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root, o.h = r.h AS verified
FROM placed p JOIN subroots s ON s.tree = p.tree JOIN over o ON o.line = p.line AND o.n = 1 CROSS JOIN (SELECT h FROM upper_nodes WHERE n = 1) r
"""
