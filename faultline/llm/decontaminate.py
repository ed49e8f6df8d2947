"""Benchmark passages in a corpus, from a positional inverted index.

A window is ``WINDOW`` consecutive words of a benchmark item; an item of fewer words, but not
none, is one window. Corpus frequencies of the benchmark's terms are counted first. The anchor of
a window is its rarest term, so the lists that are read are the shortest ones, and neighbouring
windows of an item mostly share an anchor. The index stores, for anchor terms alone, one posting
for each corpus occurrence: document, position, and the terms up to a window's length before and
after it. Postings meet the anchors of a term, positions are aligned by the anchor's offset in the
item, and the lists of the other offsets are intersected outward from the anchor: the aligned run
of equal terms. A run as long as a window is an exact phrase match; a posting whose neighbourhood
holds at least ``NEAR`` of the window's other terms, in any order, is a proximity match.

Defined results: null and empty texts have no words and no matches. Every input row gives one
row; rows that repeat an id with another text are judged apart. Items with a null id or without
words take no part; items that repeat an id count once. Columns other than id and text are ignored;
an empty benchmark finds nothing, an empty corpus gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import scratch, table, text_key, words
from faultline.session import Scratch

WINDOW = 10
#: Share of the anchor's neighbours that a proximity match needs.
NEAR = 0.8
#: Posting that holds a document's length: no word is the empty text.
LENGTH = ""


def _before(terms: Column, at: Column, reach: int) -> Column:
    """Up to ``reach`` terms before 0-based place ``at``, nearest first."""
    n = F.least(at, F.lit(reach))
    return F.reverse(F.slice(terms, at - n + 1, n))


def _after(terms: Column, at: Column, reach: int) -> Column:
    return F.slice(terms, at + 2, reach)


def _agree(left: Column, right: Column, reach: int) -> Column:
    """Length of the common beginning of two arrays of at most ``reach`` terms."""
    out = F.lit(reach)
    for i in reversed(range(reach)):
        equal = F.coalesce(F.get(left, F.lit(i)) == F.get(right, F.lit(i)), F.lit(False))
        out = F.when(~equal, i).otherwise(out)
    return out


def anchors(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(term, item, place, length, before, after): the rarest term of every window.

    ``documents`` has ``terms``; ``items`` has ``item`` and ``terms``. Ties go to the lesser term,
    then to the first place.
    """
    placed = items.select("item", "terms", F.posexplode("terms").alias("place", "term"))
    vocabulary = placed.select("term").distinct()
    seen = (
        documents.select(F.explode("terms").alias("term")).join(vocabulary, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = placed.join(seen, "term", "left").select(
        "item", "terms", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "place").alias("rank"), "place"
    )
    # items are short texts of a test set, so one row may hold the ranks of an item
    rows = ranked.groupBy("item", "terms").agg(F.array_sort(F.collect_list(F.struct("place", "rank"))).alias("_ranks"))
    length = F.least(F.size("terms"), F.lit(window))
    least = F.transform(
        F.sequence(F.lit(1), F.size("terms") - length + 1), lambda i: F.array_min(F.transform(F.slice("_ranks", i, length), lambda x: x["rank"]))
    )
    return (
        rows.select("item", "terms", length.alias("length"), F.explode(F.array_distinct(least)).alias("_anchor"))
        .select("item", "terms", "length", F.col("_anchor.term").alias("term"), F.col("_anchor.place").alias("place"))
        .select(
            "term",
            "item",
            "length",
            _before(F.col("terms"), F.col("place"), window - 1).alias("item_before"),
            _after(F.col("terms"), F.col("place"), window - 1).alias("item_after"),
        )
    )


def build_index(rows: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """Postings (id, key, term, at, before, after) of ``terms``, and one length posting for each row."""
    listed = F.concat("terms", F.array(F.lit(LENGTH)))
    kept = terms.select("term").union(terms.sparkSession.range(1).select(F.lit(LENGTH))).distinct()
    postings = rows.select("_id", "_key", "terms", F.posexplode(listed).alias("at", "term")).join(kept, "term")
    return postings.select(
        "_id",
        "_key",
        "term",
        "at",
        F.when(F.col("term") != LENGTH, _before(F.col("terms"), F.col("at"), window - 1)).alias("before"),
        F.when(F.col("term") != LENGTH, _after(F.col("terms"), F.col("at"), window - 1)).alias("after"),
    )


def match(index: DataFrame, marks: DataFrame, window: int = WINDOW, near: float = NEAR) -> DataFrame:
    """(id, key, item, kind, start, stop): phrase runs and proximity matches of anchors in the index."""
    reach = window - 1
    met = index.where(F.col("term") != LENGTH).join(marks, "term")
    left, right = _agree(F.col("before"), F.col("item_before"), reach), _agree(F.col("after"), F.col("item_after"), reach)
    around = F.concat("before", "after")
    wanted = F.array_distinct(F.concat("item_before", "item_after"))
    share = F.size(F.array_intersect(wanted, around)) >= F.lit(near) * F.size(wanted)
    aligned = met.withColumn("_left", left).withColumn("_right", right)
    phrase = F.col("_left") + F.col("_right") + 1 >= F.col("length")
    return aligned.withColumn("kind", F.when(phrase, "phrase").when(share & (F.size(wanted) > 0), "proximity")).where("kind IS NOT NULL").select(
        "_id",
        "_key",
        "item",
        "kind",
        F.when(phrase, F.col("at") - F.col("_left")).otherwise(F.col("at") - F.size("before")).alias("start"),
        F.when(phrase, F.col("at") + F.col("_right") + 1).otherwise(F.col("at") + F.size("after") + 1).alias("stop"),
    )


def _covered(runs: Column) -> Column:
    """Places covered by an array of sorted (start, stop)."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("stop"))

    def add(state: Column, run: Column) -> Column:
        stop = F.greatest(state["stop"], run["stop"])
        return F.struct((state["n"] + stop - F.greatest(state["stop"], run["start"])).cast("long").alias("n"), stop.alias("stop"))

    return F.aggregate(runs, start, add, lambda s: s["n"])


def find_passages(
    documents: DataFrame, benchmark: DataFrame, work: Scratch, window: int = WINDOW,
    id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", keys: bool = False,
) -> DataFrame:
    """(id, n_words, n_hit, items, near_items): hits and ids of matched items of every row of ``documents``.

    ``keys`` adds ``_key``, which tells apart the texts of one id.
    """
    rows = documents.select(
        F.col(id_column).alias("_id"), text_key(F.col(text_column)).alias("_key"), words(F.col(text_column)).alias("terms")
    )
    items = (
        benchmark.where(F.col(item_column).isNotNull())
        .select(F.col(item_column).cast("string").alias("item"), words(F.col("text")).alias("terms"))
        .where(F.size("terms") > 0)
        .distinct()
    )
    marks = work.keep(anchors(rows, items, window), "anchors")
    index = work.keep(build_index(rows, marks, window), "index")
    lengths = index.where(F.col("term") == LENGTH).select(F.col("_id"), F.col("_key"), F.col("at").cast("long").alias("n_words"))
    exact, loose = F.col("kind") == "phrase", F.col("kind") == "proximity"
    # sets of runs and items, so repeated rows of a document add nothing
    found = (
        match(index, marks, window)
        .groupBy(F.col("_id").alias("_doc"), F.col("_key").alias("_other"))
        .agg(
            F.array_sort(F.collect_set(F.when(exact, F.struct("start", "stop")))).alias("_runs"),
            F.array_sort(F.collect_set(F.when(exact, F.col("item")))).alias("_items"),
            F.array_sort(F.collect_set(F.when(loose, F.col("item")))).alias("_near"),
        )
    )
    nothing = F.array().cast("array<string>")
    meets = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_other"))
    return lengths.join(found, meets, "left").select(
        F.col("_id").alias(id_column),
        "n_words",
        F.coalesce(_covered(F.col("_runs")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("_items", nothing).alias("items"),
        F.coalesce("_near", nothing).alias("near_items"),
        *(["_key"] if keys else []),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), scratch(spark, "decontaminate"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
ORACLE = f"""
WITH doc AS (SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT DISTINCT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT item, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i, w FROM item WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM win),
place AS (SELECT n, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM doc, (SELECT DISTINCT k FROM wanted) WHERE len(w) >= k),
hit AS (SELECT n, item, i, k FROM (SELECT n, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM place) JOIN wanted USING (k, s)),
cover AS (SELECT n, count(DISTINCT p) AS c FROM (SELECT n, unnest(range(i, i + k)) AS p FROM hit) GROUP BY n),
names AS (SELECT n, count(*) AS m, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT n, item FROM hit) GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_hit, coalesce(m, 0)::BIGINT AS n_items,
    sha256(coalesce(s, '')) AS items_sha256, coalesce(c, 0) > 0 AS contaminated
FROM doc LEFT JOIN cover USING (n) LEFT JOIN names USING (n)
"""
