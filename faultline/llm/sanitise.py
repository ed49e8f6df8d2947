"""Personal data in texts: patterns, and terms that give protected values away.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. Around each base
span lie up to ``REACH`` words on either side, its context. Over the whole corpus, all counts are
of documents: N in all, n(t) that hold a term, n(e) that hold a value, and n(e,t) where the term
is in a context of the value. So a copied passage changes them alike, and t tells

    disclosure(t, e) = PMI(t; e) / IC(e),  PMI = log(n(e,t) N / (n(e) n(t))),  IC = log(N / n(e))

of the information in e: 1 if t occurs with e alone, 0 if it is independent of e. Terms that reach
``DISCLOSURE`` in at least ``SUPPORT`` distinct contexts, which copies do not add to, are further
spans in the documents that hold e.

Spans are [start, stop) in code points. A text is cut at the matches of a pattern; the pieces
between them become rows, and a running sum of lengths inside one text gives the positions.

Defined results: null is as empty, and has no spans. Every input row gives one row; rows that
repeat an id with another text are judged apart, equal rows alike. Columns other than id and text
are ignored by ``spans_of`` and kept by ``sanitise``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.common import scratch, table, text_key, words
from faultline.session import Scratch

#: Kinds of spans in their order.
KINDS = ("email", "ip", "card", "phone", "term")
#: The patterns. Possessive repeats and the look-behind change no match; they keep
#: long runs of one character class from being tried again from each of their characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
REACH, CONTEXT_CHARS = 8, 200
SUPPORT, DISCLOSURE, LEAST_TERM = 3, 0.8, 4
WORD_CHARS = r"0-9A-Za-z\x{80}-\x{10FFFF}"


def _may_hold(text: Column, kind: str) -> Column:
    """A cheap test that every text with a span of the kind passes."""
    return {
        "email": text.contains("@"),
        "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
        "phone": text.contains("+") & text.rlike(r"\+[0-9][\x20().0-9-]"),
    }[kind]


def _luhn(digits: Column) -> Column:
    """Double every second digit from the right, add up the digits of all."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    ip = F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"))
    return (
        F.when(kind == "ip", ip)
        .when(kind == "card", n.between(16, 19) & F.when(n.between(16, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(8, 15))
        .otherwise(True)
    )


def _cut(text: Column, kind: str, pattern: Column, applies: Column) -> Column:
    """Matches of ``pattern`` with their number, the length of the text before, and what lies around."""
    matches, pieces = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    found = F.transform(
        F.arrays_zip(matches.alias("value"), pieces.alias("before"), F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))).alias("after")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("number"),
            F.length(x["before"]).alias("gap"),
            x["value"].alias("value"),
            F.right(x["before"], F.lit(CONTEXT_CHARS)).alias("before"),
            F.left(x["after"], F.lit(CONTEXT_CHARS)).alias("after"),
        ),
    )
    held = F.filter(found, lambda x: x["value"].isNotNull())  # the last piece has no match behind it
    return F.when(applies, held)


def _place(cut: DataFrame) -> DataFrame:
    """Positions of matches; rows (id, key, kind, start, stop, value, before, after)."""
    rows = cut.select("_id", "_key", F.explode("_found").alias("m")).select("_id", "_key", "m.*")
    once = (
        rows.repartition("_id", "_key", "kind")
        .groupBy("_id", "_key", "kind", "number")  # equal rows of the table meet here
        .agg(*(F.first(c).alias(c) for c in ("gap", "value", "before", "after")))
    )
    run = Window.partitionBy("_id", "_key", "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.length("value")).over(run)
    return once.withColumn("stop", stop.cast("long")).select(
        "_id", "_key", "kind", (F.col("stop") - F.length("value")).alias("start"), "stop", "value", "before", "after"
    )


def base_spans(rows: DataFrame) -> DataFrame:
    """Valid matches of all patterns in rows (_id, _key, _text)."""
    text = F.col("_text")
    parts = [F.coalesce(_cut(text, k, F.lit(p), _may_hold(text, k)), F.array()) for k, p in PATTERNS.items()]
    return _place(rows.select("_id", "_key", F.concat(*parts).alias("_found"))).where(_valid(F.col("kind"), F.col("value")))


def _near_words(before: Column, after: Column) -> Column:
    """Up to REACH whole words on either side."""
    left, right = words(before), words(after)
    left = F.when(F.length(before) == CONTEXT_CHARS, F.slice(left, 2, F.greatest(F.size(left) - 1, F.lit(0)))).otherwise(left)
    right = F.when(F.length(after) == CONTEXT_CHARS, F.slice(right, 1, F.greatest(F.size(right) - 1, F.lit(0)))).otherwise(right)
    n = F.least(F.size(left), F.lit(REACH))
    return F.concat(F.slice(left, F.size(left) - n + 1, n), F.slice(right, 1, REACH))


def telling_terms(
    rows: DataFrame, spans: DataFrame, work: Scratch, support: int = SUPPORT, disclosure: float = DISCLOSURE
) -> DataFrame:
    """(entity, term, disclosure) for the terms that tell too much of a protected value."""
    contexts = (
        spans.select("_id", "_key", _entity().alias("entity"), _near_words(F.col("before"), F.col("after")).alias("_near"))
        .select(F.struct("_id", "_key").alias("document"), "entity", "_near", F.xxhash64("_near").alias("context"))
        .distinct()
    )
    kept = F.filter(F.array_distinct("_near"), lambda t: (F.length(t) >= LEAST_TERM) & ~t.rlike("^[0-9]+$"))
    pairs, n_pairs = work.keep_counted(
        contexts.select("document", "entity", "context", F.explode(kept).alias("term"))
        .groupBy("entity", "term")
        .agg(F.count_distinct("document").alias("n_both"), F.count_distinct("context").alias("_contexts"))
        .where(F.col("_contexts") >= support)
        .drop("_contexts"),
        "pairs",
    )
    if n_pairs == 0:
        return pairs.select("entity", "term", F.lit(None).cast("double").alias("disclosure"))
    entities = contexts.groupBy("entity").agg(F.count_distinct("document").alias("n_entity"))
    candidates = work.keep(pairs.select("term").distinct(), "candidates")
    # counted per task before anything is joined: a common term among the candidates costs one row for each task
    counted = rows.select(F.explode(F.array_distinct(words(F.col("_text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    held = counted.join(candidates, "term")
    n = F.lit(float(max(2, rows.count())))
    content = F.log(n / F.col("n_entity"))
    mutual = F.log(F.col("n_both") * n / (F.col("n_entity") * F.col("n_term")))
    told = F.when(content > 0, mutual / content)
    return (
        pairs.join(entities, "entity").join(held, "term").select("entity", "term", told.alias("disclosure")).where(F.col("disclosure") >= disclosure)
    )


def _entity() -> Column:
    return F.concat(F.col("kind"), F.lit(":"), F.lower("value"))


def _term_spans(rows: DataFrame, spans: DataFrame, telling: DataFrame, work: Scratch) -> DataFrame:
    """Whole-word occurrences of telling terms in the documents that hold their value.

    The list of documents is written first, so that Spark knows its size when it plans the join
    with the texts, and moves no text where the list is small.
    """
    wanted = work.keep(
        spans.select("_id", "_key", _entity().alias("entity"))
        .join(telling, "entity")
        .groupBy("_id", "_key")
        .agg(F.array_sort(F.collect_set("term")).alias("_terms"))
        .select(F.col("_id").alias("_doc"), F.col("_key").alias("_other"), "_terms"),
        "holding",
    )
    # terms are letters and digits alone; of two that begin alike the longer is tried first
    longest = F.expr("array_sort(_terms, (a, b) -> CASE WHEN length(a) > length(b) THEN -1 WHEN length(a) < length(b) THEN 1 WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END)")
    pattern = F.concat(F.lit(f"(?i)(?<![{WORD_CHARS}])(?:"), F.array_join(longest, "|"), F.lit(f")(?![{WORD_CHARS}])"))
    meets = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_other"))
    holding = rows.join(wanted, meets).withColumn("_pattern", pattern)
    return _place(holding.select("_id", "_key", _cut(F.col("_text"), "term", F.col("_pattern"), F.lit(True)).alias("_found")))


def spans_of(documents: DataFrame, work: Scratch, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(_id, _key, kind, start, stop, value): base spans, and telling terms that lie outside them."""
    rows = _rows(documents, id_column, text_column)
    base = work.keep(base_spans(rows), "base")
    telling, n = work.keep_counted(telling_terms(rows, base, work), "telling")
    plain = base.select("_id", "_key", "kind", "start", "stop", "value")
    if n == 0:
        return plain
    terms = _term_spans(rows, base, telling, work).select("_id", "_key", "kind", "start", "stop", "value")
    order = Window.partitionBy("_id", "_key").orderBy("start", F.desc("stop"))
    # a term inside a base span begins before an earlier span's end; one that a base span begins in ends after its start
    reach = F.max(F.when(F.col("kind") != "term", F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(F.col("kind") != "term", F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    free = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(ahead, F.col("stop")) >= F.col("stop"))
    both = plain.unionByName(terms).withColumn("_free", free)
    return work.keep(both.where((F.col("kind") != "term") | F.col("_free")).drop("_free"), "spans")


def _rows(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return documents.select(
        F.col(id_column).alias("_id"), text_key(F.col(text_column)).alias("_key"), F.coalesce(F.col(text_column), F.lit("")).alias("_text")
    )


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(kinds, s["order"]), s["start"], s["stop"])
    return F.array_join(F.transform(spans, one), ",")


def report(documents: DataFrame, work: Scratch, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    grouped = (
        spans_of(documents, work, id_column, text_column)
        .groupBy(F.col("_id").alias("_doc"), F.col("_key").alias("_other"))
        .agg(F.array_sort(F.collect_list(F.struct(order.alias("order"), "start", "stop"))).alias("_all"))
    )
    rows = documents.select(F.col(id_column).alias("_id"), text_key(F.col(text_column)).alias("_key"))
    meets = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_other"))
    everything = F.coalesce("_all", F.array().cast("array<struct<order:int,start:bigint,stop:bigint>>"))
    count = lambda k: F.size(F.filter("_spans", lambda s: s["order"] == k)).cast("long")
    base = F.filter("_spans", lambda s: s["order"] < len(PATTERNS))
    return (
        rows.join(grouped, meets, "left")
        .withColumn("_spans", everything)
        .select(
            F.col("_id").alias(id_column),
            *(count(k).alias(f"n_{name}") for k, name in enumerate(PATTERNS)),
            F.sha2(_listed(base), 256).alias("base_sha256"),
            _listed(F.col("_spans")).alias("spans"),
        )
    )


def sanitise(documents: DataFrame, work: Scratch, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``documents`` with every span replaced by its kind in brackets; all columns are kept."""
    spans = spans_of(documents, work, id_column, text_column)
    order = Window.partitionBy("_id", "_key").orderBy("start", F.desc("stop"))
    covered = F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    apart = (  # what an earlier span covers already is left out
        spans.select("_id", "_key", "kind", F.greatest("start", covered).alias("start"), "stop")
        .where("start < stop")
        .groupBy(F.col("_id").alias("_doc"), F.col("_key").alias("_other"))
        .agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind"))).alias("_spans"))
    )
    text = F.col(text_column)
    last = F.size("_spans")
    piece = lambda i: F.substring(
        text, _stop(i - 1) + 1, F.when(i < last, F.get("_spans", i)["start"]).otherwise(F.length(text)).cast("int") - _stop(i - 1)
    )
    mark = lambda i: F.when(i < last, F.concat(F.lit("["), F.upper(F.get("_spans", i)["kind"]), F.lit("]"))).otherwise("")
    rebuilt = F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(piece(i), mark(i))), "")
    meets = F.col(id_column).eqNullSafe(F.col("_doc")) & (F.col("_text_key") == F.col("_other"))
    return (
        documents.withColumn("_text_key", text_key(text))
        .join(apart, meets, "left")
        .withColumn(text_column, F.when(F.col("_spans").isNull(), text).otherwise(rebuilt))
        .select(*(F.col(f"`{c}`") for c in documents.columns))
    )


def _stop(i: Column) -> Column:
    return F.when(i >= 0, F.get("_spans", i)["stop"]).otherwise(0).cast("int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), scratch(spark, "sanitise"))
