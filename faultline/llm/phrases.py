"""Collocations by language from weighted acyclic automata.

Every word of a piece starts one window: itself and up to three words after it. The number of
occurrences of a phrase is then the number of windows that begin with it, the sum of the weights
over a prefix range. Each task sorts the windows of its texts in runs of bounded size and builds
from them transducers (``transducer.py``), one for each range of windows; the ranges have equal
borders in all tasks, so the transducers of one range meet, are united and their weights added.
Phrases at the edges of a range are added over ranges before any threshold applies. The frequent
phrases become transducers again, and the parts of candidates are looked up by composing a
range's requests with its transducer.

Borders are whole windows from a bounded sample of the texts (``SAMPLE_TEXTS``); they decide which
task does what, never a result. So a word, or a phrase, with a third of all windows spreads over
many ranges.

Defined results: a null text is empty, a null language is ``und``. Equal rows count as often as
they occur. Texts without words give nothing but may not be dropped otherwise. Columns other than
the two read are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.common import LOWER, UPPER, scratch, ship, table
from faultline.llm.transducer import Transducer, cut_points, summed

WORDS, LEAST, TOP = 4, 30, 2000
UNKNOWN = "und"
#: A longer phrase hides what it contains from this share of its occurrences on, in percent.
HIDES = 80
#: Windows of one run, and bytes of text split at a time, within a task.
RUN, TEXT_BYTES = 1 << 20, 1 << 21
#: Bytes of text whose windows one range holds on average.
RANGE_BYTES = 1 << 22
SAMPLE_TEXTS, WINDOWS_A_TEXT, BORDER_BYTES = 1024, 256, 32

#: What ends a piece, and the mark put in its place, which no word can be.
PIECE_ENDS, MARK = b".,;:!?\x0a\x0b\x0c\x0d", b"."
_PLAIN = bytes.maketrans((UPPER.encode() + b"\t" + PIECE_ENDS), (LOWER.encode() + b" " + MARK * len(PIECE_ENDS)))


def marked(texts: pa.Array) -> pa.Array:
    """A-Z lower-cased, tabs as spaces, and every end of a piece a word of its own."""
    filled = pc.fill_null(texts, "").cast(pa.large_string())
    _, at, data = filled.buffers()
    ends = np.frombuffer(at, np.int64, len(filled) + 1, 8 * filled.offset) if len(filled) else np.zeros(1, np.int64)
    raw = data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if data is not None else b""
    # single bytes are exchanged, so the texts keep their places in the buffer
    plain = pa.Array.from_buffers(pa.large_string(), len(filled), [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(raw.translate(_PLAIN))])
    return pc.replace_substring(plain, MARK.decode(), f" {MARK.decode()} ")


def windows(langs: pa.Array, texts: pa.Array, ids: dict[bytes, int]) -> np.ndarray:
    """Rows (language, word, up to three more or -1), as numbers that ``ids`` keeps by label."""
    split = pc.ascii_split_whitespace(marked(texts))
    coded = pc.cast(split.flatten(), pa.large_binary()).dictionary_encode()
    known = [ids.setdefault(word, len(ids)) if word not in (b"", MARK) else (-1 if word else -2) for word in coded.dictionary.to_pylist()]
    tokens = np.array(known, np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
    lengths = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.array([ids.setdefault(lang.encode(), len(ids)) for lang in langs.to_pylist()], np.int64)
    # the end of a text ends its last piece
    ends = np.cumsum(lengths)
    tokens, of = np.insert(tokens, ends, -1), np.repeat(of, lengths + 1)
    of, tokens = of[tokens != -2], tokens[tokens != -2]
    rows = np.full((len(tokens), 1 + WORDS), -1, np.int32)
    rows[:, 0], rows[:, 1] = of, tokens
    for k in range(1, WORDS):
        last = max(0, len(tokens) - k)
        rows[:last, 1 + k] = np.where(rows[:last, k] >= 0, tokens[k:], -1)
    return rows[tokens >= 0]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``TEXT_BYTES`` of text, or one text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TEXT_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def sorted_run(rows: np.ndarray, counts: np.ndarray, ids: dict[bytes, int]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(labels, rows, counts): distinct rows in sorted order, their ids in the order of the labels."""
    labels = sorted(ids)
    place = np.empty(len(labels) + 1, np.int32)
    place[[ids[word] for word in labels]] = np.arange(len(labels))
    place[-1] = -1
    return labels, *summed(place[rows], counts)


def pieces(labels: list[bytes], rows: np.ndarray, counts: np.ndarray, borders: list[tuple[bytes, ...]]) -> Iterator[tuple[int, bytes]]:
    """(range, transducer) of the sorted rows between each two borders."""
    cuts = [0, *cut_points(labels, rows, borders), len(rows)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            held = np.zeros(len(labels) + 1, bool)  # the last place is for -1
            held[rows[a:b]] = True
            held[-1] = False
            place = np.cumsum(held, dtype=np.int32) - 1
            place[-1] = -1
            yield k, Transducer.build([labels[i] for i in np.flatnonzero(held)], place[rows[a:b]], counts[a:b]).dump()


def _shards(borders: list[tuple[bytes, ...]]):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[bytes, int] = {}
        held: list[np.ndarray] = []

        def run() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            found = list(pieces(*sorted_run(rows, np.ones(len(rows), np.int64), ids), borders))
            held.clear()
            ids.clear()
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())], ["range", "part"])

        for batch in batches:
            for part in slices(batch):
                held.append(windows(part.column(0), part.column(1), ids))
                if sum(map(len, held)) >= RUN:
                    yield from run()
        if held:
            yield from run()

    return shards


def _samples(every: int):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids: dict[bytes, int] = {}
                rows = windows(batch.column(0).slice(at, 1), batch.column(1).slice(at, 1), ids)
                step = max(every, -(-len(rows) // WINDOWS_A_TEXT))
                labels = [word[:BORDER_BYTES] for word in ids]
                out = [[labels[i] for i in row if i >= 0] for row in rows[(at * 7) % step :: step].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.binary()))], ["window"])

    return sample


def borders_of(docs: DataFrame) -> list[tuple[bytes, ...]]:
    """Windows that cut all windows into ranges of about equal size; not quite one for every ``RANGE_BYTES``."""
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("bytes")).first()
    ranges = -(-size.bytes // RANGE_BYTES)
    if ranges <= 1:
        return []
    share = F.pmod(F.xxhash64("_text"), F.lit(1 << 30)) / (1 << 30) < SAMPLE_TEXTS / size.n
    every = max(1, int(size.bytes / size.n * min(SAMPLE_TEXTS, size.n) / 6 / (SAMPLE_TEXTS * 64)))
    seen = docs.where(share).mapInArrow(_samples(every), "window array<binary>").collect()  # bounded: texts and windows a text
    found = sorted(tuple(bytes(word) for word in row["window"]) for row in seen)
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []


def _spell(labels: list[bytes], rows: np.ndarray) -> tuple[list[str], list[str]]:
    words = {i: labels[i].decode() for i in np.unique(rows).tolist()}
    listed = rows.tolist()
    return [words[row[0]] for row in listed], [" ".join(words[i] for i in row[1:]) for row in listed]


def _unite(least: int):
    def unite(frame: pd.DataFrame) -> pd.DataFrame:
        whole = Transducer.union([Transducer.load(bytes(part)) for part in frame["part"]], 1 + WORDS)
        out = []
        for rows, weights in whole.prefixes(1 + WORDS):
            if len(rows):
                kept = weights >= least
                kept[[0, -1]] = True  # phrases at the edges may go on in the ranges beside
                langs, phrases = _spell(whole.labels, rows[kept])
                out.append(pd.DataFrame({"lang": langs, "phrase": phrases, "size": rows.shape[1] - 1, "a": weights[kept]}))
        return pd.concat(out)

    return unite


def _key(lang: str, phrase: str) -> tuple[bytes, ...]:
    return (lang.encode(), *phrase.encode().split(b" ")) if phrase else (lang.encode(),)


def _homes(borders: list[tuple[bytes, ...]]):
    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield frame.assign(range=[bisect_right(borders, _key(*pair)) for pair in zip(frame["lang"], frame["phrase"])])

    return homes


def _frequent(frame: pd.DataFrame) -> pd.DataFrame:
    """The transducer of a range's frequent phrases; a phrase's own count is what its longer ones here leave."""
    total = {_key(lang, phrase): int(a) for lang, phrase, a in zip(frame["lang"], frame["phrase"], frame["a"])}
    own = dict(total)
    for key, a in total.items():
        if key[:-1] in own:
            own[key[:-1]] -= a
    keys = sorted(total)
    labels = sorted({word for key in keys for word in key})
    place = {word: i for i, word in enumerate(labels)}
    rows = np.full((len(keys), 1 + WORDS), -1, np.int32)
    for row, key in zip(rows, keys):
        row[: len(key)] = [place[word] for word in key]
    made = Transducer.build(labels, rows, np.array([own[key] for key in keys], np.int64))
    return pd.DataFrame({"range": [frame["range"].iloc[0]], "part": [made.dump()]})


def _look_up(parts: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    keys = [_key(*pair) for pair in zip(asked["lang"], asked["phrase"])]
    found = Transducer.load(bytes(parts["part"].iloc[0])).compose(keys) if len(parts) else [0] * len(keys)
    return pd.DataFrame({"lang": asked["lang"], "phrase": asked["phrase"], "f": found})


def _join(words: str, start: str, size: str) -> str:
    return f"array_join(slice({words}, {start}, {size}), ' ')"


def collocations(
    documents: DataFrame, least: int = LEAST, top: int = TOP, text_column: str = "text", lang_column: str = "lang"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to four words."""
    spark = documents.sparkSession
    ship(spark)
    work = scratch(spark, "phrases")
    docs = documents.select(F.coalesce(F.col(lang_column), F.lit(UNKNOWN)).alias("_lang"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    borders = borders_of(docs)
    shards = docs.mapInArrow(_shards(borders), "range int, part binary")
    counted = shards.groupBy("range").applyInPandas(_unite(least), "lang string, phrase string, size int, a long")
    totals = work.keep(counted.groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a")).where((F.col("a") >= least) | (F.col("size") == 0)), "totals")
    phrases = totals.where("size > 0")

    homed = phrases.select("lang", "phrase", "a").mapInPandas(_homes(borders), "lang string, phrase string, a long, range int")
    known = work.keep(homed.groupBy("range").applyInPandas(_frequent, "range int, part binary"), "known")
    candidates = phrases.where("size > 1").withColumn("words", F.split("phrase", " "))
    cuts = work.keep(
        candidates.select("lang", "phrase", "a", "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")).select(
            "lang", "phrase", "a", "cut", F.expr(_join("words", "1", "cut")).alias("head"), F.expr(_join("words", "cut + 1", "size - cut")).alias("tail")
        ),
        "cuts",
    )
    asked = cuts.select("lang", F.explode(F.array("head", "tail")).alias("phrase")).distinct()
    asked = asked.mapInPandas(_homes(borders), "lang string, phrase string, range int")
    found = work.keep(known.groupBy("range").cogroup(asked.groupBy("range")).applyInPandas(_look_up, "lang string, phrase string, f long"), "found")
    left = found.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    right = found.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    score = F.expr("cast((cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    scored = cuts.join(left, ["lang", "head"]).join(right, ["lang", "tail"]).withColumn("score", score)
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_low"))

    inside = candidates.where("size > 2").select(
        "lang", F.col("a").alias("longer"), "words", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("part")
    ).select("lang", "longer", "words", "part", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("part") + 1)).alias("start"))
    inside = inside.select("lang", F.expr(_join("words", "start", "part")).alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    hidden = F.coalesce(F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * HIDES, F.lit(False))
    kept = lowest.join(inside, ["lang", "phrase"], "left").where(~hidden).select("lang", "phrase", "a", "_low.l", "_low.r", "_low.score")

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    words = totals.where("size = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH pieces AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]'), lambda w: w <> '') AS words
    FROM (SELECT coalesce(lang, 'und') AS lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\n-\\r]')) AS piece FROM documents)),
grams AS (
    SELECT lang, k, array_to_string(words[start:start + k - 1], ' ') AS phrase
    FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS start FROM pieces, (SELECT unnest(range(1, 5)) AS k) WHERE len(words) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND a >= {LEAST}),
cuts AS (SELECT lang, phrase, a, words, k, unnest(range(1, k)) AS cut FROM candidates),
scored AS (
    SELECT c.lang, c.phrase, c.a, c.cut, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a) AS score
    FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1:c.cut], ' ')
        JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[c.cut + 1:c.k], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
    SELECT lang, array_to_string(words[start:start + part - 1], ' ') AS phrase, max(a) AS longer
    FROM (SELECT lang, words, a, part, unnest(range(1, k - part + 2)) AS start
        FROM (SELECT lang, words, a, k, unnest(range(2, k)) AS part FROM candidates)) GROUP BY ALL),
kept AS (
    SELECT o.* FROM lowest o LEFT JOIN inside i ON i.lang = o.lang AND i.phrase = o.phrase
    WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < {HIDES}::HUGEINT * o.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= {TOP}
"""
