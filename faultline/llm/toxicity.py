"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Learning. At most ``EXAMPLES`` labelled documents of the learning folds, those with the least
hashes, are the examples. Their words and word beginnings are counted by label; a term enters the
vocabulary if it speaks for the label with a log-likelihood ratio that chance would not give to
any of the terms tried, and at most ``TERMS`` of the strongest do. Examples become TF-IDF vectors
of unit length over that vocabulary.

Index. The postings of a term are cut into blocks of ``BLOCK`` neighbouring examples, and the
largest weight of each term and block is kept. A search adds up these maxima to a bound for each
block, scores blocks from the highest bound down, and stops when the ``K``-th best cosine found is
above the next bound: the neighbours are exactly those of a full scan.

Scores. Examples with equal vectors are one neighbour, whose label is their mean. Neighbours vote with the square of their cosine, together with the base rate as a vote of
weight ``DOUBT``. An isotonic fit on the examples, each scored without itself, turns votes into
probabilities. The nearest examples are returned as evidence.

All that is collected or broadcast is bounded by these parameters; every text is scored whole.

Defined results: null is as empty; texts without vocabulary terms get the probability of such
texts. Labels that are null, or of a null id, are ignored; an id with several labels is toxic if
one says so. Without labelled rows every score is 0. A null id is not held out and not learned
from. Every input row gives one row; columns other than id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import scratch, ship, table, text_key
from faultline.session import Scratch

EXAMPLES, TERMS, BLOCK, K, DOUBT = 16_384, 4_096, 64, 16, 2.0
FOLDS = 5
#: Beginnings of words that are terms of their own, in characters.
STEMS = (3, 4, 5, 6, 7, 8)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words whose terms a worker remembers.
MEMO_WORDS = 200_000
EVIDENCE = 3
#: Blocks scored one by one before whole posting lists are taken.
FIRST_BLOCKS = 8


def word_terms(word: str) -> tuple[str, ...]:
    """The word, marked as whole, and its beginnings."""
    return (f"={word}", *(word[:n] for n in STEMS if len(word) >= n))


def text_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def vector_bytes(terms: np.ndarray, weights: np.ndarray) -> bytes:
    return terms.tobytes() + weights.tobytes()


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with each term, by label, added up per batch."""
    for frame in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(frame["_text"], frame["_toxic"]):
            counts[int(toxic)].update({t for w in set(text_words(text)) for t in word_terms(w)})
        terms = list(counts[0].keys() | counts[1].keys())
        yield pd.DataFrame({"term": terms, "clean": [counts[0][t] for t in terms], "toxic": [counts[1][t] for t in terms]})


class Model:
    """Vocabulary, block-max index and calibration; plain arrays of bounded size."""

    def __init__(self, terms: list[str], idf: np.ndarray, n_examples: int, base_rate: float):
        self.ids = {t: i for i, t in enumerate(terms)}
        self.idf, self.n_examples, self.base_rate = idf, n_examples, base_rate
        self.marks, self.probabilities = np.zeros(1), np.array([base_rate])
        self.memo: dict[str, tuple[int, ...]] = {}
        self.build([], [], [])

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and unit-length TF-IDF weights of a text."""
        counts: Counter = Counter()
        for word, n in Counter(text_words(text)).items():
            found = self.memo.get(word)
            if found is None:
                found = tuple(self.ids[t] for t in word_terms(word) if t in self.ids)
                if len(self.memo) < MEMO_WORDS:
                    self.memo[word] = found
            for t in found:
                counts[t] += n
        return self.weigh(counts)

    def weigh(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array(sorted(counts), np.int64)
        weights = np.array([1 + math.log(counts[t]) for t in terms.tolist()]) * self.idf[terms] if len(terms) else np.zeros(0)
        return terms, weights / np.linalg.norm(weights) if len(terms) else weights

    def build(self, keys: list, labels: list[int], vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Index examples. Equal vectors are one entry with their counts, so copies vote once.

        Entries that share their heaviest term lie side by side, so blocks differ.
        """
        entries: dict[bytes, list[int]] = {}
        for i in sorted(range(len(keys)), key=lambda i: keys[i]):
            entries.setdefault(vector_bytes(*vectors[i]), []).append(i)
        heaviest = {k: int(vectors[m[0]][0][np.argmax(vectors[m[0]][1])]) for k, m in entries.items()}
        order = sorted(entries, key=lambda k: (heaviest[k], keys[entries[k][0]]))
        self.place = {k: at for at, k in enumerate(order)}
        self.keys = [keys[entries[k][0]] for k in order]
        self.counts = np.array([len(entries[k]) for k in order], float)
        self.toxic = np.array([sum(labels[i] for i in entries[k]) for k in order], float)
        n_terms, self.n_blocks = len(self.ids), -(-len(order) // BLOCK)
        rows = [(t, at, w) for at, k in enumerate(order) for t, w in zip(*(x.tolist() for x in vectors[entries[k][0]]))]
        rows.sort()
        self.post_place = np.array([r[1] for r in rows], np.int64)
        self.post_weight = np.array([r[2] for r in rows], float)
        cell = np.array([r[0] for r in rows], np.int64) * self.n_blocks + self.post_place // BLOCK
        self.cells = np.searchsorted(cell, np.arange(n_terms * self.n_blocks + 1))
        self.maxima = np.zeros(n_terms * self.n_blocks)
        np.maximum.at(self.maxima, cell, self.post_weight)
        self.maxima = self.maxima.reshape(n_terms, self.n_blocks)

    def neighbours(self, terms: np.ndarray, weights: np.ndarray, without: int = -1) -> list[tuple[float, int]]:
        """(cosine, place) of the K nearest entries, nearest first, ties to the lower place."""
        if not len(terms) or not self.n_blocks:
            return []
        bounds = weights @ self.maxima[terms]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        best: list[tuple[float, int]] = []
        for n, block in enumerate(order.tolist()):
            least = best[-1][0] if len(best) == K else 0.0
            if least > bounds[block] * (1 + 1e-12):
                break
            if n >= FIRST_BLOCKS and (bounds[order[n:]] * (1 + 1e-12) >= least).sum() > FIRST_BLOCKS:
                # many blocks are left: whole posting lists cost less than their cells one by one
                return self._nearest(self._scores(terms, weights), without)
            first = block * BLOCK
            scores = np.zeros(BLOCK)
            for t, w in zip(terms.tolist(), weights.tolist()):
                a, b = self.cells[t * self.n_blocks + block], self.cells[t * self.n_blocks + block + 1]
                if a < b:
                    scores[self.post_place[a:b] - first] += w * self.post_weight[a:b]
            best = sorted([*best, *self._nearest(scores, without - first, first)], key=lambda x: (-x[0], x[1]))[:K]
        return best

    def _scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        scores = np.zeros(len(self.keys))
        for t, w in zip(terms.tolist(), weights.tolist()):
            a, b = self.cells[t * self.n_blocks], self.cells[(t + 1) * self.n_blocks]
            scores[self.post_place[a:b]] += w * self.post_weight[a:b]
        return scores

    @staticmethod
    def _nearest(scores: np.ndarray, without: int, first: int = 0) -> list[tuple[float, int]]:
        if 0 <= without < len(scores):
            scores[without] = 0.0
        least = np.partition(scores, len(scores) - K)[len(scores) - K] if len(scores) > K else 0.0
        places = np.flatnonzero((scores >= least) & (scores > 0))
        places = places[np.argsort(-scores[places], kind="stable")][:K]
        return [(s, first + p) for s, p in zip(scores[places].tolist(), places.tolist())]

    def vote(self, near: list[tuple[float, int]], own: tuple[int, int] | None = None) -> float:
        """Share of toxicity near by; ``own`` (place, label) takes one example out of its entry."""
        mass = toxic = 0.0
        for s, p in near:
            n, y = self.counts[p], self.toxic[p]
            if own and own[0] == p:
                n, y = n - 1, y - own[1]
            mass += s * s
            toxic += s * s * y / n
        return (toxic + DOUBT * self.base_rate) / (mass + DOUBT)

    def vote_without(self, terms: np.ndarray, weights: np.ndarray, label: int) -> float:
        """The vote on an example by all the others."""
        place = self.place[vector_bytes(terms, weights)]
        near = self.neighbours(terms, weights, without=place if self.counts[place] == 1 else -1)
        return self.vote(near, (place, label))

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Isotonic fit of label on vote by pooling adjacent violators."""
        pools: list[list[float]] = []  # [sum of votes, sum of labels, count]
        for v in np.unique(votes):
            mine = labels[votes == v]
            pools.append([v * len(mine), float(mine.sum()), float(len(mine))])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        self.marks = np.array([p[0] / p[2] for p in pools])
        self.probabilities = np.array([p[1] / p[2] for p in pools])

    def score(self, near: list[tuple[float, int]]) -> float:
        return float(np.interp(self.vote(near), self.marks, self.probabilities))


def learn(documents: DataFrame, labels: DataFrame, learns: Column, work: Scratch, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Fit on the labelled documents for whose id ``learns`` holds."""
    spark = documents.sparkSession
    ship(spark)
    labelled = (
        labels.where(F.col(id_column).isNotNull() & F.col("toxic").isNotNull() & learns)
        .groupBy(F.col(id_column).alias("_label_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
        .orderBy(F.xxhash64("_label_id"), "_label_id")
        .limit(EXAMPLES)
    )
    # at most EXAMPLES ids are broadcast
    rows = documents.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).join(
        F.broadcast(labelled), F.col("_id") == F.col("_label_id")
    )
    examples, n = work.keep_counted(
        rows.withColumn("_key", text_key(F.col("_text")))
        .dropDuplicates(["_id", "_key"])
        .orderBy(F.xxhash64("_id", "_key"), "_id")
        .limit(EXAMPLES)
        .select("_id", "_key", "_text", F.coalesce("_toxic", F.lit(0)).alias("_toxic")),
        "examples",
    )
    if n == 0:
        return Model([], np.zeros(0), 0, 0.0)
    n_toxic = examples.agg(F.sum("_toxic")).first()[0]
    counted, n_terms = work.keep_counted(
        examples.select("_text", "_toxic")
        .mapInPandas(_count_terms, "term string, clean long, toxic long")
        .groupBy("term")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where("clean + toxic > 1"),
        "terms",
    )
    chosen = _speaking(counted, n, n_toxic, n_terms)
    found = chosen.orderBy(F.desc("ratio"), "term").limit(TERMS).collect()  # at most TERMS rows
    terms = [r.term for r in found]
    idf = np.log1p(n / np.array([r.clean + r.toxic for r in found], float))
    model = Model(terms, idf, n, n_toxic / n)

    shared = spark.sparkContext.broadcast(model)
    kind = "key string, toxic int, terms array<long>, weights array<double>"

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for frame in batches:
            made = [own.vector(t) for t in frame["_text"]]
            yield pd.DataFrame({"key": frame["key"], "toxic": frame["_toxic"], "terms": [t for t, _ in made], "weights": [w for _, w in made]})

    keyed = examples.select(F.concat_ws(":", "_id", "_key").alias("key"), "_toxic", "_text")
    made = sorted(keyed.mapInPandas(vectors, kind).collect())  # at most EXAMPLES rows of vocabulary terms
    full = [(r.key, r.toxic, (np.array(r.terms, np.int64), np.array(r.weights))) for r in made if r.terms]
    model.build([k for k, _, _ in full], [y for _, y, _ in full], [v for _, _, v in full])
    _calibrate(model, full, len(made) - len(full), sum(r.toxic for r in made if not r.terms), spark)
    return model


def _speaking(counted: DataFrame, n: int, n_toxic: int, n_terms: int) -> DataFrame:
    """Terms that speak for the label: G-test of term against label, beyond the best of ``n_terms`` by chance."""
    held = F.col("clean") + F.col("toxic")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    rate = n_toxic / n
    ratio = 2 * (
        part(F.col("toxic"), held * rate)
        + part(F.col("clean"), held * (1 - rate))
        + part(n_toxic - F.col("toxic"), (n - held) * rate)
        + part((n - n_toxic) - F.col("clean"), (n - held) * (1 - rate))
    )
    limit = 2 * math.log(max(n_terms, 2)) + 2
    return counted.withColumn("ratio", ratio).where((F.col("ratio") >= limit) & (F.col("toxic") > held * rate))


def _calibrate(model: Model, full: list, n_bare: int, n_bare_toxic: int, spark: SparkSession) -> None:
    """Votes of every example without itself, made by tasks; then the isotonic fit."""
    shared = spark.sparkContext.broadcast((model, full))

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, rows = shared.value
        for frame in batches:
            mine = [rows[i] for i in frame["id"]]
            yield pd.DataFrame({"vote": [own.vote_without(*v, y) for _, y, v in mine], "toxic": [y for _, y, _ in mine]})

    scored = spark.range(len(full)).mapInPandas(votes, "vote double, toxic int").collect() if full else []
    bare = [(model.vote([]), 1)] * n_bare_toxic + [(model.vote([]), 0)] * (n_bare - n_bare_toxic)
    pairs = [(r.vote, r.toxic) for r in scored] + bare
    model.calibrate(np.round([v for v, _ in pairs], 6), np.array([y for _, y in pairs], float))
    shared.unpersist()


def score_documents(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All columns of ``documents`` with ``_scored``: score and evidence (key and cosine of the nearest examples)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("evidence", T.StringType())])

    @F.pandas_udf(kind)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            out, seen = [], {}  # copies, and texts with the same few terms, share a result
            for text in texts:
                vector = own.vector(text)
                key = vector_bytes(*vector)
                if key not in seen:
                    near = own.neighbours(*vector)
                    shown = " ".join(f"{own.keys[p].split(':')[0]}:{s:.3f}" for s, p in near[:EVIDENCE])
                    seen[key] = (own.score(near), shown)
                out.append(seen[key])
            yield pd.DataFrame(out, columns=["score", "evidence"])

    return documents.withColumn("_scored", scored(F.col(text_column)))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(documents, labels, ~held_out(F.col("doc_id")), scratch(spark, "toxicity"))
    scored = score_documents(documents.select("doc_id", "text"), model)
    score = F.col("_scored.score")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        score.alias("score"),
        F.when(score >= 0.5, 1).otherwise(0).alias("predicted"),
        F.col("_scored.evidence").alias("evidence"),
    )
