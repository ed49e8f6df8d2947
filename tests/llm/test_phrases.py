import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.llm import phrases
from faultline.llm.transducer import Transducer, summed
from tests.llm.conftest import CLASHING, DOCUMENT


def grams(rows, top=4):
    """{lang: Counter of word tuples of 1..top}, occurrences within pieces."""
    out = defaultdict(Counter)
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, top + 1):
                for i in range(len(words) - k + 1):
                    out["und" if lang is None else lang][tuple(words[i : i + k])] += 1
    return out


def brute(rows, least=30, top=2000):
    out = []
    for lang, f in grams(rows).items():
        found = []
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in held.items():
            score, cut = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            hidden = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in held.items())
            if not hidden:
                found.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        n = sum(a for p, a in f.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def run(spark, rows, extra=(), **kw):
    made = spark.createDataFrame([(i, t, lang, "s", 0) for i, (lang, t) in enumerate(rows)], DOCUMENT)
    for name in extra:
        made = made.withColumn(name, F.lit("x y z"))
    return sorted(tuple(r) for r in phrases.collocations(made, **kw).collect())


def texts(n, seed=1):
    rng = random.Random(seed)
    common = ["the", "of", "New", "York", "city", "É", "a\x00b", "x\x1cy"]
    out = []
    for _ in range(n):
        words = [rng.choice(common) if rng.random() < 0.7 else f"w{rng.randrange(300)}" for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" "] * 20 + ["  ", "\t", ". ", ",", "\n", "\x0b"]) for w in words)
        out.append((rng.choice(["en", "en", "fr", None, ""]), text))
    return out


@pytest.mark.parametrize("least,top", [(30, 2000), (3, 50)])
def test_against_brute_force(spark, least, top):
    rows = texts(1200)
    got = run(spark, rows, least=least, top=top)
    assert got == brute(rows, least, top) and len(got) > 20


def test_many_ranges_with_one_hot_phrase(spark, monkeypatch):
    """Borders inside the windows of one word, small runs: the sums over ranges are whole."""
    rows = texts(200, 2) + [("en", "new york city " * 30 + "new york times")] * 40 + [("en", "new " * 500)]
    monkeypatch.setattr(phrases, "RANGE_BYTES", 1 << 10)
    monkeypatch.setattr(phrases, "RUN", 700)
    docs = spark.createDataFrame([(t, lang or "und") for lang, t in rows], "_text string, _lang string").select("_lang", "_text")
    assert len(phrases.borders_of(docs)) > 10
    assert run(spark, rows, least=5) == brute(rows, 5)


def test_odd_rows(spark):
    rows = [("en", None), ("en", ""), (None, " \t"), ("en", ".,;"), ("en", "one two " * 20_000), ("en", "Straße " + "z" * 100_000), ("und", "a b"), (None, "a b")] + [("xx", "a b")] * 30
    got = run(spark, rows, extra=(*CLASHING, "_lang", "phrase", "words", "range", "part", "size", "l", "r", "n"), least=2)
    assert got == brute(rows, 2)
    assert [r for r in got if r[0] == "und"] == [("und", 1, "a b", 2, 2, 2, 4, 1_000_000)]


def test_empty(spark, empty):
    assert phrases.collocations(empty).count() == 0
    assert run(spark, [("en", None), ("en", ". .")]) == []


@pytest.fixture(scope="module")
def counted():
    langs = ["en", "fr"] * 30
    rows = [(lang, text) for lang, (_, text) in zip(langs, texts(60, 3))]
    ids = {}
    found = phrases.windows(pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), ids)
    want = {(lang.encode(), *(w.encode() for w in p)): a for lang, f in grams(rows).items() for p, a in f.items()}
    return phrases.sorted_run(found, np.ones(len(found), np.int64), ids), want


def test_prefix_sums_are_phrase_counts(counted):
    (labels, rows, counts), want = counted
    made = Transducer.load(Transducer.build(labels, rows, counts).dump())
    got = {tuple(labels[i] for i in row): w for found, weights in made.prefixes(5) for row, w in zip(found.tolist(), weights.tolist())}
    assert {k: v for k, v in got.items() if len(k) > 1} == want
    assert [made.compose([k])[0] for k in want][:50] == list(want.values())[:50]
    assert made.compose([(b"en", b"none"), (b"no",)]) == [0, 0] and made.compose([]) == []


def test_equal_tails_are_one_state():
    labels = [bytes([97 + i]) for i in range(6)]
    rows = np.array([[0, 2, 3, 4], [1, 2, 3, 4], [5, 2, 3, -1]], np.int32)
    made = Transducer.build(labels, rows, np.array([7, 7, 1]))
    # the start, a shared chain of three states for two prefixes, one more chain of two, and the end
    assert len(made.first) - 1 == 7
    back, counts = made.paths(4)
    assert {tuple(r): c for r, c in zip(back.tolist(), counts.tolist())} == {(0, 2, 3, 4): 7, (1, 2, 3, 4): 7, (5, 2, 3, -1): 1}


def test_union_adds_weights_over_pieces(counted):
    (labels, rows, counts), want = counted
    borders = [(b"en", b"of"), (b"en", b"the", b"w"), (b"fr",)]
    parts = [Transducer.load(data) for _, data in phrases.pieces(labels, rows, counts, borders)]
    assert len(parts) > 2
    whole = Transducer.union(parts + parts, 5)
    assert whole.compose(list(want)) == [2 * a for a in want.values()]
    found, sums = summed(*whole.paths(5))
    assert len(found) == len(rows) and sorted(sums.tolist()) == sorted((2 * counts).tolist())


def test_slices_of_a_batch_read_like_the_whole():
    rows = [None if i % 7 == 0 else f"Wörter ÀB{i} {'é' * i}, x\ty" for i in range(300)]
    whole = phrases.marked(pa.array(rows)).to_pylist()
    parts = [w for i in range(0, 300, 37) for w in phrases.marked(pa.array(rows).slice(i, 37)).to_pylist()]
    assert parts == whole and whole[3] == "wörter Àb3 ééé .  x y" and whole[0] == ""
