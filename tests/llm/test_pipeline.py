"""Each stage on its own input, against a brute-force version of its decision."""

import hashlib
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline as P
from faultline.llm import toxicity
from faultline.session import Scratch

from .conftest import CLASHING, documents
from .test_decontaminate import brute as passages
from .test_near_copies import brute_groups
from .test_sanitise import PLAIN, valid

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Inputs and outputs of all stages over the smallest tables."""
    work, docs, out = Scratch(spark, "pipeline-test"), spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in P.STAGES:
        after = work.keep(stage(spark, docs, SMALL), name)
        out.append((docs, after))
        docs = after
    return out


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.schema == before.schema


def test_toxic_documents_go(spark, stages, scratch):
    before, after = stages[0]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.learn(before, labels, ~toxicity.held_out(F.col("doc_id")), scratch)
    rejected = {i for i, t in texts(before).items() if model.score(model.neighbours(*model.vector(t))) >= 0.5}
    assert texts(before).keys() - texts(after).keys() == rejected


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    held = texts(before)
    ids = sorted(held)
    roots = brute_groups([held[i] for i in ids])
    assert set(texts(after)) == {ids[r] for r in roots}
    assert len(set(roots)) < len(ids)


def test_contaminated_documents_go(spark, stages):
    before, after = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bad = {i for i, _, n_hit, _ in passages(list(texts(before).items()), items) if n_hit}
    assert bad and set(texts(after)) == set(texts(before)) - bad


def test_personal_data_are_masked(stages):
    before, after = stages[3]
    masked = texts(after)
    assert set(masked) == set(texts(before))
    for i, text in texts(before).items():
        spans = sorted((m.start(), -m.end(), k) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m[0]))
        out, at = [], 0
        for start, stop, kind in spans:
            start, stop = max(start, at), -stop
            if start < stop:
                out += [text[at:start], f"[{kind.upper()}]"]
                at = stop
        assert masked[i] == "".join([*out, (text or "")[at:]])
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_ids_and_decoded_texts(stages):
    before, after = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in after.collect()}
    for i, text in texts(before).items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_is_the_stages(spark, stages):
    run = __spark_entry__.queries()["pipeline"](spark, SMALL)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_odd_rows(spark, odd_rows):
    names = tuple(dict.fromkeys((*CLASHING, "_scored", "_spans", "_doc", "_other", "_text_key", "_group", "kept_0", "a.b")))
    docs = documents(spark, [*odd_rows, (8, "mail a@b.cd now please"), (9, "mail a@b.cd now please")], names)
    columns = docs.columns
    for _, stage in P.STAGES[:-1]:
        docs = Scratch(spark, "odd").keep(stage(spark, docs, SMALL), "out")
        assert docs.columns == columns
    assert all(r["_spans"] == r["_key"] == r["a.b"] for r in docs.collect())
    kept = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    assert (8, "mail [EMAIL] now please") in kept and all(i != 9 for i, _ in kept)
    assert [t for i, t in kept if i == 1] == ["another text under one id", "plain text of a few words"]
    assert sum(t is None or not t.strip("\x00\x1f 　é") for _, t in kept) == 2  # one of the empty ones, and the odd word
    nothing = documents(spark, [])
    for _, stage in P.STAGES:
        nothing_after = stage(spark, nothing, SMALL)
        assert nothing_after.count() == 0
        nothing = documents(spark, [])


def test_near_duplicates_come_through_the_fingerprint_operator(spark, monkeypatch):
    asked = []
    operator = P.simhash.near_duplicates
    monkeypatch.setattr(P.simhash, "near_duplicates", lambda *a, **k: asked.append(k) or operator(*a, **k))
    docs = documents(spark, [(5, "a text that comes twice in all"), (3, "a text that comes twice in all"), (9, "nothing of the kind, in words of its own")])
    assert {r.doc_id for r in P.drop_near_duplicates(spark, docs, SMALL).collect()} == {3, 9} and asked
