import random
import re

import numpy as np
import xxhash

from faultline.llm import simhash as S
from faultline.session import Scratch

from .conftest import CLASHING, documents


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(values, budget=3):
    up = list(range(len(values)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(values))]


def test_fingerprint_equals_the_definition():
    random.seed(1)
    pool = ["a", "B", "é", "ẞ", "\u3000", "\x1c", "\x00", " ", "\t", "\n", "\x0b", "Zz", "word"]
    for _ in range(300):
        text = "".join(random.choice(pool) for _ in range(random.randint(0, 40)))
        assert S.fingerprint(text) == plain_fingerprint(text), repr(text)
    assert S.fingerprint(None) == S.fingerprint(" \n") == 0


def test_trie_join_against_all_pairs():
    random.seed(2)
    for trial in range(60):
        width = random.choice([64, 20, 8])
        values = [random.getrandbits(width) for _ in range(random.randint(1, 120))]
        for _ in range(60):
            v = random.choice(values)
            for _ in range(random.randint(0, 4)):
                v ^= 1 << random.randrange(64)
            values.append(v)
        ordered = sorted(set(values))
        got = S.trie_links(np.array(ordered, np.uint64), None, 3, 0).tolist()
        assert got == groups_of(ordered)


def test_groups_with_cells_split(spark, scratch):
    random.seed(3)
    base = random.getrandbits(64)
    dense = {base}
    while len(dense) < 150:  # one tight group, far more than a cell holds
        dense.add(base ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)))
    values = sorted(dense | {random.getrandbits(64) for _ in range(200)} | {0, 1, 7})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "_fp long").repartition(5)
    rooted = S.components(S.links(frame, len(values), scratch, cell=20), scratch)
    got = {r.node & (2**64 - 1): r.root for r in rooted.collect()}
    want = groups_of(values)
    for i, v in enumerate(values):
        for j in range(i):
            w = values[j]
            assert (want[i] == want[j]) == (got.get(v, v) == got.get(w, w))


def test_components_of_a_chain_and_a_star(spark, scratch):
    chain = [(i, i + 1) for i in range(40)] + [(i, 100) for i in range(60, 100)] + [(3, 3), (1, 0)]
    frame = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.root for r in S.components(frame, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 60 for i in range(60, 101)}}
    assert S.components(frame.limit(0), scratch).count() == 0


def test_odd_rows_and_copies(spark, odd_rows, empty):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [*odd_rows, (50, base), (40, base.upper()), (60, base + " end"), (70, " ".join(f"v{i}" for i in range(400)))]
    got = S.near_duplicates(documents(spark, rows, [c for c in CLASHING if c != "_fp"])).collect()
    assert len(got) == len(rows)
    component = {(r.doc_id, r._fp): r.component for r in got}
    by_id = {r.doc_id: r.component for r in got}
    assert by_id[50] == by_id[40] == 40 and by_id[70] == 70
    assert (S.fingerprint(base) ^ S.fingerprint(base + " end")).bit_count() > 3 or by_id[60] == 40
    zero = {r.component for r in got if r._fp == 0}
    assert zero == {2}  # null, empty and wordless texts link; the null id names nothing
    assert component[(None, S.fingerprint("no id here") - (1 << 64) if S.fingerprint("no id here") >> 63 else S.fingerprint("no id here"))] is None
    assert S.near_duplicates(empty).count() == 0
