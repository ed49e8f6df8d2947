import hashlib
import random
import re

from faultline.llm import decontaminate as D

from .conftest import CLASHING, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, window=10):
    out = []
    for i, text in rows:
        words, hit, names = terms(text), set(), set()
        for item, body in items:
            own = terms(body)
            n = min(window, len(own))
            if item is None or not n:
                continue
            wanted = {tuple(own[j : j + n]) for j in range(len(own) - n + 1)}
            for j in range(len(words) - n + 1):
                if tuple(words[j : j + n]) in wanted:
                    hit.update(range(j, j + n))
                    names.add(str(item))
        out.append((i, len(words), len(hit), ",".join(sorted(names))))
    return sorted(out, key=str)


def find(spark, scratch, rows, items, extra=()):
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "text AS term", "text AS item")
    got = D.find_passages(documents(spark, rows, extra), bench, scratch).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got), key=str)


def test_against_brute_force(spark, scratch):
    random.seed(7)
    word = lambda: random.choice("ab ab ab c d É ñ 7 word other".split(" "))  # noqa: E731  few words: many chance matches
    text = lambda n: " ".join(word() + random.choice(["", ",", ".", "\n"]) for _ in range(n))
    items = [(i, text(random.choice((1, 3, 9, 10, 11, 25)))) for i in range(12)] + [(3, text(12)), (None, text(10)), (50, None), (51, "... !")]
    rows = [(i, text(random.choice((0, 2, 10, 60, 200)))) for i in range(40)]
    rows += [(100 + i, text(9) + " " + items[i][1].upper() + " " + text(9)) for i in range(12)]
    rows += [(1, items[4][1]), (1, items[4][1]), (None, items[5][1]), (None, None)]
    assert find(spark, scratch, rows, items, CLASHING) == brute(rows, items)


def test_one_passage_in_many_documents(spark, scratch):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"before {i} {passage if i % 3 else ''} after") for i in range(300)]
    got = find(spark, scratch, rows, [(5, passage)])
    assert got == brute(rows, [(5, passage)])


def test_proximity_and_odd_rows(spark, scratch, odd_rows, empty):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    shuffled = "kappa iota theta eta zeta epsilon delta gamma beta alpha"
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = D.find_passages(documents(spark, [(1, f"x {shuffled} y"), (2, "nothing near")]), bench, scratch).collect()
    assert sorted((r.doc_id, r.n_hit, r["items"], r.near_items) for r in got) == [(1, 0, [], ["1"]), (2, 0, [], [])]
    assert find(spark, scratch, odd_rows, [(1, passage)], CLASHING) == brute(odd_rows, [(1, passage)])
    assert find(spark, scratch, odd_rows, [(None, None)]) == brute(odd_rows, [])
    assert D.find_passages(empty, bench, scratch).count() == 0


def test_query_digests(spark):
    from faultline.llm.catalog import QUERIES

    rows = QUERIES["op6_decontaminate"](spark, "/root/testdata/sf0.001").collect()
    none = hashlib.sha256(b"").hexdigest()
    assert any(r.contaminated for r in rows)
    assert all((r.n_items == 0) == (r.items_sha256 == none) == (not r.contaminated) for r in rows)
