import random
import re

from faultline.llm import sanitise as S

from .conftest import CLASHING, documents

#: The patterns as the contract has them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def test_base_spans_against_brute_force(spark, scratch):
    random.seed(9)
    pool = ["a@b.c", "@", ".", "..", "x_y%+-z@q-1.co.uk", "1.2.3.4", "255.256.1.1", "007.000000001.3.4", "1.2.3.4.5.6.7.8", "+1 (555) 010-9999", "+", "+1",
            "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "0", "00", " ", "-", "é", "😀", "\n", "word", "12345678901234567890", "(", ")"]
    rows = [(i, "".join(random.choice(pool) for _ in range(random.randint(0, 25)))) for i in range(600)]
    got = {r.doc_id: r for r in S.report(documents(spark, rows, CLASHING), scratch).collect()}
    for i, text in rows:
        spans = [s for s in got[i].spans.split(",") if s and not s.startswith("term")]
        assert spans == brute(text), repr(text)
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(s.startswith(k) for s in spans) for k in PLAIN]


def test_long_runs_stay_linear(spark, scratch):
    rows = [(1, "a" * 200_000), (2, "1" * 200_000), (3, "1.2.3." * 40_000), (4, "+1 " * 60_000), (5, "1 " * 100_000), (6, "a@" * 50_000), (7, "a.b@c." * 30_000), (8, "x 10.0.0.1 " * 4000)]
    got = {r.doc_id: r for r in S.report(documents(spark, rows), scratch).collect()}
    assert got[8].n_ip == 4000
    assert [got[i].n_email for i in (1, 6, 7)] == [0, 0, len(brute("a.b@c." * 30_000))]


def test_terms_that_tell_a_value(spark, scratch):
    filler = lambda i: " ".join(f"w{i}x{j}" for j in range(12))
    rows = [(i, f"{filler(i)}\nthe surgeon Quilliam mailed jo@x.org about topic{i} today\n{filler(i + 1000)}") for i in range(5)]
    rows += [(10 + i, f"{filler(i + 50)} the mailed about today and a word") for i in range(200)]
    rows += [(300, "Quilliam again, but without the address"), (301, "quilliam wrote as jo@x.org or jo@x.org.")]
    docs = documents(spark, rows)
    got = {r.doc_id: r.spans for r in S.report(docs, scratch).collect()}
    text = dict(rows)
    for i in range(5):
        at = text[i].index("Quilliam")
        assert f"term:{at}:{at + 8}" in got[i].split(",")
        assert not any(s == f"term:{text[i].index(w)}:{text[i].index(w) + len(w)}" for w in ("mailed", "about", "today") for s in got[i].split(","))
    assert got[300] == "" and got[301].startswith("email:18:26,email:30:38") and "term:0:8" in got[301]
    masked = {r.doc_id: r.text for r in S.sanitise(docs, scratch).collect()}
    assert masked[301] == "[TERM] wrote as [EMAIL] or [EMAIL]."
    assert masked[300] == text[300] and "Quilliam" not in masked[0]


def test_copies_do_not_tell(spark, scratch):
    rows = [(i, "one surgeon Quilliam mailed jo@x.org about it") for i in range(50)] + [(100 + i, f"other text {i}") for i in range(200)]
    assert all("term" not in r.spans for r in S.report(documents(spark, rows), scratch).collect())


def test_odd_rows_and_masking(spark, scratch, odd_rows, empty):
    rows = [*odd_rows, (1, "mail a@b.cd"), (1, "mail a@b.cd"), (None, "+1 (649) 555-1648 4111111111111111")]
    got = S.report(documents(spark, rows, CLASHING), scratch).collect()
    assert sorted((str(r.doc_id), r.spans) for r in got) == sorted((str(i), ",".join(brute(t))) for i, t in rows)
    masked = S.sanitise(documents(spark, rows, [c for c in CLASHING if c not in ("_id", "_key")]), scratch)
    assert masked.count() == len(rows)
    assert sorted(str(r.text) for r in masked.collect())[-1] >= "" and {r.text for r in masked.collect()} >= {"mail [EMAIL]", None, ""}
    assert S.report(empty, scratch).count() == S.sanitise(empty, scratch).count() == 0


def test_copied_passages_give_the_spans_of_the_uncopied(spark, scratch):
    passages = ["mail to jo@x.org in Zanzibar was sent", "from Zanzibar wrote jo@x.org again later", "old Zanzibar friends know jo@x.org well"]
    filler = [(1000 + i, " ".join(f"w{i}x{j}" for j in range(9))) for i in range(1500)]
    found = {}
    for copies in (1, 5, 40):
        # what differs between copies lies beyond the context
        apart = [" ".join(f"p{k}q{j}" for j in range(9)) for k in range(3)]
        rows = [(100 * k + c, f"{p} {apart[k]} {c}") for k, p in enumerate(passages) for c in range(copies)]
        got = {r.doc_id: r.spans for r in S.report(documents(spark, rows + filler), scratch).collect()}
        found[copies] = {k: {got[100 * k + c] for c in range(copies)} for k in range(3)}
    assert found[1] == found[5] == found[40]
    assert all("term" in s for spans in found[1].values() for s in spans)
