import random

import public_tokenizers
from tokenizers import Tokenizer

from faultline.llm import bpe as B

from .conftest import CLASHING, LONG, documents

LIBRARY = Tokenizer.from_file(public_tokenizers.path(B.VOCABULARY))


def test_coder_equals_the_library():
    coder = B.WordCoder(public_tokenizers.path(B.VOCABULARY), memo_words=50)
    random.seed(2)
    pool = ["abc", "ABC", "'", "'s", "'LL", "123", "²½Ⅷ", "éÉ", "é", "İ", "Σσς", "ß", "中文", "한글", "\x00", "\x1c", "\x85", "\xa0", " ", "😀", "👍🏽", "<|endoftext|>", "<|", "_", "-- ...", "\t\n", "՘", " ", " "]
    for _ in range(3000):
        text = "".join(random.choice(pool) for _ in range(random.randint(0, 14)))
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == want, repr(text)
        assert coder.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


def test_scan_and_heap_merge_alike():
    coder = B.WordCoder(public_tokenizers.path(B.VOCABULARY))
    random.seed(4)
    for n in (1, 2, 3, 50, 199, 200, 201, 3000):
        word = "".join(random.choice("theinorabcé") for _ in range(n))
        symbols = [coder.symbols[b] for b in word.encode()]
        symbols[-1] += coder.end
        assert B.merge_long(symbols, coder.ranks) == (B.merge_parts(symbols, coder.ranks))
        assert coder.encode(word) == LIBRARY.encode(word, add_special_tokens=False).ids


def test_odd_rows(spark, odd_rows, empty):
    rows = [*odd_rows, (9, "x" * 100_000), (10, LONG + " 'S")]
    got = B.encode_texts(documents(spark, rows, CLASHING), B.VOCABULARY).collect()
    want = [(i, LIBRARY.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    assert sorted(((r.doc_id, list(r["ids"])) for r in got), key=str) == sorted(want, key=str)
    assert {r.decoded for r in got if not r["ids"]} == {""}
    assert B.encode_texts(empty, B.VOCABULARY).count() == B.digest_texts(empty, B.VOCABULARY).count() == 0
