import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from faultline.llm import token_store as S

from .conftest import CLASHING, documents


def test_segment_round_trip():
    random.seed(1)
    for d in (1, 2, 255, 256, 257, 1000):
        counts = [random.choice((1, 1, 1, 2, 9, 4000)) for _ in range(d)]
        ends = np.cumsum(counts)
        ids = np.random.default_rng(d).integers(0, 60000, ends[-1]).astype("<u2")
        blob = S.pack(ends, ids.tobytes(), 2)
        segment = S.Segment(blob)
        assert [segment.boundary(i) for i in range(d)] == ends.tolist()
        i = random.randrange(d)
        assert (segment.document(i) == ids[ends[i] - counts[i] : ends[i]]).all()
        assert len(blob) < 2 * len(ids) + d * (4 + np.log2(ends[-1] / d)) / 8 + 100 + d / 16
    with pytest.raises(ValueError):
        S.Segment(b"XXXX" + blob[4:])


def test_coder_equals_the_library():
    coder, library = S.TextCoder(S.VOCABULARY, S.END_ID), Tokenizer.from_file(public_tokenizers.path(S.VOCABULARY))
    random.seed(3)
    pool = ["abc", "ABC", "'", "'s", "'LL", "'ll", "12", "²", "½", "éÉ", "×", "_", "--", "…", "€", "中", "\x1c", "\x85", "\xa0", "<|endoftext|>", " ", "  ", "\n", "\t"]
    for _ in range(3000):
        text = "".join(random.choice(pool) for _ in range(random.randint(0, 12)))
        want = [*library.encode(text, add_special_tokens=False).ids, S.END_ID]
        assert np.frombuffer(coder.encode(text), "<u2").tolist() == want, repr(text)


def test_store_of_odd_rows(spark, scratch, odd_rows, empty):
    rows = [*odd_rows, *((100 + i, f"text number {i} of many") for i in range(50))]
    path = scratch.path("store")
    S.write_store(documents(spark, rows, CLASHING), path, S.VOCABULARY, S.END_ID, segment_ids=100)
    got = sorted(map(tuple, S.read_store(spark, path).collect()), key=lambda r: r[1])
    library = Tokenizer.from_file(public_tokenizers.path(S.VOCABULARY))
    coded = {t: [*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows}
    want = sorted((i or -1, len(coded[t]), zlib.crc32(np.array(coded[t], "<u4").tobytes())) for i, t in rows)
    assert sorted((r[0] or -1, r[2], r[3]) for r in got) == want
    assert [r[0] or -1 for r in got] == sorted(i or -1 for i, _ in rows)  # ascending, null first
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    again = scratch.path("none")
    S.write_store(empty, again, S.VOCABULARY, S.END_ID)
    assert S.read_store(spark, again).count() == 0
