"""Word-level byte-pair encoding with a contiguous rank array, and decoding.

The vocabulary file gives the normal form, the split pattern and the merges. A word is a list of
part boundaries with, beside each boundary, the rank of the merge of the two parts that meet
there; the least rank is looked for by a scan over the array, its boundary is deleted, and the two
neighbouring ranks are refreshed. Words of more than ``SCAN_LIMIT`` bytes use a heap over the same
boundaries, because the repeated scan takes the square of the length. Words recur, so a bounded
memo (``MEMO_WORDS``) keeps finished ones; it changes nothing but the time.

Defined results: null and empty texts have no ids and decode to the empty text. Special tokens
written out in a text are single ids, as in the library. Every input row gives one output row;
columns other than the two read are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from faultline.llm.common import ship, table

SCAN_LIMIT = 200
MEMO_WORDS = 200_000
NO_RANK = 1 << 60
#: Up to here every Unicode version sorts characters alike.
SETTLED = "\u0558"
#: Unicode white space, without the ASCII separators that some libraries add.
SPACES = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where printable, else one from 256 upwards."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def merge_parts(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Byte-pair merges of one word by scans over a contiguous rank array."""
    parts = list(symbols)
    near = [ranks.get(pair, NO_RANK) for pair in zip(parts, parts[1:])]
    while near:
        least = min(near)
        if least == NO_RANK:
            break
        i = near.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del near[i]
        if i < len(near):
            near[i] = ranks.get((parts[i], parts[i + 1]), NO_RANK)
        if i:
            near[i - 1] = ranks.get((parts[i - 1], parts[i]), NO_RANK)
    return parts


def merge_long(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The same merges for a long word: a heap of (rank, place) over linked boundaries."""
    parts: list[str | None] = list(symbols)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= len(parts) or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, None
        after[i] = k = after[j]
        if k < len(parts):
            before[k] = i
            if (r := ranks.get((parts[i], parts[k]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
            heapq.heappush(heap, (r, h, parts[h], parts[i]))
    return [p for p in parts if p is not None]


class WordCoder:
    """Encoder and decoder of one vocabulary file, for use inside a task."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): r for r, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.library_split = Split(Regex(split["pattern"]["Regex"]), behavior="removed", invert=True)
        self.library_form = Tokenizer.from_file(path).normalizer
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")")
        self.symbols = byte_symbols()
        self.memo: dict[str, tuple[int, ...]] = {}
        self.memo_words = memo_words

    @staticmethod
    def normalise(text: str) -> str:
        text = SPACES.sub(" ", unicodedata.normalize("NFC", text))
        # character by character: a final capital sigma gets no special form
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def split(self, text: str) -> list[str]:
        """Words of the normal form; characters younger than Unicode 3.2 are classed by the library's own tables."""
        if text and max(text) >= SETTLED and any(unicodedata.ucd_3_2_0.category(c) == "Cn" for c in set(text)):
            return [w for w, _ in self.library_split.pre_tokenize_str(self.library_form.normalize_str(text))]
        return self.words.findall(self.normalise(text))

    def word(self, word: str) -> tuple[int, ...]:
        found = self.memo.get(word)
        if found is None:
            symbols = [self.symbols[b] for b in word.encode()]
            symbols[-1] += self.end
            merge = merge_parts if len(symbols) <= SCAN_LIMIT else merge_long
            found = tuple(self.ids[p] for p in merge(symbols, self.ranks) if p in self.ids)
            if len(self.memo) < self.memo_words and len(word) <= SCAN_LIMIT:
                self.memo[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.marks.split(text) if "<|" in text else (text,):
            if piece in self.special:
                out.append(self.special[piece])
            else:
                for word in self.split(piece):
                    out.extend(self.word(word))
        return out

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by spaces, which is what a file without a decoder means."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


_CODERS: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    """One coder per worker process and file; the memo in it is bounded."""
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def _resolve(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(
    documents: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, ids, decoded): token ids of every whole text, and the text decoded from them.

    ``vocabulary`` is a path that every executor can read, or the name of a public vocabulary.
    """
    ship(documents.sparkSession)

    @F.pandas_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = coder(_resolve(vocabulary))
        for texts in batches:
            ids = [own.encode(t or "") for t in texts]
            yield pd.DataFrame({"ids": ids, "decoded": [own.decode(x) for x in ids]})

    coded = documents.select(F.col(id_column), code(F.col(text_column)).alias("_coded"))
    return coded.select(id_column, "_coded.ids", "_coded.decoded")


def digest_texts(
    documents: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), digests made beside the encoder."""
    ship(documents.sparkSession)
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    @F.pandas_udf(kind)
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = coder(_resolve(vocabulary))

        def row(text: str | None) -> tuple[int, str, str]:
            ids = own.encode(text or "")
            listed = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            return len(ids), listed, hashlib.sha256(own.decode(ids).encode()).hexdigest()

        for texts in batches:
            yield pd.DataFrame(list(map(row, texts)), columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    coded = documents.select(F.col(id_column), code(F.col(text_column)).alias("_coded"))
    return coded.select(id_column, "_coded.*")


VOCABULARY = "word_bpe_49k.json"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_texts(table(spark, sf_dir, "documents"), VOCABULARY)
