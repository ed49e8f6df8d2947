"""Token ids of a corpus as binary segments with Elias-Fano encoded document boundaries.

A store is a Parquet folder, so Spark's committers make a written segment whole or absent and any
file system will do; each row is one segment and its ``blob`` column is the segment file image:

    header   magic ``FLTS``, version, id width (2 or 4), documents d, ids n, low bits l,
             bytes of the high part, number of select samples (little-endian, 8 bytes each)
    high     unary coded upper parts of the d boundaries, one bit set for each
    low      the lower l bits of the d boundaries, packed
    select   bit position of every 256th set bit of ``high``
    ids      n token ids of ``width`` bytes

The boundary of document i is the number of ids up to its end, so a boundary needs about
2 + log2(n / d) bits. ``boundary(i)`` reads one sample and scans at most 256 set bits onward; no
table of 64-bit offsets is kept in the blob or made by a point lookup.

Segments are written in ascending id order, null ids first; rows of one id are ordered by a hash
of the text. Defined results: null and empty texts are stored with the end id alone; every input
row is one document, repeated rows included; columns other than the two read are ignored; an
empty table gives an empty store.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.bpe import byte_symbols
from faultline.llm.common import scratch, ship, table, text_key

MAGIC, VERSION = b"FLTS", 1
HEADER = struct.Struct("<4sI6Q")
SAMPLE = 256
#: A segment closes after the document that takes it to this many ids.
SEGMENT_IDS = 1 << 18


def pack(ends: np.ndarray, ids: bytes, width: int) -> bytes:
    """The segment image of packed ``ids`` of ``width`` bytes with document boundaries ``ends``."""
    d, n = len(ends), int(ends[-1]) if len(ends) else 0
    low_bits = max(0, int(np.log2(n / d))) if d and n > d else 0
    ends = ends.astype(np.uint64)
    ones = (ends >> np.uint64(low_bits)).astype(np.int64) + np.arange(d)
    high = np.zeros(int(ones[-1]) + 1 if d else 0, np.uint8)
    high[ones] = 1
    shifts = np.arange(low_bits, dtype=np.uint64)
    low = ((ends[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
    samples = ones[::SAMPLE].astype("<u8")
    packed_high = np.packbits(high, bitorder="little").tobytes()
    packed_low = np.packbits(low, bitorder="little").tobytes()
    head = HEADER.pack(MAGIC, VERSION, width, d, n, low_bits, len(packed_high), len(samples))
    return b"".join((head, packed_high, packed_low, samples.tobytes(), ids))


class Segment:
    """Reads one segment image."""

    def __init__(self, blob: bytes):
        magic, version, width, self.documents, self.n_ids, self.low_bits, high, samples = HEADER.unpack_from(blob)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token segment of this version")
        at = HEADER.size
        self.high = np.frombuffer(blob, np.uint8, high, at)
        at += high
        low = (self.documents * self.low_bits + 7) // 8
        self.low = np.frombuffer(blob, np.uint8, low, at)
        at += low
        self.samples = np.frombuffer(blob, "<u8", samples, at)
        at += 8 * samples
        self.ids = np.frombuffer(blob, f"<u{width}", self.n_ids, at)

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        value = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return (value >> (first % 8)) & ((1 << self.low_bits) - 1)

    def _select(self, i: int) -> int:
        """Bit position of set bit ``i`` of the high part."""
        sample = int(self.samples[i // SAMPLE])
        byte, left = sample // 8, i % SAMPLE
        word = int(self.high[byte]) >> (sample % 8)  # its lowest bit is the sampled one
        base = sample
        while left >= (ones := word.bit_count()):
            left -= ones
            byte += 1
            base, word = byte * 8, int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return base + (word & -word).bit_length() - 1

    def boundary(self, i: int) -> int:
        """Number of ids in documents 0 to i."""
        return ((self._select(i) - i) << self.low_bits) | self._low(i)

    def boundaries(self) -> Iterator[tuple[int, int]]:
        """(begin, end) of every document, in order, in constant memory beside the blob."""
        begin = 0
        for i in range(self.documents):
            end = self.boundary(i)
            yield begin, end
            begin = end

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.boundary(i - 1) if i else 0 : self.boundary(i)]


#: Characters whose class no Unicode version or library disputes; texts of these alone are split here.
SETTLED = re.compile(r"[\t-\r -~\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\u024f\u2010-\u2027\u2030-\u203e\u20ac]*")
#: The byte-level pattern for such texts: contractions, letters, digits, others, white space.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Pieces kept with their ids in a worker process; beyond it a piece is merged anew each time.
MEMO_PIECES = 600_000


class TextCoder(dict):
    """Ids of whole texts by the tokenizers library, as packed integers.

    Pieces between two splits recur, so the library's merge model is asked once for a piece and
    the dictionary itself is the memo. Texts with characters outside ``SETTLED``, or that may hold
    a special token, and vocabularies split otherwise, go through the library whole.
    """

    def __init__(self, vocabulary: str, end_id: int, memo: int = MEMO_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism here
        from tokenizers import Tokenizer

        path = vocabulary
        if "/" not in path:
            import public_tokenizers

            path = public_tokenizers.path(path)
        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.memo = memo
        self.width = 2 if max(self.whole.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.end = np.array([end_id], self.kind).tobytes()
        spec = json.loads(self.whole.to_str())
        split = spec["pre_tokenizer"] or {}
        self.in_pieces = (
            spec["normalizer"] is None and spec["post_processor"] is None and spec["model"]["type"] == "BPE"
            and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        )
        self.marks = [t["content"] for t in spec["added_tokens"]]
        self.symbols = {b: s for b, s in enumerate(byte_symbols())}

    def __missing__(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(self.symbols)
        ids = np.array([t.id for t in self.model.tokenize(mapped)], self.kind).tobytes()
        if len(self) < self.memo:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Packed ids of ``text`` and the end id."""
        if self.in_pieces and SETTLED.fullmatch(text) and not any(m in text for m in self.marks):
            return b"".join(map(self.__getitem__, PIECES.findall(text))) + self.end
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind).tobytes() + self.end


_CODERS: dict[tuple[str, int], TextCoder] = {}


def text_coder(vocabulary: str, end_id: int) -> TextCoder:
    """One coder per worker process and vocabulary."""
    key = (vocabulary, end_id)
    if key not in _CODERS:
        _CODERS[key] = TextCoder(vocabulary, end_id)
    return _CODERS[key]


def _segments(vocabulary: str, end_id: int, segment_ids: int):
    kind = pa.schema([("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("blob", pa.binary())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = text_coder(vocabulary, end_id)
        keys: list = []
        parts: list[bytes] = []
        ends: list[int] = []
        n = first = 0

        def closed() -> pa.RecordBatch:
            blob = pack(np.array(ends, np.int64), b"".join(parts), own.width)
            row = ([first], [n], [keys], [blob])
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, kind)], schema=kind)

        for batch in batches:
            for key, text in zip(*(batch.column(i) for i in range(2))):
                ids = own.encode(text.as_py() or "")
                keys.append(key.as_py())
                parts.append(ids)
                n += len(ids) // own.width
                ends.append(n)
                if n >= segment_ids:
                    yield closed()
                    first += n
                    keys, parts, ends, n = [], [], [], 0
        if keys:
            yield closed()

    return write


def write_store(
    documents: DataFrame, path: str, vocabulary: str, end_id: int, id_column: str = "doc_id", text_column: str = "text",
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Encode every whole text and write the segments, in ascending id order, below ``path``.

    ``part`` is the place of a segment's range partition, ``first`` the ids before it in that partition.
    """
    ship(documents.sparkSession)
    ordered = (
        documents.select(F.col(id_column).cast("long").alias("_id"), F.col(text_column).alias("_text"))
        .withColumn("_key", text_key(F.col("_text")))
        .repartitionByRange("_id", "_key")
        .sortWithinPartitions("_id", "_key")
        .select("_id", "_text")
    )
    segments = ordered.mapInArrow(
        _segments(vocabulary, end_id, segment_ids), "first long, n_ids long, doc_ids array<long>, blob binary"
    )
    segments.withColumn("part", F.spark_partition_id()).write.parquet(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        starts, doc_ids, blobs = (batch.column(i) for i in range(3))
        for row in range(batch.num_rows):
            segment, first = Segment(blobs[row].as_py()), starts[row].as_py()
            begins, counts, sums = [], [], []
            for begin, end in segment.boundaries():
                begins.append(first + begin)
                counts.append(end - begin)
                sums.append(zlib.crc32(segment.ids[begin:end].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [doc_ids[row].values, *(pa.array(x, pa.int64()) for x in (begins, counts, sums))], schema=kind
            )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the segments alone.

    Only the sums of ids of the range partitions, one row for each, meet in a window and are broadcast.
    """
    ship(spark)
    stored = spark.read.schema("first long, n_ids long, doc_ids array<long>, blob binary, part int").parquet(path)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        stored.groupBy("part")
        .agg(F.sum("n_ids").alias("_n"))
        .select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_begin"))
    )
    return (
        stored.join(F.broadcast(begins), "part")
        .select((F.col("_begin") + F.col("first")).alias("_start"), "doc_ids", "blob")
        .mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


VOCABULARY, END_ID = "byte_bpe_50k.json", 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-store").path("segments")
    write_store(table(spark, sf_dir, "documents"), path, VOCABULARY, END_ID)
    return read_store(spark, path)
