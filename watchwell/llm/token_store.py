"""Token ids in binary blocks whose document boundaries are Elias-Fano coded.

Documents are dealt into shards by ascending doc_id and each shard is a run of
blocks. A block is one binary record of a Parquet table:

    header   magic, version, bytes per id, low bits and size of both sequences
    doc ids  Elias-Fano sequence of doc_id - first doc_id
    ends     Elias-Fano sequence of the end of every document in the block
    ids      all ids of the block, one after the other, 2 or 4 bytes each

An Elias-Fano sequence of n values below u takes about n * (2 + log2(u / n))
bits; ``EliasFano.select`` finds one value through 32-bit samples of the upper
bits, ``EliasFano.values`` decodes all. No table of 64-bit offsets is kept:
a document starts at (ids in earlier shards) + (ids of earlier blocks of its
shard) + (end of the document before it in the block).

Edge cases: a null text counts as empty and yields only the end id; null doc_ids
come first; rows that share a doc_id stay separate, ordered by their ids; an empty
table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchwell.llm import words as W
from watchwell.llm.common import stored, table

#: One select sample per this many values.
SAMPLE = 256
_HEAD = struct.Struct("<4sBBxxIQIIIq")
_SEQ = struct.Struct("<BxxxIQII")
_MAGIC = b"WWEF"

BLOCK_SCHEMA = "shard int, block int, shard_offset long, n_docs long, n_ids long, payload binary"
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, block int"


class EliasFano:
    """A non-decreasing sequence of integers from 0 up, in near-minimal space."""

    def __init__(self, n: int, universe: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.universe, self.low_bits = n, universe, low_bits
        self._low, self._high, self._samples = low, high, np.frombuffer(samples, dtype="<u4")

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n, dtype=np.int64)
        upper = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        upper[ones] = 1
        high = np.packbits(upper, bitorder="little").tobytes()
        return cls(n, universe, low_bits, low, high, ones[::SAMPLE].astype("<u4").tobytes())

    def to_bytes(self) -> bytes:
        head = _SEQ.pack(self.low_bits, self.n, self.universe, len(self._low), len(self._high))
        return head + self._low + self._high + self._samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The sequence at the start of ``data`` and the bytes that it takes."""
        low_bits, n, universe, n_low, n_high = _SEQ.unpack_from(data)
        a = _SEQ.size
        b, c = a + n_low, a + n_low + n_high
        d = c + 4 * (-(-n // SAMPLE))
        return cls(n, universe, low_bits, bytes(data[a:b]), bytes(data[b:c]), bytes(data[c:d])), d

    def _lows(self, first: int, count: int) -> np.ndarray:
        at = first * self.low_bits
        part = np.frombuffer(self._low, dtype=np.uint8)[at // 8 : (at + count * self.low_bits + 7) // 8]
        bits = np.unpackbits(part, bitorder="little")[at % 8 : at % 8 + count * self.low_bits]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return (bits.reshape(count, self.low_bits).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)

    def values(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, dtype=np.int64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self._high, dtype=np.uint8), bitorder="little"))
        upper = (ones - np.arange(self.n)).astype(np.uint64)
        return ((upper << np.uint64(self.low_bits)) | self._lows(0, self.n)).astype(np.int64)

    def select(self, i: int) -> int:
        """Value i, from the sample before it on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self._samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        high = np.frombuffer(self._high, dtype=np.uint8)
        while True:
            ones = np.flatnonzero(np.unpackbits(high[byte : byte + 128], bitorder="little")) + 8 * byte
            ones = ones[ones >= at]
            if left < len(ones):
                upper = int(ones[left]) - i
                return (upper << self.low_bits) | int(self._lows(i, 1)[0])
            left -= len(ones)
            byte += 128


def pack_block(doc_ids: list[int | None], ends: np.ndarray, ids: bytes, width: int) -> bytes:
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    first = int(known[0]) if len(known) else 0
    keys = EliasFano.encode(known.astype(np.uint64) - np.uint64(first % 2**64)).to_bytes()
    marks = EliasFano.encode(ends).to_bytes()
    head = _HEAD.pack(_MAGIC, 1, width, len(doc_ids), len(ids) // width, len(keys), len(marks), len(doc_ids) - len(known), first)
    return head + keys + marks + ids


def open_block(payload: bytes) -> tuple[list[int | None], EliasFano, memoryview, int]:
    """doc_ids, ends, the raw ids and the bytes per id of one block."""
    data = memoryview(payload)
    magic, version, width, _, _, n_keys, n_marks, n_null, first = _HEAD.unpack_from(data)
    if magic != _MAGIC or version != 1:
        raise ValueError("not a token block")
    a = _HEAD.size
    keys, _ = EliasFano.from_bytes(data[a : a + n_keys])
    ends, _ = EliasFano.from_bytes(data[a + n_keys : a + n_keys + n_marks])
    known = (keys.values().astype(np.uint64) + np.uint64(first % 2**64)).astype(np.int64)
    return [None] * n_null + known.tolist(), ends, data[a + n_keys + n_marks :], width


def document_ids(payload: bytes, doc_id: int) -> np.ndarray | None:
    """The ids of one document of a block, found by bisection over ``select``; None if it isn't there."""
    data = memoryview(payload)
    _, _, width, n_docs, _, n_keys, n_marks, n_null, first = _HEAD.unpack_from(data)
    keys, _ = EliasFano.from_bytes(data[_HEAD.size : _HEAD.size + n_keys])
    ends, _ = EliasFano.from_bytes(data[_HEAD.size + n_keys : _HEAD.size + n_keys + n_marks])
    at = bisect_left(range(keys.n), doc_id - first, key=keys.select)
    if at == keys.n or keys.select(at) != doc_id - first:
        return None
    at += n_null
    begin, end = ends.select(at - 1) if at else 0, ends.select(at)
    body = data[_HEAD.size + n_keys + n_marks :]
    return np.frombuffer(body[begin * width : end * width], dtype=f"<u{width}")


# Normalizer and pre-tokenizer of tokenizers for which the ids of a text
# are those of its chunks between spaces and line ends, as they drop white space, never
# cross it, lower-case, and part letters from digits and marks.
_CHUNKED = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


class Encoder:
    """Ids of texts by the tokenizers library.

    Where the tokenizer's file allows it (_CHUNKED), each distinct chunk between
    spaces goes through the library once while it is remembered, by a 64-bit hash;
    the ids of a batch are then gathered with numpy. (Two of a million remembered
    chunks share a hash with probability 3e-8.) Other tokenizers encode whole texts.
    """

    #: Chunks that are remembered at most, by a worker: some 70 bytes each.
    CACHE = 1 << 20
    #: Bytes of text that are worked on in one go.
    UNITS = 1 << 17
    # A Latin word and ASCII marks after it: the word in lower case, then the marks.
    _PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-/:-@\[-`{-~]*)")

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self._tokenizer.to_str())
        model = spec["model"]
        self.chunked = (spec["normalizer"], spec["pre_tokenizer"]) == _CHUNKED and model["type"] == "BPE" and not model["dropout"]
        # Added tokens are looked for before anything else: none may hold white space, or take it from its sides.
        self.chunked &= not any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        #: Letters of plain words as the model spells them.
        self._bytes = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(0x250) if chr(c).isalpha()}
        self._kind = np.dtype(f"<u{width}")
        self._inside = np.ones(256, dtype=bool)
        self._inside[[10, 32]] = False
        self._known = W.Memory(self._kind)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> list[int]:
        """Ids of a lower-case Latin word: one piece, straight to the library's model."""
        return [t.id for t in self._tokenizer.model.tokenize(word.translate(self._bytes))]

    def _learn(self, chunks: list[str]) -> list[list[int]]:
        """The ids of new chunks."""
        parts = [(m[1].lower(), m[2]) if (m := self._PLAIN.fullmatch(c)) else ("", c) for c in chunks]
        words, rest = {w for w, _ in parts if w}, list({x for _, x in parts if x})
        known = {"": [], **{w: self._word(w) for w in words}}
        other = dict(zip(["", *rest], [[], *self._whole(rest)], strict=True))
        return [known[w] + other[x] for w, x in parts]

    def _chunks(self, units: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, first = W.spans(units, offsets, self._inside)

        def learn(at: np.ndarray) -> list[list[int]]:
            data = units.tobytes()
            return self._learn([data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])

        ids, begins = self._known.gather(self._known.recall(W.hashes(units, starts, ends), self.CACHE, learn))
        return ids, np.diff(begins[first])

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow string array without nulls, one text after the other, and how many each text has."""
        ids, sizes = [np.zeros(0, dtype=self._kind)], [np.zeros(0, dtype=np.int64)]
        if self.chunked:
            units, offsets = W.arrow_bytes(column)
            for a, b in W.slices(offsets, self.UNITS):
                made = self._chunks(units[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids.append(made[0])
                sizes.append(made[1])
        else:
            for a in range(0, len(column), 256):
                lists = self._whole(column.slice(a, 256).to_pylist())
                ids += [np.array(x, dtype=self._kind) for x in lists]
                sizes.append(np.array([len(x) for x in lists], dtype=np.int64))
        return np.concatenate(ids), np.concatenate(sizes)


_encoders: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, width: int) -> Encoder:
    if (path, width) not in _encoders:
        _encoders[path, width] = Encoder(path, width)
    return _encoders[path, width]


def encode_texts(docs: DataFrame, tokenizer: str, width: int = 2) -> DataFrame:
    """(doc_id, ids) of docs (doc_id, text): the ids of each text, ``width`` bytes each, without an end id."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = _encoder(tokenizer, width)
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                ids, sizes = encoder.encode(batch.column(1))
                ends = np.concatenate([[0], np.cumsum(sizes)]) * width
                made = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0), made.cast(pa.binary())], names=["doc_id", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, ids binary")


def write_blocks(encoded: DataFrame, end_id: int = 1, width: int = 2, block_ids: int = 1 << 20) -> DataFrame:
    """Blocks (BLOCK_SCHEMA) of stored (doc_id, ids), in ascending doc_id order; every document gets ``end_id``.

    A block ends once it holds ``block_ids`` ids; a longer document gets a block of its own size.
    """

    def write(batches: Iterator) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        from pyspark import TaskContext

        shard, block, offset, end = TaskContext.get().partitionId(), 0, 0, end_id.to_bytes(width, "little")
        doc_ids, parts, sizes, n = [], [], [], 0

        def flush():
            nonlocal block, offset, doc_ids, parts, sizes, n
            payload = pack_block(doc_ids, np.cumsum(sizes), b"".join(parts), width)
            row = (shard, block, offset, len(doc_ids), n, payload)
            block, offset, doc_ids, parts, sizes, n = block + 1, offset + n, [], [], [], 0
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], type=k) for x, k in zip(row, kinds, strict=True)], names=["shard", "block", "shard_offset", "n_docs", "n_ids", "payload"])

        for batch in batches:
            for d, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = len(ids) // width + 1
                if n and n + size > block_ids:
                    yield flush()
                doc_ids.append(d)
                parts += (ids, end)
                sizes.append(size)
                n += size
        if doc_ids:
            yield flush()

    order = F.col("doc_id").asc_nulls_first()
    return encoded.repartitionByRange(order).sortWithinPartitions(order, "ids").mapInArrow(write, BLOCK_SCHEMA)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, width: int = 2, block_ids: int = 1 << 20) -> DataFrame:
    """Blocks of token ids (BLOCK_SCHEMA) of docs (doc_id, text).

    Texts are encoded where they are and the ids are stored; only ids are dealt by
    range. tokenizer: a file of the tokenizers library; width: bytes per id.
    """
    return write_blocks(stored(encode_texts(docs, tokenizer, width), "token-ids", "zstd"), end_id, width, block_ids)


def read_documents(blocks: DataFrame) -> DataFrame:
    """One row per document from stored blocks (DOC_SCHEMA); boundaries are read by ``select``.

    The driver sees one number per shard, that is per task that wrote.
    """
    totals = sorted(blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    starts = dict(zip([r.shard for r in totals], np.cumsum([0, *(r.n for r in totals)]).tolist(), strict=False))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                doc_ids, ends, ids, width = open_block(r.payload)
                words = np.frombuffer(ids, dtype=f"<u{width}").astype("<u4")
                stops = np.fromiter(map(ends.select, range(ends.n)), dtype=np.int64, count=ends.n)
                begins = np.concatenate([[0], stops[:-1]])
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(doc_ids, dtype="Int64"),
                        "start": begins + r.shard_offset + starts[r.shard],
                        "n_tokens": stops - begins,
                        "ids_crc32": [zlib.crc32(words[a:b]) for a, b in zip(begins, stops, strict=True)],
                        "shard": r.shard,
                        "block": r.block,
                    }
                )

    return blocks.select("shard", "block", "shard_offset", "payload").mapInPandas(read, DOC_SCHEMA)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    blocks = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(stored(blocks, "token-store", "zstd"))


QUERIES = {"op1_token_store": op1_token_store}
ORACLES: dict[str, str] = {}
