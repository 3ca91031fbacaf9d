import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from watchwell.llm.common import stored
from watchwell.llm.token_store import EliasFano, Encoder, document_ids, encode_documents, open_block, read_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [3, 3, 9, 1000, 10**12], list(range(0, 5000, 3)), [0] * 700 + [2**40]])
def test_elias_fano_round_trip(values):
    seq, used = EliasFano.from_bytes(memoryview(EliasFano.encode(np.array(values)).to_bytes() + b"rest"))
    assert seq.values().tolist() == values
    assert [seq.select(i) for i in range(len(values))] == values
    assert used == len(seq.to_bytes())


def test_elias_fano_is_small():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 20, 4000))
    assert len(EliasFano.encode(values).to_bytes()) * 8 < 4000 * 11


@pytest.mark.parametrize("text", ["", "a  b", "Hello, World. don't I'll 12,5 x.\ty z", "É̈A, ÉA. Σίσυφος, İx. ß.", "<|endoftext|>, a", "\n\n", "a\x1cb ́c ,. . ,", "Ndheha, ESBLE!! euxan### Çà, mail7.x@y.com,&& 's x's 'S a_b ﬁn ǅ. Ωmega, naïve-- x!'s"])
def test_chunks_encode_as_whole_texts(text):
    whole = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    encoder = Encoder(PATH, 2)
    assert encoder.chunked
    assert encoder.encode(pa.array([text]))[0].tolist() == whole


def test_random_texts_and_a_small_cache():
    rng = random.Random(8)
    marks = ["a", "Bé", "'S", "'ll", "\t", " ", "\n", "\u00a0", "\u0301", "ﬁ", "12", "<|endoftext|>", "-", "…", "漢字", "e\u0301", "\x1c", "ΑΣ", "😀"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(40))) for _ in range(800)]
    library, encoder = Tokenizer.from_file(PATH), Encoder(PATH, 4)
    encoder.CACHE, encoder.UNITS = 50, 300
    ids, sizes = encoder.encode(pa.array(["head", *texts, "tail"]).slice(1, 800))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, text = Encoder(path, 4), "Two  words\n and spaces"
    assert not encoder.chunked
    assert encoder.encode(pa.array([text, ""]))[0].tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def brute(rows):
    tokenizer, at, out = Tokenizer.from_file(PATH), 0, []
    encode = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, np.array(encode(r[1]), "<u2").tobytes())):
        ids = [*encode(t), 1]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_documents_round_trip(spark):
    rows = [(9, "nine words, or so."), (-4, None), (None, "no id"), (2, ""), (2, "twice"), (2, "twice"), (2**62, "long " * 3000), (7, "Zwölf Boxkämpfer")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, payload string").repartition(3)
    blocks = stored(encode_documents(docs, PATH, block_ids=50), "t")
    got = read_documents(blocks).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(rows)
    ends = [open_block(r.payload)[1].values()[-1] for r in blocks.collect()]
    assert sum(ends) == sum(r[2] for r in brute(rows))
    found = [x for r in blocks.collect() if (x := document_ids(r.payload, 7)) is not None]
    assert [x.tolist() for x in found] == [[*Tokenizer.from_file(PATH).encode("Zwölf Boxkämpfer", add_special_tokens=False).ids, 1]]
    assert all(document_ids(r.payload, 8) is None for r in blocks.collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert read_documents(stored(encode_documents(docs, PATH), "t")).collect() == []
