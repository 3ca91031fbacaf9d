import random
import sys

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from watchwell.llm.pieces import BYTE_SCORE, SPACE, Pieces, decode, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return Pieces(PATH)


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def small(words, seed=0, ranked=False):
    """A model of few pieces, with spaces inside some."""
    rng = random.Random(seed)
    m = Pieces.__new__(Pieces)
    m.bytes = {b: b for b in range(256)}
    score = (lambda i: -float(i)) if ranked else (lambda i: -rng.uniform(1, 9))
    m._build({w: (score(i), 256 + i) for i, w in enumerate(words)}, 256 + len(words), ranked)
    return m


def best_score(m, text):
    """Full-table Viterbi."""
    shown = text.replace(SPACE, "\0").replace(" ", SPACE)
    top = [0.0]
    for end in range(1, len(shown) + 1):
        c = SPACE if shown[end - 1] == "\0" and text[end - 1] == SPACE else shown[end - 1]
        options = [top[end - 1] + BYTE_SCORE * len(c.encode())]
        options += [top[s] + m.pieces[shown[s:end]][0] for s in range(max(0, end - 40), end) if shown[s:end] in m.pieces]
        top.append(max(options))
    return top[-1]


def score_of(m, ids):
    names = {i: s for s, i in m.pieces.values()}
    return sum(names.get(int(i), BYTE_SCORE) for i in ids)


TEXTS = ["", "a", " ", "  two  spaces ", "Hello world", "naïve Ωmega 東京 😀", "x▁y ▁", "tab\tand\nline\r\n", "a" * 500, "wordsrunningtogether" * 40, "\0 nul", "é" * 70 + " end"]


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip_and_ids_of_the_library(model, library, text):
    ids = model.encode(text)
    assert model.decode(ids) == text
    if SPACE not in text and "\0" not in text:
        assert ids.tolist() == library.encode(text)


@pytest.mark.parametrize("seed", range(20))
def test_ranked_pieces_are_those_of_merging_step_by_step(seed):
    rng = random.Random(seed)
    merged = ["a", "b", "c", SPACE]
    while len(merged) < 30:  # pieces grow from pieces, as a training makes them
        new = rng.choice(merged) + rng.choice(merged)
        if new not in merged and len(new) < 9:
            merged.append(new)
    m = small(merged, ranked=True)
    usable = [w for w in merged if m._merged(w) == [w]]
    m = small(usable, ranked=True)
    for _ in range(30):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 60)))
        ids = [i for part in m.stream(text, check=8) for i in part]
        assert [m.names[i] for i in ids] == m._merged(text.replace(" ", SPACE))


@pytest.mark.parametrize("seed", range(30))
def test_streaming_equals_full_table_where_pieces_cross_words(seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("ab" + SPACE) for _ in range(rng.randint(1, 5))) for _ in range(25)} | {"a", "b", SPACE}
    m = small(sorted(words), seed)
    text = "".join(rng.choice("ab ") for _ in range(300))
    parts = list(m.stream(text, check=8))
    ids = [i for p in parts for i in p]
    assert score_of(m, ids) == pytest.approx(best_score(m, text))
    assert b"".join(m.raw[i] for i in ids).decode() == text
    assert len(parts) > 1


def test_a_long_text_without_spaces_is_committed_on_the_way(model, library):
    rng = random.Random(4)
    text = "".join(rng.choice(["ing", "the", "water", "é", "x", "of"]) for _ in range(40_000))
    parts = list(model.stream(" " + text))
    assert len(text) > 90_000 and len(parts) > len(text) / 100
    assert max(map(len, parts)) < 400  # what is held at one time
    assert [i for p in parts for i in p] == library.encode(text)


def test_word_by_word_is_the_search_over_the_whole_text(model):
    rng = random.Random(6)
    pieces = ["word", "naïve", " ", "  ", "\n", "▁", "東京", "x", "Straße,", "\0"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["", " ", "   ", "a" * 3000]
    m = Pieces(PATH)
    m.CACHE = 60
    ids, begins = m.encode_all(pa.array(["head", *texts, "tail"]).slice(1, len(texts)))
    assert [x.tolist() for x in np.split(ids, begins[1:-1])] == [model.encode(t).tolist() for t in texts]


def test_all_documents_get_the_ids_of_the_library(model, library):
    rows = [t or "" for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    ids, begins = model.encode_all(pa.array(rows))
    assert len(rows) == 1000 and [x.tolist() for x in np.split(ids, begins[1:-1])] == library.encode(rows)


def test_frames(spark, model):
    df = spark.createDataFrame([(1, "some text", 5), (2, None, 6), (2, None, 6), (3, "", 7)], "doc_id long, text string, n int")
    got = decode(encode(df, PATH), PATH, text="back").orderBy("doc_id").collect()
    assert [r.back for r in got] == ["some text", "", "", ""]
    assert got[0].ids == model.encode("some text").tolist()
    assert encode(df.limit(0), PATH).collect() == []


def test_few_pieces_are_asked_for(model, monkeypatch):
    """A piece is asked whether it may follow only where its place has no path that is as good."""
    monkeypatch.setattr(model, "_beside", {})
    ids = [i for part in model.stream(" international") for i in part]
    assert model.decode(np.array(ids)) == "international"
    assert len(model._beside) <= len(" international")  # 45 if all that fit are asked


def test_few_lookups_a_character(model):
    """The pieces that end at a character come from one lookup, not from one for each place where a piece may end."""
    words = [" international", " understanding", " representations", " thertionat,", " enthaltenden", " the.\nThereafter"]
    encoded = [[i for part in model.stream(w) for i in part] for w in words]
    seen = []
    sys.setprofile(lambda frame, event, called: seen.append(called.__name__) if event == "c_call" else None)
    try:
        again = [[i for part in model.stream(w) for i in part] for w in words]
    finally:
        sys.setprofile(None)
    assert again == encoded
    assert seen.count("get") < 4 * sum(map(len, words))
