"""SentencePiece encoding by streaming Viterbi, and decoding.

The vocabulary and its scores come from a model file; the text is split into the
pieces whose scores have the greatest sum. One search gives all ids. It goes once
through the text and looks no further back than the longest piece; it keeps scores
and backpointers from the last committed boundary on, and whenever all surviving
paths run through one boundary, the ids before it are committed and forgotten.
Where no piece can contain a space after its beginning, the beginning of each word
is such a boundary: there the search ends and begins anew, so what it finds for a
word is remembered (by a 64-bit hash; two of a million words share one with
probability 3e-8).

Scores. A unigram model's scores are log probabilities and are used as they are. A
character without a piece is spelled in byte pieces, each worth ``BYTE_SCORE``, if the
model has them, else as its unknown piece. Ties: the longer last piece.

Ranks. The scores of a BPE model are merge ranks: the library joins the neighbours of
the lowest rank again and again. What it ends with is known by its neighbours alone:
two pieces stand side by side only if merging the text of the two gives just these two.
So a path of the search goes on with a piece only if that holds for it and the path's
last piece; of each beginning of the text one path is left, the library's. Whether two
pieces can stand side by side is remembered by a worker.

Spaces are written as U+2581 and a text gets one in front, as the library does;
U+2581 in a text is spelled in bytes, so decode(encode(text)) == text always.

Edge cases: null and empty texts have no ids and decode to the empty text; null
ids decode to the empty text; very long words and texts are streamed; repeated
rows are encoded each; other columns are kept whatever their names, but for a
column that has a new column's name; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from watchwell.llm import words as W
from watchwell.llm.common import appended, table

SPACE = "▁"
BYTE_SCORE = -25.0
#: Bytes of text that are worked on in one go.
UNITS = 1 << 17


class Pieces:
    """The pieces of a model file: best splits and their inverse."""

    #: Segments that are remembered at most, by a worker: some 70 bytes each.
    CACHE = 1 << 20

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = {i: model.get_score(i) for i in plain}
        ranked = all(s == int(s) for s in scores.values())
        self.bytes = {int(names[i][1:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self._build({names[i]: (scores[i], i) for i in plain}, size, ranked)

    def _build(self, pieces: dict[str, tuple[float, int]], size: int, ranked: bool = False) -> None:
        """pieces: (score, id) by name; ranked: scores are merge ranks, the highest first."""
        self.pieces, self.ranked = pieces, ranked
        self.names = {i: name for name, (_, i) in pieces.items()}
        self._beside: dict[tuple[int, int], bool] = {}
        self.longest = max(map(len, pieces), default=1)
        self.raw = [b""] * size
        for name, (_, i) in pieces.items():
            self.raw[i] = name.replace(SPACE, " ").encode()
        for byte, i in self.bytes.items():
            self.raw[i] = bytes([byte])
        self._beginnings = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
        self._endings: dict[str, tuple[tuple[int, int, float], ...]] = {"": ()}
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self._known = W.Memory(np.dtype("<u4"))

    def _spelled(self, c: str) -> list[int]:
        """Ids of a character without a piece; one that no UTF-8 can spell becomes "?"."""
        return [self.bytes[b] for b in c.encode("utf-8", "replace")] if len(self.bytes) == 256 else [self.unknown]

    def _merged(self, text: str) -> list[str]:
        """What a short text is merged to, by the lowest rank and from the left."""
        parts, none = list(text), (-math.inf,)
        ranks = [self.pieces.get(a + b, none)[0] for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := max(ranks)) > -math.inf:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            for k in (at - 1, at):  # only the new part's neighbours change
                if 0 <= k < len(ranks):
                    ranks[k] = self.pieces.get(parts[k] + parts[k + 1], none)[0]
        return parts

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether piece ``right`` can stand behind ``left`` (-1: none, or a spelled character)."""
        if left < 0:
            return True
        known = self._beside.get((left, right))
        if known is None:
            if len(self._beside) >= self.CACHE:
                self._beside.clear()
            a, b = self.names[left], self.names[right]
            known = self._beside[left, right] = self._merged(a + b) == [a, b]
        return known

    def _ending(self, text: str) -> tuple[tuple[int, int, float], ...]:
        """Size, id and score (ranked: 0) of all pieces that a beginning of a piece ends with, the longest first."""
        found = ((len(text) - k, self.pieces.get(text[k:])) for k in range(len(text)))
        return tuple((size, hit[1], 0.0 if self.ranked else hit[0]) for size, hit in found if hit)

    def stream(self, text: str, check: int = 64) -> Iterator[list[int]]:
        """Lists of ids, each committed as soon as all surviving paths agree on it.

        text: with spaces as they are; a U+2581 in it is spelled in bytes. Held are the
        scores of positions from the last commit on. The pieces that end at a character
        are those that the longest beginning of a piece which ends there ends with; they
        are listed once for each beginning.
        """
        shown = text.replace(SPACE, "\0").replace(" ", SPACE)  # \0 has no piece
        pieces, beginnings, endings, longest, low = self.pieces, self._beginnings, self._endings, self.longest, -math.inf
        ranked, beside = self.ranked, self._beside
        done, best, back, last = 0, [0.0], [0], [-1]  # of positions from done on; back, last: start of the last piece, and its id or -1
        behind = ""  # the longest beginning of a piece that ends here

        def path(stop: int) -> list[int]:
            out: list[int] = []
            at = stop
            while at > done:
                start, i = back[at - done], last[at - done]
                out += [i] if i >= 0 else reversed(self._spelled(SPACE if shown[start] == "\0" and text[start] == SPACE else shown[start]))
                at = start
            return out[::-1]

        for start, c in enumerate(shown):
            behind += c
            while (found := endings.get(behind)) is None:
                if behind in beginnings:
                    found = endings[behind] = self._ending(behind)
                    break
                behind = behind[1:]
            k = start + 1 - done
            top, first, piece = low, start, -1
            # Of equal sums the first start, that is the longer last piece, stays; a piece is never worse than its bytes.
            for size, i, value in found:
                at = k - size
                if at < 0 or (score := best[at] + value) <= top:
                    continue
                # Only a piece that would change something is asked whether it may stand there.
                if ranked and (left := last[at]) >= 0:
                    fits = beside.get((left, i))
                    if not (self._may_follow(left, i) if fits is None else fits):
                        continue
                top, first, piece = score, start + 1 - size, i
                if ranked and top == 0.0:  # no sum of ranked pieces is greater
                    break
            if not ranked or (top < 0.0 and c not in pieces):  # there a character with a piece is never spelled
                spelled = best[k - 1] + BYTE_SCORE * (3 if c == "\0" and text[start] == SPACE else len(c.encode("utf-8", "replace")))
                if spelled > top:
                    top, first, piece = spelled, start, -1
            best.append(top)
            back.append(first)
            last.append(piece)
            if k >= check and k % check == 0:
                # Each path to come passes one of the last positions that are reached.
                live = {p for p in range(max(0, k + 1 - longest), k + 1) if best[p] > low}
                while len(live) > 1:  # step back from the latest until all paths meet
                    p = max(live)
                    live.remove(p)
                    live.add(back[p] - done)
                (meet,) = live
                if meet:
                    yield path(done + meet)
                    best, back, last, done = best[meet:], back[meet:], last[meet:], done + meet
        if len(shown) > done:
            yield path(len(shown))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids (uint32) of a text, by one search over all of it."""
        return np.array([i for part in self.stream(" " + text) for i in part] if text else [], dtype="<u4")

    def encode_all(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow string array without nulls, one text after the other, and where each text's begin (and the last end).

        Where each word start is a point of commitment, the search runs from one to
        the next, and what it found for a segment (spaces and a word) is remembered.
        """
        if not self.by_word:
            lists = [self.encode(t) for t in column.to_pylist()]
            return np.concatenate([np.zeros(0, dtype="<u4"), *lists]), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        units, offsets = W.arrow_bytes(column)
        made, begins = [np.zeros(0, dtype="<u4")], [np.zeros(1, dtype=np.int64)]
        for a, b in W.slices(offsets, UNITS):
            ids, ends = self._segments(units[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            made.append(ids)
            begins.append(begins[-1][-1] + ends)
        return np.concatenate(made), np.concatenate(begins)

    def _segments(self, units: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts, and where those of each end."""
        full = np.diff(offsets) > 0
        before = np.cumsum(full)  # a space goes in front of every text that isn't empty
        shown = np.full(len(units) + int(before[-1]), 32, dtype=np.uint8)
        shown[np.arange(len(units)) + np.repeat(before, np.diff(offsets))] = units
        stops = offsets[1:] + before
        begin = shown == 32
        begin[1:] &= shown[:-1] != 32
        begin[stops[full][:-1]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(shown)) if len(starts) else starts

        def learn(at: np.ndarray) -> list[list[int]]:
            data = shown.tobytes()
            return [[i for part in self.stream(data[a:b].decode("utf-8", "surrogatepass")) for i in part] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]

        ids, at = self._known.gather(self._known.recall(W.hashes(shown, starts, ends), self.CACHE, learn))
        return ids, at[np.searchsorted(starts, stops)]

    def decode(self, ids) -> str:
        """The text of ids; broken byte sequences become U+FFFD."""
        raw = self.raw
        return b"".join([raw[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode("utf-8", "replace")[1:] if len(ids) else ""


_models: dict[str, Pieces] = {}


def _model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _split(texts: list[str | None], path: str) -> list[np.ndarray]:
    """The ids of every text."""
    import pyarrow as pa

    ids, begins = _model(path).encode_all(pa.array([t or "" for t in texts], type=pa.string()))
    return np.split(ids, begins[1:-1]) if texts else []


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids (array<int>) of its texts."""
    return appended(df, text, f"`{ids}` array<int>", lambda texts: [[x.astype(np.int32) for x in _split(texts, path)]])


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """df with the texts of its ids."""
    return appended(df, ids, f"`{text}` string", lambda rows: [[_model(path).decode(r or ()) for r in rows]])


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the digest of what they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")

    def digest(texts: list[str | None]) -> list[list]:
        model = _model(path)
        ids = _split(texts, path)
        return [[len(x) for x in ids], [zlib.crc32(x) for x in ids], [hashlib.sha256(model.decode(x).encode()).hexdigest() for x in ids]]

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return appended(docs, "text", "n_ids long, ids_crc32 long, decoded_sha256 string", digest).select("doc_id", "n_ids", "ids_crc32", "decoded_sha256")


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
ORACLES: dict[str, str] = {}
