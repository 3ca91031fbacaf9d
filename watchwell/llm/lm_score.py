"""Language-model scores: a word-count base and a gated recurrent model.

Tokens are the words of a text with A-Z lower-cased, words being runs of other
characters than space, tab, line feed, vertical tab, form feed and carriage
return, then one end token. Counts cover all tokens of all training documents.

The recurrent model (see gru) knows the ``n_words`` most frequent tokens one by
one. Other tokens of the head (``head_words`` at most, by count) fall into bands
of about equal weight, and all the rest into the last band; inside a band a
token's probability is its share of the band's counts, smoothed like the base, so
the model gives every token, seen or not, a probability.

Training reads all of every training text, in windows with the state carried
along. Texts are dealt to trainers by their content, one trainer for each
``trainer_tokens`` training tokens, and to ``rounds`` parts; in a round every trainer
begins from the same parameters and reads its texts of one part, and Spark averages
the results, weighted by tokens. So the model depends on the texts alone, not on how
the input was partitioned.

Only the head is broadcast, a table of ``head_words`` rows at most; its words are
found by 64-bit hashes (a word outside the head passes for one inside with
probability 1e-14). Tokens of the tail are joined to their counts by a shuffle and
summed per document.

Edge cases: null and empty texts are one end token; a null doc_id counts as the
empty text for the split into training and held-out documents; rows that share a
doc_id are scored each; very long texts run through windows with the state carried
along; without training documents every count is 0; other columns are ignored
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchwell.llm import gru
from watchwell.llm import words as W
from watchwell.llm.common import bucket_of, stored, table

END = ""  # no word is empty
#: Documents that are scored side by side, and bytes of text that are worked on in one go.
ROWS, UNITS = 4096, 1 << 17
#: Distinct words that a counting task holds at most.
HELD = 1 << 19
#: Texts of more tokens go first in training, so that none is left to run alone at the end.
LONG = 2048
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.ones(256, dtype=bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False


def _parts(column) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Lower-cased bytes, word starts, word ends and words before each text, of slices of an Arrow string array."""
    units, offsets = W.arrow_bytes(column)
    for a, b in W.slices(offsets, UNITS):
        part = _LOWER[units[offsets[a] : offsets[b]]]
        yield part, *W.spans(part, offsets[a : b + 1] - offsets[a], _INSIDE)


def _gathered(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words, one after the other, and the size of each."""
    sizes = ends - starts
    return units[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())], sizes


def _strings(pieces: list[tuple[np.ndarray, np.ndarray]]):
    """An Arrow string array of gathered words."""
    import pyarrow as pa

    data = np.concatenate([np.zeros(0, dtype=np.uint8), *(x for x, _ in pieces)])
    ends = np.cumsum(np.concatenate([[0], *(n for _, n in pieces)])).astype(np.int32)
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data))


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c) over all training texts, the end token included as the empty word."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index, counts, pieces = W.Index(), np.zeros(1024, dtype=np.int64), []

        def flush():
            return pa.RecordBatch.from_arrays([_strings(pieces), pa.array(counts[: len(index)])], names=["word", "c"])

        for batch in batches:
            for units, starts, ends, _ in _parts(batch.column(0)):
                h = W.hashes(units, starts, ends)
                at = index.find(h)
                new = np.flatnonzero(at < 0)
                if len(new):
                    fresh, first = np.unique(h[new], return_index=True)
                    first = new[first]
                    pieces.append(_gathered(units, starts[first], ends[first]))
                    counts = W.room(counts, len(index), len(fresh))
                    counts[len(index) : len(index) + len(fresh)] = 0
                    index.add(fresh)
                    at = index.find(h)
                places, n = np.unique(at, return_counts=True)
                counts[places] += n
                if len(index) > HELD:
                    yield flush()
                    index, counts, pieces = W.Index(), np.zeros(1024, dtype=np.int64), []
        if len(index):
            yield flush()

    texts = train.select(F.coalesce("text", F.lit("")).alias("text"))
    words = texts.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))
    ends = train.agg(F.count("*").alias("c")).filter("c > 0").select(F.lit(END).alias("word"), "c")
    return words.unionByName(ends)


class Lexicon:
    """The head of the vocabulary as symbols, and the totals of all of it."""

    def __init__(self, head: list[tuple[str, int]], total: int, distinct: int, n_words: int, n_bands: int):
        """head: (word, count) by falling count; the end token need not be in it."""
        self.total, self.distinct = total, distinct
        counts = {w: c for w, c in head}
        end = counts.pop(END, 0)
        ranked = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
        words = sorted([(END, end), *ranked[:n_words]], key=lambda x: (-x[1], x[0]))
        rest = ranked[n_words:]
        mass = np.array([c for _, c in rest], dtype=float) + 0.1
        share = (np.cumsum(mass) - mass / 2) / max(mass.sum(), 1e-9)
        band = np.minimum((share * n_bands).astype(int), n_bands - 1)
        self.n_words, self.tail = len(words), len(words) + n_bands
        weights = np.zeros(self.tail + 1)
        weights[: self.n_words] = [c + 0.1 for _, c in words]
        np.add.at(weights, self.n_words + band, mass)
        # Unseen tokens share 0.1 in the tail.
        seen_tail, kinds_tail = total - end - sum(counts.values()), distinct - (end > 0) - len(counts)
        weights[self.tail] = seen_tail + 0.1 * (kinds_tail + 1)
        self.weights = weights
        #: By place in the head; the last place is that of the tail.
        self.words = [w for w, _ in words] + [w for w, _ in rest]
        self.symbol = np.concatenate([np.arange(self.n_words), self.n_words + band, [self.tail]]).astype(np.int64)
        self.log_count = np.log10(np.array([c for _, c in words] + [c for _, c in rest] + [0.9]) + 0.1)
        self.end, self.known_end = self.words.index(END), int(end > 0)
        self._index: W.Index | None = None
        #: log10 of a band's weight; tokens of the words' symbols have none.
        self.log_band = np.where(np.arange(self.tail + 1) < self.n_words, 0.0, np.log10(np.maximum(weights, 1e-9)))
        self.log_base = math.log10(total + 0.1 * (distinct + 1))

    def places(self, units: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place in the head of every token of texts, end tokens included, and where each text's begin."""
        if self._index is None:
            pieces = [np.frombuffer(w.encode(), dtype=np.uint8) for w in self.words]
            stops = np.cumsum([len(x) for x in pieces])
            self._index = W.Index(W.hashes(np.concatenate(pieces), np.concatenate([[0], stops[:-1]]), stops))
        n = len(first) - 1
        out, begins = np.full(len(starts) + n, self.end, dtype=np.int64), first + np.arange(n + 1)
        at = self._index.find(W.hashes(units, starts, ends))
        out[np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(first))] = np.where(at < 0, len(self.words), at)
        return out, begins


def lexicon(counts: DataFrame, head_words: int, n_words: int, n_bands: int) -> Lexicon:
    """The lexicon of stored counts (word, c)."""
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    level = F.floor(F.log2("c") * 16).cast("int")
    steps = sorted(((r.level, r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    cut, size = None, 0
    for at, n in steps:  # as many levels of counts as fit
        if size + n > head_words:
            break
        cut, size = at, size + n
    head = counts.filter(level >= cut).collect() if cut is not None else []
    end = [] if any(r.word == END for r in head) else counts.filter(F.col("word") == END).collect()
    return Lexicon([(r.word, r.c) for r in [*head, *end]], sums.n, sums.v, n_words, n_bands)


def encoded(train: DataFrame, shared) -> DataFrame:
    """(symbols, n) of every training text: of all tokens, the end token included, two bytes each."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lex: Lexicon = shared.value
        for batch in batches:
            for part in _parts(batch.column(0)):
                places, begins = lex.places(*part)
                symbols = lex.symbol[places].astype("<u2")
                made = pa.BinaryArray.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer((2 * begins).astype(np.int32)), pa.py_buffer(symbols)])
                yield pa.RecordBatch.from_arrays([made, pa.array(np.diff(begins))], names=["symbols", "n"])

    return train.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "symbols binary, n long")


def _summed(made: DataFrame, groups: int) -> DataFrame:
    """(trainer, n, p) of rows (trainer, n, p) of weights and binary vectors: their sums, in so many groups, whose numbers stand for trainers."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        n, total = 0.0, None
        for batch in batches:
            for own, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = np.frombuffer(p)
                n, total = n + own, x if total is None else total + x
        if total is not None:
            row = ([TaskContext.get().partitionId()], [n], [total.tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["trainer", "n", "p"])

    dealt = made.repartitionById(groups, F.pmod("trainer", F.lit(groups)).cast("int"))
    return dealt.sortWithinPartitions("trainer").mapInArrow(run, "trainer long, n double, p binary")


def _averaged(texts: DataFrame, trainers: int, shared, model: gru.Model, rate: float, batch: int) -> np.ndarray:
    """The parameters after one round: each trainer's, averaged by tokens."""
    start, shape = model.flat(), model.shape

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        lex: Lexicon = shared.value
        own = gru.Model(shape, lex.weights).load(start)
        n = gru.train(own, (np.frombuffer(x, dtype="<u2").astype(np.int64) for batch in batches for x in batch.column(0).to_pylist()), lex.end, rate=rate, batch=batch)
        if n:
            row = ([TaskContext.get().partitionId()], [float(n)], [(own.flat().astype(float) * n).tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["trainer", "n", "p"])

    dealt = texts.repartitionById(trainers, F.pmod("at", F.lit(trainers)).cast("int"))
    order = (F.when(F.col("n") > LONG, -F.col("n")).otherwise(0), "at", "symbols")
    made = dealt.sortWithinPartitions(*order).select("symbols").mapInArrow(run, "trainer long, n double, p binary")
    if trainers > 16:
        made, groups = stored(made, "lm-trained"), trainers
        while groups > 16:  # sums of 64 at a time, so that neither a task nor the driver gets all
            groups = -(-groups // 64)
            made = stored(_summed(made, groups), "lm-sums")
    sums = [(r.n, np.frombuffer(bytes(r.p))) for r in made.select("n", "p").collect()]
    if not sums:
        return start
    return (sum(p for _, p in sums) / sum(n for n, _ in sums)).astype(start.dtype)


def fit(
    train: DataFrame, head_words: int = 200_000, n_words: int = 1023, n_bands: int = 12, word_classes: int = 32, hidden: int = 16, rounds: int = 2, epochs: int = 1, trainer_tokens: int = 4_000_000, rate: float = 0.02
) -> tuple[DataFrame, Lexicon, gru.Model]:
    """Counts (stored), lexicon and trained model from training documents (doc_id, text).

    Every text is read ``epochs`` times, in one of ``rounds`` parts each time.
    """
    counts = stored(word_counts(train), "lm-counts")
    lex = lexicon(counts, head_words, n_words, n_bands)
    shape = gru.Shape.of(lex.weights, lex.n_words, word_classes, hidden)
    model = gru.Model(shape, lex.weights)
    shared = train.sparkSession.sparkContext.broadcast(lex)
    texts = stored(encoded(train, shared).withColumn("at", F.xxhash64("symbols")), "lm-symbols")
    trainers = max(1, -(-lex.total // (trainer_tokens * rounds)))
    # Some hundred moves of the parameters for every trainer, of 2,048 symbols at most.
    batch = min(2048, max(32, lex.total // (trainers * rounds * 100)))
    for epoch in range(epochs):
        for k in range(rounds):
            part = texts.filter(F.pmod(F.xxhash64("at"), F.lit(rounds)) == k)
            model.load(_averaged(part, trainers, shared, model, rate / (1 + epoch * rounds + k), batch))
    return counts, lex, model


def score(docs: DataFrame, counts: DataFrame, lex: Lexicon, model: gru.Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    flat, shape = model.flat(), model.shape

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lex: Lexicon = shared.value
        own, tail = gru.Model(shape, lex.weights).load(flat), len(lex.words)
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                symbols, n, n_tail, base, inside, words = [], [], [], [], [], []
                for units, starts, ends, first in _parts(batch.column(2)):
                    places, begins = lex.places(units, starts, ends, first)
                    own_symbols, logs, rare = lex.symbol[places], lex.log_count[places], places == tail
                    symbols += np.split(own_symbols, begins[1:-1])
                    n.append(np.diff(begins))
                    n_tail.append(np.add.reduceat(rare, begins[:-1], dtype=np.int64))
                    base.append(np.add.reduceat(logs, begins[:-1]))
                    inside.append(np.add.reduceat(np.where(own_symbols >= lex.n_words, logs, 0.0) - lex.log_band[own_symbols], begins[:-1]))
                    at = np.flatnonzero(rare)
                    at -= np.searchsorted(begins, at, side="right") - 1  # without the end tokens before
                    words.append(_gathered(units, starts[at], ends[at]))
                n, n_tail, base, inside = map(np.concatenate, (n, n_tail, base, inside))
                scores = gru.log_likelihood(own, symbols, lex.end, rows=ROWS) / math.log(10) + inside
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_tail)]).astype(np.int32)), _strings(words))
                numbers = [pa.array(x) for x in (n, n - n_tail - (1 - lex.known_end), base - n * lex.log_base, scores)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, lists], names=["row", "doc_id", "n_tokens", "known", "base", "model", "tail"])

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(texts.mapInArrow(run, "row long, doc_id long, n_tokens long, known long, base double, model double, tail array<string>"), "lm-rows")
    tail = rows.select("row", F.explode("tail").alias("word")).groupBy("row", "word").agg(F.count("*").alias("k"))
    c = F.coalesce("c", F.lit(0))
    sums = tail.join(counts, "word", "left").groupBy("row").agg(F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("tail_known"), F.sum(F.col("k") * F.log10(c + F.lit(0.1))).alias("tail_log"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return rows.join(sums, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + zero("tail_known")).cast("long").alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("tail_log")).alias("base_score"),
        (F.col("model") + zero("tail_log")).alias("score"),
    )


def op8_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, *fit(docs.filter(bucket_of(F.col("doc_id"), 10) != 0)))
    return scored.select("doc_id", (bucket_of(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op8_gru_scores": op8_gru_scores}
ORACLES: dict[str, str] = {}
