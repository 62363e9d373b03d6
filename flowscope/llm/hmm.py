"""A hidden Markov language model over words: how likely is a text?

The words of all training texts are counted. What a state emits is a symbol: the end of the text, one of the most frequent
words (``vocabulary`` at most), or the class that a rarer or unknown word's last two bytes fall in; within its class a rare
word has its smoothed share of the class's occurrences, whatever the state. So the model's tables have a fixed bound while
every word's own count takes part: tasks know the counts of the ``at_hand`` most frequent words at most, those of all others
are joined by word. A class keeps the share of one more word, as the base score does, for all unknown ones.

Baum-Welch: tasks run forward and backward over stretches of training texts and give expected counts by symbol and state,
which Spark sums; ``warm_rounds`` rounds each take another part of all training texts, ``full_rounds`` take all. Scoring is
the scaled forward recursion over each whole text, in blocks of time steps for many texts at once.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.llm.common import bounded, pieces, white_cut, written

#: Added to every count, as in the base score.
ADDED = 0.1
#: Buckets of counts to a doubling, by which the vocabulary's least count is found; words seen less than LEAST are never in it.
FINE, LEAST = 16, 3
CLASSES = 512
END = b""
#: Tokens of a training sequence at most, and tokens that a task works on at a time.
STRETCH, TOKENS = 1024, 300_000
#: Pseudo-counts of the overall rates in each state, and of each transition; probability of staying in a state at first.
PRIOR, TURN, STAY = 100.0, 1.0, 0.9
SEED = 20


def held_out(holdout: int = 10):
    """Rows that nothing is learned from; a null doc_id is none of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % holdout == 0, F.lit(False))


def words_of(text: bytes | None):
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, in lists of bounded size."""
    for part in white_cut(text or b""):
        yield part.lower().split()


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def class_column(word: str = "word"):
    """``word_class`` as a column."""
    return (F.crc32(F.expr(f"substring({word}, greatest(length({word}) - 1, 1), 2)")) % CLASSES).cast("int")


def counted(texts: DataFrame, most: int = 300_000) -> DataFrame:
    """(word, c) over all rows of ``texts`` (text as binary); the empty word stands for the end of a text."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in bounded(batches, 0):
            for text in batch.column(0).to_pylist():
                for words in words_of(text):
                    seen.update(words)
                seen[END] += 1
            if len(seen) > most:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Vocabulary:
    """Symbols of words and their counts; all of bounded size but for the numbers ``total`` and ``distinct``."""

    def __init__(
        self, words: list[tuple[bytes, int]], at_hand: dict[bytes, int], ends: int, class_n: np.ndarray, class_words: np.ndarray, size: tuple[int, int]
    ):
        self.total, self.distinct = size
        self.ends, self.at_hand = ends, at_hand
        self.words = {w: i + 1 for i, (w, _) in enumerate(words)}
        self.class_n, self.class_words = class_n, class_words
        self.first_class = len(words) + 1
        self.size = self.first_class + CLASSES
        #: Occurrences of each symbol.
        self.counts = np.concatenate(([float(ends)], [float(c) for _, c in words], class_n))
        #: log10 of what a rare word's ADDED count is divided by, by class.
        self.class_log = np.log10(class_n + ADDED * (class_words + 1))
        self.base_log = math.log10(self.total + ADDED * (self.distinct + 1))

    def base(self, count):
        """log10 of the base score's probability of tokens with these counts."""
        return np.log10(count + ADDED) - self.base_log

    @staticmethod
    def of(counts: DataFrame, vocabulary: int, at_hand: int) -> Vocabulary:
        """From a written table (word, c): the words with the largest counts, all with the same count or none, ``vocabulary`` at
        most, and after them those that tasks know the counts of, ``at_hand`` at most."""
        own = F.col("word") != F.lit(bytearray(END))
        bucket = F.floor(F.log2("c") * FINE).alias("bucket")
        sizes = counts.filter(own & (F.col("c") >= LEAST)).groupBy(bucket).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()
        sizes.sort(key=lambda r: -r.bucket)  # as many as there are buckets in 64 doublings
        above = lambda most: min((r.least for r, n in zip(sizes, np.cumsum([r.n for r in sizes]), strict=True) if n <= most), default=None)
        from_ = lambda least: F.lit(False) if least is None else F.col("c") >= least
        often, some = from_(above(vocabulary)), from_(above(vocabulary + at_hand))
        words = [(bytes(r.word), r.c) for r in counts.filter(own & often).orderBy(F.desc("c"), "word").collect()]
        more = {bytes(r.word): r.c for r in counts.filter(own & some & ~often).collect()}
        class_n, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in counts.filter(own & ~often).groupBy(class_column().alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("words")).collect():
            class_n[r.k], class_words[r.k] = r.n, r.words
        size = counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(~own, F.col("c")))).head()
        return Vocabulary(words, more, size[2] or 0, class_n, class_words, (size[0] or 0, size[1]))


class Symbols(dict):
    """word -> symbol; rare words are remembered up to a bound."""

    def __init__(self, vocabulary: Vocabulary, most: int = 200_000):
        super().__init__(vocabulary.words)
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most + len(self.vocabulary.words):
            self.clear()
            self.update(self.vocabulary.words)
        s = self.vocabulary.first_class + word_class(word)
        if len(word) <= 64:
            self[word] = s
        return s


def encoded(docs: DataFrame, vocabulary: Vocabulary, holdout: int) -> DataFrame:
    """(row, doc_id, held_out, n_tokens, known, base, inner, symbols, rare) of every row; written, so that ``row`` stays the same.

    ``known``, ``base`` and ``inner``, the log of words' shares of their classes, are of the tokens whose counts are at hand;
    ``rare`` has the others and how often the text has them. Symbols are little-endian 32-bit numbers, the last one the end.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)
    cols = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), held_out(holdout).alias("held_out"),
        F.col("text").cast("binary").alias("text"),
    )

    def run(batches):
        v = shipped.value
        known, base, first = Symbols(v), v.base(v.counts[: v.first_class]), v.first_class
        for batch in bounded(batches, 3):
            n, n_known, base_sum, inner, symbols, rare = [], [], [], [], [], []
            for text in batch.column(3).to_pylist():
                found, odd = [], Counter()
                for words in words_of(text):
                    s = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
                    odd.update(words[i] for i in np.flatnonzero(s >= first).tolist())
                    found.append(s)
                s = np.concatenate([*found, np.zeros(1, np.int32)])
                often = s[s < first]
                near = [(w, k, v.at_hand[w]) for w, k in odd.items() if w in v.at_hand]
                times, log = np.array([k for _, k, _ in near], float), np.log10(np.array([c for *_, c in near], float) + ADDED)
                for w, _, _ in near:
                    del odd[w]
                n.append(len(s))
                n_known.append(len(often) - (not v.ends) + int(times.sum()))
                base_sum.append(float(base[often].sum() + times @ (log - v.base_log)))
                inner.append(float(times @ (log - v.class_log[[word_class(w) for w, _, _ in near]])) if near else 0.0)
                symbols.append(s.astype("<i4").tobytes())
                rare.append(odd)
            at = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in rare]))), pa.int32())
            entries = pa.StructArray.from_arrays(
                [pa.array([w for x in rare for w in x], pa.binary()), pa.array([k for x in rare for k in x.values()], pa.int64())], ["word", "n"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(n_known, pa.int64()),
                    pa.array(base_sum, pa.float64()), pa.array(inner, pa.float64()), pa.array(symbols, pa.binary()), pa.ListArray.from_arrays(at, entries),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "known", "base", "inner", "symbols", "rare"],
            )

    kind = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, inner double, symbols binary"
    return written(cols.mapInArrow(run, f"{kind}, rare array<struct<word:binary,n:long>>"), "symbols")


def rare_sums(coded: DataFrame, counts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(row, rare_known, rare_base, within): each text's rare words by their own counts, joined by word.

    No frequent word is among them, so no key is hot.
    """
    spark = coded.sparkSession
    below = spark.createDataFrame([(k, float(x)) for k, x in enumerate(vocabulary.class_log)], "class int, below double")
    words = coded.select("row", F.inline("rare")).join(counts, "word", "left").withColumn("class", class_column())
    words = words.join(F.broadcast(below), "class")
    own = F.log10(F.coalesce("c", F.lit(0)) + ADDED)
    return words.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * (own - vocabulary.base_log)).alias("rare_base"),
        F.sum(F.col("n") * (own - F.col("below"))).alias("within"),
    )


class Model:
    """Start and transition probabilities, and what each symbol's probability is in each state."""

    def __init__(self, start: np.ndarray, turn: np.ndarray, emit: np.ndarray):
        self.start, self.turn, self.emit = start, turn, emit

    @staticmethod
    def first(rates: np.ndarray, states: int) -> Model:
        """Sticky states that emit nearly the overall rates, each a little differently."""
        noise = np.random.default_rng(SEED).normal(size=(len(rates), states))
        emit = rates[:, None] * np.exp(noise)
        turn = np.full((states, states), (1 - STAY) / max(states - 1, 1))
        np.fill_diagonal(turn, STAY if states > 1 else 1.0)
        return Model(np.full(states, 1 / states), turn, emit / emit.sum(0))

    @staticmethod
    def of_counts(start: np.ndarray, turn: np.ndarray, emit: np.ndarray, rates: np.ndarray) -> Model:
        """From expected counts, smoothed by pseudo-counts."""
        emit = emit + PRIOR * rates[:, None]
        turn, start = turn + TURN, start + TURN
        return Model(start / start.sum(), turn / turn.sum(1, keepdims=True), emit / emit.sum(0))


def by_time(sequences: list[np.ndarray]):
    """Sequences side by side, the longest first: their order, symbols by time step, and where each step begins."""
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    sizes = np.array([len(sequences[i]) for i in order])
    wide = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")  # sequences that have a step
    at = np.concatenate(([0], np.cumsum(wide)))
    out = np.empty(at[-1], np.int32)
    for i, k in enumerate(order.tolist()):
        out[at[: sizes[i]] + i] = sequences[k]
    return order, out, at


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of each sequence's probability, by the scaled forward recursion."""
    order, symbols, at = by_time(sequences)
    total, alpha = np.zeros(len(order)), np.empty(0)
    step, steps = 0, len(at) - 1
    while step < steps:
        to = max(step + 1, int(np.searchsorted(at, at[step] + TOKENS, "right")) - 1)
        emit = model.emit[symbols[at[step] : at[to]]]
        scale = np.empty(len(emit))
        for t in range(step, to):
            a, b = at[t] - at[step], at[t + 1] - at[step]
            alpha = (alpha[: b - a] @ model.turn if t else model.start) * emit[a:b]
            scale[a:b] = alpha.sum(1)
            alpha /= scale[a:b, None]
        width = np.diff(at[step : to + 1])
        of = np.arange(len(scale)) - np.repeat(at[step:to] - at[step], width)
        total += np.bincount(of, np.log(scale), len(total))
        step = to
    out = np.empty(len(total))
    out[order] = total
    return out


def expected_counts(model: Model, sequences: list[np.ndarray]):
    """Baum-Welch's expected counts over sequences of bounded size: (start, transitions, symbols by state)."""
    order, symbols, at = by_time(sequences)
    steps, states = len(at) - 1, len(model.start)
    emit = model.emit[symbols]
    alpha, scale = np.empty_like(emit), np.empty((len(emit), 1), emit.dtype)
    for t in range(steps):
        a, b = at[t], at[t + 1]
        alpha[a:b] = (alpha[at[t - 1] : at[t - 1] + b - a] @ model.turn if t else model.start) * emit[a:b]
        scale[a:b, 0] = alpha[a:b].sum(1)
        alpha[a:b] /= scale[a:b]
    turns = np.zeros((states, states))
    emit /= scale
    beta = np.ones((at[1], states), emit.dtype)
    for t in range(steps - 1, 0, -1):
        a, b, before = at[t], at[t + 1], at[t - 1]
        ahead = emit[a:b] * beta[: b - a]
        turns += alpha[before : before + b - a].T @ ahead
        alpha[a:b] *= beta[: b - a]  # from here on what the states are worth at this step
        beta[: b - a] = ahead @ model.turn.T
    alpha[: at[1]] *= beta
    counts = np.column_stack([np.bincount(symbols, alpha[:, k], len(model.emit)) for k in range(states)])
    return alpha[: at[1]].sum(0), model.turn * turns, counts


def stretches(symbols: np.ndarray):
    """A long sequence in equal parts of at most STRETCH tokens."""
    return np.array_split(symbols, -(-len(symbols) // STRETCH))


def sequences_of(batches, column: int):
    """Lists of sequences with about TOKENS tokens, and the batches they are of."""
    for batch in bounded(batches, column, 4 * TOKENS):
        yield batch, [np.frombuffer(x, "<i4") for x in batch.column(column).to_pylist()]


def improved(model: Model, coded: DataFrame, rates: np.ndarray) -> Model:
    """One round of Baum-Welch over the rows of ``coded``."""
    states = len(model.start)
    single = Model(*(x.astype(np.float32) for x in (model.start, model.turn, model.emit)))
    shipped = coded.sparkSession.sparkContext.broadcast(single)
    names = [f"s{k}" for k in range(states)]

    def run(batches):
        m = shipped.value
        sums = [np.zeros(states), np.zeros((states, states)), np.zeros((len(m.emit), states))]
        for _, found in sequences_of(batches, 0):
            parts = [p for s in found for p in stretches(s)]
            for some in pieces([len(p) for p in parts], TOKENS):
                for total, x in zip(sums, expected_counts(m, parts[some]), strict=True):
                    total += x
        table = np.vstack([sums[0][None, :], sums[1], sums[2]]).astype(np.float32)
        rows = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array(table[rows, k]) for k in range(states))], ["at", *names])

    kind = "at int, " + ", ".join(f"{n} float" for n in names)
    sums = coded.select("symbols").mapInArrow(run, kind).groupBy("at").agg(*(F.sum(n).alias(n) for n in names))
    table = np.zeros((1 + states + len(model.emit), states))
    for r in sums.collect():  # as many as there are symbols
        table[r[0]] = r[1:]
    shipped.unpersist()
    return Model.of_counts(table[0], table[1 : 1 + states], table[1 + states :], rates)


def fit(coded: DataFrame, vocabulary: Vocabulary, states: int = 12, warm_rounds: int = 8, full_rounds: int = 2) -> Model:
    """Trains on all rows of ``coded`` that aren't held out; without any, all states emit the overall rates."""
    rates = vocabulary.counts + ADDED
    rates = rates / rates.sum()
    train = coded.filter("not held_out")
    part = F.pmod(F.xxhash64("row"), F.lit(max(warm_rounds, 1)))
    rounds = [*(train.filter(part == k) for k in range(warm_rounds)), *[train] * full_rounds]
    return reduce(lambda m, rows: improved(m, rows, rates), rounds, Model.first(rates, states))


def likelihoods(coded: DataFrame, model: Model) -> DataFrame:
    """(row, doc_id, held_out, n_tokens, known, base, inner, symbols_log): log10 of each row's symbols under the model."""
    shipped = coded.sparkSession.sparkContext.broadcast(model)
    names = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "inner"]

    def run(batches):
        for batch, found in sequences_of(batches, len(names)):
            log = log_likelihoods(shipped.value, found) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(log)], [*names, "symbols_log"])

    kind = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, inner double, symbols_log double"
    return coded.select(*names, "symbols").mapInArrow(run, kind)


def scored(docs: DataFrame, vocabulary: int = 1 << 14, at_hand: int = 1 << 17, states: int = 12, holdout: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text).

    Scores are log10 probabilities of whole texts; null and empty texts are one token, the end. Rows repeated are trained on
    and scored one by one; a null doc_id is trained on; without training rows nothing is known and every token equally
    likely; an empty table gives no rows. Other columns don't matter.
    """
    texts = docs.filter(~held_out(holdout)).select(F.col("text").cast("binary").alias("text"))
    counts = written(counted(texts), "word-counts")
    words = Vocabulary.of(counts, vocabulary, at_hand)
    coded = encoded(docs, words, holdout)
    model = fit(coded, words, states)
    rows = likelihoods(coded, model).join(rare_sums(coded, counts, words), "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return rows.select(
        "doc_id", "held_out", "n_tokens", plus("known", "rare_known").alias("n_known"), F.lit(words.total).cast("bigint").alias("train_tokens"),
        plus("base", "rare_base").alias("base_score"), (plus("symbols_log", "within") + F.col("inner")).alias("score"),
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores; nine tenths of the documents train the model."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
