"""Toxic passages as maximum-scoring segments of token log-odds.

A token's score is the log-odds of its rates in toxic and other training texts, each class's rates being the posterior mean
under a Dirichlet prior over the vocabulary. The prior of prefixes (five letters) is even between the classes; a word's
pseudo-counts lean to the class that its prefix leans to. A drift makes ordinary text score below zero, so the linear
Ruzzo-Tompa scan yields every maximal segment. The best segment's score is calibrated by its extreme-value law
(Karlin-Altschul: E = K * length * exp(-lambda * score)), and a logistic curve over it gives a probability.

The fit reads a bounded sample, ``train_rows`` labelled rows at most (half of them per class), chosen by a hash of the doc_id, and keeps
``vocabulary`` tokens at most, so what is broadcast has a fixed bound. Scoring reads every row and whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.llm.common import bounded, written

TOKEN = re.compile(r"[^\W\d_]+")
PREFIX, STRENGTH, DRIFT = 5, 2.0, 0.5
#: Token scores are counted in steps of 1/STEPS.
STEPS = 1024
#: A passage is reported if so many are expected by chance in a text of its length.
PASSAGE_E = 0.01


def folded(text: str) -> str:
    """Lower case, character by character where that would change the length, so that positions hold."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(folded(text)) if text else []


def ruzzo_tompa(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), in order of start.

    Neighbouring positive scores always share a segment, so the scan steps over their runs.
    """
    up = scores > 0
    if not up.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate(([False], up, [False])).astype(np.int8)))
    total = np.concatenate(([0.0], np.cumsum(scores)))
    out: list[list[float]] = []  # left sum, right sum, start, end
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        left, right, start = total[a], total[b], a
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][0] >= left:
                j -= 1
            if j < 0 or out[j][1] >= right:
                break
            left, start = out[j][0], out[j][2]
            del out[j:]
        out.append([left, right, start, b])
    return [(int(s), int(e), float(r - x)) for x, r, s, e in out]


class Weights(dict):
    """token -> score; unknown words get their prefix's, and are remembered up to a bound."""

    def __init__(self, known: dict[str, float], most: int = 300_000):
        super().__init__(known)
        self.known, self.most = known, most

    def __missing__(self, word: str) -> float:
        if len(self) > self.most + len(self.known):
            self.clear()
            self.update(self.known)
        w = self[word] = self.known.get(word[:PREFIX] + "*", -DRIFT)
        return w


def posterior(y: np.ndarray, n: float, alpha: np.ndarray) -> np.ndarray:
    """Mean rates of tokens with counts y of n in all, under a Dirichlet prior with pseudo-counts alpha."""
    return (y + alpha) / (n + alpha.sum())


def fit_weights(table: list[tuple[str, float, float]], n1: float, n0: float) -> dict[str, float]:
    """token -> score, from its counts in toxic and other texts that have n1 and n0 tokens; prefixes end in ``*``.

    A class's pseudo-counts are in proportion to its tokens, so that what was never seen scores no more than the drift.
    """
    part1, part0 = 2 * n1 / max(n1 + n0, 1), 2 * n0 / max(n1 + n0, 1)

    def odds(rows, lean):
        y1, y0 = (np.array([r[k] for r in rows], float) for k in (1, 2))
        return np.log(posterior(y1, n1, 2 * STRENGTH * part1 * lean)) - np.log(posterior(y0, n0, 2 * STRENGTH * part0 * (1 - lean)))

    prefixes, words = [r for r in table if r[0].endswith("*")], [r for r in table if not r[0].endswith("*")]
    score = dict(zip((r[0] for r in prefixes), odds(prefixes, np.full(len(prefixes), 0.5)).tolist(), strict=True))
    lean = 1 / (1 + np.exp(-np.array([score.get(t[:PREFIX] + "*", 0.0) for t, _, _ in words])))
    score |= dict(zip((r[0] for r in words), odds(words, lean).tolist(), strict=True))
    return {t: x - DRIFT for t, x in score.items()}


def scores_of(words: list[str], weights: Weights) -> np.ndarray:
    return np.fromiter(map(weights.__getitem__, words), np.float64, len(words))


def root_of(score: np.ndarray, n: np.ndarray) -> float:
    """lambda with E[exp(lambda s)] = 1 over tokens of ordinary texts: scores and how often each occurs."""
    score, n = np.append(score, [-DRIFT, DRIFT / 2]), np.append(n, [1.0, 1.0])
    lo, hi = 1e-3, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.average(np.exp(np.minimum(mid * score, 500)), weights=n) < 1 else (lo, mid)
    return min(max(lo, 0.05), 5.0)


def extreme_value(scored: DataFrame) -> tuple[float, float]:
    """lambda and ln K from all ordinary training texts, by aggregates: the distribution of token scores, and Gumbel's mean of the best segments."""

    def tally(batches):
        for batch in bounded(batches, 0):
            flat = np.concatenate([np.empty(0, np.float32), *(np.frombuffer(x, np.float32) for x in batch.column(0).to_pylist())])
            keys, n = np.unique(np.rint(flat.astype(float) * STEPS).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n, pa.int64())], ["k", "n"])

    def best(batches):
        for batch in bounded(batches, 0):
            x = [np.frombuffer(b, np.float32).astype(float) for b in batch.column(0).to_pylist()]
            x = [(max((s for _, _, s in ruzzo_tompa(f)), default=0.0), math.log(len(f))) for f in x if len(f)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in x], pa.float64()) for c in (0, 1)], ["best", "length"])

    plain = scored.filter("y = 0").select("scores")
    rows = plain.mapInArrow(tally, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").collect()  # as many as there are steps between the extreme scores
    lam = root_of(np.array([r.k / STEPS for r in rows]), np.array([float(r.n) for r in rows]))
    mean = plain.mapInArrow(best, "best double, length double").agg(F.avg("best").alias("best"), F.avg("length").alias("length")).head()
    return lam, (lam * mean.best - mean.length if mean.best is not None else 0.0) - np.euler_gamma


def evidence(segments, n: int, lam: float, ln_k: float) -> tuple[float, float]:
    """Of a text of n tokens: the best segment's calibrated score, and the sum over its significant ones (log scale)."""
    floor = ln_k + math.log(n + 1)
    over = [lam * s - floor for _, _, s in segments]
    return min(max(over, default=-floor), 60.0), math.log1p(sum(x for x in over if x > -math.log(PASSAGE_E)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: float = 1.0) -> np.ndarray:
    """Newton's method with an L2 penalty; x without the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - weight * beta
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + weight * np.eye(len(beta)), grad)
    return beta


def training_rows(labels: DataFrame, train_rows: int, holdout: int) -> DataFrame:
    """(doc_id, y, fold): train_rows / 2 of each class at most, none held out; one row a doc_id."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y")).filter(~held_out(holdout))
    some = lambda y: rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows // 2)
    return some(1).union(some(0)).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int"))


def held_out(holdout: int = 5):
    """Rows that labels are never learned from; a null doc_id has no label and is none of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % holdout == 0, F.lit(False))


class ToxicityModel:
    """Fitted weights, extreme-value law and logistic curve; small enough to be shipped with each task."""

    def __init__(self, weights, lam, ln_k, beta):
        self.weights, self.lam, self.ln_k, self.beta = weights, lam, ln_k, beta

    def judge(self, text: str | None, weights: Weights):
        """(probability, significant passages as (start, end, score) in tokens)."""
        words = tokens(text)
        segments = ruzzo_tompa(scores_of(words, weights))
        x = evidence(segments, len(words), self.lam, self.ln_k)
        z = self.beta[0] + self.beta[1] * x[0] + self.beta[2] * x[1]
        floor = self.ln_k + math.log(len(words) + 1) - math.log(PASSAGE_E)
        return 1 / (1 + math.exp(-min(max(z, -30), 30))), [s for s in segments if self.lam * s[2] >= floor]


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, vocabulary: int = 100_000, holdout: int = 5) -> ToxicityModel:
    """Learns from labelled rows that aren't held out. Without rows of both classes every text gets the base rate."""
    chosen = written(training_rows(labels, train_rows, holdout), "train-rows")
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    sample = written(sample.select("fold", "y", "text"), "train-texts")

    def count(batches):
        for batch in bounded(batches, 2, 8 << 20):
            c = Counter()
            for fold, y, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                words = tokens(text)
                c.update((w, fold, y) for w in words)
                c.update((w[:PREFIX] + "*", fold, y) for w in words)
                c[("", fold, y)] += len(words)
            keys = list(c)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([2 * k[1] + k[2] for k in keys], pa.int32()), pa.array(list(c.values()), pa.int64())], ["token", "cell", "n"])

    cells = [F.sum(F.when(F.col("cell") == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(4)]
    table = sample.mapInArrow(count, "token string, cell int, n long").groupBy("token").agg(*cells)
    toxic, other = F.col("c1") + F.col("c3"), F.col("c0") + F.col("c2")
    table = written(table.withColumns({"y1": toxic, "y0": other}).filter("token = '' or y1 + y0 > 1"), "counts")
    size = table.filter("token = ''").head()
    if size is None or not size["y1"] or not size["y0"]:
        n = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
        rate = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
        return ToxicityModel({}, 1.0, 0.0, [math.log(rate / (1 - rate)), 0.0, 0.0])
    rate1, rate0 = (F.col("y1") + 0.5) / float(size["y1"]), (F.col("y0") + 0.5) / float(size["y0"])
    telling = F.abs(F.log(rate1 / rate0)) * F.sqrt(F.col("y1") + F.col("y0"))
    top = table.filter("token <> ''").orderBy(F.desc(telling), "token").limit(vocabulary).collect()

    def of_folds(folds):
        pick = lambda r, y: sum(r[f"c{2 * f + y}"] for f in folds)
        return fit_weights([(r["token"], pick(r, 1), pick(r, 0)) for r in top], pick(size, 1), pick(size, 0))

    by_fold = [of_folds([1]), of_folds([0])]  # each fold is scored by what the other taught

    def features(batches):
        own = [Weights(w) for w in by_fold]
        for batch in bounded(batches, 2):
            y, s = [], []
            for fold, label, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                y.append(label)
                s.append(scores_of(tokens(text), own[fold]).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array([x.tobytes() for x in s], pa.binary())], ["y", "scores"])

    scored = written(sample.mapInArrow(features, "y int, scores binary"), "train-scores")
    lam, ln_k = extreme_value(scored)

    def gather(batches):
        for batch in bounded(batches, 1):
            x = [(f := np.frombuffer(b, np.float32).astype(float), evidence(ruzzo_tompa(f), len(f), lam, ln_k))[1] for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64())], ["y", "best", "more"])

    rows = np.array(sorted(tuple(r) for r in scored.mapInArrow(gather, "y int, best double, more double").collect()), float)  # train_rows at most
    return ToxicityModel(of_folds([0, 1]), lam, ln_k, fit_logistic(rows[:, 1:], rows[:, 0]).tolist())


def scored(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, passages) of every row; passages are (start, end, score), in characters of the text.

    A null or empty text has no token and gets the score that the curve gives to no evidence. Rows are scored one by one,
    so repeated rows and null doc_ids are of no concern.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shipped.value
        weights = Weights(m.weights)
        for batch in bounded(batches, 1):
            score, passages = [], []
            for text in batch.column(1).to_pylist():
                p, found = m.judge(text, weights)
                at = [x.span() for x in TOKEN.finditer(folded(text))] if found else []
                score.append(p)
                passages.append([{"start": at[a][0], "end": at[b - 1][1], "score": s} for a, b, s in found])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"])

    cols = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return cols.mapInArrow(run, "doc_id long, score double, passages array<struct<start:int,end:int,score:double>>")


def accepted(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below 0.5.

    Null, empty and blank texts have no evidence against them and stay, unless the fit had toxic rows only; repeated rows
    stay or go together; a score of exactly 0.5 goes; an empty table stays empty. Other columns don't matter.
    """
    at = docs.columns.index(text)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shipped.value
        weights = Weights(m.weights)
        for batch in bounded(batches, at):
            yield batch.filter(pa.array([m.judge(t, weights)[0] < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, learned from the labels that aren't held out; n_passages: its significant passages."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("bigint").alias("n_passages"))
