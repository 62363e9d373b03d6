"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic); the cells' token weights are raked to the target shares of
each margin in turn until they hold, never above what a cell has. A document is then drawn with its cell's probability.

Topics are learned: documents as weighted bags of words over ``BUCKETS`` hashes, in as many clusters as there are topics,
found by spherical k-means over all documents. The bags are counted and written once, then their unit vectors, many in a
row; each round is a pass over these that sums whole numbers by task and cluster, so the centres don't depend on how the
rows are dealt.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.llm.common import Memo, bounded, join_counted, white_cut, written

DIMS = ("source", "lang", "topic")
#: Up to so many cells are raked on the driver; more are raked by Spark, with the same results.
CELLS_ON_DRIVER = 50_000
BUCKETS = 1024
#: Topic of texts without words.
NO_TOPIC = "none"
#: Unit vectors and centres are whole numbers of this part: their products and sums are exact in any order.
STEPS = 1 << 20
#: Bags that are worked on at a time, and rounds at most.
SPREAD, ROUNDS = 512, 20


class Bags(Memo):
    """word (bytes, case folded) -> bucket."""

    def of_key(self, key: bytes) -> int:
        return xxhash.xxh64_intdigest(key.lower() if key.isascii() else key.decode("utf8", "replace").lower()) % BUCKETS

    def counts(self, text: bytes | None) -> tuple[np.ndarray, int]:
        """The words' counts by bucket, and their sum."""
        n, total = np.zeros(BUCKETS, np.int64), 0
        for part in white_cut(text or b""):
            words = (part.lower() if part.isascii() else part).split()
            n += np.bincount(np.fromiter(map(self.__getitem__, words), np.intp, len(words)), minlength=BUCKETS)
            total += len(words)
        return n, total

    def of(self, text: bytes | None) -> np.ndarray:
        """Square roots of the words' counts by bucket."""
        return np.sqrt(self.counts(text)[0])

    def packed(self, texts) -> tuple[list[bytes], list[bytes], list[int]]:
        """Of each text the buckets it has, their counts, and its number of words."""
        at, n, tokens = [], [], []
        for text in texts:
            counts, total = self.counts(text.as_py())
            own = np.flatnonzero(counts)
            at.append(own.astype(np.uint16).tobytes())
            n.append(counts[own].astype(np.uint32).tobytes())
            tokens.append(total)
        return at, n, tokens


def flat_units(at: list[bytes], n: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bags as weighted unit vectors in STEPS, one after the other: (how many buckets each has, buckets, values); zeros for a bag without weight."""
    sizes = np.array([len(a) // 2 for a in at], np.int64)
    rows = np.repeat(np.arange(len(at)), sizes)
    bucket = np.frombuffer(b"".join(at), np.uint16)
    value = np.sqrt(np.frombuffer(b"".join(n), np.uint32)) * weights[bucket]
    length = np.maximum(np.sqrt(np.bincount(rows, value * value, len(at))), 1e-12)
    return sizes, bucket, np.rint(value / length[rows] * STEPS)


def products(sizes: np.ndarray, bucket: np.ndarray, value: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of flat vectors, none of them empty, the products with each centre, a row each."""
    starts, bucket = np.cumsum(sizes) - sizes, bucket.astype(np.intp)
    return np.stack([np.add.reduceat(value * c.take(bucket, mode="clip"), starts) for c in centres], axis=1)


def centre(sums: np.ndarray) -> np.ndarray:
    """A sum of vectors as one of unit length, in STEPS."""
    sums = sums.astype(float)
    return np.rint(sums / max(np.linalg.norm(sums), 1e-12) * STEPS)


def clusters(rows: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Centres of spherical k-means over unit rows; begun with the row nearest to the mean and then the farthest from those taken, so it repeats.

    Rows in memory: what ``fit_topics`` does over all documents, for tables of that size and for tests.
    """
    first = int(np.argmax(rows @ rows.mean(0)))
    taken, near = [first], rows @ rows[first]
    while len(taken) < min(k, len(rows)):
        taken.append(int(np.argmin(near)))
        near = np.maximum(near, rows @ rows[taken[-1]])
    centres = rows[taken]
    for _ in range(rounds):
        own = np.argmax(rows @ centres.T, axis=1)
        sums = np.array([rows[own == c].sum(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        new = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, centres):
            break
        centres = new
    return centres


class TopicModel:
    """Word weights and cluster centres; a fixed size."""

    def __init__(self, weights: np.ndarray, centres: np.ndarray):
        self.weights, self.centres = weights, centres

    def nearest(self, at: list[bytes], n: list[bytes]) -> np.ndarray:
        """The cluster of each packed bag, -1 without words."""
        out = np.full(len(at), -1)
        some = [i for i, a in enumerate(at) if a] if len(self.centres) else []
        for k in range(0, len(some), SPREAD):
            part = some[k : k + SPREAD]
            out[part] = np.argmax(products(*flat_units([at[i] for i in part], [n[i] for i in part], self.weights), self.centres), axis=1)
        return out

    def names(self, at: list[bytes], n: list[bytes]) -> list[str]:
        return [f"topic-{c}" if c >= 0 else NO_TOPIC for c in self.nearest(at, n).tolist()]


def bagged(rows: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, and (tokens, at, n): its number of words, the buckets they fall in and their counts."""
    rows = rows.select(*(c for c in rows.columns if c != text), text)
    last = len(rows.columns) - 1

    def run(batches):
        memo = Bags()
        for batch in bounded(batches, last):
            at, n, tokens = memo.packed(batch.column(last).cast(pa.binary()))
            new = [pa.array(tokens, pa.int64()), pa.array(at, pa.binary()), pa.array(n, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], *new], [*batch.schema.names[:last], "tokens", "at", "n"])

    from pyspark.sql.types import BinaryType, LongType, StructType

    return rows.mapInArrow(run, StructType(rows.schema.fields[:last]).add("tokens", LongType()).add("at", BinaryType()).add("n", BinaryType()))


def packed_parts(batches):
    """(at, n) of batches of packed bags, SPREAD at a time; bags without words are left out."""
    for batch in batches:
        rows = [x for x in zip(*(c.to_pylist() for c in batch.columns), strict=True) if x[0]]
        for i in range(0, len(rows), SPREAD):
            yield tuple(map(list, zip(*rows[i : i + SPREAD], strict=True)))


def vectors(bags: DataFrame, weights: np.ndarray) -> DataFrame:
    """(sizes, at, v), written: the unit vectors of SPREAD bags in a row, as every round reads them."""

    def run(batches):
        for at, n in packed_parts(batches):
            sizes, bucket, value = flat_units(at, n, weights)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (sizes.astype(np.uint16), bucket, value.astype(np.int32))], ["sizes", "at", "v"])

    return written(bags.select("at", "n").mapInArrow(run, "sizes binary, at binary, v binary"), "vectors")


def flat_parts(batches):
    """(sizes, buckets, values) of each row of ``vectors``."""
    for batch in batches:
        for sizes, at, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield np.frombuffer(sizes, np.uint16).astype(np.int64), np.frombuffer(at, np.uint16), np.frombuffer(v, np.int32).astype(float)


def summed(rows: DataFrame, parts, of_part) -> dict[int, np.ndarray]:
    """{c: sum of v} over what ``of_part`` gives of each of ``parts(batches)`` as {c: v}, v being whole numbers: a row a task and c, then one a c."""

    def by_key(pairs):
        sums: dict[int, np.ndarray] = {}
        for c, v in pairs:
            sums[c] = sums[c] + v if c in sums else v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype(np.int64).tobytes() for v in sums.values()], pa.binary())], ["c", "v"])

    def partial(batches):
        return by_key(x for part in parts(batches) for x in of_part(*part).items())

    def whole(batches):
        return by_key((c, np.frombuffer(v, np.int64)) for b in batches for c, v in zip(*(x.to_pylist() for x in b.columns), strict=True))

    kind = "c int, v binary"
    rows = rows.mapInArrow(partial, kind).repartition("c").mapInArrow(whole, kind).collect()
    return {r.c: np.frombuffer(bytes(r.v), np.int64) for r in rows}


def least_vector(rows: DataFrame, score) -> tuple[float, np.ndarray]:
    """The smallest of the scores that ``score`` gives rows of ``vectors``, and the vector that has it; of ties the first by its buckets and values."""

    def run(batches):
        best = None
        for sizes, bucket, value in flat_parts(batches):
            got, ends = score(sizes, bucket, value), np.cumsum(sizes)
            for i in np.flatnonzero(got == got.min()).tolist():
                own = slice(ends[i] - sizes[i], ends[i])
                best = min(x for x in (best, (float(got[i]), bucket[own].tobytes(), value[own].astype(np.int32).tobytes())) if x)
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]], pa.binary()), pa.array([best[2]], pa.binary())], ["s", "at", "v"])

    r = rows.mapInArrow(run, "s double, at binary, v binary").orderBy("s", "at", "v").head()
    out = np.zeros(BUCKETS)
    out[np.frombuffer(bytes(r.at), np.uint16)] = np.frombuffer(bytes(r.v), np.int32)
    return r.s, out


def some_weight(sizes: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which of the flat vectors aren't all zeros."""
    return np.logical_or.reduceat(value != 0, np.cumsum(sizes) - sizes)


def fit(bags: DataFrame, topics: int = 8) -> TopicModel:
    """From all rows of ``bagged``, at best a written table. No words at all: no topics."""

    def present(at, n):
        return {0: np.bincount(np.frombuffer(b"".join(at), np.uint16), minlength=BUCKETS), 1: np.array([len(at)])}

    got = summed(bags.select("at", "n"), packed_parts, present)
    if 1 not in got:
        return TopicModel(np.zeros(BUCKETS), np.zeros((0, BUCKETS)))
    weights = np.log((1 + got[1][0]) / (1 + got[0]))
    if not (weights * (got[0] > 0)).any():  # every text has every word: nothing tells them apart
        return TopicModel(weights, np.zeros((0, BUCKETS)))
    rows = vectors(bags, weights)
    mean = centre(summed(rows, flat_parts, lambda sizes, bucket, value: {0: np.bincount(bucket, value, BUCKETS)})[0])
    centres = least_vector(rows, lambda *x: -products(*x, mean[None, :])[:, 0])[1][None, :]
    while len(centres) < topics:

        def nearness(sizes, bucket, value, c=centres):
            return np.where(some_weight(sizes, value), products(sizes, bucket, value, c).max(1), np.inf)

        near, far = least_vector(rows, nearness)
        if (centres == far).all(1).any() or np.isinf(near):
            break
        centres = np.vstack([centres, far])
    for _ in range(ROUNDS):

        def own_sums(sizes, bucket, value, c=centres):
            own = np.where(some_weight(sizes, value), np.argmax(products(sizes, bucket, value, c), axis=1), len(c))
            sums = np.bincount(np.repeat(own * BUCKETS, sizes) + bucket, value, (len(c) + 1) * BUCKETS).reshape(-1, BUCKETS)
            return {k: sums[k] for k in np.unique(own).tolist() if k < len(c)}

        sums = summed(rows, flat_parts, own_sums)
        new = np.array([centre(sums[k]) if k in sums else centres[k] for k in range(len(centres))])
        if (new == centres).all():
            break
        centres = new
    return TopicModel(weights, centres)


def fit_topics(docs: DataFrame, topics: int = 8, text: str = "text") -> TopicModel:
    """Learned from every row."""
    return fit(written(bagged(docs.select(text), text), "bags"), topics)


def with_topics(df: DataFrame, model: TopicModel, text: str = "text", name: str = "topic") -> DataFrame:
    """All columns and a further one with each row's topic; a text without words has the topic NO_TOPIC."""
    at, shipped = df.columns.index(text), df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        memo, m = Bags(), shipped.value
        for batch in bounded(batches, at):
            topics = m.names(*memo.packed(batch.column(at).cast(pa.binary()))[:2])
            yield batch.append_column(name, pa.array(topics, pa.string()))

    from pyspark.sql.types import StringType, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(name, StringType()))


def weighed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, source, lang, tokens, at, n) of every row, written: null source or lang is '', tokens are runs of other than white space."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return written(bagged(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), some("source"), some("lang"), F.col(text).alias("text"))), "bags")


def named(bags: DataFrame, model: TopicModel) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) of rows of ``weighed``."""
    shipped = bags.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            *keys, tokens, at, n = batch.columns
            topics = pa.array(shipped.value.names(at.to_pylist(), n.to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([*keys, topics, tokens], ["doc_id", *DIMS, "tokens"])

    return bags.select("doc_id", "source", "lang", "tokens", "at", "n").mapInArrow(run, "doc_id long, source string, lang string, topic string, tokens long")


def margins(cells: DataFrame, dim: str, power: float = 1.0, shares: dict[str, float] | None = None) -> DataFrame:
    """(dim, share): named shares for the values that occur, what is left to the others in proportion to tokens ** power.

    If the named shares leave nothing, the others (null is one) keep their own part of all tokens ** power and the named
    ones are scaled down to the rest, so only a value that is named with 0 gets no share.
    """
    m = cells.groupBy(dim).agg(F.sum("have").alias("have")).filter("have > 0")
    named = F.coalesce(*[F.when(F.col(dim) == v, F.lit(float(s))) for v, s in (shares or {}).items()], F.lit(None).cast("double"))
    m = m.select(dim, named.alias("named"), F.pow(F.col("have").cast("double"), F.lit(power)).alias("size"))
    unnamed = F.sum(F.when(F.col("named").isNull(), F.col("size")))
    sums = m.agg(F.coalesce(F.sum("named"), F.lit(0.0)), F.coalesce(unnamed, F.lit(0.0)), F.coalesce(F.sum("size"), F.lit(0.0))).head()
    left = 1 - sums[0]
    if left < 1e-9 and sums[1]:  # rounding of the named shares is no share
        left = 1.0 if sums[1] == sums[2] else sums[0] * sums[1] / (sums[2] - sums[1])
    free = left / sums[1] if sums[1] else 0.0
    total = sums[0] + free * sums[1] or 1.0
    return m.select(dim, (F.coalesce("named", F.col("size") * free) / total).alias("share"))


def rake_on_driver(have: np.ndarray, codes: list[np.ndarray], shares: list[np.ndarray], total: float, rounds: int) -> np.ndarray:
    want = have * (total / max(have.sum(), 1e-300))
    for _ in range(rounds):
        before = want
        for code, share in zip(codes, shares, strict=True):
            now = np.bincount(code, want, len(share)).astype(float)
            want = want * np.divide(share * total, now, out=np.ones_like(now), where=now > 0)[code]
        want = np.minimum(want, have)
        if np.abs(want - before).max(initial=0) <= 1e-9 * max(total, 1):
            break
    return want


def rake(cells: DataFrame, targets: dict[str, DataFrame], total: float, rounds: int) -> DataFrame:
    """Spark's way for any number of cells: a margin at a time, each round cut off in the shared folder."""
    scale = total / max(cells.agg(F.sum("have")).head()[0] or 0, 1e-300)
    cur = cells.withColumn("want", F.col("have") * scale)
    for _ in range(rounds):
        new = cur.withColumn("before", F.col("want"))
        for dim, share in targets.items():
            factor = new.groupBy(dim).agg(F.sum("want").alias("now")).join(share, dim).select(dim, F.when(F.col("now") > 0, F.col("share") * total / F.col("now")).otherwise(1.0).alias("factor"))
            new = new.join(factor, dim, "left").withColumn("want", F.col("want") * F.coalesce("factor", F.lit(1.0))).drop("factor")
        cur = written(new.withColumn("want", F.least("want", "have")), "rake")
        if (cur.agg(F.max(F.abs(F.col("want") - F.col("before")))).head()[0] or 0) <= 1e-9 * max(total, 1):
            break
        cur = cur.drop("before")
    return cur.drop("before")


def residuals(cells: DataFrame, targets: dict[str, DataFrame], total: float) -> DataFrame:
    """(dim, value, target, reached) of each margin's value: its target share and the share that cells (with ``want``) come to."""
    out = None
    for dim, share in targets.items():
        now = cells.groupBy(dim).agg(F.sum("want").alias("now")).join(share, dim)
        part = now.select(F.lit(dim).alias("dim"), F.col(dim).alias("value"), F.col("share").alias("target"), (F.col("now") / F.lit(max(total, 1e-300))).alias("reached"))
        out = part if out is None else out.union(part)
    return out


def calibrated(docs: DataFrame, part: float = 0.5, powers=None, shares=None, rounds: int = 50, seed: int = 17, on_driver: int = CELLS_ON_DRIVER, bags: DataFrame | None = None, model: TopicModel | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, residual, sampled) of every row.

    The sample is to hold ``part`` of all tokens. Each dimension's shares are tempered (tokens ** power) or named.
    Values without a named share, null too, never get a share of 0. A cell without tokens has probability ``part``.
    residual is the largest distance of a row's three margins from their targets: above 0 where cells have too little
    for it or ``rounds`` were too few. The draw is a hash of doc_id and seed, so it repeats, and repeated rows share their
    fate; rows with a null doc_id share one draw. An empty table gives no rows. ``bags`` and ``model`` are what ``weighed``
    and ``fit`` gave for docs, where they are at hand.
    """
    powers, shares = powers or {}, shares or {}
    bags = weighed(docs) if bags is None else bags
    rows = written(named(bags, model or fit(bags)).withColumn("cell", F.concat_ws("\x1f", *DIMS)), "weighed")
    cells = written(rows.groupBy("cell", *DIMS).agg(F.sum("tokens").alias("have"), F.count("*").alias("n")), "cells")
    sums = cells.agg(F.coalesce(F.sum("have"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).head()
    total = part * sums[0]
    targets = {d: margins(cells, d, powers.get(d, 1.0), shares.get(d)) for d in DIMS}
    if cells.limit(on_driver + 1).count() <= on_driver:
        got = cells.orderBy("cell").collect()
        codes, wanted = [], []
        for d in DIMS:
            share = {r[0]: r[1] for r in targets[d].collect()}
            values = sorted({r[d] for r in got})
            codes.append(np.array([values.index(r[d]) for r in got], np.int64))
            wanted.append(np.array([share.get(v, 0.0) for v in values]))
        want = rake_on_driver(np.array([float(r["have"]) for r in got]), codes, wanted, total, rounds)
        spark = docs.sparkSession
        raked = cells.join(F.broadcast(spark.createDataFrame([(r["cell"], float(w)) for r, w in zip(got, want, strict=True)], "cell string, want double")), "cell")
    else:
        raked = rake(cells, targets, total, rounds)
    raked = written(raked.select("cell", *DIMS, "have", "n", "want"), "raked")
    off = residuals(raked, targets, total).withColumn("off", F.abs(F.col("target") - F.col("reached")))
    away = raked.select("cell", F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in DIMS))).alias("m")).select("cell", "m.*")
    worst = away.join(off, ["dim", "value"]).groupBy("cell").agg(F.max("off").alias("residual"))
    chance = F.when(F.col("have") > 0, F.least(F.lit(1.0), F.col("want") / F.col("have"))).otherwise(part)
    chances = raked.join(worst, "cell", "left").select("cell", "n", chance.alias("probability"), F.coalesce("residual", F.lit(0.0)).alias("residual"))
    out = join_counted(rows, written(chances, "chances"), "cell", "n", sums[1])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    return out.select("doc_id", *DIMS, "tokens", "probability", "residual", (draw < F.col("probability")).alias("sampled"))


#: Parameters of the registered query and of the pipeline.
POWERS = {"source": 0.5, "topic": 0.8}
SHARES = {"lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}}


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability and draw under ``POWERS`` and ``SHARES``."""
    return calibrated(spark.read.parquet(f"{sf_dir}/documents.parquet"), powers=POWERS, shares=SHARES)


def sampled(docs: DataFrame, part: float = 0.5, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns, with their probability as a further last column.

    It is named ``probability``, or ``mix_probability`` where docs have such a column, which stays as it is. The draw is made
    anew from doc_id and the cell, so the texts are not shuffled: only the cells are joined to them. Repeated rows are
    drawn or left together; null languages and sources are values; a text without words is drawn with chance ``part``;
    an empty table stays empty.
    """
    name = next(n for n in ("probability", "mix_probability", "_mix_probability") if n not in docs.columns)
    bags = weighed(docs)
    model = fit(bags)
    verdict = calibrated(docs, part, POWERS, SHARES, seed=seed, bags=bags, model=model)
    cells = written(verdict.groupBy(*(F.col(d).alias(f"_fs_{d}") for d in DIMS)).agg(F.first("probability").alias("_fs_p")), "cell-chances")
    keyed = with_topics(docs, model, name="_fs_t").withColumns({"_fs_s": F.coalesce(F.col("source").cast("string"), F.lit("")), "_fs_l": F.coalesce(F.col("lang").cast("string"), F.lit(""))})
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint"), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    same = (F.col("_fs_s") == F.col("_fs_source")) & (F.col("_fs_l") == F.col("_fs_lang")) & (F.col("_fs_t") == F.col("_fs_topic"))
    small = F.broadcast(cells) if cells.limit(CELLS_ON_DRIVER + 1).count() <= CELLS_ON_DRIVER else cells
    return keyed.join(small, same).filter(draw < F.col("_fs_p")).select(*docs.columns, F.col("_fs_p").alias(name))
