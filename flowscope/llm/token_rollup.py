"""Delta-maintained token totals by source, language and tokenizer version.

A batch holds signed changes: an insert adds a document's counts, a delete takes them back, a revision does both. Batches are
aggregated and committed as partial totals in a folder of their own, named after the batch; totals are the sum of all
committed parts. A batch that was committed before is left alone, a batch that was broken off is written again, so
retries never count twice. ``compacted`` folds old parts into one.
"""

from __future__ import annotations

import base64
import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.llm.common import bounded, new_path, remove

KEYS = ("source", "lang", "tokenizer")
SUMS = ("docs", "tokens", "chars")
PART = "source string, lang string, tokenizer string, docs bigint, tokens bigint, chars bigint"


#: Characters from which a text's pieces are met one by one.
LONG = 4_000_000


class Counter:
    """Token counts by a byte-level BPE, given its ranks file's lines; short pre-tokens are remembered, in a bounded number."""

    def __init__(self, ranks: bytes, pattern: str, most: int = 300_000):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pattern = regex.compile(pattern)
        self.known, self.most = {}, most

    def count(self, text: str | None) -> int:
        n, known, text = 0, self.known, text or ""
        # the pieces of a very long text are not all held at once
        for piece in self.pattern.findall(text) if len(text) < LONG else (m.group() for m in self.pattern.finditer(text)):
            k = known.get(piece)
            if k is None:
                k = len(self.encode(piece))
                if len(piece) <= 64:
                    if len(known) >= self.most:
                        known.clear()
                    known[piece] = k
            n += k
        return n


def ranks_of(spark: SparkSession, path: str, most: int = 32_000_000) -> bytes:
    """The bytes of a vocabulary file, which all workers get; a larger one than ``most`` is refused."""
    row = spark.read.format("binaryFile").load(path).select("length", "content").head()
    if row["length"] > most:
        raise ValueError(f"{path}: {row['length']} bytes, {most} at most")
    return bytes(row["content"])


def token_counts(docs: DataFrame, path: str, pattern: str, version: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, source, lang, words, tokens, chars, tokenizer) of every row.

    A null text counts as empty: no words, tokens or characters. Null source or lang stay null and are values of their
    own. Repeated rows are counted each; null doc_ids are of no concern; an empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(ranks_of(docs.sparkSession, path))

    def run(batches):
        counter = Counter(shipped.value, pattern)
        for batch in bounded(batches, 3):
            counts = [counter.count(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), batch.column(4), pa.array(counts, pa.int64()), batch.column(5)], ["doc_id", "source", "lang", "words", "tokens", "chars"])

    value = F.coalesce(F.col(text), F.lit(""))
    cols = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text).alias("text"), F.regexp_count(value, F.lit(r"\S+")).cast("bigint").alias("words"), F.length(value).cast("bigint").alias("chars"))
    out = cols.mapInArrow(run, "doc_id long, source string, lang string, words long, tokens long, chars long")
    return out.withColumn("tokenizer", F.lit(version))


def changes(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """Signed rows that lead from the counts ``before`` to those ``after``; None: nothing there.

    Null counts add nothing; a row that is in both cancels out; repeated rows count each.
    """
    cols = lambda df, sign: df.select(*KEYS, F.lit(sign).cast("bigint").alias("docs"), (F.col("tokens") * sign).alias("tokens"), (F.col("chars") * sign).alias("chars"))
    parts = [cols(df, sign) for df, sign in ((before, -1), (after, 1)) if df is not None]
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def revisions(counts: DataFrame, was: str, now: str) -> DataFrame:
    """Signed rows that replace each row's count ``was`` by ``now``, from one pass over ``counts``."""
    both = F.array(F.struct(F.lit(-1).cast("bigint").alias("docs"), (-F.col(was)).alias("tokens"), (-F.col("chars")).alias("chars")), F.struct(F.lit(1).cast("bigint").alias("docs"), F.col(now).alias("tokens"), F.col("chars").alias("chars")))
    return counts.select(*KEYS, F.inline(both))


#: A part with this empty file counts; Spark's readers pass over it.
COMMITTED = "_COMMITTED"


class TokenRollup:
    """Totals in the folder ``path``: one folder of Parquet a batch, committed by an empty file of our own once it is whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _part(self, batch: str) -> str:
        return f"{self.path}/batch-{hashlib.sha256(batch.encode()).hexdigest()[:24]}"

    def parts(self) -> list[str]:
        """Committed parts; one that a compaction has taken over no longer counts."""
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = [f"{self.path}/{n}" for s in fs.listStatus(p) if not (n := s.getPath().getName()).endswith("-names")]
        done = {n for n in names if (at := self._fs(f"{n}/{COMMITTED}"))[0].exists(at[1])}
        gone = {x for n in done if "/folded-" in n for x in self._folded(n)}
        return sorted(done - {f"{self.path}/{x}" for x in gone})

    def _folded(self, part: str) -> list[str]:
        return json.loads(self.spark.read.schema("names string").parquet(f"{part}-names").head()[0])

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds signed rows (source, lang, tokenizer, docs, tokens, chars); False if the batch was committed before."""
        part = self._part(batch)
        fs, done = self._fs(f"{part}/{COMMITTED}")
        if fs.exists(done) or self._taken(batch):
            return False
        sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in SUMS]
        deltas.groupBy(*KEYS).agg(*sums).write.mode("overwrite").parquet(part)
        self._seal(part)
        return True

    def _seal(self, part: str) -> None:
        fs, done = self._fs(f"{part}/{COMMITTED}")
        fs.create(done, True).close()

    def _taken(self, batch: str) -> bool:
        name = self._part(batch).rsplit("/", 1)[1]
        return any(name in self._folded(p) for p in self.parts() if "/folded-" in p)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens, chars); a cell whose documents have all gone is left out."""
        parts = self.parts()
        rows = self.spark.read.schema(PART).parquet(*parts) if parts else self.spark.createDataFrame([], PART)
        out = rows.groupBy(*KEYS).agg(*(F.sum(c).cast("bigint").alias(c) for c in SUMS))
        return out.filter("docs <> 0 or tokens <> 0 or chars <> 0")

    def compact(self) -> None:
        """One part instead of all; the list of what it stands for is written first, and counts only with the part."""
        parts = self.parts()
        names = sorted({p.rsplit("/", 1)[1] for p in parts} | {x for p in parts if "/folded-" in p for x in self._folded(p)})
        to = f"{self.path}/folded-{hashlib.sha256(json.dumps(names).encode()).hexdigest()[:24]}"
        self.spark.createDataFrame([(json.dumps(names),)], "names string").coalesce(1).write.mode("overwrite").parquet(f"{to}-names")
        self.totals().write.mode("overwrite").parquet(to)
        self._seal(to)
        for p in parts:
            remove(self.spark, p)


def op2(spark: SparkSession, sf_dir: str, tokenizer: str = "/opt/tokenizers/byte_bpe_50k.tiktoken", version: str = "byte_bpe_50k/1") -> DataFrame:
    """All documents come in with their number of words as a provisional count; that batch is sent twice, as after a retry.

    A second batch revises every document: the provisional counts go, the tokenizer's come. The totals are those of the latter.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = TokenRollup(spark, new_path(spark, "rollup"))
    text = F.coalesce("text", F.lit(""))
    rough = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(version).alias("tokenizer"), F.regexp_count(text, F.lit(r"\S+")).cast("bigint").alias("tokens"), F.length(text).cast("bigint").alias("chars"))
    store.commit("provisional", changes(None, rough))
    store.commit("provisional", changes(None, rough))
    store.commit("counted", revisions(token_counts(docs, tokenizer, PATTERN, version), "words", "tokens"))
    return store.totals()


#: How byte_bpe_50k cuts texts into pieces before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
