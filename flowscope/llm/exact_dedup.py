"""Exact de-duplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row for each digest
(partial aggregation before the shuffle), joined to the index by a sort-merge anti-join, and what is new is appended.
Everything runs as DataFrame expressions; a text is read once and only its 32-byte digest is shuffled.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.llm.common import join_counted, kept_rows, lower_ascii, new_path, partitions, text_hash, written


def digest(text="text"):
    """SHA-256 of the text with A-Z lower-cased, in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(lower_ascii(F.col(text)).cast("binary"), 256))


class DigestIndex:
    """Digests of all texts seen so far, at ``path``.

    ``buckets`` is fixed when the index is first made; by default the session's number of shuffle partitions.
    """

    SCHEMA = "digest binary, keep_id bigint, batch string"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path, buckets or partitions(spark)
        self.table = "fs_digests_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        if not spark.catalog.tableExists(self.table):
            spark.sql(
                f"CREATE TABLE {self.table} ({self.SCHEMA}) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
            )

    def read(self) -> DataFrame:
        """(digest, keep_id, batch) of all that was appended; an index that can't be read is an error, not an empty one."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p) or not any(s.getPath().getName().startswith("part-") for s in fs.listStatus(p)):
            return self.spark.createDataFrame([], self.SCHEMA)
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame) -> None:
        """One file a bucket, each sorted by digest."""
        out = fresh.select("digest", "keep_id", "batch").repartition(self.buckets, "digest")
        out.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table)

    def ingest(self, docs: DataFrame, batch: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Adds a batch; returns (doc_id, text_hash, digest, keep_id, group_size, kept), one row for each of its rows.

        Of equal texts in the batch the row with the largest doc_id stays; of rows equal in that too, one of them.
        A text that an earlier batch brought in stays with that batch: none of the new rows is kept and keep_id names
        the old one. A null text counts as empty; a null doc_id sorts below all others. An empty batch adds nothing.
        group_size counts the rows of this batch. A batch that was ingested before gives the same rows again and adds nothing.
        """
        rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"), digest(text).alias("digest"), text_hash(text).alias("text_hash")), "digests")
        groups = written(rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("group_size")), "digest-groups")
        fresh = groups.hint("merge").join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        self.append(written(fresh.select("digest", F.col("top.doc_id").alias("keep_id"), F.lit(batch).alias("batch")), "fresh"))
        verdict = groups.hint("merge").join(self.read().hint("merge"), "digest")
        verdict = verdict.select("digest", "keep_id", "group_size", F.when(F.col("batch") == batch, F.col("top.row")).alias("keep_row"))
        total = groups.agg(F.sum("group_size")).head()[0] or 0
        out = join_counted(rows, written(verdict, "verdict"), "digest", "group_size", total)
        return out.select("doc_id", "text_hash", "digest", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts in A-Z's lower case the row with the largest doc_id.

    A null text counts as empty; a null doc_id is the smallest; of rows that repeat one stays; an empty table stays empty.
    """
    return kept_rows(docs, index.ingest(docs, batch))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the first batch of a new index."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = DigestIndex(spark, new_path(spark, "digest-index")).ingest(docs, "all")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
