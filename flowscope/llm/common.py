"""What the operators of this subpackage share: scratch tables, components, skew-proof joins, streams of groups."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import threading
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_own_dirs: dict[str, str] = {}


def on_one_machine(spark: SparkSession) -> bool:
    """Whether driver and executor are one process."""
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on a single machine without it, a folder of our own."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not on_one_machine(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_dirs.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="flowscope-"))
    return f"{base.rstrip('/')}/flowscope-{sc.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    top = shared_dir(spark)
    if top not in _own_dirs.values():
        _own_dirs[top] = top
        atexit.register(lambda: _at_exit(spark, top))
    return f"{top}/{name}-{uuid.uuid4().hex[:12]}"


def _at_exit(spark: SparkSession, top: str) -> None:
    if spark.sparkContext._jsc is not None and spark.sparkContext._gateway is not None:
        try:
            remove(spark, top)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            pass


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Seconds between two collections of the driver's garbage at least.
COLLECT_S = 30
_collected = [time.monotonic()]


def collect_garbage(spark: SparkSession, after: float | None = None) -> None:
    """Every COLLECT_S (or ``after``) at most, a full collection on the driver, as its heap otherwise grows to its bound over a run of many steps.

    What is live is small (plans, tasks' states); with it Spark's cleaner drops the shuffle files and broadcasts of steps that are done.
    """
    if time.monotonic() - _collected[0] >= (COLLECT_S if after is None else after):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()


#: Seconds between two looks at the driver's heap, and the part of its bound from which on it isn't left to grow.
TICK_S, HEAP_PART = 5, 0.5
_watched: dict[str, threading.Event] = {}


def collect_meanwhile(spark: SparkSession) -> threading.Event:
    """Collects the driver's garbage during a job too, as one job over a large table takes many times COLLECT_S; setting the event ends it.

    One thread an application. A heap beyond HEAP_PART of its bound is collected at the next look, so that it shrinks again.
    """
    sc, app = spark.sparkContext, spark.sparkContext.applicationId
    if app in _watched:
        return _watched[app]
    stop = _watched[app] = threading.Event()
    atexit.register(stop.set)

    def run():
        while not stop.wait(TICK_S):
            try:
                if sc._jsc is None:
                    return
                heap = sc._jvm.Runtime.getRuntime()
                collect_garbage(spark, TICK_S if heap.totalMemory() > HEAP_PART * heap.maxMemory() else None)
            except Exception:  # noqa: BLE001  the JVM may be gone already
                return

    threading.Thread(target=run, name="flowscope-garbage", daemon=True).start()
    return stop


def collect_on_executors(spark: SparkSession) -> None:
    """A full collection on each executor, best when no job runs: between two stages a heap that has grown goes back to what is live.

    A task for each core asks for it, so each executor has some; an executor that gets none only keeps its garbage.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if not on_one_machine(spark):
        collect_meanwhile(spark)
    df.write.parquet(path)
    collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key counts as hot from this part of all rows on, so there are HOT_PART hot keys at most, whatever the input's size.
HOT_PART = 1024


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row for each key and in ``n`` the number of rows with it.

    Keys with at least 1/HOT_PART of ``total`` rows are few by definition: only they are broadcast.
    All others go through a sort-merge join in which no key has more than that part of the rows.
    """
    is_hot = F.col(n) * HOT_PART >= F.lit(max(total, HOT_PART * 64))
    hot = keyed.filter(is_hot)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.filter(~is_hot), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


#: Bits of a membership filter at most: 16 MB.
FILTER_BITS = 1 << 27


def probably_among(rows: DataFrame, key, members: DataFrame, member_key, count: int) -> DataFrame:
    """The rows whose ``key`` (64-bit) is a member's, and a few others: a filter before a join, so that most rows need no shuffle.

    A bitmap of 16 bits a member, FILTER_BITS at most, is broadcast; it errs only in letting rows through.
    """
    size = min(FILTER_BITS, max(1 << 15, 1 << (16 * count).bit_length()))
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(size)) + 1
    bits = members.select(place(member_key).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("_fs_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("_fs_bits"))
    at = F.bitmap_bit_position("_fs_place")
    byte = F.conv(F.hex(F.substring("_fs_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("_fs_place", place(key)).withColumn("_fs_bucket", F.bitmap_bucket_number("_fs_place")).join(F.broadcast(written(bits, "filter")), "_fs_bucket")
    return marked.filter(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0).select(*rows.columns)


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, label) for each node of an edge (a, b), label being the smallest node of its component.

    Alternating large-star and small-star steps until only stars are left; each round is written to the shared folder.
    A star's least neighbour is found by partial sums; its edges are then joined by their centre, so the pairs of one large
    star, 16 bytes each, meet in one task.
    """
    cur = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    while True:
        both = cur.union(cur.select(F.col("b"), F.col("a")))
        ends = both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") < F.col("a")).alias("below"), F.count_if(F.col("b") > F.col("a")).alias("above"))
        if not ends.agg(F.count_if(F.expr("below > 1 or (below > 0 and above > 0)"))).head()[0]:
            break
        low = ends.select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low)
        cur = written(small.filter("a <> b").distinct(), name)
    return cur.select(F.col("a").alias("node"), F.col("b").alias("label")).union(cur.select("b", "b").distinct())


def lower_ascii(col):
    """Lower-cases A-Z and nothing else."""
    return F.translate(F.coalesce(col, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_hash(text: str = "text"):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def kept_rows(docs: DataFrame, verdict: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``verdict`` (doc_id, text_hash, kept; one row for each of theirs) keeps.

    Only what goes is joined to the texts. Of rows repeated with the same doc_id and text one stays, if that is kept.
    """
    odd = verdict.groupBy(F.col("doc_id").alias("_fs_id"), F.col("text_hash").alias("_fs_hash")).agg(F.max("kept").alias("_fs_kept"), F.count("*").alias("_fs_n"))
    odd = written(odd.filter(~F.col("_fs_kept") | (F.col("_fs_n") > 1)), "dropped")
    keyed = docs.withColumn("_fs_text", text_hash(text))
    same = (F.col("_fs_text") == F.col("_fs_hash")) & F.col(doc_id).eqNullSafe(F.col("_fs_id"))
    out = keyed.join(odd, same, "left_anti").select(*docs.columns)
    if not odd.filter("_fs_kept").isEmpty():
        twice = keyed.join(odd.filter("_fs_kept"), same, "left_semi").dropDuplicates(["_fs_text", doc_id])
        out = out.unionByName(twice.select(*docs.columns))
    return out


#: Bytes of text that a Python worker works on at a time, and that its word memory may hold.
PIECE_BYTES, MEMO_BYTES = 1 << 20, 16 << 20


def pieces(sizes, most: int = PIECE_BYTES):
    """Slices of consecutive items whose ``sizes`` add up to about ``most``; a single larger item is a slice of its own."""
    a, total = 0, 0
    for b, n in enumerate(sizes):
        if b > a and total + n > most:
            yield slice(a, b)
            a, total = b, 0
        total += n
    if a < len(sizes):
        yield slice(a, len(sizes))


def bounded(batches, text: int, most: int = PIECE_BYTES):
    """The rows of Arrow batches in slices with about ``most`` bytes in column ``text``: work space doesn't grow with the batch.

    A null counts nothing; no row is left out or cut.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for part in pieces(sizes.tolist(), most):
            yield batch.slice(part.start, part.stop - part.start)
    pa.default_memory_pool().release_unused()


def white_cut(text: bytes, most: int = PIECE_BYTES):
    """A text in stretches of about ``most`` bytes, cut only at white space, so that no word is cut."""
    at = 0
    while len(text) - at > most:
        m = _WHITE.search(text, at + most)
        if not m:
            break
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


class Memo(dict):
    """Remembers what ``of_key`` gives for a word, in a bounded number of bytes; long words aren't remembered."""

    LONGEST, ENTRY = 64, 150

    def __init__(self, most: int = MEMO_BYTES):
        super().__init__()
        self.most = max(1, most // (self.LONGEST + self.ENTRY))

    def of_key(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value = self.of_key(key)
        if len(key) <= self.LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value
