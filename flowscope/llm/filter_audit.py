"""How five quality filters act on each other, whatever the order they are applied in.

Words are counted relationally: they are exploded, counted by (document, word) and then by document, which gives each
document's words and distinct words. Texts are shuffled once, by document, and both counts use that partitioning, so no
word is shuffled. What else fails comes from a second table, joined to the first. A document's failures are a set of five
filters, and all that the report says about 120 orders follows from how many documents of a part have which of the 32 sets.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.llm.common import join_counted, text_hash, written

FILTERS = "ABCDE"
WHITE = " \t\n\x0b\x0c\r"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 3
ODD_SIGNS = "[#$%&*|]"
SETS = 1 << len(FILTERS)
#: What the columns count, by the condition on a label.
COUNTED = {"n": None, "good": "quality", "toxic": "toxic"}


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, words, distinct_words), one row for each pair of the first two.

    A word is a maximal run of other characters than space, tab and line ends, upper and lower case apart. Every text gives
    two empty words, before its first and after its last white space; their number tells how many rows repeat a document,
    and keeps documents without words.
    """
    keyed = docs.select(F.col(doc_id).alias("doc_id"), text_hash(text).alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = F.concat(F.lit(" "), F.ltrim(F.rtrim("text", F.lit(WHITE)), F.lit(WHITE)), F.lit(" "))
    words = keyed.repartition("doc_id", "text_hash").select("doc_id", "text_hash", F.explode(F.split(whole, "[ \\t-\\r]+")).alias("word"))
    by_word = words.groupBy("doc_id", "text_hash", "word").agg(F.count("*").alias("n"))
    own = F.col("word") != ""
    sums = by_word.groupBy("doc_id", "text_hash").agg(
        F.sum(F.when(own, F.col("n")).otherwise(0)).alias("all_words"),
        F.count_if(own).alias("distinct_words"),
        F.expr("sum(if(word = '', n, 0)) div 2").alias("rows"),
    )
    return sums.select("doc_id", "text_hash", F.expr("all_words div rows").alias("words"), "distinct_words")


def other_flags(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, text_hash, part, c, d, e, quality, toxic) of every row.

    e compares SHA-256 digests of whole texts; a null doc_id is neither smaller nor larger than another. A document has a
    label if any of its label rows says so. A text that a third of all rows share is no hot spot: the first holder of such
    a text is broadcast, of all others joined.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        text_hash(text).alias("text_hash"),
        F.coalesce(F.col(lang), F.lit("")).alias("part"),
        F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"),
        (100 * F.length(F.regexp_replace(body, "[^A-Z]+", "")) > UPPER_PERCENT * F.length(body)).alias("c"),
        body.rlike(ODD_SIGNS).alias("d"),
    )
    rows = written(rows, "flags")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    rows = join_counted(rows, written(first, "first"), "digest", "copies", rows.count())
    said = labels.groupBy(F.col("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("quality"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    e = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).alias("e")
    return rows.select("doc_id", "text_hash", "part", "c", "d", e).join(said, "doc_id", "left")


def failure_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each value of lang (null: empty): n0 to n31 count its documents by the set of filters they fail.

    Bit i of the column's number stands for filter i of FILTERS; good0 to good31 and toxic0 to toxic31 count only documents
    with that label. Every row counts, repeated ones too.
    """
    counts = word_counts(docs).withColumnsRenamed({"doc_id": "counted_id", "text_hash": "counted_hash"})
    flags = other_flags(docs, labels)
    same = flags.doc_id.eqNullSafe(counts.counted_id) & (flags.text_hash == counts.counted_hash)
    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct_words", F.lit(0))
    fails = [words < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * words, F.col("c"), F.col("d"), F.col("e")]
    number = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    rows = flags.join(counts, same, "left").select("part", "quality", "toxic", number.alias("failed"))
    of = lambda label, m: (F.col("failed") == m) & (F.col(label) == 1 if label else F.lit(True))
    return rows.groupBy("part").agg(*(F.count_if(of(label, m)).alias(f"{name}{m}") for name, label in COUNTED.items() for m in range(SETS)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report for each part, order of the filters and step: see the columns below.

    ``kept`` after the step, ``removed`` by it, ``redundant``: failing its filter but removed earlier, ``unique_fails``:
    failing its filter alone, ``good_lost`` and ``toxic_lost``: removed by it and so labelled, ``shapley``: removed by its
    filter, summed over all orders. Of k filters that a document fails, each comes first in 120 / k of the orders.

    Null or empty texts have no words and fail A; null langs are the part ''; columns of other names don't matter; an empty
    table has no parts and no rows.
    """
    table = failure_sets(docs, labels)
    lists = (F.array(*(F.col(f"{name}{m}") for m in range(SETS))).alias(name) for name in COUNTED)
    orders = F.explode(F.lit(["".join(p) for p in permutations(FILTERS)])).alias("filter_order")
    steps = table.select("part", *lists).select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = f"locate(substring(filter_order, {{}}, 1), '{FILTERS}') - 1"
    bits = steps.select(
        "*",
        F.expr(f"shiftleft(1, {place.format('step')})").alias("own"),
        F.expr(f"aggregate(sequence(1, 5), 0, (x, i) -> if(i < step, x | shiftleft(1, {place.format('i')}), x))").alias("before"),
    )
    total = f"aggregate(sequence(0, {SETS - 1}), 0L, (x, m) -> if({{}}, x + {{}}, x))"
    removed = "m & own > 0 AND m & before = 0"
    return bits.select(
        "part",
        "filter_order",
        "step",
        F.expr(total.format("m & (own | before) = 0", "n[m]")).alias("kept"),
        F.expr(total.format(removed, "n[m]")).alias("removed"),
        F.expr(total.format("m & own > 0 AND m & before > 0", "n[m]")).alias("redundant"),
        F.expr("n[own]").alias("unique_fails"),
        F.expr(total.format(removed, "good[m]")).alias("good_lost"),
        F.expr(total.format(removed, "toxic[m]")).alias("toxic_lost"),
        F.expr(total.format("m & own > 0", "n[m] * (120 div bit_count(m))")).alias("shapley"),
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(docs, labels)


OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), f AS (
  SELECT d.row, d.part, d.doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM d
), g AS (
  SELECT part, doc_id, (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed
  FROM f
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), s AS (
  SELECT part, failed, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM g LEFT JOIN l USING (doc_id) GROUP BY ALL
), p AS (
  SELECT '' AS o UNION ALL
  SELECT o || x FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)
), t AS (
  SELECT o AS filter_order, step::INT AS step, substr(o, step, 1) AS own, left(o, step - 1) AS before
  FROM p, (SELECT unnest(range(1, 6)) AS step) WHERE length(o) = 5
), r AS (
  SELECT part, filter_order, step, own, n, good, toxic, failed, contains(failed, own) AS fails,
    regexp_matches(failed, '[' || before || '#]') AS gone
  FROM s, t
), a AS (
  SELECT part, filter_order, step, any_value(own) AS own,
    coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM a
"""
