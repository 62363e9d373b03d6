"""URL rules as intervals: a sort-merge range join with a sweep that keeps the stack of active nested rules.

A rule has a host, which stands for the host and all its subdomains, and a path prefix. Its canonical key is the host with
its labels reversed, a zero byte and the path prefix, as bytes; the keys that begin with it are one interval, from the key
to its successor (the last byte raised by one: UTF-8 has no byte 255, so there is always one, and no character can follow a
prefix and stand behind it). A URL has such a key for each suffix of its host that some rule names.

Intervals of prefixes are nested or apart. A rule's start is an event that carries the stack of the rules that are active
from there on, itself on top; its end one that carries the stack without it. In key order the stack at a URL is that of
the last event before it, and the top of the stack is the longest rule that fits. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowscope.llm.common import join_counted, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = "host string, path string, action string"
#: So many different URLs of one host suffix are swept together; more are dealt among salts, for each of which that suffix's rules are repeated.
SWEEP = 100_000


def parsed(url="url"):
    """(host, path): the host with A-Z lower-cased, from the first :// up to /, ?, # or the end; then the path up to ? or #."""
    col = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(col, "://")
    rest = F.when(at > 0, F.substring(col, at + 3, F.length(col))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER).alias("host"), path.alias("path")


def suffix_key(host):
    """Labels from the last to the first: org.example.www."""
    return F.concat_ws(".", F.reverse(F.split(host, r"\.")))


def interval_key(labels, path):
    """Bytes that sort URLs by reversed host, then path; a host has no zero byte but in garbage, which only rules with such hosts can meet."""
    return F.concat(labels.cast("binary"), F.unhex(F.lit("00")), path.cast("binary"))


def successor(key):
    """The least byte string above all that begin with ``key``."""
    n = F.octet_length(key)
    return F.concat(F.substring(key, F.lit(1), n - 1), F.unhex(F.lpad(F.hex(F.conv(F.hex(F.substring(key, n, F.lit(1))), 16, 10).cast("bigint") + 1), 2, "0")))


def events(rules: DataFrame) -> DataFrame:
    """(host, at, kind, stack): from the key ``at`` on, ``stack`` holds the active rules below a host, the innermost last.

    The stack of a rule is collected from equal joins on its path's proper prefixes, so rule tables may be large. A rule
    without a host, or with a path that no URL's path begins with, fits nothing. Of a rule given twice block counts.
    """
    path = F.coalesce("path", F.lit(""))
    r = rules.select(suffix_key(F.translate("host", UPPER, LOWER)).alias("host"), path.alias("p"), F.concat(F.translate("host", UPPER, LOWER), path).alias("rule"), "action")
    r = r.filter("host is not null and host <> '' and (p = '' or startswith(p, '/'))").groupBy("host", "p").agg(F.first("rule").alias("rule"), F.max("action").alias("action"))
    up = r.filter("length(p) > 0").select("host", "p", F.explode(F.sequence(F.lit(0), F.length("p") - 1)).alias("n")).withColumn("q", F.expr("left(p, n)"))
    outer = r.select("host", F.col("p").alias("q"), F.col("rule").alias("o_rule"), F.col("action").alias("o_action"))
    inside = up.join(outer, ["host", "q"]).groupBy("host", "p").agg(F.sort_array(F.collect_list(F.struct("n", F.col("o_rule").alias("rule"), F.col("o_action").alias("action")))).alias("outer"))
    none = F.array().cast("array<struct<n:int,rule:string,action:string>>")
    full = r.join(inside, ["host", "p"], "left").withColumn("outer", F.coalesce("outer", none)).withColumn("key", interval_key(F.col("host"), F.col("p")))
    own = F.array(F.struct(F.length("p").alias("n"), "rule", "action"))
    # at one key the outermost end comes last, and a start after any end
    starts = full.select("host", F.col("key").alias("at"), F.length("p").alias("kind"), F.concat("outer", own).alias("stack"))
    ends = full.select("host", successor(F.col("key")).alias("at"), (-F.length("p") - 1).alias("kind"), F.col("outer").alias("stack"))
    return starts.unionByName(ends)


def judged(urls: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", url_id: str = "page_id", sweep: int = SWEEP) -> DataFrame:
    """(url_id, host, path, rule, verdict) of every row; extra columns don't matter.

    The longest fitting rule (host and path) decides, then the one with the longer host; no rule: null and ``default``.
    A null URL or one without :// has an empty host and path and fits no rule. Repeated rows are judged one by one,
    and so are equal or null ids. An empty table gives no rows; without rules all get ``default``.
    """
    own = urls.select(F.col(url_id).alias("_fs_id"), *parsed(url))
    ev = events(rules)
    labels = F.split("host", r"\.")
    size = F.size(labels)
    suffixes = F.when(F.col("host") != "", F.transform(F.sequence(F.lit(1), size), lambda n: F.concat_ws(".", F.reverse(F.slice(labels, size - n + 1, n)))))
    hosted = own.filter("host <> ''")
    counted = hosted.groupBy("host", "path").agg(F.count("*").alias("n"))  # only what differs is swept
    distinct = counted.select("host", "path")
    below = distinct.select("host", "path", F.explode(suffixes).alias("below")).join(ev.select(F.col("host").alias("below")).distinct(), "below", "left_semi")
    places = below.select("below", interval_key(F.col("below"), F.col("path")).alias("at")).distinct()
    hot = places.groupBy("below").count().filter(F.col("count") > sweep).select("below", F.ceil(F.col("count") / sweep).cast("int").alias("salts"))
    dealt = lambda df, salt: df.join(hot, "below", "left").withColumn("salt", salt).drop("salts")
    salts = F.coalesce("salts", F.lit(1))
    null = F.lit(None)
    swept = dealt(places, F.pmod(F.xxhash64("at"), salts).cast("int")).select("below", "salt", "at", null.cast("int").alias("kind"), null.cast("array<struct<n:int,rule:string,action:string>>").alias("stack"))
    marks = dealt(ev.withColumnRenamed("host", "below"), F.explode(F.sequence(F.lit(0), salts - 1)))
    w = Window.partitionBy("below", "salt").orderBy("at", F.col("kind").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = swept.unionByName(marks.select("below", "salt", "at", "kind", "stack")).withColumn("active", F.last("stack", ignorenulls=True).over(w))
    found = active.filter("kind is null and size(active) > 0").select("below", "at", F.element_at("active", -1).alias("top"))
    best = F.max_by(F.struct("top.rule", "top.action"), F.struct(F.length("top.rule"), F.length("below")))
    won = below.withColumn("at", interval_key(F.col("below"), F.col("path"))).join(found, ["below", "at"]).groupBy("host", "path").agg(best.alias("top"))
    # a URL that most rows have, or none, makes no task larger
    both = F.struct("host", "path").alias("_fs_url")
    keyed = written(counted.join(won, ["host", "path"], "left").select(both, "n", "top"), "judged")
    found = join_counted(hosted.select("*", both), keyed, "_fs_url", "n", keyed.agg(F.sum("n")).head()[0] or 0)
    out = found.drop("_fs_url", "n").unionByName(own.filter("host = ''"), allowMissingColumns=True)
    return out.select(F.col("_fs_id").alias(url_id), "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.action", F.lit(default)).alias("verdict"))


#: The rules of the registered query.
QUERY_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under ``QUERY_RULES``."""
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, QUERY_RULES)) + " AS r(host, path, action)")
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP10_SQL = """
WITH r(rh, rp, act) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                               ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
f AS (SELECT c.*, rh || rp AS rule, act,
             row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
      FROM c LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(act, 'allow') AS verdict FROM f WHERE k = 1
"""
