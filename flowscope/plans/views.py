"""Canonical views over the driver's tables, in Spark and, for the checks, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Each event is an interaction; its session is the user.
EVENT_SQL = """v_event AS (
  SELECT event_id AS id, user_id AS session, epoch_us(ts) // 1000 AS ts_ms, event_type AS type,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x, value AS y FROM events)"""

#: Each embedding is an 8 x 8 grey frame; its session is the label.
FRAME_SQL = """v_frame AS (
  SELECT vec_id AS frame_no, label AS session, 100 * vec_id AS ts_ms,
         list_transform(embedding, lambda e: CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5) AS INTEGER)) AS px FROM embeddings)"""

#: Events on the frames' clock, one every five milliseconds; their sessions are the frames'.
CLICK_SQL = """v_click AS (
  SELECT event_id AS id, user_id % 10 AS session, 5 * event_id AS ts_ms, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x, value AS y FROM events)"""

PAIR_SQL = f"""{FRAME_SQL},
v_pair AS (
  SELECT * FROM (
    SELECT session, frame_no, ts_ms, px, lag(frame_no) OVER w AS prev_no, lag(ts_ms) OVER w AS prev_ts, lag(px) OVER w AS prev_px
    FROM v_frame WINDOW w AS (PARTITION BY session ORDER BY frame_no)) WHERE prev_no IS NOT NULL)"""

#: The same frames in colour: red is the grey plane, green is it from the last pixel to the first, blue its negative.
RGB_SQL = f"""{PAIR_SQL},
v_rgb AS (SELECT session, frame_no, px, prev_px, px AS r, list_reverse(px) AS g, list_transform(px, lambda x: 255 - x) AS b,
       prev_px AS prev_r, list_reverse(prev_px) AS prev_g, list_transform(prev_px, lambda x: 255 - x) AS prev_b FROM v_pair)"""

#: A state is an event type with a class of values; an edge leads to the user's next state.
EDGE_SQL = """v_step AS (
  SELECT user_id AS session, event_id AS pos, event_type AS kind,
         event_type || '_' || CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS state,
         lead(event_type || '_' || CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_state
  FROM events),
v_edge AS (SELECT session, pos, kind, state AS src, next_state AS dst FROM v_step WHERE next_state IS NOT NULL)"""

#: Each line of an order is a box on the order's screenshot.
BOX_SQL = """v_box AS (
  SELECT l_orderkey AS shot,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos,
         CAST(l_partkey % 1000 AS DOUBLE) AS x, CAST(l_suppkey * 10 AS DOUBLE) AS y, 12 * l_quantity AS w, 8 * l_quantity AS h,
         round(1 - 5 * l_discount, 6) AS confidence, CAST(l_linenumber AS INTEGER) AS type_no FROM lineitem)"""

#: Each page is a captured state; its elements are its links.
PAGE_SQL = """v_page AS (
  SELECT page_id AS id, url, coalesce(html, '') AS html,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
         sha256(coalesce(html, '')) AS visual_hash,
         list_sort(list_distinct(regexp_extract_all(coalesce(html, ''), '<a href="([^"]*)"', 1))) AS links FROM pages)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: str):
    """Milliseconds of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def events(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("session"), epoch_ms("ts").alias("ts_ms"), F.col("event_type").alias("type"), F.get_json_object("props", "$.k").cast("double").alias("x"), F.col("value").alias("y"))


def clicks(spark, d) -> DataFrame:
    return events(spark, d).select("id", (F.col("session") % 10).alias("session"), (F.col("id") * 5).alias("ts_ms"), "x", "y")


def frames(spark, d) -> DataFrame:
    px = F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 127.5).cast("int"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("frame_no"), F.col("label").alias("session"), (F.col("vec_id") * 100).alias("ts_ms"), px.alias("px"))


def frame_pairs(spark, d) -> DataFrame:
    w = Window.partitionBy("session").orderBy("frame_no")
    return frames(spark, d).withColumns({"prev_no": F.lag("frame_no").over(w), "prev_ts": F.lag("ts_ms").over(w), "prev_px": F.lag("px").over(w)}).filter("prev_no is not null")


def color_pairs(spark, d) -> DataFrame:
    p = frame_pairs(spark, d)
    back, negative = F.reverse, lambda c: F.transform(c, lambda x: 255 - x)
    return p.withColumns({"r": F.col("px"), "g": back("px"), "b": negative("px"), "prev_r": F.col("prev_px"), "prev_g": back("prev_px"), "prev_b": negative("prev_px")})


def steps(spark, d) -> DataFrame:
    state = F.concat("event_type", F.lit("_"), F.floor(F.col("value") / 10).cast("string"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), F.col("event_type").alias("kind"), state.alias("state"), F.lead(state).over(w).alias("next_state"))


def edges(spark, d) -> DataFrame:
    return steps(spark, d).filter("next_state is not null").select("session", "pos", "kind", F.col("state").alias("src"), F.col("next_state").alias("dst"))


def boxes(spark, d) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("bigint")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("shot"), pos.alias("pos"), (F.col("l_partkey") % 1000).cast("double").alias("x"), (F.col("l_suppkey") * 10).cast("double").alias("y"),
        (F.col("l_quantity") * 12).alias("w"), (F.col("l_quantity") * 8).alias("h"), F.round(1 - 5 * F.col("l_discount"), 6).alias("confidence"), F.col("l_linenumber").cast("int").alias("type_no"),
    )


def pages(spark, d) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    links = F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))))
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), "url", html.alias("html"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.sha2(html.cast("binary"), 256).alias("visual_hash"), links.alias("links"))


#: What an event type's molecules are.
KINDS = {"click": "interactive_button", "view": "container", "error": "text", "purchase": "input_field"}


def raw_documents(spark, d) -> DataFrame:
    """(path, raw): each user's events as a session document; times count from the user's first event."""
    from flowscope.sources import export

    s = steps(spark, d).select("pos", "kind", "state", "next_state", F.col("session").cast("string").alias("path"))
    ts = table(spark, d, "events").select(F.col("event_id").alias("pos"), epoch_ms("ts").alias("ms"))
    e = s.join(ts, "pos").withColumn("ts", F.col("ms") - F.min("ms").over(Window.partitionBy("path")))
    look = F.sha2(F.col("state"), 256).alias("hash")
    n = e.groupBy("path", "state").agg(F.min("ts").alias("ts"), F.count("*").alias("visits"), F.first("kind").alias("kind"))
    kind = F.coalesce(*[F.when(F.col("kind") == k, x) for k, x in KINDS.items()], F.lit("custom"))
    box = (F.col("visits") * 10).alias("x"), F.lit(0).alias("y"), F.lit(10).alias("w"), F.lit(10).alias("h")
    ways = e.filter("next_state is not null").groupBy("path", F.col("state").alias("src"), F.col("next_state").alias("dst")).agg(F.count("*").alias("n"), F.min("kind").alias("kind"))
    ways = ways.withColumn("probability", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("path", "src")), 6))
    formulas = e.groupBy("path").agg((1 + F.count("*") / 10000).alias("hi")).select("path", F.lit("q").alias("id"), F.lit("m").alias("element"), F.lit("width").alias("property"), F.lit("size * size / 20").alias("equation"), F.lit(1).alias("lo"), "hi")
    return export.documents(e.filter("kind = 'purchase'").select("path", "ts", look), n.select("path", F.col("state").alias("id"), kind.alias("type"), *box), n.select("path", F.col("state").alias("id"), look, "ts", "visits"), ways, formulas, "http://events.example/")


def documents(spark, d, change=None) -> DataFrame:
    """(path, raw, doc) of the users' documents, their texts changed by ``change`` of a column."""
    from flowscope.sources import schemas as sch

    rows = raw_documents(spark, d)
    if change:
        rows = rows.withColumn("raw", change(F.col("raw"), F.col("path").cast("bigint")))
    return rows.withColumn("doc", F.from_json("raw", sch.of(sch.DOCUMENT)))


DOC_SQL = """ev AS (SELECT CAST(user_id AS VARCHAR) AS path, event_id AS pos, event_type AS kind, event_type || '_' || CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS state,
  epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) AS ts, lead(event_type || '_' || CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events),
node AS (SELECT path, state AS id, min(ts) AS ts, count(*) AS visits, CASE any_value(kind) WHEN 'click' THEN 'interactive_button' WHEN 'view' THEN 'container' WHEN 'error' THEN 'text' WHEN 'purchase' THEN 'input_field' ELSE 'custom' END AS type FROM ev GROUP BY 1, 2),
way AS (SELECT DISTINCT path, state AS src, nxt AS dst FROM ev WHERE nxt IS NOT NULL)"""
