"""Registered queries on captured states and what to explore."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowscope.operators import explore as ex
from flowscope.operators import states as st
from flowscope.plans import views as v

_HOST = r"^[^/]*//([^/?#]*)"


def _elements(s, d):
    """A page's links in order, as elements placed down the page."""
    html = F.coalesce("html", F.lit(""))
    tags = F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)">'), F.lit(1))
    texts = F.regexp_extract_all(html, F.lit(r'<a href="[^"]*">([^<]*)'), F.lit(1))
    rows = v.table(s, d, "pages").select(F.col("page_id").alias("state"), F.posexplode(F.arrays_zip(tags.alias("href"), texts.alias("text"))).alias("pos", "e"))
    return rows.select(
        "state", "pos", F.concat(F.lit("a"), F.col("pos").cast("string")).alias("selector"), F.when(F.col("pos") % 5 == 4, "button").otherwise("link").alias("type"), F.when(F.length("e.text") % 2 == 0, 0.9).otherwise(0.8).alias("confidence"),
        (F.length("e.text") % 3 != 0).alias("visible"), F.lit(True).alias("enabled"), F.when(F.col("pos") == 9, "navigation").alias("role"), F.col("e.href").alias("href"), F.col("e.text").alias("text"), (F.col("pos") * 20).alias("top"), (F.length("e.href") % 7).alias("left"),
    )


def _explored(s, d):
    return _elements(s, d).filter(F.length("href") <= 5).select("state", "selector")


def _next(strategy):
    return lambda s, d: ex.next_element(_elements(s, d), _explored(s, d), strategy).select("state", F.col("pos").cast("bigint").alias("pos"))


def _compared(s, d):
    return st.compared(st.neighbours(v.pages(s, d), F.regexp_extract("url", _HOST, 1)))


def _placed(s, d):
    """Pages scrolled to a place by their number, with the names of their url's parameters as their storage's keys."""
    keys = F.array_sort(F.array_distinct(F.regexp_extract_all("url", F.lit("[?&]([a-z]+)="), F.lit(1))))
    pages = v.pages(s, d).withColumns({"scroll_x": F.col("id") % 3, "scroll_y": F.floor(F.col("id") / 3) % 2, "storage": keys})
    return st.compared(st.neighbours(pages, F.regexp_extract("url", _HOST, 1)))


def _states(s, d):
    return v.pages(s, d).select(F.col("id").alias("state"), (F.length("url") % 6).alias("depth"), F.regexp_replace("url", "/9", "/error9").alias("url"), "title")


def _heights(s, d):
    return v.table(s, d, "pages").select(F.col("page_id").alias("id"), F.length(F.coalesce("html", F.lit(""))).cast("bigint").alias("height"))


QUERIES = {
    "state_hashes": lambda s, d: st.with_hashes(v.pages(s, d)).select("id", "visual_hash", "struct_hash", "combined_hash"),
    "same_states": lambda s, d: st.canonical(v.pages(s, d)),
    "state_comparison": lambda s, d: _compared(s, d).select("a_id", "b_id", "visual", F.round("structural", 6).alias("structural"), F.array_join(F.transform("differences", lambda e: F.concat_ws(":", e["kind"], e["severity"])), ",").alias("differences"), "identical"),
    "placed_comparison": lambda s, d: _placed(s, d).select("a_id", "b_id", F.round("structural", 6).alias("structural"), F.size("differences").cast("bigint").alias("n"), "identical"),
    "tag_hashes": lambda s, d: st.with_hashes(v.pages(s, d), lambda html: F.md5(st.tag_sequence(html))).select("id", "struct_hash"),
    "tree_hashes": lambda s, d: st.tree_hashes(v.pages(s, d)),
    "detected_elements": lambda s, d: ex.detected(v.pages(s, d)).groupBy(F.col("state").alias("id"), "type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence")),
    "elements_by_importance": lambda s, d: ex.by_importance(_elements(s, d)).select("state", F.col("pos").cast("bigint").alias("pos"), "rank"),
    "element_priorities": lambda s, d: ex.with_priority(_elements(s, d)).select("state", F.col("pos").cast("bigint").alias("pos"), F.round("score", 4).alias("score")),
    "open_elements": lambda s, d: ex.open_counts(_elements(s, d), _explored(s, d)),
    "next_breadth_first": _next("breadth-first"),
    "next_depth_first": _next("depth-first"),
    "next_by_priority": _next("priority"),
    "next_guided": _next("guided"),
    "next_hybrid": _next("hybrid"),
    "next_random": lambda s, d: ex.next_element(_elements(s, d), _explored(s, d), "random"),
    "state_priorities": lambda s, d: ex.state_priorities(_elements(s, d), _states(s, d)),
    "content_areas": lambda s, d: ex.content_areas(ex.page_nodes(v.pages(s, d)).withColumns({"top": F.col("pos") * 20, "height": F.lit(20)})).groupBy("page", "selector").agg(F.count("*").alias("n"), F.max("importance").alias("importance")),
    "exploration_statistics": lambda s, d: ex.exploration_statistics(_elements(s, d), _explored(s, d), "guided"),
    "next_by_own_order": lambda s, d: ex.next_element(_elements(s, d), _explored(s, d), lambda rows: [F.length("text").desc(), "href"]).select("state", F.col("pos").cast("bigint").alias("pos")),
    "failed_interactions": lambda s, d: ex.failed(v.table(s, d, "events").filter("event_type = 'error'").select(F.col("user_id").alias("state"), F.concat(F.lit("#e"), F.col("event_id")).alias("selector"), v.epoch_ms("ts").alias("ts_ms"), F.get_json_object("props", "$.k").alias("error"))).select("id", "type", "selector", "from_state", "successful", "error"),
    "visible_boxes": lambda s, d: v.boxes(s, d).select("shot", "pos", ex.seen(F.col("x") - 400, F.col("y") - 100, F.col("w"), F.col("h"), 300, 200, opacity=F.col("confidence")).alias("visible")),
    "element_actions": lambda s, d: _elements(s, d).groupBy("type", ex.action(F.col("type")).alias("action")).agg(F.count("*").alias("n")),
    "scroll_exhaustive": lambda s, d: ex.scroll_positions(_heights(s, d), 1000).select("id", F.col("place").cast("bigint").alias("place"), "y"),
    "scroll_sampled": lambda s, d: ex.scroll_positions(_heights(s, d), 1000, False).select("id", F.col("place").cast("bigint").alias("place"), "y", F.lit(0).alias("z")).drop("z"),
    "scroll_checkpoints": lambda s, d: ex.checkpoints(v.boxes(s, d).select(F.col("shot").alias("page"), F.col("y").alias("top"), F.col("confidence").alias("importance")), v.boxes(s, d).groupBy(F.col("shot").alias("page")).agg(F.max(F.col("y") + F.col("h")).alias("y"))),
    "page_types": lambda s, d: v.pages(s, d).groupBy(F.coalesce(F.nullif(F.regexp_extract("html", r'<html lang="([a-z]+)"', 1), F.lit("")), F.lit("unknown")).alias("type")).agg(F.count("*").alias("n")),
}

_P = f"WITH {v.PAGE_SQL}, v_hash AS (SELECT *, sha256(array_to_string(list_transform(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>', '<script>', 'g'), '<([a-zA-Z][a-zA-Z0-9]*)', 1), lambda t: lower(t)), ',')) AS struct_hash FROM v_page), v_all AS (SELECT *, sha256(visual_hash || ':' || struct_hash || ':' || coalesce(url, '')) AS combined_hash FROM v_hash)"
_EL = """WITH l AS (SELECT page_id AS state, regexp_extract_all(coalesce(html, ''), '<a href="([^"]*)">', 1) AS hs, regexp_extract_all(coalesce(html, ''), '<a href="[^"]*">([^<]*)', 1) AS ts FROM pages),
u AS (SELECT state, unnest(range(0, len(hs))) AS pos, unnest(hs) AS href, unnest(ts) AS text FROM l),
el AS (SELECT state, pos, href, text, CASE WHEN pos % 5 = 4 THEN 'button' ELSE 'link' END AS type, CASE WHEN length(text) % 2 = 0 THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS confidence, length(text) % 3 <> 0 AS visible, pos * 20 AS top, length(href) % 7 AS "left", length(href) <= 5 AS done FROM u),
pr AS (SELECT *, confidence * 100 + CASE WHEN type = 'button' THEN 50 ELSE 40 END + CASE WHEN visible THEN 20 ELSE 0 END + 10 + CASE WHEN length(text) BETWEEN 1 AND 49 THEN 15 ELSE 0 END
  + CASE WHEN regexp_matches(lower(text), 'submit|next|continue|login|search|add|create') THEN 25 ELSE 0 END - CASE WHEN regexp_matches(lower(text), 'logout|exit|cancel|close') THEN 20 ELSE 0 END AS score FROM el),
dn AS (SELECT state, count(*) FILTER (done) AS n FROM el GROUP BY state)"""


def _pick(order):
    return f"{_EL} SELECT state, pos FROM (SELECT state, pos, row_number() OVER (PARTITION BY state ORDER BY {order}) AS k FROM pr JOIN dn USING (state) WHERE NOT done) WHERE k = 1"


ORACLE = {
    "state_hashes": f"{_P} SELECT id, visual_hash, struct_hash, combined_hash FROM v_all",
    "tag_hashes": f"{_P} SELECT id, md5(array_to_string(list_transform(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>', '<script>', 'g'), '<([a-zA-Z][a-zA-Z0-9]*)', 1), lambda t: lower(t)), ',')) AS struct_hash FROM v_page",
    "same_states": f"{_P} SELECT id, least(min(id) OVER (PARTITION BY combined_hash), min(id) OVER (PARTITION BY visual_hash)) AS same_as FROM v_all",
    "state_comparison": f"""{_P}, k AS (SELECT *, regexp_extract(url, '^[^/]*//([^/?#]*)', 1) AS host FROM v_all),
n AS (SELECT id AS a_id, lead(id) OVER w AS b_id, links AS al, lead(links) OVER w AS bl, visual_hash AS av, lead(visual_hash) OVER w AS bv, struct_hash AS ac, lead(struct_hash) OVER w AS bc, url AS au, lead(url) OVER w AS bu, title AS ta, lead(title) OVER w AS tb FROM k WINDOW w AS (PARTITION BY host ORDER BY id)),
m AS (SELECT *, len(list_distinct(list_concat(al, bl))) AS un, len(list_intersect(al, bl)) AS inter FROM n WHERE b_id IS NOT NULL),
q AS (SELECT *, CASE WHEN un = 0 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE * inter / un + 0.2::DOUBLE + 0.1::DOUBLE END AS sim, av = bv AND ac = bc AS eq, abs(len(al) - len(bl)) AS more FROM m),
z AS (SELECT *, concat_ws(',', CASE WHEN sim < 0.5 THEN 'structural:critical' WHEN sim < 0.9 THEN 'structural:major' END, CASE WHEN au IS DISTINCT FROM bu THEN 'content:major' END, CASE WHEN ta IS DISTINCT FROM tb THEN 'content:minor' END, CASE WHEN more > 5 THEN 'interaction:major' WHEN more > 0 THEN 'interaction:minor' END) AS diff FROM q)
SELECT a_id, b_id, CASE WHEN eq OR av = bv THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS visual, round(CASE WHEN eq THEN 1.0::DOUBLE ELSE sim END, 6) AS structural, CASE WHEN eq THEN '' ELSE diff END AS differences, eq OR (av = bv AND sim >= 0.9 AND diff = '') AS identical FROM z""",
    "detected_elements": r"""SELECT page_id AS id, 'link' AS type, n, 0.9::DOUBLE AS confidence FROM (SELECT page_id, len(regexp_extract_all(regexp_replace(coalesce(html, ''), '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '<a [^>]*href=')) AS n FROM pages) WHERE n > 0""",
    "elements_by_importance": f"{_EL} SELECT state, pos, row_number() OVER (PARTITION BY state ORDER BY confidence DESC, visible DESC, type, top, \"left\", pos) AS rank FROM el",
    "element_priorities": f"{_EL} SELECT state, pos, round(score, 4) AS score FROM pr",
    "open_elements": f"{_EL} SELECT state, count(*) FILTER (NOT done) AS open FROM el GROUP BY state",
    "next_breadth_first": _pick("pos"),
    "next_depth_first": _pick("pos DESC"),
    "next_by_priority": _pick("score DESC, pos"),
    "next_guided": _pick("CASE WHEN type = 'link' AND contains(href, '/') THEN 1 ELSE 2 END, score DESC, pos"),
    "next_hybrid": _pick("CASE WHEN n < 10 THEN pos ELSE -score END, pos"),
    "state_priorities": f"""{_EL}, e AS (SELECT state, count(*) AS n, bool_or(type = 'link' OR pos = 9) AS nav FROM el GROUP BY state)
SELECT page_id AS state, coalesce(n, 0) * 10 + (10 - length(url) % 6) * 5 + CASE WHEN nav THEN 15 ELSE 0 END - CASE WHEN contains(replace(url, '/9', '/error9'), 'error') OR contains(lower(coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '')), 'error') THEN 30 ELSE 0 END AS priority FROM pages LEFT JOIN e ON state = page_id""",
    "content_areas": r"""WITH c AS (SELECT page_id AS page, regexp_replace(coalesce(html, ''), '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g') AS h FROM pages),
u AS (SELECT page, unnest(['header', 'nav', 'main', 'section', 'article', 'footer']) AS selector, h FROM c)
SELECT page, selector, len(regexp_extract_all(h, '<' || selector || '[ >]')) AS n, CASE selector WHEN 'main' THEN 1.0::DOUBLE WHEN 'header' THEN 0.9 ELSE 0.5 END AS importance FROM u WHERE len(regexp_extract_all(h, '<' || selector || '[ >]')) > 0""",
    "exploration_statistics": f"{_EL} SELECT 'guided' AS strategy, count(*) FILTER (done) AS explored, count(*) FILTER (NOT done) AS open, count(DISTINCT state) AS scored FROM el",
    "next_by_own_order": _pick("length(text) DESC, href, pos"),
    "failed_interactions": "SELECT 'failed_' || user_id || '_' || (epoch_us(ts) // 1000) AS id, 'click' AS type, '#e' || event_id AS selector, CAST(user_id AS VARCHAR) AS from_state, false AS successful, coalesce(json_extract_string(props, '$.k'), 'unknown') AS error FROM events WHERE event_type = 'error'",
    "visible_boxes": f"WITH {v.BOX_SQL} SELECT shot, pos, w > 0 AND h > 0 AND confidence <> 0 AND y - 100 < 200 AND y - 100 + h > 0 AND x - 400 < 300 AND x - 400 + w > 0 AS visible FROM v_box",
    "element_actions": f"{_EL} SELECT type, 'click' AS action, count(*) AS n FROM el GROUP BY type",
    "scroll_exhaustive": "WITH h AS (SELECT page_id AS id, length(coalesce(html, '')) AS height FROM pages), l AS (SELECT id, list_append(range(0, height, 800), greatest(0, height - 1000)) AS ys FROM h) SELECT id, unnest(range(0, len(ys))) AS place, unnest(ys) AS y FROM l",
    "scroll_sampled": "WITH h AS (SELECT page_id AS id, length(coalesce(html, '')) AS height FROM pages), l AS (SELECT id, range(0, height, 1000) AS ys FROM h) SELECT id, unnest(range(0, len(ys))) AS place, unnest(ys) AS y FROM l",
    "scroll_checkpoints": f"""WITH {v.BOX_SQL}, b AS (SELECT shot AS page, max(y + h) AS y FROM v_box GROUP BY shot)
SELECT page, 0.0::DOUBLE AS y, 2000 AS delay, 0 AS part FROM b UNION ALL SELECT page, y, 500, 2 FROM b UNION ALL SELECT shot, greatest(0, y - 100), 300, 1 FROM v_box WHERE confidence > 0.7""",
    "page_types": """SELECT coalesce(nullif(regexp_extract(coalesce(html, ''), '<html lang="([a-z]+)"', 1), ''), 'unknown') AS type, count(*) AS n FROM pages GROUP BY 1""",
}
# the comparison of states with the place they are scrolled to and their storage
_KEYS_OF = "list_distinct(regexp_extract_all(url, '[?&]([a-z]+)=', 1))"
ORACLE["placed_comparison"] = (
    ORACLE["state_comparison"]
    .replace("title AS ta,", f"title AS ta, id % 3 = lead(id) OVER w % 3 AND id // 3 % 2 = lead(id) OVER w // 3 % 2 AS still, {_KEYS_OF} AS ka, lead({_KEYS_OF}) OVER w AS kb,")
    .replace("0.2::DOUBLE + 0.1::DOUBLE END", "0.2::DOUBLE * CASE WHEN still THEN 1 ELSE 0.8::DOUBLE END + 0.1::DOUBLE * CASE WHEN len(list_concat(ka, kb)) = 0 THEN 1 ELSE len(list_intersect(ka, kb)) / len(list_distinct(list_concat(ka, kb))) END END")
)
ORACLE["placed_comparison"] = f"SELECT a_id, b_id, structural, CASE WHEN differences = '' THEN 0 ELSE len(string_split(differences, ',')) END AS n, identical FROM ({ORACLE['placed_comparison']})"
