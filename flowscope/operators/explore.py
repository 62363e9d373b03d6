"""What to try next: elements (state, pos, selector, type, confidence, visible, enabled, text, top, left) and the explored set."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowscope.functions import scoring as sc
from flowscope.operators.scopes import VOID, Scopes

#: Roles, attributes and classes that make an element interactive, beside its tag (fixed values).
ROLES = ("button", "link", "checkbox", "radio", "tab", "menuitem")
MARKS = ("onclick", "ng-click", "data-click", "data-action")
CLASSES = ("btn", "button", "clickable")
#: Styles that hide an element and all within it.
UNSEEN = re.compile(r"(^|;)(display:none|visibility:hidden|opacity:0(\.0*)?(;|$)|(width|height):0(px)?(;|$))")


class _Elements(Scopes):
    def __init__(self):
        super().__init__()
        self.found, self.path, self.counts, self.hidden = [], [], [{}], [False]

    def began(self, tag, attrs):
        a = {k: v or "" for k, v in attrs.items()}
        n = self.counts[-1][tag] = self.counts[-1].get(tag, 0) + 1
        step = f"{tag}:nth-of-type({n})"
        hidden = self.hidden[-1] or "hidden" in a or bool(UNSEEN.search(a.get("style", "").replace(" ", "").lower()))
        if self._interactive(tag, a):
            selector = f"#{a['id']}" if a.get("id") else " > ".join([*self.path, step])
            self.found.append({
                "tag": tag, "role": a.get("role"), "kind": a.get("type"), "selector": selector, "hot": bool(a.keys() & {"onclick", "href", "role"}),
                "pointer": "cursor:pointer" in a.get("style", "").replace(" ", "").lower(), "visible": not hidden, "enabled": "disabled" not in a,
                "href": a.get("href"), "text": "",
            })
        if tag not in VOID:
            self.path.append(step)
            self.counts.append({})
            self.hidden.append(hidden)

    def ending(self, at):
        del self.path[at:], self.hidden[at + 1 :], self.counts[at + 1 :]

    @staticmethod
    def _interactive(tag, a):
        return bool(
            tag in ("button", "select", "textarea") or (tag == "a" and "href" in a) or (tag == "input" and a.get("type") != "hidden") or a.get("role") in ROLES
            or a.keys() & set(MARKS) or set(a.get("class", "").split()) & set(CLASSES) or ("tabindex" in a and a["tabindex"] != "-1")
        )

    def handle_data(self, data):
        if self.found and self.path and self.found[-1]["selector"].endswith(self.path[-1]) and not self.found[-1]["text"]:
            self.found[-1]["text"] = data.strip()[:100]


class _Nodes(Scopes):
    """All elements in order: tag, classes, attributes, and whether a video or canvas lies within."""

    def __init__(self):
        super().__init__()
        self.found, self.open = [], []

    def began(self, tag, attrs):
        a = {k: v or "" for k, v in attrs.items()}
        if tag in ("video", "canvas") and self.open:
            self.open[-1]["media"] = True
        node = {"tag": tag, "classes": a.get("class", "").split(), "attributes": list(a.items()), "media": False}
        self.found.append(node)
        if tag not in VOID:
            self.open.append(node)

    def ending(self, at):
        while len(self.open) > at:
            media = self.open.pop()["media"]
            if media and self.open:
                self.open[-1]["media"] = True


def page_nodes(pages: DataFrame) -> DataFrame:
    """(page, pos, tag, classes, attributes, media) of each page's elements; where they stand on the page is not in its text."""

    def run(batches):
        for b in batches:
            out = []
            for page, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out += [{"page": page, "pos": i} | n for i, n in enumerate(_Nodes().read(html).found)]
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    kinds = pa.schema([("page", pa.int64()), ("pos", pa.int64()), ("tag", pa.string()), ("classes", pa.list_(pa.string())), ("attributes", pa.map_(pa.string(), pa.string())), ("media", pa.bool_())])
    return pages.select(F.col("id").alias("page"), "html").mapInArrow(run, "page long, pos long, tag string, classes array<string>, attributes map<string,string>, media boolean")


#: Sections that hold content, by tag, class or attribute (fixed values).
SECTIONS = ("header", "nav", "main", "section", "article", "footer", ".hero", ".banner", "[data-section]")


def content_areas(nodes: DataFrame) -> DataFrame:
    """(page, pos, selector, top, bottom, height, importance) of nodes (see ``page_nodes``) with their top and height.

    A node is an area for each section selector that it fits; images that load late count 0.8, and the first node of each
    sign of endless scrolling 1.0.
    """
    has = lambda k, v=None: F.map_contains_key("attributes", k) if v is None else F.coalesce(F.try_element_at("attributes", F.lit(k)) == v, F.lit(False))
    marked = lambda c: F.array_contains("classes", c)
    fits = lambda s: marked(s[1:]) if s[0] == "." else has(s[1:-1]) if s[0] == "[" else F.col("tag") == s
    own = sc.importance(F.col("tag"), F.col("classes"), F.col("media"))
    area = lambda when, name, value: F.when(when, F.struct(F.lit(name).alias("selector"), value.alias("importance")))
    late = (F.col("tag") == "img") & (has("data-src") | has("loading", "lazy"))
    found = F.array_compact(F.array(*(area(fits(s), s, own) for s in SECTIONS), area(late, "lazy-image", F.lit(0.8))))
    place = ["page", "pos", "top", "height"]
    rows = nodes.select(*place, F.inline(found))
    for sign in (has("data-infinite-scroll"), marked("infinite-scroll"), has("data-pagination", "infinite")):
        first = nodes.filter(sign).groupBy("page").agg(F.min_by(F.struct("pos", "top", "height"), "pos").alias("n"))
        rows = rows.unionByName(first.select("page", "n.*", F.lit("infinite-scroll").alias("selector"), F.lit(1.0).alias("importance")))
    return rows.select("page", "pos", "selector", "top", (F.col("top") + F.col("height")).alias("bottom"), "height", "importance")


def detected(pages: DataFrame) -> DataFrame:
    """(state, pos, selector, type, confidence, visible, enabled, role, href, text) of each page's interactive elements, each node once.

    visible by the styles and attributes written in the page, an element's own and those around it (see ``seen`` for places);
    enabled unless disabled. The tree needs a parser, in Arrow batches; type and confidence are columns.
    """

    def run(batches):
        for b in batches:
            out = []
            for state, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out += [{"state": state, "pos": i} | e for i, e in enumerate(_Elements().read(html).found)]
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    kinds = pa.schema([("state", pa.int64()), ("pos", pa.int64()), ("tag", pa.string()), ("role", pa.string()), ("kind", pa.string()), ("selector", pa.string()), ("hot", pa.bool_()), ("pointer", pa.bool_()), ("visible", pa.bool_()), ("enabled", pa.bool_()), ("href", pa.string()), ("text", pa.string())])
    rows = pages.select(F.col("id").alias("state"), "html").mapInArrow(run, "state long, pos long, tag string, role string, kind string, selector string, hot boolean, pointer boolean, visible boolean, enabled boolean, href string, text string")
    return rows.select("state", "pos", "selector", sc.element_type(F.col("tag"), F.col("role"), F.col("kind")).alias("type"), sc.element_confidence(F.col("tag"), F.col("hot"), F.col("pointer")).alias("confidence"), "visible", "enabled", "role", "href", "text")


def seen(left, top, width, height, view_width, view_height, display="", visibility="", opacity=1.0, hidden_too: bool = False):
    """Whether an element is visible: it has a size, isn't hidden by its style and, unless ``hidden_too``, meets the view."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    left, top, width, height, display, visibility, opacity = map(as_col, (left, top, width, height, display, visibility, opacity))
    shown = (width > 0) & (height > 0) & (display != "none") & (visibility != "hidden") & (opacity != 0)
    inside = (top < as_col(view_height)) & (top + height > 0) & (left < as_col(view_width)) & (left + width > 0)
    return shown if hidden_too else shown & inside


def action(kind):
    """How an element is tried."""
    return F.when(kind.isin("input", "textarea"), "type").otherwise("click")


def by_importance(elements: DataFrame) -> DataFrame:
    """With ``rank`` within the state: confidence, visible first, type, then top to bottom and left to right."""
    order = [F.desc("confidence"), F.desc("visible"), F.desc(sc.lookup(sc.SORT_PRIORITY, F.col("type"), 0)), "top", "left", "pos"]
    return elements.withColumn("rank", F.row_number().over(Window.partitionBy("state").orderBy(*order)))


def with_priority(elements: DataFrame) -> DataFrame:
    return elements.withColumn("score", sc.element_priority(F.col("confidence"), F.col("type"), F.col("visible"), F.col("enabled"), F.col("text")))


def unexplored(elements: DataFrame, explored: DataFrame) -> DataFrame:
    return elements.join(explored.select("state", "selector"), ["state", "selector"], "left_anti")


def next_element(elements: DataFrame, explored: DataFrame, strategy="breadth-first", seed: int = 1) -> DataFrame:
    """(state, pos, selector): of each state the next element that isn't explored.

    breadth-first takes the first found, depth-first the last, priority the highest score, guided (also "intelligent")
    form elements, then links, then the rest by score, random any by a seeded hash; hybrid goes from first found to
    priority to random as 10 and then 50 elements of a state are explored. Any other name means breadth-first.
    """
    rows = with_priority(unexplored(elements, explored))
    t = F.col("type")
    tier = F.when(t.isin("input", "select", "textarea", "checkbox", "radio"), 0).when((t == "link") & F.contains(F.coalesce("href", F.lit("")), F.lit("/")), 1).otherwise(2)
    dice = F.xxhash64("state", "selector", F.lit(seed))
    order = {"depth-first": [F.desc("pos")], "priority": [F.desc("score"), F.col("pos")], "guided": [tier, F.desc("score"), F.col("pos")], "random": [dice]}
    order["intelligent"] = order["guided"]
    if strategy == "hybrid":
        done = explored.groupBy("state").agg(F.count("*").alias("done"))
        rows = rows.join(done, "state", "left").withColumn("done", F.coalesce("done", F.lit(0)))
        keys = [F.when(F.col("done") < 10, F.col("pos").cast("double")).when(F.col("done") < 50, -F.col("score").cast("double")).otherwise(dice.cast("double")), F.col("pos")]
    else:
        keys = [*strategy(rows), F.col("pos")] if callable(strategy) else order.get(strategy, [F.col("pos")])
    return queued(rows, keys).filter("place = 1").select("state", "pos", "selector")


def queued(rows: DataFrame, keys) -> DataFrame:
    """With ``place``: each row's place in its state's queue, 1 being the next."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("state").orderBy(*keys)))


def exploration_statistics(elements: DataFrame, explored: DataFrame, strategy: str = "breadth-first") -> DataFrame:
    """One row: the strategy, elements explored, elements left, and states with a score (those with elements)."""
    done = elements.join(explored.select("state", "selector").distinct(), ["state", "selector"], "left_semi").agg(F.count("*").alias("explored"))
    left = elements.agg(F.count("*").alias("n"), F.count_distinct("state").alias("scored"))
    # two tables of one row each
    return left.join(done).select(F.lit(strategy).alias("strategy"), "explored", (F.col("n") - F.col("explored")).alias("open"), "scored")


def failed(attempts: DataFrame) -> DataFrame:
    """Rows of interactions (state, selector, ts_ms, error) that came to nothing: clicks without a state they lead to."""
    return attempts.select(F.concat_ws("_", F.lit("failed"), F.col("state").cast("string"), F.col("ts_ms").cast("string")).alias("id"), F.lit("click").alias("type"), "selector", F.col("state").cast("string").alias("from_state"), F.lit(None).cast("string").alias("to_state"), "ts_ms", F.lit(False).alias("successful"), F.coalesce("error", F.lit("unknown")).alias("error"))


def open_counts(elements: DataFrame, explored: DataFrame) -> DataFrame:
    """(state, open): elements not explored yet, the order of guided exploration between states."""
    left = unexplored(elements, explored).groupBy("state").agg(F.count("*").alias("open"))
    return elements.select("state").distinct().join(left, "state", "left").withColumn("open", F.coalesce("open", F.lit(0)))


def state_priorities(elements: DataFrame, states: DataFrame) -> DataFrame:
    """(state, priority) from states (state, depth, url, title): many elements, small depth, forms and navigation first, errors last."""
    leads = (F.col("type") == "link") | F.coalesce(F.col("role") == "navigation", F.lit(False))
    e = elements.groupBy("state").agg(F.count("*").alias("n"), F.bool_or(F.col("type").isin("input", "select", "textarea")).alias("form"), F.bool_or(leads).alias("nav"))
    rows = states.join(e, "state", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    score = sc.state_priority(F.coalesce("n", F.lit(0)), F.col("depth"), no("form"), no("nav"), F.contains(F.coalesce("url", F.lit("")), F.lit("error")) | F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit("error")))
    return rows.select("state", score.cast("bigint").alias("priority"))


def scroll_positions(pages: DataFrame, view: int, exhaustive: bool = True) -> DataFrame:
    """(id, place, y) from (id, height): steps of four fifths of a view and then the bottom, or of a whole view."""
    step = F.floor(F.lit(view) * 0.8).cast("bigint") if exhaustive else F.lit(view).cast("bigint")
    at = F.when(F.col("height") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("height") - 1, step)).otherwise(F.array().cast("array<bigint>"))
    if exhaustive:
        at = F.concat(at, F.array(F.greatest(F.lit(0).cast("bigint"), F.col("height") - view)))
    return pages.select("id", F.posexplode(at).alias("place", "y"))


def checkpoints(areas: DataFrame, bottoms: DataFrame) -> DataFrame:
    """(page, y, delay): the top, areas (page, top, importance) over 0.7 from 100 above them, the bottom (page, y)."""
    mid = areas.filter("importance > 0.7").select("page", F.greatest(F.lit(0.0), F.col("top") - 100).alias("y"), F.lit(300).alias("delay"), F.lit(1).alias("part"))
    top = bottoms.select("page", F.lit(0.0).alias("y"), F.lit(2000).alias("delay"), F.lit(0).alias("part"))
    return top.unionByName(mid).unionByName(bottoms.select("page", F.col("y").cast("double").alias("y"), F.lit(500).alias("delay"), F.lit(2).alias("part")))


def progress(y, height):
    return F.coalesce(F.try_divide(y * F.lit(100.0), height), F.lit(0.0))
