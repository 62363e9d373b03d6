"""Captured states (pages): hashes, similarity, what is the same state."""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowscope.operators.scopes import VOID, Scopes


def tag_sequence(html):
    """Names of all opening tags in order, without scripts' contents and comments."""
    clean = F.regexp_replace(html, r"(?s)<!--.*?-->|<script.*?</script>", "<script>")
    return F.array_join(F.transform(F.regexp_extract_all(clean, F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), lambda t: F.lower(t)), ",")


def with_hashes(pages: DataFrame, hasher=None) -> DataFrame:
    """Adds struct_hash and combined_hash (of visual, structural and url); nulls count as empty.

    ``hasher`` makes a column of the html column; by default the SHA-256 of the tag sequence.
    """
    own = hasher or (lambda html: F.sha2(tag_sequence(html), 256))
    out = pages.withColumn("struct_hash", own(F.col("html")))
    return out.withColumn("combined_hash", F.sha2(F.concat_ws(":", F.coalesce("visual_hash", F.lit("")), "struct_hash", F.coalesce("url", F.lit(""))), 256))


#: Styles that take an element and all within it out of the tree.
HIDDEN = re.compile(r"(^|;)(display:none|visibility:hidden)")


class _Tree(Scopes):
    def __init__(self):
        super().__init__()
        self.root = {"tag": "body", "id": "", "classes": [], "children": []}
        self.open, self.nodes = [self.root], [self.root]

    def began(self, tag, attrs):
        node = {"tag": tag, "id": attrs.get("id") or "", "classes": sorted((attrs.get("class") or "").split()), "children": []}
        self.nodes.append(node)
        if not HIDDEN.search((attrs.get("style") or "").replace(" ", "").lower()):
            self.open[-1]["children"].append(node)
        if tag not in VOID:
            self.open.append(node)

    def ending(self, at):
        del self.open[at + 1 :]


def tree_text(html: str | None) -> str:
    """The body's tree as a browser writes it: tag, id and children where there are any, sorted classes; hidden elements left out.

    Ends that the page leaves out are filled in (see ``scopes``). A page without a body is its own body. Written without
    recursion, so depth is no concern.
    """
    tree = _Tree().read(html)
    quoted = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    out, todo = [], [next((n for n in tree.nodes[1:] if n["tag"] == "body"), tree.root)]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        out.append(f'{{"tag":{quoted(node["tag"])}' + (f',"id":{quoted(node["id"])}' if node["id"] else "") + f',"classes":{quoted(node["classes"])}')
        if node["children"]:
            out.append(',"children":[')
            todo.append("]}")
            for i, child in reversed(list(enumerate(node["children"]))):
                todo += [child, ","] if i else [child]
        else:
            out.append("}")
    return "".join(out)


def tree_hash(html: str | None) -> str:
    """SHA-256 of the tree of tags, ids, sorted classes and visible children."""
    return hashlib.sha256(tree_text(html).encode()).hexdigest()


def tree_hashes(pages: DataFrame) -> DataFrame:
    """(id, tree_hash): for trees the parsing has no DataFrame form."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tree_hash(h) for h in b.column(1).to_pylist()], pa.string())], ["id", "tree_hash"])

    return pages.select("id", "html").mapInArrow(run, "id long, tree_hash string")


def canonical(pages: DataFrame) -> DataFrame:
    """(id, same_as): the first state by id with the same combined hash, else with the same visual hash; an empty one matches nothing.

    First states are found by partial sums and joined back, so a hash that most pages share costs no task more than others.
    """
    rows = with_hashes(pages).select("id", "combined_hash", F.nullif("visual_hash", F.lit("")).alias("visual_hash"))
    first = lambda key, name: rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias(name))
    both = rows.join(first("combined_hash", "by_all"), "combined_hash", "left").join(first("visual_hash", "by_sight"), "visual_hash", "left")
    return both.select("id", F.least(F.coalesce("by_all", "id"), F.coalesce("by_sight", "id")).alias("same_as"))


def jaccard(a, b, empty=1.0):
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def structural_similarity(a, b, same_scroll=None, storage_a=None, storage_b=None):
    """0.7 for the elements' keys, 0.2 for the scroll position (0.8 of it if it differs), 0.1 for the storage's keys; 1 without elements."""
    scroll = F.lit(1.0) if same_scroll is None else F.when(same_scroll, 1.0).otherwise(0.8)
    storage = F.lit(1.0) if storage_a is None else jaccard(storage_a, storage_b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(0.7 * jaccard(a, b, 0.0) + 0.2 * scroll + 0.1 * storage)


def compared(pairs: DataFrame, visual=None, like: float = 0.95, alike: float = 0.9) -> DataFrame:
    """(a_id, b_id, visual, structural, differences, identical) of pairs of states: a_ and b_ of id, url, title, visual_hash, struct_hash, links,
    and where they are known scroll_x, scroll_y and storage (keys), which the structural similarity takes in.

    States with equal visual and structural hashes are identical, whatever else they hold; a null or empty hash, of a page that
    couldn't be hashed, equals none. ``visual`` is a column of
    visual similarity; without it hashes decide it and it is no difference by itself. differences are (kind, severity):
    visual and structural below their thresholds (critical below a half), content for another url (major) or title
    (minor), interaction for another number of elements (major if more than five). Identical needs no difference and both
    similarities.
    """
    c = lambda n: (F.col(f"a_{n}"), F.col(f"b_{n}"))
    differs = lambda n: ~c(n)[0].eqNullSafe(c(n)[1])
    same_hash = lambda n: F.coalesce((c(n)[0] == c(n)[1]) & (c(n)[0] != ""), F.lit(False))
    equal = same_hash("visual_hash") & same_hash("struct_hash")
    seen = F.when(same_hash("visual_hash"), 1.0).otherwise(0.0) if visual is None else visual
    scroll = ~differs("scroll_x") & ~differs("scroll_y") if {"a_scroll_x", "a_scroll_y"} <= set(pairs.columns) else None
    keys = [F.coalesce(k, F.array().cast("array<string>")) for k in c("storage")] if "a_storage" in pairs.columns else (None, None)
    sim, more = structural_similarity(*c("links"), scroll, *keys), F.abs(F.size("a_links") - F.size("b_links"))
    note = lambda when, kind, severity: F.when(when, F.struct(F.lit(kind).alias("kind"), severity.alias("severity")))
    low = lambda x: F.when(x < 0.5, "critical").otherwise("major")
    found = F.array_compact(F.array(
        note(F.lit(False) if visual is None else seen < like, "visual", low(seen)), note(sim < alike, "structural", low(sim)), note(differs("url"), "content", F.lit("major")), note(differs("title"), "content", F.lit("minor")),
        note(more > 0, "interaction", F.when(more > 5, "major").otherwise("minor")),
    ))
    none = F.array().cast("array<struct<kind:string,severity:string>>")
    out = pairs.withColumns({"_v": F.when(equal, 1.0).otherwise(seen), "_s": F.when(equal, 1.0).otherwise(sim), "_d": F.when(equal, none).otherwise(found)})
    return out.select("a_id", "b_id", F.col("_v").alias("visual"), F.col("_s").alias("structural"), F.col("_d").alias("differences"), (equal | ((F.col("_v") >= like) & (F.col("_s") >= alike) & (F.size("_d") == 0))).alias("identical"))


def neighbours(pages: DataFrame, key) -> DataFrame:
    """Each page with the next of its key, as a_ and b_ columns; scroll_x, scroll_y and storage go along where pages have them."""
    cols = ["id", "url", "title", "visual_hash", "struct_hash", "links", *(x for x in ("scroll_x", "scroll_y", "storage") if x in pages.columns)]
    w = Window.partitionBy("_key").orderBy("id")
    rows = with_hashes(pages).withColumn("_key", key)
    both = rows.select(*(F.col(c).alias(f"a_{c}") for c in cols), *(F.lead(c).over(w).alias(f"b_{c}") for c in cols))
    return both.filter("b_id is not null")
