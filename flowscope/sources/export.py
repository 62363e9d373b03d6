"""Exports: each row of an export is a column of text or a struct; ordered pieces are joined by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowscope.operators.graph import with_cut


def to_json(df: DataFrame, path: str, pretty: bool = False) -> None:
    """One JSON object a line, binary columns as base64."""
    cols = [F.base64(c).alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes]
    text = F.to_json(F.struct(*cols), {"pretty": "true"} if pretty else {})
    df.select(text.alias("value")).write.mode("overwrite").text(path)


def _quoted(c):
    return F.regexp_replace(c, '"', '\\\\"')


def dot_lines(nodes: DataFrame, edges: DataFrame, direction: str = "LR") -> DataFrame:
    """(part, line) of a DOT graph from nodes (id, label, visits?, error?, terminal?) and edges (src, dst, label).

    Red: error, green: terminal, black: any other, where the flags are given. Quotes are escaped.
    """
    spark = nodes.sparkSession
    more = F.lit("")
    if "visits" in nodes.columns:
        more = F.concat(F.lit(" ("), F.col("visits").cast("string"), F.lit(")"))
    color = F.lit("")
    if "error" in nodes.columns:
        color = F.concat(F.lit(' color="'), F.when(F.col("error"), "red").when(F.col("terminal"), "green").otherwise("black"), F.lit('"'))
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('  "'), _quoted(F.col("id")), F.lit('" [label="'), _quoted(F.col("label")), more, F.lit('"'), color, F.lit("];")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('  "'), _quoted(F.col("src")), F.lit('" -> "'), _quoted(F.col("dst")), F.lit('" [label="'), _quoted(F.col("label")), F.lit('"];')).alias("line"))
    ends = spark.createDataFrame([(0, f"digraph states {{\n  rankdir={direction};"), (3, "}")], "part int, line string")
    return ends.unionByName(n).unionByName(e)


def cytoscape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json): an element a row; edges are numbered edge-<i> in the order of source, target and label.

    Edges are dealt by ranges and sorted; a partition's numbers go on where the one before ends, so no task has them all.
    """
    spark = edges.sparkSession
    dealt = with_cut(edges.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "src", "dst", "label").withColumn("part", F.spark_partition_id()))
    sizes = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}  # one row a partition
    first = [(p, sum(n for q, n in sizes.items() if q < p)) for p in sizes]
    offsets = spark.createDataFrame(first or [(0, 0)], "part int, first long")
    i = F.col("first") + F.row_number().over(Window.partitionBy("part").orderBy("src", "dst", "label")) - 1
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(F.struct(F.col("id"), F.col("label")).alias("data"))).alias("json"))
    e = dealt.join(F.broadcast(offsets), "part").withColumn("i", i).select(F.lit("edge"), F.to_json(F.struct(F.struct(F.concat(F.lit("edge-"), F.col("i").cast("string")).alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), "label").alias("data"))))
    return n.union(e)


def force_layout(nodes: DataFrame, edges: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, size, x, y) at seeded places and edges (source, target, weight) for a graph viewer."""
    place = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(10000)) / 10.0).alias("xy"[k])
    return nodes.select("id", "label", F.greatest(F.col("size"), F.lit(1)).alias("size"), place(0), place(1)), edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("n").alias("weight"))


def documents(keyframes: DataFrame, molecules: DataFrame, states: DataFrame, edges: DataFrame, equations: DataFrame, url: str) -> DataFrame:
    """(path, raw): session documents of the format's eight sections, one a ``path``, with their checksums.

    Rows have path and: keyframes ts, hash; molecules id, type, x, y, w, h; states id, hash, ts, visits; edges src, dst, kind,
    probability; equations id, element, property, equation, lo, hi. A document's rows meet in one row, so each must fit a worker.
    """
    from flowscope.operators.document import sealed

    none = lambda t="string": F.array().cast(f"array<{t}>")
    text = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    joined = lambda c: F.concat(F.lit("["), F.array_join(F.coalesce(c, F.array().cast("array<string>")), ","), F.lit("]"))
    rows = lambda df, order, item, name, *more: df.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, text(item).alias("_item")))), lambda e: e["_item"]).alias(name), *more)
    lit = lambda v, name: F.lit(v).alias(name)
    bounds = F.struct(F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height")).alias("static"), F.lit(None).cast("string").alias("dynamic"), none().alias("transformations"), lit(1, "zIndex"), lit(1, "opacity"))
    empty = lambda *names: F.struct(*(F.create_map().cast("map<string,string>").alias(n) for n in names))
    life = F.struct(F.struct(lit(0, "timestamp"), lit("page_load", "trigger"), F.lit(None).cast("string").alias("fromState"), F.lit("").alias("toState")).alias("created"), none().alias("modified"), F.lit(None).cast("string").alias("destroyed"), F.struct(none().alias("visible"), none().alias("hidden"), none().alias("partial")).alias("visibility"))
    look = F.struct(lit("", "primaryImage"), F.create_map().cast("map<string,string>").alias("alternateStates"), none("int").alias("colorFingerprint"), none("int").alias("shapeDescriptor"), lit("", "texturePattern"))
    m = rows(molecules, ["id"], F.struct("id", "type", look.alias("visualSignature"), bounds.alias("bounds"), empty("visual", "behavioral", "semantic", "performance").alias("properties"), F.create_map().cast("map<string,string>").alias("interactions"), none().alias("relationships"), life.alias("lifecycle")), "molecules")
    k = rows(keyframes, ["ts", "hash"], F.struct(F.col("ts").alias("timestamp"), lit("major", "significance"), F.col("hash").alias("visualHash"), lit(0, "deltaFromPrevious"), none().alias("associatedEvents")), "keyframes")
    n = rows(states, ["ts", "id"], F.struct("id", F.col("hash").alias("visualHash"), none().alias("molecules"), F.col("ts").alias("timestamp"), F.col("visits").alias("frequency"), lit(1, "stability")), "nodes", F.transform(F.array_sort(F.collect_list(F.struct("ts", "id"))), lambda x: x["id"]).alias("ids"))
    e = rows(edges, ["src", "dst"], F.struct(F.concat_ws(">", "src", "dst").alias("id"), F.col("src").alias("fromState"), F.col("dst").alias("toState"), F.struct(lit("interaction", "type"), F.create_map(F.lit("action"), "kind").alias("details"), none().alias("conditions")).alias("trigger"), lit(0, "duration"), "probability", lit(False, "reversible"), none().alias("animations")), "edges", F.collect_set("src").alias("leaves"), F.collect_set("dst").alias("led"))
    q = rows(equations, ["id"], F.struct("id", "element", "property", "equation", none().alias("variables"), F.struct(F.col("lo").alias("min"), F.col("hi").alias("max")).alias("constraints"), F.struct(none().alias("states"), F.lit(None).cast("string").alias("timeRange"), none().alias("viewports"), none().alias("conditions")).alias("domain"), lit(1, "accuracy")), "behavioralEquations")
    meta = F.struct(
        F.regexp_replace(F.md5(F.col("path").cast("binary")), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5").alias("captureId"), lit("1970-01-01T00:00:00.000Z", "captureTimestamp"),
        F.struct(lit("linux", "platform"), lit("", "browserEngine"), F.struct(lit("", "vendor"), lit("", "model"), lit("", "driver"), lit(0, "vram"), none().alias("features")).alias("gpuInfo"), F.struct(F.array(F.lit(0), F.lit(0)).alias("resolution"), lit(96, "dpi"), lit(24, "colorDepth"), lit(60, "refreshRate"), lit(False, "hdr")).alias("displayInfo")).alias("captureEnvironment"),
        lit(url, "targetUrl"), F.struct(*(lit(1, x) for x in ("overall", "visual", "behavioral", "timing", "color"))).alias("fidelityScore"), none().alias("viewportConfigurations"),
        F.struct(lit(60, "frameRate"), lit("srgb", "colorSpace"), lit("full", "captureMode"), lit(1, "interactionDepth"), lit("sampled", "scrollStrategy"), F.lit(None).cast("string").alias("networkThrottling")).alias("captureSettings"), none().alias("edgeCasesDetected"),
    )
    tensor = F.struct(lit("compressed", "format"), F.array(*[F.lit(0)] * 4).alias("dimensions"), lit("raw", "encoding"), lit("", "dataUrl"), lit(1, "compressionRatio"), lit(0, "temporalResolution"), F.array(F.lit(0), F.lit(0)).alias("spatialResolution"), lit(8, "bitDepth"))
    d = n
    for more in (k, m, e, q):
        d = d.join(more, "path", "left")
    start = F.coalesce(F.get(F.array_except("ids", F.coalesce("led", none())), F.lit(0)), F.get("ids", F.lit(0)))
    ends = text(F.struct(F.array_except("ids", F.coalesce("leaves", none())).alias("x")))
    trace = text(F.struct(*(none().alias(x) for x in ("renderingCommands", "networkSequence", "computedStyles", "performanceMetrics", "consoleOutput", "memorySnapshots"))))
    raw = F.concat(
        F.lit('{"version":"1.0","metadata":'), text(meta), F.lit(',"visualData":{"tensor4D":'), text(tensor), F.lit(',"keyframes":'), joined("keyframes"), F.lit(',"depthMaps":[],"colorProfiles":[]},"molecules":'), joined("molecules"),
        F.lit(',"stateGraph":{"nodes":'), joined("nodes"), F.lit(',"edges":'), joined("edges"), F.lit(',"initialState":"'), _quoted(start), F.lit('","terminalStates":'), F.regexp_extract(ends, r"(?s)^\{\"x\":(.*)\}$", 1),
        F.lit(',"stateGroups":[]},"executionTrace":'), trace, F.lit(',"behavioralEquations":'), joined("behavioralEquations"), F.lit("}"),
    )
    return sealed(d.select("path", raw.alias("raw")))


def _escape(c):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def tree_lines(boxes: DataFrame, html: bool = False) -> DataFrame:
    """(shot, path, line): each box under its parent, indented by depth; sorting by path draws the tree.

    Boxes and their parents are worked out once and kept as one table; a level's boxes are sought only among those with a parent.
    """
    from flowscope.operators.elements import parents, type_name

    rows = with_cut(parents(boxes.select("*", type_name().alias("type")), ("type", "w", "h")))
    key = F.lpad(F.col("pos").cast("string"), 19, "0")  # as many digits as a position can have
    look = ["shot", "pos", "path", "type", "w", "h", "depth"]
    out = level = rows.filter("parent is null").withColumns({"path": key, "depth": F.lit(0)}).select(*look)
    held, depth = rows.filter("parent is not null"), 0
    while not level.isEmpty():
        depth += 1
        up = level.select("shot", F.col("pos").alias("parent"), F.col("path").alias("above"))
        level = with_cut(held.join(up, ["shot", "parent"]).withColumns({"path": F.concat_ws("/", "above", key), "depth": F.lit(depth)}).select(*look))
        out = out.union(level)
    text = F.concat_ws(" ", "type", F.concat(F.col("w").cast("int").cast("string"), F.lit("x"), F.col("h").cast("int").cast("string")))
    line = F.concat(F.lit("<li style='margin-left:"), (F.col("depth") * 20).cast("string"), F.lit("px'>"), _escape(text), F.lit("</li>")) if html else F.concat(F.repeat(F.lit("  "), F.col("depth")), text)
    return out.select("shot", "path", line.alias("line"))


def report(states: DataFrame, transitions: DataFrame, most: int = 20) -> str:
    """An HTML page with totals, the first states and the most frequent transitions (a top-k report)."""
    n, m = states.count(), transitions.count()
    rows = states.orderBy("id").limit(most).select(F.concat(F.lit("<tr><td>"), _escape(F.col("id").cast("string")), F.lit("</td><td>"), _escape(F.col("title")), F.lit("</td></tr>")).alias("r")).collect()
    ways = transitions.orderBy(F.desc("n"), "src", "dst").limit(most).select(F.concat(F.lit("<tr><td>"), _escape(F.col("src")), F.lit("</td><td>"), _escape(F.col("dst")), F.lit("</td><td>"), F.col("n").cast("string"), F.lit("</td></tr>")).alias("r")).collect()
    return f"<html><body><p>{n} states, {m} transitions</p><table>{''.join(r.r or '' for r in rows)}</table><table>{''.join(r.r or '' for r in ways)}</table></body></html>"
