"""Queries on session documents: rows (path, raw, doc) as ``sources.readers.documents`` gives them, one a document."""

from __future__ import annotations

import json
import re
from collections import deque

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowscope.functions import equations as eq
from flowscope.functions.jsjson import checksum, read, stringify

#: Where the parts of a document are that queries take apart.
PARTS = {
    "keyframes": "visualData.keyframes", "depthMaps": "visualData.depthMaps", "colorProfiles": "visualData.colorProfiles", "molecules": "molecules", "states": "stateGraph.nodes", "edges": "stateGraph.edges", "stateGroups": "stateGraph.stateGroups",
    "equations": "behavioralEquations", "rendering": "executionTrace.renderingCommands", "styles": "executionTrace.computedStyles", "metrics": "executionTrace.performanceMetrics", "memory": "executionTrace.memorySnapshots", "crossValidation": "validationChecksums.crossValidation",
}
#: Sections with a checksum, and its name (fixed values).
SUMMED = {"visualData": "visualDataChecksum", "molecules": "moleculeTreeChecksum", "stateGraph": "stateGraphChecksum"}


def part(docs: DataFrame, name: str) -> DataFrame:
    """(path, pos, ...) of an array of the document; ``pos`` is the order in it."""
    return docs.select("path", F.posexplode(F.col(f"doc.{PARTS[name]}")).alias("pos", "r")).select("path", "pos", "r.*")


def state_molecules(docs: DataFrame) -> DataFrame:
    """(path, state, moleculeId, properties, bounds, visible) of what each state shows."""
    s = part(docs, "states").select("path", F.col("id").alias("state"), F.explode("molecules").alias("m"))
    return s.select("path", "state", "m.*")


def of_type(docs: DataFrame, kind: str) -> DataFrame:
    return part(docs, "molecules").filter(F.col("type") == kind)


def type_counts(docs: DataFrame) -> DataFrame:
    return part(docs, "molecules").groupBy("path", "type").agg(F.count("*").alias("n"))


def first_metric(docs: DataFrame, kind: str) -> DataFrame:
    """(path, value): the first measured value of a kind, 0 if there is none."""
    best = part(docs, "metrics").filter(F.col("type") == kind).groupBy("path").agg(F.min_by("value", "pos").alias("value"))
    return docs.select("path").join(best, "path", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def state_at(docs: DataFrame, ts_ms: float) -> DataFrame:
    """(path, state): the latest state not after the time, the first in the document of equal ones; null if there is none."""
    best = part(docs, "states").filter(F.col("timestamp") <= ts_ms).groupBy("path").agg(F.max_by("id", F.struct("timestamp", -F.col("pos"))).alias("state"))
    return docs.select("path").join(best, "path", "left")


def state_difference(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(path, difference): 0 if the two states look the same, else 1. A state that is missing is an error."""
    look = lambda name: F.filter("doc.stateGraph.nodes", lambda n: n["id"] == name)
    s = docs.select("path", F.get(look(a), F.lit(0)).alias("x"), F.get(look(b), F.lit(0)).alias("y"))
    known = F.when(F.col("x").isNull() | F.col("y").isNull(), F.raise_error(F.lit("no such state")).cast("int"))
    return s.select("path", F.coalesce(known, F.when(F.col("x.visualHash") == F.col("y.visualHash"), 0).otherwise(1)).alias("difference"))


def path_between(docs: DataFrame, start: str, end: str) -> DataFrame:
    """(path, distance, states) of each document in which transitions lead from ``start`` to ``end``: the fewest, of equal ways the least.

    A document's transitions are in its row, so each search is done where the row is, without rounds over all documents.
    """

    def way(src: list | None, dst: list | None) -> list[str] | None:
        on: dict[str, list[str]] = {}
        for a, b in set(zip(src or (), dst or (), strict=True)):
            if a is not None and b is not None:
                on.setdefault(a, []).append(b)
        came, queue = {start: None}, deque([start])
        # states are met in the order of their ways, as each one's next states come sorted
        while queue and end not in came:
            at = queue.popleft()
            for b in sorted(on.get(at, ())):
                if b not in came:
                    came[b] = at
                    queue.append(b)
        if end not in came:
            return None
        out = [end]
        while came[out[-1]] is not None:
            out.append(came[out[-1]])
        return out[::-1]

    def run(batches):
        for b in batches:
            found = [(p, way(src.as_py(), dst.as_py())) for p, src, dst in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True)]
            found = [(p, len(w) - 1, w) for p, w in found if w]
            columns = [pa.array([r[i] for r in found], t) for i, t in enumerate((pa.string(), pa.int32(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, ["path", "distance", "states"])

    ends = docs.select("path", F.col(f"doc.{PARTS['edges']}.fromState").alias("src"), F.col(f"doc.{PARTS['edges']}.toState").alias("dst"))
    return ends.mapInArrow(run, "path string, distance int, states array<string>")


def equation(docs: DataFrame, element: str, name: str) -> DataFrame:
    """(path, equation, min, max): the first for the element and property."""
    rows = part(docs, "equations").filter((F.col("element") == element) & (F.col("property") == name))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("pos"))).filter("k = 1")
    return first.select("path", "equation", "constraints.min", "constraints.max")


def evaluated(docs: DataFrame, element: str, name: str, values: dict[str, float]) -> DataFrame:
    """(path, value) of that equation with the values, kept within its bounds; null where it divides by zero."""

    def run(batches):
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            out = [(p, eq.evaluate(t, values, lo, hi)) for p, t, lo, hi in rows]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], ["path", "value"])

    return equation(docs, element, name).mapInArrow(run, "path string, value double")


#: Bytes of documents that a worker has in hand at a time, and in a batch on the way to it; a longer document comes alone.
PIECE_BYTES, BATCH_BYTES = 1 << 20, 4 << 20


def _pieces(batches):
    """The rows of batches (path, raw, ...) in slices of about PIECE_BYTES of raw, so that the texts made of them stay few."""
    for b in batches:
        at, total = 0, 0
        sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
        for i, n in enumerate(sizes):
            if i > at and total + n > PIECE_BYTES:
                yield b.slice(at, i - at)
                at, total = i, 0
            total += n
        yield b.slice(at)
        pa.default_memory_pool().release_unused()


def _by_pieces(docs: DataFrame, run, schema: str) -> DataFrame:
    """``docs`` (path, raw, ...) through ``run``, a generator over slices of batches.

    Batches lie outside the heap, several at once where one pass follows another, hence the session's bound on their bytes
    is lowered to BATCH_BYTES where it is higher.
    """
    spark, key = docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)
    return docs.mapInArrow(lambda batches: run(_pieces(batches)), schema)


def subset(docs: DataFrame, start: float | None = None, end: float | None = None, molecules: list[str] | None = None, states: list[str] | None = None) -> DataFrame:
    """The documents (path, raw, doc) cut to keyframes and states of a time (both ends included, a missing one open), molecules by id, states and edges by state ids.

    With a time alone edges stay, also where one of their states has gone, as documents have always been cut. All else
    stays as it is written, and the checksums are those of what is left.
    """
    schema = docs.schema["doc"].dataType
    lo, hi = start or 0, float("inf") if not end else end

    def cut(doc: dict) -> dict:
        if start is not None or end is not None:
            visual, graph = doc["visualData"], doc["stateGraph"]
            visual["keyframes"] = [k for k in visual["keyframes"] if lo <= k["timestamp"] <= hi]
            graph["nodes"] = [n for n in graph["nodes"] if lo <= n["timestamp"] <= hi]
        if molecules is not None:
            doc["molecules"] = [m for m in doc["molecules"] if m["id"] in molecules]
        if states is not None:
            graph = doc["stateGraph"]
            graph["nodes"] = [n for n in graph["nodes"] if n["id"] in states]
            graph["edges"] = [e for e in graph["edges"] if e["fromState"] in states and e["toState"] in states]
        return doc

    return _rewritten(docs, cut).withColumn("doc", F.from_json("raw", schema))


def section_checksums(doc: dict, write=stringify) -> dict[str, str]:
    """A document's three checksums: SHA-256 of the sections as a browser writes them."""
    return {name: f"sha256:{checksum(doc[section], write)}" for section, name in SUMMED.items() if section in doc}


def _rewritten(docs: DataFrame, change) -> DataFrame:
    """(path, raw) of the changed documents with their checksums made anew."""

    def run(batches):
        for b in batches:
            out = []
            for raw in b.column(1).to_pylist():
                doc, write = read(raw)
                doc = change(doc)
                doc["validationChecksums"] = {**section_checksums(doc, write), "crossValidation": (doc.get("validationChecksums") or {}).get("crossValidation", [])}
                out.append(write(doc))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["path", "raw"])

    return _by_pieces(docs.select("path", "raw"), run, "path string, raw string")


def sealed(docs: DataFrame) -> DataFrame:
    """(path, raw): the documents with the checksums of what they hold."""
    return _rewritten(docs, lambda doc: doc)


def checksums(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, section, stored, actual): SHA-256 of each summed section as a browser would write it, from the raw text.

    ``keep`` names columns of the documents that go with each section.
    """

    def run(batches):
        for b in batches:
            out = []
            for i, (path, raw) in enumerate(zip(*(c.to_pylist() for c in b.columns[:2]), strict=True)):
                doc, write = read(raw)
                stored, actual = doc.get("validationChecksums") or {}, section_checksums(doc, write)
                out += [(path, k, stored.get(name), actual[name], i) for k, name in SUMMED.items() if name in actual]
            at = pa.array([r[4] for r in out], pa.int64())
            kept = [c.take(at) for c in b.columns[2:]]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in out], pa.string()) for i in range(4)), *kept], ["path", "section", "stored", "actual", *keep])

    rows = docs.select("path", "raw", *keep)
    more = "".join(f", `{c}` {kind}" for c, kind in rows.dtypes[2:])
    return _by_pieces(rows, run, f"path string, section string, stored string, actual string{more}")


#: What the format asks for (fixed values): parts that must be there, by the place of what holds them; [] is each of an array.
REQUIRED = {
    "": ["version", "metadata", "visualData", "molecules", "stateGraph", "executionTrace", "behavioralEquations", "validationChecksums"],
    "metadata": ["captureId", "captureTimestamp", "captureEnvironment", "targetUrl", "fidelityScore", "viewportConfigurations", "captureSettings"],
    "metadata.captureEnvironment": ["platform", "browserEngine", "gpuInfo", "displayInfo"],
    "metadata.captureEnvironment.gpuInfo": ["vendor", "model", "driver", "vram", "features"],
    "metadata.captureEnvironment.displayInfo": ["resolution", "dpi", "colorDepth", "refreshRate", "hdr"],
    "metadata.fidelityScore": ["overall", "visual", "behavioral", "timing", "color"],
    "metadata.viewportConfigurations[]": ["name", "width", "height", "deviceScaleFactor", "userAgent", "hasTouch"],
    "metadata.captureSettings": ["frameRate", "colorSpace", "captureMode", "interactionDepth", "scrollStrategy"],
    "metadata.edgeCasesDetected[]": ["type", "description", "handlingStrategy", "occurrences"],
    "visualData": ["tensor4D", "keyframes", "depthMaps", "colorProfiles"],
    "visualData.tensor4D": ["format", "dimensions", "encoding", "dataUrl", "compressionRatio", "temporalResolution", "spatialResolution", "bitDepth"],
    "visualData.keyframes[]": ["timestamp", "significance", "visualHash", "deltaFromPrevious", "associatedEvents"],
    "visualData.depthMaps[]": ["timestamp", "resolution", "encoding", "dataUrl", "minDepth", "maxDepth"],
    "visualData.colorProfiles[]": ["space", "gamut", "whitePoint", "transferFunction"],
    "molecules[]": ["id", "type", "visualSignature", "bounds", "properties", "interactions", "relationships", "lifecycle"],
    "molecules[].visualSignature": ["primaryImage", "alternateStates", "colorFingerprint", "shapeDescriptor", "texturePattern"],
    "molecules[].bounds": ["static", "dynamic", "transformations", "zIndex", "opacity"],
    "molecules[].properties": ["visual", "behavioral", "semantic", "performance"],
    "molecules[].relationships[]": ["type", "target", "strength", "bidirectional", "metadata"],
    "molecules[].lifecycle": ["created", "modified", "destroyed", "visibility"],
    "molecules[].lifecycle.visibility": ["visible", "hidden", "partial"],
    "stateGraph": ["nodes", "edges", "initialState", "terminalStates", "stateGroups"],
    "stateGraph.nodes[]": ["id", "visualHash", "molecules", "timestamp", "frequency", "stability"],
    "stateGraph.nodes[].molecules[]": ["moleculeId", "properties", "bounds", "visible"],
    "stateGraph.nodes[].molecules[].bounds": ["x", "y", "width", "height"],
    "stateGraph.edges[]": ["id", "fromState", "toState", "trigger", "duration", "probability", "reversible", "animations"],
    "stateGraph.edges[].trigger": ["type", "details", "conditions"],
    "stateGraph.stateGroups[]": ["id", "name", "states", "type", "metadata"],
    "executionTrace": ["renderingCommands", "networkSequence", "computedStyles", "performanceMetrics", "consoleOutput", "memorySnapshots"],
    "behavioralEquations[]": ["id", "element", "property", "equation", "variables", "constraints", "domain", "accuracy"],
    "behavioralEquations[].variables[]": ["name", "type", "range", "unit"],
    "behavioralEquations[].domain": ["states", "timeRange", "viewports", "conditions"],
    "validationChecksums": ["visualDataChecksum", "moleculeTreeChecksum", "stateGraphChecksum", "crossValidation"],
    "validationChecksums.crossValidation[]": ["source", "target", "method", "score", "details"],
}
#: Values that a part may have (fixed values).
ALLOWED = {
    "metadata.captureEnvironment.platform": ["windows", "linux", "macos"],
    "metadata.captureSettings.colorSpace": ["srgb", "p3", "rec2020"],
    "metadata.captureSettings.captureMode": ["full", "incremental", "adaptive"],
    "metadata.captureSettings.scrollStrategy": ["exhaustive", "intelligent", "sampled"],
    "metadata.edgeCasesDetected[].type": ["infinite_scroll", "real_time_data", "webrtc_stream", "authentication", "ab_testing", "geo_restriction", "rate_limiting", "pwa_offline", "custom"],
    "visualData.tensor4D.format": ["float32", "uint16", "compressed"],
    "visualData.tensor4D.encoding": ["raw", "h265", "av1", "custom"],
    "visualData.keyframes[].significance": ["major", "minor", "transition"],
    "visualData.depthMaps[].encoding": ["float32", "uint16"],
    "visualData.colorProfiles[].space": ["srgb", "p3", "rec2020", "lab"],
    "molecules[].type": ["text", "image", "video", "canvas", "webgl", "interactive_button", "input_field", "container", "navigation", "animation_particle", "svg_element", "iframe", "custom"],
    "molecules[].bounds.transformations[].type": ["translate", "rotate", "scale", "skew", "matrix"],
    "molecules[].relationships[].type": ["parent", "child", "sibling", "reference", "dependency", "visual_group", "semantic_group", "interaction_group"],
    "stateGraph.edges[].trigger.type": ["interaction", "time", "scroll", "network", "media", "system"],
    "stateGraph.stateGroups[].type": ["sequential", "parallel", "exclusive"],
    "behavioralEquations[].variables[].type": ["scrollY", "scrollX", "time", "mouseX", "mouseY", "viewportWidth", "viewportHeight", "custom"],
    "validationChecksums.crossValidation[].method": ["visual_match", "behavioral_consistency", "timing_correlation"],
}
#: Least and largest value of numbers (fixed values).
RANGES = {
    **{f"metadata.fidelityScore.{k}": (0, 1) for k in ("overall", "visual", "behavioral", "timing", "color")}, "metadata.captureSettings.frameRate": (60, 240), "molecules[].relationships[].strength": (0, 1),
    "stateGraph.edges[].probability": (0, 1), "behavioralEquations[].accuracy": (0, 1), "validationChecksums.crossValidation[].score": (0, 1),
}
#: Least and largest length of arrays (fixed values).
LENGTHS = {
    "molecules": (1, None), "metadata.captureEnvironment.displayInfo.resolution": (2, 2), "visualData.tensor4D.dimensions": (4, 4), "visualData.tensor4D.spatialResolution": (2, 2), "visualData.depthMaps[].resolution": (2, 2),
    "visualData.colorProfiles[].whitePoint": (2, 2), "molecules[].bounds.transformations[].origin": (3, 3), "behavioralEquations[].variables[].range": (2, 2),
}
#: Forms of texts (fixed values).
PATTERNS = {"version": r"\d+\.\d+", "metadata.captureId": r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"}


def _rules() -> dict:
    """The rules as a tree of places: what lies below one by its key, an array's elements at None; parts without rules aren't in it."""
    root = {"at": "", "below": {}}
    for at in (*REQUIRED, *ALLOWED, *RANGES, *LENGTHS, *PATTERNS):
        node = root
        for key in at.replace("[]", ".[]").split(".") if at else ():
            below = f"{node['at']}[]" if key == "[]" else f"{node['at']}.{key}".lstrip(".")
            node = node["below"].setdefault(None if key == "[]" else key, {"at": below, "below": {}})
        node |= {name: rules[at] for name, rules in (("required", REQUIRED), ("allowed", ALLOWED), ("range", RANGES), ("length", LENGTHS), ("pattern", PATTERNS)) if at in rules}
    return root


_TREE = _rules()


def broken_rules(doc) -> list[str]:
    """What a document lacks or has wrong, each rule once, in order."""
    if not isinstance(doc, dict):
        return ["not a document"]
    out: list[str] = []

    def look(value, node: dict) -> None:
        at, below = node["at"], node["below"]
        if isinstance(value, dict):
            out.extend(f"{at}.{k} is missing".lstrip(".") for k in node.get("required", ()) if k not in value)
        if "allowed" in node and value not in node["allowed"]:
            out.append(f"{at} is none of the known values")
        if "range" in node:
            lo, hi = node["range"]
            if not (isinstance(value, (int, float)) and not isinstance(value, bool) and lo <= value <= hi):
                out.append(f"{at} is not within {lo} and {hi}")
        if "length" in node and not (isinstance(value, list) and node["length"][0] <= len(value) <= (node["length"][1] or len(value))):
            out.append(f"{at} has not the right length")
        if "pattern" in node and not (isinstance(value, str) and re.fullmatch(node["pattern"], value)):
            out.append(f"{at} is not well formed")
        if isinstance(value, dict):
            for k, v in value.items() if below else ():
                if k in below:
                    look(v, below[k])
        elif isinstance(value, list) and None in below:
            for v in value:
                look(v, below[None])

    look(doc, _TREE)
    overall = ((doc.get("metadata") or {}).get("fidelityScore") or {}).get("overall")
    if isinstance(overall, (int, float)) and 0 <= overall < 0.999:
        out.append("warning: fidelity below 0.999")
    return list(dict.fromkeys(out))


def errors(docs: DataFrame) -> DataFrame:
    """(path, rule): every rule of the format that a document breaks, once; a fidelity below 0.999 is a warning."""

    def run(batches):
        for b in batches:
            out = []
            for path, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    doc = json.loads(raw) if raw else None
                except ValueError:
                    doc = None
                out += [(path, rule) for rule in broken_rules(doc)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in (0, 1)], ["path", "rule"])

    return _by_pieces(docs.select("path", "raw"), run, "path string, rule string")


def loaded(docs: DataFrame) -> DataFrame:
    """The documents if none breaks a rule and all three checksums hold; else an error that names the first that does."""
    first = errors(docs).filter("rule not like 'warning%'").orderBy("path", "rule").head()
    if not first:
        first = checksums(docs).filter("stored is distinct from actual").select("path", F.concat(F.lit("checksum of "), "section").alias("rule")).orderBy("path", "rule").head()
    if first:
        raise ValueError(f"{first['path']}: {first['rule']}")
    return docs


def summary(docs: DataFrame) -> DataFrame:
    """(path, text): a report of a document's origin, fidelity, settings, counts, molecules by type (in their order) and edge cases."""
    kinds = part(docs, "molecules").groupBy("path", "type").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    types = kinds.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "type", "n"))), lambda t: F.format_string("  %s: %d", t["type"], t["n"])).alias("types"))
    m = "doc.metadata."
    pct = lambda k: F.format_string(f"  {k.capitalize()}: %.2f%%", F.col(f"{m}fidelityScore.{k}") * 100)
    count = lambda name, at: F.format_string(f"  {name}: %d", F.size(F.coalesce(F.col(f"doc.{at}"), F.array())))
    plain = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    cases = F.transform(F.coalesce(F.col(f"{m}edgeCasesDetected"), F.array()), lambda e: F.concat(F.lit("  "), e["type"], F.lit(": "), e["description"]))
    lines = F.concat(
        F.array(
            F.concat(F.lit("Version: "), "doc.version"), F.concat(F.lit("URL: "), f"{m}targetUrl"), F.concat(F.lit("Capture Time: "), f"{m}captureTimestamp"), F.concat(F.lit("Platform: "), f"{m}captureEnvironment.platform"), F.lit(""),
            F.lit("Fidelity Scores:"), *(pct(k) for k in ("overall", "visual", "behavioral", "timing", "color")), F.lit(""),
            F.lit("Capture Settings:"), F.concat(F.lit("  Frame Rate: "), plain(f"{m}captureSettings.frameRate"), F.lit(" fps")), F.concat(F.lit("  Color Space: "), f"{m}captureSettings.colorSpace"), F.concat(F.lit("  Mode: "), f"{m}captureSettings.captureMode"), F.lit(""),
            F.lit("Data Statistics:"), count("Molecules", PARTS["molecules"]), count("States", PARTS["states"]), count("Transitions", PARTS["edges"]), count("Behavioral Equations", PARTS["equations"]), count("Keyframes", PARTS["keyframes"]), F.lit(""),
            F.lit("Molecule Types:"),
        ),
        F.coalesce("types", F.array().cast("array<string>")),
        F.when(F.size(cases) > 0, F.concat(F.array(F.lit(""), F.lit("Edge Cases Detected:")), cases)).otherwise(F.array().cast("array<string>")),
    )
    return docs.join(types, "path", "left").select("path", F.array_join(lines, "\n").alias("text"))
