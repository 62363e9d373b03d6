"""A small session document and small recordings, for examples and tests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.operators.document import section_checksums
from flowscope.sources import schemas as sch


#: When the timer is set, runs, is stopped, runs out, in milliseconds, and what is on the page then.
PHASES = {"set": (0, "dial", "minutes"), "runs": (1200, "dial", "minutes", "log"), "stopped": (4700, "dial", "log"), "rings": (9000, "dial", "log", "bell")}
#: Ways from phase to phase: what brings them about, how long they take and how likely they are.
WAYS = [("set", "runs", "interaction", 40, 1.0), ("runs", "stopped", "interaction", 40, 0.25), ("stopped", "runs", "interaction", 40, 1.0), ("runs", "rings", "time", 250, 0.75)]
#: Parts of the page: type and box.
PARTS = {"dial": ("canvas", 220, 60, 200, 200), "minutes": ("input_field", 270, 290, 100, 32), "log": ("container", 20, 340, 600, 120), "bell": ("svg_element", 300, 10, 40, 40)}
#: What follows from variables: (part, property, equation, variables with their ranges, least, most).
EQUATIONS = [("dial", "angle", "360 * (total - left) / total", {"total": (1, 3600), "left": (0, 3600)}, 0, 360), ("log", "offset", "-(lines - 4) * 18", {"lines": (0, 99)}, -1710, 0)]


def _box(name: str) -> dict:
    return dict(zip(("x", "y", "width", "height"), PARTS[name][1:], strict=True))


def _part(name: str) -> dict:
    shown = [at for at, *parts in PHASES.values() if name in parts]
    look = {"primaryImage": "", "alternateStates": {}, "colorFingerprint": [], "shapeDescriptor": [], "texturePattern": "solid"}
    place = {"static": _box(name), "dynamic": None, "transformations": [], "zIndex": 1, "opacity": 1}
    born = {"timestamp": shown[0], "trigger": "page_load", "fromState": None, "toState": "set"}
    seen = {"visible": [{"start": shown[0], "end": 9500}], "hidden": [], "partial": []}
    return {
        "id": name, "type": PARTS[name][0], "visualSignature": look, "bounds": place, "properties": {k: {} for k in ("visual", "behavioral", "semantic", "performance")},
        "interactions": {"click": None, "hover": None}, "relationships": [], "lifecycle": {"created": born, "modified": [], "destroyed": None, "visibility": seen},
    }


def _phase(name: str) -> dict:
    at, *parts = PHASES[name]
    held = [{"moleculeId": p, "properties": {}, "bounds": _box(p), "visible": True} for p in parts]
    return {"id": name, "visualHash": f"look-{name}", "molecules": held, "timestamp": at, "frequency": len(parts), "stability": 0.5}


def _way(k: int) -> dict:
    a, b, kind, took, chance = WAYS[k]
    trigger = {"type": kind, "details": {"action": "keypress" if kind == "interaction" else "countdown"}, "conditions": []}
    return {"id": f"way-{k}", "fromState": a, "toState": b, "trigger": trigger, "duration": took, "probability": chance, "reversible": False, "animations": []}


def _equation(k: int) -> dict:
    part, prop, text, given, least, most = EQUATIONS[k]
    variables = [{"name": n, "type": "custom", "range": list(r), "unit": "count"} for n, r in given.items()]
    domain = {"states": list(PHASES), "timeRange": None, "viewports": ["kitchen"], "conditions": []}
    return {"id": f"eq-{k}", "element": part, "property": prop, "equation": text, "variables": variables, "constraints": {"min": least, "max": most}, "domain": domain, "accuracy": 0.98}


def document() -> dict:
    """A kitchen timer's page: it is set, runs, may be stopped and go on, and rings."""
    size = [640, 480]
    screen = {"resolution": size, "dpi": 96, "colorDepth": 24, "refreshRate": 60, "hdr": False}
    gpu = {"vendor": "none", "model": "none", "driver": "0", "vram": 0, "features": []}
    measured = [("memory", 21.5, "set"), ("layout", 3.0, "set"), ("memory", 24.0, "rings")]
    frames = [
        {"timestamp": at, "significance": "transition" if i else "major", "visualHash": f"look-{name}", "deltaFromPrevious": 3e-7 if name == "stopped" else i / 8, "associatedEvents": []}
        for i, (name, (at, *_)) in enumerate(PHASES.items())
    ]
    doc = {
        "version": "1.0",
        "metadata": {
            "captureId": "1b9d6bcd-bbfd-4b2d-9b5d-ab8dfbbd4bed", "captureTimestamp": "2023-11-12T07:08:09.000Z", "targetUrl": "http://timer.example/egg",
            "captureEnvironment": {"platform": "linux", "browserEngine": "test-1", "gpuInfo": gpu, "displayInfo": screen},
            "fidelityScore": {"overall": 0.9992, "visual": 1.0, "behavioral": 0.998, "timing": 0.9991, "color": 0.9999},
            "viewportConfigurations": [{"name": "kitchen", "width": 640, "height": 480, "deviceScaleFactor": 1, "userAgent": "test", "hasTouch": True}],
            "captureSettings": {"frameRate": 90, "colorSpace": "p3", "captureMode": "adaptive", "interactionDepth": 4, "scrollStrategy": "exhaustive", "networkThrottling": None},
            "edgeCasesDetected": [{"type": "real_time_data", "description": "the dial moves by itself", "handlingStrategy": "frozen", "occurrences": 2}],
        },
        "visualData": {
            "tensor4D": {"format": "uint16", "dimensions": [*size, 1, 855], "encoding": "raw", "dataUrl": "data/none", "compressionRatio": 2, "temporalResolution": 90, "spatialResolution": size, "bitDepth": 16},
            "keyframes": frames, "depthMaps": [], "colorProfiles": [{"space": "p3", "gamut": [[0.68, 0.32], [0.265, 0.69], [0.15, 0.06]], "whitePoint": [0.3127, 0.329], "transferFunction": "p3"}],
        },
        "molecules": [_part(name) for name in PARTS],
        "stateGraph": {"nodes": [_phase(name) for name in PHASES], "edges": [_way(k) for k in range(len(WAYS))], "initialState": "set", "terminalStates": ["rings"], "stateGroups": []},
        "executionTrace": {
            "renderingCommands": [{"timestamp": 1200, "type": "paint", "target": "dial", "command": {}, "duration": 0.75, "gpuAccelerated": False}], "networkSequence": [], "computedStyles": [],
            "performanceMetrics": [{"timestamp": PHASES[at][0], "type": kind, "value": value, "context": at} for kind, value, at in measured], "consoleOutput": [], "memorySnapshots": [],
        },
        "behavioralEquations": [_equation(k) for k in range(len(EQUATIONS))],
    }
    return doc | {"validationChecksums": {**section_checksums(doc), "crossValidation": []}}


def documents(spark: SparkSession, *docs: dict) -> DataFrame:
    rows = [(f"doc-{i}", json.dumps(d, separators=(",", ":"))) for i, d in enumerate(docs or (document(),))]
    return spark.createDataFrame(rows, "path string, raw string").withColumn("doc", F.from_json("raw", sch.of(sch.DOCUMENT)))


def recordings() -> tuple[list[dict], list[dict]]:
    """Two frames and an event as the readers expect them."""
    frames = [{"id": f"f{i}", "timestamp": 1000 + 50 * i, "data": "iVBORw==", "dimensions": {"width": 1, "height": 1}, "frameNumber": i} for i in range(2)]
    return frames, [{"id": "click", "type": "click", "timestamp": 1025, "target": {"x": 500, "y": 300}}]
