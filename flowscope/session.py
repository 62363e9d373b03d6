"""Factories: the settings of an analysis in one place, and the two pipelines made of the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.operators import elements, frames, slicing, timeline


@dataclass(frozen=True)
class Timeline:
    """Times in milliseconds; ``strict_reference`` keeps what recorded tools did where that was a defect.

    A keyframe changes by more than ``pct_over`` percent. Frames are ``side`` pixels wide; regions have ``least_region`` pixels
    at least, and a region that moved is sought ``reach`` pixels around in steps of ``step``. Events and slices correlate from
    ``threshold`` on, which slices must reach too; an event at ``near`` pixels is far, a response after ``longest_delay`` slow.
    """

    shortest: int = 50
    longest: int = 5000
    pct_over: float = 1.0
    threshold: float = 0.7
    near: float = 100.0
    longest_delay: float = 2000.0
    merge: bool = True
    side: int = frames.SIDE
    least_region: int = 2
    reach: int = 50
    step: int = 5
    planes: tuple[str, ...] = frames.GREY
    strict_reference: bool = False

    def analyze(self, pairs: DataFrame, all_frames: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
        """keyframes, the slices between them, slices with their events, merged slices that are sure enough, chains, statistics.

        ``pairs`` has each frame and the one before; chains and statistics have a row a session. One frame alone is an error.
        """
        if all_frames.limit(2).count() < 2:
            raise ValueError("a timeline needs two frames at least")
        pct = frames.changed_parts(pairs)
        changes = all_frames.select("session", "frame_no", "ts_ms").join(pct, ["session", "frame_no"], "left")
        keys = timeline.keyframes(changes, self.pct_over, self.shortest, self.longest)
        found = {"least": self.least_region, "reach": self.reach, "step": self.step}
        spans = slicing.described(slicing.framed(keys, all_frames), all_frames, side=self.side, planes=self.planes, **found)
        held, judged = slicing.with_events(spans, events, self.longest, self.threshold, self.near, self.longest_delay)
        joined = timeline.merged(held, self.shortest) if self.merge else held.withColumnsRenamed({"segment": "grp"}).withColumn("slices", F.lit(1))
        sure = joined.filter(joined.confidence >= self.threshold)
        links = slicing.chain_links(sure, judged, events, self.near, self.longest_delay)
        return {
            "keyframes": keys, "slices": spans, "correlations": held, "merged": sure,
            "chains": timeline.chains(links, ["session"], self.strict_reference), "statistics": slicing.statistics(all_frames, events, sure),
        }


@dataclass(frozen=True)
class Elements:
    least: float = 0.5
    most: int | None = None
    overlap: float = 0.4

    def decompose(self, boxes: DataFrame) -> dict[str, DataFrame]:
        """elements, their hierarchy, sibling groups, relationships, hints and warnings."""
        kept = elements.kept(elements.suppressed(boxes, self.overlap), self.least, self.most)
        links = elements.parents(kept)
        groups = elements.sibling_groups(kept, links)
        return {"elements": elements.by_area(kept), "parents": links, "depths": elements.depths(links), "groups": groups, "grids": elements.layout_grid(kept, links), "relationships": elements.relationships(links, groups), "hints": elements.hints(kept, links), "warnings": elements.warnings(kept)}


def create(kind: str, **settings):
    """create("timeline", ...) or create("elements", ...)."""
    return {"timeline": Timeline, "elements": Elements}[kind](**settings)
