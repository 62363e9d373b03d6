"""The state graph: edges (src, dst, and any of session, pos, kind), one row a transition."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def transition_counts(edges: DataFrame) -> DataFrame:
    """Each transition's count, its probability among those from its source, and the source's out-degree."""
    n = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    w = Window.partitionBy("src")
    return n.select("src", "dst", "n", F.round(F.col("n") / F.sum("n").over(w), 6).alias("probability"), F.count("*").over(w).alias("out_degree"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("state")).union(edges.select("dst")).distinct()


def entry_points(edges: DataFrame) -> DataFrame:
    """States that no transition leads to."""
    return nodes(edges).join(edges.select(F.col("dst").alias("state")).distinct(), "state", "left_anti")


def dead_ends(edges: DataFrame) -> DataFrame:
    """States that no transition leaves."""
    return nodes(edges).join(edges.select(F.col("src").alias("state")).distinct(), "state", "left_anti")


def loops(edges: DataFrame) -> DataFrame:
    """Transitions whose reverse was first taken earlier: one row for each pair of states."""
    first = edges.groupBy("src", "dst").agg(F.min("pos").alias("pos"))
    back = first.select(F.col("src").alias("r_dst"), F.col("dst").alias("r_src"), F.col("pos").alias("r_pos"))
    return first.join(back, (F.col("src") == F.col("r_src")) & (F.col("dst") == F.col("r_dst")) & (F.col("r_pos") < F.col("pos"))).select("src", "dst", "pos")


def degrees(edges: DataFrame) -> DataFrame:
    """In- and out-degree of each state, counting different transitions once."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("state"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("state").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def hubs(edges: DataFrame, more_than: int = 5) -> DataFrame:
    return degrees(edges).filter(F.col("in_degree") + F.col("out_degree") > more_than)


def statistics(edges: DataFrame) -> DataFrame:
    """One row: states, transitions, mean branching of states with a way out, terminal and unreached states."""
    return degrees(edges).agg(
        F.count("*").alias("states"), F.coalesce(F.sum("out_degree"), F.lit(0)).alias("transitions"), F.round(F.avg(F.when(F.col("out_degree") > 0, F.col("out_degree"))), 6).alias("branching"),
        F.count_if(F.col("out_degree") == 0).alias("terminal"), F.count_if(F.col("in_degree") == 0).alias("unreached"),
    )


def coverage(edges: DataFrame, possible: DataFrame) -> DataFrame:
    """One row: explored part of what each state offers (state, possible); 0 if nothing is offered."""
    seen = degrees(edges).select("state", "out_degree")
    both = possible.join(seen, "state", "left").withColumn("out_degree", F.coalesce("out_degree", F.lit(0)))
    part = F.sum(F.least("out_degree", "possible")) / F.nullif(F.sum("possible"), F.lit(0))
    return both.agg(F.round(F.coalesce(part, F.lit(0.0)), 6).alias("coverage"))


def top_sources(edges: DataFrame, n: int = 5) -> DataFrame:
    return edges.select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("targets")).orderBy(F.desc("targets"), "src").limit(n)


def initial_state(steps: DataFrame) -> DataFrame:
    """The first state by position that no transition leads to, else the first of all; one row."""
    first = steps.groupBy("state").agg(F.min("pos").alias("pos"))
    led = steps.filter("next_state is not null").select(F.col("next_state").alias("state"), F.lit(True).alias("led")).distinct()
    return first.join(led, "state", "left").agg(F.min_by("state", F.struct(F.coalesce("led", F.lit(False)), "pos")).alias("state"))


def valid_edges(edges: DataFrame, states: DataFrame) -> DataFrame:
    """Transitions both of whose states are known."""
    known = states.select(F.col("state").alias("known")).distinct()
    return edges.join(known, edges.src == F.col("known"), "left_semi").join(known, edges.dst == F.col("known"), "left_semi")


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct().groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("targets"))


def visits(steps: DataFrame) -> DataFrame:
    return steps.groupBy("state").agg(F.count("*").alias("visits"), F.max("pos").alias("last_pos"))


def with_cut(df: DataFrame) -> DataFrame:
    """A level's rows cut from their lineage: a table in the session's folder for them, written in one pass.

    The folder is that named in spark.checkpoint.dir, or the context's; on a single machine without either, cached only.
    """
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder:
        path = f"{folder.rstrip('/')}/flowscope-{sc.applicationId}/cut-{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return df.persist()


#: Levels of a search after which those reached so far become one table.
LEVELS = 16


class _Reached:
    """The levels of a search so far, as few tables."""

    def __init__(self, first: DataFrame):
        self.old, self.levels = None, [first]

    def all(self) -> DataFrame:
        return reduce(DataFrame.union, self.levels if self.old is None else [self.old, *self.levels])

    def add(self, level: DataFrame) -> None:
        self.levels.append(level)
        if len(self.levels) >= LEVELS:
            self.old, self.levels = with_cut(self.all()), []


def distances(edges: DataFrame, start: str) -> DataFrame:
    """(state, distance) of every state reached from ``start`` in fewest steps.

    A frontier a round, until none is left: each joins the edges once and the states already reached once. The start is
    reached by itself.
    """
    e = with_cut(edges.select("src", "dst").filter("src <> dst").distinct())
    frontier = edges.sparkSession.createDataFrame([(start, 0)], "state string, distance int")
    reached, level = _Reached(frontier), 0
    while not frontier.isEmpty():
        level += 1
        nxt = frontier.join(e, F.col("state") == F.col("src")).select(F.col("dst").alias("state")).distinct()
        frontier = with_cut(nxt.join(reached.all().select("state"), "state", "left_anti").select("state", F.lit(level).alias("distance")))
        reached.add(frontier)
    return reached.all()


def predecessors(edges: DataFrame, start: str, end: str | None = None) -> DataFrame:
    """(state, distance, prev) as far as ``end``, if given: the state before each on its shortest path, of equal paths the least
    by its states.

    Paths of a level are in the order of their predecessors' places and their last states, so a level is sorted by ranges and
    numbered, and no path is carried along.
    """
    e = with_cut(edges.select("src", "dst").filter("src <> dst").distinct())
    ddl = "state string, distance int, prev string, place long"
    frontier = edges.sparkSession.createDataFrame([(start, 0, None, 0)], ddl)
    reached, level = _Reached(frontier), 0
    while not frontier.isEmpty() and (end is None or frontier.filter(F.col("state") == end).isEmpty()):
        level += 1
        nxt = frontier.join(e, F.col("state") == F.col("src")).groupBy("dst").agg(F.min(F.struct("place", F.col("src").alias("prev"))).alias("by"))
        new = with_cut(nxt.join(reached.all().select(F.col("state").alias("dst")), "dst", "left_anti").select(F.col("dst").alias("state"), "by"))
        order = ["by.place", "state"]
        ranked = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
        frontier = with_cut(ranked.select("state", F.lit(level).alias("distance"), F.col("by.prev").alias("prev"), "place"))
        reached.add(frontier)
    return reached.all().select("state", "distance", "prev")


def shortest_path(edges: DataFrame, start: str, end: str) -> DataFrame:
    """One row with the path, or none; a state's way to itself is itself if it is known.

    The states on the way are marked from the end by twice as many steps back in each round.
    """
    if nodes(edges).filter(F.col("state") == start).isEmpty():
        return edges.sparkSession.createDataFrame([], "path array<string>, distance int")
    before = with_cut(predecessors(edges, start, end))
    marked, back = before.filter(F.col("state") == end).select("state"), before.filter("prev is not null").select("state", "prev")
    while True:
        more = marked.join(back, "state").select(F.col("prev").alias("state"))
        if more.isEmpty():
            break
        marked = with_cut(marked.union(more).distinct())
        further = back.select(F.col("state").alias("prev"), F.col("prev").alias("_prev"))
        back = with_cut(back.join(further, "prev").select("state", F.col("_prev").alias("prev")))
    way = before.join(marked, "state").agg(F.array_sort(F.collect_list(F.struct("distance", "state"))).alias("way"))
    path = F.transform("way", lambda x: x["state"]).alias("path")
    return way.filter(F.size("way") > 0).select(path, F.get("way", F.size("way") - 1)["distance"].alias("distance"))


def max_depth(edges: DataFrame, start: str) -> DataFrame:
    """Largest least distance from the start (the documented intent; a walk's first-visit depth depends on its order)."""
    return distances(edges, start).agg(F.max("distance").alias("max_depth"))


def _contracted(e: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Edges and weights (state, least, states) with chains drawn together, and whether there were any.

    A state's only way out and the next state's only way in make a link: both lie on the same cycles. Links form paths and
    rings, which pointer jumping measures in rounds that double the steps: a path becomes its last state, a ring its least
    with an edge to itself. As long as pointers move no two are at the same state, so no key is hot.
    """
    only = lambda at, other: e.groupBy(at).agg(F.count("*").alias("n"), F.max(other).alias(other)).filter("n = 1").drop("n")
    links = with_cut(only("src", "dst").join(only("dst", "src"), ["src", "dst"]).filter("src <> dst"))
    n = links.count()
    if not n:
        return e, weights, False
    inner = links.select(F.col("src").alias("dst"), F.lit(False).alias("done"))
    at = links.join(inner, "dst", "left").select(
        F.col("src").alias("state"), F.col("dst").alias("to"), F.least("src", "dst").alias("least"), F.coalesce("done", F.lit(True)).alias("done")
    )
    at = with_cut(at)
    for _ in range(n.bit_length() + 1):
        moving = at.filter("not done")
        if moving.isEmpty():
            break
        ahead = at.select(F.col("state").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"), F.col("done").alias("_done"))
        step = moving.join(ahead, "to").select("state", F.col("_to").alias("to"), F.least("least", "_least").alias("least"), F.col("_done").alias("done"))
        at = with_cut(at.filter("done").union(step))
    into = with_cut(at.select("state", F.when(F.col("done"), F.col("to")).otherwise(F.col("least")).alias("into"), (~F.col("done")).alias("ring")))
    rings = into.filter("ring").select(F.col("into").alias("src"), F.col("into").alias("dst")).distinct()
    left = e.join(links, ["src", "dst"], "left_anti")
    for end in ("src", "dst"):
        left = left.join(into.select(F.col("state").alias(end), F.col("into").alias("_into")), end, "left").withColumn(end, F.coalesce("_into", end)).drop("_into")
    joined = weights.join(into.select("state", "into"), "state", "left").groupBy(F.coalesce("into", "state").alias("state"))
    return with_cut(left.select("src", "dst").union(rings).distinct()), with_cut(joined.agg(F.min("least").alias("least"), F.sum("states").alias("states"))), True


def _reduced(e: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without edges that lie on no cycle for want of a way in or out, and with chains drawn together, until neither is left."""
    n, again = e.count(), True
    while again and n:
        e, weights, again = _contracted(e, weights)
        into, out_of = e.select(F.col("dst").alias("src")).distinct(), e.select(F.col("src").alias("dst")).distinct()
        e = with_cut(e.join(into, "src", "left_semi").join(out_of, "dst", "left_semi").select("src", "dst"))
        m = e.count()
        again, n = again or m < n, m
    return e, weights


def _spread(e: DataFrame, values: DataFrame) -> DataFrame:
    """values (state, color): the largest colour that reaches each state along the edges, a step a round."""
    before = None
    while True:
        new = values.join(e, F.col("state") == F.col("src")).select(F.col("dst").alias("state"), "color").union(values).groupBy("state").agg(F.max("color").alias("color"))
        new = with_cut(new)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("state", "color").cast("decimal(38,0)"))).head()
        if now == before:
            return new
        values, before = new, now


def cyclic_components(edges: DataFrame) -> DataFrame:
    """(component, states): strongly connected components with a cycle, named after their least state.

    What lies on no cycle goes and chains are drawn together first, so a ring or a chain of any length takes few rounds.
    Then colouring: the largest state that reaches each state is its colour; the states that lead back to a colour's root
    within the colour are its component. All colours' components go at once, and the rest is coloured anew.
    """
    e, out = with_cut(edges.select("src", "dst").distinct()), None
    weights = nodes(e).select("state", F.col("state").alias("least"), F.lit(1).cast("long").alias("states"))
    e, weights = _reduced(e, weights)
    while not e.isEmpty():
        states = nodes(e)
        color = _spread(e, states.select("state", F.col("state").alias("color")))
        ends = [color.select(F.col("state").alias(end), F.col("color").alias(c)) for end, c in (("src", "c1"), ("dst", "c2"))]
        same = e.join(ends[0], "src").join(ends[1], "dst").filter("c1 = c2")
        back = with_cut(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        member = _spread(back, color.filter("state = color"))
        selves = e.filter("src = dst").select(F.col("src").alias("state"), F.lit(1).alias("self"))
        sizes = member.join(weights, "state").join(selves, "state", "left").groupBy("color")
        found = sizes.agg(F.min("least").alias("component"), F.sum("states").alias("states"), (F.count("*") + F.count("self")).alias("ways"))
        found = with_cut(found.filter("ways > 1").select("component", "states"))
        out = found if out is None else out.union(found)
        gone = member.select("state")
        e = e.join(gone.select(F.col("state").alias("src")), "src", "left_anti").join(gone.select(F.col("state").alias("dst")), "dst", "left_anti")
        e, weights = _reduced(with_cut(e.select("src", "dst")), weights)
    return edges.sparkSession.createDataFrame([], "component string, states long") if out is None else out


def explored(steps: DataFrame, states: DataFrame) -> DataFrame:
    """One row: states visited, known states and their ratio."""
    seen = steps.select("state").distinct().withColumn("seen", F.lit(1))
    both = states.select("state").distinct().join(seen, "state", "left")
    return both.agg(F.count("seen").alias("explored"), F.count("*").alias("total"), F.round(F.count("seen") / F.nullif(F.count("*"), F.lit(0)), 6).alias("progress"))
