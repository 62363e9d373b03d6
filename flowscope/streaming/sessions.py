"""The stateful parts as streams; each gives on a bounded source what its batch form gives."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ring(events: DataFrame, capacity: int) -> DataFrame:
    """(session, held, dropped, newest): a ring buffer for each session; at its capacity the oldest row goes.

    The state is the ids held and the number dropped, so it never grows beyond the capacity. Rows of a micro-batch come in
    the order of ``id``.
    """

    def step(key, batches, state: GroupState):
        ids, dropped = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        for pdf in batches:
            ids += sorted(pdf["id"].tolist())
        dropped += max(0, len(ids) - capacity)
        ids = ids[-capacity:]
        state.update((ids, dropped))
        yield pd.DataFrame({"session": [key[0]], "held": [len(ids)], "dropped": [dropped], "newest": [ids[-1] if ids else None]})

    return events.select("session", "id").groupBy("session").applyInPandasWithState(step, "session long, held long, dropped long, newest long", "ids array<long>, dropped long", "update", GroupStateTimeout.NoTimeout)


def keyframes(frames: DataFrame, pct_over: float = 30.0, longest: int = 2000) -> DataFrame:
    """(session, frame_no, reason) as frames (session, frame_no, ts_ms, changed_pct) arrive: first, change or forced.

    The last frame of a session is not known before the stream ends, so it is no keyframe of its own here.
    """

    def step(key, batches, state: GroupState):
        last = state.get[0] if state.exists else None
        out = []
        for pdf in batches:
            for r in pdf.sort_values(["ts_ms", "frame_no"]).itertuples(index=False):
                why = "first" if last is None else "change" if r.changed_pct > pct_over else "forced" if r.ts_ms - last > longest else None
                if why:
                    last = int(r.ts_ms)
                    out.append((key[0], r.frame_no, why))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["session", "frame_no", "reason"])

    return frames.groupBy("session").applyInPandasWithState(step, "session long, frame_no long, reason string", "last long", "append", GroupStateTimeout.NoTimeout)


def correlation_history(rows: DataFrame, most: int = 1000) -> DataFrame:
    """(source, id, n): how many correlations of each event (source, id, ts, clear) of a source are held after each micro-batch.

    The state is the ``most`` events of a source that came last, so it never grows beyond them; the first to come goes first.
    A row with ``clear`` forgets all that came before it. Rows of a micro-batch come in the order of ts, then id.
    """

    def step(key, batches, state: GroupState):
        ids, counts = (list(x) for x in state.get) if state.exists else ([], [])
        held = dict(zip(ids, counts, strict=True))
        for pdf in batches:
            for r in pdf.sort_values(["ts", "id"]).itertuples(index=False):
                if r.clear:
                    held.clear()
                    continue
                held[r.id] = held.get(r.id, 0) + 1
                if len(held) > most:
                    del held[next(iter(held))]
        state.update((list(held), list(held.values())))
        yield pd.DataFrame({"source": [key[0]] * len(held), "id": list(held), "n": list(held.values())})

    cols = rows.select("source", "id", "ts", F.coalesce("clear", F.lit(False)).alias("clear"))
    return cols.groupBy("source").applyInPandasWithState(step, "source long, id long, n long", "ids array<long>, counts array<long>", "update", GroupStateTimeout.NoTimeout)


def segments(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(session, type, start, end, n): session windows of one type, closed once the watermark has passed the gap."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", F.col("event_type").alias("type"), w.alias("w")).agg(F.count("*").alias("n")).select(F.col("user_id").alias("session"), "type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def visit_counts(events: DataFrame) -> DataFrame:
    """(state, visits): running totals, for complete or update output."""
    return events.groupBy(F.col("event_type").alias("state")).agg(F.count("*").alias("visits"))


def written_once(stream: DataFrame, path: str, checkpoint: str):
    """Appends each micro-batch under its own number, so a batch that is run again replaces itself."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
