"""Streams: pages in order as they and all earlier ones are there; latest revisions; windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def ordered_pages(pages: DataFrame, idle: str | None = None) -> DataFrame:
    """A stream of (document_id, page_number, payload) in any order gives each document's pages in order, without gaps; the
    state holds the next page's number and the pages that wait. With ``idle`` (as "2 hours") a document without pages for so long ends:
    the pages that still wait come out in order, past the gap, and its state goes; pages after that begin a document anew."""
    milliseconds = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key, batches: Iterator[pd.DataFrame], state):
        waiting, following = ({}, 1) if not state.exists else (dict(zip(state.get[1], state.get[2])), state.get[0])
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], n, waiting[n]) for n in sorted(waiting)], columns=["document_id", "page_number", "payload"])
            return
        for b in batches:
            waiting.update((int(n), p) for n, p in zip(b.page_number, b.payload) if int(n) >= following)
        out = []
        while following in waiting:
            out.append((key[0], following, waiting.pop(following)))
            following += 1
        state.update((following, list(waiting), list(waiting.values())))
        if milliseconds:
            state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame(out, columns=["document_id", "page_number", "payload"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if milliseconds else GroupStateTimeout.NoTimeout
    return pages.groupBy("document_id").applyInPandasWithState(
        run, "document_id string, page_number int, payload string", "following int, numbers array<int>, payloads array<string>", "append", timeout
    )


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An addition to the engine: event counts and sums by tumbling window; works on tables and streams."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def latest_revision(changes: DataFrame) -> DataFrame:
    """(document_id, revision, payload): what stands after all changes; a stale revision never wins."""
    return changes.groupBy("document_id").agg(F.max("revision").alias("revision"), F.max_by("payload", "revision").alias("payload"))
