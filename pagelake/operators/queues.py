"""Behaviours of queue, admission, ledger, cache and sessions, read from their logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def queue_depth(tickets: DataFrame) -> DataFrame:
    """tickets (queue, ticket, enqueued_at, finished_at): how many were ahead when each came. Serving is first come, first served, so the
    finished by then are the counted ends before that time."""
    ends = tickets.filter("finished_at is not null").select("queue", F.lit(None).cast("long").alias("ticket"), F.col("finished_at").alias("at"), F.lit(-1).alias("step"))
    log = tickets.select("queue", F.col("ticket").cast("long"), F.col("enqueued_at").alias("at"), F.lit(1).alias("step")).unionByName(ends)
    w = Window.partitionBy("queue").orderBy("at", "step", "ticket").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("inside", F.sum("step").over(w)).filter("ticket is not null").select("queue", "ticket", F.greatest(F.col("inside") - 1, F.lit(0)).alias("ahead"))


def _replayed(log: DataFrame, key: str, columns: list[str], fresh: Callable[[], object], step: Callable, out: dict[str, str]) -> DataFrame:
    """Rows in order of key, at and id, batch by batch: ``step(state, *columns)`` gives a row's results, and the state goes from batch to
    batch until the key changes. A task holds one batch and one state, however long a log is; null keys are one log."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for b in batches:
            results = []
            for k, *row in zip(b[key], *(b[c] for c in columns)):
                k = None if pd.isna(k) else k
                if k != last:
                    last, state = k, fresh()
                results.append(step(state, *row))
            yield pd.concat([b[[key, "id"]].reset_index(drop=True), pd.DataFrame(results, columns=list(out))], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in log.schema}
    names = list(dict.fromkeys([key, "id", "at", *columns]))
    schema = ", ".join([f"{key} {kinds[key]}", f"id {kinds['id']}", *(f"{n} {t}" for n, t in out.items())])
    return log.select(*names).repartition(key).sortWithinPartitions(key, "at", "id").mapInPandas(run, schema)


def admissions(arrivals: DataFrame, limit: int) -> DataFrame:
    """arrivals (gate, id, at, seconds): replay of a bounded gate; refused arrivals hold no place. The state is a heap of ``limit`` ends at
    most."""
    import heapq

    def step(ends: list[float], at: float, seconds: float) -> tuple[bool]:
        while ends and ends[0] <= at:
            heapq.heappop(ends)
        admitted = len(ends) < limit
        if admitted:
            heapq.heappush(ends, at + seconds)
        return (admitted,)

    return _replayed(arrivals, "gate", ["at", "seconds"], list, step, {"admitted": "boolean"})


def ledger(charges: DataFrame, reserve: float, budget: float) -> DataFrame:
    """charges (ledger, id, actual): each reserves, then settles to what it cost, unknown costs keep the reserve; whether the next one
    still fitted when it came."""
    w = Window.partitionBy("ledger").orderBy("id")
    spent = F.coalesce(F.sum(F.coalesce("actual", F.lit(reserve))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return charges.select("ledger", "id", F.round(spent, 6).alias("spent_before"), (spent + reserve <= budget).alias("fits"))


def cache_replay(requests: DataFrame, most_bytes: int, ttl: float) -> DataFrame:
    """requests (cache, id, at, key, size): hit or miss of a cache bounded in bytes that drops the least recently used and what is older
    than ``ttl``; an entry above the bound isn't kept. The state is what the cache holds."""

    def step(state: list, at: float, key, size: int) -> tuple[bool, int]:
        held, entry = state[0], state[0].pop(key, None)
        hit, evicted = entry is not None and at - entry[0] <= ttl, 0
        if hit:
            held[key] = entry
            return hit, evicted
        state[1] -= entry[1] if entry else 0
        if size <= most_bytes:
            held[key] = (at, size)
            state[1] += size
        while state[1] > most_bytes:
            state[1] -= held.pop(next(iter(held)))[1]
            evicted += 1
        return hit, evicted

    return _replayed(requests, "cache", ["at", "key", "size"], lambda: [{}, 0], step, {"hit": "boolean", "evicted": "int"})


def evicted_by_size(entries: DataFrame, most_bytes: int) -> DataFrame:
    """entries (cache, key, last_used, size): those beyond the bound, counted from the most recently used."""
    w = Window.partitionBy("cache").orderBy(F.desc("last_used"), "key").rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("held", F.sum("size").over(w)).filter(F.col("held") > most_bytes).drop("held")


def kept_sessions(sessions: DataFrame, keep: int) -> DataFrame:
    """sessions (store, session_id, accessed, pending): the newest by access; pending ones never go."""
    w = Window.partitionBy("store").orderBy(F.desc("accessed"), "session_id")
    return sessions.withColumn("_r", F.row_number().over(w)).filter(F.col("pending") | (F.col("_r") <= keep)).drop("_r")


def amended_feedback(feedback: DataFrame) -> DataFrame:
    """feedback (session_id, record_id, amends?, position, verdict, reason): an amendment of the same session replaces the record it names."""
    target = F.coalesce("amends", "record_id")
    known = feedback.filter("amends is null").select("session_id", F.col("record_id").alias("_t"))
    rows = feedback.withColumn("_t", target).join(known, ["session_id", "_t"], "left_semi")
    return rows.groupBy("session_id", F.col("_t").alias("record_id")).agg(F.max_by("verdict", "position").alias("verdict"), F.max_by("reason", "position").alias("reason"), F.count("*").alias("versions"))


def batch_failures(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Pages (document_id, page_number) of a batch without exactly one result, as rows of failures."""
    n = results.groupBy("document_id", "page_number").agg(F.count("*").alias("n"))
    return expected.join(n, ["document_id", "page_number"], "left").filter("n is null or n <> 1").select("document_id", "page_number", F.when(F.col("n").isNull(), "no_result").otherwise("several_results").alias("failure"))


def pages_after(pages: DataFrame, cursor: int) -> DataFrame:
    """What a poll that has seen pages below the cursor still gets."""
    return pages.filter(F.col("page_number") >= cursor)
