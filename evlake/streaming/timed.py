"""Build completion whose state ends: a timer per build instead of a row for ever."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evlake.operators.observe import completion_outcome
from evlake.session import shared_path
from evlake.streaming.completion import latest_rows, run_to_log

# Ship the processor with its tasks, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTS = ["messages", "selected", "finished", "failed", "errors", "mismatched"]
SPAN = ["opened", "last", "until"]


class Builds(StatefulProcessor):
    """Counts of one build from its first message until its time has come.

    A message renews the time by ``idle`` milliseconds; the first that says finished sets it to
    ``grace`` after itself, for good. Later messages open a span of their own.
    """

    def __init__(self, grace: int, idle: int):
        self.grace, self.idle = grace, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("span", ", ".join(f"{n} bigint" for n in [*SPAN, *COUNTS]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        messages = pd.concat(rows, ignore_index=True).sort_values("at", kind="stable")
        span = list(self.state.get()) if self.state.exists() else None
        armed = span[2] if span else None
        closed = []
        # Whole spans at a time: ends are looked up, counts are differences of running sums.
        times, n = messages["at"].to_numpy(), len(messages)
        sums = np.zeros((n + 1, len(COUNTS)), np.int64)
        np.cumsum(messages[COUNTS].to_numpy(np.int64), axis=0, out=sums[1:])
        finishes = np.append(np.flatnonzero(messages["finished"].to_numpy()), n)
        gaps = np.append(np.flatnonzero(np.diff(times) > self.idle) + 1, n)
        i = 0
        while i < n:
            at = int(times[i])
            if span and at > span[2]:
                closed.append(self.row(key, span, True))
                span = None
            if span is None:
                span = [at, at, at + self.idle, *[0] * len(COUNTS)]
            done = span[5] > 0
            # Messages before `open_to` come while the span waits for more; the first that says
            # finished, if it is one of them, ends the waiting.
            open_to = int(np.searchsorted(times, span[2], "right"))
            if not done:
                open_to = max(open_to, int(gaps[np.searchsorted(gaps, i, "right")]))
                first = int(finishes[np.searchsorted(finishes, i)])
                if first < open_to:
                    span[2] = int(times[first]) + self.grace
                    open_to = max(first + 1, int(np.searchsorted(times, span[2], "right")))
                else:
                    span[2] = max(span[2], int(times[open_to - 1]) + self.idle)
            span[1] = max(span[1], int(times[open_to - 1]))
            span[3:] = [a + int(b) for a, b in zip(span[3:], sums[open_to] - sums[i])]
            i = open_to
        self.state.update(tuple(span))
        if armed != span[2]:
            if armed is not None:
                self.handle.deleteTimer(armed)
            self.handle.registerTimer(span[2])
        yield frame([*closed, self.row(key, span, False)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            span = list(self.state.get())
            self.state.clear()
            yield frame([self.row(key, span, True)])

    def row(self, key, span: list, closed: bool) -> tuple:
        return (key[0], *span, closed)

    def close(self) -> None:
        pass


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["build", *SPAN, *COUNTS, "closed"])


def timed_completion(
    stream: DataFrame,
    build: Column,
    at: Column,
    selected: Column,
    finished: Column,
    success: Column,
    error: Column,
    matches: Column,
    grace: str = "10 minutes",
    idle: str = "1 day",
    late: str = "5 minutes",
) -> DataFrame:
    """Spans of builds in a stream: ``build, opened, last, messages, selected, finished, errors,
    outcome, closed``.

    ``build`` is a text, ``at`` a timestamp (the event's own time). A span is open until ``grace``
    after its finished message, or, while there is none, until nothing has come for ``idle``; then
    its state goes, and a row with ``closed`` is the last one of (build, opened). A message behind
    that opens a span of its own. Until then every micro-batch gives the span's row anew. Messages
    more than ``late`` behind the newest one may be dropped by the watermark. The session must keep
    state in RocksDB (`timed_state`).
    """
    flags = {
        "messages": F.lit(1), "selected": selected, "finished": finished,
        "failed": finished & ~F.coalesce(success, F.lit(False)), "errors": error,
        "mismatched": selected & ~F.coalesce(matches, F.lit(False)),
    }
    rows = stream.select(
        build.cast("string").alias("build"), at.alias("__time"), F.unix_millis(at).alias("at"),
        *[F.coalesce(c.cast("int"), F.lit(0)).alias(n) for n, c in flags.items()],
    ).filter(F.col("build").isNotNull() & F.col("at").isNotNull())
    spans = rows.withWatermark("__time", late).groupBy("build").transformWithStateInPandas(
        statefulProcessor=Builds(millis(grace), millis(idle)),
        outputStructType=", ".join(
            ["build string", *[f"{n} bigint" for n in [*SPAN, *COUNTS]], "closed boolean"]
        ),
        outputMode="Update",
        timeMode="EventTime",
    )
    return spans.select(
        "build", F.timestamp_millis("opened").alias("opened"), F.timestamp_millis("last").alias("last"),
        "messages", "selected", "finished", "errors", completion_outcome().alias("outcome"), "closed",
    )


def millis(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def timed_state(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, which timers need; for the session, before a query starts."""
    spark.conf.set(PROVIDER_KEY, PROVIDER)


def spans_of(stream: DataFrame, spans: DataFrame) -> DataFrame:
    """Feed the stream's available input through `timed_completion`; the last row of every span.

    The session's own state store is put back afterwards.
    """
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER_KEY, None)
    log, checkpoint = shared_path(spark, "span-log"), shared_path(spark, "span-state")
    timed_state(spark)
    try:
        run_to_log(spans, log, checkpoint)
    finally:
        if before is None:
            spark.conf.unset(PROVIDER_KEY)
        else:
            spark.conf.set(PROVIDER_KEY, before)
    return latest_rows(spark, log, ["build", "opened"], spans.schema)
