"""What runs tell while they run: metrics of tables, progress of streams, times of steps."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger("lexmill")


def log_to_console(level: str) -> None:
    """Show the package's messages from a level on."""
    if not log.handlers:
        shown = logging.StreamHandler()
        shown.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(shown)
    log.setLevel(level)


class Seen:
    """Metrics of a table, known once an action has run over all of it."""

    def __init__(self, name: str) -> None:
        self.name, self.observation = name, Observation(name)

    def values(self) -> dict:
        """Waits for the action."""
        return self.observation.get

    def log(self, level: int = logging.INFO) -> None:
        log.log(level, "%s: %s", self.name, ", ".join(f"{k} {v}" for k, v in sorted(self.values().items())))


def watched(df: DataFrame, name: str, **metrics: F.Column) -> tuple[DataFrame, Seen]:
    """``df``, and its metrics (aggregates) as Spark collects them on the way; no pass of their own is made."""
    seen = Seen(name)
    return df.observe(seen.observation, *[c.alias(k) for k, c in metrics.items()]), seen


def mean_tokens(signposts: DataFrame) -> tuple[DataFrame, Seen]:
    """Signposts, and how many there are with the mean of their tokens as a whole number, 0 of none."""
    mean = F.coalesce(F.floor(F.sum("token_count") / F.count(F.lit(1))), F.lit(0)).cast("long")
    return watched(signposts, "signposts", count=F.count(F.lit(1)), mean_tokens=mean)


class _Progress(StreamingQueryListener):
    def __init__(self, name: str, level: int) -> None:
        self.name, self.level, self.batches, self.ended = name, level, [], threading.Event()

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        log.log(self.level, "%s: stream began", self.name)

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        p = event.progress
        kept = sum(s.numRowsTotal for s in p.stateOperators)
        self.batches.append({"batch": p.batchId, "rows": p.numInputRows, "ms": p.durationMs.get("triggerExecution", 0), "kept": kept})
        log.log(self.level, "%s: batch %d, %d rows in %d ms, %d rows of state", self.name, *self.batches[-1].values())

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        log.log(logging.ERROR if event.exception else self.level, "%s: stream ended%s", self.name, f", {event.exception}" if event.exception else "")
        self.ended.set()


@contextmanager
def stream_progress(spark: SparkSession, name: str, level: int = logging.INFO, wait: float = 10.0) -> Iterator[list[dict]]:
    """Logs the batches of streams that run within; the list of what they did is filled as they go.

    What a stream reports comes a little after it, so the end waits for one that has begun.
    """
    listener = _Progress(name, level)
    spark.streams.addListener(listener)
    try:
        yield listener.batches
        listener.ended.wait(wait)
    finally:
        spark.streams.removeListener(listener)


@contextmanager
def timed(name: str, level: int = logging.DEBUG) -> Iterator[None]:
    """Logs how long a step took, or that it failed."""
    began = time.perf_counter()
    try:
        yield
    except Exception as e:
        log.error("%s: failed after %.0f ms, %s", name, 1000 * (time.perf_counter() - began), e)
        raise
    log.log(level, "%s: %.0f ms", name, 1000 * (time.perf_counter() - began))
