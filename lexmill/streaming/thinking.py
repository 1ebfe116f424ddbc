"""Answers streamed token by token, without the parts in which a model thinks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

START, END = "<think>", "</think>"


def step(buffer: str, inside: bool, token: str) -> tuple[str, str, bool]:
    """What a token lets through, what is held back, and whether a thought is open.

    As much of the end is held back as may be the beginning of a mark.
    """
    buffer, out = buffer + token, []
    while True:
        mark = END if inside else START
        at = buffer.find(mark)
        if at >= 0:
            if not inside:
                out.append(buffer[:at])
            buffer, inside = buffer[at + len(mark) :], not inside
            continue
        hold = next((k for k in range(len(mark) - 1, 0, -1) if buffer.endswith(mark[:k])), 0)
        if not inside:
            out.append(buffer[: len(buffer) - hold])
        return "".join(out), buffer[len(buffer) - hold :], inside


def united(stream: DataFrame) -> DataFrame:
    """``stream`` with tokens of an answer that follow each other in an Arrow batch as one row, so that what is shuffled are texts, not tokens.

    Only tokens whose numbers follow and whose other columns are equal are united,
    none behind a last one; ``seq`` and ``last`` are those of the last of them.  What
    step() lets through of them is the same as token by token.
    """
    names = stream.columns
    others = [c for c in names if c not in ("seq", "token", "last")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            seq = b.column("seq")
            same = [pc.equal(pc.subtract(seq[1:], seq[:-1]), 1), pc.invert(pc.fill_null(b.column("last"), False))[:-1], *[pc.equal(b.column(c)[1:], b.column(c)[:-1]) for c in others]]
            breaks = np.flatnonzero(~np.logical_and.reduce([pc.fill_null(x, False).to_numpy(zero_copy_only=False) for x in same]))
            ends = pa.array(np.append(breaks, n - 1))
            text = pc.fill_null(b.column("token"), "").cast(pa.string())
            _, offsets, data = text.buffers()
            bounds = np.frombuffer(offsets, np.int32)[text.offset : text.offset + n + 1][np.concatenate(([0], breaks + 1, [n]))]
            joined = pa.StringArray.from_buffers(len(ends), pa.py_buffer(bounds), data or pa.py_buffer(b""))  # tokens lie one behind the other already
            yield pa.RecordBatch.from_arrays([joined if c == "token" else b.column(c).take(ends) for c in names], names=names)

    return stream.mapInArrow(run, stream.schema)


class _Answer(StatefulProcessor):
    """State of an answer: what is held back, whether a thought is open, the last token's number, and when patience, if it ends, does."""

    def __init__(self, patience_ms: int | None = None) -> None:
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("answer", "buffer string, inside boolean, seq long, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        known = self.state.get()
        buffer, inside, seq, until = known or ("", False, -1, None)
        tokens = sorted(rows, key=lambda r: r["seq"])
        shown, over = [], False
        for r in tokens:
            through, buffer, inside = step(buffer, inside, r["token"] or "")
            seq = r["seq"]
            shown.append(through)
            if r["last"]:
                shown.append("" if inside else buffer)
                over = True
        if until is not None:
            self.handle.deleteTimer(until)
        if not over:
            if self.patience is not None:
                latest = max(r["at_ms"] for r in tokens) + self.patience
                until = latest if until is None else max(until, latest)
                self.handle.registerTimer(until)
            self.state.update((buffer, inside, seq, until))
        elif known:
            self.state.clear()
        text = "".join(shown)
        if text or over:
            yield Row(answer_id=key[0], seq=seq, shown=text, ended="last" if over else None)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        buffer, inside, seq, _ = self.state.get()
        self.state.clear()
        yield Row(answer_id=key[0], seq=seq + 1, shown="" if inside else buffer, ended="timeout")

    def close(self) -> None:
        pass


def _filtered(stream: DataFrame, answer: _Answer, time_mode: str) -> DataFrame:
    kind = stream.schema["answer_id"].dataType.simpleString()
    return stream.groupBy("answer_id").transformWithState(answer, f"answer_id {kind}, seq long, shown string, ended string", "Append", time_mode)


def filter_thinking(stream: DataFrame) -> DataFrame:
    """``answer_id``, ``seq``, ``shown`` from a stream of ``answer_id``, ``seq``, ``token``, ``last``: a row for what an answer's tokens of a batch let through (``seq``: its last token's).

    State is a few characters an answer; it goes with the answer's last token,
    which also lets through what was held back.  The state store must be RocksDB,
    which plans.streams.run_timed() sees to.
    """
    return _filtered(united(stream), _Answer(), "None").filter("shown <> ''").drop("ended")


def filter_thinking_within(stream: DataFrame, patience_ms: int, late: str = "0 seconds", time: str = "at") -> DataFrame:
    """As filter_thinking(), a row for what an answer's tokens of a batch let through (``seq``: its last token's), with ``ended``: ``last`` at an answer's last token, ``timeout`` where none came in time.

    ``time`` is when a token came.  When the watermark, the latest time less ``late``,
    passes an answer's latest token by ``patience_ms``, what was held back is let
    through and the answer's state goes, so no answer stays in state for ever.
    Tokens that come behind the watermark are dropped.  The state store must be
    RocksDB, which plans.streams.run_timed() sees to.
    """
    rows = united(stream).withColumn("at_ms", F.unix_millis(time)).withWatermark(time, late)
    return _filtered(rows, _Answer(patience_ms), "EventTime")
