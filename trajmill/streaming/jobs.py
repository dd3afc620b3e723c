"""Decisions on jobs as their event logs arrive, with keyed state and event-time timers.

A job runs in attempts.  An attempt starts with an executing line; each finished instance counts;
it ends ``done`` when all expected instances are finished, and ``ended_late`` when its time is
over, without any further line: a timer at the start plus the limit decides it.  A held attempt ends
too: ``needs_retry``, or ``gave_up`` after the last resubmission.  A retry keeps the number of
resubmissions, every other decision clears the job's state, and the next executing line begins anew.

Lines are handled in the order of their time stamps, not of their arrival: a line waits in the
state until the watermark has passed it.  What comes out therefore does not depend on how the
stream was cut into batches, as long as lines are not later than the delay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trajmill import constants as C

FINISHED_CODE = "100"
HELD_CODE = "012"
_STATE = "resubmits int, started bigint, coverage bigint, times array<bigint>, places array<bigint>, codes array<string>, expected array<bigint>"
_DECISION = "outcome string, decided_us bigint, coverage bigint, elapsed bigint, resubmits int"
_US = 1_000_000


@dataclass
class Job:
    """The state of a job between two lines; times in microseconds."""

    late: int
    most_resubmits: int
    resubmits: int = 0
    started: int | None = None
    coverage: int = 0

    def _decide(self, outcome: str, at: int) -> tuple:
        row = (outcome, at, self.coverage, (at - self.started) // _US, self.resubmits)
        self.resubmits = self.resubmits + 1 if outcome == "needs_retry" else 0
        self.started, self.coverage = None, 0
        return row

    def deadline(self) -> int | None:
        return None if self.started is None else self.started + self.late

    def until(self, at: int) -> Iterator[tuple]:
        """The decision that the timer makes up to a time."""
        if self.started is not None and self.started + self.late <= at:
            yield self._decide("ended_late", self.started + self.late)

    def line(self, at: int, code: str, expected: int | None) -> Iterator[tuple]:
        yield from self.until(at)
        if self.started is None:
            if code == C.EXECUTING_CODE:
                self.started = at
        elif code == FINISHED_CODE:
            self.coverage += 1
            if expected is not None and self.coverage >= expected:
                yield self._decide("done", at)
        elif code == HELD_CODE:
            yield self._decide("gave_up" if self.resubmits >= self.most_resubmits else "needs_retry", at)


def job_decisions(
    events: DataFrame,
    keys: list[str],
    delay: str,
    late_seconds: int = C.LATE_SECONDS,
    max_resubmits: int = C.MAX_RESUBMITS,
) -> DataFrame:
    """Every decision once, as a stream for an append sink.

    ``events``: the keys, ``ts`` (time stamp), ``line_no`` (order among equal times), ``code`` and ``expected`` (instances
    of the job).  Columns: the keys, ``outcome, decided_at, coverage, elapsed, resubmits``.  Lines
    without a time stamp are left out, lines later than ``delay`` are dropped by the watermark.
    Lines that say nothing about a job advance the watermark and go no further.
    """
    kinds = [events.schema[k] for k in keys]
    out = T.StructType([*kinds, *T.StructType.fromDDL(_DECISION).fields])

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        resubmits, started, coverage, *waiting = state.get if state.exists else (0, None, 0, [], [], [], [])
        job = Job(late_seconds * _US, max_resubmits, resubmits, started, coverage)
        lines = list(zip(*waiting, strict=True))
        for frame in frames:
            expected = [None if pd.isna(e) else int(e) for e in frame["expected"]]
            lines += zip(frame["us"].tolist(), frame["line_no"].tolist(), frame["code"].tolist(), expected, strict=True)
        lines.sort(key=lambda line: line[:2])
        passed = sum(line[0] // 1000 < watermark for line in lines)
        made = [d for at, _, code, expected in lines[:passed] for d in job.line(at, code, expected)]
        made += job.until(watermark * 1000 - 1)
        lines = lines[passed:]
        if lines or job.started is not None or job.resubmits:
            state.update((job.resubmits, job.started, job.coverage, *([line[i] for line in lines] for i in range(4))))
            wake = [t // 1000 for t in (job.deadline(), lines[0][0] if lines else None) if t is not None]
            if wake:
                state.setTimeoutTimestamp(min(wake))
        elif state.exists:
            state.remove()
        if made:
            yield pd.DataFrame([(*key, *row) for row in made], columns=out.names)

    # The condition names the time stamp, so that it is not moved before the watermark.
    matters = F.when(F.col("code").isin(C.EXECUTING_CODE, FINISHED_CODE, HELD_CODE), F.col("ts")).isNotNull()
    timed = events.withWatermark("ts", delay).where(matters)
    timed = timed.select(*keys, "ts", F.unix_micros("ts").alias("us"), F.col("line_no").cast("bigint").alias("line_no"), "code", F.col("expected").cast("bigint").alias("expected"))
    decided = timed.groupBy(*keys).applyInPandasWithState(fold, out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return decided.select(*keys, "outcome", F.timestamp_micros("decided_us").alias("decided_at"), "coverage", "elapsed", "resubmits")
