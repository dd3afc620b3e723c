"""Decisions with keyed state and timers against a sequential twin."""

import random
from datetime import datetime, timedelta

from trajmill.streaming import jobs, streams as T

SCHEMA = "run string, job int, line_no long, ts timestamp, code string, expected int"
START = datetime(2024, 1, 1)
LATE, DELAY = 5400, 600


def at(seconds):
    return START + timedelta(seconds=seconds)


def by_key(rows):
    return sorted(rows, key=lambda r: (str(r[:2]), r[3], r[2]))


class Feed:
    """Files that land one after the other; each call processes what is new."""

    def __init__(self, spark, folder, **limits):
        self.spark, self.source, self.target, self.limits, self.n = spark, str(folder / "in"), str(folder / "out"), limits, 0

    def land(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.source)

    def process(self):
        stream = T.read_files(self.spark, self.source, self.spark.read.parquet(self.source).schema, maxFilesPerTrigger=1)
        decided = jobs.job_decisions(stream, ["run", "job"], f"{DELAY} seconds", LATE, **self.limits)
        found = T.append_to_table(decided, f"jobs{id(self)}", self.target)
        return by_key((r.run, r.job, r.outcome, (r.decided_at - START).total_seconds(), r.coverage, r.elapsed, r.resubmits) for r in found.collect())


def twin(rows, most=3):
    """All lines in order, then the timers up to the watermark."""
    newest = max(r[3] for r in rows)
    limit = newest - timedelta(seconds=DELAY)
    found, state = [], {}

    def decide(key, outcome, when):
        resubmits, started, coverage = state.pop(key)
        found.append((*key, outcome, (when - START).total_seconds(), coverage, int((when - started).total_seconds()), resubmits))
        if outcome == "needs_retry":
            state[key] = (resubmits + 1, None, 0)

    def late(key, when):
        if key in state and state[key][1] is not None and state[key][1] + timedelta(seconds=LATE) <= when:
            decide(key, "ended_late", state[key][1] + timedelta(seconds=LATE))

    for run, job, _, ts, code, expected in sorted((r for r in rows if r[3] < limit), key=lambda r: (r[3], r[2])):
        key = (run, job)
        late(key, ts)
        resubmits, started, coverage = state.get(key, (0, None, 0))
        if started is None:
            if code == "001":
                state[key] = (resubmits, ts, 0)
        elif code == "100":
            state[key] = (resubmits, started, coverage + 1)
            if expected is not None and coverage + 1 >= expected:
                decide(key, "done", ts)
        elif code == "012":
            decide(key, "gave_up" if resubmits >= most else "needs_retry", ts)
    for key in list(state):
        late(key, limit - timedelta(milliseconds=1))
    return by_key(found)


def tick(seconds, line=0):
    """A line that only moves the clock."""
    return ("clock", 0, line, at(seconds), "006", 1)


def test_silent_job_turns_late_without_a_further_line(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.land([("r", 1, 0, at(0), "001", 2), ("r", 1, 1, at(60), "100", 2), ("r", 2, 0, at(0), "001", 1), ("r", 2, 1, at(90), "100", 1)])
    assert feed.process() == []  # the watermark has passed nothing yet
    feed.land([tick(5000)])
    assert feed.process() == [("r", 2, "done", 90.0, 1, 90, 0)]
    feed.land([tick(LATE + DELAY + 1)])
    assert feed.process() == [("r", 1, "ended_late", float(LATE), 1, LATE, 0), ("r", 2, "done", 90.0, 1, 90, 0)]
    # A restart emits nothing twice, and decided jobs have left the state.
    assert len(feed.process()) == 2
    state = spark.read.format("statestore").load(f"{feed.target}-checkpoint")
    assert state.where("value.groupState is not null").count() == 0


def test_arrival_order_does_not_matter(spark, tmp_path):
    lines = [
        ("r", 1, 0, at(0), "001", 3), ("r", 1, 1, at(30), "100", 3), ("r", 1, 2, at(40), "012", 3), ("r", 1, 3, at(50), "100", 3),
        ("r", 1, 4, at(60), "001", 3), ("r", 1, 5, at(70), "100", 3), ("r", 1, 6, at(70), "100", 3), ("r", 1, 7, at(70), "100", 3),
    ]
    want = [("r", 1, "needs_retry", 40.0, 1, 40, 0), ("r", 1, "done", 70.0, 3, 10, 1)]
    for name, parts in (("once", [lines]), ("backwards", [[line] for line in reversed(lines)])):
        feed = Feed(spark, tmp_path / name)
        for part in [*parts, [tick(2000)]]:
            feed.land(part)
        assert feed.process() == want == twin([*lines, tick(2000)])


def test_gives_up_after_the_last_resubmission(spark, tmp_path):
    lines = [line for i in range(6) for line in (("r", 1, 2 * i, at(20 * i), "001", 9), ("r", 1, 2 * i + 1, at(20 * i + 10), "012", 9))]
    feed = Feed(spark, tmp_path, max_resubmits=2)
    feed.land(lines)
    feed.land([tick(3000)])
    assert [(r[2], r[6]) for r in feed.process()] == [("needs_retry", 0), ("needs_retry", 1), ("gave_up", 2)] * 2
    assert twin([*lines, tick(3000)], 2) == feed.process()


def test_random_logs_in_several_batches(spark, tmp_path):
    rng, rows = random.Random(4), []
    for i in range(600):
        rows.append((rng.choice("ab"), rng.randint(0, 12), i, at(i * 40 + rng.random() * 300), rng.choice(["001", "001", "100", "100", "012", "006"]), rng.choice([1, 2, None])))
    feed = Feed(spark, tmp_path, max_resubmits=1)
    for k in range(0, 600, 150):
        feed.land(rows[k : k + 150])
        got = feed.process()
    assert got == twin(rows, 1) and {r[2] for r in got} == {"done", "ended_late", "needs_retry", "gave_up"}


def test_null_times_are_left_out(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.land([("r", 1, 0, None, "001", 1), ("r", 1, 1, at(5), "001", 1), ("r", 1, 2, at(9), "100", 1), (None, None, 2, at(1), "001", 1), tick(9000)])
    assert feed.process() == [("r", 1, "done", 9.0, 1, 4, 0), (None, None, "ended_late", 1.0 + LATE, 0, LATE, 0)]
