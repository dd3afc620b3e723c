"""Periodic runs against a scan of all places, and in linear time."""

import random
import time

import pytest

from trajmill.operators import periodic


def plain(text, periods, repeats):
    best = None
    for p in range(periods[0], periods[1] + 1):
        at = 0
        while at + p < len(text):
            end = at
            while end + p < len(text) and text[end] == text[end + p]:
                end += 1
            length = end - at + p
            if length >= p * repeats and len(set(text[at : at + p])) > 1 and (best is None or length > best[2]):
                best = (p, at, length)
            at = end + 1
    return best


@pytest.mark.parametrize("seed", range(200))
def test_against_a_plain_scan(seed):
    rng = random.Random(seed)
    letters = rng.choice(["ab", "abc", "aé漢😀"])
    text = "".join("".join(rng.choices(letters, k=rng.randint(1, 6))) * rng.randint(1, 9) for _ in range(rng.randint(0, 12)))
    for periods, repeats in (((2, 20), 10), ((2, 5), 3), ((3, 3), 2)):
        assert periodic.longest_run(text, periods, repeats) == plain(text, periods, repeats)


def test_known_texts():
    assert periodic.longest_run("x" + "symp" * 15000) == (4, 1, 60000)
    assert periodic.longest_run("abc" * 9) is None and periodic.longest_run("abc" * 10) == (3, 0, 30)
    assert periodic.longest_run("-" * 500) is None and periodic.longest_run("") is None
    assert periodic.longest_run("0123456789abcdefghij" * 10) == (20, 0, 200)
    assert periodic.longest_run("ab" * 10 + "c" + "de" * 10) == (2, 0, 20)


def test_linear_time():
    text = "".join(random.Random(1).choices("abcdefgh \n", k=1 << 20))
    start = time.process_time()
    assert periodic.longest_run(text) is None and periodic.longest_run("ab" * (1 << 19)) == (2, 0, 1 << 20)
    assert time.process_time() - start < 5


def test_columns(spark):
    rows = spark.createDataFrame([(1, "hello " + "ha" * 20, "k"), (2, None, "k"), (3, "", "k"), (4, "plain words", "k")], "id int, text string, period_of string")
    got = {r.id: (r.period, r.run_start, r.run_length, round(r.run_share, 3)) for r in periodic.periodic_texts(rows, "text").collect()}
    assert got == {1: (2, 6, 40, 0.87), 2: (None, None, None, 0.0), 3: (None, None, None, 0.0), 4: (None, None, None, 0.0)}
