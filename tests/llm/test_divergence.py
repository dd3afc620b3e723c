"""The source audit against its SQL and against plain loops."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb

from tests.llm import fixtures
from trajmill.llm import divergence
from trajmill.llm.queries import ORACLES, QUERIES


def plain(rows, least=3):
    """``rows``: lang, source, text."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(a or "", s or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(lower))) for a, s, t in rows]
    found = []
    for lang in {a for a, _, _ in docs}:
        seen, total, groups = Counter(), Counter(), defaultdict(Counter)
        for a, s, words in docs:
            if a == lang:
                seen.update(set(words))
                total.update(words)
                groups[s].update(words)
        kept = [t for t, n in seen.items() if n >= least]

        def shares(counts, kept=kept):
            size = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + divergence.UNIT * (counts[t] + 1) // size for t in kept}

        whole, price = shares(total), lambda p, q: (p - q) * (p - q) // q
        for s, counts in groups.items():
            own = shares(counts)
            parts = {
                "pair": [(sum(price(own[t], other[t]) for t in kept), o) for o in groups if o != s for other in [shares(groups[o])]],
                "term": [(price(own[t], whole[t]), t) for t in kept if counts[t] and own[t] > whole[t]],
            }
            for part, items in parts.items():
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                found += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ordered, 1) if part == "pair" or k <= divergence.RANKS]
    return sorted(found)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute("SELECT lang, source, part, item, value, rank FROM (" + ORACLES["op12_source_divergence"] + ")").fetchall())
    got = QUERIES["op12_source_divergence"](spark, sf)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert rows_of(got) == want


def test_against_plain_loops(spark, monkeypatch):
    rng = random.Random(2)
    words = ["The", "é", "漢字", "a", "B", "straße", "x" * 50, *(f"w{chr(97 + i)}" for i in range(20))]
    rows = []
    for i in range(300):
        lang = rng.choice(["en", "de", None, "xx"])
        text = None if i % 40 == 0 else rng.choice([" ", "1", "-", "\x00"]).join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 30)))
        rows.append((lang, rng.choice(["s1", "s2", "S", None, "ü"]) if lang != "xx" else "only", text))
    rows += [("zz", "empty", ""), ("zz", "other", None), ("yy", "rare", "once twice")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    want = plain(rows)
    assert rows_of(divergence.audit_sources(df)) == want
    assert ("zz", "empty", "pair", "other", 0, 1) in want
    # Small blocks, narrow products and early hand-overs change nothing.
    monkeypatch.setattr(divergence, "BLOCK_ROWS", 7)
    monkeypatch.setattr(divergence, "BLOCK_COLUMNS", 3)
    monkeypatch.setattr(divergence, "HELD", 5)
    assert rows_of(divergence.audit_sources(df)) == want


def test_joint_tables_count_terms(spark):
    rows = [("en", "a", "x x y z"), ("en", "a", "x y z"), ("en", "b", "x y"), ("en", "b", "y"), ("en", "c", "z")]
    groups, counts = divergence.group_counts(spark.createDataFrame(rows, "lang string, source string, text string"))
    name = {r.group: r.source for r in groups.collect()}
    got = Counter()
    for r in divergence.joint_tables(groups, counts).collect():
        pair = sorted([(name[r.a], r.level_a), (name[r.b], r.level_b)])
        got[tuple(pair)] += r.terms
    assert got == {(("a", 3), ("b", 1)): 1, (("a", 2), ("b", 2)): 1, (("a", 2), ("c", 1)): 1}


def test_shares_do_not_overflow(spark):
    values = [(0, 0, 0), (0, 0, 1), (5, 10, 3), (9_000_000_000, 9_500_000_000, 7), (4 * 10**15, 9 * 10**15, 10**6), (9_223_372_034, 10**10, 1), (9_223_372_035, 10**10, 1)]
    df = spark.createDataFrame(values, "n long, total long, kept long").select(divergence.share(*(divergence.F.col(c) for c in ("n", "total", "kept"))).alias("p"))
    assert [r.p for r in df.collect()] == [1 + divergence.UNIT * (n + 1) // max(1, t + k) for n, t, k in values]
    assert divergence.UNIT * math.prod((3, 3)) < 1 << 63


def test_odd_rows(spark):
    docs = fixtures.odd(spark)
    rows = [(r.lang, r.source, r.text) for r in docs.select("lang", "source", "text").collect()]
    assert rows_of(divergence.audit_sources(docs)) == plain(rows)
    assert divergence.audit_sources(fixtures.empty(spark)).collect() == []
