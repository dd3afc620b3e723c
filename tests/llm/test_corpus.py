"""Line deduplication, near duplicates, decontamination, language model and the pipeline."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

import corpus_pipeline
from tests.llm.fixtures import PROSE, ROWS, documents, empty, odd
from trajmill.llm import arrow, components, decontaminate, linededup, packing, simhash, suffix_lm
from trajmill.llm.queries import ORACLES, QUERIES, tokenizer_path


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n != "op12_source_divergence"))  # that one is in test_divergence
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(ORACLES[name]).df().sort_values("doc_id").reset_index(drop=True)
    got = QUERIES[name](spark, sf).toPandas()[list(want.columns)].sort_values("doc_id").reset_index(drop=True)
    assert (got.astype(str) == want.astype(str)).all().all() and len(got) == len(want)


LINE = "A banner that is on every site"


def test_lines_on_many_sites_stay_once(spark):
    texts = {i: f"own text number {i}\n{LINE}\nthe end of {i}" for i in range(8)}
    texts[8] = f"{LINE}\n{LINE}"
    docs = documents(spark, texts, {i: f"s{i % 6}" for i in texts})
    got = {r.row.doc_id: (r.text, r.n_removed) for r in linededup.remove_spread_lines(docs, sites=6).collect()}
    assert got[0] == (texts[0], 0) and got[8] == ("", 2)
    assert all(got[i] == (f"own text number {i}\nthe end of {i}", 1) for i in range(1, 8))
    assert linededup.remove_spread_lines(docs, sites=7).filter("n_removed > 0").count() == 0
    nowhere = linededup.remove_spread_lines(docs, sites=6, keep="none")
    assert nowhere.filter(F.col("text").contains(LINE)).count() == 0
    cleaned = linededup.without_spread_lines(docs, sites=6)
    assert cleaned.columns == docs.columns and cleaned.filter("n_chars <> length(text)").count() == 0


def test_far_spread_is_sketched_and_near_spread_counted(spark):
    texts = {i: LINE + "\n" + ("a line that is on five of them" if i < 5 else f"unlike any other {i}") for i in range(400)}
    found = linededup.lines(documents(spark, texts, {i: f"s{i}" for i in texts}), "source", "doc_id", "text", 3)
    rows = linededup.spread_lines(found, 5).collect()
    assert sorted((r.exact, r.spread) for r in rows)[-1] == (True, 5) and len(rows) == 2
    assert abs(next(r.spread for r in rows if not r.exact) - 400) <= 40


def test_line_dedup_of_odd_rows(spark):
    got = linededup.without_spread_lines(odd(spark), sites=2)
    assert got.columns == odd(spark).columns and got.count() == len(ROWS)
    assert got.filter("text IS NULL").count() == 2
    assert linededup.without_spread_lines(empty(spark)).count() == 0


def _roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)] + [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame([*links, (5, 5), (None, 3)], "a long, b long")).collect()}
    want = _roots({n for ab in links for n in ab if ab[0] != ab[1]}, [ab for ab in links if ab[0] != ab[1]])
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _plain_fingerprint(text, words):
    tokens = (text or "").encode().lower().split()
    grams = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    import xxhash

    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprint_components_equal_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in QUERIES["op8_simhash"](spark, sf).collect()}
    prints = {i: _plain_fingerprint(t, 3) for i, t in texts.items()}
    assert all(int(got[i].fingerprint, 16) == p for i, p in prints.items())
    ids = sorted(prints)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {i: r.component_id for i, r in got.items()} == _roots(ids, links)


def test_crowded_blocks_lose_no_link(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(3)]
    prints = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(150)} | set(base)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    rows = [(r.a, r.b) for r in links.collect()]
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 for a, b in rows)
    want = _roots(signed, [(a, b) for n, a in enumerate(signed) for b in signed[n + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2])
    assert _roots(signed, rows) == want


def _similar(a, b):
    x, y = (set(simhash.shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_near_duplicates_equal_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: frozenset(simhash.shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    where = {}
    for i, s in sets.items():
        for h in s:
            where.setdefault(h, set()).add(i)
    pairs = {(a, b) for ids in where.values() if len(ids) > 1 for a in ids for b in ids if a < b}
    roots = _roots(sorted(texts), [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    kept = {r.doc_id for r in simhash.without_near_duplicates(docs).collect()}
    assert len(kept ^ set(roots.values())) <= 0.002 * len(texts)


def test_large_group_of_near_copies(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]

    def copy():
        out = list(words)
        for _ in range(3):
            out[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
        return " ".join(out)

    texts = {0: " ".join(words), **{i: copy() for i in range(1, 150)}, **{i: " ".join(f"q{rng.randrange(10**6)}" for _ in range(60)) for i in range(200, 240)}}
    assert min(_similar(texts[0], texts[i]) for i in range(1, 150)) >= 0.8
    kept = {r.doc_id for r in simhash.without_near_duplicates(documents(spark, texts)).collect()}
    assert kept == {0, *range(200, 240)}


def _planted(size, similarity, rng):
    """Two sets of so many shingle hashes with that similarity."""
    shared = math.ceil(2 * size * similarity / (1 + similarity))
    drawn = np.unique(np.array([rng.getrandbits(64) for _ in range(2 * size - shared)], dtype=np.uint64))
    drawn = rng.sample(drawn.tolist(), len(drawn))
    return [np.array(sorted(s), dtype=np.uint64) for s in (drawn[:size], drawn[:shared] + drawn[size:])]


@pytest.mark.parametrize("size", [1, 5, 20, 45, 100, 1000, 1500, 5000, 20_000])
@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_planted_pairs_share_a_sketch(size, similarity, monkeypatch):
    rng, sketch = random.Random(size), simhash._Sketcher(5)
    monkeypatch.setattr(simhash, "shingle_hashes", lambda hashes, _: hashes)
    found = []
    for _ in range(40):
        a, b = _planted(size, similarity, rng)
        assert len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))  # brute force
        found.append(bool(set(next(sketch((0, a)))[-1]) & set(next(sketch((1, b)))[-1])))
    assert all(found)


@pytest.mark.parametrize("size", [45, 60, 300, 1000, 5000])
def test_pairs_whose_differences_meet_every_sample_share_a_sketch(size, monkeypatch):
    rng, sketch = random.Random(size), simhash._Sketcher(5)
    monkeypatch.setattr(simhash, "shingle_hashes", lambda hashes, _: hashes)
    for other in (size, math.ceil(0.8 * size) + 1):
        shared = math.ceil((size + other) * 0.8 / 1.8)
        for bits in range(2, 14):
            drawn = {rng.getrandbits(64) for _ in range(shared)}
            # One difference after the other lies in the next of two to this power samples.
            apart = [(rng.getrandbits(64) & ~(((1 << bits) - 1) << 7)) | (i % (1 << bits) << 7) for i in range(size + other - 2 * shared)]
            a, b = (np.array(sorted(drawn | set(own)), dtype=np.uint64) for own in (apart[: size - shared], apart[size - shared :]))
            assert len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
            assert set(next(sketch((0, a)))[-1]) & set(next(sketch((1, b)))[-1])


def test_texts_with_too_few_filled_samples_share_a_sketch(monkeypatch):
    """All hashes lie in three of the samples, until very many are dealt."""
    rng, sketch = random.Random(4), simhash._Sketcher(5)
    monkeypatch.setattr(simhash, "shingle_hashes", lambda hashes, _: hashes)
    for drawn in range(40, 400, 9):
        hashes = [(rng.getrandbits(64) & ~(((1 << 12) - 1) << 7)) | (rng.randrange(3) << 7) for _ in range(drawn)]
        gone = int(0.2 * drawn)
        a, b = (np.array(sorted(own), dtype=np.uint64) for own in (hashes, rng.sample(hashes, drawn - gone)))
        assert set(next(sketch((0, a)))[-1]) & set(next(sketch((1, b)))[-1])


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.6, 0.7, 0.95, 1.0])
def test_pairs_at_other_thresholds_share_a_sketch(threshold, monkeypatch):
    rng, sketch = random.Random(7), simhash._Sketcher(5, threshold)
    monkeypatch.setattr(simhash, "shingle_hashes", lambda hashes, _: hashes)
    for size in (3, 39, 41, 80, 130, 900):
        for _ in range(20):
            a, b = _planted(size, threshold, rng)
            assert set(next(sketch((0, a)))[-1]) & set(next(sketch((1, b)))[-1])


@pytest.mark.parametrize("common", [0, 3, 1 << 14])
def test_rarest_shingles_lose_no_pair(spark, monkeypatch, common):
    monkeypatch.setattr(simhash, "PAIRED", 2)
    monkeypatch.setattr(simhash, "COMMON", common)
    rng, texts = random.Random(9), {}
    for i in range(60):
        words = [f"w{k}" for k in range(60)] if i < 40 else [f"v{k}" for k in range(30)]
        for at in rng.sample(range(0, len(words), 5), 2):
            words[at] = f"x{i}-{at}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame([*texts.items(), (0, texts[0])], "key long, text string")
    got = {r.key: r.sketches for r in simhash._rarest(docs, 5, 0.6).collect()}
    assert set(got) == set(texts)
    near = [(a, b) for a in texts for b in texts if a < b and _similar(texts[a], texts[b]) >= 0.6]
    assert near and all(set(got[a]) & set(got[b]) for a, b in near)


def test_sizes_apart_by_the_threshold_have_a_number_of_samples_in_common():
    assert all(set(simhash.samples(n)) & set(simhash.samples(math.ceil(0.8 * n))) for n in range(50, 30_000, 7))


def test_chain_of_versions_is_one_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRED", 3)  # no link is found in a small group alone
    # All share the end, so that sketches are crowded; each version changes three words of the last.
    rng, words, texts = random.Random(8), [f"w{i}" for i in range(400)], {}
    for i in range(250):
        texts[i] = " ".join(words)
        for at in rng.sample(range(24), 3):
            words[at * 5] = f"v{i}-{at}"
    assert all(_similar(texts[i], texts[i + 1]) >= 0.8 for i in range(249)) and _similar(texts[0], texts[249]) < 0.6
    sketches = Counter(k for i, t in texts.items() for k in next(simhash._Sketcher(5)((i, t)))[-1])
    assert max(sketches.values()) > 32
    kept = {r.doc_id for r in simhash.without_near_duplicates(documents(spark, texts)).collect()}
    assert kept == {0}


def test_texts_stay_with_a_group_while_a_link_may_be_unknown(spark):
    # 1 leads; 2 to 4 are similar to it. 5 may be similar to 2 and is out of reach of 3; 6 is far from all.
    met = [(1, 2, 0.8), (1, 3, 0.95), (1, 4, 0.9), (1, 5, 0.65)]
    held = spark.createDataFrame([(0, k) for k in range(1, 7)], "sketch long, key long")
    roots = spark.createDataFrame([(k, 1) for k in range(1, 5)], "node long, root long")
    leaders = spark.createDataFrame([(0, 1)], "sketch long, leader long")
    rest = simhash._unsettled(held, leaders, spark.createDataFrame(met, "a long, b long, similarity double"), roots, 0.8)
    assert sorted(r.key for r in rest.collect()) == [2, 5, 6]


def test_crowded_groups_are_not_paired_up(spark, monkeypatch):
    """Texts that leave out parts of one text, most of them too far from each other to be linked, and edited copies of some."""
    monkeypatch.setattr(simhash, "PAIRED", 8)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng, asked = random.Random(5), []
    base = [f"w{rng.randint(0, 9999)}" for _ in range(130)]
    texts = {}
    for i in range(120):
        gone = set(rng.sample(range(13), 3))
        words = [w for k, w in enumerate(base) if k // 10 not in gone]
        texts[2 * i] = " ".join(words)
        if i % 3 == 0:
            texts[2 * i + 1] = " ".join([*words[:40], f"x{i}", *words[41:]])
    verified = simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *a: asked.append(pairs.distinct().count()) or verified(pairs, *a))
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    links = [(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    kept = {r.doc_id for r in simhash.without_near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert kept == set(_roots(sorted(texts), links).values())
    assert sum(asked) < len(texts) * (len(texts) - 1) / 4


def test_repeats_do_not_part_near_copies(spark):
    rng, texts = random.Random(6), {}
    for i in range(30):
        body, footer = ([f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (400, 30))
        texts[i], texts[100 + i] = " ".join(body + footer), " ".join(body + footer * 20)
        assert _similar(texts[i], texts[100 + i]) >= 0.9
    kept = {r.doc_id for r in simhash.without_near_duplicates(documents(spark, texts)).collect()}
    assert kept == set(range(30))


def test_near_duplicates_of_odd_rows(spark):
    got = simhash.without_near_duplicates(odd(spark))
    assert got.columns == odd(spark).columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 6, 7, 8]  # 3 stands for all texts without words
    assert simhash.without_near_duplicates(empty(spark)).count() == 0
    labels = simhash.fingerprint_components(odd(spark), 3)
    assert labels.count() == len(ROWS) and simhash.fingerprint_components(empty(spark), 3).count() == 0
    twice = documents(spark, {7: "a b c"})
    assert simhash.without_near_duplicates(twice.unionByName(twice)).count() == 1


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abcd", max_size=20))
def test_edit_distance_to_the_nearest_stretch(item, part):
    row = [0] * (len(part) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(part, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    distance, end = decontaminate.edit_distance_within(item, part)
    assert distance == min(row) and (end == row.index(min(row)) or distance == len(item))
    for limit in range(len(item)):
        early, at = decontaminate.edit_distance_within(item, part, limit)
        assert (early, at) == (distance, end) if distance <= limit else early > limit


def _edit_words(text, share, rng):
    words = text.split()
    for _ in range(round(share * len(words))):
        words[rng.randrange(len(words))] = "zzq"
    return " ".join(words)


def test_leaks_are_found_and_clean_rows_left(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    texts, tests = {r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in items.collect()}
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(docs, items).collect()}
    exact = {(i, k) for i, t in texts.items() for k, q in tests.items() if q in t}
    assert exact and exact <= set(found) and all(found[p] == 1.0 for p in exact)
    rng = random.Random(4)
    hosts = [t for i, t in texts.items() if i not in {i for i, _ in found}][:80]
    planted = {i: f"{h[:200]} {_edit_words(tests[i % len(tests)], 0.08, rng)} {h[200:]}" for i, h in enumerate(hosts)}
    clean = {1000 + i: h for i, h in enumerate(hosts)}
    kept = {r.doc_id for r in decontaminate.without_leaks(documents(spark, planted | clean), items).collect()}
    assert set(clean) <= kept and len(kept - set(clean)) <= 2


def test_alignments_together_equal_single_ones():
    rng, pairs = random.Random(3), []
    for i in range(600):
        item = "".join(rng.choice("abcdé ") for _ in range(rng.choice([5, 63, 64, 65, 128, 129, 200, 300])))
        part = "".join(rng.choice("abcdéz ") for _ in range(rng.randrange(0, 3 * len(item))))
        if i % 2:
            part += "".join(c for c in item if rng.random() > 0.1)
        pairs.append((item, part, int(0.2 * len(item))))
    found = decontaminate.edit_distances_within(pairs)
    wanted = [decontaminate.edit_distance_within(*pair) for pair in pairs]
    assert sum(w[0] <= p[2] for w, p in zip(wanted, pairs, strict=True)) > 100
    for got, want, (_, _, limit) in zip(found, wanted, pairs, strict=True):
        assert got == want if want[0] <= limit else got[0] > limit


def test_recall_up_to_the_edit_limit_against_all_alignments(spark, sf):
    """Random edits of characters, up to the limit; every pair of an item and a document is aligned."""
    items = [(r.item_id, decontaminate.normalise(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hosts = [decontaminate.normalise(r.text)[:600] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(400).collect()]
    rng, texts, shares = np.random.default_rng(5), {}, (0.05, 0.1, 0.15, 0.19)
    for i, host in enumerate(h for h in hosts if len(h) == 600):
        if i < 160:
            edited = decontaminate._edited(items[i % 40][1].encode(), shares[i // 40], rng).decode(errors="ignore")
            texts[i] = f"{host[:300]} {edited} {host[300:]}"
        elif i < 200:
            texts[i] = host
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(documents(spark, texts), benchmark).collect()}
    pairs = [(i, k, decontaminate.normalise(t), item) for i, t in texts.items() for k, item in items]
    within = set()
    for i, k, text, item in pairs:
        limit = int(decontaminate.EDITS * len(item))
        if decontaminate.edit_distance_within(item, text, limit)[0] <= limit:
            within.add((i, k))
    assert len(within) >= 155 and found <= within
    assert len(found) >= 0.93 * len(within)
    limit = {(i, k) for i, k in within if 120 <= i < 160}
    assert len(found & limit) >= 0.85 * len(limit)


def test_every_item_within_the_limit_is_found_without_shared_words():
    """Edits in nearly every word, up to the limit: no three words are left to search by."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeinorst"), size=rng.integers(2, 8))) for _ in range(300)]
    items = [(i, " ".join(rng.choice(words, size=n))) for i, n in enumerate([5, 5, 6, 7, 9, 12, 20, 31, 40, 60] * 2)]
    items.append((20, "один два три четыре пять шесть"))
    texts = {-1: "", -2: None, -3: "a"}
    for number in range(210):
        item = items[number % 21][1]
        limit, edited = int(decontaminate.EDITS * len(item)), list(item)
        for at in sorted(rng.choice(len(item), size=limit, replace=False).tolist(), reverse=True):  # at most the limit
            edited[at] = ["", "x" + edited[at], "q"][rng.integers(0, 3)]
        before, after = (" ".join(rng.choice(words, size=n)) for n in rng.integers(0, 30, size=2))
        texts[number] = f"{before} {''.join(edited)} {after}"
    finder = decontaminate.Finder(items, decontaminate.EDITS, decontaminate.RECALL)
    rows = [r for row in texts.items() for r in finder(row)] + list(finder.rest())
    wanted = {}
    for number, text in texts.items():
        for item, own in items:
            distance, _ = decontaminate.edit_distance_within(own, decontaminate.normalise(text))
            if distance <= int(decontaminate.EDITS * len(own)):
                wanted[number, item] = distance
    assert len(wanted) >= 200
    assert {(r[0], r[1]): r[2] for r in rows} == wanted
    for number, item, distance, _, start, end in rows:
        assert decontaminate.edit_distance_within(items[item][1], decontaminate.normalise(texts[number])[:end])[0] == distance


def test_workers_give_back_what_a_task_has_freed(spark, monkeypatch):
    """The next stages share an executor with the workers of the one before."""

    class Frame:
        schema = T.StructType.fromDDL("doc_id long, text string")

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a few words", None]})
    for module, run in (
        (arrow, arrow.map_rows(Frame(), lambda: lambda row: iter([row]), Frame.schema)),
        (packing, packing.pack(Frame(), tokenizer_path())),
    ):
        called = []
        monkeypatch.setattr(module, "give_back", lambda called=called: called.append(1))
        made = run(iter([batch]))
        rows = sum(b.num_rows for b in made)
        assert rows >= 2 and called == [1]
    assert list(arrow.values(pa.array(["a", None] * 700).slice(1))) == [None, "a"] * 699 + [None]


def test_decontamination_of_odd_rows(spark):
    items = documents(spark, {1: PROSE, 2: None, 3: "", 4: "too short"}).select(F.col("doc_id").alias("item_id"), "text")
    found = decontaminate.find_leaks(odd(spark), items).collect()
    assert len(found) == 4 and {r.item_id for r in found} == {1}
    kept = decontaminate.without_leaks(odd(spark), items)
    assert kept.columns == odd(spark).columns and kept.count() == len(ROWS) - 4
    assert decontaminate.find_leaks(odd(spark), items.limit(0)).count() == 0
    assert decontaminate.without_leaks(empty(spark), items).count() == 0


def test_item_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    items = spark.createDataFrame([(i, f"item number {i} has these six words") for i in range(5)], "item_id long, text string")
    assert [len(b) for b in decontaminate.item_blocks(items, "item_id", "text")] == [2, 2, 1]
    docs = documents(spark, {i: f"see item number {i} has these six words there" for i in range(5)})
    assert {r.doc_id for r in decontaminate.find_leaks(docs, items).filter("distance = 0").collect()} == set(range(5))


def test_language_model_equals_a_plain_count(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op6_suffix_lm"](spark, sf).collect()}
    tokens = {i: [*suffix_lm.tokens_of(t), b"\n"] for i, t in texts.items()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(w for i, own in tokens.items() if i not in held for w in own)
    n, v = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(own), sum(w in counts for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
    unseen = [rows[i] for i in held]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_tree_scores_equal_the_longest_suffix(spark):
    texts = ["abracadabra " * 40, "alakazam abra " * 30, "x", ""]
    model = suffix_lm.train(documents(spark, dict(enumerate(texts))))
    tree, depth = model.tree, suffix_lm.DEPTH
    assert tree.states > 10
    # Every state's distribution over bytes sums to one.
    shares = 10 ** tree.logs[:, :-1].astype(float)
    per_class = np.bincount(tree.classes, minlength=shares.shape[1])
    assert np.allclose(shares @ per_class, 1, atol=1e-4)
    body = b"abra cadabra kazam zz \n"
    state, total = 0, 0.0
    for at, byte in enumerate(suffix_lm.END * depth + body):
        if at >= depth:
            total += tree.logs[state, tree.classes[byte]]
        state = tree.following[state, tree.classes[byte]]
    long = body[:-1] * 40 + b"\n"
    logs = suffix_lm.tree_logs(tree, [b"x \n", body, long])
    assert len(logs) == 3 + len(body) + len(long)
    assert math.isclose(logs[3 : 3 + len(body)].sum(), total, rel_tol=1e-5)


def test_language_model_of_odd_rows(spark):
    model = suffix_lm.train(odd(spark))
    rows = suffix_lm.score(odd(spark), model).collect()
    assert len(rows) == len(ROWS) and all(r.score <= 0 and r.base_score <= 0 for r in rows)
    assert sum(r.n_tokens == 1 for r in rows) == 5
    nothing = suffix_lm.train(empty(spark))
    assert suffix_lm.score(odd(spark), nothing).filter("train_tokens = 0 AND n_known = 0 AND score < 0").count() == len(ROWS)
    assert suffix_lm.score(empty(spark), model).count() == 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = corpus_pipeline.scratch.materialize(stage(spark, docs, sf), name)
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= before
            assert (docs.count() == before) == (name == "line_dedup")
            last = docs
    assert docs.filter("start = 0").count() == last.count()
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(q in r.text for r in last.collect() for q in items)


def test_pipeline_stages_of_odd_rows(spark, sf):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), sf).count() == 0
        assert stage(spark, odd(spark), sf).count() > 0


def test_maps_inside_of_extra_columns(spark):
    rows = [(1, "one line of words\nother", "a"), (2, "one line of words\nthird", "b"), (2, "one line of words\nthird", "b"), (3, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "named_struct('m', map('k', doc_id), 'x', array(map('y', source))) AS extra", "map('a', 1) AS top")
    cleaned = linededup.without_spread_lines(df, length=None, sites=2)
    assert sorted((r.doc_id, r.text) for r in cleaned.collect()) == [(1, "one line of words\nother"), (2, "third"), (2, "third"), (3, None)]
    assert sorted(r.doc_id for r in simhash.without_near_duplicates(df).collect()) == [1, 2, 3]


def test_very_many_lines_of_boilerplate(spark):
    lines = [f"boiler plate line {i % 50}" for i in range(20_000)]
    rows = [(i, "\n".join(lines + [f"own line of {i}"]), f"s{i}") for i in range(6)]
    got = {r.doc_id: r for r in linededup.remove_spread_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("row.doc_id", "text", "n_removed").collect()}
    assert got[3].text == "own line of 3" and got[3].n_removed == 20_000
    assert got[0].text == "\n".join(lines[:50] + ["own line of 0"])
