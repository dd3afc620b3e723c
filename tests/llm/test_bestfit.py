"""Best-fit packing: the plan puts every piece in one place, the pieces give back the texts' ids."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tests.llm import fixtures
from trajmill.llm import bestfit

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def contents(plan, lengths):
    """What each sequence holds; every piece of every length must be somewhere, once."""
    seen = {length: np.zeros(n, int) for length, n in lengths.items()}
    held = [[] for _ in range(plan.sequences)]
    for length, first, last, sequence, each, offset in plan.segments:
        seen[length][first:last] += 1
        for i in range(last - first):
            held[sequence + i // each].append((offset + i % each * length, length))
    assert all((n == 1).all() for n in seen.values())
    return held


@pytest.mark.parametrize("seed", range(60))
def test_plans_are_whole(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 8, 33, 64, 2048])
    lengths = dict(Counter(rng.randint(1, capacity) for _ in range(rng.choice([0, 1, 5, 300, 3000]))))
    for made in (bestfit.plan(lengths, capacity), bestfit.grouped_plan(lengths, capacity, 1 / 8, 5)):
        for held in contents(made, lengths):
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert 0 < at <= capacity


def test_few_sequences():
    rng = np.random.default_rng(3)
    total = lambda lengths: -(-sum(k * n for k, n in lengths.items()) // 2048)
    mixed = dict(Counter(np.minimum(2048, rng.lognormal(6, 1, 40_000).astype(int) + 1).tolist()))
    assert bestfit.plan(mixed).sequences <= total(mixed) * 1.002 + 1
    # Without small pieces best fit alone wastes a tenth; the configurations do not.
    middle = dict(Counter(rng.integers(500, 900, 20_000).tolist()))
    alone = bestfit.Plan(2048)
    for length in sorted(middle, reverse=True):
        alone.best_fit(length, 0, middle[length])
    assert bestfit.plan(middle).sequences < 0.93 * alone.sequences
    assert bestfit.plan({2048: 3, 1024: 4, 512: 4}).sequences == 3 + 2 + 1


def test_groups_have_equal_cardinality():
    groups = bestfit.equal_groups({9: 5, 8: 7, 3: 8}, 4)
    # The second and the third of four groups are both rounded up to 8 and become one size.
    assert [list(g) for g in groups] == [[(9, 0, 5)], [(8, 0, 7), (3, 0, 3)], [(3, 3, 5)]]


def test_configurations_of_a_known_case():
    found = bestfit.configurations(np.array([6, 4]), np.array([10.0, 10.0]), 10)
    assert sum(used for _, used in found) == pytest.approx(10)


def encode_plainly(path, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoder_equals_the_tokenizer(path):
    rng = random.Random(7)
    letters = list(" \n\t\x01\x1c\x1f\x85\xa0 　'stredvlmABCßÄéÉ1²٣ªµ!-.,<|endoftext|>́İıΣσςﬁ漢字😀​K﻿ͅ")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + ["a" * 300, "", "don't we'll I'VE x's'"]
    encode = bestfit.WordEncoder(path)
    got = [ids for k in range(0, len(texts), 31) for ids in encode(texts[k : k + 31])]
    assert got == encode_plainly(path, texts)


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(bestfit, "WORDS_HELD", 5)
    encode = bestfit.WordEncoder(WORDS)
    texts = [f"word{i} of {i % 7} ! and {'x' * 80}{i % 3}" for i in range(60)]
    assert [encode([t])[0] for t in texts] == encode_plainly(WORDS, texts)
    assert len(encode.new) < 20 and not any(len(w) > bestfit.LONGEST_HELD for w in encode.new)


def test_encoder_looks_a_word_up_once_for_all_texts():
    class Counted(dict):
        asked = 0

        def get(self, word):
            Counted.asked += 1
            return super().get(word)

        def __getitem__(self, word):
            Counted.asked += 1
            return super().__getitem__(word)

    encode = bestfit.WordEncoder(WORDS)
    encode.new = Counted()
    texts = ["the same words and the others "] * 50
    assert encode(texts) == encode_plainly(WORDS, texts)
    assert Counted.asked <= 12


def check_packing(rows, want, capacity):
    """``want`` counts the documents' ids."""
    documents, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length
        documents[(r.doc_id, r.doc_tokens)].append((r.piece, r.start, bytes(r.ids)))
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    found = Counter()
    for (doc_id, tokens), pieces in documents.items():
        per = -(-tokens // capacity)
        assert len(pieces) % per == 0
        by_place = [sorted(p[2] for p in pieces if p[0] == k) for k in range(per)]
        assert all(p[1] == p[0] * capacity for p in pieces)
        for copy in zip(*by_place, strict=True):
            found[(doc_id, b"".join(copy))] += 1
    assert found == want
    return len(sequences)


def test_round_trip_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    ids = encode_plainly(WORDS, [d.text or "" for d in docs])
    want = Counter((d.doc_id, i + b"\0\0\0\0") for d, i in zip(docs, ids, strict=True))
    rows = bestfit.pack(spark.read.parquet(f"{sf}/documents.parquet").repartition(5), WORDS).collect()
    n = check_packing(rows, want, 2048)
    assert n <= 1.003 * sum(r.length for r in rows) / 2048 + 1


def test_query_digest(spark, sf):
    from trajmill.llm.queries import QUERIES

    query = QUERIES["op11_best_fit_packing"](spark, sf)
    assert query.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert dict(query.dtypes)["piece"] == "int" and all(t == "bigint" for c, t in query.dtypes if c != "piece")
    docs = {d.doc_id: d.text or "" for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = dict(zip(docs, encode_plainly(WORDS, list(docs.values())), strict=True))
    for r in query.collect():
        own = (ids[r.doc_id] + b"\0\0\0\0")[4 * r.start : 4 * (r.start + r.length)]
        assert len(own) == 4 * r.length and zlib.crc32(own) == r.ids_crc32


def test_odd_rows(spark):
    docs = fixtures.odd(spark)
    texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    want = Counter((d, i + b"\0\0\0\0") for (d, _), i in zip(texts, encode_plainly(WORDS, [t for _, t in texts]), strict=True))
    check_packing(bestfit.pack(docs, WORDS, 64).collect(), want, 64)
    assert bestfit.pack(fixtures.empty(spark), WORDS).collect() == []
