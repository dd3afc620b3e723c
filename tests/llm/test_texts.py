"""Packing, licences, secrets and toxicity."""

import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tests.llm.fixtures import LONG, PROSE, ROWS, documents, empty, odd
from trajmill.llm import licenses, packing, secrets, toxicity
from trajmill.llm.queries import QUERIES, tokenizer_path


def _tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    return tokenizer


TOKENIZER = _tokenizer()
PARTS = ["a", "bc", " ", "  ", "\n", " \n", "\t", " ", "\x0b", "\x1c", "!", "'s", "é", "7", "　", " ", "\x85", "<|endoftext|>", "​", "𝒳", "_", "\r\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_chunks_encode_as_the_whole_text(text):
    got = np.frombuffer(packing.encoder(tokenizer_path())(text), dtype="<u4").tolist()
    assert got == TOKENIZER.encode(text, add_special_tokens=False).ids


def _check_packing(rows, texts, capacity):
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in texts.items():
        ids = np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted(pieces[doc_id], key=lambda r: r.start)
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
        assert b"".join(bytes(r.ids) for r in own) == ids.tobytes() and {r.doc_tokens for r in own} == {len(ids)}
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        total = sum(r.length for r in own)
        assert [r.offset for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
        assert total <= capacity and total & (total - 1) == 0  # full, or a power of two
        # A full bin of a class has its number of documents of that class, and at most one beginning of another behind them.
        kind = own[0]["class"]
        assert len({r["class"] for r in own}) == 1
        if kind:
            assert total == capacity and sum(capacity // r.length == kind for r in own[:kind]) == kind


def test_packing_round_trip(spark):
    texts = {1: PROSE, 2: "", 3: None, 4: LONG, 5: "x", **{i: PROSE[: 3 * i] for i in range(10, 40)}}
    _check_packing(packing.pack(documents(spark, texts), tokenizer_path()).collect(), texts, 1024)
    _check_packing(packing.pack(documents(spark, texts), tokenizer_path(), capacity=64).collect(), texts, 64)


def test_packing_of_odd_rows(spark):
    rows = packing.pack(odd(spark), tokenizer_path()).collect()
    assert sum(r.start == 0 for r in rows) == len(ROWS)
    assert packing.pack(empty(spark), tokenizer_path()).count() == 0


def _plain_spans(text):
    """The base, character by character."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 6:
            out.append(("assign", m.start(), m.end()))
    for kind, first, chars, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), ("hex", "", "0123456789abcdef", 24)):
        at = 0
        while at < len(text):
            end = at + len(first)
            if text.startswith(first, at) and end < len(text) and text[end] in chars:
                while end < len(text) and text[end] in chars:
                    end += 1
                if end - at >= least:
                    out.append((kind, at, end))
                at = end
            else:
                at += 1
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "TOKEN", "api_key", "ApiKey", "=", ": ", " ", '"', "'", "abc", "deadbeef0123", "AKIA", "ABCDEFGH12345678", "\n", "é", "ſecret", "x.y-z", "+"]), max_size=14).map("".join))
def test_base_secrets_equal_a_plain_scan(text):
    base = [s[:3] for s in secrets.find_spans(text) if s[0] in ("assign", "access", "hex")]
    assert base == _plain_spans(text)


@pytest.mark.parametrize(
    "text, found",
    [
        ('a = "hunter2Xyz9"\nb = a\nDB_PASSWORD = b', [("constant", "hunter2Xyz9")]),
        ('base = "Zk9x"\nfull = base + "Qw8e7r"\nauth_token = full', [("constant", "Zk9x"), ("constant", "Qw8e7r")]),
        ('{"clientSecretKey": "aB3dE5fG7hI9"}', [("literal", "aB3dE5fG7hI9")]),
        ("max_tokens = 123456789", []), ('password_hint = "your-password"', []), ('passphrase = input("say it")', []), ("the key: of all things", []),
    ],
)
def test_assignments_and_constants(text, found):
    assert [(kind, text[a:b]) for kind, a, b, *_ in secrets.find_spans(text) if kind in ("literal", "constant")] == found


def test_secret_query_digests_its_spans(spark, sf):
    import hashlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op3_secrets"](spark, sf).collect()
    assert len(rows) == len(docs) and sum(r.n_assign for r in rows) > 0
    for r in rows:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in _plain_spans(docs[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_secrets_of_odd_rows(spark):
    rows = secrets.scan_secrets(odd(spark)).collect()
    assert len(rows) == len(ROWS) and sum(bool(r.spans) for r in rows) == 1
    assert secrets.scan_secrets(empty(spark)).count() == 0


def test_toxicity_ranks_held_out_rows(spark, sf):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op5_toxicity"](spark, sf).collect()]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    right = sum(p == t for p, t in held) / len(held)
    assert right >= 0.95
    assert sum(p and not t for p, t in held) <= 0.02 * len(held)


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({toxicity.fold("idiot").strip() + " ": 5.0, toxicity.fold("clown").strip() + " ": 5.0}, (-3.0, 2.0, 0.0))
    score = lexicon.matcher().score
    for text in ("you idiot", "you 1d10t", "you іdiоt", "IDIOT!", "you id​iot"):
        assert score(text) > 0.5, text
    for text in ("a clown fish", "", None, "idiotic notions", "word " * 50):
        assert score(text) < 0.5, text


def test_toxicity_of_odd_rows(spark):
    lexicon = toxicity.Lexicon({"word": 4.0}, (-3.0, 2.0, 0.0))
    assert toxicity.score_documents(odd(spark), lexicon).filter("score IS NULL").count() == 0
    kept = toxicity.without_toxic(odd(spark), lexicon)
    assert kept.columns == odd(spark).columns and kept.count() < len(ROWS)
    none = toxicity.learn(spark.createDataFrame([], "text string, toxic int"))
    assert toxicity.without_toxic(empty(spark), none).count() == 0 and none.weights == {}


@pytest.fixture(scope="module")
def classifier(spark, sf):
    return licenses.train(spark.read.parquet(f"{sf}/documents.parquet"))


def test_licences_are_found_and_confirmed(spark, sf, classifier):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    marks = {"CC-BY-NC": "CC BY-NC 4.0", "GPL": "GNU General Public", "Apache-2.0": "Apache License", "MIT": "MIT License", "proprietary": "All rights reserved"}
    texts = {r.doc_id: r.text for r in docs.collect()}
    wrong = [r for r in licenses.scan_licenses(docs, classifier).collect() if r.license != next((k for k, v in marks.items() if v in texts[r.doc_id]), "unknown")]
    assert len(wrong) <= 2


def test_licence_variants_and_near_misses(classifier):
    def family(text):
        shares = classifier.probabilities(licenses.features(text))
        best = int(shares.argmax())
        return classifier.families[best] if shares[best] >= licenses.CONFIDENCE else "unknown"

    assert family("The whole of it is licensed under the Mozilla Public License, version 2.0, as stated") == "MPL-2.0"
    assert family("Licensed under CC BY-SA 4.0.") == "CC-BY-SA"
    assert family("The driver showed a valid license to an officer.") == "unknown"
    assert family("") == "unknown"


def test_licences_of_odd_rows(spark, classifier):
    rows = licenses.scan_licenses(odd(spark), classifier).collect()
    assert len(rows) == len(ROWS) and {r.license for r in rows} == {"unknown"}
    assert licenses.scan_licenses(empty(spark), classifier).count() == 0
    assert sorted(licenses.paragraphs("one\ntwo\n\nthree")) == [(0, 3), (0, 7), (4, 7), (9, 14)]


def test_fold_number(spark):
    import zlib

    rows = spark.range(50).select("id", toxicity.fold_number("id", 3).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 3 for r in rows)
    assert spark.range(1).select(toxicity.fold_number(F.lit(None), 3)).first()[0] is None


def _plain_assignments(text):
    """Constants copied at every use: grows with each step, but says the same on small texts."""
    constants, out, done = {}, [], 0
    for op in re.finditer(r":=|=>|[=:]", text):
        if op.start() < done:
            continue
        before = text[: op.start()].rstrip(" \t")
        name = re.search(r"""(?:\A|[^\w.$-])([A-Za-z_$][\w$-]*(?:\.[\w$-]+)*)["']?\]?\Z""", before)
        at, literal, places = op.end(), "", []
        while name and (value := secrets._VALUE.match(text, at)):
            at = value.end()
            known, own = constants.get(value[3], (value[value.lastindex], [value.span(value.lastindex)]))
            literal, places = literal + known, places + own
            plus = re.compile(r"[ \t]*\+[ \t]*").match(text, at)
            if not plus:
                break
            at = plus.end()
        if places:
            done = at
            if text[at : at + 1] != "(":
                constants[name[1]] = literal, places
                out.append((name[1], literal, set(places)))
    return out


CODE = ["password", "a", "b", "api_key", " = ", "=", ": ", " + ", '"s3cr3tV4lue"', "'x'", "b", "\n", "\n", "(", ")", ".", "tok", '"', " ", "] =", ":="]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(CODE), max_size=24).map("".join))
def test_assignments_equal_a_plain_lexer(text):
    got = [(name, literal, set(places)) for name, literal, places, _ in secrets.assignments(text)]
    assert got == [(name, literal[: secrets.SCORED], places) for name, literal, places in _plain_assignments(text)]


def test_constants_that_double_themselves():
    lines = 3000
    text = 'a = "Zx81kQ29vLm4"\n' + "a = a + a\n" * lines + "db_password = a\n"
    spans = [s for s in secrets.find_spans(text) if s[0] == "constant"]
    assert [text[s[1] : s[2]] for s in spans] == ["Zx81kQ29vLm4"]
    chain = 'k0 = "Zx81kQ29vLm4"\n' + "".join(f'k{i} = "Zx81kQ{i:06}" + k{i - 1}\n' for i in range(1, lines)) + f"password = k{lines - 1}\n"
    assert sum(s[0] == "constant" for s in secrets.find_spans(chain)) == lines


@pytest.mark.parametrize("length", [100, 300, 5000, 200_000])
def test_names_of_any_length(length):
    text = f'x\npassword_{"q" * length} = "Zx81kQ29vLm4"'
    assert [text[a:b] for kind, a, b, *_ in secrets.find_spans(text) if kind == "literal"] == ["Zx81kQ29vLm4"]
    spaced = f'password{" " * length}= "Zx81kQ29vLm4"'
    assert [spaced[a:b] for kind, a, b, *_ in secrets.find_spans(spaced) if kind == "literal"] == ["Zx81kQ29vLm4"]


def test_harmonic_bins_cut_little(spark):
    texts = {i: " ".join(["word"] * (1 + i * 37 % 900)) for i in range(400)}
    rows = packing.pack(documents(spark, texts).coalesce(1), tokenizer_path()).collect()
    _check_packing(rows, texts, 1024)
    sequences = {r.sequence_id for r in rows}
    assert len(rows) <= len(texts) + len(sequences)  # one cut for each bin at most
    assert len([s for s in sequences if sum(r.length for r in rows if r.sequence_id == s) < 1024]) <= 10
