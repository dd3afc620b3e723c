"""A probabilistic suffix tree as a language model.

Texts are sequences of tokens (words in lower case, then one end).  The tree predicts them
symbol by symbol: the bytes of the words, a space between words, and the end.

* **Counts.**  Every text adds its ``DEPTH + 1``-grams of bytes and its words to tables that are
  counted in the tasks and summed by a grouping; they grow with the corpus.
* **Contexts.**  A context of ``k`` bytes stays in the tree if its next-symbol distribution
  diverges from that of its suffix by enough, weighted by how often it occurs: the gain in bits is
  more than the description length of its distribution (half a logarithm of its count for each
  symbol), so it is no chance, and at least ``DIVERGENCE`` times the number of symbols.  The gains of one depth add up to 8 bits a
  symbol at most, so at most ``8 / DIVERGENCE`` contexts of a depth stay, at any corpus size.
  Their substrings are added, which makes the tree an automaton.
* **Smoothing.**  A context's distribution is mixed with that of its suffix by the number of
  different symbols seen after it, down to one that gives every byte a share.
* **Words.**  A token's probability is the mean of that of its spelling in the tree and its add-one
  share of the training tokens, in which all unknown words are one.  Frequent words do not depend
  on their spelling; for an unknown word the sum is a lower bound, as other spellings are unknown
  words too.
* **Scores.**  The automaton's state is always the longest suffix in the tree.  A state depends on
  the last ``DEPTH`` symbols only, so texts are cut into rows of one array and scored together.

The unigram base needs the count of every word.  Words of at least ``FREQUENT`` of all tokens, at
most ``1 / FREQUENT`` of them, are sent to all tasks; other words are joined by a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from trajmill import scratch
from trajmill.llm.arrow import map_rows, parts

DEPTH = 5
DIVERGENCE = 2e-6
FREQUENT = 4e-6
#: The weight of a token's add-one share; the tree's spelling has the rest.
WORD_SHARE = 0.5
SPACE, END = b" ", b"\n"
#: Symbols that are counted at once, and different grams and words that a task holds.
_COUNT_AT = 2 << 20
_HELD_GRAMS = 2 << 20
_HELD_WORDS = 200_000
_ROW = 256
#: Symbols that are scored at once.
_SCORE_AT = 1 << 20


def tokens_of(text: str | None) -> list[bytes]:
    """Words of the text, A to Z in lower case, without the end."""
    return (text or "").encode().lower().split()


def body_of(tokens: list[bytes]) -> bytes:
    """The symbols of a text: each word with a space behind it, then the end."""
    return SPACE.join([*tokens, END])


def _codes(bodies: list[bytes]) -> np.ndarray:
    """The gram that ends at each symbol, the last byte lowest; before a text lie end symbols."""
    data = np.frombuffer(b"".join(END * DEPTH + b for b in bodies), dtype=np.uint8)
    starts = np.cumsum([0] + [DEPTH + len(b) for b in bodies[:-1]])
    real = np.ones(len(data), dtype=bool)
    real[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
    code = np.zeros(len(data) - DEPTH, dtype=np.int64)
    for back in range(DEPTH, -1, -1):
        code = (code << 8) | data[DEPTH - back : len(data) - back]
    return code[real[DEPTH:]]


def _merge(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(counts, first)


_COUNT_SCHEMA = pa.schema([("word", pa.binary()), ("code", pa.int64()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and grams of the texts of a task with their counts."""
    words: Counter[bytes] = Counter()
    bodies: list[bytes] = []
    waiting, grams = 0, (np.empty(0, np.int64), np.empty(0, np.int64))

    def word_rows() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays(
            [pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], schema=_COUNT_SCHEMA
        )
        words.clear()
        return rows

    def gram_rows(codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(codes), 100_000):
            part, n = codes[at : at + 100_000], counts[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.binary()), pa.array(part), pa.array(n)], schema=_COUNT_SCHEMA)

    def counted() -> tuple[np.ndarray, np.ndarray]:
        codes, counts = np.unique(_codes(bodies), return_counts=True)
        bodies.clear()
        return _merge(np.concatenate([grams[0], codes]), np.concatenate([grams[1], counts]))

    for part in parts(batches):
        for text in part.column(0).to_pylist():
            tokens = tokens_of(text)
            words.update(tokens)
            words[END] += 1
            bodies.append(body_of(tokens))
            waiting += len(bodies[-1])
            if waiting >= _COUNT_AT:
                grams, waiting = counted(), 0
                if len(grams[0]) > _HELD_GRAMS:
                    yield from gram_rows(*grams)
                    grams = (np.empty(0, np.int64), np.empty(0, np.int64))
            if len(words) >= _HELD_WORDS:
                yield word_rows()
    if bodies:
        grams = counted()
    yield from gram_rows(*grams)
    yield word_rows()


@dataclass(frozen=True)
class Tree:
    """The tree as an automaton: for each state and symbol class the log10 probability and the next state."""

    classes: np.ndarray  # of each byte; one more class for padding
    logs: np.ndarray
    following: np.ndarray

    @property
    def states(self) -> int:
        return len(self.logs)


@dataclass
class Model:
    words: DataFrame  # word, n
    tokens: int
    distinct: int
    frequent: dict[bytes, int]
    tree: Tree


def _mask(symbols: int) -> int:
    return (1 << 8 * symbols) - 1


def train(texts: DataFrame, text: str = "text") -> Model:
    """Count ``texts`` and build the tree.  Null texts count as empty; no rows give a uniform model."""
    schema = "word binary, code bigint, n bigint"
    counted = texts.select(text).mapInArrow(_count, schema).groupBy("word", "code").agg(F.sum("n").alias("n"))
    counted = scratch.materialize(counted, "lm-counts")
    words = counted.filter("word IS NOT NULL").select("word", "n")
    totals = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = int(totals.n or 0), int(totals.v)
    often = words.filter(F.col("n") >= F.lit(FREQUENT * tokens)).toArrow()  # at most 1 / FREQUENT rows
    frequent = dict(zip(often.column("word").to_pylist(), often.column("n").to_pylist(), strict=True))
    return Model(words, tokens, distinct, frequent, _tree(counted.filter("code IS NOT NULL").select("code", "n")))


def _tree(grams: DataFrame) -> Tree:
    """Keep the contexts that diverge, close them under substrings and read their counts."""
    of_depth = [F.struct(F.lit(k).alias("k"), F.col("code").bitwiseAND(F.lit(_mask(k + 1))).alias("gram")) for k in range(DEPTH + 1)]
    stats = grams.select(F.explode(F.array(*of_depth)).alias("g"), "n").groupBy("g.k", "g.gram").agg(F.sum("n").alias("n"))
    stats = scratch.materialize(stats.withColumn("context", F.shiftright("gram", 8)), "lm-grams")
    totals = scratch.materialize(stats.groupBy("k", "context").agg(F.sum("n").alias("total")), "lm-contexts")
    symbols = int(totals.filter("k = 0").agg(F.sum("total")).first()[0] or 0)
    # Each gram next to that of the context's suffix, which lacks the oldest byte.
    shares = stats.join(totals, ["k", "context"]).withColumn("share", F.col("n") / F.col("total"))
    lacking = F.call_function("shiftright", F.lit(_mask(DEPTH + 1)), F.lit(8) * (F.lit(DEPTH + 1) - F.col("k")))
    suffix = F.when(F.col("k") > 0, F.col("gram").bitwiseAND(lacking))
    shares = scratch.materialize(shares.withColumn("suffix", suffix), "lm-shares")
    above = shares.select((F.col("k") + 1).alias("k"), F.col("gram").alias("suffix"), F.col("share").alias("suffix_share"))
    gain = F.sum(F.col("n") * F.log2(F.col("share") / F.col("suffix_share")))
    kept = shares.filter("k > 0").join(above, ["k", "suffix"]).groupBy("k", "context").agg(gain.alias("gain"), F.sum("n").alias("total"), F.count("*").alias("kinds"))
    length = 0.5 * F.col("kinds") * F.log2(F.col("total") + 1)
    kept = kept.filter((F.col("gain") >= F.lit(DIVERGENCE * symbols)) & (F.col("gain") > length))
    parts = []
    for length in range(DEPTH + 1):
        for newest in range(DEPTH + 1 - length):  # how many of the newest bytes are left out
            code = F.shiftright("context", 8 * newest).bitwiseAND(F.lit(_mask(length)))
            parts.append(F.when(F.col("k") >= length + newest, F.struct(F.lit(length).alias("k"), code.alias("context"))))
    states = kept.select(F.explode(F.array_compact(F.array(*parts))).alias("s")).select("s.k", "s.context").distinct()
    nodes = stats.join(scratch.materialize(states, "lm-states"), ["k", "context"]).select("k", "context", "gram", "n")
    # Bounded by DIVERGENCE.  The root is there even if nothing diverges.
    root = stats.filter("k = 0").select("k", "context", "gram", "n")
    table = nodes.filter("k > 0").unionByName(root).toArrow()
    return _automaton(*(table.column(c).to_numpy() for c in ("k", "context", "gram", "n")))


def _automaton(k: np.ndarray, context: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Tree:
    symbol = (gram & 255).astype(np.int64)
    seen = np.unique(symbol)
    classes = np.full(256, len(seen), dtype=np.int64)  # the class of all bytes never seen
    classes[seen] = np.arange(len(seen))
    width = len(seen) + 2  # the last one is padding
    levels = [np.zeros(1, dtype=np.int64)] + [np.unique(context[k == depth]) for depth in range(1, DEPTH + 1)]
    first = np.cumsum([0] + [len(level) for level in levels])
    share = np.zeros((first[-1], width))
    following = np.zeros((first[-1], width), dtype=np.int32)
    for depth, level in enumerate(levels):
        if not len(level):
            continue
        rows = slice(first[depth], first[depth + 1])
        here = k == depth
        counts = np.zeros((len(level), width))
        np.add.at(counts, (np.searchsorted(level, context[here]), classes[symbol[here]]), n[here])
        total, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
        if depth == 0:
            below = np.full((1, width), 1 / 256)  # per byte
            kinds = np.maximum(kinds, 1)
        else:
            parent = first[depth - 1] + np.searchsorted(levels[depth - 1], level & _mask(depth - 1))
            below = share[parent]
            following[rows] = following[parent]
        share[rows] = (counts + kinds * below) / (total + kinds)
        if depth < DEPTH and len(levels[depth + 1]):
            child = levels[depth + 1]
            of = first[depth] + np.searchsorted(level, child >> 8)
            following[of, classes[child & 255]] = first[depth + 1] + np.arange(len(child))
    logs = np.log10(np.maximum(share, 1e-300)).astype(np.float32)
    logs[:, -1], following[:, -1] = 0.0, 0
    return Tree(classes, logs, following)


def tree_logs(tree: Tree, bodies: list[bytes]) -> np.ndarray:
    """The log10 probability of every symbol of the sequences, one sequence after another."""
    pad = tree.logs.shape[1] - 1
    rows = np.full((sum(-(-len(b) // _ROW) for b in bodies), DEPTH + _ROW), pad, dtype=np.int64)
    at = 0
    for body in bodies:
        data = np.frombuffer(END * DEPTH + body, dtype=np.uint8)
        for start in range(0, len(body), _ROW):
            piece = data[start : start + DEPTH + _ROW]
            rows[at, : len(piece)] = tree.classes[piece]
            at += 1
    logs, following, width = tree.logs.ravel(), tree.following.ravel(), pad + 1
    state, out = np.zeros(len(rows), dtype=np.int64), np.empty((len(rows), _ROW), dtype=np.float32)
    for step in range(rows.shape[1]):
        place = state * width + rows[:, step]
        if step >= DEPTH:
            out[:, step - DEPTH] = logs[place]
        state = following[place].astype(np.int64)
    return out[rows[:, DEPTH:] != pad]


class _Scorer:
    """Scores rows in blocks: row, tokens, frequent tokens, their base and model scores, the tree's score, other words.

    Other words come with the log10 probability of their spelling.
    """

    def __init__(self, tree: Tree, frequent: dict[bytes, int], total: int) -> None:
        self.tree, self.frequent, self.total = tree, frequent, total
        self.rows: list[tuple] = []
        self.bodies: list[bytes] = []
        self.size = 0

    def __call__(self, row: tuple) -> Iterator[tuple]:
        tokens = tokens_of(row[1])
        self.bodies.append(body_of(tokens))
        self.rows.append((row[0], [*tokens, END]))
        self.size += len(self.bodies[-1])
        if self.size >= _SCORE_AT:
            yield from self.rest()

    def rest(self) -> Iterator[tuple]:
        rows, bodies = self.rows, self.bodies
        self.rows, self.bodies, self.size = [], [], 0
        symbols = tree_logs(self.tree, bodies) if bodies else np.empty(0)
        at = 0
        for (key, tokens), body in zip(rows, bodies, strict=True):
            starts = np.cumsum([0, *(len(t) + 1 for t in tokens[:-1])])
            spelled = np.add.reduceat(symbols[at : at + len(body)].astype(np.float64), starts)
            at += len(body)
            counts = np.array(list(map(self.frequent.get, tokens)), dtype=np.float64)  # none becomes NaN
            known = np.flatnonzero(~np.isnan(counts))
            n = counts[known]
            mixed = _log_sum(np.log10((n + 1) / self.total) + np.log10(WORD_SHARE), spelled[known] + np.log10(1 - WORD_SHARE))
            rare = np.flatnonzero(np.isnan(counts))
            words, logs = [tokens[i] for i in rare.tolist()], spelled[rare].tolist()
            yield key, len(tokens), len(known), float(np.log10(n + 1).sum()), float(mixed.sum()), float(spelled.sum()), words, logs


def _log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log10 of the sum of two numbers given by their log10."""
    high = np.maximum(a, b)
    return high + np.log10(1 + 10 ** (np.minimum(a, b) - high))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score, tree_score`` for every row of ``docs``.

    Scores are log10 probabilities of the whole text with its end; ``tree_score`` is that of the
    spelling alone.  A null text is an empty one, which is the end alone.  Null ids and repeated
    rows are scored like any others.
    """
    spark = docs.sparkSession
    total = model.tokens + model.distinct + 1
    sent = spark.sparkContext.broadcast((model.tree, model.frequent, total))
    schema = T.StructType(
        [
            T.StructField("row", T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("number", T.LongType())])),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()),
            T.StructField("logs", T.DoubleType()),
            T.StructField("mixed", T.DoubleType()),
            T.StructField("tree_score", T.DoubleType()),
            T.StructField("words", T.ArrayType(T.BinaryType())),
            T.StructField("spelled", T.ArrayType(T.DoubleType())),
        ]
    )
    numbered = docs.select(F.struct(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("number")), F.col(text))
    # Written down once, so that the numbers stay what they are.
    scored = scratch.materialize(map_rows(numbered, lambda: _Scorer(*sent.value), schema, "rest"), "lm-scored")
    rare = scored.select(F.col("row.number").alias("number"), F.explode(F.arrays_zip("words", "spelled")).alias("r"))
    rare = rare.select("number", F.col("r.words").alias("word"), "r.spelled").join(model.words, "word", "left")
    plus_one = F.coalesce("n", F.lit(0)) + 1
    share = F.log10(plus_one * F.lit(WORD_SHARE / total))
    spelled = F.col("spelled") + F.lit(float(np.log10(1 - WORD_SHARE)))
    both = F.greatest(share, spelled) + F.log10(1 + F.pow(F.lit(10.0), F.least(share, spelled) - F.greatest(share, spelled)))
    rare = rare.groupBy("number").agg(
        F.sum(both).alias("rare_mixed"),
        F.sum(F.log10(plus_one)).alias("rare_logs"),
        F.count("n").alias("rare_known"),
    )
    joined = scored.select("row.*", "n_tokens", "n_known", "logs", "mixed", "tree_score").join(rare, "number", "left")
    per_token = F.log10(F.lit(float(total)))
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("mixed") + F.coalesce("rare_mixed", F.lit(0.0))).alias("score"),
        "tree_score",
    )
