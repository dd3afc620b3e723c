"""Best-fit packing of tokenized documents by linear grouping.

What decides a packing is how many pieces there are of each length, at most ``capacity`` numbers
whatever the corpus.  The plan is made from them: large lengths are sorted and cut into groups
of equal cardinality, every length is rounded up to the longest of its group, and the
configurations of these few sizes are optimised as a linear program with column generation.
Actual pieces take the places of their group, which leaves room behind each shorter one; the
rest, large and small, goes best-fit, longest first, into the smallest room that is enough.

The plan never names a piece.  It speaks of the ``r``-th piece of a length, and sequences with
the same content are handled as one run.  The pieces of a length are numbered per task and
shifted by the counts of the tasks before, so no length is gathered in one place.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left, insort
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trajmill import scratch
from trajmill.llm.arrow import Out, parts
from trajmill.llm.packing import SPACE

CAPACITY = 2048
END_ID = 0
#: Plans that are tried: lengths over this share of the capacity are large, and the number of groups.
SETTINGS = ((1 / 2, 256), (1 / 3, 192), (1 / 4, 128), (1 / 8, 64))
#: Steps of the linear program; fewer have always sufficed, and a stop before the optimum costs sequences only.
STEPS = 4000
_ID_BYTES = 4

# Words of these characters are normalised and cut here as the tokenizer does it; all others are left to it.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^a-zß-öø-ÿ0-9\n]+")
#: Stands between the tokens of two words; no id is that large.
_CUT = b"\xff\xff\xff\xff"
#: The tokenizer's own definition; one with another definition encodes whole texts.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = ["NFC", "Replace", "Lowercase"]
MARK = "\x01"
WORDS_HELD = 300_000
LONGEST_HELD = 64
#: Characters that are encoded together.
TEXT_HELD = 1 << 20


@lru_cache(maxsize=2)
def _tokenizers(path: str):
    """The tokenizer, the same without normalising and cutting, the ids that end a word, and the id of the mark."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True  # their strings in a text are ordinary text
    known = json.loads(whole.to_str())
    steps = [s.get("type") for s in (known["normalizer"] or {}).get("normalizers", [])]
    cuts = (known["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    if steps != _NORMAL or cuts[0].get("pattern", {}).get("Regex") != _PATTERN:
        return whole, None, None, None
    bare = Tokenizer.from_str(whole.to_str())
    bare.encode_special_tokens = True
    bare.normalizer = normalizers.Sequence([])
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    vocabulary = whole.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    return whole, bare, ends, bare.encode(MARK, add_special_tokens=False).ids[0]


class WordEncoder:
    """Token ids as little-endian 32-bit bytes.

    No token reaches over white space, so each word is encoded once while it is remembered, and
    looked up once for the texts that are encoded together.  Words are held in two generations, and
    what they are made of in a table of its own; all go with the task.  Very long words are not
    remembered.
    """

    def __init__(self, path: str) -> None:
        self.whole, self.bare, self.ends, self.mark = _tokenizers(path)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {"\n": _CUT}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Encode texts together; the more of them, the fewer calls of the tokenizer."""
        if self.bare is None:
            return [self._ids(self.whole, text).tobytes() for text in texts]
        words, ends = self._words(texts)
        words = words.dictionary_encode()
        known = self._known(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        of, sizes = words.indices.to_numpy(), np.fromiter(map(len, known), np.int64, len(known)) // _ID_BYTES
        ids, firsts, lengths = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes) - sizes, sizes[of]
        before = np.concatenate([[0], np.cumsum(lengths)])
        data = ids[np.repeat(firsts[of] - before[:-1], lengths) + np.arange(before[-1])].tobytes()
        cuts = (before[ends] * _ID_BYTES).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    @staticmethod
    def _words(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
        """The words of all texts, some of them empty, and where each text ends."""
        if any(c in text for text in texts for c in "\x1c\x1d\x1e\x1f"):  # white space to Python and Arrow only
            split = pa.array([re.split(f"[{SPACE}]+", text) for text in texts], pa.list_(pa.string()))
        else:
            split = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
        return split.values, split.offsets.to_numpy()[1:]

    @staticmethod
    def _ids(tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        if len(self.new) > WORDS_HELD:
            self.old, self.new = self.new, {}
        if len(self.tokens) > WORDS_HELD:
            self.tokens = {"\n": _CUT}
        found = list(map(self.new.get, words))
        gaps = [at for at, ids in enumerate(found) if ids is None]
        if self.old:
            for at in gaps:
                found[at] = self.old.get(words[at])
            self.new.update((words[at], found[at]) for at in gaps if found[at] is not None)
            gaps = [at for at in gaps if found[at] is None]
        plain = [at for at in gaps if PLAIN.fullmatch(words[at])]
        for at, ids in zip(plain, self._plain([words[at] for at in plain]), strict=True):
            found[at] = ids
        others = [at for at in gaps if found[at] is None] if len(plain) < len(gaps) else []
        made = self._others([words[at] for at in others])
        for at in others:
            found[at] = made[words[at]]
        self.new.update((words[at], found[at]) for at in gaps if len(words[at]) <= LONGEST_HELD)
        return found

    def _plain(self, words: list[str]) -> list[bytes]:
        """Encode words of plain characters by their tokens."""
        if not words:
            return []
        tokens = TOKENS.findall("\n".join([*words, ""]).lower())
        self._learn(list(set(tokens).difference(self.tokens)))
        data = b"".join(map(self.tokens.__getitem__, tokens))
        cuts = np.flatnonzero(np.frombuffer(data, "<u4") == np.frombuffer(_CUT, "<u4")) * _ID_BYTES
        return [data[a:b] for a, b in zip([0, *(cuts[:-1] + _ID_BYTES).tolist()], cuts.tolist(), strict=True)]

    def _learn(self, tokens: list[str]) -> None:
        """Encode parts of plain words together; each ends with the only id that ends a word."""
        if tokens:
            ids = self._ids(self.bare, " ".join(tokens))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            self.tokens.update(zip(tokens, self._cut(ids, cuts[:-1], cuts), strict=True))

    def _others(self, words: list[str]) -> dict[str, bytes]:
        """Encode words together, with a mark between them that none of them contains."""
        apart = {word: self._ids(self.whole, word).tobytes() for word in words if MARK in word}
        words = [word for word in words if word not in apart]
        if words:
            ids = self._ids(self.whole, f" {MARK} ".join([*words, ""]))
            cuts = np.flatnonzero(ids == self.mark)
            apart.update(zip(words, self._cut(ids, cuts[:-1] + 1, cuts), strict=True))
        return apart

    @staticmethod
    def _cut(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        data = ids.tobytes()
        return [data[a * _ID_BYTES : b * _ID_BYTES] for a, b in zip([0, *starts.tolist()], ends.tolist(), strict=True)]


def _runs(part: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Rows of a slice in runs of bounded text."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
        ids.append(doc_id)
        texts.append(text or "")
        size += len(texts[-1])
        if size > TEXT_HELD:
            yield ids, texts
            ids, texts, size = [], [], 0
    yield ids, texts


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids, doc_tokens`` and, for the numbering by length, ``part, number``."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("part", T.IntegerType()),
            T.StructField("number", T.LongType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = WordEncoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        context, seen, out = TaskContext.get(), Counter(), Out(arrow)
        number_of_part = context.partitionId() if context else 0
        for batch in parts(batches):
            for ids_of, texts in _runs(batch):
                for doc, ids in zip(ids_of, encode(texts), strict=True):
                    ids += end
                    total = len(ids) // _ID_BYTES
                    for piece, start in enumerate(range(0, total, capacity)):
                        length = min(capacity, total - start)
                        own = ids[start * _ID_BYTES : (start + length) * _ID_BYTES]
                        out.add((doc, piece, start, length, own, total, number_of_part, seen[length]), len(own))
                        seen[length] += 1
                        if out.full():
                            yield out.batch()
        yield out.batch()

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(cut, schema)


# The plan.  A range is (length, first, count): pieces of a length by their number.


def best_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity that is worth most, as counts."""
    most = capacity // int(sizes.min())
    room = np.arange(capacity + 1)
    before = room - sizes[:, None]
    fits = before >= 0
    before = np.where(fits, before, 0)
    worth, chosen = np.zeros(capacity + 1), []
    for _ in range(most):
        offers = np.where(fits, worth[before] + prices[:, None], -np.inf)
        best = offers.argmax(0)
        value = offers[best, room]
        chosen.append(np.where(value > worth, best, -1))
        worth = np.maximum(worth, value)
    counts, at = np.zeros(len(sizes)), capacity
    for picks in reversed(chosen):
        if picks[at] >= 0:
            counts[picks[at]] += 1
            at -= sizes[picks[at]]
    return float(counts @ prices), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, by the simplex method with column generation."""
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(STEPS):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, counts = best_configuration(sizes, prices, capacity)
        if value <= 1 + 1e-7:
            break
        used, change = np.linalg.solve(basis, demand), np.linalg.solve(basis, counts)
        ratios = np.where(change > 1e-9, np.maximum(used, 0) / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, ratios.argmin()] = counts
    return list(zip(basis.T.copy(), np.maximum(np.linalg.solve(basis, demand), 0), strict=True))


def equal_groups(lengths: dict[int, int], groups: int) -> list[deque]:
    """Ranges of the lengths, longest first, in groups of equal cardinality; groups that begin with the same length are one."""
    total, made = sum(lengths.values()), []
    at = full = number = 0
    for length in sorted(lengths, reverse=True):
        first = 0
        while first < lengths[length]:
            if at == full:
                number += 1
                full = total * number // groups
                if not (made and made[-1][0][0] == length):
                    made.append(deque())
            count = min(lengths[length] - first, full - at)
            if made[-1] and made[-1][-1][0] == length:
                count_before = made[-1].pop()[2]
                made[-1].append((length, first - count_before, count_before + count))
            else:
                made[-1].append((length, first, count))
            first, at = first + count, at + count
    return made


def _take(group: deque, count: int) -> list[tuple[int, int, int]]:
    """The next ``count`` pieces of a group as ranges."""
    taken = []
    while count:
        length, first, there = group.popleft()
        if there > count:
            group.appendleft((length, first + count, there - count))
            there = count
        taken.append((length, first, there))
        count -= there
    return taken


class Plan:
    """Runs of sequences with the same content, and which pieces are in them.

    A segment ``(length, first, end, sequence, each, offset)`` puts the pieces of ``length`` from
    number ``first`` up to ``end`` into sequences from ``sequence`` on, ``each`` of them side by
    side from ``offset`` on.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.segments: list[tuple[int, int, int, int, int, int]] = []
        self.rooms: list[int] = []  # ascending
        self.runs: dict[int, list[tuple[int, int]]] = {}  # by room: first sequence and number

    def _open(self, number: int) -> int:
        self.sequences += number
        return self.sequences - number

    def _offer(self, room: int, sequence: int, number: int) -> None:
        if number and room:
            if room not in self.runs:
                self.runs[room] = []
                insort(self.rooms, room)
            self.runs[room].append((sequence, number))

    def fill(self, slots: list[list[tuple[int, int, int]]], copies: int) -> None:
        """Open ``copies`` sequences with one piece from each slot."""
        queues = [deque(s) for s in slots]
        while copies:
            number = min(q[0][2] for q in queues)
            sequence, offset = self._open(number), 0
            for q in queues:
                ((length, first, _),) = _take(q, number)
                self.segments.append((length, first, first + number, sequence, 1, offset))
                offset += length
            self._offer(self.capacity - offset, sequence, number)
            copies -= number

    def best_fit(self, length: int, first: int, count: int) -> None:
        """Put pieces of one length into the smallest rooms that are enough, else into new sequences."""
        while count:
            at = bisect_left(self.rooms, length)
            if at < len(self.rooms):
                room = self.rooms[at]
                sequence, number = self.runs[room].pop()
                if not self.runs[room]:
                    del self.runs[room], self.rooms[at]
            else:
                room = self.capacity
                number = -(-count // (room // length))
                sequence = self._open(number)
            each = room // length
            full = min(number, count // each)
            for each_, n in ((each, full), (count - full * each, 1)) if full < number else ((each, full),):
                if each_ and n:
                    self.segments.append((length, first, first + each_ * n, sequence, each_, self.capacity - room))
                    self._offer(room - each_ * length, sequence, n)
                    first, count, sequence, number = first + each_ * n, count - each_ * n, sequence + n, number - n
            self._offer(room, sequence, number)


def grouped_plan(lengths: dict[int, int], capacity: int, share: float, groups: int) -> Plan:
    """Large lengths by configurations of rounded sizes, then the rest best-fit."""
    made = Plan(capacity)
    large = {length: n for length, n in lengths.items() if capacity * share < length < capacity}
    rest: list[tuple[int, int, int]] = [(length, 0, n) for length, n in lengths.items() if length not in large]
    if large:
        queues = equal_groups(large, min(groups, sum(large.values())))
        sizes = np.array([q[0][0] for q in queues])
        demand = np.array([sum(n for _, _, n in q) for q in queues], dtype=float)
        left = demand.astype(int)
        for counts, used in configurations(sizes, demand, capacity):
            own = [(g, int(c)) for g, c in enumerate(counts.round()) if c]
            copies = min([int(used + 1e-6), *(int(left[g]) // c for g, c in own)])
            slots = [_take(queues[g], copies) for g, c in own for _ in range(c)]
            for g, c in own:
                left[g] -= c * copies
            made.fill(slots, copies)
        rest += [r for q in queues for r in q]
    for length, first, count in sorted(rest, reverse=True):
        made.best_fit(length, first, count)
    return made


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Pack ``lengths`` (how many pieces there are of each): the setting that needs the fewest sequences.

    Many small pieces fill any room, and then few large ones a sequence are best; without them
    the configurations decide, and more lengths should take part.
    """
    least = -(-sum(length * n for length, n in lengths.items()) // capacity)
    best = None
    for share, groups in SETTINGS:
        made = grouped_plan(lengths, capacity, share, groups)
        best = made if best is None or made.sequences < best.sequences else best
        if best.sequences == least:
            break
    return best


_SEGMENT = "length bigint, first bigint, last bigint, base bigint, each bigint, place bigint"


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text",
    payload: dict[str, Column] | None = None,
) -> DataFrame:
    """Pieces of all documents with their sequences.

    Columns: ``doc_id, piece, start, length, ids, doc_tokens, sequence_id, offset``; ``ids`` are
    little-endian unsigned 32-bit numbers.  ``payload`` replaces ``ids`` by columns made from it
    before anything is written.

    Every document ends with ``end_id``, so a null or empty text is one token.  Only documents of
    more than ``capacity`` tokens are cut, into pieces of ``capacity``; the last may be
    shorter.  Repeated rows are packed as often as they occur.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    payload = payload or {"ids": F.col("ids")}
    keep = ["doc_id", "piece", "start", "length", *payload, "doc_tokens"]
    cut = cut_documents(docs, tokenizer, capacity, end_id, doc_id, text).withColumns(payload)
    pieces = scratch.materialize(cut.select(*keep, "part", "number"), "pieces")
    by_part = scratch.materialize(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    # At most ``capacity`` rows.
    lengths = {row.length: row.n for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made = plan(lengths, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = pieces.join(shifts, ["part", "length"]).withColumn("rank", F.col("number") + F.col("shift"))
    # The plan's size follows from the capacity and the number of groups, not from the corpus.
    segments = F.broadcast(spark.createDataFrame(made.segments, _SEGMENT).withColumnRenamed("length", "of"))
    inside = F.col("rank") - F.col("first")
    placed = ranked.join(segments, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    return placed.select(
        *keep,
        (F.col("base") + F.call_function("div", inside, F.col("each"))).alias("sequence_id"),
        (F.col("place") + inside % F.col("each") * F.col("length")).alias("offset"),
    )
