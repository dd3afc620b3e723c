"""Harmonic packing of tokenized documents.

Lengths fall into reciprocal-capacity classes: class ``j`` holds documents of more than
``capacity / (j + 1)`` and at most ``capacity / j`` tokens, and each of its bins takes exactly
``j`` of them.  Of a document that is longer than a sequence, full sequences are cut off first, and
what is left goes whole into its class.  A bin with its ``j`` documents is filled up by the
beginning of the next document, so there is one cut for each bin at most.  Workers (Spark's
tasks) fill their own bins: nothing is shuffled, and a task that runs again repeats its own
result.

A worker holds an open bin for each class, together fewer than ``capacity`` bins.  At the end
what is left in them is laid end to end into full sequences; the rest, less than one sequence, is
cut into sequences of a power of two, which need no padding.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trajmill.llm.arrow import Out, give_back, text_runs

CAPACITY = 1024
END_ID = 0
# No token reaches from a character that is no white space into following white space, so texts
# can be encoded in chunks that begin there.  These are Unicode's white space characters.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: In texts without these, every space begins a chunk.
IRREGULAR = ("  ", " \n", *"\t\v\f\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))
CACHED_CHUNK = 64
CACHE_SIZE = 250_000
#: Characters that are encoded together.
TEXT_HELD = 4 << 20
_ID_BYTES = 4


def chunk_keys(text: str) -> list[str]:
    """The chunks of a text.  A key without a space in front stands for a chunk with one before it, and the reverse."""
    if text.endswith(" ") or any(map(text.__contains__, IRREGULAR)):
        return [c[1:] if c[0] == " " and not c[1:2].isspace() and len(c) > 1 else " " + c for c in CHUNK.findall(text)]
    keys = text.split(" ")
    keys[0] = " " + keys[0]
    return keys


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer and, by id, the bytes of a token."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    vocabulary = tokenizer.get_vocab()
    bytes_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)  # a token is written with one character per byte
    bytes_of[list(vocabulary.values())] = [len(token) for token in vocabulary]
    return tokenizer, bytes_of


class ChunkEncoder:
    """Token ids as little-endian 32-bit bytes.  A task encodes a frequent chunk once.

    The cache has two generations: when the new one is full it becomes the old one, and chunks
    that are met again move back, so rare chunks are forgotten and the size is bounded.  Long
    chunks are not remembered, and all goes with the task.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer, self.bytes_of = _tokenizer(path)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        return self.all([text])[0]

    def all(self, texts: list[str]) -> list[bytes]:
        """Encode texts together; the more of them, the fewer calls of the tokenizer."""
        if len(self.new) > CACHE_SIZE:
            self.old, self.new = self.new, {}
        keys = list(map(chunk_keys, texts))
        missing = [key for key in set().union(*keys) if key not in self.new]
        unknown = []
        for key in missing:
            ids = self.old.get(key)
            if ids is None:
                unknown.append(key)
            else:
                self.new[key] = ids
        spaced = [key for key in unknown if key[:1] != " "]
        self.new.update(zip(spaced, self.together([" " + key for key in spaced]), strict=True))
        self.new.update((key, self.ids(key[1:]).tobytes()) for key in unknown if key[:1] == " ")
        done = [b"".join(map(self.new.__getitem__, own)) for own in keys]
        for key in missing:
            if len(key) > CACHED_CHUNK:
                del self.new[key]
        return done

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def together(self, chunks: list[str]) -> list[bytes]:
        """Encode chunks that begin with a space as one text, and cut its ids where the chunks end."""
        if not chunks:
            return []
        ids = self.ids("".join(chunks))
        ends = np.cumsum([len(c.encode()) for c in chunks])
        cuts = ((np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1) * _ID_BYTES).tolist()
        data = ids.tobytes()
        return [data[start:end] for start, end in zip([0, *cuts[:-1]], cuts, strict=True)]


def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


@dataclass
class Piece:
    """Tokens of a document from ``start`` on."""

    doc_id: object
    start: int
    ids: bytes
    total: int

    def __len__(self) -> int:
        return len(self.ids) // _ID_BYTES

    def cut(self, at: int) -> tuple[Piece, Piece]:
        """The first ``at`` tokens and the others."""
        return Piece(self.doc_id, self.start, self.ids[: at * _ID_BYTES], self.total), Piece(self.doc_id, self.start + at, self.ids[at * _ID_BYTES :], self.total)


class Worker:
    """The open bins of one task."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        context = TaskContext.get()
        self.first = (context.partitionId() if context else 0) << 33
        self.closed = 0
        self.open: dict[int, list[Piece]] = {}
        self.gaps: list[tuple[int, list[Piece], int]] = []  # class, pieces and room of bins that have their documents

    def add(self, document: Piece) -> Iterator[tuple]:
        """Take in a document; yields the rows of the sequences that it completes."""
        while self.gaps and len(document):
            kind, pieces, room = self.gaps.pop()
            piece, document = document.cut(min(room, len(document)))
            pieces.append(piece)
            if len(piece) == room:
                yield from self.close(kind, pieces)
            else:
                self.gaps.append((kind, pieces, room - len(piece)))
        while len(document) >= self.capacity:
            piece, document = document.cut(self.capacity)
            yield from self.close(1, [piece])
        if len(document):
            kind = self.capacity // len(document)
            pieces = self.open.setdefault(kind, [])
            pieces.append(document)
            if len(pieces) == kind:
                del self.open[kind]
                room = self.capacity - sum(map(len, pieces))
                if room:
                    self.gaps.append((kind, pieces, room))
                else:
                    yield from self.close(kind, pieces)

    def close(self, kind: int, pieces: list[Piece]) -> Iterator[tuple]:
        sequence, offset = self.first + self.closed, 0
        self.closed += 1
        for p in pieces:
            yield p.doc_id, p.start, len(p), p.ids, p.total, sequence, offset, kind
            offset += len(p)

    def rest(self) -> Iterator[tuple]:
        """What lies in open bins, end to end; sequences of class 0."""
        left = [p for _, pieces, _ in self.gaps for p in pieces] + [p for pieces in self.open.values() for p in pieces]
        total = sum(map(len, left))
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << bit for bit in range(self.capacity.bit_length(), -1, -1) if total % self.capacity >> bit & 1]
        left.reverse()
        for size in sizes:
            held = []
            while size:
                piece = left.pop()
                if len(piece) > size:
                    piece, more = piece.cut(size)
                    left.append(more)
                held.append(piece)
                size -= len(piece)
            yield from self.close(0, held)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", held: int = TEXT_HELD) -> DataFrame:
    """Pieces of all documents with their sequences.

    Columns: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset, class``; ``ids`` are
    little-endian unsigned 32-bit numbers, ``class`` the harmonic class of the sequence, 0 for what
    was left at the end of a task.  Every document ends with ``end_id``, so a null or empty text
    is one token.  Repeated rows are packed as often as they occur.  An empty table gives no rows.
    A task encodes about ``held`` characters together; fewer take less memory and more time.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
            T.StructField("class", T.IntegerType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, worker, out = ChunkEncoder(tokenizer), Worker(capacity), Out(arrow)
        end = np.array([end_id], dtype="<u4").tobytes()

        def made() -> Iterator[tuple]:
            for rows in text_runs(batches, held):
                for (doc, _), ids in zip(rows, encode.all([t for _, t in rows]), strict=True):
                    ids += end
                    yield from worker.add(Piece(doc, 0, ids, len(ids) // _ID_BYTES))
            yield from worker.rest()

        for row in made():
            out.add(row, len(row[3]))
            if out.full():
                yield out.batch()
        yield out.batch()
        del encode, worker, out
        give_back()

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)
