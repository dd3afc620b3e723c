"""Text to token ids and back, in Arrow batches.

Python sees only the text column of a batch.  The byte encoder is a reinterpretation of
Arrow buffers; the rank-table encoder calls the tokenizer library once per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

try:  # only rank encoders need it
    import tiktoken
except ImportError:
    tiktoken = None

from trajmill import constants as C
from trajmill.functions.arrays import RUNS, runs_of_spans
from trajmill.operators.chat import IM_LAYOUT, Layout, mask_pieces


class ByteEncoder:
    """Token ids are UTF-8 bytes.  Lengths equal ``octet_length`` of the text."""

    def shared(self, spark: SparkSession) -> ByteEncoder:
        return self

    def open(self) -> ByteEncoder:
        return self

    def encode(self, texts: pa.Array) -> pa.ListArray:
        raw = texts.fill_null("").cast(pa.large_string()).cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = raw.buffers()[2]
        values = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
        values = values[offsets[0] : offsets[-1]].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(values))

    def decode(self, ids: pa.ListArray) -> list[str]:
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
        ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1]], ends)]

    def decode_bytes(self, ids: list[pa.Array]) -> list[bytes]:
        return [part.to_numpy(zero_copy_only=False).astype(np.uint8).tobytes() for part in ids]


class RankEncoder:
    """Byte-pair encoding from a rank table.  Special tokens in the text keep their ids."""

    def __init__(
        self,
        ranks: dict[bytes, int] | Broadcast,
        pattern: str = C.PRETOKEN_PATTERN,
        special: dict[str, int] = C.SPECIAL_TOKENS,
    ):
        self.ranks, self.pattern, self.special = ranks, pattern, special

    def shared(self, spark: SparkSession) -> RankEncoder:
        """The same encoder with its ranks as a broadcast; a rank table is bounded by its ranks."""
        return RankEncoder(spark.sparkContext.broadcast(self.ranks), self.pattern, self.special)

    def open(self) -> RankTask:
        ranks = self.ranks if isinstance(self.ranks, dict) else self.ranks.value
        library = tiktoken.Encoding(
            name="ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens=self.special
        )
        return RankTask(library)


class RankTask:
    """A rank encoder inside one task."""

    def __init__(self, library):
        self.library = library

    def encode(self, texts: pa.Array) -> pa.ListArray:
        rows = [self.library.encode_to_numpy(t or "", allowed_special="all") for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        flat = np.concatenate(rows) if rows else np.empty(0)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))

    def decode(self, ids: pa.ListArray) -> list[str]:
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        return [self.library.decode(flat[a:b].tolist()) for a, b in zip([0, *ends[:-1]], ends)]

    def decode_bytes(self, ids: list[pa.Array]) -> list[bytes]:
        return [self.library.decode_bytes(part.to_pylist()) for part in ids]


Encoder = ByteEncoder | RankEncoder


def rank_encoder(vocab: DataFrame, limit: int = C.VOCAB_RANK_LIMIT, **options) -> RankEncoder:
    """Load a rank table ``(token binary, rank int)`` below the rank limit.

    The limit bounds the number of ranks; more rows than ranks is an error, not a cut.
    """
    rows = vocab.where(F.col("rank") < limit).select("token", "rank").limit(limit + 1).collect()
    ranks = {bytes(r["token"]): r["rank"] for r in rows}
    if len(rows) > limit or len(set(ranks.values())) != len(rows):
        raise ValueError("ranks must be unique")
    return RankEncoder(ranks, **options)


def _parts(batch: pa.RecordBatch, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of about ``size`` bytes, so that long rows do not pile up in a worker."""
    rows = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _with_list(batch: pa.RecordBatch, drop: list[str], columns: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n not in drop]
    return pa.RecordBatch.from_arrays(
        [batch.column(n) for n in kept] + list(columns.values()), names=kept + list(columns)
    )


def _schema(df: DataFrame, without: str, added: str) -> str:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != without]
    return ", ".join([*kept, added])


def encode_column(df: DataFrame, text: str, encoder: Encoder, ids: str = "input_ids") -> DataFrame:
    """Replace a text column by its ids; all other columns pass through."""
    shared = encoder.shared(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = shared.open()
        for batch in (part for whole in batches for part in _parts(whole)):
            yield _with_list(batch, [text], {ids: task.encode(batch.column(text))})

    return df.mapInArrow(run, _schema(df, text, f"`{ids}` array<int>"))


def decode_columns(df: DataFrame, columns: dict[str, str], encoder: Encoder) -> DataFrame:
    """Replace id columns by their texts; ``columns`` maps id column to text column."""
    shared = encoder.shared(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = shared.open()
        for batch in (part for whole in batches for part in _parts(whole)):
            texts = {t: pa.array(task.decode(batch.column(i)), pa.string()) for i, t in columns.items()}
            yield _with_list(batch, list(columns), texts)

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in columns]
    return df.mapInArrow(run, ", ".join([*kept, *(f"`{t}` string" for t in columns.values())]))


def _cut_pieces(
    lens: np.ndarray, rows: np.ndarray, targets: np.ndarray, header: int, n_rows: int, max_length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many tokens of each piece stay and how many of those are a header of the prompt, and row lengths after and before the cut.

    One entry per piece: its length, its row and whether it is an assistant turn.  The last
    piece of each row is the header.
    """
    last = np.append(rows[1:] != rows[:-1], True) if len(rows) else np.empty(0, bool)
    first = np.append(True, rows[1:] != rows[:-1]) if len(rows) else np.empty(0, bool)
    before = np.append(False, targets[:-1])  # of the piece before, inside the row
    # The trailing header stays only behind a turn of another kind.
    keep_piece = ~last | (~before & ~first)
    moved = targets & ~first & ~before  # its header belongs to the turn before

    kept = np.where(keep_piece, lens, 0)
    whole = np.bincount(rows, weights=kept, minlength=n_rows).astype(np.int64)
    row_start = np.cumsum(whole) - whole
    place = np.cumsum(kept) - kept - row_start[rows]
    stay = np.clip(max_length - place, 0, kept)
    return stay, np.where(moved, np.minimum(header, stay), 0), np.minimum(whole, max_length), whole


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The two arrays, element by element in turn."""
    return np.stack([first, second], axis=1).ravel()


def tokenize_rows(
    df: DataFrame,
    encoder: Encoder,
    max_length: int = C.PACK_LENGTH,
    layout: Layout = IM_LAYOUT,
    with_calls: bool = False,
    messages: str = "messages",
) -> DataFrame:
    """Trajectory rows to token columns, without a shuffle.

    Adds ``input_ids, completion_mask, seq_lengths``, the length before the cut ``orig_len``
    and the run-length form of the mask ``mask_runs``.

    Rendering happens in the JVM and each piece is encoded once.  The header of an assistant
    turn that follows another kind of turn belongs to the prompt, and a conversation that
    ends on another kind of turn keeps a trailing header.
    """
    shared = encoder.shared(df.sparkSession)
    others = [c for c in df.columns if c != messages]
    pieces = df.withColumn("_pieces", mask_pieces(F.col(messages), layout, with_calls)).select(
        *others,
        F.concat("_pieces.target", F.array(F.lit(False))).alias("_targets"),
        F.concat("_pieces.text", F.array(F.lit(layout.generation))).alias("_texts"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = shared.open()
        for batch in (part for whole in batches for part in _parts(whole)):
            texts, flags = batch.column("_texts"), batch.column("_targets").flatten()
            rows = np.repeat(np.arange(len(texts)), texts.value_lengths().to_numpy(zero_copy_only=False))
            encoded = task.encode(texts.flatten())
            lens = encoded.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            header = int(lens[-1]) if len(lens) else 0
            targets = flags.fill_null(False).to_numpy(zero_copy_only=False)
            stay, asked, cut, whole = _cut_pieces(lens, rows, targets, header, len(texts), max_length)
            offsets = pa.array(np.append(0, np.cumsum(cut)).astype(np.int32))
            ids = encoded.flatten().to_numpy(zero_copy_only=False)
            if (stay < lens).any():
                ids = ids[np.repeat(np.tile([True, False], len(lens)), _pairs(stay, lens - stay))]
            size = pa.array(cut.astype(np.int32))
            # Each piece is a header of the prompt, often empty, and the rest.
            flag, span = _pairs(np.zeros_like(targets), targets).astype(np.int32), _pairs(asked, stay - asked)
            yield _with_list(
                batch,
                ["_texts", "_targets"],
                {
                    "input_ids": pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                    "completion_mask": pa.ListArray.from_arrays(offsets, pa.array(np.repeat(flag, span))),
                    "seq_lengths": pa.ListArray.from_arrays(pa.array(np.arange(len(cut) + 1, dtype=np.int32)), size),
                    "orig_len": pa.array(whole.astype(np.int32)),
                    "mask_runs": runs_of_spans(flag, span, cut),
                },
            )

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name != messages)
    added = "input_ids array<int>, completion_mask array<int>, seq_lengths array<int>, orig_len int"
    return pieces.mapInArrow(run, f"{kept}{added}, mask_runs {RUNS}")
