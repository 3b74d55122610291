"""Bounded-space online packing of token sequences.

Every partition keeps a fixed number of open windows. A document's tokens first fill whole windows of
their own; what remains is placed best-fit, that is into the open window that it leaves least room in.
If it fits none and all windows are open, the fullest is emitted; since pieces may be cut freely, the
head of the remainder fills the room of that window first when both parts keep ``MIN_PIECE`` tokens.
At the end the windows still open, at most ``OPEN_WINDOWS`` per partition, are merged: the leftovers of
``MERGE_PARTITIONS`` partitions meet in one task, which packs them best-fit again from the longest down.

The memory of a task is its batch and its open windows. The pass over the texts is written to the
checkpoint folder, so that emitted and leftover pieces always come from the same pass, also after an
executor is lost.

Ids are the tokenizer file's. The rank file of the same vocabulary gives the same ids for texts of Latin letters
at a third of the time; texts that hold other characters, the beginning of a special token's string or white space
of ``LONG_SPACE`` characters, on which the faster library fails, go to the tokenizer file.

Defined results: a null or empty text is the single end id; repeated rows are packed one by one; an empty
table gives no pieces; columns other than doc_id and text are ignored; a very long text is cut into whole
windows and one remainder.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW = 1024
OPEN_WINDOWS = 32
MIN_PIECE = 16
MERGE_PARTITIONS = 2
END_ID = 0

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FIRST_PASS = PIECES + ", part int, is_open boolean"


LONG_SPACE = 256
#: Characters that the two libraries may class differently, and long white space.
ODD = re.compile(rf"[\x1c-\x1f]|<\||\s{{{LONG_SPACE}}}")


class TokenIds:
    """Ids of texts as arrays of unsigned 32-bit numbers."""

    def __init__(self, tokenizer_file: str, rank_file: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if (text.isascii() or max(text) < "\u0250") and not ODD.search(text):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")


class OpenWindows:
    """The bounded set of open windows of one partition; ``emit`` gets each window that is closed."""

    def __init__(self, emit, capacity: int = WINDOW, slots: int = OPEN_WINDOWS, min_piece: int = MIN_PIECE, cut: bool = True):
        self.emit, self.capacity, self.slots, self.min_piece, self.cut = emit, capacity, slots, min_piece, cut
        self.windows: list[list] = []  # [room, pieces]

    def place(self, length: int, split) -> None:
        """``split(a, b)`` makes the piece of the tokens a to b of what is placed."""
        at = 0
        while length - at:
            left = length - at
            fitting = [w for w in self.windows if w[0] >= left]
            if fitting:
                best = min(fitting, key=lambda w: w[0])
                best[0] -= left
                best[1].append(split(at, length))
                if best[0] == 0:
                    self.windows.remove(best)
                    self.emit(best[1])
                return
            if len(self.windows) >= self.slots:
                fullest = min(self.windows, key=lambda w: w[0])
                room = fullest[0]
                if self.cut and room >= self.min_piece and left - room >= self.min_piece:
                    fullest[1].append(split(at, at + room))
                    at += room
                self.windows.remove(fullest)
                self.emit(fullest[1])
                continue
            self.windows.append([self.capacity, []])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_LONGS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_MERGED_SCHEMA = pa.schema([(c, pa.int64()) for c in _LONGS])
_FIRST_SCHEMA = pa.schema([*_MERGED_SCHEMA, ("part", pa.int32()), ("is_open", pa.bool_())])


def _first_pass(files: tuple[str, str], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = TokenIds(*files)
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        numbered = 0

        def emit(pieces: list[tuple], is_open: bool = False) -> None:
            nonlocal numbered
            sequence, offset = (part << 32) + numbered, 0
            numbered += 1
            for piece in pieces:
                out.append((*piece, sequence, offset, part, is_open))
                offset += piece[2]

        space = OpenWindows(emit, window)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                total = len(ids)
                data = memoryview(ids.tobytes())

                def piece(a: int, b: int, doc_id=doc_id, total=total, data=data) -> tuple:
                    return (doc_id, a, b - a, zlib.crc32(data[4 * a : 4 * b]), total)

                whole = total - total % window
                for a in range(0, whole, window):
                    emit([piece(a, a + window)])
                if total > whole:
                    space.place(total - whole, lambda a, b, piece=piece, whole=whole: piece(whole + a, whole + b))
                if len(out) >= 20_000:
                    yield _batch(out, _FIRST_SCHEMA)
                    out.clear()
        for _, pieces in space.windows:
            emit(pieces, True)
        yield _batch(out, _FIRST_SCHEMA)

    return run


def _merge(window: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        pieces = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        first = (1 << 62) + (key[0].as_py() << 32)
        out, numbered = [], 0

        def emit(pieces: list[tuple]) -> None:
            nonlocal numbered
            offset = 0
            for piece in pieces:
                out.append((*piece, first + numbered, offset))
                offset += piece[2]
            numbered += 1

        # from the longest down with no bound but the leftovers themselves, which are bounded
        space = OpenWindows(emit, window, slots=pieces.num_rows, cut=False)
        for row in zip(*(pieces.column(c).to_pylist() for c in _LONGS[:5]), strict=True):
            space.place(row[2], lambda a, b, row=row: row)
        for _, left in space.windows:
            emit(left)
        return pa.Table.from_batches([_batch(out, _MERGED_SCHEMA)])

    return run


def pack_documents(docs: DataFrame, tokenizer_file: str | None = None, rank_file: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if tokenizer_file is None or rank_file is None:
        import public_tokenizers

        tokenizer_file = tokenizer_file or public_tokenizers.path("byte_bpe_50k.json")
        rank_file = rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken")
    first = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_first_pass((tokenizer_file, rank_file), window), FIRST_PASS))
    closed = first.filter(~F.col("is_open")).drop("part", "is_open")
    merged = (
        first.filter("is_open")
        .withColumn("meeting", F.floor(F.col("part") / MERGE_PARTITIONS).cast("int"))
        .groupBy("meeting")
        .applyInArrow(_merge(window), PIECES)
    )
    return closed.unionByName(merged)
