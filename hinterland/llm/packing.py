"""Packing by powers of two: each document is cut into pieces of binary lengths."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hinterland.llm.segments import space_pieces
from hinterland.llm.worker import kept

LONGEST = 1024
_END = b"\0\0\0\0"
#: Distinct pieces whose ids a worker remembers at most; then it starts afresh.
_REMEMBER = 800_000
_MARKS = (".", ",", ";", ":", "!", "?", ")")


class _Words(dict):
    """Ids of words as the pattern splits them, as little-endian 32-bit integers."""

    def __init__(self, tokenizer) -> None:
        self._merge = tokenizer.model.tokenize
        shown = tokenizer.pre_tokenizer.pre_tokenize_str
        self._shown = {}
        for point in range(128):
            [(text, _)] = shown(chr(point))
            self._shown[point] = text
        for point in range(128, 2048):
            [(text, _)] = shown(chr(point))
            data = chr(point).encode()
            self._shown[data[0]], self._shown[data[1]] = text

    def ids(self, shown: str) -> bytes:
        ids = [t.id for t in self._merge(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        self[word] = found = self.ids(word.encode().decode("latin-1").translate(self._shown))
        return found


class _Ids(dict):
    """Ids of the pieces met so far; new ones are encoded.

    Letters with at most one of these marks behind are split at sight, as the pattern does it.
    """

    def __init__(self, tokenizer, lead: str, words: _Words) -> None:
        self._split = tokenizer.pre_tokenizer.pre_tokenize_str
        self._words = words
        self._lead = lead

    def __missing__(self, piece: str) -> bytes:
        whole = self._lead + piece
        if piece.isalpha():
            words = [whole]
        elif piece[-1:] in _MARKS and piece[:-1].isalpha():
            words = [whole[:-1], whole[-1]]
        else:
            words = None
        if words:
            found = b"".join(map(self._words.__getitem__, words))
        else:
            found = b"".join(self._words.ids(w) for w, _ in self._split(whole))
        self[piece] = found
        return found


class PieceEncoder:
    """Ids of texts by a ``tokenizers`` file; pieces between spaces are encoded once.

    The file has to be byte-level BPE without a normaliser. Strings of special tokens in a
    text are ordinary text.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        if self._tokenizer.normalizer is not None:
            raise ValueError(f"{path} normalises texts")
        self._forget()

    def _forget(self) -> None:
        words = _Words(self._tokenizer)
        self._first, self._later = _Ids(self._tokenizer, "", words), _Ids(self._tokenizer, " ", words)

    def __call__(self, text: str) -> bytes:
        pieces = space_pieces(text)
        if pieces is None:
            ids = self._tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        if len(self._first) + len(self._later) > _REMEMBER:
            self._forget()
        return self._first[pieces[0]] + b"".join(map(self._later.__getitem__, pieces[1:]))


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Whole pieces of ``longest``, then the binary digits of the rest, largest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1)
                                         if rest >> k & 1]


def pack_pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    longest: int = LONGEST, with_ids: bool = True,
) -> DataFrame:
    """One row a piece, which is a sequence of its own: ``doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, bucket`` and, if asked for, ``ids``.

    A document's ids and a final 0 are cut into pieces of power-of-two length up to ``longest``
    (itself a power of two), so that sequences of one bucket are equally long, need no padding
    and never cross documents. ``sequence_id`` numbers the rows of each task. The work is row
    by row and shuffles nothing.

    NULL and empty texts have the final id only. Repeated rows and rows without an id are packed
    like others; other columns are ignored.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What a worker has met serves its later tasks.
        encode = kept(("pieces", tokenizer), lambda: PieceEncoder(tokenizer))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                names = part.column(0).to_pylist()
                columns: list[list] = [[] for _ in fields]
                for name, text in zip(names, part.column(1).to_pylist()):
                    ids = encode(text or "") + _END
                    n, start = len(ids) // 4, 0
                    for length in binary_lengths(n, longest):
                        piece = ids[4 * start:4 * (start + length)]
                        row = [name, start, length, zlib.crc32(piece), n]
                        if with_ids:
                            row.append(np.frombuffer(piece, "<i4"))
                        for column, value in zip(columns, row):
                            column.append(value)
                        start += length
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    spark_schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    pieces = rows.mapInArrow(run, spark_schema + (", ids array<int>" if with_ids else ""))
    return pieces.withColumns({
        "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"),
        "bucket": F.col("length")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each length, which a trainer reads as a batch of equal sequences."""
    pieces.write.partitionBy("bucket").parquet(path)
