"""Words and word hashes of whole Arrow text columns, by numpy over the UTF-8 bytes.

A chunk holds some consecutive rows of a batch, about ``CHUNK_BYTES`` of text, or one longer row, so that memory in a task is
bounded by the longest text. Null texts count as empty. ASCII letters are lower-cased; other characters stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHUNK_BYTES = 1 << 20

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing: digits, letters and everything beyond ASCII
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
#: ``[^\x20\x09-\x0D]``
NONSPACE = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, _BASE, np.uint64), dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.full(max(n, 2 * len(_POWERS)), _BASE, np.uint64), dtype=np.uint64)
    return _POWERS


def mix64(x: np.ndarray) -> np.ndarray:
    """The finishing step of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each row begins (one offset more than rows)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text."""
    _, at = text_buffers(batch.column(text))
    row = 0
    while row < batch.num_rows:
        upto = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield batch.slice(row, upto - row)
        row = upto


@dataclass
class Words:
    raw: np.ndarray  # lower-cased bytes of the chunk
    at: np.ndarray  # where rows begin in raw
    start: np.ndarray  # of each word in raw
    size: np.ndarray  # bytes of each word
    row_at: np.ndarray  # where the words of each row begin, one more than rows
    joined: np.ndarray  # the bytes of all words without what is between them
    joined_at: np.ndarray  # where each word begins in joined, one more than words

    @property
    def n(self) -> int:
        return len(self.start)

    def per_row(self) -> np.ndarray:
        return np.diff(self.row_at)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.row_at) - 1), self.per_row())

    def hashes(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.uint64)
        place = np.arange(len(self.joined)) - np.repeat(self.joined_at[:-1], self.size)
        terms = (self.joined.astype(np.uint64) + np.uint64(1)) * _powers(int(self.size.max()))[place]
        return mix64(np.add.reduceat(terms, self.joined_at[:-1]) + self.size.astype(np.uint64))

    def word(self, i: int) -> str:
        return self.raw[self.start[i] : self.start[i] + self.size[i]].tobytes().decode("utf-8", "replace")


def split_words(column: pa.Array, inside: np.ndarray) -> Words:
    """Maximal runs of the bytes marked in ``inside``; a word never crosses rows."""
    raw, at = text_buffers(column)
    raw = LOWER[raw]
    is_in = inside[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    before = np.concatenate(([False], is_in[:-1])) if len(raw) else is_in
    after = np.concatenate((is_in[1:], [False])) if len(raw) else is_in
    start = np.flatnonzero(is_in & (~before | first[:-1]))
    size = np.flatnonzero(is_in & (~after | first[1:])) + 1 - start
    joined_at = np.concatenate(([0], np.cumsum(size)))
    return Words(raw, at, start, size, np.searchsorted(start, at), raw[is_in], joined_at)


def ngram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words."""
    if len(word_hashes) < n:
        return np.zeros(0, np.uint64)
    upto = len(word_hashes) - n + 1
    out = np.full(upto, np.uint64(n))
    for j in range(n):
        out = out * _BASE + word_hashes[j : j + upto]
    return mix64(out)


def with_columns(df: DataFrame, text: str, fields: list[T.StructField], fn: Callable[[pa.Array], list]) -> DataFrame:
    """Adds columns made from the text, chunk by chunk in one pass without a shuffle; columns of the same names are replaced."""
    new = {f.name for f in fields}
    kept = df.select(*[c for c in df.columns if c not in new])
    names = [*kept.columns, *[f.name for f in fields]]

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c) if not isinstance(c, pa.Array) else c for c in fn(part.column(text))]], names)

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))
