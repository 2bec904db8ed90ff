"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweft.operators.components import components
from pixelweft.storage import discard, durable, scratch, shared_dir, small_batches

__all__ = ["WordHashes", "mixed", "chunks", "components", "discard", "durable", "map_texts", "row_key", "scratch", "shared_dir", "small_batches", "table"]

#: Bytes of text that a Python task works on at a time.
CHUNK = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*cols: str):
    """A 64-bit key of a row's content; rows that agree in all of ``cols`` share it."""
    parts = []
    for c in cols:
        parts += [F.col(c).isNull(), F.col(c)]
    return F.xxhash64(*parts)


def chunks(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``CHUNK`` bytes of text; a longer text is a slice by itself."""
    column = batch.column(text)
    size = pc.binary_length(column) if pa.types.is_string(column.type) else pc.multiply(pc.list_value_length(column), 8)
    size = pc.fill_null(size, 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // CHUNK
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def map_texts(df: DataFrame, text: str, keep: list[str], make: Callable[[], Callable], fields: list[T.StructField], uses: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` of ``df`` and new ``fields``, computed from slices of its rows.

    ``make()`` is called once in each task and returns a function from a slice to the arrays of
    the new columns, which may look at ``text`` and ``uses`` too. A kept column with the name of a new one gives way to it. Rows stay where
    they are: no shuffle.
    """
    small_batches(df.sparkSession)
    new = {f.name for f in fields}
    keep = [c for c in keep if c not in new]
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    names = schema.names
    need = df.select(*dict.fromkeys([*keep, text, *uses]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for piece in chunks(batch, text):
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), *work(piece)], names)

    return need.mapInArrow(run, schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """A change of 64 bits in which every bit of the input counts."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def plain_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class WordHashes(dict):
    """64-bit hashes of words; up to ``MEMORY`` words are remembered."""

    MEMORY, LONGEST = 150_000, 48

    def __init__(self, words: Callable[[str | None], list[bytes]] = plain_words):
        super().__init__()
        self.words = words

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word, 42)
        if len(self) < self.MEMORY and len(word) <= self.LONGEST:
            self[word] = h
        return h

    def words_of(self, text: str | None) -> tuple[list[bytes], np.ndarray]:
        words = self.words(text)
        return words, np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    def of(self, text: str | None) -> np.ndarray:
        return self.words_of(text)[1]
