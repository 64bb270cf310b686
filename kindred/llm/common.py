"""What the operators of this subpackage share: text defaults, words, hashes and memory."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from kindred.scratch import materialise, release, scratch_path, shared_dir

__all__ = ["SPACES", "WORD", "chunks_by_bytes", "materialise", "mix64", "partitions", "release", "scratch_path", "shared_dir", "tidily", "utf8", "whole_text"]

#: A word is a run of anything but the six ASCII white-space characters; ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(column: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


def utf8(column) -> list[bytes]:
    """An Arrow string column as bytes; null is empty. Nothing is decoded."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def tidily(run):
    """``run`` for ``mapInArrow``, after which the worker gives back the memory that its task used. Workers live on
    between tasks and stages, and what they keep is missing to the executor."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow

            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return wrapped


def chunks_by_bytes(texts: list[bytes], most: int):
    """Index ranges of consecutive texts that hold about ``most`` bytes, one text at least."""
    begin, held = 0, 0
    for i, x in enumerate(texts):
        if held and held + len(x) > most:
            yield begin, i
            begin, held = i, 0
        held += len(x)
    if begin < len(texts):
        yield begin, len(texts)
