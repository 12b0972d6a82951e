"""Bounded memory for Arrow functions over long texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loamdex.session import small_batches



def _release() -> None:
    """Gives memory of finished batches back: idle workers stay alive beside later stages of the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over batches, and memory given back at the end of each task."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _release()

    return wrapped


def map_texts(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) in batches that suit texts; a batch size that the session has set itself is kept."""
    small_batches(df)
    return df.mapInArrow(releasing(run), schema)
