"""Giving memory back between the tasks of a worker."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def release() -> None:
    """Return freed memory to the system: a Python worker lives on after its task, and keeps what it once had."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it keeps its memory
        pass


def released(function: Callable) -> Callable:
    """``function`` over the batches of a task; what it held is given back at the end, also when the reader stops early."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release()

    return run
