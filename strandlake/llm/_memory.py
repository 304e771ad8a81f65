"""What Python workers keep: they outlive their tasks, and what they hold on to counts beside the next stage's."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

# only glibc has it
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory, which allocators would keep for later, back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def released(work: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """work on batches, after each of which, and at the end, freed memory is given back."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch], *args, **options) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                release()

        yield from work(each(), *args, **options)
        release()

    return run
