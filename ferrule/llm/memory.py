"""Memory of Python workers, which outlive the tasks and the operators that they run.

An operator's tasks find what its earlier tasks have learnt; what other operators left behind goes first, and freed
pages go back to the system when a task ends, so what a worker holds is bounded by one operator.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

_caches: dict[str, Callable[[], None]] = {}


def cache(name: str, clear: Callable[[], None]) -> None:
    """Make an operator's cache known, with what empties it."""
    _caches[name] = clear


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], own: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` in a worker without the caches of others than ``own``; unused memory is given back at its end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, clear in _caches.items():
            if name != own:
                clear()
        try:
            yield from run(batches)
        finally:
            _release()

    return tidied
