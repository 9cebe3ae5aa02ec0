"""Python workers live through many tasks and stages: what a task has freed goes back to the system."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from functools import lru_cache, wraps

import pyarrow as pa

# The allocator's option, and the size from which an array has pages of its own.
MMAP_THRESHOLD, OWN_PAGES = -3, 4 << 20


@lru_cache(maxsize=1)
def _allocator() -> ctypes.CDLL | None:
    """The C library, told to keep large arrays apart; None where it has no such calls."""
    try:
        library = ctypes.CDLL("libc.so.6")
        library.mallopt(MMAP_THRESHOLD, OWN_PAGES)
        library.malloc_trim  # noqa: B018
    except (OSError, AttributeError):
        return None
    return library


def give_back() -> None:
    """Return freed memory of Python, numpy and Arrow to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    library = _allocator()
    if library is not None:
        library.malloc_trim(0)


def frugal(work: Callable) -> Callable:
    """A function of a group or of two, after which what it has freed is given back; Spark counts its parameters."""

    def run(*args):  # noqa: ANN002, ANN202
        _allocator()
        try:
            return work(*args)
        finally:
            give_back()

    shapes = {1: lambda table: run(table), 2: lambda first, second: run(first, second), 3: lambda key, left, right: run(key, left, right)}
    return shapes[work.__code__.co_argcount]


def frugal_stream(work: Callable) -> Callable:
    """The same for a function that turns batches into batches."""

    @wraps(work)
    def run(batches):  # noqa: ANN001, ANN202
        _allocator()
        try:
            yield from work(batches)
        finally:
            give_back()

    return run
