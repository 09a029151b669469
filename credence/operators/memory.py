"""Memory of Python workers: what their allocators keep for later counts as used, in workers that wait as well."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):        # another C library
    _trim = None


def release() -> None:
    """Gives free memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def released(f: Callable) -> Callable:
    """``f`` over an iterator, then what it leaves behind is given back."""
    def run(items: Iterable) -> Iterator:
        release()               # of whatever the worker did before
        yield from f(items)
        release()
    return run


def released_pairs(f: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        release()
        return out
    return run
