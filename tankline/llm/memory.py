"""What a Python worker remembers from task to task, bounded in bytes and dropped when another operator begins.

Spark reuses its Python workers, so a cache that outlives a task also outlives the query.  A worker holds the working
set of one operator at a time: :func:`working_set` drops any other first.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa

#: Longer keys are made anew each time; about what an entry takes besides its key's and value's lengths.
LONG, ENTRY = 256, 200


class Remembered(dict):
    """A cache of two generations that hold about `most` bytes together; a miss is made by `make`."""

    def __init__(self, make: Callable, most: int = 48_000_000):
        super().__init__()
        self.make, self.half, self.old, self.held = make, most // 2, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > LONG:
            return value
        self.held += ENTRY + len(key) + (len(value) if isinstance(value, bytes) else 0)
        if self.held > self.half:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[key] = value
        return value


def release() -> None:
    """Give freed memory back to the system, as a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives memory back at its end."""

    def run(batches):
        yield from work(batches)
        release()

    return run


_WORKING: dict[Hashable, object] = {}


def working_set(key: Hashable, make: Callable[[], object]):
    """The object that `make` gives, once in a worker until another key is asked for."""
    if key not in _WORKING:
        _WORKING.clear()
        gc.collect()
        release()
        _WORKING[key] = make()
    return _WORKING[key]
