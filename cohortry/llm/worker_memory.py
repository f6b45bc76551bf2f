"""What a Python worker keeps from one task to the next: the tables of one tokenizer at a time.

Spark uses a worker again for later stages. What an earlier stage has left there would add to the memory of the
next, so asking for another tokenizer's tables lets go of those before, and stages without any can let go of all.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable

import pyarrow as pa

_kept: dict[Hashable, object] = {}


def kept[T](key: Hashable, make: Callable[[], T]) -> T:
    if key not in _kept:
        let_go()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """Free what is kept, and return what Arrow and the C library hold for later to the system."""
    _kept.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim is not None:
        trim(0)
