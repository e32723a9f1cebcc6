"""Objects that a Python worker keeps from task to task."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` returned when this process first asked for ``key``.

    The package's functions travel to tasks by value, so their module's globals last for one
    task only; a module of the process outlives it.
    """
    store = sys.modules.setdefault("_hinterland_worker", types.ModuleType("_hinterland_worker"))
    return store.__dict__.setdefault("made", {}).get(key) or store.made.setdefault(key, make())


def give_back() -> None:
    """Forget what is ``kept`` and return freed memory to the machine.

    Idle processes hold on to both, next to an executor that may need the room for a step
    without any Python. What the next task needs it makes again.
    """
    store = sys.modules.get("_hinterland_worker")
    if store is not None:
        store.__dict__.get("made", {}).clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass
