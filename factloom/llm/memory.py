"""Python workers outlive their tasks: what a worker no longer needs goes back to the machine.

A worker that turns to a step it was not at lately, or has been idle for a while,
drops the registered caches and returns free memory of its allocators; steady work
keeps its pages, also where a worker goes to and fro between the two steps of a stage.
"""

from __future__ import annotations

import ctypes
import gc
import os
import threading
import time
from collections.abc import Callable, Iterator

import pyarrow as pa

IDLE = 0.5
_caches: list[Callable[[], None]] = []


def dropped_when_done(clear: Callable[[], None]) -> None:
    """Registers what empties a cache of this process."""
    _caches.append(clear)


def release() -> None:
    for clear in _caches:
        clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


class _Keeper:
    """The last two steps of this process; memory goes back when another comes and once nothing ran for IDLE seconds."""

    def __init__(self):
        self.pid, self.busy, self.last, self.used, self.steps = None, 0, 0.0, False, []
        self.lock = threading.Lock()

    def at(self, step: str) -> _Keeper:
        if self.pid != os.getpid():  # workers are forked; threads are not
            self.pid, self.busy, self.steps, self.lock = os.getpid(), 0, [step], threading.Lock()
            threading.Thread(target=self._watch, daemon=True).start()
        if step not in self.steps and not self.busy:
            self.steps = [*self.steps[-1:], step]
            release()
        return self

    def __enter__(self):
        with self.lock:
            self.busy += 1
            self.used = True

    def __exit__(self, *_):
        self.busy -= 1
        self.last = time.monotonic()

    def _watch(self) -> None:
        while True:
            time.sleep(IDLE)
            with self.lock:
                if self.used and not self.busy and time.monotonic() - self.last >= IDLE:
                    self.used = False
                    release()


_keeper = _Keeper()


def busy(step: str) -> _Keeper:
    """The keeper of this process; a closure that names this function is pickled without the keeper."""
    return _keeper.at(step)


def lean(stream: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """For mapInArrow."""
    step = stream.__qualname__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with busy(step):
            yield from stream(batches)

    return run


def lean_group(group: Callable[[pa.Table], pa.Table]):
    """For applyInArrow of one table."""
    step = group.__qualname__

    def run(table: pa.Table) -> pa.Table:
        with busy(step):
            return group(table)

    return run


def lean_groups(groups: Callable[[pa.Table, pa.Table], pa.Table]):
    """For applyInArrow of two tables."""
    step = groups.__qualname__

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        with busy(step):
            return groups(left, right)

    return run
