"""State that operators keep in a Python worker between tasks.

Spark reuses workers, so what one stage keeps would stay in memory under all later ones.
A task says whose state it needs; the state of other operators is dropped and freed
memory goes back to the system. Large blocks are mapped on their own, so they are given
back as soon as they are free instead of leaving holes.
"""

import ctypes
import gc

import pyarrow as pa

_HELD = {}
_SETTLED = []
LARGE = 2 << 20
M_MMAP_THRESHOLD = -3  # fixed value: the C library's name for it


def keep(owner, clear):
    """Let `clear` drop the owner's state when a task of another owner starts."""
    _HELD[owner] = clear


def _settle():
    """Once in a worker: large blocks, Arrow's too, come straight from the system."""
    if not _SETTLED:
        _SETTLED.append(True)
        _call("mallopt", M_MMAP_THRESHOLD, LARGE)
        pa.set_memory_pool(pa.system_memory_pool())


def _call(name, *values):
    try:
        getattr(ctypes.CDLL(None), name)(*values)
    except (AttributeError, OSError):  # not every C library has it
        pass


def enter(owner):
    """Start a task of an operator: drop what others hold in this worker."""
    _settle()
    others = [name for name in _HELD if name != owner]
    for name in others:
        _HELD.pop(name)()
    if others:
        release()


def release():
    """Give free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    _call("malloc_trim", 0)
