"""What Python workers remember: one cache at a time.

Spark uses a worker again for later stages, also of other operators.  A cache that starts to be used therefore
empties the one before it, so that a worker holds the words of one stage only.
"""

from __future__ import annotations

from typing import Protocol

import pyarrow as pa


class Clearable(Protocol):
    def clear(self) -> None: ...


_HELD: list[Clearable] = []


def _release() -> None:
    """Give back what Arrow holds of batches that are gone (some 70 MB after a stage of large texts)."""
    pa.default_memory_pool().release_unused()


def hold(cache: Clearable) -> None:
    """Make ``cache`` the one that this worker keeps."""
    if not _HELD or _HELD[0] is not cache:
        for other in _HELD:
            other.clear()
        _release()
        _HELD[:] = [cache]
