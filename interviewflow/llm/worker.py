"""Small helpers that run inside Python workers."""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType
from typing import Any


def once_per_worker(key: str, make: Callable[[], Any], most: int = 4) -> Any:
    """``make()`` of the first call in this worker process; later tasks of the process get the same object.

    The process keeps the ``most`` objects that were used last.
    """
    module = sys.modules.setdefault("interviewflow_worker_cache", ModuleType("interviewflow_worker_cache"))
    kept = module.__dict__.setdefault("kept", {})
    found = kept.pop(key) if key in kept else make()
    kept[key] = found
    while len(kept) > most:
        kept.pop(next(iter(kept)))
    return found


def slices(batches, column: int | str, size: int = 4 << 20):
    """The rows of Arrow batches in slices of about ``size`` bytes of a text column, a longer text alone."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        cells = batch.column(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(cells), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(at, end - at)
            at = end


def byte_texts(column) -> list[bytes]:
    """Cells of an Arrow string column as UTF-8; null is empty."""
    import pyarrow as pa

    return [cell or b"" for cell in column.cast(pa.large_binary()).to_pylist()]
