"""Rows that Python makes, gathered into Arrow batches of a fair size.

Each batch costs the engine a fixed sum, some half a millisecond, so one for every file or part costs more than its rows do.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa

#: A batch ends at so many rows or so many characters and bytes, whichever comes first.
ROWS, SIZE = 5_000, 4_000_000


def batched(rows: Iterable[tuple], names: Sequence[str], types: Sequence[pa.DataType]) -> Iterator[pa.RecordBatch]:
    waiting: list[tuple] = []
    size = 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting, strict=True), types, strict=True)], names=list(names))

    for row in rows:
        waiting.append(row)
        size += sum(len(v) for v in row if isinstance(v, str | bytes))
        if len(waiting) >= ROWS or size >= SIZE:
            yield made()
            waiting, size = [], 0
    if waiting:
        yield made()


def each(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The batches' rows as Python values, one at a time."""
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            yield tuple(v.as_py() for v in row)
